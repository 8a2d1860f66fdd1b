import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convolens.operators import render, sessionize
from convolens.operators.sessionize import fold


def frame(spark, rows):
    """rows: (id, chat, ts, text)."""
    return spark.createDataFrame([(i, c, float(t), True, None, x, False) for i, c, t, x in rows], "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean")


def windows(df, **kw):
    return [(r.chat_id, r.position, r.msg_ids) for r in sessionize.chunk_messages(df, **kw).orderBy("chat_id", "position").collect()]


def test_pause_cuts_without_overlap(spark):
    df = frame(spark, [(1, 1, 0, "a"), (2, 1, 2700, "b"), (3, 1, 5401, "c"), (4, 2, 0, "d")])
    assert windows(df) == [(1, 0, [1, 2]), (1, 1, [3]), (2, 0, [4])]


def test_count_cuts_with_overlap(spark):
    df = frame(spark, [(i, 1, i * 30, "a b") for i in range(7)])
    assert windows(df, max_messages=4) == [(1, 0, [0, 1, 2, 3]), (1, 1, [2, 3, 4, 5]), (1, 2, [4, 5, 6])]


def test_tokens_cut(spark):
    df = frame(spark, [(i, 1, i, "w " * 30) for i in range(4)])
    assert windows(df, token_target=70, overlap=0) == [(1, 0, [0, 1]), (1, 1, [2, 3])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(1, 100), st.integers(1, 8), st.integers(0, 3))
def test_fold_covers_all(tokens, target, most, overlap):
    cuts = fold(tokens, target, max(most, overlap + 1), overlap)
    assert sorted({i for s, e in cuts for i in range(s, e)}) == list(range(len(tokens)))
    assert all(a < b for a, b in cuts) and all(e1 - s2 in (min(overlap, e1 - s1), 0) or s2 >= s1 for (s1, e1), (s2, _) in zip(cuts, cuts[1:], strict=False))
    assert [e for _, e in cuts] == sorted({e for _, e in cuts})


def test_diff(spark):
    old = spark.createDataFrame([(5, 1, [1, 2]), (6, 1, [2, 3]), (7, 2, [9])], "chunk_id long, chat_id long, msg_ids array<long>")
    new = spark.createDataFrame([(1, 0, [1, 2]), (1, 1, [2, 3, 4]), (1, 2, [4, 5]), (3, 0, [20])], "chat_id long, position int, msg_ids array<long>")
    got = {(r.chat_id, r.position): (r.action, r.chunk_id) for r in sessionize.positional_diff(new, old).collect()}
    assert got == {(1, 0): ("same", 5), (1, 1): ("rewrite", 6), (1, 2): ("insert", 8), (2, 0): ("delete", 7), (3, 0): ("insert", 9)}


def test_labels_and_texts(spark):
    rows = [("w", 0, True, None, "hi https://www.x.org/p", False), ("w", 1, False, "b", "yes", True), ("w", 2, False, "a", "", True), ("w", 3, False, "b", None, False), ("v", 0, False, "z", "solo", False)]
    df = spark.createDataFrame(rows, "w string, pos int, is_from_me boolean, handle string, text string, has_attachment boolean")
    sem = {r.w: r.body_semantic for r in render.semantic_text(df, ["w"]).collect()}
    assert sem == {"w": "Me: hi [link:x.org]\nA: yes [attachment]\nB: [attachment]", "v": "Them: solo"}
    lex = {r.w: r.body_lexical for r in render.lexical_text(df.withColumn("files", F.array(F.lit("a.jpg"))), ["w"]).collect()}
    assert lex["w"] == "hi https://www.x.org/p\nyes [attachment a.jpg]\n[attachment a.jpg]"


def test_random_chats_against_a_loop(spark):
    r = random.Random(2)
    rows, ts = [], 0
    for i in range(300):
        ts += r.choice([1, 60, 2700, 2701, 9000])
        rows.append((i, i // 100, ts, "w " * r.randint(0, 90)))
    expected = []
    for chat in range(3):
        k, run = 0, []
        own = [x for x in rows if x[1] == chat]
        for x in [*own, None]:
            if x is None or run and x[2] - run[-1][2] > 2700:
                for s, e in fold([len(y[3].split()) for y in run], 400, 40, 2):
                    expected.append((chat, k, [y[0] for y in run[s:e]]))
                    k += 1
                run = []
            run.append(x)
    assert windows(frame(spark, rows).repartition(5)) == expected
