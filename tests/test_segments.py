"""Incremental builds: small segments, and the same index as a full rebuild."""

import random

import pytest
from pyspark.sql import functions as F

from convolens.plans.parse import ParsedQuery
from convolens.plans.search import Engine, build_index
from convolens.sources import store as S
from convolens.sources.store import IndexStore

SCHEMA = "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean"
WORDS = "lease beach dinner photos train ticket garden window paper river stone cloud".split()


def message(i, chat, at, text):
    return (i, chat, 1_700_000_000.0 + at, i % 2 == 0, None if i % 2 == 0 else f"h{chat}", text, False)


def talk(seed=1, chats=5, n=12):
    r = random.Random(seed)
    return {c * 1000 + i: message(c * 1000 + i, c, c * 90_000 + i * 1700, " ".join(r.choices(WORDS, k=5))) for c in range(chats) for i in range(n)}


def content(spark, root):
    """The tables with windows named by their messages instead of their ids."""
    at = IndexStore(spark, root).snapshot()
    name = {r.chunk_id: (r.chat_id, *r.msg_ids) for r in at.read("chunks").collect()}
    assert len(name) == at.read("chunks").count()
    by = lambda table, *columns: sorted((name[r.chunk_id], *(str(r[c]) for c in columns)) for r in at.read(table).collect())
    return {
        "chunks": by("chunks", "position", "start_ts", "end_ts", "body_semantic", "body_lexical"), "postings": by("postings", "term", "tf", "dl", "positions"), "doc_stats": by("doc_stats", "dl"),
        "vectors": by("vectors", "norm", "embedding"), "chunk_message": by("chunk_message", "msg_id"), "terms": sorted(map(tuple, at.read("terms").collect())), "meta": {k: at.meta[k] for k in ("n_docs", "sum_dl", "avgdl", "last_msg_id")},
    }


def build(spark, rows, root, **k):
    build_index(spark, spark.createDataFrame(list(rows.values()), SCHEMA), root, **k)
    return IndexStore(spark, root).snapshot()


def test_one_message_writes_one_small_segment(spark, tmp_path):
    root, rows = str(tmp_path / "i"), talk()
    first = build(spark, rows, root)
    rows[9000] = message(9000, 2, 2 * 90_000 + 12 * 1700, "a late word about the lease")
    then = build(spark, rows, root)
    assert then.segments[0] == first.segments[0] and len(then.segments) == 2
    # the new message's window, and the one before it, which ended with the chat
    assert then.segments[1]["rows"] <= 2 and then.segments[1]["dead"] <= 1 and then.segments[0]["rows"] > 4
    again = build(spark, rows, root)
    assert again.segments == then.segments and again.version != then.version
    build(spark, rows, str(tmp_path / "whole"))
    got, want = content(spark, root), content(spark, str(tmp_path / "whole"))
    # the vectors' calibration is that of the first build
    assert {k: v for k, v in got.items() if k != "vectors"} == {k: v for k, v in want.items() if k != "vectors"}
    q = ParsedQuery("q", semantic="lease")
    found = [{(r.chat_id, tuple(m.msg_id for m in r.hit_messages)) for r in Engine(spark, IndexStore(spark, x), spark.createDataFrame(list(rows.values()), SCHEMA), now=1_700_600_000.0).search(q).collect()} for x in (root, str(tmp_path / "whole"))]
    assert found[0] == found[1] and found[0]


def test_edits_deletes_and_merges(spark, tmp_path):
    """Edits, deletions, a chat that goes and comes back; after each build the tables are those of a rebuild, and old segments are merged."""
    root, rows, r = str(tmp_path / "i"), talk(2, 4, 8), random.Random(3)
    build(spark, rows, root)
    seen = []
    for step in range(6):
        for _ in range(2):
            i = r.choice(list(rows))
            rows[i] = (*rows[i][:5], " ".join(r.choices(WORDS, k=4)), False)
        if step == 1:
            gone = {i: rows.pop(i) for i in list(rows) if rows[i][1] == 3}
        if step == 3:
            rows |= gone
        if step == 4:
            rows.pop(min(rows))
        rows[5000 + step] = message(5000 + step, step % 3, 500_000 + step * 9000, "more of the river")
        seen.append(build(spark, rows, root).segments)
    assert max(map(len, seen)) <= 5 and len({s["name"] for x in seen for s in x}) > 4
    build(spark, rows, str(tmp_path / "whole"))
    got, want = content(spark, root), content(spark, str(tmp_path / "whole"))
    assert {k: v for k, v in got.items() if k != "vectors"} == {k: v for k, v in want.items() if k != "vectors"}
    store = IndexStore(spark, root)
    assert store.vacuum(1) and store.vacuum(1) == [] and len(store.pointers()) == 1
    assert content(spark, root) == got
    assert build(spark, {}, root).read("chunks").count() == 0


@pytest.mark.parametrize(
    ("sizes", "start"),
    [([(9, 0)], None), ([(100, 0), (1, 1)], None), ([(100, 0), (1, 0), (1, 0), (1, 0)], None), ([(100, 0), (1, 0), (1, 0), (1, 0), (1, 0)], 1), ([(100, 0), (60, 0), (30, 0), (20, 0)], 0), ([(10, 0), (8, 10)], 0)],
)
def test_what_is_merged(sizes, start):
    assert S.merge_from([{"name": "", "rows": a, "dead": b} for a, b in sizes]) == start


def test_only_some_windows_and_other_cuts(spark, tmp_path):
    root, rows = str(tmp_path / "i"), talk(4, 3, 6)
    assert build(spark, rows, root, limit_chunks=2).read("chunks").count() == 2
    build(spark, rows, root)
    build(spark, rows, root, gap=100.0)
    build(spark, rows, str(tmp_path / "whole"), gap=100.0)
    assert content(spark, root)["chunks"] == content(spark, str(tmp_path / "whole"))["chunks"]


def test_file_names_count(spark, tmp_path):
    root, rows = str(tmp_path / "i"), talk(5, 2, 4)
    files = lambda name: spark.createDataFrame([(1001, [name])], "msg_id long, files array<string>")
    build(spark, rows, root, files=files("holiday.jpg"))
    at = build(spark, rows, root, files=files("receipt.pdf"))
    assert len(at.segments) == 2 and at.read("terms").filter(F.col("term").isin("holiday", "holidai")).count() == 0
