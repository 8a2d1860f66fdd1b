from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.operators import evalkit, filters, hydrate, lexical, ranking, sessionize, vectors
from convolens.plans.parse import Contacts, ParsedQuery, merge_parse, parse_query, with_filters
from convolens.plans.search import Engine, build_index
from convolens.schemas import SchemaDriftError, require_columns
from convolens.sources.store import IndexStore, insert_new, upsert

NOW = datetime(2024, 6, 12, 15, tzinfo=UTC)
PEOPLE = Contacts([("Kaya Moreno", ["+15550001"]), ("Sam Lee", ["sam@x.org"]), ("Mike Fox", ["+15550003"])])


@pytest.mark.parametrize(
    "text,expected",
    [
        ("what did Kaya say about dinner last week", {"senders": ("+15550001",), "semantic": "what did say about dinner"}),
        ("latest from kaya", {"senders": ("+15550001",), "semantic": ""}),
        ("messages from Kaay", {"senders": ("+15550001",), "semantic": ""}),
        ("kaya's photos", {"senders": ("+15550001",), "has_media": True}),
        ("may i borrow the car", {"date_from": None, "semantic": "may i borrow the car"}),
        ("what did I say about the lease", {"from_me": True}),
        ("messages i sent to Kaya", {"participants": ("+15550001",)}),
        ("what did Zed say when I asked", {"from_me": None}),
        ("from yesterday", {"participants": (), "date_from": datetime(2024, 6, 11, tzinfo=UTC).timestamp()}),
        ("what happened in August", {"date_from": datetime(2023, 8, 1, tzinfo=UTC).timestamp(), "date_to": datetime(2023, 9, 1, tzinfo=UTC).timestamp()}),
        ("with mine", {"participants": ()}),
        ("", {"semantic": ""}),
    ],
)
def test_parser(text, expected):
    p = parse_query(text, NOW, PEOPLE, {"mine", "same"})
    assert {k: getattr(p, k) for k in expected} == expected


def test_filters_and_merges():
    p = with_filters(parse_query("dinner", NOW, PEOPLE), PEOPLE, senders=["Sam Lee"], has_media=True)
    assert p.senders == p.participants == ("sam@x.org",) and p.has_media
    with pytest.raises(TypeError):
        with_filters(p, PEOPLE, nonsense=1)
    q, more = merge_parse(parse_query("dinner plans", NOW), {"senders": ["Kaya"], "date_from": 10, "date_to": 20, "expansions": ["supper plans", "unrelated"]}, PEOPLE, (0, 100))
    assert q.senders == ("+15550001",) and (q.date_from, q.date_to) == (10, 20) and more == ["supper plans"]


def test_newest_first_is_global(spark):
    df = spark.createDataFrame([(1, 500.0), (2, 100.0), (3, 101.0), (4, 102.0), (5, 400.0), (6, 103.0), (7, 300.0)], "id long, start_ts double")
    assert [r.id for r in ranking.newest_first(df, "id").collect()] == [1, 5, 7, 6, 4, 3, 2]


def test_two_weak_hits_beat_a_weaker_one(spark):
    now = 1_700_000_000.0
    df = spark.createDataFrame([(1, 1, now, -5.0, False), (2, 1, now, -6.0, False), (3, 2, now, -9.0, False)], "chunk_id long, chat_id long, start_ts double, logit double, lexical boolean")
    rows = ranking.sessions(df, now).collect()
    assert [r.chat_id for r in rows] == [1, 2] and rows[0].chunk_ids == [1, 2]
    assert rows[1].score == pytest.approx(1 / (1 + 2.718281828459045**9) * 1.6)


def test_roster_and_authors(spark):
    roster = spark.createDataFrame([(1, "k"), (3, "z")], "chat_id long, handle string")
    messages = spark.createDataFrame([(2, False, "k"), (4, True, "k")], "chat_id long, is_from_me boolean, handle string")
    assert {r.chat_id for r in filters.participant_chats(roster, messages, ["k"]).collect()} == {1, 2}


def test_empty_filter_closes(spark):
    chunks = spark.createDataFrame([(1, 1, 0.0, 1.0, True)], "chunk_id long, chat_id long, start_ts double, end_ts double, has_attachment boolean")
    none = spark.createDataFrame([], "chat_id long")
    assert filters.candidate_chunks(chunks) is None and filters.chat_filter(None, None) is None
    assert filters.candidate_chunks(chunks, chats=filters.chat_filter(none)).count() == 0
    assert filters.candidate_chunks(chunks, has_media=True).count() == 1


def test_quantise_and_rank(spark):
    v = spark.createDataFrame([(1, [1.0, 0.5, -2.0]), (2, [0.0, 0.0, 0.0])], "id long, v array<double>")
    assert v.select(vectors.quantize_int8(F.col("v"), F.lit(1.0)).alias("q")).collect()[0].q == [127, 64, -127]
    assert v.select(vectors.norm(vectors.l2_normalize(F.col("v"))).alias("n")).collect()[0].n == pytest.approx(1)
    assert [r.n for r in v.filter("id = 2").select(vectors.norm(vectors.l2_normalize(F.col("v"))).alias("n")).collect()] == [0]


def test_bm25_needs_all_words_and_phrases_order(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "fox red"), (3, "red red dog"), (4, "the red fox and the red fox")], "id long, t string")
    index, stats = lexical.postings(docs, "id", "t"), lexical.doc_stats(docs, "id", "t")
    assert {r.id for r in lexical.bm25(index, stats, ["red", "fox"], "id").collect()} == {1, 2, 4}
    assert {r.id: r.tf for r in lexical.phrase_places(index, ["red", "fox"], "id").collect()} == {1: 1, 4: 2}
    assert lexical.bm25(index, stats, [], "id").count() == 0 and lexical.phrase_search(index, stats, ["red"], "id").count() == 0


def test_intervals(spark):
    r = spark.range(1).select(*[c.alias(n) for n, c in zip(("lo", "hi"), evalkit.wilson(F.lit(20), F.lit(32)), strict=True)], evalkit.mcnemar(F.lit(8), F.lit(2)).alias("m"), evalkit.mcnemar(F.lit(0), F.lit(0)).alias("none")).first()
    assert (round(r.lo, 2), round(r.hi, 2), r.m, r.none) == (0.45, 0.77, 3.6, None)


def test_conversation_frame(spark):
    m = spark.createDataFrame([(i, 1, float(i * 10)) for i in range(20)], "msg_id long, chat_id long, ts double")
    assert [r.msg_id for r in hydrate.conversation(m, 1, 52.0, 4).collect()] == [3, 4, 5, 6]
    assert [r.msg_id for r in hydrate.conversation(m, 1, 0.0, 4).collect()] == [0, 1, 2, 3]
    assert [r.msg_id for r in hydrate.conversation(m, 1, limit=3).collect()] == [17, 18, 19]


def test_schema_is_checked(spark):
    with pytest.raises(SchemaDriftError, match="message.text"):
        require_columns({"message": spark.range(1).withColumnRenamed("id", "rowid")})


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, x string, y int")
    new = spark.createDataFrame([(2, "c", None), (3, "d", 3)], "id long, x string, y int")
    assert sorted(map(tuple, upsert(old, new, "id").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
    assert sorted(map(tuple, insert_new(old, new, "id").collect())) == [(1, "a", 1), (2, "b", 2), (3, "d", 3)]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = []
    for chat in range(6):
        for i in range(4):
            text = "the verbatim needle sentence" if (chat, i) == (3, 1) else f"plain words {chat} number {i}"
            rows.append((chat * 100 + i, chat, 1_700_000_000.0 + chat * 86_400 + i * 60, i % 2 == 0, None if i % 2 == 0 else f"h{chat}", text, i == 3))
    m = spark.createDataFrame(rows, "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean").cache()
    root = str(tmp_path_factory.mktemp("index"))
    build_index(spark, m, root)
    return Engine(spark, IndexStore(spark, root), m, now=1_700_600_000.0), root, rows


def test_search_finds_the_needle(engine):
    e, _, _ = engine
    top = e.search(ParsedQuery("q", "verbatim needle sentence")).first()
    assert top.chat_id == 3 and any("needle" in x.text for x in top.hit_messages)
    bad = [k for k, c in evalkit.payload_checks().items() if e.search(ParsedQuery("q", "plain words")).filter(~c).count()]
    assert bad == []


def test_browse_and_filters(engine):
    e, _, _ = engine
    assert [r.chat_id for r in e.browse(ParsedQuery("q")).collect()] == [5, 4, 3, 2, 1, 0]
    only = e.browse(ParsedQuery("q", senders=("h2",), participants=("h2",))).collect()
    assert [r.chat_id for r in only] == [2] and all(x.handle == "h2" for x in only[0].hit_messages)


def test_pages_follow_each_other(engine):
    e, _, _ = engine
    q = ParsedQuery("q", "plain words")
    whole = [(r.chat_id, r.place) for r in e.search(q, max_sessions=6).collect()]
    assert [(r.chat_id, r.place) for r in e.search(q, max_sessions=3).collect()] + [(r.chat_id, r.place) for r in e.search(q, offset=3, max_sessions=3).collect()] == whole


def test_rebuild_keeps_and_changes(spark, engine, tmp_path):
    _, _, rows = engine
    schema = "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean"
    root, m = str(tmp_path / "i"), spark.createDataFrame(rows, schema)
    build_index(spark, m, root)
    store = IndexStore(spark, root)
    ids = lambda: {(r.chat_id, r.position): (r.chunk_id, tuple(r.msg_ids)) for r in store.read("chunks").collect()}
    before = ids()
    build_index(spark, m, root)
    assert ids() == before
    late = [*[r for r in rows if r[1] != 5], (999, 0, 1_699_000_000.0, False, "h0", "from long ago", False)]
    build_index(spark, spark.createDataFrame(late, schema), root)
    after = ids()
    assert (5, 0) not in after and after[0, 0] == (before[0, 0][0], (999,)) and after[0, 1][1] == before[0, 0][1]
    with pytest.raises(FileNotFoundError):
        IndexStore(spark, str(tmp_path / "none")).read("chunks")


def test_python_gets_little_at_once(spark):
    """A model gets few texts at once; of a message its number of tokens alone goes to Python, and stems are asked word by word."""

    def make():
        def model(texts):
            assert len(texts) <= 512
            return np.ones((len(texts), 2), np.float32) * [[len(t)] for t in texts]

        return model

    df = spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("a"), F.col("id").cast("int") % 7).alias("text"))
    assert {(r.id % 7, r.embedding[1]) for r in vectors.embed(df, "text", make=make).collect()} == {(i, float(i)) for i in range(7)}
    m = df.select(F.col("id").alias("msg_id"), F.lit(1).alias("chat_id"), F.col("id").cast("double").alias("ts"), "text", F.lit(False).alias("has_attachment"))
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan(sessionize.chunk_messages(m))
    assert "[stem_udf(term" in plan(lexical.postings(df, "id", "text", stem=True))
