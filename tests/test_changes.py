"""Changes of the source: feeds, versions, replay and deletes."""

import pytest

from convolens.plans.parse import ParsedQuery
from convolens.plans.search import Engine, build_index
from convolens.sources.snapshots import SourceSnapshots, changes
from convolens.sources.store import IndexStore
from convolens.streaming.sync import follow

SCHEMA = "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean"


def message(i, chat, text, at=0.0):
    return (i, chat, 1_700_000_000.0 + i * 3000 + at, False, "sam", text, False)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


@pytest.fixture
def held(spark, tmp_path):
    return SourceSnapshots(spark, str(tmp_path / "source"), SCHEMA)


def test_feed_says_what_differs(spark):
    a = spark.createDataFrame([message(1, 1, "stays"), message(2, 1, "goes"), message(3, 2, None), message(4, 2, None)], SCHEMA)
    b = spark.createDataFrame([message(1, 1, "stays"), message(3, 2, None), message(4, 2, "comes"), message(5, 3, "new")], SCHEMA)
    got = {(r.chat_id, r.msg_id): (r.change, r.text) for r in changes(a, b).collect()}
    assert got == {(1, 2): ("delete", None), (2, 4): ("update", "comes"), (3, 5): ("insert", "new")}
    assert changes(a, a).count() == 0 and changes(a.limit(0), a).count() == 4


def test_versions_batches_and_vacuum(spark, held):
    steps = [[message(i, i % 4, f"text {i}") for i in range(12)]]
    steps.append([r for r in steps[0] if r[1] != 3 and r[0] != 5] + [message(50, 1, "later")])
    steps.append([(*r[:5], "edited", False) if r[0] == 0 else r for r in steps[1]])
    for n, rows in enumerate(steps):
        feed = changes(held.read(), spark.createDataFrame(rows, SCHEMA))
        assert held.apply(feed, "s", n) and rows_of(held.read()) == sorted(rows, key=lambda r: r[:2])
    number = held.manifest()["number"]
    again = changes(spark.createDataFrame([], SCHEMA), spark.createDataFrame(steps[0], SCHEMA))
    assert not held.apply(again, "s", 2) and not held.apply(again, "s", 0) and held.manifest()["number"] == number == 3
    assert [rows_of(held.read(v + 1)) for v in range(3)] == [sorted(r, key=lambda x: x[:2]) for r in steps]
    one, two = held.manifest(2)["buckets"], held.manifest(3)["buckets"]
    assert sum(one[b] != two[b] for b in two) == 1 and held.manifest()["horizon"] == max(r[2] for r in steps[2])
    assert held.vacuum(1) and held.vacuum(1) == [] and rows_of(held.read()) == sorted(steps[2], key=lambda r: r[:2])
    with pytest.raises(FileNotFoundError):
        held.read(1)


def test_last_change_of_a_key_counts(spark, held):
    feed = spark.createDataFrame([(n, c, *message(1, 1, t)) for n, c, t in ((1, "insert", "a"), (3, "update", "c"), (2, "delete", None))], f"seq int, change string, {SCHEMA}")
    assert held.apply(feed, "s", 0) and [r.text for r in held.read().collect()] == ["c"]
    assert held.apply(feed.filter("change = 'delete'"), "s", 1) and held.read().count() == 0
    assert held.apply(feed.limit(0), "s", 2) and held.manifest()["applied"] == {"s": 2}


def test_stream_of_changes_keeps_the_index(spark, held, tmp_path):
    """A chat that shrinks loses windows; a stream that starts over changes nothing; an index that is behind is built."""
    root, feed = str(tmp_path / "index"), str(tmp_path / "feed")
    first = [message(i, c, f"words {i} of {c}", at=c * 0.5) for c in (1, 2) for i in range(c * 10, c * 10 + 4)]
    second = [r for r in first if r[0] not in (12, 13)] + [message(90, 2, "river at night")]
    df = [spark.createDataFrame(x, SCHEMA) for x in (first, second)]
    for i, c in enumerate((changes(df[0].limit(0), df[0]), changes(df[0], df[1]))):
        c.coalesce(1).write.parquet(f"{feed}/n={i}")
    stream = spark.readStream.schema(f"change string, {SCHEMA}").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(feed)
    built = lambda: int(IndexStore(spark, root).snapshot().meta["source_version"]) if IndexStore(spark, root).exists() else None
    build = lambda m, n: build_index(spark, m, root, source_version=n)
    for checkpoint in ("a", "b"):
        follow(stream, held, build, built, "feed", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        at = IndexStore(spark, root).snapshot()
        assert held.manifest()["number"] == 2 == built() and at.number == 2
        assert {r.msg_id for r in at.read("chunk_message").select("msg_id").distinct().collect()} == {r[0] for r in second}
    held.apply(changes(held.read(), df[0]), "other", 0)
    engine = Engine.of_versions(spark, IndexStore(spark, root), held, now=1_700_400_000.0)
    found = {m.text for r in engine.search(ParsedQuery("q", semantic="river night")).collect() for m in r.hit_messages}
    assert "river at night" in found and held.read().filter("text like 'river%'").count() == 0
    follow(stream, held, build, built, "feed", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert built() == 3 and {r.msg_id for r in IndexStore(spark, root).read("chunk_message").collect()} == {r[0] for r in first}
