"""Stages that are taken up again, and what a harvest leaves out."""

import uuid

import pytest
from pyspark.sql import functions as F

from convolens.operators import evalkit, harvest

VALUES = "double_id long"


@pytest.fixture
def stages(spark, tmp_path):
    return harvest.Stages(spark, f"file://{tmp_path}")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id long, stamp long")


def computing(seen, fail_at=None):
    def compute(some):
        ids = sorted(r["chunk_id"] for r in some.collect())
        if fail_at is not None and len(seen) == fail_at:
            raise RuntimeError("lost")
        seen.append(ids)
        return some.filter("chunk_id != 7").select("chunk_id", (F.col("chunk_id") * 2).alias("double_id"))

    return compute


def test_only_keys_without_a_result_are_computed(spark, stages):
    """A new key and a changed stamp are computed; a key without a result is noted and not asked again."""
    seen = []
    stages.fill("s", asked(spark, (1, 10), (2, 20), (7, 70)), VALUES, computing(seen))
    out = stages.fill("s", asked(spark, (1, 10), (2, 21), (3, 30), (7, 70)), VALUES, computing(seen))
    assert seen == [[1, 2, 7], [2, 3]]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(1, 2), (2, 4), (3, 6), (7, None)]
    assert stages.fill("s", asked(spark), VALUES, computing(seen)).count() == 0 and len(seen) == 2


def test_a_run_that_ended_goes_on(spark, stages):
    """Blocks that were written stay; a folder without its end mark is not read."""
    keys = asked(spark, *[(i, i) for i in range(20, 60)])
    seen = []
    with pytest.raises(RuntimeError):
        stages.fill("s", keys, VALUES, computing(seen, fail_at=2), block=10)
    stages.files.path("s/b=torn/part-0", lambda fs, p: fs.create(p, False).close())
    done = {i for ids in seen for i in ids}
    again = []
    out = stages.fill("s", keys, VALUES, computing(again), block=10)
    assert {i for ids in again for i in ids} == set(range(20, 60)) - done and done
    assert sorted(map(tuple, out.collect())) == [(i, 2 * i) for i in range(20, 60)]


def test_blocks_are_put_together(spark, stages, monkeypatch):
    """Many blocks become one, without rows of stamps that nobody asks for."""
    monkeypatch.setattr(harvest, "BLOCKS", 3)
    for stamp in range(5):
        out = stages.fill("s", asked(spark, (1, stamp), (2, 0)), VALUES, computing([]))
    assert len(stages.blocks("s")) <= 3
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 4)]


def windows(spark):
    long = "Then we met Paula and Marco near Lisbon " + "and talked of the old house by the river " * 5
    rows = [(1, 1, 0.0, False, [1, 2], long + "one"), (2, 1, 100.0, False, [2, 3], long + "one"), (3, 1, 9e5, None, [4], long + "two things [link:x.org]"),
            (4, 2, 0.0, True, [5], long + "three"), (5, 2, 50.0, False, [6], None), (6, 3, 7.0, False, [7], "short")]
    w = spark.createDataFrame(rows, "chunk_id long, chat_id long, start_ts double, has_attachment boolean, msg_ids array<long>, body string")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0])], "chunk_id long, embedding array<float>")
    return w, v, spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a")], "chat_id long, handle string")


def test_harvest(spark, tmp_path):
    """A window that shares a message is no neighbour though its vector is equal; null and short texts have signals and no score; the second run computes nothing."""
    w, v, roster = windows(spark)
    placed = spark.createDataFrame([(6, "Lisbon")], "msg_id long, place string")
    out = harvest.harvest(w, v, roster, f"file://{tmp_path}", placed=placed)
    got = {r["chunk_id"]: r for r in out.collect()}
    assert len(got) == 6
    assert [got[i]["nn_chunk_id"] for i in range(1, 7)] == [3, 3, 1, 3, None, None]
    assert [got[i]["is_group"] for i in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    assert got[5]["has_geo"] == 1 and got[5]["token_count"] == 0 and got[5]["score"] is None and got[6]["score"] is None
    assert got[1]["entity_count"] == 3 and got[3]["has_url"] == 1 and got[3]["category"] == "exact_string" and got[4]["category"] == "media_geo"
    stages = harvest.Stages(spark, f"file://{tmp_path}")
    before = {s: stages.blocks(s) for s in ("text", "rarity", "nearest")}
    again = harvest.harvest(w, v, roster, f"file://{tmp_path}", placed=placed)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.values()))
    assert {s: stages.blocks(s) for s in before} == before
    assert harvest.harvest(w.limit(0), v, roster, f"file://{tmp_path}/none").count() == 0


def test_prefilter_falls_back_on_idf(spark):
    """Few windows all stay; with too few good ones idf alone decides; the middle of an even number is between two."""
    df = spark.createDataFrame([(i, 100, float(i), 2 if i in (8, 9) else 0) for i in range(10)], "chunk_id long, token_count int, idf_mean double, entity_count int")
    ids = lambda n: sorted(r[0] for r in evalkit.prefilter(df, n).collect())
    assert ids(10) == list(range(10)) and ids(3) == [7, 8, 9] and ids(2) == [8, 9] and ids(1) == [9]
    assert evalkit.middle(df, "idf_mean") == 4.5 and evalkit.middle(df.filter("chunk_id < 3"), "idf_mean") == 1.0 and evalkit.middle(df.limit(0), "idf_mean") is None


def test_windows_and_vectors_are_made_once(spark, tmp_path):
    """Many steps read the windows and the vectors; each row is made once."""
    seen = tmp_path / "seen"
    seen.mkdir()

    @F.udf("string")
    def noted(i):
        (seen / f"{i}-{uuid.uuid4().hex}").touch()
        return f"In Paris with Anna Number {i} " + "word " * 50

    @F.udf("array<float>")
    def vector(i):
        (seen / f"v{i}-{uuid.uuid4().hex}").touch()
        return [1.0, float(i)]

    ids = spark.range(6).select(F.col("id").alias("chunk_id"))
    body = noted.asNondeterministic()("chunk_id")
    windows = ids.select("chunk_id", F.lit(1).cast("long").alias("chat_id"), (F.col("chunk_id") * 9000.0).alias("start_ts"), F.lit(False).alias("has_attachment"), F.array("chunk_id").alias("msg_ids"), body.alias("body"))
    roster = spark.createDataFrame([(1, "a")], "chat_id long, handle string")
    out = harvest.harvest(windows, ids.select("chunk_id", vector.asNondeterministic()("chunk_id").alias("embedding")), roster, f"file://{tmp_path}/root")
    assert out.filter("nn_distance is not null").count() == 6
    assert sorted(p.name.split("-")[0] for p in seen.iterdir()) == sorted([str(i) for i in range(6)] + [f"v{i}" for i in range(6)])
