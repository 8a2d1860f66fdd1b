"""Bitmaps that tell which hashes may be keys."""

from pyspark.sql import functions as F

from convolens.llm.linededup import dedup_passages
from convolens.llm.shared import keep, sieve


def test_all_keys_and_few_others(spark, monkeypatch):
    """All keys pass, negative and null ones as well as those of a full sieve; few others do; no keys, no rows."""
    rows = spark.range(0, 60000).select(F.xxhash64("id").alias("h"), (F.col("id") % 100 == 0).alias("key"))
    flag = sieve(keep(rows.filter("key").select("h"), "keys"))
    got = {(r.key, r.has): r.n for r in flag(rows, F.col("h"), "has").groupBy("key", "has").agg(F.count("*").alias("n")).collect()}
    assert got[True, True] == 600 and (True, False) not in got and got.get((False, True), 0) < 60000 / 30
    assert flag(rows.select(F.lit(None).cast("long").alias("h")), F.col("h"), "has").filter("has").count() == 0
    assert sieve(keep(rows.limit(0).select("h"), "none"))(rows, F.col("h"), "has").filter("has").count() == 0
    monkeypatch.setattr("convolens.llm.shared.SIEVE_BITS", 1 << 15)
    full = sieve(keep(rows.select("h"), "all"))
    assert full(rows, F.col("h"), "has").filter("has").count() == 60000


def test_texts_without_repeats_are_not_shuffled(spark):
    """Rows of which nothing goes come from a branch without an exchange."""
    rows = [(i, f"line {i} a\nline {i} b\nline {i} c") for i in range(40)] + [(100, "x\ny\nz"), (101, "0\nx\ny\n1"), (None, "x\ny")]
    out = dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.removed_lines) for r in out.collect()}
    assert got[None] == ("x\ny", 0) and got[100] == ("z", 2) and got[101] == ("0\n1", 2)
    assert all(got[i] == (t, 0) for i, t in rows[:40])
    branches = out._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1]
    assert "Join LeftOuter" in branches and "NOT" in branches.upper()
