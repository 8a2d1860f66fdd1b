"""Short lists from large tables: no task gets the whole table, and nothing is scored that can't be in the list."""

from pyspark.sql import functions as F

from convolens.operators import hydrate, ranking


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_head_without_a_window_over_all(spark):
    rows = spark.range(500).select(F.col("id").alias("chunk_id"), (F.col("id") * 7 % 31).cast("double").alias("logit"), (F.col("id") * 13 % 97).cast("double").alias("start_ts"))
    out = ranking.head(rows, "chunk_id", 12, 3)
    plain = sorted(rows.collect(), key=lambda r: (-r.logit, r.chunk_id))
    newest = sorted(plain[9:], key=lambda r: (-r.start_ts, r.chunk_id))[:3]
    assert {r.chunk_id for r in out.collect()} == {r.chunk_id for r in plain[:9] + newest} and out.count() == 12
    assert "Window" not in plan_of(out)
    for few in (0, 4, 10):
        assert ranking.head(rows.limit(few), "chunk_id", 12, 3).count() == few


def test_similar_names_are_scored_only_if_needed(spark):
    names = [(f"c{i}", f"Kaya {i:02}") for i in range(9)] + [("d", "Kayla"), ("e", "Zed"), ("f", None)]
    contacts = spark.createDataFrame(names, "identifier string, display_name string")
    enough, more = hydrate.suggest_contacts(contacts, "kaya"), hydrate.suggest_contacts(contacts, "kaya", 12)
    assert [r.identifier for r in enough.collect()] == [f"c{i}" for i in range(8)] and "weighted_ratio" not in plan_of(enough)
    assert [r.identifier for r in more.collect()] == [f"c{i}" for i in range(9)] + ["d"]
