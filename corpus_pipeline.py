"""A corpus pipeline: five stages, each on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.llm import toxicity
from convolens.llm.decontam import drop_contaminated
from convolens.llm.jaccard import drop_near_duplicates
from convolens.llm.mixing import mix
from convolens.llm.sharding import shard_rows
from convolens.llm.shared import aside, keep, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the nearest labelled examples call toxic go. Null and empty texts, null and repeated ids and rows, and columns of any name are kept; empty in, empty out."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: that of the least id, then text, then other columns. Rows without words all stay; empty in, empty out."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with ten words or more of a benchmark item in a row, or all of a shorter item, go; rows with one id and one text together. Null and empty texts stay; empty in, empty out."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(docs: DataFrame):
    """(rows with position, the place of a row in the mix; what gives back the columns of ``docs``). It follows from the rows alone, so each stage that asks gets the same."""
    packed, back = aside(docs, "doc_id", "source", "n_chars", "text")
    out = mix(packed.withColumn("__tie", F.xxhash64("text")), ties=["n_chars", "__tie"])
    return out.select(*packed.columns, "position"), back


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, written in the order in which Pfair scheduling interleaves their sources; a null source is a source. Empty in, empty out."""
    rows, back = mixed(docs)
    return back(rows.repartitionByRange("position").sortWithinPartitions("position"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and grown_shard, by jump consistent hashing of doc_id, and slot: a shard's rows in the order of the mix. Columns of these names are replaced; null ids are one key."""
    rows, back = mixed(docs.drop("shard", "grown_shard", "slot"))
    return back(shard_rows(rows, order="position"), "shard", "grown_shard", "slot")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the learned first stage; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in their order over the whole documents table; each is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
