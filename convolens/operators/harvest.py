"""Windows that are worth a question: signals in stages that can be taken up again, then a score and a category.

A stage's results are kept by (chunk_id, stamp); the stamp is a hash of all that a result follows
from. A run computes only keys that have no result under their present stamp, in blocks that are
each written whole, so a run that was ended loses one block, and a changed text costs its own windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.operators import batch, evalkit, filters, lexical
from convolens.sources.scratch import keep
from convolens.sources.store import IndexStore

#: Keys of a block, and blocks of a stage from which they are put together.
BLOCK, BLOCKS = 1_000_000, 64
KEY = ["chunk_id", "stamp"]
TEXT = "entity_count int, has_url int, has_number int, has_long_token int, token_count int"
RARITY, NEAREST = "idf_mean double", "nn_distance double, nn_chunk_id long"


class Stages:
    """Results of stages under ``root``, which all executors share. One run at a time; what two runs both wrote is equal and read once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), IndexStore(spark, root)

    def blocks(self, stage: str) -> list[str]:
        """Folders of blocks that were written to their end."""
        return [b for b in self.files.names(stage) if "_SUCCESS" in self.files.names(f"{stage}/{b}")]

    def read(self, stage: str, columns: str) -> DataFrame:
        empty = self.spark.createDataFrame([], f"chunk_id long, stamp long, {columns}")
        folders = [f"{self.root}/{stage}/{b}" for b in self.blocks(stage)]
        return self.spark.read.schema(empty.schema).parquet(*folders).dropDuplicates(KEY) if folders else empty

    def write(self, stage: str, rows: DataFrame) -> str:
        name = f"b={uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{stage}/{name}")
        return name

    def fill(self, stage: str, asked: DataFrame, columns: str, compute: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
        """(chunk_id, columns) of all keys of ``asked`` (chunk_id, stamp; ids distinct and not null).

        ``compute`` gets keys that have no result and gives (chunk_id, columns); a key without a row is
        noted with nulls and not computed again under its stamp.
        """
        asked = keep(asked.select(F.col("chunk_id").cast("long").alias("chunk_id"), "stamp"), f"{stage}-asked")
        missing = keep(asked.join(self.read(stage, columns).select(*KEY), KEY, "left_anti"), f"{stage}-missing")
        n = -(-missing.count() // block)
        names = [c.split()[0] for c in columns.split(", ")]
        for i in range(n):
            some = missing.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(n)) == i)
            self.write(stage, some.join(compute(some), "chunk_id", "left").select(*KEY, *names))
        if len(old := self.blocks(stage)) > BLOCKS:
            self.write(stage, self.read(stage, columns).join(asked, KEY, "left_semi"))
            for b in old:
                self.files.path(f"{stage}/{b}", lambda fs, p: fs.delete(p, True))
        return asked.join(self.read(stage, columns), KEY, "left").select("chunk_id", *names)


def chat_signals(windows: DataFrame, roster: DataFrame, chats: DataFrame | None = None, placed: DataFrame | None = None) -> DataFrame:
    """(chunk_id, has_attachment, msg_count, has_geo, isolation, n_24h, participant_count, is_group): what a window has by its chat and its messages.

    ``roster``: (chat_id, handle); ``chats``: (chat_id, style); ``placed``: msg_id of messages whose images have a place.
    """
    narrow = windows.select("chunk_id", "chat_id", "start_ts", F.coalesce("has_attachment", F.lit(False)).cast("int").alias("has_attachment"), F.size("msg_ids").alias("msg_count"))
    near = evalkit.within_a_day(evalkit.temporal_isolation(narrow))
    people = roster.groupBy("chat_id").agg(F.count_distinct("handle").alias("participant_count"))
    out = near.join(people, "chat_id", "left").withColumn("participant_count", F.coalesce("participant_count", F.lit(0)))
    style = chats.select("chat_id", "style").filter("style is not null").distinct() if chats is not None else None
    out = out.join(style, "chat_id", "left") if style is not None else out.withColumn("style", F.lit(None).cast("int"))
    group = F.coalesce(F.col("style") != filters.ONE_TO_ONE, F.col("participant_count") > 1).cast("int")
    out = out.withColumn("is_group", group)
    if placed is None:
        out = out.withColumn("has_geo", F.lit(0))
    else:
        held = windows.select("chunk_id", F.explode("msg_ids").alias("msg_id")).join(placed.select("msg_id").distinct(), "msg_id", "left_semi").select("chunk_id").distinct()
        out = out.join(held.withColumn("has_geo", F.lit(1)), "chunk_id", "left").withColumn("has_geo", F.coalesce("has_geo", F.lit(0)))
    return out.select("chunk_id", "has_attachment", "msg_count", "has_geo", "isolation", "n_24h", "participant_count", "is_group")


def overlapping(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk_id, other): windows that share a message with one of ``keys``; a message is in as many windows as overlap there."""
    member = windows.select("chunk_id", F.explode("msg_ids").alias("msg_id"))
    own = member.join(keys.select("chunk_id"), "chunk_id", "left_semi")
    return own.join(member.withColumnRenamed("chunk_id", "other"), "msg_id").filter("chunk_id != other").select("chunk_id", "other").distinct()


def nearest_apart(windows: DataFrame, vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """(chunk_id, nn_distance, nn_chunk_id): for each of ``keys``, a bounded list, the nearest window that shares no message, exactly; ties by id."""
    shared = keep(overlapping(windows, keys), "shared")
    most = shared.groupBy("chunk_id").count().agg(F.max("count")).first()[0] or 0
    asked = vectors.join(keys.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("q"))
    found = batch.knn_many(vectors.select("chunk_id", "embedding"), asked, "chunk_id", "embedding", most + 2)
    left = found.filter("qid != chunk_id").join(shared.select(F.col("chunk_id").alias("qid"), F.col("other").alias("chunk_id")), ["qid", "chunk_id"], "left_anti")
    best = left.groupBy("qid").agg(F.min(F.struct(F.round("distance", 9).alias("d"), "chunk_id")).alias("b"))
    return best.select(F.col("qid").alias("chunk_id"), F.col("b.d").alias("nn_distance"), F.col("b.chunk_id").alias("nn_chunk_id"))


def harvest(windows: DataFrame, vectors: DataFrame, roster: DataFrame, root: str, chats: DataFrame | None = None, placed: DataFrame | None = None, target: int = 5000, block: int = BLOCK) -> DataFrame:
    """All windows with their signals; those that are worth it also with nn_distance, nn_chunk_id, nn_band, category and score.

    ``windows``: chunk_id (distinct, not null), chat_id, start_ts, has_attachment, msg_ids, body (null: empty).
    ``vectors``: chunk_id, embedding. Stages are kept under ``root``; windows and vectors are written once, as
    many steps read them. A window without a vector, or with nothing left to compare with, has no distance,
    category and score; empty in, empty out.
    """
    spark = windows.sparkSession
    stages = Stages(spark, root)
    rows = keep(windows.withColumn("body", F.coalesce("body", F.lit(""))), "windows")
    vectors = keep(vectors.select("chunk_id", "embedding"), "vectors")
    stamped = keep(rows.select("chunk_id", F.xxhash64("body").alias("stamp")), "stamped")
    only = lambda df, some: df.join(some.select("chunk_id"), "chunk_id", "left_semi")
    texts = rows.select("chunk_id", "body")

    signals = T.regex_signals(F.col("body"))
    text = stages.fill("text", stamped, TEXT, lambda some: only(texts, some).select("chunk_id", *[c.alias(k) for k, c in signals.items()]), block)

    corpus = stamped.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*KEY)).alias("h")).first()
    of_corpus = stamped.select("chunk_id", F.xxhash64("stamp", F.lit(corpus["n"]), F.lit(corpus["h"])).alias("stamp"))
    counts = cache(lambda: keep(lexical.document_counts(texts, "chunk_id", "body"), "counts"))
    rarity = stages.fill("rarity", of_corpus, RARITY, lambda some: lexical.top_idf(only(texts, some), counts(), F.lit(corpus["n"]), "chunk_id", "body"), block)

    table = keep(chat_signals(rows, roster, chats, placed).join(text, "chunk_id").join(rarity, "chunk_id"), "signals")
    worth = evalkit.prefilter(table, target)
    marks = vectors.select("chunk_id", F.xxhash64("embedding").alias("v"))
    members = rows.agg(F.bit_xor(F.xxhash64("chunk_id", "msg_ids"))).first()[0]
    space = marks.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("chunk_id", "v")).alias("h")).first()
    stamp = F.xxhash64("v", F.lit(space["n"]), F.lit(space["h"]), F.lit(members)).alias("stamp")
    nearest = stages.fill("nearest", worth.join(marks, "chunk_id").select("chunk_id", stamp), NEAREST, lambda some: nearest_apart(rows, vectors, some), block)

    known = keep(table.join(nearest.filter("nn_distance is not null"), "chunk_id"), "known")
    banded = evalkit.quartile_bands(known, "nn_distance", "nn_band", closed=True)
    shared = evalkit.rank_share(banded, "isolation", "isolation_share", evalkit.LONE)
    # a lone window is not far from others: it has none
    shared = shared.withColumn("isolation_share", F.when(F.col("isolation") < evalkit.LONE, F.col("isolation_share")))
    scored = evalkit.candidate_scores(keep(shared.withColumn("category", evalkit.category()), "banded"))
    return table.join(scored.select("chunk_id", "nn_distance", "nn_chunk_id", "nn_band", "category", "score"), "chunk_id", "left")


def sample(harvested: DataFrame, target: int = 300) -> DataFrame:
    """The best scored windows by bands of distance, up to each band's share of ``target``; ``evalkit.stratified``."""
    return evalkit.stratified(harvested.filter("nn_distance is not null"), target)
