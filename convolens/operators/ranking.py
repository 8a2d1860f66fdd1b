"""Fusion of arms, reranking, sessions and pages. Every order has a last key, so results repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DAY = 86_400
RRF_K, FUSED, RECENT_SLOTS = 60, 50, 10
HEAD, HEAD_RECENT, RADIUS, SESSIONS, SESSION_RECENT = 12, 3, 2, 8, 2
HALF_LIFE, BOOST = 365, 0.6
WORD_HALF_LIFE, WORD_BOOST = 30, 1.2
HITS_A_SESSION = 10


def arm(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, rank) of a bounded list of results, best first, rank from 1."""
    return df.select(key, F.row_number().over(W.orderBy(*order)).alias("rank"))


def rrf(arms: list[DataFrame], key: str, k: int = RRF_K, top: int = FUSED, weights: list[float] | None = None) -> DataFrame:
    """(key, score): sum of weight / (k + rank) over arms (key, rank); ties in the order of first appearance."""
    parts = [a.select(key, "rank", F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rrf_rows(rows, key, k, top, weights)


def rrf_rows(rows: DataFrame, key: str, k: int = RRF_K, top: int = FUSED, weights: list[float] | None = None) -> DataFrame:
    """The same of all arms in one table (arm, key, rank)."""
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.col("arm")] if weights else F.lit(1.0)
    fused = rows.groupBy(key).agg(F.sum(weight / (k + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    return fused.orderBy(F.desc(F.round("score", 12)), "seen", key).limit(top)


def newest_first(df: DataFrame, key: str, ts: str = "start_ts") -> DataFrame:
    return df.orderBy(F.desc(ts), key)


def reserve_recent(fused: DataFrame, matched: DataFrame, key: str, top: int = FUSED, slots: int = RECENT_SLOTS) -> DataFrame:
    """(key, place): the best ``top - slots`` of ``fused`` (key, rank), the newest of ``matched`` (key, ts) that they lack, then fused ones until ``top``."""
    best = fused.filter(F.col("rank") <= top - slots).select(key, F.lit(0).alias("part"), F.col("rank").cast("double").alias("o"))
    fresh = matched.join(best.select(key), key, "left_anti").orderBy(F.desc("ts"), key).limit(slots).select(key, F.lit(1).alias("part"), (-F.col("ts")).alias("o"))
    rest = fused.filter(F.col("rank") > top - slots).select(key, F.lit(2).alias("part"), F.col("rank").cast("double").alias("o"))
    first = best.unionByName(fresh).unionByName(rest).groupBy(key).agg(F.min(F.struct("part", "o")).alias("x"))
    return first.orderBy("x", key).limit(top).select(key, F.row_number().over(W.orderBy("x", key)).alias("place"))


def word_overlap(query: str, texts: list[str]) -> list[float]:
    """A stand-in for a pair-scoring model: a logit from shared words."""
    q = set(query.lower().split())
    return [-10.0 + len(q & set(t.lower().split())) for t in texts]


def rerank(query: str, chunks: DataFrame, text: str, score: Callable[[str, list[str]], list[float]] = word_overlap) -> DataFrame:
    """Add ``logit``; all rows, a bounded list, are scored in one pass."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(score(query, [t or "" for t in s]), dtype="float64")

    return chunks.withColumn("logit", F.pandas_udf(run, "double")(F.col(text)))


def head(scored: DataFrame, key: str, top: int = HEAD, recent: int = HEAD_RECENT) -> DataFrame:
    """The best ``top - recent`` by logit, and the newest ``recent`` of the others."""
    first = scored.orderBy(F.desc("logit"), key).limit(top - recent)
    # of the ``top`` newest, so many can't be among the best that too few are left
    known = F.broadcast(first.select(F.col(key).alias("__known")))
    others = scored.orderBy(F.desc("start_ts"), key).limit(top).join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
    return first.unionByName(others.orderBy(F.desc("start_ts"), key).limit(recent))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def recency(ts: Column, now: float) -> Column:
    return 1 + BOOST * F.pow(F.lit(0.5), F.greatest((F.lit(now) - ts) / DAY, F.lit(0.0)) / HALF_LIFE)


def word_freshness(ts: Column, now: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest((F.lit(now) - ts) / DAY, F.lit(0.0)) / WORD_HALF_LIFE)


def day_of(ts: Column) -> Column:
    """The day in the session's time zone."""
    return F.to_date(F.timestamp_seconds(ts))


def sessions(chunks: DataFrame, now: float) -> DataFrame:
    """(chat_id, day, score, latest, is_lexical, chunk_ids), best first.

    ``chunks``: chunk_id, chat_id, start_ts, logit, lexical. A chunk counts once; a
    verbatim hit adds by its age, and the whole is raised by the newest chunk's.
    """
    once = chunks.dropDuplicates(["chunk_id"])
    g = once.groupBy("chat_id", day_of(F.col("start_ts")).alias("day")).agg(
        F.sum(sigmoid(F.col("logit"))).alias("base"), F.max("start_ts").alias("latest"), F.max(F.when(F.col("lexical"), F.col("start_ts"))).alias("word_ts"), F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids")
    )
    bonus = F.when(F.col("word_ts").isNotNull(), WORD_BOOST * word_freshness(F.col("word_ts"), now)).otherwise(0.0)
    scored = g.withColumn("score", (F.col("base") + bonus) * recency(F.col("latest"), now)).withColumn("is_lexical", F.col("word_ts").isNotNull())
    return scored.select("chat_id", "day", "score", "latest", "is_lexical", "chunk_ids").orderBy(F.desc("score"), "chat_id", "day")


def reserve_sessions(scored: DataFrame, size: int = SESSIONS, slots: int = SESSION_RECENT) -> DataFrame:
    """Add ``place`` (from 1): a head of ``size`` with some of the newest sessions, verbatim ones first, ordered by score, and the others after it."""
    slots = min(slots, max(1, size // 3)) if slots else 0
    one = W.partitionBy(F.lit(0))
    ranked = scored.withColumn("r", F.row_number().over(one.orderBy(F.desc("score"), "chat_id", "day"))).withColumn("n", F.count("*").over(one))
    keep_n = F.least(F.lit(size - slots), F.col("n"))
    in_rest = F.col("r") > keep_n
    fresh = F.row_number().over(W.partitionBy(in_rest).orderBy(F.desc("is_lexical"), F.desc("latest"), "chat_id", "day"))
    part = F.when(~in_rest | (fresh <= slots), 0).otherwise(1)
    return ranked.withColumn("part", part).withColumn("place", F.row_number().over(one.orderBy("part", F.desc("score"), "chat_id", "day"))).drop("r", "n", "part")


def expand(hits: DataFrame, chunks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(chat_id, day, context_ids): the chunks up to ``radius`` places from a session's hits, without the hits. ``hits``: chat_id, day, chunk_id."""
    spread = hits.join(chunks.select("chunk_id", "position"), "chunk_id").select("chat_id", "day", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position")).distinct()
    around = spread.join(chunks.select("chat_id", "position", "chunk_id"), ["chat_id", "position"])
    context = around.join(hits.select("chat_id", "day", "chunk_id"), ["chat_id", "day", "chunk_id"], "left_anti")
    return context.groupBy("chat_id", "day").agg(F.array_sort(F.collect_set("chunk_id")).alias("context_ids"))


def page(placed: DataFrame, offset: int = 0, size: int = SESSIONS) -> DataFrame:
    """Rows of a page, with ``has_more`` and ``next_offset``; ``placed`` has ``place`` from 1."""
    more = F.max("place").over(W.partitionBy(F.lit(0))) > offset + size
    return placed.withColumn("has_more", more).filter(F.col("place").between(offset + 1, offset + size)).withColumn("next_offset", F.when(F.col("has_more"), offset + size))


def browse(chunks: DataFrame, candidates: DataFrame | None = None, top: int = FUSED) -> DataFrame:
    """(chat_id, day, latest, chunk_ids) of the newest chunks, newest session first."""
    some = chunks if candidates is None else chunks.join(candidates, "chunk_id", "left_semi")
    newest = some.select("chunk_id", "chat_id", "start_ts").orderBy(F.desc("start_ts"), F.desc("chunk_id")).limit(top)
    return newest.groupBy("chat_id", day_of(F.col("start_ts")).alias("day")).agg(F.max("start_ts").alias("latest"), F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids")).orderBy(F.desc("latest"), "chat_id")


def newest_hits(rows: DataFrame, sessions_n: int = SESSIONS, each: int = HITS_A_SESSION) -> DataFrame:
    """Only the newest ``sessions_n * each`` hits of all sessions stay hits."""
    order = W.partitionBy("is_hit").orderBy(F.desc("ts"), F.desc("msg_id"))
    return rows.withColumn("is_hit", F.col("is_hit") & (F.row_number().over(order) <= sessions_n * each))
