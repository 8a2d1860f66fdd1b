"""Filters before retrieval and on what it found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The style of a chat between two, and linked messages that a sender search looks at.
ONE_TO_ONE, LOOKBACK = 45, 20_000


def within(start: float | None, end: float | None) -> Column:
    """Windows that lie in the span; an open side is None."""
    c = F.lit(True)
    c = c & (F.col("start_ts") >= start) if start is not None else c
    return c & (F.col("end_ts") <= end) if end is not None else c


def participant_chats(roster: DataFrame, messages: DataFrame, handles: list[str]) -> DataFrame:
    """chat_id of chats that someone is a member of or has written in. ``roster``: chat_id, handle."""
    of = lambda df: df.filter(F.col("handle").isin(handles)).select("chat_id")
    return of(roster).union(of(messages.filter(~F.col("is_from_me")))).distinct()


def chat_kinds(chats: DataFrame, roster: DataFrame) -> DataFrame:
    """(chat_id, is_group): by style, or where that is null by whether there is more than one other."""
    sizes = roster.groupBy("chat_id").agg(F.count_distinct("handle").alias("n"))
    group = F.when(F.col("style").isNotNull(), F.col("style") != ONE_TO_ONE).otherwise(F.coalesce("n", F.lit(0)) > 1)
    return chats.join(sizes, "chat_id", "left").select("chat_id", group.alias("is_group"))


def chat_filter(*sets: DataFrame | None) -> DataFrame | None:
    """Chats in all of the given sets; None, and no filter, if none is given. An empty set stays empty: nothing matches."""
    given = [s.select("chat_id") for s in sets if s is not None]
    return reduce(lambda a, b: a.join(b, "chat_id", "left_semi"), given) if given else None


def candidate_chunks(chunks: DataFrame, start: float | None = None, end: float | None = None, has_media: bool = False, chats: DataFrame | None = None) -> DataFrame | None:
    """chunk_id of windows that pass; None where nothing restricts them."""
    if start is None and end is None and not has_media and chats is None:
        return None
    out = chunks.filter(within(start, end))
    out = out.filter("has_attachment") if has_media else out
    return (out.join(chats, "chat_id", "left_semi") if chats is not None else out).select("chunk_id")


def chunks_by_sender(messages: DataFrame, members: DataFrame, handles: list[str], need_file: bool = False, lookback: int = LOOKBACK) -> DataFrame:
    """chunk_id of windows with a message that one of ``handles`` wrote, among the newest ``lookback`` that are in a window."""
    wrote = messages.filter(~F.col("is_from_me") & F.col("handle").isin(handles))
    wrote = wrote.filter("has_attachment") if need_file else wrote
    linked = wrote.join(members.select("msg_id").distinct(), "msg_id", "left_semi").select("msg_id", "ts").distinct()
    newest = linked.orderBy(F.desc("ts"), F.desc("msg_id")).limit(lookback)
    return members.join(newest, "msg_id", "left_semi").select("chunk_id").distinct()


def narrow_by_sender(candidates: DataFrame | None, by_sender: DataFrame) -> DataFrame | None:
    """Candidates that a sender wrote in; all of them if that leaves none, as the sender may write later."""
    if by_sender.isEmpty():
        return candidates
    return by_sender if candidates is None else candidates.join(by_sender, "chunk_id", "left_semi")


def visible(messages: DataFrame) -> DataFrame:
    """Without rows that have neither text nor attachment."""
    return messages.filter((F.trim(F.coalesce("text", F.lit(""))) != "") | F.col("has_attachment"))


def demote(hits: DataFrame, handles: list[str] | None = None, from_me: bool | None = None, need_file: bool = False) -> DataFrame:
    """Hydrated rows (chat_id, day, is_hit, ...) in which hits that fail become context, without sessions that keep none. A sender goes before ``from_me``."""
    ok = F.lit(True)
    if handles:
        ok = ~F.col("is_from_me") & F.lower(F.coalesce("handle", F.lit(""))).isin([h.lower() for h in handles])
    elif from_me is not None:
        ok = F.col("is_from_me") == from_me
    ok = ok & F.col("has_attachment") if need_file else ok
    marked = hits.withColumn("is_hit", F.col("is_hit") & ok)
    return marked.withColumn("__any", F.max("is_hit").over(W.partitionBy("chat_id", "day"))).filter("__any").drop("__any")
