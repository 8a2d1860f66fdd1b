"""Cutting conversations into overlapping session windows, and comparing two cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.functions.text import strip_placeholder, token_count
from convolens.operators import ranges

#: Seconds without a message that end a window, its tokens and messages at most, and messages that the next one takes over.
GAP, TOKENS, MESSAGES, OVERLAP = 2700, 400, 40, 2


def gap_sessions(messages: DataFrame, gap: float = GAP) -> DataFrame:
    """Add ``session``: runs of a chat's messages with no longer pause than ``gap``."""
    by_time = W.partitionBy("chat_id").orderBy("ts", "msg_id")
    new = (F.col("ts") - F.lag("ts").over(by_time) > gap).cast("int")
    return messages.withColumn("session", F.coalesce(F.sum(new).over(by_time.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).cast("long"))


def fold(tokens: list[int], target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Windows [start, end) over messages without a long pause.

    A window closes before the message that would take it over the target or over the
    count; the next one starts with its last ``overlap`` messages and takes that message
    whatever it holds by then.
    """
    out, start, held = [], 0, 0
    for i, n in enumerate(tokens):
        if i > start and (held + n > target or i - start >= most):
            out.append((start, i))
            start = max(start, i - overlap) if overlap else i
            held = sum(tokens[start:i])
        held += n
    return [*out, (start, len(tokens))] if tokens else out


def chunk_messages(messages: DataFrame, gap: float = GAP, token_target: int = TOKENS, max_messages: int = MESSAGES, overlap: int = OVERLAP) -> DataFrame:
    """chat_id, position (from 0 in a chat by time), start_ts, end_ts, msg_ids, has_attachment.

    Nothing passes a long pause, so each (chat, session) is folded by itself; a session
    comes as one array of (ts, id, tokens), without texts.
    """
    t = token_count(F.coalesce(strip_placeholder(F.col("text")), F.lit("")))
    flat = gap_sessions(messages, gap).withColumn("tokens", t)
    rows = flat.groupBy("chat_id", "session").agg(F.sort_array(F.collect_list(F.struct("ts", "msg_id", "tokens", "has_attachment"))).alias("m"))

    @F.pandas_udf("array<array<int>>")
    def cut(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: [[s, e] for s, e in fold(t.tolist(), token_target, max_messages, overlap)])

    # of a message only its number of tokens goes to Python
    cuts = rows.withColumn("cuts", cut(F.transform("m", lambda x: x["tokens"])))
    each = cuts.select("chat_id", "session", F.posexplode("cuts").alias("i", "c"), "m").select("chat_id", "session", "i", F.slice("m", F.col("c")[0] + 1, F.col("c")[1] - F.col("c")[0]).alias("m"))
    position = F.row_number().over(W.partitionBy("chat_id").orderBy("session", "i")) - 1
    return each.select("chat_id", position.alias("position"), F.col("m")[0]["ts"].alias("start_ts"), F.element_at("m", -1)["ts"].alias("end_ts"), F.transform("m", lambda x: x["msg_id"]).alias("msg_ids"), F.exists("m", lambda x: x["has_attachment"]).alias("has_attachment"))


def chat_states(messages: DataFrame) -> DataFrame:
    """(chat_id, n, h): how many messages a chat has, and a hash of all that its windows are made of, in any order."""
    columns = [c for c in ("msg_id", "ts", "is_from_me", "handle", "text", "date_edited", "date_retracted", "has_attachment", "files") if c in messages.columns]
    return messages.groupBy("chat_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("h"))


def membership(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("msg_ids").alias("msg_id"), "chunk_id")


def with_content_hash(chunks: DataFrame, messages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Add a hash of the messages' texts, and of the names of their ``files``, which tells an edit that keeps all ids."""
    messages = messages.join(files, "msg_id", "left") if files is not None else messages
    columns = [c for c in ("text", "date_edited") if c in messages.columns] + (["files"] if files is not None else [])
    texts = chunks.select("chat_id", "position", F.explode("msg_ids").alias("msg_id")).join(messages.select("chat_id", "msg_id", F.xxhash64(*columns).alias("h")), ["chat_id", "msg_id"])
    return chunks.join(texts.groupBy("chat_id", "position").agg(F.bit_xor(F.xxhash64("msg_id", "h")).alias("content_hash")), ["chat_id", "position"])


def positional_diff(fresh: DataFrame, existing: DataFrame, top: int | None = None) -> DataFrame:
    """chat_id, position, action (same, rewrite, insert, delete), chunk_id, and the fresh msg_ids.

    The k-th window of a chat is held against the k-th there is. A rewrite keeps the id;
    new ids go on from the greatest, by chat and place, so that order of ids stays order in time.
    ``top``: the greatest id there is, where ``existing`` has only some chats.
    """
    old = existing.select("chat_id", F.row_number().over(W.partitionBy("chat_id").orderBy("chunk_id")).alias("k"), F.col("chunk_id").alias("old_id"), F.array_sort("msg_ids").alias("old_ids"), *([F.col("content_hash").alias("old_hash")] if "content_hash" in existing.columns else []))
    new = fresh.select("chat_id", (F.col("position") + 1).alias("k"), F.array_sort("msg_ids").alias("new_ids"), *([F.col("content_hash").alias("new_hash")] if "content_hash" in fresh.columns else []))
    both = new.join(old, ["chat_id", "k"], "full")
    equal = F.col("new_ids") == F.col("old_ids")
    if "old_hash" in old.columns and "new_hash" in new.columns:
        equal = equal & F.col("new_hash").eqNullSafe(F.col("old_hash"))
    action = F.when(F.col("new_ids").isNull(), "delete").when(F.col("old_ids").isNull(), "insert").when(equal, "same").otherwise("rewrite")
    marked = both.withColumn("action", action)
    top = existing.agg(F.coalesce(F.max("chunk_id"), F.lit(0)).alias("top")) if top is None else existing.sparkSession.range(1).select(F.lit(top).cast("long").alias("top"))
    # ids of new windows: chats one after the other, so a chat's first id is what chats before it need
    need = marked.filter("action = 'insert'").groupBy("chat_id").agg(F.count("*").alias("n"))
    before = ranges.summed_before(need, "chat_id", F.col("n"), "before").select("chat_id", "before")
    numbered = marked.withColumn("i", F.sum((F.col("action") == "insert").cast("long")).over(W.partitionBy("chat_id").orderBy("k")))
    ids = F.coalesce("old_id", F.col("top") + F.col("before") + F.col("i"))
    return numbered.join(before, "chat_id", "left").crossJoin(F.broadcast(top)).select("chat_id", (F.col("k") - 1).alias("position"), "action", ids.cast("long").alias("chunk_id"), F.col("new_ids").alias("msg_ids"))
