"""From chunk ids to messages: sessions, conversations, the unindexed tail, status and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.functions import text as T
from convolens.functions.names import fold_name, fold_name_udf, weighted_ratio_udf
from convolens.operators.ranking import day_of

TAIL_CAP = 2000
ROW = ["msg_id", "ts", "is_from_me", "sender", "text", "has_attachment", "handle"]


def sender(names: DataFrame | None) -> Column:
    """Null for oneself, a contact's name, or the handle."""
    known = F.coalesce("display_name", "handle") if names is not None else F.col("handle")
    return F.when(~F.col("is_from_me"), known)


def with_sender(messages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``names``: (handle, display_name), one row a handle."""
    joined = messages.join(names, "handle", "left") if names is not None else messages
    return joined.withColumn("sender", sender(names)).drop("display_name")


def hydrate(wanted: DataFrame, members: DataFrame, messages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Message rows of sessions. ``wanted``: chat_id, day, chunk_id, is_hit, those of a page. A message in several chunks stands once, as a hit if one is.

    The few wanted rows meet the messages first; of several rows with one id the earliest by time and text counts.
    """
    rows = F.broadcast(wanted).join(members, "chunk_id").groupBy("chat_id", "day", "msg_id").agg(F.max("is_hit").alias("is_hit"))
    full = with_sender(messages.filter((F.trim(F.coalesce("text", F.lit(""))) != "") | F.col("has_attachment")), names).drop("chat_id")
    met = full.join(F.broadcast(rows), "msg_id")
    first = F.row_number().over(W.partitionBy("chat_id", "day", "msg_id").orderBy("ts", "text"))
    return met.withColumn("__first", first).filter("__first = 1").drop("__first")


def nest(rows: DataFrame) -> DataFrame:
    """One row a session with arrays ``hit_messages`` and ``context_messages`` by time."""
    part = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("ts", "msg_id", *[x for x in ROW if x not in ("ts", "msg_id")]))))
    return rows.groupBy("chat_id", "day").agg(part(F.col("is_hit")).alias("hit_messages"), part(~F.col("is_hit")).alias("context_messages"))


def payload(nested: DataFrame, terms: list[str] = (), hide: bool = False) -> DataFrame:
    """Add ``payload`` (JSON) with redacted texts, match scores and ``confidence`` by the number of sessions."""
    words = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    text = lambda m: T.redact(m["text"]) if hide else m["text"]
    shown = lambda c: F.transform(c, lambda m: F.struct(m["msg_id"].alias("message_id"), m["ts"].alias("ts"), m["is_from_me"].alias("is_from_me"), m["sender"].alias("sender"), text(m).alias("text"), T.match_score(m["text"], words).alias("match_score")))
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    level = F.when(n >= 3, "high").when(n >= 1, "low").otherwise("none")
    return nested.withColumn("confidence", level).withColumn("payload", F.to_json(F.struct("chat_id", F.col("day").cast("string").alias("day"), "confidence", shown("hit_messages").alias("hits"), shown("context_messages").alias("context"))))


def conversation(messages: DataFrame, chat_id: int, around: float | None = None, limit: int = 50) -> DataFrame:
    """A chat's newest ``limit`` messages, or those centred on the one nearest in time, by time; a frame that would pass an end is moved inside."""
    chat = messages.filter(F.col("chat_id") == chat_id)
    if around is None:
        return chat.orderBy(F.desc("ts"), F.desc("msg_id")).limit(limit).orderBy("ts", "msg_id")
    one = W.partitionBy("chat_id")
    placed = chat.withColumn("i", F.row_number().over(one.orderBy("ts", "msg_id")) - 1).withColumn("n", F.count("*").over(one))
    placed = placed.withColumn("c", F.min_by("i", F.struct(F.abs(F.col("ts") - around), "i")).over(one))
    low = F.greatest(F.lit(0), F.least(F.col("c") - limit // 2, F.col("n") - limit))
    return placed.filter((F.col("i") >= low) & (F.col("i") < low + limit)).drop("i", "n", "c").orderBy("ts", "msg_id")


def tail_limit(behind: int) -> int:
    return min(2 * behind + 50, TAIL_CAP)


def live_tail(messages: DataFrame, since: float, limit: int, until: float | None = None, chats: DataFrame | None = None, start: float | None = None) -> DataFrame:
    """(chat_id, day, msg_id, ...) newer than the index, of the last ``limit`` rows by id; the horizon filters and never ends the reading, as ids are not in order of time.

    Dates and chats that a search asks for hold here as well.
    """
    last = messages.orderBy(F.desc("msg_id")).limit(limit).filter(F.col("ts") > since)
    last = last.filter(F.col("ts") >= start) if start is not None else last
    last = last.filter(F.col("ts") <= until) if until is not None else last
    last = last.join(chats, "chat_id", "left_semi") if chats is not None else last
    return last.withColumn("day", day_of(F.col("ts"))).withColumn("is_hit", F.lit(True))


def merge_rows(tail: DataFrame, indexed: DataFrame) -> DataFrame:
    """Message rows of both, each message once in a session, as a hit if it is one in either."""
    columns = [c for c in indexed.columns if c in tail.columns and c not in ("chat_id", "day", "msg_id", "is_hit")]
    both = tail.select("chat_id", "day", "msg_id", "is_hit", *columns).unionByName(indexed.select("chat_id", "day", "msg_id", "is_hit", *columns))
    return both.groupBy("chat_id", "day", "msg_id").agg(F.max("is_hit").alias("is_hit"), *[F.first(c, True).alias(c) for c in columns])


def status(chunks: DataFrame, members: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of counts and times of the index."""
    c = chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("chat_id").alias("n_chats"), F.min("start_ts").alias("oldest"), F.max("end_ts").alias("newest"))
    m = members.agg(F.count_distinct("msg_id").alias("n_messages"))
    s = messages.agg(F.count_distinct("msg_id").alias("n_source_messages"))
    return c.crossJoin(m).crossJoin(s)


def freshness(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(horizon, n_behind, stale): messages newer than all windows."""
    horizon = chunks.agg(F.max("end_ts").alias("horizon"))
    behind = messages.join(F.broadcast(horizon), F.col("ts") > F.col("horizon"))
    n = behind.agg(F.count_distinct("msg_id").alias("n_behind"))
    return horizon.crossJoin(n).withColumn("stale", F.col("n_behind") > 0)


def chat_metadata(chats: DataFrame, roster: DataFrame, names: DataFrame) -> DataFrame:
    """(chat_id, participants, participant_count, title); a title falls back on the chat's identifier, if it has one."""
    shown = roster.select("chat_id", "handle").distinct().join(names, "handle", "left").select("chat_id", "handle", F.coalesce("display_name", "handle").alias("name"))
    people = shown.groupBy("chat_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("handle", "name"))), lambda x: x["name"]).alias("participants"))
    joined = chats.join(people, "chat_id", "left").withColumn("participants", F.coalesce("participants", F.array().cast("array<string>")))
    fallback = F.col("chat_identifier") if "chat_identifier" in chats.columns else F.lit(None).cast("string")
    title = F.when(F.size("participants") > 0, F.array_join("participants", ", ")).otherwise(F.coalesce(fallback, F.lit("Unknown conversation")))
    return joined.select("chat_id", "participants", F.size("participants").alias("participant_count"), title.alias("title"))


def suggest_contacts(contacts: DataFrame, prefix: str, limit: int = 8, least: float = 60.0) -> DataFrame:
    """Contacts whose name or one of its words begins so, then similar ones; these are looked for only if the first are too few."""
    p = fold_name(prefix)
    low = fold_name_udf("display_name")
    named = contacts.withColumn("starts", low.startswith(p) | low.contains(" " + p))
    begin = named.filter("starts").orderBy("display_name", "identifier").limit(limit).select("identifier", "display_name")
    if begin.count() == limit:
        return begin
    scored = named.withColumn("score", F.when(F.col("starts"), 100.0).otherwise(weighted_ratio_udf("display_name", F.lit(prefix))))
    return scored.filter(F.col("starts") | (F.col("score") >= least)).orderBy(F.desc("starts"), F.desc("score"), "display_name", "identifier").limit(limit).select("identifier", "display_name")


def inversions(messages: DataFrame) -> DataFrame:
    """(pairs, inverted): ids that follow each other, and how many of them do not follow in time."""
    nxt = messages.select((F.col("msg_id") - 1).alias("msg_id"), F.col("ts").alias("next_ts"))
    return messages.select("msg_id", "ts").join(nxt, "msg_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("next_ts") < F.col("ts")).alias("inverted"))


def coverage(messages: DataFrame, members: DataFrame) -> DataFrame:
    """(messages, in_chunks, share)."""
    ids = messages.select("msg_id").distinct()
    hit = members.select("msg_id").distinct().withColumn("hit", F.lit(1))
    return ids.join(hit, "msg_id", "left").agg(F.count("*").alias("messages"), F.count("hit").alias("in_chunks")).withColumn("share", F.col("in_chunks") / F.col("messages"))
