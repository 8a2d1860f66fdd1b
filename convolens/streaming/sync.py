"""Keeping an index current from a stream of messages that may come late, changed or twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from convolens.operators.sessionize import GAP, MESSAGES, OVERLAP, TOKENS, fold
from convolens.sources.snapshots import SourceSnapshots


def sync_batches(stream: DataFrame, read_all: Callable[[], DataFrame], append: Callable[[DataFrame, int], None], rebuild: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that stores each batch and cuts the touched chats anew.

    No watermark: a message from years back rewrites the windows it belongs to. ``append``
    must be idempotent by batch id; ``rebuild`` gets all messages of the touched chats.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("chat_id").distinct()
        append(batch, batch_id)
        rebuild(read_all().join(touched, "chat_id", "left_semi"), batch_id)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def follow(stream: DataFrame, held: SourceSnapshots, build: Callable[[DataFrame, int], None], built: Callable[[], int | None], name: str, checkpoint: str):
    """A query, still to be started, that applies a feed of changes (``snapshots.changes``) and brings an index up to date after each batch.

    Deletes take their windows along, as chats are compared with what the index has. ``build`` gets the messages and
    their version, ``built`` says of which version the index is. A batch that comes again is in the ledger and changes nothing;
    if the job ended between the batch and the index, the index is built then.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        held.apply(batch.persist(), name, batch_id)
        batch.unpersist()
        number = held.manifest()["number"]
        if built() != number:
            build(held.read(number), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def latest_version(messages: DataFrame) -> DataFrame:
    """One row a (chat, message) of a log of versions: the last by ``version``."""
    return messages.groupBy("chat_id", "msg_id").agg(F.max_by(F.struct(*[c for c in messages.columns if c not in ("chat_id", "msg_id")]), "version").alias("m")).select("chat_id", "msg_id", "m.*")


def session_counts(stream: DataFrame, gap: str = "45 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions by pause alone, with Spark's own operator, for uses that may drop late rows: chat_id, window, n."""
    timed = stream.withColumn("time", F.timestamp_seconds("ts"))
    return timed.withWatermark("time", delay).groupBy("chat_id", F.session_window("time", gap).alias("window")).agg(F.count("*").alias("n"))


def daily_counts(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    timed = stream.withColumn("time", F.timestamp_seconds("ts"))
    return timed.withWatermark("time", delay).groupBy("chat_id", F.window("time", "1 day").alias("window")).agg(F.count("*").alias("n"))


WINDOWS = "chat_id long, start_ts double, end_ts double, msg_ids array<long>, closed boolean"


def window_stream(stream: DataFrame, gap: float = GAP, token_target: int = TOKENS, max_messages: int = MESSAGES, overlap: int = OVERLAP) -> DataFrame:
    """Windows of chats as they grow, in update mode: the state is the open window's messages.

    ``stream``: chat_id, msg_id, ts, tokens. Closed windows leave the state; the open one
    is given again with each batch and replaces the last with its start. A message older
    than the open window starts one of its own: exact history is what sync_batches is for.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(zip(*state.get, strict=True)) if state.exists else [], columns=["msg_id", "ts", "tokens"])
        new = pd.concat([held, *[b[["msg_id", "ts", "tokens"]] for b in batches]]).drop_duplicates("msg_id", keep="last").sort_values(["ts", "msg_id"]).reset_index(drop=True)
        run = (new.ts.diff() > gap).cumsum()
        rows = []
        for _, part in new.groupby(run):
            for s, e in fold(part.tokens.tolist(), token_target, max_messages, overlap):
                own = part.iloc[s:e]
                rows.append((key[0], float(own.ts.iloc[0]), float(own.ts.iloc[-1]), own.msg_id.tolist(), True, own))
        *closed, last = rows
        state.update((last[5].msg_id.tolist(), last[5].ts.tolist(), last[5].tokens.tolist()))
        yield pd.DataFrame([r[:5] for r in closed] + [(*last[:4], False)], columns=["chat_id", "start_ts", "end_ts", "msg_ids", "closed"])

    return stream.groupBy("chat_id").applyInPandasWithState(step, WINDOWS, "ids array<long>, ts array<double>, tokens array<long>", "update", GroupStateTimeout.NoTimeout)
