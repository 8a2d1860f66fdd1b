"""The message source: its seven relations to one cleaned row per (chat, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.functions.blobs import decode_rich_text_udf
from convolens.schemas import REQUIRED, SCHEMAS, require_columns


def read_source(spark: SparkSession, path: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The relations at ``path``/<name>.<fmt>, their columns checked; ``path`` may be any that Spark reads. Nothing is inferred."""
    reader = spark.read
    tables = {}
    for name in REQUIRED:
        r = reader if fmt == "parquet" else reader.schema(SCHEMAS[name])
        tables[name] = r.format(fmt).option("header", True).load(f"{path}/{name}.{fmt}")
    require_columns(tables)
    return tables


def read_jdbc_source(spark: SparkSession, url: str, **options: str) -> dict[str, DataFrame]:
    """The same relations over JDBC; the driver's jar must be on the class path."""
    tables = {n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in REQUIRED}
    require_columns(tables)
    return tables


def chat_roster(tables: dict[str, DataFrame]) -> DataFrame:
    """(chat_id, handle) of all members, those who never wrote too."""
    h = tables["handle"].select(F.col("rowid").alias("handle_id"), F.col("id").alias("handle"))
    return tables["chat_handle_join"].join(h, "handle_id").select("chat_id", "handle").distinct()


def chat_table(tables: dict[str, DataFrame]) -> DataFrame:
    """(chat_id, style, ...) of all chats."""
    return tables["chat"].withColumnRenamed("rowid", "chat_id")


def clean_messages(tables: dict[str, DataFrame], chat_id: int | None = None, decode: bool = True) -> DataFrame:
    """One row per (chat, message), reactions left out; a blank text falls back on the rich-text blob."""
    m, j, h = tables["message"], tables["chat_message_join"], tables["handle"]
    if chat_id is not None:
        j = j.filter(F.col("chat_id") == chat_id)
    with_file = tables["message_attachment_join"].select(F.col("message_id").alias("f_id")).distinct().withColumn("has_attachment", F.lit(True))
    plain = F.when(F.col("text") != "", F.col("text"))
    body = F.coalesce(plain, decode_rich_text_udf("attributed_body")) if decode else plain
    rows = m.filter(F.col("associated_message_type") == 0).join(j, m["rowid"] == j["message_id"])
    rows = rows.join(h.select(F.col("rowid").alias("h_id"), F.col("id").alias("handle")), F.col("handle_id") == F.col("h_id"), "left").join(with_file, F.col("rowid") == F.col("f_id"), "left")
    edited = lambda c: F.when(F.col(c) > 0, T.unix_seconds(F.col(c)))
    return rows.select(
        F.col("rowid").alias("msg_id"), "chat_id", T.unix_seconds(F.col("date")).alias("ts"), (F.col("is_from_me") == 1).alias("is_from_me"), "handle", body.alias("text"),
        edited("date_edited").alias("date_edited"), edited("date_retracted").alias("date_retracted"), F.coalesce("has_attachment", F.lit(False)).alias("has_attachment"),
    )


def attachments_by_message(tables: dict[str, DataFrame]) -> DataFrame:
    """(msg_id, attachments): array of (attachment_id, filename) in order of id."""
    a = tables["attachment"].select(F.col("rowid").alias("attachment_id"), "filename")
    return tables["message_attachment_join"].join(a, "attachment_id").groupBy(F.col("message_id").alias("msg_id")).agg(F.sort_array(F.collect_list(F.struct("attachment_id", "filename"))).alias("attachments"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's conversations as messages: ten minutes from turn to turn, a long gap before the fourth, an attachment every fifth."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ts = 1_700_000_000 + F.col("conv_id") * 86_400 + F.col("turn") * 600 + F.when(F.col("turn") >= 4, 3600).otherwise(0)
    mine = F.col("role") == "user"
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.col("conv_id").alias("chat_id"), ts.cast("double").alias("ts"), mine.alias("is_from_me"), F.when(~mine, F.col("role")).alias("handle"), "text", (F.col("turn") % 5 == 0).alias("has_attachment"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as messages of one chat for each user; purchases carry an attachment, views are one's own."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return e.select(F.col("event_id").alias("msg_id"), F.col("user_id").alias("chat_id"), ts.alias("ts"), (F.col("event_type") == "view").alias("is_from_me"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("handle"), F.col("event_type").alias("text"), (F.col("event_type") == "purchase").alias("has_attachment"))
