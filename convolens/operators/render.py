"""Two texts of a window: one for vectors, one for words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.functions import text as T

CAP = 512


def speaker_labels(rows: DataFrame, window: list[str]) -> DataFrame:
    """Add ``label``: Me, Them for the only other, or A, B, ... in the order in which others first speak in a window."""
    other = F.when(~F.col("is_from_me"), F.coalesce("handle", F.lit("?")))
    first = F.when(other.isNotNull(), F.min("pos").over(W.partitionBy(*window, other)))
    ranked = rows.withColumn("__first", first)
    rank = F.dense_rank().over(W.partitionBy(*window, F.col("is_from_me")).orderBy("__first"))
    ranked = ranked.withColumn("__rank", F.when(F.col("__first").isNotNull(), rank))
    others = F.max("__rank").over(W.partitionBy(*window))
    label = F.when(F.col("is_from_me"), "Me").when(others <= 1, "Them").otherwise(F.char(64 + F.col("__rank")))
    return ranked.withColumn("label", label).drop("__first", "__rank")


def _lines(rows: DataFrame, window: list[str], line: Column) -> DataFrame:
    kept = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), lambda x: x != "")
    return rows.groupBy(*window).agg(kept.alias("lines"))


def semantic_text(rows: DataFrame, window: list[str], cap: int = CAP) -> DataFrame:
    """(window, body_semantic): ``label: text [attachment]`` a line, links as hosts; one over the cap loses its middle and its line ends.

    ``rows``: window keys, pos, is_from_me, handle, text, has_attachment.
    """
    body = T.collapse_urls(T.strip_placeholder(F.coalesce("text", F.lit(""))))
    said = F.trim(F.concat_ws(" ", F.when(body != "", body), F.when(F.col("has_attachment"), F.lit("[attachment]"))))
    lines = _lines(speaker_labels(rows, window), window, F.when(said != "", F.concat(F.col("label"), F.lit(": "), said)).otherwise(""))
    whole = F.array_join("lines", "\n")
    tokens = F.regexp_extract_all(whole, F.lit(r"\S+"), F.lit(0))
    return lines.select(*window, F.when(F.size(tokens) <= cap, whole).otherwise(F.array_join(T.middle_drop(tokens, cap), " ")).alias("body_semantic"))


def lexical_text(rows: DataFrame, window: list[str]) -> DataFrame:
    """(window, body_lexical): texts as they are, with places and file names of attachments; ``rows`` may have ``files``, an array of strings."""
    body = T.strip_placeholder(F.coalesce("text", F.lit("")))
    names = F.coalesce(F.array_join("files", " "), F.lit("")) if "files" in rows.columns else F.lit("")
    mark = F.when(F.col("has_attachment"), F.concat(F.lit("["), F.concat_ws(" ", F.lit("attachment"), F.when(names != "", names)), F.lit("]")))
    lines = _lines(rows, window, F.trim(F.concat_ws(" ", F.when(body != "", body), mark)))
    return lines.select(*window, F.array_join("lines", "\n").alias("body_lexical"))
