"""Bounded samples of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.shared import order_key


def id_remainder(key: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % k


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int) -> DataFrame:
    """(doc_id, y, rows_of_class, text): up to ``per_class`` rows of each class, those first by a hash of the id.

    ``usable`` is a condition on doc_id that keeps held-out rows away. Rows with no
    label or a longer text than ``max_bytes`` are not learned from; of several labels
    of an id the greatest counts.
    """
    known = labels.filter(F.col(label).isNotNull() & usable).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = docs.filter(usable).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))
    fit = known.join(sizes.filter(F.col("size") <= max_bytes).select("doc_id").distinct(), "doc_id")
    counts = fit.groupBy("y").agg(F.count("*").alias("rows_of_class"))
    picked = None
    for y in (0, 1):
        some = fit.filter(F.col("y") == y).orderBy(order_key(F.col("doc_id")), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.filter(usable).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    return picked.join(counts, "y").join(texts, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "y", "rows_of_class", "text")
