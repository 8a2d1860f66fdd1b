"""Orders over a whole table without a task that holds all of it.

The table is cut at sampled quantiles of the first column of the order; counts by range
say where a range starts, and rows are numbered inside their ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

PARTS = 64


def cut(df: DataFrame, by: str, parts: int = PARTS, out: str = "__part") -> DataFrame:
    """Add the range that ``by`` (a number, a date or a time) falls in; equal values share one, nulls are in the first."""
    kind = df.schema[by].dataType
    number = F.col(by) if isinstance(kind, T.NumericType) else F.col(by).cast("timestamp")
    number = number.cast("double")
    marks = df.select(number.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.002)
    bounds = F.array(*[F.lit(float(b)) for b in sorted(set(marks))]).cast("array<double>")
    return df.withColumn(out, F.size(F.filter(bounds, lambda b: b <= number)))


def numbered(df: DataFrame, *order: str, out: str = "i") -> DataFrame:
    """Add a number from 0 in the order of the columns, over the whole table."""
    some = cut(df, order[0])
    sizes = some.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))  # a row a range
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return some.withColumn("__in", inside).join(F.broadcast(starts), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__start") + F.col("__in")).alias(out))


def summed_before(df: DataFrame, by: str, value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows that stand before by ``by``; its values are distinct."""
    some = cut(df.withColumn("__value", value), by)
    sizes = some.groupBy(F.col("__part").alias("__p")).agg(F.sum("__value").alias("__n"))
    before = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum("__value").over(W.partitionBy("__part").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = some.withColumn("__in", inside).join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return placed.select(*df.columns, (F.col("__start") + F.col("__in")).alias(out))
