"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996), in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.llm.shared import aside, keep, number_rows, small


def tempered_units(df: DataFrame, source: str = "source", alpha: float = 0.5, resolution: int = 1000) -> DataFrame:
    """Target weights in proportion to (rows of the source) ** alpha, in whole units of about 1 / resolution, 1 at least."""
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    total = W.partitionBy()
    return sizes.select("source", F.greatest(F.lit(1), F.round(resolution * F.pow("n", F.lit(alpha)) / F.sum(F.pow("n", F.lit(alpha))).over(total))).cast("int").alias("units"))


def _due(k: Column, units: Column, period: Column) -> Column:
    """Deadline of subtask k (from 0) of weight units / period: ceil((k + 1) * period / units)."""
    return F.expr("0").cast("long") + F.floor(((k + 1) * period + units - 1) / units).cast("long")


def _release(k: Column, units: Column, period: Column) -> Column:
    return F.floor(k * period / units).cast("long")


def pfair_pattern(weights: DataFrame) -> DataFrame:
    """One period of the schedule: (source, units, period, turn, offset, release, deadline).

    ``weights`` has one row per source (a dimension table) with whole ``units``; the
    period is their sum, and in each period a source has as many turns as units. At
    every slot the released turn with the earliest deadline goes, ties by source.
    Every turn then runs inside its window, so before any slot a source is less than
    one block away from its share; the pattern repeats exactly after a period.
    """
    one = weights.filter("units > 0").agg(F.sort_array(F.collect_list(F.struct("source", "units"))).alias("s"), F.sum("units").cast("long").alias("period"))

    def slot(acc: Column, t: Column) -> Column:
        def bid(x: Column, i: Column) -> Column:
            k = F.get(acc["turn"], i)
            ready = (k < x["units"]) & (_release(k, x["units"], F.col("period")) <= t)
            return F.when(ready, F.struct(_due(k, x["units"], F.col("period")).alias("due"), i.alias("i")))

        best = F.array_min(F.filter(F.transform(F.col("s"), bid), lambda b: b.isNotNull()))["i"]
        return F.transform(F.array(best), lambda b: F.struct(F.transform(acc["turn"], lambda k, i: F.when(i == b, k + 1).otherwise(k)).alias("turn"), F.concat(acc["out"], F.array(b)).alias("out")))[0]

    start = F.struct(F.transform(F.col("s"), lambda _: F.lit(0).cast("long")).alias("turn"), F.array().cast("array<int>").alias("out"))
    ran = one.filter("period > 0").select("s", "period", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("period") - 1), start, slot)["out"].alias("out"))
    rows = ran.select("s", "period", F.posexplode("out").alias("offset", "i")).select(F.get("s", F.col("i")).alias("x"), "period", F.col("offset").cast("long").alias("offset"))
    turn = F.row_number().over(W.partitionBy("x.source").orderBy("offset")).cast("long") - 1
    out = rows.select(F.col("x.source").alias("source"), F.col("x.units").cast("long").alias("units"), "period", turn.alias("turn"), "offset")
    return out.select("*", _release(F.col("turn"), F.col("units"), F.col("period")).alias("release"), _due(F.col("turn"), F.col("units"), F.col("period")).alias("deadline"))


def mix(df: DataFrame, weights: DataFrame | None = None, source: str = "source", key: str = "doc_id", block_rows: int = 32, ties: list[str] = ()) -> DataFrame:
    """Add ``block``, ``slot``, ``release``, ``deadline`` and ``position`` (gapless from 0): the place of each row in the mix.

    Rows of a source are put in the order of a hash of the key and cut into blocks of
    ``block_rows``; block k takes turn k of its source's endless Pfair schedule. All
    rows are kept: once a source has no block left its slots stay empty, and the
    others go on in their order. A null source is a source; a source without a weight
    has weight 1 unit. Columns of those names that ``df`` has are replaced, other columns
    are kept whatever their names. Texts are not looked at. Empty in, empty out.
    """
    added = ["block", "slot", "release", "deadline", "position"]
    base, back = aside(df.drop(*added), source, key, *ties)
    weights = tempered_units(base, source) if weights is None else weights
    present = base.select(F.col(source).alias("__p")).distinct()
    known = present.join(weights, F.col("__p").eqNullSafe(F.col("source")), "left").select(F.col("__p").alias("source"), F.greatest(F.coalesce("units", F.lit(1)), F.lit(1)).alias("units"))
    pattern = keep(pfair_pattern(known), "pattern")
    units = pattern.groupBy(F.col("source").alias("__s")).agg(F.max("units").alias("__u"))

    numbered = number_rows(base, [source], key, "__n", ties).withColumn("block", F.floor(F.col("__n") / block_rows).cast("long"))
    with_units = numbered.join(small(units), F.col(source).eqNullSafe(F.col("__s"))).withColumn("__turn", F.col("block") % F.col("__u"))
    p = pattern.select(F.col("source").alias("__s2"), F.col("turn").alias("__t2"), "period", "offset", F.col("release").alias("__r"), F.col("deadline").alias("__d"))
    placed = with_units.join(small(p), F.col(source).eqNullSafe(F.col("__s2")) & (F.col("__turn") == F.col("__t2")))
    first = F.floor(F.col("block") / F.col("__u")).cast("long") * F.col("period")
    placed = placed.select(*base.columns, "block", (first + F.col("offset")).alias("slot"), (first + F.col("__r")).alias("release"), (first + F.col("__d")).alias("deadline"), (F.col("__n") % block_rows).alias("__in"))

    # where each slot starts: sums in ranges of slots, then over the ranges
    filled = placed.groupBy("slot").agg(F.count("*").alias("__n")).withColumn("__range", F.floor(F.col("slot") / 128).cast("long"))
    ranges = filled.groupBy("__range").agg(F.sum("__n").alias("__all"))
    ahead = ranges.select("__range", F.coalesce(F.sum("__all").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__range").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = keep(filled.withColumn("__inside", inside).join(ahead, "__range").select(F.col("slot").alias("__slot"), (F.col("__ahead") + F.col("__inside")).alias("__start")), "starts")
    out = placed.join(small(starts), F.col("slot") == F.col("__slot"))
    return back(out, "block", "slot", "release", "deadline", (F.col("__start") + F.col("__in")).cast("long").alias("position"))
