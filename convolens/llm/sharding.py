"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convolens.llm.shared import aside, let, number_rows

#: The multiplier of the published generator, as its upper 32, middle 16 and lower 16 bits.
A_HIGH, A_MID, A_LOW = 2862933555777941757 >> 32, (2862933555777941757 >> 16) & 0xFFFF, 2862933555777941757 & 0xFFFF
M16, M32 = 0xFFFF, 0xFFFFFFFF
#: Steps of a walk that all but a vanishing share of keys end in, for any number of shards.
STEPS = 64


def _next_key(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * A + 1 modulo 2 ** 64 on two halves of 32 bits; no step leaves 63 bits, so ANSI mode never sees an overflow."""
    low = lo * A_LOW
    mid = F.shiftright(low, 16) + lo * A_MID
    new_lo = F.shiftleft(mid.bitwiseAND(M16), 16).bitwiseOR(low.bitwiseAND(M16))
    cross = F.shiftright(mid, 16) + hi * A_LOW + F.shiftleft((hi * A_MID).bitwiseAND(M16), 16)
    cross = cross + lo * (A_HIGH & M16) + F.shiftleft((lo * (A_HIGH >> 16)).bitwiseAND(M16), 16)
    carry = (new_lo == M32).cast("long")
    return (cross + carry).bitwiseAND(M32), (new_lo + 1).bitwiseAND(M32)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit key among ``shards``, and among one more.

    A key's jumps do not depend on the number of shards; it stays at the last jump
    below that number. So one walk gives both. A null key counts as 0. A key has about
    log(shards) jumps; the walk has ``STEPS`` and, for a key that is still under way, as
    many more as there are shards, which is always enough, as every jump goes up.
    """
    k = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    state = F.struct(
        F.shiftrightunsigned(k, 32).alias("hi"),
        k.bitwiseAND(M32).alias("lo"),
        F.lit(0).cast("long").alias("at"),  # the last jump below shards
        F.lit(0).cast("long").alias("grown"),  # the last one below shards + 1
        F.lit(0).cast("long").alias("j"),
    )

    def moved(key_parts: Column, s: Column) -> Column:
        draw = F.shiftrightunsigned(key_parts["hi"], 1) + 1
        jump = F.floor((s["grown"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long")
        return let(
            jump,
            lambda j: F.struct(
                key_parts["hi"].alias("hi"),
                key_parts["lo"].alias("lo"),
                F.when(j < shards, j).otherwise(s["at"]).alias("at"),
                F.when(j < shards + 1, j).otherwise(s["grown"]).alias("grown"),
                j.alias("j"),
            ),
        )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next_key(s["hi"], s["lo"])
        go = let(F.struct(hi.alias("hi"), lo.alias("lo")), lambda p: moved(p, s))
        return F.when(s["j"] > shards, s).otherwise(go)

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(min(STEPS, shards + 1))), state, step)
    if STEPS < shards + 1:
        rest = lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(shards + 1)), s, step)
        walk = let(walk, lambda s: F.when(s["j"] > shards, s).otherwise(rest(s)))
    return let(walk, lambda s: F.struct(s["at"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def shard_rows(df: DataFrame, key: str = "doc_id", shards: int = 40, ties: list[str] = (), order: str | None = None) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more) and ``slot``, gapless from 0 in a shard.

    The key alone decides the shard: rows with one key, nulls too, stay together, and
    a further shard takes rows only into itself. An empty table stays empty. Columns
    of those names that ``df`` has are replaced, others kept whatever their names; a key that
    is no whole number is hashed first. Texts are not looked at. Slots are in the order of a hash of the
    key, or of the column ``order``, which numbers all rows from 0.
    """
    base, back = aside(df.drop("shard", "grown_shard", "slot"), key, *ties, *([order] if order else []))
    number = F.col(key) if isinstance(base.schema[key].dataType, T.IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    placed = base.withColumn("__jump", jump_shards(number, shards))
    placed = placed.select(*base.columns, F.col("__jump.shard").alias("shard"), F.col("__jump.grown").alias("grown_shard"))
    return back(number_rows(placed, ["shard"], key, "slot", ties, order=order), "shard", "grown_shard", "slot")
