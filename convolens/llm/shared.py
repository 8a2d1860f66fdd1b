"""Helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

#: White space that ends a word, as a Java pattern.
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set: one of our own on a local master, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='convolens-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/convolens-{spark.sparkContext.applicationId}"


def discard_kept(spark: SparkSession) -> None:
    """Delete all tables that ``keep`` wrote in this application; results that are still to be read need them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, so that what is used twice is computed once and a lost
    executor costs a read and not the work before it.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query inside is deleted at the query's end, and not when the driver next collects garbage. For queries that write a table which is read from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Tables of up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def width_of(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value has."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return reduce(lambda a, f: a + width_of(column[f.name], f.dataType), kind.fields, F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(column, F.lit(8).cast("long"), lambda a, x: a + width_of(x, kind.elementType)), F.lit(8))
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, with a hint to broadcast it if its rows have no more than ``most`` bytes."""
    size = reduce(lambda a, f: a + width_of(F.col(f.name), f.dataType), df.schema.fields, F.lit(16).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= most else df


def given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function of batches, after whose end the worker gives back memory: it waits for other tasks, and holds what it has beside those of the next stage."""

    @wraps(run)
    def out(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return out


#: Bits of a sieve at most, which are 32 MiB, and for each key; a row of it has 2 ** 15.
SIEVE_BITS, BITS_A_KEY = 1 << 28, 64


def sieve(keys: DataFrame):
    """A function that adds to rows whether a 64-bit hash may be one of ``keys`` (a written table of one long column): ``flag(df, hash, out)``.

    Bitmaps of bounded size are broadcast. All keys are found; of others about one in 64 is taken
    for a key, and more when the bitmaps are full, so an exact join is to follow.
    """
    bits = min(SIEVE_BITS, 1 << max(15, (BITS_A_KEY * keys.count()).bit_length() - 1))
    place = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    split = keys.select(F.shiftright(place, 15).alias("__bucket"), place.bitwiseAND(0x7FFF).alias("__bit"))
    maps = keep(split.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__map")), "sieve")

    def flag(df: DataFrame, hash: Column, out: str) -> DataFrame:
        at = F.pmod(hash, F.lit(bits))
        low = at.bitwiseAND(0x7FFF).cast("int")
        byte = F.conv(F.hex(F.substring("__map", F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, low.bitwiseAND(7)).bitwiseAND(1) == 1
        return df.join(F.broadcast(maps), F.shiftright(at, 15) == F.col("__bucket"), "left").select(*df.columns, F.coalesce(bit, F.lit(False)).alias(out))

    return flag


def aside(df: DataFrame, *needed: str):
    """(df with its other columns in one struct, a function that gives them back): so no name of theirs meets one of an operator's own.

    ``back(out, *added)`` selects the columns of ``df`` in their order, and ``added``.
    """
    own = list(dict.fromkeys(needed))
    rest = [c for c in df.columns if c not in own]
    held = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")
    packed = df.select(*own, held.alias("__rest"))

    def back(out: DataFrame, *added: str | Column, **changed: Column) -> DataFrame:
        give = lambda c: changed[c].alias(c) if c in changed else F.col("__rest")[c].alias(c) if c in rest else F.col(c)
        return out.select(*[give(c) for c in df.columns], *added)

    return packed, back


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does the same where every character is one byte, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, blank: str = BLANK) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), blank), lambda w: w != "")


def order_key(key: Column) -> Column:
    """60 bits of a stable hash of a key: even in every range, and the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def number_rows(df: DataFrame, groups: list[str], key: str, out: str, ties: list[str] = (), bits: int = 10, order: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in the order of a hash of ``key``, or of the numbers ``order``.

    A group is cut into ``2 ** bits`` ranges of the hash, so that a group with a third
    of all rows is still many small windows; a range starts where the counts of the
    ranges before it end. Groups may be null; ties go by ``ties``. With ``order``, a
    column that numbers all rows from 0, a range has 4,096 of its numbers.
    """
    h, r = "__hash", "__range"
    if order is None:
        cut = df.withColumn(h, order_key(F.col(key))).withColumn(r, F.shiftright(F.col(h), 60 - bits).cast("int"))
    else:
        cut = df.withColumn(h, F.col(order)).withColumn(r, F.shiftright(F.col(h), 12).cast("int"))
    sizes = cut.groupBy(*groups, r).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*groups).orderBy(r).rowsBetween(W.unboundedPreceding, -1)
    starts = keep(sizes.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col(r).alias("__r2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")), "starts")
    inside = W.partitionBy(*groups, r).orderBy(h, key, *ties)
    numbered = cut.withColumn("__i", F.row_number().over(inside) - 1)
    on = numbered[r] == starts["__r2"]
    for i, g in enumerate(groups):
        on = on & numbered[g].eqNullSafe(starts[f"__g{i}"])
    joined = numbered.join(small(starts), on)
    return joined.select(*df.columns, (F.col("__start") + F.col("__i")).alias(out))
