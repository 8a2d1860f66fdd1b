"""The index on disk: immutable segments and versions that name them, made visible by a pointer that is written last.

A build writes one segment: the windows that are new or changed, and tombstones of those that it
replaces or drops. A version lists its segments in order; a reader takes the rows of all of them but
those of windows that a later segment has buried. Segments are merged when those after one have grown
as large as it, so there are about as many as the logarithm of the number of builds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.schemas import SCHEMAS

#: How a table's rows are laid out, so that a filter on these columns reads few row groups.
LAYOUT = {"postings": ("term", "chunk_id"), "terms": ("term",), "chunks": ("chunk_id",), "chunk_message": ("chunk_id", "msg_id")}
#: Tables of a segment, all but ``terms`` by window; tables that each version has whole.
SEGMENTED = ("chunks", "chunk_message", "postings", "terms", "doc_stats", "vectors")
WHOLE = ("meta", "chat_state", "attachment_place", "attachment_retry")
#: Segments that must follow one before it is merged with them; tombstones up to which they are broadcast (8 bytes each, twice).
FOLLOWING, BROADCAST_ROWS = 3, 250_000


def rows_of(spark: SparkSession, root: str, segment: dict, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{segment['name']}/{name}")


def merged(spark: SparkSession, root: str, segments: Sequence[dict], name: str, all_there_is: bool = True) -> DataFrame:
    """A table over segments in their order, without rows of windows that a later one has buried.

    ``terms`` are differences that are added up: a segment takes away what the windows had that it buries,
    so before ``all_there_is`` a sum may be negative.
    """
    if not segments:
        return spark.createDataFrame([], SCHEMAS[name])
    every = reduce(DataFrame.unionByName, [rows_of(spark, root, s, name).withColumn("__age", F.lit(i)) for i, s in enumerate(segments)])
    if name == "terms":
        sums = every.groupBy("term").agg(F.sum("docs").alias("docs"))
        return sums.filter("docs > 0" if all_there_is else "docs != 0")
    graves = [(i, s) for i, s in enumerate(segments) if i and s["dead"]]
    if not graves:
        return every.drop("__age")
    buried = reduce(DataFrame.unionByName, [rows_of(spark, root, s, "tombstones").withColumn("__until", F.lit(i)) for i, s in graves])
    buried = buried.groupBy(F.col("chunk_id").alias("__buried")).agg(F.max("__until").alias("__until"))
    buried = F.broadcast(buried) if sum(s["dead"] for _, s in graves) <= BROADCAST_ROWS else buried
    return every.join(buried, (F.col("chunk_id") == F.col("__buried")) & (F.col("__age") < F.col("__until")), "left_anti").drop("__age")


def merge_from(segments: Sequence[dict], following: int = FOLLOWING) -> int | None:
    """The first segment that is to be merged with all that follow it: these are ``following`` or more and together as large; all, if more windows are buried than live."""
    sizes = [s["rows"] + s["dead"] for s in segments]
    if len(segments) > 1 and 2 * sum(s["dead"] for s in segments) > sum(s["rows"] for s in segments):
        return 0
    return next((i for i in range(len(segments)) if len(segments) - i > following and sum(sizes[i + 1 :]) >= sizes[i]), None)


class Snapshot:
    """One version of an index. A query that reads all its tables from one snapshot never mixes two versions."""

    def __init__(self, spark: SparkSession, root: str, number: int, version: str):
        self.spark, self.root, self.number, self.version = spark, root, number, version
        self.tables: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        """A table; its files are listed once in a snapshot."""
        if name not in self.tables:
            if name in SEGMENTED:
                self.tables[name] = merged(self.spark, self.root, self.segments, name)
            else:
                self.tables[name] = self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{self.version}/{name}")
        return self.tables[name]

    @cached_property
    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.read("meta").collect()}

    @property
    def segments(self) -> list[dict]:
        """name, rows (windows) and dead (tombstones) of each, oldest first."""
        return json.loads(self.meta.get("segments", "[]"))


class Writer:
    """A version that is being written, on top of ``base``, segments that it goes on using.

    Each table can be read back at once, so that what follows from it is not computed again.
    """

    def __init__(self, store: IndexStore, base: Sequence[dict] = ()):
        self.store, self.base, self.done = store, list(base), set()
        self.version, self.segment = f"v={uuid.uuid4().hex}", f"s={uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, segment: str | None = None) -> DataFrame:
        """Write a table; one that is no index table is a helper and goes when the version is published."""
        home = (segment or self.segment) if name in SEGMENTED or name == "tombstones" else self.version
        path = f"{self.store.root}/{home}/{name}"
        if name in SCHEMAS:
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]])
        if name in LAYOUT:
            df = df.repartitionByRange(*LAYOUT[name]).sortWithinPartitions(*LAYOUT[name])
        df.write.option("compression", "zstd").parquet(path)
        self.done.add(name)
        return self.store.spark.read.schema(SCHEMAS.get(name, df.schema)).parquet(path)

    def publish(self, meta: dict[str, str] | None = None) -> str:
        """Take over from the version before what was not put, merge segments, drop helpers, and point to this version."""
        store, before = self.store, self.store.snapshot(missing_ok=True)
        empty = lambda name: store.spark.createDataFrame([], SCHEMAS[name])
        for name in {*SEGMENTED, "tombstones"} - self.done:
            whole = before and not self.base and name != "tombstones"
            self.put(name, before.read(name) if whole else empty(name))
        own = {"name": self.segment, **{k: rows_of(store.spark, store.root, {"name": self.segment}, t).count() for k, t in (("rows", "chunks"), ("dead", "tombstones"))}}
        segments = self.merge([*self.base, own] if own["rows"] or own["dead"] or not self.base else self.base)
        for name in set(WHOLE) - self.done - {"meta"}:
            self.put(name, before.read(name) if before else empty(name))
        meta = {**(before.meta if before else {}), **(meta or {}), "segments": json.dumps(segments)}
        self.put("meta", store.spark.createDataFrame([(k, v) for k, v in meta.items() if v is not None], "key string, value string"))
        for name in self.done - {*SEGMENTED, *WHOLE, "tombstones"}:
            store.path(f"{self.version}/{name}", lambda fs, p: fs.delete(p, True))
        store.path(f"current/{(before.number if before else 0) + 1:012d}.{self.version}", lambda fs, p: fs.create(p, False).close())
        return self.version

    def merge(self, segments: list[dict]) -> list[dict]:
        """``segments``, with those that ``merge_from`` names written as one."""
        store = self.store
        start = merge_from(segments)
        if start is None:
            return segments
        some, name = segments[start:], f"s={uuid.uuid4().hex}"
        for table in SEGMENTED:
            self.put(table, merged(store.spark, store.root, some, table, all_there_is=not start), name)
        graves = reduce(DataFrame.unionByName, [rows_of(store.spark, store.root, s, "tombstones") for s in some]).distinct()
        self.put("tombstones", graves if start else graves.limit(0), name)
        count = lambda t: rows_of(store.spark, store.root, {"name": name}, t).count()
        return [*segments[:start], {"name": name, "rows": count("chunks"), "dead": count("tombstones")}]


class IndexStore:
    """Segments ``root``/s=<id>/<name> and versions ``root``/v=<id>/<name>. A reader sees the version that the greatest pointer names, so a failed build changes nothing.

    A pointer is an empty file whose name has its number and the version: finding it needs no Spark job.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str, act):
        """``act(file system, path)`` on something under the root, in whatever store Spark reads it from."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return act(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p)

    def names(self, folder: str) -> list[str]:
        return self.path(folder, lambda fs, p: [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else [])

    def pointers(self) -> list[str]:
        return sorted(n for n in self.names("current") if n[:12].isdigit())

    def snapshot(self, missing_ok: bool = False) -> Snapshot | None:
        top = next(reversed(self.pointers()), None)
        if top is None and not missing_ok:
            raise FileNotFoundError(f"no index at {self.root}")
        return Snapshot(self.spark, self.root, int(top[:12]), top[13:]) if top else None

    def exists(self) -> bool:
        return self.snapshot(missing_ok=True) is not None

    def read(self, name: str) -> DataFrame:
        return self.snapshot().read(name)

    def writer(self, base: Sequence[dict] = ()) -> Writer:
        return Writer(self, base)

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write a new version of one segment; tables that are not given are taken over from the one before, or empty."""
        w = self.writer()
        for name, df in tables.items():
            if name != "meta":
                w.put(name, df)
        return w.publish({r["key"]: r["value"] for r in tables["meta"].collect()} if "meta" in tables else None)

    def meta(self) -> dict[str, str]:
        return self.snapshot().meta

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions but the newest ``keep``, and segments that none of these name; returns what went. A failed build's leavings go too, so no build may run meanwhile."""
        kept = [Snapshot(self.spark, self.root, int(p[:12]), p[13:]) for p in self.pointers()[-keep:]]
        used = {v.version for v in kept} | {s["name"] for v in kept for s in v.segments}
        gone = [n for n in self.names("") if n[:2] in ("v=", "s=") and n not in used]
        for name in [*(f"current/{p}" for p in self.pointers()[:-keep]), *gone]:
            self.path(name, lambda fs, p: fs.delete(p, True))
        return gone


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a column of ``new`` wins where it is not null."""
    n = new.select(*[F.col(c).alias(f"__{c}") for c in new.columns])
    both = old.join(n, F.col(key) == F.col(f"__{key}"), "full")
    kept = [F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns]
    return both.select(*kept, *[F.col(f"__{c}").alias(c) for c in new.columns if c not in old.columns])


def insert_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    fresh = new.dropDuplicates([key]).join(old.select(key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def write_json_lines(df: DataFrame, path: str) -> None:
    """All columns but those that begin with an underscore."""
    df.select(*[c for c in df.columns if not c.startswith("_")]).write.mode("append").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Golden sets and suites, a record a line; fields that the schema lacks are left out."""
    return spark.read.schema(schema).json(path)
