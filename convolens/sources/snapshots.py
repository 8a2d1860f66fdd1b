"""Versioned copies of the messages, kept current by changes.

Rows are dealt to buckets by chat. A version is a list that says where each bucket's rows are; applying
changes writes anew only the buckets that they touch. The list also has the ledger of applied batches and
the greatest time, so data and ledger become visible together, by a pointer that is written last.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.sources.store import IndexStore

KEY = ("chat_id", "msg_id")
BUCKETS = 256


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (insert, update, delete), chat_id, msg_id and the columns of ``after``, null in a delete: what makes ``after`` of ``before``.

    One row a key that differs; keys are distinct in each table and not null. Both have the same columns; equal nulls are equal.
    """
    rest = [c for c in after.columns if c not in KEY]
    a = after.select(*KEY, F.struct(*rest).alias("__new"))
    b = before.select(*KEY, F.struct(*rest).alias("__old"))
    both = b.join(a, list(KEY), "full")
    kind = F.when(F.col("__old").isNull(), "insert").when(F.col("__new").isNull(), "delete").when(~F.col("__new").eqNullSafe(F.col("__old")), "update")
    return both.select(kind.alias("change"), *KEY, *[F.col("__new")[c].alias(c) for c in rest]).filter("change is not null")


class SourceSnapshots:
    """Versions of the messages under ``root``; see the module. ``schema``: of the messages, with chat_id and msg_id."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.files, self.root, self.schema = spark, IndexStore(spark, root), root.rstrip("/"), schema

    def manifest(self, version: int | None = None) -> dict:
        """number, buckets (bucket: folder), applied (stream: greatest batch), horizon; of the newest version, or of an older one that is still there."""
        found = {int(p[:12]): p[13:] for p in self.files.pointers()}
        if not found and version is None:
            return {"number": 0, "buckets": {}, "applied": {}, "horizon": None}
        number = max(found) if version is None else version
        if number not in found:
            raise FileNotFoundError(f"no version {number} at {self.root}")
        return json.loads(self.spark.read.text(f"{self.root}/{found[number]}/list", wholetext=True).first()[0]) | {"number": number}

    def rows(self, buckets: dict[str, str]) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema)
        folders = [f"{self.root}/{folder}/bucket={b}" for b, folder in buckets.items()]
        return self.spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows(self.manifest(version)["buckets"])

    def apply(self, feed: DataFrame, stream: str, batch: int) -> bool:
        """Apply a batch of ``changes``, once: a batch that the ledger has changes nothing and gives False.

        Several changes of one key in a batch: the last by column ``seq`` counts, where there is one. A delete
        of what is not there and an insert of what is are applied like the rest.
        """
        now = self.manifest()
        if now["applied"].get(stream, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64("chat_id"), F.lit(BUCKETS))
        columns = self.spark.createDataFrame([], self.schema).columns
        if "seq" in feed.columns:
            feed = feed.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in feed.columns if c not in KEY]), "seq").alias("m")).select(*KEY, "m.*")
        touched = [str(r["b"]) for r in feed.select(bucket.alias("b")).distinct().collect()]
        old = self.rows({b: now["buckets"][b] for b in touched if b in now["buckets"]})
        left = old.join(feed.select(*KEY), list(KEY), "left_anti")
        fresh = left.unionByName(feed.filter("change != 'delete'").select(*columns))
        folder = f"d={uuid.uuid4().hex}"
        if touched:
            fresh.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        held = {n[7:] for n in self.files.names(folder) if n.startswith("bucket=")}
        buckets = {b: f for b, f in now["buckets"].items() if b not in touched} | {b: folder for b in touched if b in held}
        horizon = feed.agg(F.max("ts")).first()[0] if "ts" in feed.columns else None
        known = [x for x in (horizon, now["horizon"]) if x is not None]
        self.publish(now["number"] + 1, {"buckets": buckets, "applied": now["applied"] | {stream: batch}, "horizon": max(known, default=None)})
        return True

    def publish(self, number: int, manifest: dict) -> None:
        version = f"v={uuid.uuid4().hex}"

        def write(fs, p):
            out = fs.create(p, False)
            out.write(bytearray(json.dumps(manifest).encode()))
            out.close()

        self.files.path(f"{version}/list", write)
        self.files.path(f"current/{number:012d}.{version}", lambda fs, p: fs.create(p, False).close())

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete versions but the newest ``keep`` and folders that none of these uses. No batch may be applied meanwhile."""
        pointers = self.files.pointers()
        kept = [self.manifest(int(p[:12])) for p in pointers[-keep:]]
        used = {p[13:] for p in pointers[-keep:]} | {f for m in kept for f in m["buckets"].values()}
        gone = [n for n in self.files.names("") if n[:2] in ("v=", "d=") and n not in used]
        for name in [*(f"current/{p}" for p in pointers[:-keep]), *gone]:
            self.files.path(name, lambda fs, p: fs.delete(p, True))
        return gone


def replayed(spark: SparkSession, root: str, versions: list[DataFrame]) -> DataFrame:
    """Versions of the messages, each applied as the changes from the one before; the last as it is read back."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in versions[0].schema)
    held = SourceSnapshots(spark, root, schema)
    for i, v in enumerate(versions):
        held.apply(changes(held.read(), v), "replay", i)
    return held.read()
