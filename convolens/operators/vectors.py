"""Vectors: embedding, calibration to bytes, and exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Texts that a model gets at once, and components of vectors that are numbers of eight bytes at once.
TEXTS, PIECE = 512, 1 << 20
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: signed hashed words and word pairs, of unit length; the same in every process."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, t in enumerate(texts):
            w = t.lower().split()
            for x in [*w, *(" ".join(p) for p in zip(w, w[1:], strict=False))]:
                h = int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                out[row, h % dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embed(df: DataFrame, text: str, out: str = "embedding", make: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> DataFrame:
    """Add the vectors of a text column; ``make`` builds the model once in each worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            for a in range(0, len(s), TEXTS):
                yield pd.Series(list(model([t or "" for t in s.iloc[a : a + TEXTS]])))

    return df.withColumn(out, F.pandas_udf(run, ArrayType(FloatType()))(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; one of length 0 stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))[0]


def absmax(df: DataFrame, vector: str, percent: float = 99.9, sample: int | None = None, key: str | None = None) -> DataFrame:
    """One row ``absmax``: the interpolated percentile of the components' sizes, over the first ``sample`` vectors by key, or all."""
    some = df.orderBy(key).limit(sample) if sample else df
    return some.select(F.explode(vector).alias("x")).agg(F.percentile(F.abs(F.col("x").cast("double")), F.lit(percent / 100)).alias("absmax"))


def quantize_int8(v: Column, most: Column) -> Column:
    """Components as bytes: ``most`` and more to 127, halves to even."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") * 127 / most))).cast("tinyint"))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def knn(vectors: DataFrame, query: list[float] | DataFrame, key: str, vector: str, k: int = 200, candidates: DataFrame | None = None) -> DataFrame:
    """(key, distance): the exact k nearest by cosine, ties by key. Candidates come before the distances; an empty set gives no rows.

    A batch of vectors is one matrix product, and only the k best of a batch leave it.
    Vectors of another length than the query, or with nulls, have no distance.
    """
    if candidates is not None:
        vectors = vectors.join(candidates.select(key).distinct(), key, "left_semi")
    if isinstance(query, DataFrame):
        first = query.select(query.columns[0]).first()
        query = list(first[0]) if first else []
    q = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.linalg.norm(q)
        for b in batches:
            lists = b.column(1)
            fit = (pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False) == len(q)) & (len(q) > 0)
            some = b.filter(pa.array(fit))
            d, step = np.zeros(some.num_rows), max(1, PIECE // max(1, len(q)))
            for a in range(0, some.num_rows, step):
                x = some.slice(a, step).column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, len(q))
                with np.errstate(divide="ignore", invalid="ignore"):
                    d[a : a + step] = 1 - (x @ q) / (np.linalg.norm(x, axis=1) * size)
            own = np.flatnonzero(np.isfinite(d))
            keys = some.column(0).to_numpy(zero_copy_only=False)
            best = own[np.lexsort((keys[own], np.round(d[own], 9)))][:k]
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(best)), pa.array(d[best])], ["key", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    near = vectors.select(key, vector).mapInArrow(run, f"key {kind}, distance double").withColumnRenamed("key", key)
    return near.orderBy(F.round("distance", 9), key).limit(k)
