"""Nearest neighbours through pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.operators import pivots


def brute(rows, shared=()):
    skip = set(shared)
    good = [(k, np.asarray(v, np.float32).astype(np.float64)) for k, v in rows if k is not None and v is not None and None not in v and any(v)]
    out = {}
    for k, v in good:
        d = [(round(1 - v @ w / (np.linalg.norm(v) * np.linalg.norm(w)), 9), j) for j, w in good if j != k and (k, j) not in skip]
        if d:
            out[k] = min(d)
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<float>").repartition(3)


def clustered(n, dim, clusters, seed, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    return [(i, (centres[i % clusters] + spread * r.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


def found(df):
    return {r.id: (round(r.nn_distance, 9), r.nn_key) for r in df.collect()}


@pytest.mark.parametrize("shell", [4, 50, 5000])
def test_equals_all_pairs(spark, shell):
    """Clusters, a large class of equal vectors, multiples, zeros, nulls, and pairs that are left out."""
    rows = clustered(160, 8, 6, 1)
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300 + i, [2 * x for x in rows[5][1]]) for i in range(3)]
    rows += [(400, [0.0] * 8), (401, None), (402, [1.0] * 7 + [None]), (None, rows[1][1]), (403, [-x for x in rows[0][1]])]
    shared = [(i, j) for i in range(0, 160, 3) for j in (i + 1, i + 6)] + [(3, 200), (3, 201), (200, 3), (200, 201), (200, 202)]
    pairs = spark.createDataFrame(shared, "id long, other long")
    assert found(pivots.nearest_other(vectors(spark, rows), "id", "vec", pairs, shell)) == brute(rows, shared)


def test_no_direction_in_common_and_few_rows(spark):
    """All as far from each other: ties by key; one row, no row."""
    rows = [(i, np.eye(12)[i].tolist()) for i in range(12)]
    assert found(pivots.nearest_other(vectors(spark, rows), "id", "vec", shell=3)) == brute(rows)
    assert found(pivots.nearest_other(vectors(spark, rows[:1]), "id", "vec")) == {}
    assert found(pivots.nearest_other(vectors(spark, []), "id", "vec")) == {}


def test_fewer_distances_on_clusters(spark):
    n = 6000
    rows = vectors(spark, clustered(n, 16, 60, 2))
    _, classes = pivots.classes_of(pivots.usable(rows, "id", "vec"), 2)
    done = pivots.search(classes, 2, 64)
    done.best.agg(F.count("*")).first()
    assert done.distances() < n * n / 10


def test_a_vector_is_sent_once_to_a_block(spark, monkeypatch):
    """Vectors without clusters open nearly all shells; what is sent grows with the blocks and not with the shells."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=12).astype(np.float32).tolist()) for i in range(900)]
    df = vectors(spark, rows)
    _, classes = pivots.classes_of(pivots.usable(df, "id", "vec"), 2)
    monkeypatch.setattr(pivots, "BLOCK", 300, raising=False)
    done = pivots.search(classes, 2, 16)
    n, shells = done.requests.agg(F.count("*")).first()[0], done.shells.count()
    assert shells > 40 and n <= 900 * 4
    assert found(pivots.nearest_other(df, "id", "vec", shell=16)) == brute(rows)
