"""Exact nearest neighbours inside a table of vectors, without all pairs.

On unit vectors cosine distance is half the square of the straight distance, which keeps the triangle
inequality. Vectors are dealt to the nearest of some pivots and, inside a pivot's part, cut into
shells by their distance from it. A vector first looks into its own shell; what it finds there bounds
how far another shell may be to be opened. Equal vectors are one class and are searched for once.

Neighbouring shells make a block. A vector that opens shells of a block is sent to the block once, and not
once for each of them; vectors of one shell are compared there with all shells that one of them opens.

Worst case: vectors that are all about equally far from each other open every shell, which is all
pairs of classes in blocks of bounded size: as many distances as pairs, and each vector is sent as often as
there are blocks. The number of pivots changes costs and never results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.sources.scratch import keep

#: Pivots at most; vectors of a shell, and shells at most; marks that cut a part.
PIVOTS, SHELL, SHELLS, MARKS = 1024, 2048, 1 << 16, 255
#: Vectors of a block, and about so many that meet it in one task; fewer if they have more than so many components.
BLOCK, COMPONENTS = 1 << 14, 1 << 22
#: What rounding to 9 digits, and the square root near 0, may hide of a distance.
COSINE_SLACK, STRAIGHT_SLACK = 2e-9, 1e-7
BEST = "array<struct<rounded:double,id:long,distance:double>>"


def unit(vectors: pd.Series | np.ndarray) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def straight(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosines))


def best_of(queries: np.ndarray, found: np.ndarray, classes: np.ndarray, ids: list, most: int) -> list[list[dict]]:
    """For each query the ``most`` nearest ids by (rounded distance, id), out of classes that each have a sorted list of ids.

    The best ids come from the best classes by their least id, as each of these gives one at least.
    """
    out = []
    for a in range(0, len(queries), 256):
        d = 1 - queries[a : a + 256] @ found.T
        rounded = np.round(d, 9)
        few = min(most, len(found))
        limit = np.partition(rounded, few - 1, axis=1)[:, few - 1]
        for row, near, top in zip(d, rounded, limit, strict=True):
            own = np.flatnonzero(near <= top)
            own = own[np.lexsort((classes[own], near[own]))][:few]
            rows = sorted((float(near[j]), int(i), float(row[j])) for j in own for i in ids[j][:most])[:most]
            out.append([{"rounded": r, "id": i, "distance": x} for r, i, x in rows])
    return out


@dataclass
class Search:
    """``best``: (class, best); ``requests``: (class, block, n) to which blocks a class is sent, and with how many vectors it is compared there; ``shells``: (shell, n) how many it has."""

    best: DataFrame
    requests: DataFrame
    shells: DataFrame
    pivots: int

    def distances(self) -> int:
        """How many distances are computed, those to pivots included."""
        row = self.shells.agg(F.sum(F.col("n") * F.col("n")).alias("d"), F.sum("n").alias("n")).first()
        return (row["d"] or 0) + (self.requests.agg(F.sum("n")).first()[0] or 0) + 2 * (row["n"] or 0) * self.pivots


def search(classes: DataFrame, most: int, shell: int = SHELL) -> Search:
    """The ``most`` nearest ids of each class, its own included. ``classes``: class, v, ids (sorted; the first ``most`` are enough)."""
    spark, n = classes.sparkSession, classes.count()
    size = max(shell, -(-n // SHELLS))
    chosen = classes.orderBy(F.xxhash64("class"), "class").limit(min(PIVOTS, max(1, math.isqrt(n)))).select("v").collect()
    pivots = unit([r["v"] for r in chosen]) if chosen else np.zeros((0, 1))
    shipped = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for b in batches:
            if len(b):
                d = straight(unit(b["v"]) @ shipped.value.T)
                b["pivot"], b["r"] = d.argmin(1), d.min(1)
                yield b

    dealt = keep(classes.mapInPandas(assign, "class long, v array<float>, ids array<long>, pivot int, r double"), "dealt")
    marks = dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("r", [i / (MARKS + 1) for i in range(1, MARKS + 1)], 2000).alias("m"))
    step = F.greatest(F.lit(1), F.floor((MARKS + 1) * F.lit(size) / F.col("n"))).cast("int")
    marks = marks.select("pivot", F.filter("m", lambda x, i: (i + 1) % step == 0).alias("m"))
    cut = dealt.join(F.broadcast(marks), "pivot").withColumn("part", F.size(F.filter("m", lambda x: x <= F.col("r")))).drop("m")
    parts = keep(cut.groupBy("pivot", "part").agg(F.ceil(F.count("*") / size).alias("subs")), "parts")
    # a part whose vectors are all as far from the pivot can't be cut by that
    subs = cut.join(F.broadcast(parts), ["pivot", "part"]).withColumn("sub", F.pmod(F.xxhash64("class"), F.col("subs")))
    placed = keep(subs.withColumn("shell", F.xxhash64("pivot", "part", "sub")).drop("part", "sub", "subs"), "placed")
    shells = keep(placed.groupBy("shell", "pivot").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")), "shells")
    # neighbouring shells make a block of bounded size
    table = shells.toPandas().sort_values(["pivot", "low", "shell"], ignore_index=True)
    held = max(1, min(BLOCK, COMPONENTS // max(1, pivots.shape[1])))
    table["block"] = (table["n"].cumsum() - table["n"]) // held
    bounds = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in ("shell", "pivot", "low", "high", "n", "block")})
    rows = [(int(r.shell), int(r.block)) for r in table.itertuples()]
    blocks = keep(spark.createDataFrame(rows, "shell long, block long"), "blocks")

    def opened(x: np.ndarray, limit: np.ndarray, own: int, among: np.ndarray) -> np.ndarray:
        """Which of the shells ``among`` (their places in ``bounds``) vectors of the shell ``own`` open."""
        t = {c: v[among] for c, v in bounds.value.items()}
        out = np.zeros((len(x), len(among)), bool)
        for a in range(0, len(x), 256):
            far = straight(x[a : a + 256] @ shipped.value.T)[:, t["pivot"]]
            least = np.maximum(0, np.maximum(far - t["high"], t["low"] - far) - STRAIGHT_SLACK)
            out[a : a + 256] = (least**2 / 2 <= limit[a : a + 256, None] + COSINE_SLACK) & (t["shell"] != own)
        return out

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(pdf["v"])
        best = best_of(x, x, pdf["class"].to_numpy(), pdf["ids"].tolist(), most)
        limit = [b[-1]["distance"] if len(b) == most else math.inf for b in best]
        return pd.DataFrame({"class": pdf["class"], "v": pdf["v"], "shell": pdf["shell"], "best": best, "limit": limit})

    own = keep(placed.groupBy("shell").applyInPandas(inside, f"class long, v array<float>, shell long, best {BEST}, limit double"), "own")

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x, limit, shell = bounds.value, unit(pdf["v"]), pdf["limit"].to_numpy(), int(pdf["shell"].iloc[0])
        out = []
        for block in np.unique(t["block"]):
            among = np.flatnonzero(t["block"] == block)
            wanted = opened(x, limit, shell, among)
            some = wanted.any(1)
            if some.any():
                n = int(t["n"][among[wanted.any(0)]].sum())
                out.append(pdf.loc[some, ["class", "v", "shell", "limit"]].assign(block=block, n=n))
        return pd.concat(out) if out else pdf[["class", "v", "shell", "limit"]].head(0).assign(block=0, n=0)

    asked = keep(own.groupBy("shell").applyInPandas(ask, "class long, v array<float>, shell long, limit double, block long, n long"), "asked")
    # the vectors of a shell go to one part of a block, as they are compared together
    parts = F.broadcast(keep(asked.groupBy("block").agg(F.ceil(F.count("*") / held).alias("parts")), "parts"))
    left = asked.drop("n").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("shell"), F.col("parts"))).drop("parts")
    right = placed.select("class", "v", "ids", "shell").join(F.broadcast(blocks), "shell").join(parts, "block")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"class": [], "best": []})
        among = np.flatnonzero(bounds.value["block"] == x["block"].iloc[0])
        names, vectors, classes, ids, shells = bounds.value["shell"][among], unit(x["v"]), x["class"].to_numpy(), x["ids"].to_numpy(), x["shell"].to_numpy()
        out = []
        for shell, some in q.groupby("shell"):
            y = unit(some["v"])
            own = np.flatnonzero(np.isin(shells, names[opened(y, some["limit"].to_numpy(), shell, among).any(0)]))
            if len(own):
                out.append(pd.DataFrame({"class": some["class"], "best": best_of(y, vectors[own], classes[own], ids[own].tolist(), most)}))
        return pd.concat(out) if out else pd.DataFrame({"class": [], "best": []})

    others = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, f"class long, best {BEST}")
    every = own.select("class", "best").unionByName(others).groupBy("class").agg(F.flatten(F.collect_list("best")).alias("best"))
    return Search(every.select("class", F.slice(F.array_sort("best"), 1, most).alias("best")), asked.select("class", "block", "n"), shells.select("shell", "n"), len(pivots))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): rows with a key whose vectors have a direction; a null inside, a length of 0 or no number has none."""
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<float>").alias("v")).filter("key is not null")
    return rows.withColumn("s", size).filter((F.col("s") > 0) & (F.col("s") < float("inf"))).drop("s")


def classes_of(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """((key, class) of all rows, (class, v, ids)): rows with equal vectors are a class, named by its least key; ids has its ``most`` least keys."""
    first = keep(rows.groupBy("v").agg(F.min("key").alias("class")), "first")
    members = keep(rows.join(first, "v").select("key", "class").distinct(), "members")
    least = members.withColumn("i", F.row_number().over(W.partitionBy("class").orderBy("key"))).filter(F.col("i") <= most)
    ids = least.groupBy("class").agg(F.sort_array(F.collect_list("key")).alias("ids"))
    return members, keep(first.join(ids, "class").select("class", "v", "ids"), "classes")


def nearest_other(vectors: DataFrame, key: str, vector: str, shared: DataFrame | None = None, shell: int = SHELL) -> DataFrame:
    """(key, nn_key, nn_distance): for each vector the nearest other one by cosine that shares nothing with it, exactly; ties by key.

    ``shared``: (key, other) pairs to leave out. Each class keeps as many best ids as the longest list of
    such pairs and two more, so one is always left. Rows without a key or a direction neither ask nor
    answer; all vectors are of one length; keys are distinct. A row with nothing left has no row; empty in, empty out.
    """
    rows = usable(vectors, key, vector)
    skips = None
    most = 2
    if shared is not None:
        skips = keep(shared.select(F.col(key).cast("long").alias("key"), F.col("other").cast("long").alias("other")).groupBy("key").agg(F.collect_set("other").alias("skip")), "skips")
        most += skips.agg(F.max(F.size("skip"))).first()[0] or 0
    members, classes = classes_of(rows, most)
    found = members.join(search(classes, most, shell).best, "class")
    found = found.join(skips, "key", "left") if skips is not None else found.withColumn("skip", F.lit(None).cast("array<long>"))
    left = F.filter("best", lambda b: (b["id"] != F.col("key")) & ~F.coalesce(F.array_contains("skip", b["id"]), F.lit(False)))
    return found.select(F.col("key").alias(key), F.get(left, F.lit(0)).alias("x")).filter("x is not null").select(key, F.col("x.id").alias("nn_key"), F.col("x.distance").alias("nn_distance"))
