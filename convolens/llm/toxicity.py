"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, over a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.examples import id_remainder, labelled_sample
from convolens.llm.shared import given_back, keep

#: Lengths of a word's beginnings, in bytes, and how many places of a feature count apart.
PREFIXES, PLACES = (3, 4, 5, 6), 4
TRIM = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def features_of(word: bytes) -> list[bytes]:
    """A word's terms: itself without punctuation at its ends, and its first bytes."""
    w = word.strip(TRIM)
    return [b"=" + w, *(b"^" + w[:n] for n in PREFIXES if len(w) > n)] if w else []


def terms_of(text: str) -> Counter[bytes]:
    """Terms of a whole text. The second, third and fourth place of a feature are terms of their own, as repeated use tells more than one."""
    counts = Counter(f for w in text.encode("utf-8", "replace").lower().split() for f in features_of(w))
    return Counter({bytes([48 + i]) + f: n - i for f, n in counts.items() for i in range(min(n, PLACES))})


class BlockMaxIndex:
    """Unit TF-IDF vectors of examples, as postings by term in blocks of examples, each with its greatest weight."""

    def __init__(self, terms: list[bytes], at: np.ndarray, term: np.ndarray, w: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray, block: int = 64):
        """``at``, ``term``, ``w``: the example, term and weight of each entry of the vectors; ``ids``, ``y``, ``weight``: of each example."""
        n = len(ids)
        # examples with the same strongest term stand together, so that a block's bounds are tight
        strongest = np.full(n, -1)
        by = np.lexsort((-term, w, at))
        strongest[at[by]] = term[by]
        order = np.lexsort((ids, strongest))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.y, self.weight = ids[order].astype(np.int64), y[order].astype(np.float64), weight[order].astype(np.float64)
        self.block, self.blocks, self.n = block, max(1, -(-n // block)), n
        self.term = {t: i for i, t in enumerate(terms)}
        by = np.lexsort((place[at], term))
        self.doc, self.w, t = place[at][by].astype(np.int32), w[by], term[by]
        self.start = np.zeros((len(terms), self.blocks + 1), np.int32)
        self.top = np.zeros((len(terms), self.blocks))
        begin = np.searchsorted(t, np.arange(len(terms) + 1))
        for i in range(len(terms)):
            a, b = begin[i], begin[i + 1]
            self.start[i] = a + np.searchsorted(self.doc[a:b], np.arange(self.blocks + 1) * block)
            np.maximum.at(self.top[i], self.doc[a:b] // block, self.w[a:b])

    @classmethod
    def of(cls, terms: list[bytes], vectors: list[dict[int, float]], ids: list[int], y: list[int], weight: list[float], block: int = 64) -> BlockMaxIndex:
        """The same from vectors as dictionaries."""
        at = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors]) if vectors else np.zeros(0, np.int64)
        term, w = (np.array([x for v in vectors for x in part(v)], kind) for part, kind in ((dict.keys, np.int64), (dict.values, np.float64)))
        return cls(terms, at, term, w, np.array(ids, np.int64), np.array(y), np.array(weight), block)

    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each example, in the index's order."""
        t = np.repeat(np.arange(len(self.start)), self.start[:, -1] - self.start[:, 0])
        by = np.argsort(self.doc, kind="stable")
        edges = np.searchsorted(self.doc[by], np.arange(self.n + 1))
        return [(t[by[a:b]], self.w[by[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]

    def _scores(self, terms: np.ndarray, q: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines above 0 of the examples in the opened blocks; of a term's postings only theirs are read."""
        start, end = self.start[terms][:, opened], self.start[terms][:, opened + 1]
        size = end - start
        own = size > 0
        first, size = start[own], size[own]
        ends = np.cumsum(size)
        at = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        weight = np.repeat(np.broadcast_to(q[:, None], own.shape)[own], size)
        score = np.bincount(self.doc[at], weight * self.w[at], self.n)
        hit = np.flatnonzero(score > 0)
        return hit, score[hit]

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k examples of greatest cosine above 0, ties by place.

        The ``first`` blocks by bound are opened; then those whose bound reaches the k-th
        best so far. No other block can hold one of the k.
        """
        bound = q @ self.top[terms]
        opened = np.zeros(self.blocks, bool)
        opened[np.argsort(-bound, kind="stable")[:first]] = True
        opened &= bound > 0
        at, score = self._scores(terms, q, np.flatnonzero(opened))
        least = np.partition(score, -k)[-k] - 1e-9 if len(score) >= k else 0.0
        more = (bound > 0) & (bound >= least) & ~opened
        if more.any():
            at2, score2 = self._scores(terms, q, np.flatnonzero(more))
            at, score = np.concatenate([at, at2]), np.concatenate([score, score2])
        best = np.lexsort((at, -np.round(score, 12)))[:k]
        return at[best], score[best]


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve that is nearest to ``y`` over ``x``: neighbours that fall are pooled to their mean."""
    pools: list[list[float]] = []
    for i in np.lexsort((y, x)).tolist():
        pools.append([x[i] * weight[i], y[i] * weight[i], weight[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools).reshape(-1, 3)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


class ToxicityModel:
    """``curve``: votes and the shares of toxic examples that they stand for; ``alone``: the share among examples without a term of the model."""

    def __init__(self, index: BlockMaxIndex, idf: np.ndarray, prior: float, k: int, trust: float):
        self.index, self.idf, self.prior, self.k, self.trust = index, idf, prior, k, trust
        self.curve, self.alone = (np.array([0.0, 1.0]), np.array([0.0, 1.0])), prior
        self.seen: dict[bytes, tuple[bytes, ...]] = {}
        self.features = {t[1:] for t in index.term}
        self.heads = {f[1 : 1 + PREFIXES[0]] for f in self.features}
        self.known: dict[tuple, tuple[float, list[int]]] = {}

    def features_of(self, word: bytes) -> tuple[bytes, ...]:
        """The features of a word that the model knows; all of them begin as the word does."""
        if len(self.seen) > 300_000:
            self.seen.clear()
        head = word.strip(TRIM)[: PREFIXES[0]]
        out = self.seen[word] = tuple(x for x in features_of(word) if x in self.features) if head in self.heads else ()
        return out

    def vector(self, text: str) -> dict[int, float]:
        hits: list[bytes] = []
        get = self.seen.get
        for w in text.encode("utf-8", "replace").lower().split():
            f = get(w)
            if f is None:
                f = self.features_of(w)
            if f:
                hits.extend(f)
        term = self.index.term
        at = {term[k]: n - i for x, n in Counter(hits).items() for i in range(min(n, PLACES)) if (k := bytes([48 + i]) + x) in term}
        return unit({t: (1 + math.log(n)) * self.idf[t] for t, n in at.items()})

    def votes(self, terms: np.ndarray, q: np.ndarray, without: int = -1) -> tuple[float, np.ndarray]:
        """Votes weigh the squared cosine; a prior of weight ``trust`` keeps far neighbours from deciding. ``without``: an example that does not vote."""
        at, cosine = self.index.nearest(terms, q, self.k + (without >= 0))
        own = at != without
        at, cosine = at[own][: self.k], cosine[own][: self.k]
        w = cosine**2 * self.index.weight[at]
        return float((w @ self.index.y[at] + self.trust * self.prior) / (w.sum() + self.trust)), at

    def calibrate(self, others: tuple[float, float]) -> None:
        """Learn what votes stand for from the fitted examples, each judged by the others. ``others``: weight and toxic weight of those without a term."""
        if self.index.n:
            raw = np.array([self.votes(t, q, i)[0] for i, (t, q) in enumerate(self.index.vectors())])
            x, p = rising(raw, self.index.y, self.index.weight)
            # a pool of few examples is less sure than it says
            self.curve = x, np.clip(p, 0.5 / (len(raw) + 1), 1 - 0.5 / (len(raw) + 1))
        total, toxic = others
        self.alone = (toxic + self.prior) / (total + 1) if total else self.prior

    def score(self, text: str) -> tuple[float, list[int]]:
        v = self.vector(text)
        if not v:
            return self.alone, []
        key = tuple(sorted((t, round(x, 9)) for t, x in v.items()))
        if key not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            raw, at = self.votes(np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), np.float64, len(v)))
            self.known[key] = float(np.interp(raw, *self.curve)), self.index.ids[at[:3]].tolist()
        return self.known[key]


def unit(v: dict[int, float]) -> dict[int, float]:
    n = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / n for t, x in v.items()} if n else {}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, max_terms: int = 256, k: int = 25, trust: float = 0.1, max_bytes: int = 1 << 20) -> ToxicityModel:
    """Learn from rows whose crc32(doc_id) modulo 3 is not 1.

    The index has up to ``per_class`` examples of each class and the ``max_terms`` terms
    that tell the classes apart best by chi-square, all bounds that do not grow with the corpus.
    Votes are then calibrated on the examples, each judged by the others. Labels that are null,
    and ids without a text, teach nothing; of several rows with an id one is taken; with no
    usable label every score is 0. Texts of more than ``max_bytes`` are scored but not learned from.
    """
    sample = keep(labelled_sample(docs, labels, "toxic", id_remainder(F.col("doc_id"), 3) != 1, per_class, max_bytes), "examples")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, y, text in zip(b.doc_id, b.y, b.text, strict=True):
                counts = terms_of(text)
                yield pd.DataFrame({"doc_id": i, "y": y, "term": list(counts), "n": list(counts.values())}, columns=["doc_id", "y", "term", "n"])

    counted = keep(sample.select("doc_id", "y", "text").mapInPandas(terms, "doc_id long, y int, term binary, n int"), "terms")
    sizes = {r["y"]: (r["used"], r["rows"]) for r in sample.groupBy("y").agg(F.count("*").alias("used"), F.max("rows_of_class").alias("rows")).collect()}
    (used0, rows0), (used1, rows1) = (sizes.get(y, (0, 0)) for y in (0, 1))
    n, prior = used0 + used1, (rows1 / (rows0 + rows1) if rows0 + rows1 else 0.0)
    a, b = F.col("a"), F.col("b")
    df = counted.groupBy("term").agg(F.sum((F.col("y") == 1).cast("double")).alias("a"), F.sum((F.col("y") == 0).cast("double")).alias("b")).filter(a + b >= 2)
    chi2 = n * F.pow(a * used0 - b * used1, F.lit(2)) / F.greatest((a + b) * (n - a - b) * max(1, used0) * max(1, used1), F.lit(1.0))
    chosen = df.withColumn("chi2", chi2).orderBy(F.desc("chi2"), "term").limit(max_terms)
    picked = [(bytes(r["term"]), r["a"] + r["b"]) for r in chosen.collect()]
    names = [t for t, _ in picked]
    idf = np.array([math.log((1 + n) / (1 + d)) + 1 for _, d in picked])
    numbers = docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(names)], "term binary, t int")
    # at most per_class * 2 examples of max_terms terms, as columns of numbers
    got = counted.join(F.broadcast(numbers), "term").select("doc_id", "t", "n").toArrow()
    doc, t, times = (got[c].to_numpy() for c in ("doc_id", "t", "n"))
    rows = sample.select("doc_id", "y").orderBy("doc_id").toArrow()
    ids, y = rows["doc_id"].to_numpy(), rows["y"].to_numpy()
    share = np.array([rows0 / max(1, used0), rows1 / max(1, used1)])  # classes are drawn unevenly; votes undo that
    weight = (share / max(share.max(), 1e-9))[y]
    known = np.isin(ids, doc)
    at = np.searchsorted(ids[known], doc)
    w = (1 + np.log(times)) * (idf[t] if len(t) else 1.0)
    w = w / np.sqrt(np.bincount(at, w * w, int(known.sum())))[at]
    index = BlockMaxIndex(names, at, t.astype(np.int64), w, ids[known], y[known], weight[known])
    model = ToxicityModel(index, idf, prior, k, trust)
    model.calibrate((float(weight[~known].sum()), float((weight * y)[~known].sum())))
    return model


def score(docs: DataFrame, model: ToxicityModel, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples).

    Every whole text, of any length, is scored by itself: null and empty texts, and those with
    no term of the model, get the share of toxic rows among examples like them. Equal texts
    get equal scores; ids are kept, null or repeated; an empty table gives an empty one.
    """

    @given_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = [model.score(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in out], "evidence": [e for _, e in out]})

    held_out = (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out")
    found = docs.select("doc_id", held_out, F.pandas_udf(run, "score double, evidence array<long>")(F.coalesce("text", F.lit(""))).alias("x"))
    return found.select("doc_id", "held_out", "x.score", (F.col("x.score") >= cut).cast("int").alias("predicted"), "x.evidence")


def drop_toxic(docs: DataFrame, model: ToxicityModel, cut: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose whole text scores ``cut`` or more."""

    @given_back
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([model.score(t)[0] for t in s], dtype="float64")

    return docs.filter(F.pandas_udf(run, "double")(F.coalesce("text", F.lit(""))) < cut)
