"""Quality from a byte-level convolutional network, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.examples import id_remainder, labelled_sample

#: Bytes that a filter sees, step of a filter, bytes of a block; a chunk is 4 blocks, and starts every 3.
WIDTH, STEP, BLOCK, CHUNK, HOP = 8, 2, 64, 4, 3
#: Chunks of a long text that are evaluated at once.
RUN = 8192


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, each text from the start of a block and followed by zeros; the first block of each text, and one past the last."""
    blocks = np.array([(len(t) + WIDTH) // BLOCK + 1 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)])
    x = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for t, at in zip(texts, first.tolist(), strict=False):
        x[at * BLOCK : at * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return x, first


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end block of each chunk, and how many chunks each text has: they overlap by a block and cover all of it."""
    blocks = np.diff(first)
    n = np.maximum(1, -(-(blocks - (CHUNK - HOP)) // HOP))
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(first[:-1], n) + HOP * within
    return np.stack([start, np.minimum(start + CHUNK, np.repeat(first[1:], n))], 1), n


class ByteCNN:
    """Filters over WIDTH bytes, rectified and max-pooled by chunk; mean, greatest and least of the chunks give one probability."""

    def __init__(self, filters: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        self.t = r.normal(0, 0.3, (WIDTH, 256, filters)).astype(np.float32)
        self.t[:, 0] = 0  # what stands after a text
        self.b = np.zeros(filters, np.float32)
        self.v = r.normal(0, 0.05, 3 * filters).astype(np.float32)
        self.c, self.mean, self.spread, self.shift = np.float32(0), np.zeros(3 * filters, np.float32), np.ones(3 * filters, np.float32), 0.0
        self.pairs: list[np.ndarray] | None = None

    def conv(self, x: np.ndarray) -> np.ndarray:
        """Filter outputs at every STEP bytes, in blocks: (blocks, places, filters)."""
        if self.pairs is None:  # tables for two bytes at a time
            self.pairs = [(self.t[k][:, None] + self.t[k + 1][None]).reshape(65536, -1) for k in range(0, WIDTH, 2)]
        two = x[:-1:STEP].astype(np.uint16) * 256 + x[1::STEP]
        n = (len(x) - WIDTH) // STEP
        z = self.pairs[0][two[:n]]
        for k in range(1, WIDTH // 2):
            z += self.pairs[k][two[k : n + k]]
        return z.reshape(-1, BLOCK // STEP, z.shape[1])

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > RUN * HOP * BLOCK:
            return self.pooled_in_runs(texts[0])
        x, first = lay_out(texts)
        top = self.conv(x).max(1) + self.b
        spans, n = chunks_of(first)
        return self.document(np.maximum(by_chunk(top, spans), 0), n)

    def pooled_in_runs(self, text: bytes) -> np.ndarray:
        """The same of one long text, ``RUN`` chunks at a time, so that memory does not grow with the text."""
        blocks = (len(text) + WIDTH) // BLOCK + 1
        spans, n = chunks_of(np.array([0, blocks]))
        total, most, least = 0.0, -np.inf, np.inf
        for a in range(0, len(spans), RUN):
            own = spans[a : a + RUN]
            start, end = int(own[0, 0]), int(own[-1, 1])
            x = np.zeros((end - start) * BLOCK + WIDTH, np.uint8)
            part = np.frombuffer(text, np.uint8, min(len(x), len(text) - start * BLOCK), start * BLOCK) if start * BLOCK < len(text) else x[:0]
            x[: len(part)] = part
            h = np.maximum(by_chunk(self.conv(x).max(1) + self.b, own - start), 0)
            total, most, least = total + h.sum(0, dtype=np.float64), np.maximum(most, h.max(0)), np.minimum(least, h.min(0))
        return np.concatenate([total / n[0], most, least])[None].astype(np.float32)

    @staticmethod
    def document(h: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = np.cumsum(n) - n
        return np.concatenate([np.add.reduceat(h, at) / n[:, None], np.maximum.reduceat(h, at), np.minimum.reduceat(h, at)], 1)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        z = ((self.pooled(texts) - self.mean) / self.spread) @ self.v + self.c + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the log loss; gradients reach the filters through the places that won the pools."""
        r = np.random.default_rng(seed)
        f = self.t.shape[2]
        first = np.concatenate([self.pooled(texts[i : i + 256]) for i in range(0, len(texts), 256)])
        self.mean, self.spread = first.mean(0), first.std(0) + 0.05
        params = [self.t, self.b, self.v, self.c.reshape(1)]
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                x, starts = lay_out([texts[i] for i in own])
                self.pairs = None
                z = self.conv(x)
                place = z.argmax(1)
                top = np.take_along_axis(z, place[:, None], 1)[:, 0] + self.b
                spans, n = chunks_of(starts)
                pre = by_chunk(top, spans)
                h, at, doc = np.maximum(pre, 0), np.cumsum(n) - n, np.repeat(np.arange(len(own)), n)
                d = self.document(h, n)
                u = (d - self.mean) / self.spread
                p = 1 / (1 + np.exp(-np.clip(u @ params[2] + params[3][0], -30, 30)))
                g = ((p - y[own]) / len(own)).astype(np.float32)
                gd = g[:, None] * params[2][None] / self.spread
                gh = (gd[:, :f] / n[:, None])[doc]
                for lo, best in ((f, d[:, f : 2 * f]), (2 * f, d[:, 2 * f :])):
                    won = h == best[doc]
                    gh += won * (gd[:, lo : lo + f] / np.maximum(1, np.add.reduceat(won.astype(np.float32), at)))[doc]
                gh *= pre > 0
                # the block of each chunk that holds its maximum, then the place in it
                block = np.stack([np.minimum(spans[:, 0] + k, spans[:, 1] - 1) for k in range(CHUNK)], 1)
                which = np.take_along_axis(block[:, :, None], top[block].argmax(1)[:, None], 1)[:, 0]
                cols = np.broadcast_to(np.arange(f), which.shape)
                byte = which * BLOCK + place[which, cols] * STEP
                gt = np.stack([np.bincount((x[byte + k].astype(np.int64) * f + cols).ravel(), gh.ravel(), 256 * f).reshape(256, f) for k in range(WIDTH)]).astype(np.float32)
                gt[:, 0] = 0
                step += 1
                for i, grad in enumerate((gt + 1e-5 * self.t, gh.sum(0), u.T @ g + 1e-4 * params[2], g.sum(keepdims=True))):
                    m[i] += 0.1 * (grad - m[i])
                    s[i] += 0.001 * (grad * grad - s[i])
                    params[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
        self.c = params[3][0]
        self.pairs = None


def by_chunk(top: np.ndarray, spans: np.ndarray) -> np.ndarray:
    ends = np.append(top, np.full((1, top.shape[1]), -np.inf, top.dtype), 0)
    return np.maximum.reduceat(ends, spans.ravel())[::2]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1000, max_bytes: int = 1 << 15, epochs: int = 12) -> ByteCNN:
    """Learn from rows whose crc32(doc_id) modulo 5 is not 0: up to ``per_class`` of each class, of ``max_bytes`` at most."""
    rows = sorted(labelled_sample(docs, labels, "quality", id_remainder(F.col("doc_id"), 5) != 0, per_class, max_bytes).collect(), key=lambda r: r["doc_id"])
    model, y = ByteCNN(), np.array([r["y"] for r in rows], np.float32)
    total = {r["y"]: r["rows_of_class"] for r in rows}
    if len(total) == 2:
        model.train([r["text"].encode("utf-8", "replace") for r in rows], y, epochs)
        model.shift = float(np.log(total[1] / total[0]) - np.log(y.sum() / (len(y) - y.sum())))  # classes are drawn unevenly
    return model


def score(docs: DataFrame, model: ByteCNN, cut: float = 0.3, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, held_out, score, predicted. Chunks cover every whole text; a null or empty text is one chunk of zeros. Equal texts get equal scores."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = [t.encode("utf-8", "replace") for t in b]
            out, a = [], 0
            while a < len(texts):
                e, size = a, 0
                while e < len(texts) and (e == a or size + len(texts[e]) <= batch_bytes):
                    size += len(texts[e])
                    e += 1
                out.append(model.probability(texts[a:e]))
                a = e
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    held_out = (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    found = docs.select("doc_id", held_out, F.pandas_udf(run, "double")(F.coalesce("text", F.lit(""))).alias("score"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
