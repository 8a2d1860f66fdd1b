"""Retrieval for many questions at once: the same results as one question after the other.

Questions are a table. Words: questions of the same words are asked once. Documents are dealt to blocks by
their keys; in a block each question starts from the shortest list of its terms, the other lists are looked up,
and only the best documents leave the task. Vectors: blocks of questions meet all vectors
as matrix products, and a task keeps the best of each question only. Ranks are counted by question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.operators import lexical, ranking
from convolens.sources.scratch import keep

#: Numbers in the matrix of a block of questions, at most.
BLOCK = 1 << 21
#: Places of a block of documents, about; classes of questions in a task; terms that are broadcast, at most; what rounding to 9 digits may hide of a score.
PLACES, CLASSES, SHIPPED, SLACK = 1 << 21, 1 << 16, 1 << 20, 2e-9


def asked(questions: DataFrame, qid: str, text: str, stem: bool = False) -> DataFrame:
    """(qid, words): the terms of each question as ``lexical.parse_terms`` gives them, in order; none for a null text."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([lexical.parse_terms(t or "", stem=stem) for t in part], dtype=object)

    return questions.select(F.col(qid).alias("qid"), F.pandas_udf(run, "array<string>")(F.col(text)).alias("words"))


def top(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """Add ``rank`` and keep the first ``k`` of each question; Spark drops what can't be among them before rows move."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= k)


def corpus_of(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))


def dealt(index: DataFrame, stats: DataFrame, words: DataFrame, key: str, columns: list[str], most: int, ordered: bool):
    """(members (qid, class), asked (class, i, tid, idf, n), postings (tid, key, columns), corpus, blocks).

    Questions of the same words are one class, in any order of the words unless ``ordered``; only classes whose
    terms all occur are asked. ``most`` is about how many places of a block of documents go to one task.
    """
    own = words.filter(F.size("words") > 0).select("qid", F.col("words") if ordered else F.array_sort("words").alias("words"))
    classes = keep(own.select("words").distinct().withColumn("class", F.monotonically_increasing_id()), "question-classes")
    members = own.join(classes, "words").select("qid", "class")
    terms = classes.select("class", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
    wanted = keep(terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()), "question-terms")
    some = F.broadcast(wanted) if wanted.count() <= SHIPPED else wanted
    # the semi join goes below the grouping that makes the index
    hit = index.filter(F.col(key).isNotNull()).join(some.select("term"), "term", "left_semi").join(some, "term")
    hit = keep(hit.select("tid", key, *columns), "question-postings")
    df = keep(hit.groupBy("tid").agg(F.count("*").alias("df"), F.sum(F.size("positions") if "positions" in columns else F.lit(1)).alias("places")), "question-df")
    corpus = F.broadcast(keep(corpus_of(stats), "question-corpus"))
    held = terms.join(wanted, "term").join(df, "tid").crossJoin(corpus)
    idf = lexical.idf(F.col("docs"), F.col("df"))
    whole = held.groupBy("class", "n").agg(F.collect_list(F.struct("i", "tid", idf.alias("idf"))).alias("t")).filter(F.size("t") == F.col("n"))
    asked = keep(whole.select("class", "n", F.inline("t")), "question-asked")
    places = df.agg(F.sum("places")).first()[0] or 0
    return members, asked, hit, corpus, max(1, -(-places // most))


def met(asked: DataFrame, hit: DataFrame, key: str, blocks: int, chosen: range, body, schema: str) -> DataFrame:
    """``body(postings, asked)``, as Arrow tables, of each of the ``chosen`` blocks of documents and each part of the questions."""
    parts = max(1, -(-asked.select("class").distinct().count() // CLASSES))
    few = F.lit([*chosen] if len(chosen) < blocks else None)
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = hit.withColumn("block", block)
    rows = rows.filter(F.array_contains(few, F.col("block"))) if len(chosen) < blocks else rows
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else rows.withColumn("part", F.lit(0))
    numbers = hit.sparkSession.createDataFrame([(b,) for b in chosen], "block int")
    questions = asked.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int")).crossJoin(F.broadcast(numbers))
    return rows.groupBy("block", "part").cogroup(questions.groupBy("block", "part")).applyInArrow(body, schema)


def lists_of(tids: np.ndarray, asked: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(class, rows of ``asked``, first, end) of the classes all of whose terms are in ``tids``, which is sorted; the shortest list first."""
    order = np.lexsort((asked["i"].to_numpy(), asked["class"].to_numpy()))
    classes, ask = asked["class"].to_numpy()[order], asked["tid"].to_numpy()[order]
    first, end = np.searchsorted(tids, ask, "left"), np.searchsorted(tids, ask, "right")
    cuts = np.flatnonzero(np.diff(classes)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(classes)], strict=True):
        n = end[a:b] - first[a:b]
        if b > a and n.min() > 0:
            by = a + np.argsort(n, kind="stable")
            yield classes[a], order[by], first[by], end[by]


def bm25_many(index: DataFrame, stats: DataFrame, words: DataFrame, key: str, k: int = 200) -> DataFrame:
    """(qid, key, score, rank): for each question what ``lexical.bm25`` gives. ``words``: (qid, words), words distinct; a question without words has no rows.

    Some blocks of documents are asked first: the score at place ``k`` among them is what a document of another block must reach.
    """
    members, asked, hit, corpus, blocks = dealt(index, stats, words, key, ["tf", "dl"], PLACES, False)
    weight = lexical._weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    weighed = hit.crossJoin(corpus).select("tid", key, weight.alias("weight"))
    kind = index.schema[key].dataType.simpleString()
    schema = f"class long, {key} {kind}, score double"

    def best(rows: pa.Table, questions: pa.Table) -> pa.Table:
        classes, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        keys, doc = numbered(rows[key])
        order = np.lexsort((doc, rows["tid"].to_numpy()))
        tids, doc, w = rows["tid"].to_numpy()[order], doc[order], rows["weight"].to_numpy()[order]
        idf, least = questions["idf"].to_numpy(), questions["least"].to_numpy()
        for c, at, first, end in lists_of(tids, questions):
            found, score = doc[first[0] : end[0]], idf[at[0]] * w[first[0] : end[0]]
            for i, a, b in zip(at[1:], first[1:], end[1:], strict=True):
                place = a + np.minimum(np.searchsorted(doc[a:b], found), b - a - 1)
                own = doc[place] == found
                found, score = found[own], score[own] + idf[i] * w[place[own]]
            rounded = np.round(score, 9)
            own = np.flatnonzero(rounded >= least[at[0]] - SLACK)
            if len(own) > k:
                own = own[rounded[own] >= np.partition(rounded[own], len(own) - k)[len(own) - k] - SLACK]
                own = own[np.lexsort((found[own], -rounded[own]))][:k]
            classes.append(np.full(len(own), c))
            docs.append(found[own])
            scores.append(score[own])
        return pa.table({"class": pa.array(np.concatenate(classes), pa.int64()), key: keys.take(pa.array(np.concatenate(docs))), "score": np.concatenate(scores)})

    rounded = F.round("score", 9)
    probe = math.isqrt(blocks) if blocks > 8 else blocks
    free = asked.withColumn("least", F.lit(float("-inf")))
    found = keep(met(free, weighed, key, blocks, range(probe), best, schema), "words-probed")
    if probe < blocks:
        by = W.partitionBy("class").orderBy(F.desc(rounded))
        least = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") == k).select("class", rounded.alias("least"))
        bound = asked.join(least, "class", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        found = found.unionByName(met(bound, weighed, key, blocks, range(probe, blocks), best, schema))
    best_of = keep(top(found.withColumnRenamed("class", "qid"), k, F.desc(rounded), key).withColumnRenamed("qid", "class"), "words-best")
    return members.join(best_of, "class").select("qid", key, "score", "rank")


def phrase_many(index: DataFrame, stats: DataFrame, words: DataFrame, key: str, k: int = 20) -> DataFrame:
    """(qid, key, score, rank): documents where a question's two words or more stand one after the other, as ``lexical.phrase_search``."""
    members, asked, hit, corpus, blocks = dealt(index, stats, words.filter(F.size("words") > 1), key, ["dl", "positions"], PLACES, True)
    kind = index.schema[key].dataType.simpleString()

    def placed(rows: pa.Table, questions: pa.Table) -> pa.Table:
        classes, docs, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        keys, doc = numbered(rows[key])
        dl = np.zeros(len(keys), np.int64)
        dl[doc] = rows["dl"].to_numpy()
        lists = rows["positions"].combine_chunks()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        tids, doc = np.repeat(rows["tid"].to_numpy(), n), np.repeat(doc, n)
        # one number for a place of the block; a phrase that would begin before its text meets no other text
        longest = int(questions["n"].to_numpy().max(initial=0))
        step = int(at.max(initial=0)) + 2 * longest + 2
        code = doc * step + at + longest
        order = np.lexsort((code, tids))
        tids, code = tids[order], code[order]
        place = questions["i"].to_numpy()
        for c, of, first, end in lists_of(tids, questions):
            start = code[first[0] : end[0]] - place[of[0]]
            for i, a, b in zip(of[1:], first[1:], end[1:], strict=True):
                want = start + place[i]
                start = start[code[a + np.minimum(np.searchsorted(code[a:b], want), b - a - 1)] == want]
            own, tf = np.unique(start // step, return_counts=True)
            classes.append(np.full(len(own), c))
            docs.append(own)
            counts.append(tf)
        doc = np.concatenate(docs)
        return pa.table({"class": pa.array(np.concatenate(classes), pa.int64()), key: keys.take(pa.array(doc)), "dl": dl[doc], "tf": np.concatenate(counts)})

    hits = keep(met(asked, hit, key, blocks, range(blocks), placed, f"class long, {key} {kind}, dl long, tf long"), "phrase-hits")
    df = hits.groupBy("class").agg(F.count("*").alias("df"))
    weight = lexical.idf(F.col("docs"), F.col("df")) * lexical._weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    scored = hits.join(df, "class").crossJoin(corpus).select(F.col("class").alias("qid"), key, weight.alias("score"))
    best = keep(top(scored, k, F.desc(F.round("score", 9)), key).withColumnRenamed("qid", "class"), "phrase-best")
    return members.join(best, "class").select("qid", key, "score", "rank")


def numbered(keys: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(distinct keys in order, the number of each row's key among them)."""
    coded = keys.combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), number[coded.indices.to_numpy(zero_copy_only=False)]


def knn_many(vectors: DataFrame, questions: DataFrame, key: str, vector: str, k: int = 200) -> DataFrame:
    """(qid, key, distance, rank): for each question (qid, q) the exact k nearest by cosine, ties by key, as ``vectors.knn``.

    The vectors are read once for each block of questions; a block has a bounded number of components.
    Vectors of another length than a question's, or with nulls, are no answers to it.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    id_kind = questions.schema["qid"].dataType.simpleString()
    usable = questions.filter(F.col("q").isNotNull() & (F.size("q") > 0) & ~F.exists("q", lambda x: x.isNull()))
    longest = usable.agg(F.max(F.size("q"))).first()[0]
    out = spark.createDataFrame([], f"qid {id_kind}, {key} {kind}, distance double")
    if not longest:
        return top(out, k, "distance")
    for rows in batched(usable.select("qid", "q").toLocalIterator(), max(1, BLOCK // longest), strict=False):
        by_length: dict[int, tuple[list, list]] = {}
        for r in rows:
            ids, qs = by_length.setdefault(len(r["q"]), ([], []))
            ids.append(r["qid"])
            qs.append(r["q"])
        shipped = spark.sparkContext.broadcast({n: (ids, np.asarray(qs, np.float64)) for n, (ids, qs) in by_length.items()})
        found = vectors.select(key, vector).mapInArrow(lambda batches, b=shipped: nearest(batches, b.value, k), f"qid {id_kind}, {key} {kind}, distance double")
        out = out.unionByName(keep(top(found, k, F.round("distance", 9), key).drop("rank"), "nearest"))
    return top(out, k, F.round("distance", 9), key)


def nearest(batches: Iterator[pa.RecordBatch], questions: dict, k: int) -> Iterator[pa.RecordBatch]:
    """A task's k best for each question; between batches only these are held."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {n: (np.zeros((len(ids), 0)), np.zeros((len(ids), 0), object)) for n, (ids, _) in questions.items()}
    name = ["qid", "key", "distance"]
    for batch in batches:
        name[1] = batch.schema.names[0]
        lengths = pc.fill_null(pc.list_value_length(batch.column(1)), -1).to_numpy(zero_copy_only=False)
        for n, (_, q) in questions.items():
            some = batch.filter(pa.array(lengths == n))
            size = np.linalg.norm(q, axis=1)
            # a piece of the distances, and what it is merged with, has a bounded number of components too
            step = max(16, min(4096, BLOCK // max(1, len(q))))
            for a in range(0, some.num_rows, step):
                part = some.slice(a, step)
                x = part.column(1).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
                own = part.column(0).to_numpy(zero_copy_only=False)
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = 1 - (q @ x.T) / np.outer(size, np.linalg.norm(x, axis=1))
                d[~np.isfinite(d)] = np.inf
                near, known = best[n]
                width = min(k, near.shape[1] + len(own))
                if width == near.shape[1]:
                    # full: only questions to which a vector of the piece is as near as their worst one are merged
                    rows, grown = np.flatnonzero(d.min(1) <= near[:, -1] + SLACK), (near, known)
                else:
                    rows, grown = range(len(q)), (np.empty((len(q), width)), np.empty((len(q), width), own.dtype))
                for i in rows:
                    dd, kk = np.concatenate([near[i], d[i]]), np.concatenate([known[i], own])
                    order = np.lexsort((kk, np.round(dd, 9)))[:width]
                    grown[0][i], grown[1][i] = dd[order], kk[order]
                best[n] = grown
    for n, (ids, _) in questions.items():
        d, keys = best[n]
        i, j = np.nonzero(np.isfinite(d))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i]), pa.array(keys[i, j].tolist()), pa.array(d[i, j])], name)


def fuse_many(arms: list[DataFrame], key: str, k: int = ranking.RRF_K, most: int = ranking.FUSED) -> DataFrame:
    """(qid, key, score, rank): ``ranking.rrf`` by question, of arms (qid, key, rank)."""
    rows = arms[0].select("qid", key, "rank", F.lit(0).alias("arm"))
    for i, a in enumerate(arms[1:], 1):
        rows = rows.unionByName(a.select("qid", key, "rank", F.lit(i).alias("arm")))
    fused = rows.groupBy("qid", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("arm", "rank")).alias("seen"))
    return top(fused, most, F.desc(F.round("score", 12)), "seen", key).drop("seen")


def reserve_recent_many(fused: DataFrame, matched: DataFrame, key: str, most: int = ranking.FUSED, slots: int = ranking.RECENT_SLOTS) -> DataFrame:
    """(qid, key, place): ``ranking.reserve_recent`` by question; ``fused``: (qid, key, rank), ``matched``: (qid, key, ts)."""
    first = fused.filter(F.col("rank") <= most - slots).select("qid", key, F.lit(0).alias("part"), F.col("rank").cast("double").alias("o"))
    fresh = top(matched.join(first.select("qid", key), ["qid", key], "left_anti"), slots, F.desc("ts"), key).select("qid", key, F.lit(1).alias("part"), (-F.col("ts")).alias("o"))
    rest = fused.filter(F.col("rank") > most - slots).select("qid", key, F.lit(2).alias("part"), F.col("rank").cast("double").alias("o"))
    best = first.unionByName(fresh).unionByName(rest).groupBy("qid", key).agg(F.min(F.struct("part", "o")).alias("x"))
    return top(best, most, "x", key).select("qid", key, F.col("rank").alias("place"))
