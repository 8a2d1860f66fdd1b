"""An inverted index with places, BM25 and verbatim phrases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.functions.names import porter_stem, stem_udf

K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(docs: DataFrame, key: str, text: str, stem: bool = False) -> DataFrame:
    """term, key, tf, dl (places of the whole text), positions (from 0). With ``stem`` the terms are stems.

    Stems are found word by word in the order of the texts, so no term, however common, is gathered
    in one task, and a batch for Python has as many words and not as many texts; the one shuffle is by (term, key).
    """
    held = docs.select(key, T.index_terms(F.coalesce(text, F.lit(""))).alias("ws")).withColumn("dl", F.size("ws"))
    rows = held.select(key, "dl", F.posexplode("ws").alias("pos", "term"))
    rows = rows.withColumn("term", stem_udf("term")) if stem else rows
    grouped = rows.groupBy("term", key).agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.select("term", key, "tf", "dl", "positions")


def doc_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.size(T.index_terms(F.coalesce(text, F.lit("")))).alias("dl"))


def term_stats(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy("term").agg(F.count(key).alias("docs"), F.sum("tf").alias("places"))


def parse_terms(query: str, stem: bool = False) -> list[str]:
    """Word terms of a query, in order, each once; driver side, as queries are short."""
    return list(dict.fromkeys(porter_stem(w) if stem else w for w in T.plain_terms(query)))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(FLOOR))


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str], key: str, k: int | None = 200, candidates: DataFrame | None = None) -> DataFrame:
    """(key, score): documents that have all of the terms, best first, ties by key.

    Only the postings of the terms are read; candidates restrict them before scoring,
    at any size, while the term weights are those of the whole corpus. No terms, no rows.
    """
    hit = index.filter(F.col("term").isin(*terms)).select("term", key, "tf", *(["dl"] if "dl" in index.columns else []))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    corpus = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    if candidates is not None:
        hit = hit.join(candidates.select(key).distinct(), key, "left_semi")
    weights = df.crossJoin(F.broadcast(corpus)).select("term", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    hit = hit if "dl" in hit.columns else hit.join(stats, key)
    scored = hit.join(F.broadcast(weights), "term").groupBy(key).agg(F.sum(F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"), F.count("*").alias("found"))
    out = scored.filter(F.col("found") == len(terms)).select(key, "score")
    return out.orderBy(F.desc(F.round("score", 9)), key).limit(k) if k else out


def phrase_places(index: DataFrame, phrase: list[str], key: str) -> DataFrame:
    """(key, tf): documents where the words stand one after the other, and how often."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(t, i) for i, t in enumerate(phrase)], "term string, i int")
    hit = index.filter(F.col("term").isin(*phrase)).join(F.broadcast(asked), "term").select(key, "i", F.transform("positions", lambda p: p - F.col("i")).alias("starts"))
    lists = hit.groupBy(key).agg(F.collect_list("starts").alias("s")).filter(F.size("s") == len(phrase))
    common = F.aggregate(F.slice("s", 2, 1_000_000), F.col("s")[0], F.array_intersect)
    return lists.select(key, F.size(common).alias("tf")).filter("tf > 0")


def phrase_search(index: DataFrame, stats: DataFrame, phrase: list[str], key: str, k: int = 20, candidates: DataFrame | None = None) -> DataFrame:
    """(key, score): phrase matches of two words or more, the phrase scored as one term."""
    if len(phrase) < 2:
        return index.select(key, F.lit(0.0).alias("score")).limit(0)
    hit = phrase_places(index, phrase, key)
    df = hit.agg(F.count("*").alias("df"))
    corpus = stats.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    if candidates is not None:
        hit = hit.join(candidates.select(key).distinct(), key, "left_semi")
    scored = hit.join(stats, key).crossJoin(F.broadcast(corpus.crossJoin(df)))
    return scored.select(key, (idf(F.col("n"), F.col("df")) * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score")).orderBy(F.desc(F.round("score", 9)), key).limit(k)


def matched(index: DataFrame, terms: list[str], key: str, candidates: DataFrame | None = None) -> DataFrame:
    """(key, dl, hits): the documents that have one of the terms, with struct(term, tf, positions) of each that they have.

    The one read of an index that all arms of a search share: a filter on literal terms
    reaches the file, whose rows are in the order of terms.
    """
    hit = index.filter(F.col("term").isin(*terms))
    if candidates is not None:
        hit = hit.join(candidates.select(key).distinct(), key, "left_semi")
    return hit.groupBy(key).agg(F.first("dl").alias("dl"), F.collect_list(F.struct("term", "tf", "positions")).alias("hits"))


def bm25_of(words: list[str], docs: dict[str, int], n: int, avgdl: float) -> Column:
    """BM25 of a row of ``matched``, null without all of the words. ``docs``: how many documents have a word."""
    own = F.filter("hits", lambda h: h["term"].isin(*words))
    weight = F.create_map(*[F.lit(x) for w in words for x in (w, max(math.log((n - docs.get(w, 0) + 0.5) / (docs.get(w, 0) + 0.5)), FLOOR))])
    score = F.aggregate(own, F.lit(0.0), lambda a, h: a + weight[h["term"]] * _weight(h["tf"], F.col("dl"), F.lit(avgdl)))
    return F.when(F.size(own) == len(words), score)


def _starts(word: str, place: int) -> Column:
    """Where a phrase would begin by the places of its word number ``place``."""
    own = F.filter("hits", lambda h: h["term"] == word)
    return F.flatten(F.transform(own, lambda h: F.transform(h["positions"], lambda p: p - place)))


def phrase_count(phrase: list[str]) -> Column:
    """How often the words stand one after the other in a row of ``matched``; null if never."""
    common = _starts(phrase[0], 0)
    for i, word in enumerate(phrase[1:], 1):
        common = F.array_intersect(common, _starts(word, i))
    return F.when(F.size(common) > 0, F.size(common))


def document_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df): in how many texts a term is, without places."""
    terms = docs.select(key, F.explode(F.array_distinct(T.index_terms(F.coalesce(text, F.lit(""))))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def top_idf(docs: DataFrame, df: DataFrame, n: Column, key: str, text: str, top: int = 5) -> DataFrame:
    """(key, idf_mean): mean of the greatest ln(n / df) among a text's distinct terms that ``df`` (term, df) knows; 0 without any."""
    terms = docs.select(key, F.explode(F.array_distinct(T.index_terms(F.coalesce(text, F.lit(""))))).alias("term"))
    known = terms.join(df, "term").groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.log(n / F.col("df"))), False), 1, top).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return docs.select(key).join(known, key, "left").select(key, F.coalesce(mean, F.lit(0.0)).alias("idf_mean"))


def mean_top_idf(docs: DataFrame, index: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """``top_idf`` over the texts themselves, by their postings."""
    n = docs.agg(F.countDistinct(key)).first()[0]
    df = index.groupBy("term").agg(F.countDistinct(key).alias("df"))
    return top_idf(docs, df, F.lit(n), key, text, top)
