"""Both arms from texts against the same arms by an index."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.operators import arms, batch, lexical
from convolens.plans import registry

ODD = ["Où est l’été d'Émile?", "ΟΔΟΣ ΟΔΟΣ'Α ΣΣ σς", "İstanbul ISTANBUL straße STRASSE", "été ete ́ x", "東京タワー は 高い ٣٤ ½ x²", "a_b-c\td\ne\x00f", "ǅ ﬁ Ⅻ ſ K ᾈ 𝔘 𐐀 😀a​b", "", None, "   ", "—«»", "x"]


def rows_of(df):
    return {(r.qid, r["rank"]): (r.id, round(r.score, 9)) for r in df.collect()}


@pytest.mark.parametrize(("places", "step"), [(1 << 21, 1 << 20), (40, 3)])
def test_same_as_by_index(spark, monkeypatch, places, step):
    """One block and many, with equal scores, unknown words, one word, no words, null keys and texts, and keys that are strings."""
    for name, n in (("PLACES", places), ("PIECE", places * 4), ("LOOKED_UP", step)):
        monkeypatch.setattr(arms, name, n)
    docs = spark.createDataFrame(
        [(f"d{i % 97:03}{i}", " ".join(w for j, w in enumerate("abcde") if (i * 7 + j * j) % (j + 2) < 2) + " a b" * (i % 3)) for i in range(300)]
        + [(f"o{i}", t) for i, t in enumerate(ODD * 2)] + [(None, "a b c d e")], "id string, text string").repartition(3)
    asked = [(0, ["a", "b"]), (1, ["b", "a"]), (2, ["c", "d"]), (3, ["a", "b"]), (4, ["e", "a", "b"]), (5, []), (6, ["a"]), (7, ["q", "a"]), (8, ["ou", "est", "l"]), (9, ["l", "ete"]), (10, ["東京タワー", "は"]), (11, ["a", "b", "a"][:2] + ["c", "d", "e"])]
    words = spark.createDataFrame(asked, "qid long, words array<string>")
    index, stats = lexical.postings(docs, "id", "text").cache(), lexical.doc_stats(docs, "id", "text")
    a, b = arms.both(docs, words, "id", "text", 7)
    assert rows_of(a) == rows_of(batch.bm25_many(index, stats, words, "id", 7))
    assert rows_of(b) == rows_of(batch.phrase_many(index, stats, words, "id", 7))
    assert all(x.count() == 0 for x in arms.both(docs.limit(0), words, "id", "text"))
    assert all(x.count() == 0 for x in arms.both(docs, words.filter("qid = 5"), "id", "text"))


def test_words_of_texts(spark):
    """Texts are cut as ``index_terms`` cuts them, beside each other too; the reading of characters is its own."""
    table = arms.letters(spark)
    some = [c for c in range(128, 0x30000, 37) if not 0xD800 <= c < 0xE000 and chr(c) != arms.SIGMA]
    texts = [t or "" for t in ODD if arms.SIGMA not in (t or "")] + [f"a{chr(c)}B {chr(c)}" for c in some]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.index_terms(F.col("t")).alias("w")).orderBy("i").collect()
    wanted = {t: i for i, t in enumerate({t.encode() for r in rows for t in r.w})}
    ids, first = arms.cut(pa.array(["skipped", *texts]).slice(1), pa.array([*wanted], pa.binary()), table)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [[wanted[t.encode()] for t in r.w] for r in rows]
    assert all(v.translate(table) == v for v in table.values())


def test_too_many_words_to_send(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "c b a") for i in range(9)], "id long, text string")
    words = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "qid long, words array<string>")
    want = [rows_of(x) for x in arms.both(docs, words, "id", "text", 3)]
    monkeypatch.setattr(batch, "SHIPPED", 1)
    assert [rows_of(x) for x in arms.both(docs, words, "id", "text", 3)] == want


def test_phrases_in_one_pass():
    """Phrases that begin alike, end in each other or would cross the end of a text."""
    trie = arms.Trie([(0, [0, 1]), (1, [0, 1, 2]), (2, [1, 2]), (3, [2, 0, 1, 2])], 3)
    ids, end = np.array([0, 1, 2, 0, 1, -1, 2, 0, 1, 2]), np.array([4] * 4 + [10] * 6)
    start = np.flatnonzero(ids >= 0)
    classes, place = trie.places(ids, end[start], start)
    assert sorted(zip(classes.tolist(), place.tolist(), strict=True)) == [(0, 0), (0, 7), (1, 0), (1, 7), (2, 1), (2, 8), (3, 6)]


def test_compare_arms_makes_no_index(spark, monkeypatch):
    """Texts are cut once for both arms; no postings of all words are made."""

    def refused(*_):
        raise AssertionError("an index was made")

    monkeypatch.setattr(lexical, "postings", refused)
    assert registry.QUERIES["compare_arms"](spark, "/root/testdata/sf0.001").count() > 0
