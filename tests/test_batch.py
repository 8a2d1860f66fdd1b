"""Retrieval of many questions against one question after the other."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from convolens.operators import batch, lexical, suites, vectors
from convolens.plans.parse import ParsedQuery
from convolens.plans.search import Engine, build_index
from convolens.sources.store import IndexStore


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    talk = ["dinner with the lease", "the lease is signed", "photos of the beach", "beach dinner tonight", "who signed it", "tonight the beach", "nothing else", "the the the lease lease"]
    rows = [(c * 100 + i, c, 1_700_000_000.0 + c * 90_000 + i * 4000, i % 2 == 0, None if i % 2 == 0 else "sam", talk[(c * 3 + i) % len(talk)], False) for c in range(12) for i in range(8)]
    m = spark.createDataFrame(rows, "msg_id long, chat_id long, ts double, is_from_me boolean, handle string, text string, has_attachment boolean").cache()
    root = str(tmp_path_factory.mktemp("index"))
    build_index(spark, m, root)
    return Engine(spark, IndexStore(spark, root), m, now=1_700_900_000.0)


QUESTIONS = ["the lease", "beach dinner", "signed the", "dinner dinner tonight", "zebra", "the zebra", "Beach!"]


def test_same_as_one_by_one(spark, engine):
    """Places with reserved recent windows, for phrases, unknown words, repeated words; blank and null questions find nothing."""
    q = spark.createDataFrame([(i, t) for i, t in enumerate([*QUESTIONS, "", None, "  "])], "qid long, t string")
    places, fused, words = engine.retrieve_many(q, "qid", "t")
    got = {}
    for r in places.collect():
        got.setdefault(r.qid, {})[r.chunk_id] = r.place
    assert set(got) == set(range(len(QUESTIONS)))
    for i, t in enumerate(QUESTIONS):
        assert got[i] == {r.chunk_id: r.place for r in engine.retrieve(ParsedQuery(t, semantic=t)).collect()}
    assert fused.filter("rank = 1").count() == len(QUESTIONS) and {r.qid for r in words.select("qid").distinct().collect()} == {0, 1, 2, 3, 6}


def test_ranks_of_the_source(spark, engine):
    q = spark.createDataFrame([(1, "the lease", 2), (2, "zebra", 3), (3, "beach dinner", None)], "id long, query string, source long")
    _, fused, words = engine.retrieve_many(q, "id", "query")
    out = {r.id: r for r in suites.with_ranks(q, fused, words, "id", "source", "chunk_id").collect()}
    by = {(r.qid, r.chunk_id): r["rank"] for r in fused.collect()}
    assert set(out) == {1, 2, 3} and out[3].source_rank is None
    for i, s in ((1, 2), (2, 3)):
        assert out[i].source_rank == by.get((i, s)) and s not in out[i].top_others
        assert out[i].top_others == [c for _, c in sorted((k, c) for (j, c), k in by.items() if j == i and c != s and k <= 5)]


def test_words_and_phrases(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b c", "b a", None, "", "c b a b", "a", "a b", "a b"] * 3)], "id long, text string")
    index, stats = lexical.postings(docs, "id", "text").cache(), lexical.doc_stats(docs, "id", "text")
    asked = [(0, ["a"]), (1, ["a", "b"]), (2, ["b", "a", "c"]), (3, []), (4, ["q", "a"])]
    words = spark.createDataFrame(asked, "qid long, words array<string>")
    for many, one in ((batch.bm25_many, lexical.bm25), (batch.phrase_many, lexical.phrase_search)):
        got = {(r.qid, r["rank"]): (r.id, round(r.score, 9)) for r in many(index, stats, words, "id", 5).collect()}
        want = {(i, k + 1): (r.id, round(r.score, 9)) for i, w in asked if w for k, r in enumerate(one(index, stats, w, "id", 5).collect())}
        assert got == want
    assert batch.bm25_many(index.limit(0), stats.limit(0), words, "id").count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    """Blocks of two questions; ties, other lengths, nulls, zeros and more neighbours than vectors."""
    monkeypatch.setattr(batch, "BLOCK", 6)
    rows = [(i, [float(i % 4), 1.0, float(i % 3)]) for i in range(30)] + [(40, [1.0, 2.0]), (41, None), (42, [0.0, 0.0, 0.0]), (43, [1.0, None, 1.0])]
    v = spark.createDataFrame(rows, "id long, vec array<float>").repartition(4)
    asked = [("x", [1.0, 1.0, 0.0]), ("y", [0.0, 0.0, 1.0]), ("z", [3.0, 1.0]), ("none", None), ("zero", [0.0, 0.0, 0.0]), ("w", [-1.0, 0.5, 2.0])]
    q = spark.createDataFrame(asked, "qid string, q array<double>")
    for k in (4, 100):
        got = {(r.qid, r["rank"]): (r.id, round(r.distance, 9)) for r in batch.knn_many(v, q, "id", "vec", k).collect()}
        want = {(i, n + 1): (r.id, round(r.distance, 9)) for i, x in asked if x for n, r in enumerate(vectors.knn(v, x, "id", "vec", k).collect())}
        assert got == want
    assert batch.knn_many(v, q.filter("false"), "id", "vec").count() == 0
    assert batch.knn_many(v.filter("false"), q, "id", "vec").agg(F.count("*")).first()[0] == 0


def test_blocks_of_documents(spark, monkeypatch):
    """Many blocks, some of which bound the others, and parts of the questions change nothing; ties go by key, which may be a string."""
    monkeypatch.setattr(batch, "PLACES", 40)
    monkeypatch.setattr(batch, "CLASSES", 2)
    docs = spark.createDataFrame([(f"d{i % 97:03}{i}", " ".join(w for j, w in enumerate("abcde") if (i * 7 + j * j) % (j + 2) < 2) + " a b" * (i % 3)) for i in range(300)], "id string, text string")
    index, stats = lexical.postings(docs, "id", "text").cache(), lexical.doc_stats(docs, "id", "text")
    asked = [(0, ["a", "b"]), (1, ["b", "a"]), (2, ["c", "d"]), (3, ["a", "b"]), (4, ["e", "a", "b"])]
    words = spark.createDataFrame(asked, "qid long, words array<string>")
    for many, one in ((batch.bm25_many, lexical.bm25), (batch.phrase_many, lexical.phrase_search)):
        got = {(r.qid, r["rank"]): (r.id, round(r.score, 9)) for r in many(index, stats, words, "id", 7).collect()}
        assert got == {(i, k + 1): (r.id, round(r.score, 9)) for i, w in asked for k, r in enumerate(one(index, stats, w, "id", 7).collect())}


def test_equal_questions_are_asked_once(spark, monkeypatch):
    """What is written and what leaves a task does not grow with questions times documents."""
    written = {}

    def counted(df, name, f=batch.keep):
        out = f(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(batch, "keep", counted)
    docs = spark.range(400).selectExpr("id", "'a b c' as text")
    index, stats = lexical.postings(docs, "id", "text"), lexical.doc_stats(docs, "id", "text")
    words = spark.range(50).selectExpr("id as qid", "array('a', 'b') as words")
    for many in (batch.bm25_many, batch.phrase_many):
        assert many(index, stats, words, "id", 5).count() == 250
    assert max(written.values()) <= 800
    assert written["words-probed"] == 5 and written["phrase-hits"] == 400


def test_memory_of_many_questions():
    """Distances are made piece by piece, so a task's memory does not follow questions times vectors; the best are those of a plain sort."""
    rng = np.random.default_rng(3)
    x, q = rng.integers(-3, 4, (3000, 4)) + 0.5, rng.integers(-3, 4, (10_000, 4)) + 0.25
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], ["id", "v"])
    tracemalloc.start()
    out = pa.Table.from_batches(batch.nearest(iter([rows]), {4: (list(range(len(q))), q)}, 5)).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    for i in (0, 17, 9999):
        d = np.round(1 - x @ q[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(q[i]), 9)
        assert out[out.qid == i].id.tolist() == np.lexsort((np.arange(3000), d))[:5].tolist()
