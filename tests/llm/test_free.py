"""Language model, toxicity, Jaccard join and the convolutional network."""

import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from convolens.llm import bytecnn, toxicity
from convolens.llm.components import connected_components
from convolens.llm.jaccard import drop_near_duplicates, jaccard_join
from convolens.llm.lm import PIECE, frequent, lm_scores, pack, pieces, unpack
from convolens.llm.toxicity import BlockMaxIndex, unit
from convolens.llm.trie import EliasFano, Level, Trie
from tests.llm import brute

SF = "/root/testdata/sf0.01"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10**9), max_size=300))
def test_elias_fano_round_trip(values):
    import tempfile

    v = np.sort(np.array(values, np.int64))
    with tempfile.TemporaryDirectory() as folder:
        ef = EliasFano(v, 10**9 + 1, folder, "x")
        assert ef.slice(0, len(v)).tolist() == v.tolist() and ef.slice(3, 7).tolist() == v[3:7].tolist()
        places = np.arange(0, len(v), 2)
        assert ef.at(places).tolist() == v[places].tolist()


def test_elias_fano_over_many_runs(tmp_path):
    v = np.cumsum(np.random.default_rng(1).integers(0, 50, 200_001)).astype(np.int64)
    ef = EliasFano(v, int(v[-1]) + 1, str(tmp_path), "x")
    assert (ef.slice(0, len(v)) == v).all() and (ef.slice(65_000, 140_000) == v[65_000:140_000]).all()


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 30)), max_size=120), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 30)), max_size=60), st.sampled_from([1, 5, 1 << 18]))
def test_level_finds_successors_in_the_context_alone(pairs, asked, stretch):
    import tempfile

    pairs, asked = sorted(pairs), sorted(asked)
    with tempfile.TemporaryDirectory() as folder:
        column = lambda x, i: np.array([p[i] for p in x], np.int64)
        level = Level(column(pairs, 0), column(pairs, 1), np.zeros(len(pairs)), 8, 31, folder, "x")
        level.STRETCH = stretch
        assert level.find(column(asked, 0), column(asked, 1)).tolist() == [pairs.index(p) if p in pairs else -1 for p in asked]


def test_trie_levels():
    bigrams = np.array([0, 1, 1]), np.array([2, 0, 3]), np.log10([0.5, 0.25, 1e-6])
    contexts = np.array([1, 1, 2]), np.array([0, 3, 1]), np.log10([0.3, 0.2, 0.1])
    trigrams = np.array([0, 0, 2]), np.array([1, 2, 3]), np.log10([0.7, 0.01, 1e-9])
    trie = Trie(4, bigrams, contexts, trigrams)
    value, seen, context = trie.lookup(np.array([0, 1, 1, 1, 2]), np.array([0, 0, 0, 3, 1]), np.array([1, 2, 3, 1, 3]))
    assert seen.tolist() == [False, True, False, False, True] and context.tolist() == [-1, 0, 0, 1, 2]
    assert np.allclose(value, [0, -2, np.log10(0.3), np.log10(0.2), -9], atol=3e-4)
    assert np.allclose(trie.after.log_p(trie.after.find(np.array([1]), np.array([3]))), -6, atol=3e-4)
    trie.close()


def same_scores(got, rows):
    want = sorted(brute.lm(rows), key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    got = sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    assert len(got) == len(want)
    for r, (doc_id, held, n, known, train, base, score) in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (doc_id, held, n, known, train)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 5e-4 * n


def test_lm_scores(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same_scores(lm_scores(docs).collect(), rows)
    same_scores(lm_scores(docs, shard_bytes=400, block_tokens=150).collect(), rows)  # many shards and blocks, long texts in stretches
    assert lm_scores(empty).count() == 0


def test_lm_scores_with_frequent_pairs(spark):
    """One pair is a twentieth of all tokens and more, one word a third; copies and ties."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        words = [f"w{int(x)}" for x in r.zipf(1.4, 40) % 300]
        for at in r.choice(40, 3, replace=False):
            words[at : at + 1] = ["very", "often"] if at % 2 else ["the"] * 6
        rows.append((i, " ".join(words)))
    rows += [(i + 400, rows[i][1]) for i in range(0, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shard_bytes, block in ((10 << 20, 700_000), (2000, 900)):
        same_scores(lm_scores(df, shard_bytes=shard_bytes, block_tokens=block).collect(), rows)


def test_lm_scores_equal_rows_and_null_ids(all_docs):
    rows = [("" if r.doc_id is None else r.doc_id, r.text) for r in all_docs.collect()]
    got = [r if r.doc_id is not None else r.__class__(**(r.asDict() | {"doc_id": None})) for r in lm_scores(all_docs).collect()]
    assert Counter(r.doc_id for r in got) == Counter(None if d == "" else d for d, _ in rows)
    want = Counter((None if d == "" else d, n, round(base, 5)) for d, _, n, _, _, base, _ in brute.lm(rows))
    assert Counter((r.doc_id, r.n_tokens, round(r.base_score, 5)) for r in got) == want


def test_lm_pieces_are_small(spark):
    """What is shuffled for a token has 9.1 bytes here, and had 10.2 when bytes of unlike size were compressed together."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{int(x)}" for x in r.zipf(1.15, 200) % 1_000_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "crc32(cast(doc_id as string)) % 10 != 0 AS train", "text").repartition(1)
    fr = frequent(df, 16, one_in=4)
    size = pieces(df, 16, fr).selectExpr("sum(octet_length(body)) AS n").first().n
    assert size / (1500 * 201) < 9.6


def test_lm_shuffles_are_gone_when_answers_are_kept(spark, monkeypatch):
    """The pieces are not beside the answers' own shuffle on the disk."""
    from convolens.llm import lm

    name, seen = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", {}
    before, keep = spark.conf.get(name, None), lm.keep

    def noted(df, what, **options):
        seen[what] = spark.conf.get(name, None)
        return keep(df, what, **options)

    monkeypatch.setattr(lm, "keep", noted)
    lm_scores(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect()
    assert seen["answers"] == "true" and spark.conf.get(name, None) == before


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 5000), st.integers(0, 3), st.integers(0, 2**64 - 1))
def test_lm_arrays_round_trip(n, empty, seed):
    r = np.random.default_rng(seed)
    arrays = [r.integers(0, np.iinfo(k).max, 0 if i % 4 == empty else n, k, endpoint=True) for i, k in enumerate(PIECE)]
    for a, b in zip(arrays, unpack(pack(*arrays), PIECE), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_jaccard(docs, empty):
    want = sorted(brute.jaccard([(r.doc_id, r.text) for r in docs.collect()]))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(docs).collect())
    assert got == want and any(x[3] for x in want)
    assert jaccard_join(empty).count() == 0


@pytest.mark.parametrize("group_size,part", [(2, 3), (512, 2048)])
def test_jaccard_cuts_large_groups(spark, group_size, part):
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = base.copy()
        w[i % 3 * 20 + 5] = f"edit{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard_join(df, group_size=group_size, queries_a_part=part).collect())
    assert got == sorted(brute.jaccard(rows))


def test_drop_near_duplicates(all_docs, docs):
    want = sum(x[0] == x[2] for x in brute.jaccard([(r.doc_id, r.text) for r in docs.collect()]))
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == want
    ids = Counter((r.doc_id, r.text) for r in drop_near_duplicates(all_docs).collect())
    assert max(ids.values()) == 1 and (None, None) not in ids


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 50, 70: 50, 50: 50}


def test_block_max_index_is_exact():
    r = np.random.default_rng(3)
    for trial in range(20):
        vec = [unit({int(t): float(r.random() + 0.1) for t in r.choice(40, r.integers(1, 6), replace=False)}) for _ in range(300)]
        index = BlockMaxIndex.of([bytes([t]) for t in range(40)], vec, list(range(300)), [0] * 300, [1.0] * 300, block=8)
        q = unit({int(t): float(r.random() + 0.1) for t in r.choice(40, 4, replace=False)})
        at, cosine = index.nearest(np.array(list(q)), np.array(list(q.values())), 10)
        all_ = sorted(((-round(sum(q.get(t, 0) * w for t, w in vec[i].items()), 9)) for i in range(300)))[:10]
        assert np.allclose(sorted(-cosine), all_, atol=1e-8)


def test_toxicity_scores_against_a_dense_search(docs, labels):
    """Vectors, cosines with all examples, votes, the curve: a score as plain Python has it."""
    import math

    model = toxicity.fit(docs, labels)
    ix, terms = model.index, {i: t for t, i in model.index.term.items()}
    dense = np.zeros((len(terms), ix.n))
    for t in terms:
        a, e = ix.start[t, 0], ix.start[t, -1]
        dense[t, ix.doc[a:e]] = ix.w[a:e]
    assert ix.n > 10 and np.allclose(np.linalg.norm(dense, axis=0), 1)
    for text in [r.text or "" for r in docs.collect()] + ["no known term ###"]:
        counts = toxicity.terms_of(text)
        q = np.array([(1 + math.log(counts[terms[t]])) * model.idf[t] if counts[terms[t]] else 0.0 for t in range(len(terms))])
        got, evidence = model.score(text)
        if not q.any():
            assert got == model.alone and not evidence
            continue
        cosine = q @ dense / np.linalg.norm(q)
        best = sorted(range(ix.n), key=lambda i: (-round(cosine[i], 12), i))[: model.k]
        best = [i for i in best if cosine[i] > 1e-12]
        w = cosine[best] ** 2 * ix.weight[best]
        raw = (w @ ix.y[best] + model.trust * model.prior) / (w.sum() + model.trust)
        assert abs(got - np.interp(raw, *model.curve)) < 1e-6 and 0 <= got <= 1
        assert np.allclose(sorted(cosine[[ix.ids.tolist().index(i) for i in evidence]]), sorted(cosine[best[:3]]), atol=1e-9)


def test_votes_are_calibrated_by_a_rising_curve():
    x, p = toxicity.rising(np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0, 1.0, 2.0]))
    assert np.allclose(p, [0, 0.5, 1]) and np.allclose(x, [0.1, 0.25, 2.6 / 3])


@pytest.mark.parametrize("operator", ["toxicity", "quality", "jaccard"])
def test_large_ids_beside_null_ones(spark, operator, labels, docs):
    big = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1]
    df = spark.createDataFrame([(i, f"some words that stand in text number {k} and no other") for k, i in enumerate(big)], "doc_id long, text string").coalesce(1)
    out = {"toxicity": lambda: toxicity.score(df, toxicity.fit(docs, labels)), "quality": lambda: bytecnn.score(df, bytecnn.fit(docs, labels, epochs=1)), "jaccard": lambda: jaccard_join(df)}[operator]()
    assert {r.doc_id for r in out.collect()} == set(big)


def test_cnn_long_texts_in_runs(monkeypatch):
    """A text in runs of chunks as at once, and pools as plain loops have them."""
    m, r = bytecnn.ByteCNN(filters=3), np.random.default_rng(4)
    for size in (bytecnn.HOP * bytecnn.BLOCK * 2 + 1, 1500, 4097):
        text = r.integers(1, 256, size, dtype=np.uint8).tobytes()
        whole = m.pooled([text])
        monkeypatch.setattr(bytecnn, "RUN", 2)
        assert np.allclose(m.pooled([text]), whole, atol=1e-5)
        monkeypatch.undo()
        blocks = (size + bytecnn.WIDTH) // bytecnn.BLOCK + 1
        x = text + bytes(blocks * bytecnn.BLOCK + bytecnn.WIDTH)
        z = lambda p: sum(m.t[k, x[p + k]] for k in range(bytecnn.WIDTH)) + m.b  # noqa: E731, B023
        spans = [(s, min(s + bytecnn.CHUNK, blocks)) for s in range(0, max(1, blocks - 1), bytecnn.HOP)]
        chunks = np.array([np.maximum(np.max([z(p) for p in range(a * bytecnn.BLOCK, e * bytecnn.BLOCK, bytecnn.STEP)], 0), 0) for a, e in spans])
        assert np.allclose(whole[0], np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)]), atol=1e-4)


def test_toxicity(docs, labels, empty, spark):
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(empty, labels)
    assert all(r.score == 0 for r in toxicity.score(docs, none).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_toxicity_and_quality_on_held_out_rows(spark):
    d, l = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for module, label in ((toxicity, "toxic"), (bytecnn, "quality")):
        rows = module.score(d, module.fit(d, l)).join(l, "doc_id").filter("held_out").select("predicted", label).collect()
        right = sum(r[0] == r[1] for r in rows) / len(rows)
        assert right > 0.9, (label, right)
        kept = [r for r in rows if r[1] == (0 if label == "toxic" else 1)]
        assert sum(r[0] == r[1] for r in kept) / len(kept) > 0.97


def test_cnn_covers_whole_texts():
    texts = [b"", b"a", b"x" * 63, b"y" * 64, b"z" * 1000]
    x, first = bytecnn.lay_out(texts)
    spans, n = bytecnn.chunks_of(first)
    covered = {b for s, e in spans.tolist() for b in range(s, e)}
    assert covered == set(range(int(first[-1]))) and n.sum() == len(spans) and (spans[:, 1] > spans[:, 0]).all()
    m = bytecnn.ByteCNN()
    p = m.probability(texts)
    assert p.shape == (5,) and np.allclose(p[4], m.probability([texts[4]])[0])
    late = b"z" * 900 + b"QUITE OTHER BYTES" + b"z" * 83
    assert m.pooled([late])[0].tolist() != m.pooled([texts[4]])[0].tolist()


def test_cnn_learns():
    r = np.random.default_rng(0)
    good = [" ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(60)).encode() for _ in range(120)]
    bad = [b"####||||" * 40 if i % 2 else b"zq " * 100 for i in range(120)]
    m = bytecnn.ByteCNN()
    y = np.array([1] * 100 + [0] * 100, np.float32)
    m.train(good[:100] + bad[:100], y, epochs=6)
    assert (m.probability(good[100:]) > 0.5).all() and (m.probability(bad[100:]) < 0.5).all()


def test_cnn_empty_tables(docs, labels, empty):
    model = bytecnn.fit(empty, labels)
    assert bytecnn.score(empty, model).count() == 0
    assert all(0 <= r.score <= 1 for r in bytecnn.score(docs, model).collect())
