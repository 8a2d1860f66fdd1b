"""Collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.llm import collocations as c
from tests.llm.brute import LOW


def brute(rows, least, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(w[i : i + k] for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {q for p, a in held.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if (q := p[i : i + m]) and 100 * a >= 100 * own[q]}
        scored = []
        for p, a in held.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows():
    r = random.Random(9)
    made = [" ".join(r.choices(["a", "b", "c", "D", "é", "É"], k=r.randint(1, 60))) for _ in range(80)]
    made += [None, "", " \t ", "...!?", "a\x0bb\x0cc\rd", "x\x1cy z\x00w", "New York, new york; NEW\tYORK! new  york", "to be or not to be " * 200, *["we hold these truths to be self evident"] * 7, "a" * 30000, "b a " * 9000]
    return [(i, t, ("en", "fr", None, "und")[i % 4], "clash", "clash") for i, t in enumerate(made)] + [(3, made[3], "en", "x", "y")] * 5


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, lang string, phrase string, n string").repartition(3).cache()


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (20, 5)])
def test_against_brute_force(docs, least, top):
    got = c.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute([(t, g) for _, t, g, *_ in rows()], least, top=top)


def test_small_shards_and_few_bits(docs, monkeypatch):
    """Many automata, one forgetful dictionary and full bitmaps change nothing."""
    for k, v in {"SHARD_WORDS": 50, "READ_WORDS": 100, "HELD_PAIRS": 300, "HELD_WORDS": 20, "HELD_PHRASES": 30, "BITS": (6, 7), "SLICE_BITS": (1, 2)}.items():
        monkeypatch.setattr(c, k, v)
    assert sorted(map(tuple, c.collocations(docs, least=4).collect())) == brute([(t, g) for _, t, g, *_ in rows()], 4)


def test_automaton_counts_every_string():
    r = random.Random(1)
    for _ in range(60):
        runs = [tuple(r.choices(range(1, 4), k=r.randint(1, 12))) for _ in range(r.randint(1, 6))]
        a, want = c.Automaton(), Counter()
        for i, run in enumerate(runs):
            a.add(run, i + 1)
            for k in range(1, 6):
                for j in range(len(run) - k + 1):
                    want[run[j : j + k]] += i + 1
        got = {tuple(s): n for strings, times in a.strings(1, 5) for s, n in zip(strings.tolist(), times.tolist(), strict=True)}
        assert got == dict(want)
        assert len(a.length) <= 2 * sum(map(len, runs)) + 1


def test_products_beyond_64_bits(spark):
    """Counts of billions, as the sums would have them: the score is exact."""
    n, a, x, y = 4_000_000_000_007, 3_000_000_001, 5_000_000_011, 7_000_000_003
    exact = lambda v: f"cast({v} as decimal(19,0))"
    assert spark.sql(f"select (cast(1000 as decimal(4,0)) * {exact(a)} * {exact(n)}) div ({exact(x)} * {exact(y)}) s").first().s == 1000 * a * n // (x * y)


def test_bitmap(spark):
    keys = [0, 1, 63, 64, 2**40 + 5, -1]
    bits = c.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"), "key", len(keys))
    assert c.has(bits, np.array(keys, np.int64).view(np.uint64)).all() and not c.has(bits, np.array([2, 6, 1000], np.uint64)).any()


def test_empty(spark, docs):
    assert c.collocations(docs.limit(0)).collect() == []


def test_texts_are_cut_once(spark, docs):
    """Words are cut and numbered in one pass, and not again for pairs, triples and phrases."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        read.add(1)
        return text

    assert c.collocations(docs.withColumn("text", noted("text")), least=20).count()
    assert read.value == len(rows())


def test_block_of_texts():
    r = random.Random(4)
    for n in [0, 1, 2, *range(3, 60)]:
        texts = ["".join(r.choices(["A", "Zz", "é", "É", "\x00", "\x1c", "\x85", "\xa0", " ", "\t", "  ", *".,;:!?\n\x0b\x0c\r"], k=r.randint(0, 40))) for _ in range(n)]
        lang, words, times, numbers = c.block_of("en", [t.encode() for t in texts])
        words, numbers = words.to_pylist(), np.frombuffer(numbers, "<i4").tolist()
        pieces = [w for t in texts for p in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOW)) if (w := [x for x in re.split(r"[\x20\x09]+", p) if x])]
        got, piece = [], []
        for i in [*numbers, 0]:
            if i:
                piece.append(words[i - 1])
            elif piece:
                got, piece = [*got, piece], []
        assert (lang, got) == ("en", pieces)
        assert dict(zip(words, times.tolist(), strict=True)) == Counter(w for p in pieces for w in p)


def test_distinct_runs():
    seq = np.array([1, 2, 3, 0, 1, 2, 0, 1, 2, 3, 2, 3], np.int32)
    got = {tuple(np.frombuffer(k, "<i4").tolist()): n for k, n in c.distinct_runs(seq, np.array([0, 4, 7, 10]), np.array([3, 2, 3, 2]))}
    assert got == {(1, 2, 3): 2, (1, 2): 1, (2, 3): 1}
    assert list(c.distinct_runs(seq, np.zeros(0, np.int64), np.zeros(0, np.int64))) == []
