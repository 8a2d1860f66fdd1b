"""Words and phrases of many questions straight from texts: what ``batch.bm25_many`` and ``batch.phrase_many`` give, without an index.

Texts are read once and cut into words by table look-ups on their bytes; distinct words of a piece are compared
with the asked ones, and phrases are followed from word to word. A block of texts is one row, which has its
asked words and phrases packed. Blocks are asked where they are, all questions together, so no posting is
shuffled: only counts of terms and the best documents of each question leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.functions import text as T
from convolens.operators import batch, lexical
from convolens.sources.scratch import keep

#: Bytes of text that are cut at once, about; rows of (term, document) in a block; documents that are looked up at once; bits of a phrase sieve.
PIECE, PLACES, LOOKED_UP, SIEVE = 1 << 20, 1 << 21, 1 << 20, 22
#: A-Z lowered, and which bytes are of words: letters, digits, and what is not ASCII, which is told apart word by word.
LOWERED = bytes(range(256)).lower()
OF_WORDS = bytes(c >= 128 or chr(c).isalnum() for c in range(256))
#: Its lower form depends on what stands beside it.
SIGMA = "Σ"
WORDS, PHRASES = 0, 1


class Letters(dict):
    """For ``str.translate``: what a character of a word becomes; any other ends a word, and a new line stays."""

    def __missing__(self, c: int) -> str:
        return " "


def letters(spark: SparkSession) -> Letters:
    """What ``T.index_terms`` makes of each character, by asking it."""
    points = spark.range(128, 0x110000).filter("id < 55296 or id > 57343")
    c = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    terms = points.select("id", F.array_join(T.index_terms(F.concat(F.lit("x"), c, F.lit("y"))), " ").alias("t"))
    # "x y" is a character that ends a word
    rows = terms.filter("t <> 'x y'").select("id", F.expr("substring(t, 2, length(t) - 2)").alias("t")).toArrow()
    own = dict(zip(rows["id"].to_pylist(), rows["t"].to_pylist(), strict=True))
    return Letters(own | {c: chr(c) for c in range(128) if chr(c).isalnum() or c == 10})


def ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for n[0] numbers, then those from first[1], and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def spans(low: bytes, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the words of texts that lie one after the other, where each text begins among them and the end). ``ends``: 0, and where texts end."""
    if not low:
        return pa.array([], pa.binary()), np.zeros(len(ends), np.int64)
    word = np.frombuffer(low.translate(OF_WORDS), np.bool_)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    # a text's first byte is beside the last one of the text before
    edges = ends[(ends > 0) & (ends < len(low))]
    begins[edges] = word[edges]
    stops[edges - 1] = word[edges - 1]
    start = np.flatnonzero(begins)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(np.flatnonzero(stops) + 1 - start, out=offsets[1:])
    spelt = np.frombuffer(low, np.uint8)[word]
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(spelt)]), np.searchsorted(start, ends)


def cut(texts: pa.Array, wanted: pa.Array, table: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(the number of each word in ``wanted`` or -1, where each text begins among them and the end)."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = texts.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().translate(LOWERED) if ends[-1] > ends[0] else b""
    found, of_text = spans(low, ends - ends[0])
    numbers = numbered(found, wanted)
    if low.isascii():
        return numbers, of_text
    offsets, spelt = np.frombuffer(found.buffers()[1], np.int32), np.frombuffer(found.buffers()[2], np.uint8)
    high = np.flatnonzero(np.bitwise_or.reduceat(spelt, offsets[:-1]) >= 128)
    # distinct words that are not ASCII, as lines; such a word can be none, one or more
    coded = found.take(pa.array(high)).dictionary_encode()
    lines = b"".join(w + b"\n" for w in coded.dictionary.to_pylist()).decode(errors="replace").translate(table).encode()
    terms, first = spans(lines, np.append(0, np.flatnonzero(np.frombuffer(lines, np.uint8) == 10) + 1))
    begin, n = np.arange(len(numbers)), np.ones(len(numbers), np.int64)
    at = coded.indices.to_numpy()
    begin[high], n[high] = len(numbers) + first[at], np.diff(first)[at]
    return np.append(numbers, numbered(terms, wanted))[ragged(begin, n)], np.append(0, np.cumsum(n))[of_text]


def numbered(words: pa.Array, wanted: pa.Array) -> np.ndarray:
    return pc.index_in(words, wanted).fill_null(-1).to_numpy().astype(np.int64)


class Trie:
    """Phrases as numbers of words, followed by all places of texts at once."""

    def __init__(self, phrases: list[tuple[int, list[int]]], n_terms: int) -> None:
        self.n_terms, self.levels = n_terms, []
        live = [(0, c, p) for c, p in phrases]
        depth = 0
        while live:
            code = np.array([s * n_terms + p[depth] for s, _, p in live], np.int64)
            codes, state = np.unique(code, return_inverse=True)
            done = np.full(len(codes), -1, np.int64)
            for s, (_, c, p) in zip(state, live, strict=True):
                if len(p) == depth + 1:
                    done[s] = c
            sieve = np.zeros(1 << SIEVE, np.bool_)
            sieve[self.slot(codes)] = True
            self.levels.append((codes, done, sieve))
            live = [(int(s), c, p) for s, (_, c, p) in zip(state, live, strict=True) if len(p) > depth + 1]
            depth += 1

    @staticmethod
    def slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE)

    def places(self, ids: np.ndarray, end: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, place) of each phrase that begins at one of the places ``start`` of wanted words; ``end``: where each one's text ends."""
        classes, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        state = np.zeros(len(start), np.int64)
        for depth, (codes, done, sieve) in enumerate(self.levels):
            inside = start + depth < end
            start, end, state = start[inside], end[inside], state[inside]
            code = ids[start + depth]
            own = np.flatnonzero(code >= 0)
            code = state[own] * self.n_terms + code[own]
            maybe = sieve[self.slot(code)]
            own, code = own[maybe], code[maybe]
            place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            same = codes[place] == code
            start, end, state = start[own[same]], end[own[same]], place[same]
            c = done[state]
            classes.append(c[c >= 0])
            found.append(start[c >= 0])
        return np.concatenate(classes), np.concatenate(found)


def counted(number: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, doc, how often) of the distinct pairs, in order."""
    pairs, n = np.unique(number * docs + doc, return_counts=True)
    return pairs // docs, pairs % docs, n


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text."""
    for rows in batches:
        ends = np.cumsum(pc.binary_length(rows.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < rows.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield rows.slice(a, b - a)
            a = b


def packed(keys: list[pa.Array], dl: list[np.ndarray], words: list[tuple], phrases: list[tuple], rows: int, places: int, schema: pa.Schema) -> pa.RecordBatch:
    """One row of a block's pieces. Documents are numbered in the order of their keys."""
    own = pa.concat_arrays(keys)
    order = pc.array_sort_indices(own).to_numpy()
    at = np.empty(len(own), np.int64)
    at[order] = np.arange(len(own))
    base = np.append(0, np.cumsum([len(k) for k in keys]))
    held = []
    for parts in (words, phrases):
        number, n = (np.concatenate([p[i] for p in parts]) for i in (0, 2))
        doc = at[np.concatenate([p[1] + b for p, b in zip(parts, base, strict=False)])]
        by = np.lexsort((doc, number))
        each, times = np.unique(number, return_counts=True)
        held += [pa.array([each.astype(np.int32)], pa.list_(pa.int32())), pa.array([times.astype(np.int32)], pa.list_(pa.int32()))]
        held += [pa.array([x[by].astype(np.int32).tobytes()], pa.binary()) for x in (doc, n)]
    listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own.take(pa.array(order)))
    lengths = pa.array([np.concatenate(dl)[order].astype(np.int32).tobytes()], pa.binary())
    columns = [pa.array([rows]), pa.array([places]), listed, lengths, *held]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)


COLUMNS = "terms array<int>, times array<int>, docs binary, tf binary, phrases array<int>, phrase_times array<int>, phrase_docs binary, phrase_tf binary"


def blocks_of(docs: DataFrame, key: str, text: str, shipped) -> DataFrame:
    """(block, n, places, keys, dl, and the asked words and phrases as numbers with counts of documents, documents and counts in them) of about ``PLACES`` rows."""
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(text, F.lit(""))
    body = F.when(F.contains(body, F.lit(SIGMA)), F.array_join(T.index_terms(body), " ")).otherwise(body)

    step, most = PIECE, PLACES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, table, trie = shipped.value
        keys, dl, words, phrases, rows, places, size, schema = [], [], [], [], 0, 0, 0, None
        for piece in pieces(batches, step):
            own = piece.column(0)
            if schema is None:
                i32, binary = pa.list_(pa.int32()), pa.binary()
                schema = pa.schema([("n", pa.int64()), ("places", pa.int64()), ("keys", pa.list_(own.type)), ("dl", binary)] + [(c.split()[0], i32 if "array" in c else binary) for c in COLUMNS.split(", ")])
            ids, first = cut(piece.column(1), wanted, table)
            rows, places = rows + len(own), places + len(ids)
            length = np.diff(first)
            doc = np.repeat(np.arange(len(own)), length)
            there = np.flatnonzero(ids >= 0)
            if own.null_count:
                there = there[pc.is_valid(own).to_numpy(zero_copy_only=False)[doc[there]]]
            of = doc[there]
            words.append(counted(ids[there], of, len(own)))
            c, place = trie.places(ids, first[of + 1], there)
            phrases.append(counted(c, doc[place], len(own)))
            keys.append(own)
            dl.append(length)
            size += len(words[-1][0]) + len(phrases[-1][0])
            if size >= most:
                yield packed(keys, dl, words, phrases, rows, places, schema)
                keys, dl, words, phrases, rows, places, size = [], [], [], [], 0, 0, 0
        if keys:
            yield packed(keys, dl, words, phrases, rows, places, schema)

    rows = docs.select(key, body.alias("text")).mapInArrow(read, f"n long, places long, keys array<{kind}>, dl binary, {COLUMNS}")
    return rows.withColumn("block", F.monotonically_increasing_id())


def best_of(classes: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first ``k`` of their class, by score and document."""
    order = np.lexsort((doc, -np.round(score, 9), classes))
    c = classes[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    place = np.arange(len(c)) - np.repeat(first, np.diff(first, append=len(c)))
    return order[place < k]


def answers(row: dict, asked: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, phrase_idf: np.ndarray, avgdl: float, least: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, document, score): the best documents of a block for each class that can reach ``least``.

    ``asked``: for each number of words, the classes that have so many and their terms. A class starts from its shortest list; what can't reach
    ``least`` with the greatest weights of the other words is not looked up.
    """
    dl = np.frombuffer(row["dl"], np.int32)
    weigh = lambda tf, doc: tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * dl[doc] / avgdl))
    out = []
    terms, times = np.asarray(row["terms"], np.int64), np.asarray(row["times"], np.int64)
    if len(terms):
        doc = np.frombuffer(row["docs"], np.int32).astype(np.int64)
        w = weigh(np.frombuffer(row["tf"], np.int32), doc)
        n, first, most = np.zeros(len(idf), np.int64), np.zeros(len(idf), np.int64), np.zeros(len(idf))
        n[terms], first[terms] = times, np.cumsum(times) - times
        most[terms] = idf[terms] * np.maximum.reduceat(w, first[terms])
        code = np.repeat(terms, times) * len(dl) + doc
        for classes, own in asked:
            reach = (n[own] > 0).all(1) & (most[own].sum(1) >= least[classes] - batch.SLACK)
            classes, own = classes[reach], own[reach]
            if not len(own):
                continue
            own = np.take_along_axis(own, np.argsort(n[own], axis=1, kind="stable"), 1)
            # the greatest that the words after each one can add
            rest = np.cumsum(most[own][:, ::-1], axis=1)[:, ::-1] - most[own]
            ends = np.cumsum(n[own[:, 0]])
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step, "right")))
                length = n[own[a:b, 0]]
                of, place = np.repeat(np.arange(a, b), length), ragged(first[own[a:b, 0]], length)
                d, score = doc[place], idf[own[of, 0]] * w[place]
                need = least[classes] - batch.SLACK
                for i in range(own.shape[1]):
                    if i:
                        want = own[of, i] * len(dl) + d
                        place = np.minimum(np.searchsorted(code, want), len(code) - 1)
                        there = np.flatnonzero(code[place] == want)
                        of, d, score, place = of[there], d[there], score[there], place[there]
                        score = score + idf[own[of, i]] * w[place]
                    may = np.flatnonzero(score + rest[of, i] >= need[of])
                    of, d, score = of[may], d[may], score[may]
                best = best_of(of, d, score, k)
                out.append((classes[of[best]], d[best], score[best]))
                a = b
    number = np.repeat(np.asarray(row["phrases"], np.int64), np.asarray(row["phrase_times"], np.int64))
    doc = np.frombuffer(row["phrase_docs"], np.int32).astype(np.int64)
    score = phrase_idf[number] * weigh(np.frombuffer(row["phrase_tf"], np.int32), doc)
    may = np.flatnonzero(score >= least[number] - batch.SLACK)
    best = may[best_of(number[may], doc[may], score[may], k)]
    out.append((number[best], doc[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def both(docs: DataFrame, words: DataFrame, key: str, text: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """``batch.bm25_many`` and ``batch.phrase_many`` of the same questions (qid, words), words distinct, over the texts of ``docs``, whose ``key`` is unique.

    The questions' words are sent to all tasks; if they are too many for that, both arms are asked by an index.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    own = words.filter(F.size("words") > 0)
    arms = {WORDS: own.select("qid", F.array_sort("words").alias("words")), PHRASES: own.filter(F.size("words") > 1).select("qid", "words")}
    each = reduce(DataFrame.unionByName, [x.select(F.lit(arm).alias("arm"), "words").distinct() for arm, x in arms.items()])
    classes = keep(each.withColumn("class", F.monotonically_increasing_id()), "arm-classes")
    terms = classes.select(F.explode("words").alias("term")).distinct()
    if max(classes.count(), terms.count()) > batch.SHIPPED:
        index, stats = lexical.postings(docs, key, text), lexical.doc_stats(docs, key, text)
        return batch.bm25_many(index, stats, words, key, k), batch.phrase_many(index, stats, words, key, k)

    rows = classes.toArrow()
    arm, ids, lists = (rows[c].to_pylist() for c in ("arm", "class", "words"))
    wanted = {t.encode(): i for i, t in enumerate(dict.fromkeys(t for w in lists for t in w))}
    lists = [[wanted[t.encode()] for t in w] for w in lists]
    asked = []
    for size in sorted({len(w) for w in lists}):
        of = [c for c, w in enumerate(lists) if arm[c] == WORDS and len(w) == size]
        asked.append((np.array(of, np.int64), np.array([lists[c] for c in of], np.int64).reshape(-1, size)))
    trie = Trie([(c, w) for c, w in enumerate(lists) if arm[c] == PHRASES], len(wanted))
    blocks = keep(blocks_of(docs, key, text, spark.sparkContext.broadcast((pa.array([*wanted], pa.binary()), letters(spark), trie))), "arm-blocks")

    def total(number: str, times: str, size: int) -> np.ndarray:
        """In how many documents each is."""
        at = F.explode(F.arrays_zip(F.col(number).alias("i"), F.col(times).alias("n"))).alias("x")
        got = blocks.select(at).groupBy("x.i").agg(F.sum("x.n").alias("n")).toArrow()
        out = np.zeros(size)
        out[got["i"].to_numpy()] = got["n"].to_numpy()
        return out

    n, places = blocks.agg(F.sum("n"), F.sum("places")).first()
    n, avgdl = n or 0, (places or 0) / (n or 1)
    rarity = lambda df: np.maximum(np.log((n - df + 0.5) / (df + 0.5)), lexical.FLOOR)
    idf, phrase_idf = rarity(total("terms", "times", len(wanted))), rarity(total("phrases", "phrase_times", len(lists)))

    def asking(some: DataFrame, least: np.ndarray) -> DataFrame:
        sent, step = spark.sparkContext.broadcast((asked, idf, phrase_idf, least, np.array(ids, np.int64))), LOOKED_UP

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, idf, phrase_idf, least, ids = sent.value
            for rows in batches:
                for i in range(rows.num_rows):
                    at = rows.schema.get_field_index
                    row = {c: rows.column(at(c))[i].values.to_numpy() if pa.types.is_list(rows.schema.field(c).type) else rows.column(at(c))[i].as_buffer() for c in rows.schema.names if c not in ("keys", "block")}
                    number, doc, score = answers(row, asked, idf, phrase_idf, avgdl, least, k, step)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[number]), rows.column(at("keys"))[i].values.take(pa.array(doc)), pa.array(score)], ["class", key, "score"])

        return some.drop("n", "places", "block").mapInArrow(run, f"class long, {key} {kind}, score double")

    # some blocks are asked first: the score at place k among them is what a document of another must reach
    numbers = sorted(r.block for r in blocks.select("block").collect())
    probe = numbers[:: max(1, math.isqrt(len(numbers)))] if len(numbers) > 8 else numbers
    rounded = F.round("score", 9)
    least = np.full(len(ids), -np.inf)
    found = keep(asking(blocks.filter(F.col("block").isin(probe)), least), "arm-probed")
    if len(probe) < len(numbers):
        by = W.partitionBy("class").orderBy(F.desc(rounded))
        got = found.withColumn("r", F.row_number().over(by)).filter(F.col("r") == k).select("class", rounded.alias("least")).toArrow()
        place = {c: i for i, c in enumerate(ids)}
        least[[place[c] for c in got["class"].to_pylist()]] = got["least"].to_numpy()
        found = found.unionByName(asking(blocks.filter(~F.col("block").isin(probe)), least))
    best = keep(batch.top(found.withColumnRenamed("class", "qid"), k, F.desc(rounded), key).withColumnRenamed("qid", "class"), "arm-best")
    return tuple(x.join(classes.filter(F.col("arm") == a).select("words", "class"), "words").select("qid", "class").join(best, "class").select("qid", key, "score", "rank") for a, x in arms.items())
