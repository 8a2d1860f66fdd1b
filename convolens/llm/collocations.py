"""Phrases that occur together more often than their parts would by chance.

Texts are cut into pieces at punctuation and their words are numbered, block by block and once; all
further passes read the numbers. Every shard of pieces gets a generalised suffix automaton
over its words; a state's strings end at the same places, so one number, the size of that set, counts
them all. The strings of two to five words of each automaton are listed with their counts, and the
counts of all shards are added. So that a shard doesn't list what can't be frequent, words and then
pairs of words are counted first, and pieces are cut where a word or a pair is too rare; two bitmaps
of bounded size tell tasks which are not. A bitmap only errs by keeping too much, and the sums decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.llm.shared import given_back, keep, small

LEAST, LONGEST, TOP = 100, 5, 2000
#: Each byte with A-Z lowered and the ends of pieces made one, and what each is then.
LOWERED = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in bytes(range(256)).lower())
BLANK, END, WORD = range(3)
KINDS = bytes(BLANK if c in b" \t" else END if c == 10 else WORD for c in range(256))
KEPT = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary())
#: Blocks are written so that few of them are in memory at a time: row groups of 8 MiB, which are looked at after each row and not after a hundred.
ROW_GROUPS = {"compression": "zstd", "parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1}
#: About how many words a block has, and bytes of a word; distinct words that a task knows at a time; pairs that it counts at a time; words of an automaton.
READ_WORDS, LETTERS, HELD_WORDS, HELD_PAIRS, SHARD_WORDS = 1 << 20, 6, 400_000, 4 << 20, 1 << 17
#: Phrases of a task's automata whose counts it adds up before they leave it.
HELD_PHRASES = 400_000
#: A bitmap has 64 bits for each of its members, as a power of two within these bounds (32 MiB at most).
BITS = (16, 28)
#: Words of the corpus for each slice of the hashes of pairs or triples, and bits of a slice's number.
SLICE_WORDS, SLICE_BITS = 1 << 18, (4, 20)
NO_LANG = "und"


def sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def block_of(lang: str, texts: list[bytes]) -> tuple[str, pa.Array, np.ndarray, bytes]:
    """(lang, distinct words, how often each occurs, the words' numbers from 1 in their order with a 0 between pieces). Only A-Z are lowered."""
    low = b"\n".join([*texts, b"\n"]).translate(LOWERED)
    kinds = np.frombuffer(low.translate(KINDS), np.uint8)
    starts = np.append(0, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1)
    what, lengths = kinds[starts], np.diff(starts, append=len(kinds))
    is_word = what == WORD
    ends = np.append(0, np.cumsum(lengths[is_word])).astype("<i4")
    letters = np.frombuffer(low, np.uint8)[kinds == WORD]
    found = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    numbers = np.zeros(len(what), "<i4")
    numbers[is_word] = found.indices.to_numpy() + 1
    return lang, found.dictionary.cast(pa.string()), np.bincount(found.indices), numbers[what != BLANK].tobytes()


def blocks_of(docs: DataFrame) -> DataFrame:
    """(lang, words, times, numbers): what ``block_of`` makes of a block of a language's texts. Texts are cut into words here, once."""
    most = LETTERS * READ_WORDS

    def read(batches):
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.setdefault(lang, []).append(text.as_py().encode())
                size += len(held[lang][-1]) + 1
                if size >= most:
                    yield from packed(held)
                    held, size = {}, 0
        yield from packed(held)

    def packed(held):
        for lang, texts in held.items():
            block = block_of(lang, texts)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block, KEPT, strict=True)], names=["lang", "words", "times", "numbers"])

    return sources(docs).mapInArrow(given_back(read), "lang string, words array<string>, times array<int>, numbers binary")


def word_counts(blocks: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "times")).alias("w"))
    return each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.times").alias("n"))


def word_hashes(lang: str, words: Iterable[bytes]) -> Iterator[int]:
    start, digest = lang.encode() + b"\0", xxhash.xxh64_intdigest
    return (digest(start + w) for w in words)


def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [next(word_hashes(a, [b.encode()])) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"key": np.array(hashes, np.uint64).view(np.int64)})


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits for each pair of words, from the words' hashes; overflow is meant."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def bitmap(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """Bits at the low bits of ``n`` keys; only as many numbers as the bitmap has come to the driver."""
    bits = min(max(math.ceil(math.log2(64 * max(n, 1))), BITS[0]), BITS[1])
    place = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("w"))
    out = np.zeros(1 << (bits - 6), "<u8")
    got = rows.toArrow()
    out[got.column("i").to_numpy()] = got.column("w").to_numpy().view("<u8")
    return out


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def numbered(batches: Iterable[pa.RecordBatch], bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(numbers of a block's words in their order, 0 for the end of a piece and words that can't be frequent; hashes by number; the block)."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            # a line feed ends a piece, so no word has one, and one long string is cut faster than many are read
            words = pc.binary_join(row["words"], "\n")[0].as_py().encode().split(b"\n")
            hashes = np.array([0, *word_hashes(row["lang"][0].as_py(), words)][: len(row["words"][0]) + 1], np.uint64)
            numbers = np.where(has(bits, hashes), np.arange(len(hashes), dtype=np.int32), np.int32(0))
            numbers[0] = 0
            yield numbers[np.frombuffer(row["numbers"][0].as_buffer(), "<i4")], hashes, row


def grams(seq: np.ndarray, hashes: np.ndarray, bits: Iterable[np.ndarray], slice_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For pairs, then triples, one level for each bitmap and one more: (places, hashes) of those whose words, or two pairs, may be frequent."""
    at = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    levels = [(at, pair_hashes(hashes[seq[at]], hashes[seq[at + 1]]))]
    for level, held in enumerate(bits, 2):
        at, h = levels[-1]
        kept = has(held, h >> np.uint64(32 - slice_bits))
        at, h = at[kept], h[kept]
        levels[-1] = at, h
        both = np.flatnonzero(np.diff(at) == 1)
        levels.append((at[both], pair_hashes(h[both], hashes[seq[at[both] + level]])))
    return levels


def runs_of(pairs: np.ndarray, triples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths) of the runs of words whose pairs, and triples, may all be frequent. Two runs can share the word at which a triple was too rare, so each pair is in one run."""
    if not len(pairs):
        return pairs, pairs
    inside = (np.diff(pairs) == 1) & np.isin(pairs[:-1], triples, assume_unique=True)
    ends = np.flatnonzero(np.append(~inside, True))
    starts = np.append(0, ends[:-1] + 1)
    return pairs[starts], pairs[ends] - pairs[starts] + 2


def distinct_runs(seq: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """(the numbers of a run, 4 bytes each, how often it occurs) of the runs of a block."""
    order = np.argsort(lengths, kind="stable")
    of_length, starts = np.unique(lengths[order], return_index=True)
    ends = np.append(starts, len(order))[1:]
    for n, a, b in zip(of_length.tolist(), starts, ends, strict=True):
        own = places[order[a:b]]
        rows = np.ascontiguousarray(seq[own[:, None] + np.arange(n)], "<i4")
        counts = pa.Array.from_buffers(pa.binary(4 * n), len(own), [None, pa.py_buffer(rows)]).value_counts()
        yield from zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True)


def frequent(blocks: DataFrame, words: np.ndarray, bits: list[np.ndarray], least: int, slice_bits: int) -> DataFrame:
    """(key) of the pairs of words that occur ``least`` times or more, or with the bitmap of pairs in ``bits`` of the triples: the upper bits of their hashes, 32 more than a slice's number has."""
    shipped = blocks.sparkSession.sparkContext.broadcast((words, bits))

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(parts) >> np.uint64(32 - slice_bits), return_counts=True)
        slices = (hashes >> np.uint64(32)).astype(np.int64)
        held, starts = np.unique(slices, return_index=True)
        ends = [*starts[1:], len(hashes)]
        tags, times = hashes.astype("<u4"), np.minimum(n, least).astype("<u4")
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
        return pa.RecordBatch.from_pydict({"slice": pa.array(held, pa.int32()), "tags": cut(tags), "times": cut(times)})

    def count(batches):
        held: list[np.ndarray] = []
        words, bits = shipped.value
        for seq, hashes, _ in numbered(batches, words):
            held.append(grams(seq, hashes, bits, slice_bits)[-1][1])
            if sum(map(len, held)) >= HELD_PAIRS:
                yield counted(held)
                held = []
        if sum(map(len, held)):
            yield counted(held)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        tags = np.concatenate([np.frombuffer(x, "<u4") for x in rows["tags"]])
        times = np.concatenate([np.frombuffer(x, "<u4") for x in rows["times"]])
        tags, back = np.unique(tags, return_inverse=True)
        often = np.bincount(back, times) >= least
        return pd.DataFrame({"key": (np.int64(rows["slice"].iloc[0]) << 32) | tags[often].astype(np.int64)})

    return blocks.drop("times").mapInArrow(given_back(count), "slice int, tags binary, times binary").groupBy("slice").applyInPandas(add, "key long")


class Automaton:
    """A generalised suffix automaton: runs of numbers are added one after the other, each with a weight."""

    def __init__(self):
        self.length, self.link, self.next, self.end, self.times, self.symbols = [0], [-1], [{}], [-1], [0], []

    def state(self, length: int, link: int, following: dict, end: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.end.append(end)
        self.times.append(0)
        return len(self.length) - 1

    def split(self, p: int, symbol: int, q: int) -> int:
        """A state of its own for the strings of q that are one longer than those of p."""
        following, link = self.next, self.link
        clone = self.state(self.length[p] + 1, link[q], dict(following[q]), self.end[q])
        link[q] = clone
        while p >= 0 and following[p].get(symbol) == q:
            following[p][symbol] = clone
            p = link[p]
        return clone

    def add(self, run: Iterable[int], weight: int) -> None:
        last, following, link, length = 0, self.next, self.link, self.length
        for symbol in run:
            self.symbols.append(symbol)
            q = following[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self.split(last, symbol, q)
            else:
                new, p = self.state(length[last] + 1, 0, {}, len(self.symbols) - 1), last
                while p >= 0 and symbol not in following[p]:
                    following[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = following[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self.split(p, symbol, q)
                last = new
            self.times[last] += weight

    def strings(self, shortest: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length (strings as rows of a matrix, how often each occurs): a place counts for a state and all that its suffix links lead to."""
        length, link, end, times = (np.array(x, np.int64) for x in (self.length, self.link, self.end, self.times))
        symbols = np.array(self.symbols, np.int64)
        order = np.argsort(-length, kind="stable")
        times = times.tolist()
        for s in order.tolist():
            if s:
                times[self.link[s]] += times[s]
        times, above = np.array(times, np.int64), np.where(link >= 0, length[link], -1)
        for n in range(shortest, longest + 1):
            states = np.flatnonzero((length >= n) & (above < n))
            yield symbols[end[states][:, None] + np.arange(1 - n, 1)], times[states]


class Known:
    """Numbers, from 1, of the words that the runs of a task have, in all blocks and languages."""

    def __init__(self):
        self.of: dict[tuple[str, bytes], int] = {}
        self.hashes: list[int] = [0]

    def numbers(self, lang: str, words: pa.Array, hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The task's number for each of a block's; only ``asked`` ones have one."""
        out = np.zeros(len(hashes), np.int32)
        for i, word, h in zip(asked.tolist(), words.take(pa.array(asked - 1)).cast(pa.binary()).to_pylist(), hashes[asked].tolist(), strict=True):
            out[i] = number = self.of.setdefault((lang, word), len(self.hashes))
            if number == len(self.hashes):
                self.hashes.append(h)
        return out


def phrase_counts(blocks: DataFrame, words: np.ndarray, bits: list[np.ndarray], least: int, slice_bits: int, longest: int) -> DataFrame:
    """(lang, phrase, n) of phrases with ``least`` occurrences or more: sums over all shards, exact for every phrase whose words, pairs and triples the bitmaps hold.

    A task adds up the counts of its automata; what leaves it is one row for each slice of the phrases' hashes, with the slice's phrases and counts.
    """
    shipped = blocks.sparkSession.sparkContext.broadcast((words, bits))

    def listed(runs: Counter, known: Known) -> pa.Table:
        """(lang, slice, phrase, n) of the strings of the runs' automaton."""
        automaton = Automaton()
        for run, weight in runs.items():
            automaton.add(np.frombuffer(run, "<i4").tolist(), weight)
        langs, texts = (pa.array([x, *(k[i] for k in known.of)], t) for i, (x, t) in enumerate((("", pa.string()), (b"", pa.binary()))))
        hashes, tables = np.array(known.hashes, np.uint64), []
        for strings, times in automaton.strings(2, longest):
            if len(strings):
                h = hashes[strings[:, 0]]
                for column in strings.T[1:]:
                    h = pair_hashes(h, hashes[column])
                phrases = pc.binary_join_element_wise(*[texts.take(pa.array(column)) for column in strings.T], b" ")
                slices = pa.array((h & np.uint64((1 << slice_bits) - 1)).astype(np.int32))
                tables.append(pa.table({"lang": langs.take(pa.array(strings[:, 0])), "slice": slices, "phrase": phrases, "n": times}))
        return pa.concat_tables(tables)

    def added(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by(["lang", "slice", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "slice", "phrase", "n"])

    def packed(held: list[pa.Table]) -> pa.RecordBatch:
        total = added(held).sort_by([("lang", "ascending"), ("slice", "ascending")])
        lang, slices = total["lang"].combine_chunks().dictionary_encode().indices.to_numpy(), total["slice"].to_numpy()
        starts = np.flatnonzero(np.append(True, (np.diff(slices) != 0) | (np.diff(lang) != 0)))
        ends, times = np.append(starts[1:], len(slices)), total["n"].to_numpy().astype("<i8")
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(slices)), pa.int32()), total["phrase"].combine_chunks())
        first = total.select(["lang", "slice"]).take(pa.array(starts)).combine_chunks()
        # a line feed ends a piece, so no phrase has one
        columns = [first["lang"].combine_chunks(), first["slice"].combine_chunks(), pc.binary_join(lists, b"\n"), pa.array([times[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "slice", "phrases", "times"])

    def count(batches):
        words, bits = shipped.value
        runs, size, known = Counter(), 0, Known()
        held: list[pa.Table] = []
        for seq, hashes, block in numbered(batches, words):
            (pairs, _), (triples, h), *_ = grams(seq, hashes, bits[:1], slice_bits)
            places, lengths = runs_of(pairs, triples[has(bits[1], h >> np.uint64(32 - slice_bits))])
            asked = np.unique(np.concatenate([seq[pairs], seq[pairs + 1]]))
            numbers = known.numbers(block["lang"][0].as_py(), block["words"][0].values, hashes, asked)
            for run, times in distinct_runs(numbers[seq], places, lengths):
                size += 0 if run in runs else len(run) // 4
                runs[run] += times
                if size >= SHARD_WORDS:
                    held.append(listed(runs, known))
                    runs, size = Counter(), 0
            if runs and len(known.hashes) >= HELD_WORDS:
                held.append(listed(runs, known))
                runs, size, known = Counter(), 0, Known()
            if sum(map(len, held)) >= HELD_PHRASES:
                held = [added(held)]
                if len(held[0]) >= HELD_PHRASES // 2:
                    yield packed(held)
                    held = []
        if runs:
            held.append(listed(runs, known))
        if held:
            yield packed(held)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for phrases, times in zip(rows["phrases"], rows["times"], strict=True):
            for p, n in zip(phrases.split(b"\n"), np.frombuffer(times, "<i8").tolist(), strict=True):
                total[p] += n
        often = [(rows["lang"].iloc[0], p.decode(), n) for p, n in total.items() if n >= least]
        return pd.DataFrame(often, columns=["lang", "phrase", "n"])

    parts = blocks.drop("times").mapInArrow(given_back(count), "lang string, slice int, phrases binary, times binary")
    return parts.groupBy("lang", "slice").applyInPandas(summed, "lang string, phrase string, n long")


def candidates(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, word, n) of all words, (lang, phrase, n) of all phrases of two words or more that occur ``least`` times or more)."""
    blocks = keep(blocks_of(docs), "blocks", **ROW_GROUPS)
    words = keep(word_counts(blocks), "words")
    often = words.filter(F.col("n") >= least)
    sums = words.agg(F.sum("n").alias("all"), F.count(F.when(F.col("n") >= least, 1)).alias("often")).first()
    word_bits = bitmap(often.select("lang", "word").mapInArrow(hashed, "key long"), "key", sums["often"])
    slice_bits = min(max(math.ceil(math.log2(max((sums["all"] or 0) / SLICE_WORDS, 1))), SLICE_BITS[0]), SLICE_BITS[1])
    bits: list[np.ndarray] = []
    for name in ("pairs", "triples"):
        often_together = keep(frequent(blocks, word_bits, bits, least, slice_bits), name)
        bits = [*bits, bitmap(often_together, "key", often_together.count())]
    return words, keep(phrase_counts(blocks, word_bits, bits, least, slice_bits, longest), "phrases")


def unsubsumed(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer one holds as often.

    What lies inside a longer phrase that occurs as often also lies inside one that is longer by one word
    and does, so it is enough to go from each phrase along its suffix link (without its first word),
    and likewise without its last.
    """
    words = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(words, 2, 99), " "), F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    inner = phrases.filter(F.size(words) > 2).select("lang", F.explode(shorter).alias("phrase"), F.col("n").alias("__n")).groupBy("lang", "phrase").agg(F.max("__n").alias("__n"))
    return phrases.join(inner, ["lang", "phrase"], "left").filter("__n is null or __n < n").drop("__n")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases.

    a: how often the phrase occurs; n: all words of the language; l and r: how often the two parts occur
    whose cut gives the least floor(1000 * a * n / (l * r)), the score, and the first cut of those that do.
    Numbers are exact (decimals of 38 digits). Ties go by a, then by the phrase's bytes. A null text has no
    words, a null language is ``und``, repeated rows count each time, and other columns are not looked at;
    an empty table gives no rows.
    """
    words, phrases = candidates(docs, least, longest)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = keep(words.filter(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n").unionByName(phrases), "counts")
    split = F.split("phrase", " ")
    cuts = unsubsumed(phrases).select("lang", "phrase", F.col("n").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.size(split) - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", 1, F.col("cut")), " ").alias("first"), F.expr("array_join(slice(w, cut + 1, size(w) - cut), ' ')").alias("rest"))
    of = lambda part, name: small(counts).select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    held = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(small(keep(total, "total")), "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = held.withColumn("over", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
