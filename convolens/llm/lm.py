"""Language-model scores from a distributed Elias-Fano n-gram trie of three levels.

The corpus is read once, in blocks of documents. Every n-gram (before, word, next) of a block goes
to the shard of its middle word, in packed arrays. A shard counts the n-grams of training
rows, builds its part of the trie and answers all n-grams from it, in the order in which they
came. What a block needs to put the answers together (the document of each n-gram, and
little more) travels with it. So no task holds more than a shard or a block, what moves
does not depend on how many shards there are, and the model grows with the corpus.

Frequent words would fill a shard by themselves. Their n-grams go to the shard of
(before, word). What follows such a word, or a frequent pair of words, is listed once
for each block with its count; the lists are dealt by (context, next) and answered apart.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolens.llm.examples import id_remainder
from convolens.llm.jaccard import WordHashes
from convolens.llm.shared import keep, shuffles_freed
from convolens.llm.trie import Level, Trie, from_codes, to_codes

#: Hashes of what stands before and after a text; no word has a space.
START, END = xxhash.xxh3_64_intdigest(b" start"), xxhash.xxh3_64_intdigest(b" end")
ODD = np.uint64(0x9E3779B97F4A7C15)
DISCOUNT = 0.75
U8, U16, U32, U64, I64 = np.uint8, np.uint16, np.uint32, np.uint64, np.int64
#: Words that have a number for their hash, and the number of all others, whose hash is written out.
LISTED, RARE = 1 << 19, (1 << 24) - 1
#: Bytes that are compressed by themselves and not with those of other arrays.
ALONE = 2048
#: Bytes of a text that are cut into words at once.
SLICE = 1 << 22


class Frequent(NamedTuple):
    """Hashes of listed words, the commonest first, and their order by hash; sorted hashes of words and pairs of words whose n-grams are spread. They decide where and how n-grams travel, and no score."""

    listed: np.ndarray
    order: np.ndarray
    words: np.ndarray
    pairs: np.ndarray

    @property
    def contexts(self) -> np.ndarray:
        return np.concatenate([self.words, self.pairs])


def scrambled(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return scrambled(before ^ (word * ODD))


def place_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash stands in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1, I64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((scrambled(h) >> U64(32)) * U64(shards) >> U64(32)).astype(I64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes. Hashes stay as they are; other numbers are cut into their low, middle and high bytes, as each of these has few values by itself."""
    press = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    alone, together = [], []
    for a in arrays:
        if a.dtype != U64:
            for part in np.ascontiguousarray(a).view(U8).reshape(-1, a.itemsize).T:
                if len(part) > ALONE:
                    alone.append(press(part.tobytes()))
                else:
                    together.append(part.tobytes())
    sizes = np.array([len(a) for a in arrays] + [len(x) for x in alone], U32)
    head = press(sizes.tobytes() + b"".join(together))
    return b"".join([struct.pack("<I", len(head)), head, *alone, *[a.tobytes() for a in arrays if a.dtype == U64]])


def unpack(packed: bytes, kinds: tuple) -> list[np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    at = 4 + struct.unpack_from("<I", packed)[0]
    head = expand(packed[4:at])
    sizes = np.frombuffer(head, U32, len(kinds)).tolist()
    parts = sum(np.dtype(k).itemsize for k, n in zip(kinds, sizes, strict=True) if k != U64 and n > ALONE)
    ends = at + np.cumsum(np.frombuffer(head, U32, parts, 4 * len(kinds)), dtype=I64)
    small, alone, out = 4 * (len(kinds) + parts), 0, []
    hashes = int(ends[-1]) if parts else at
    for kind, n in zip(kinds, sizes, strict=True):
        if kind == U64:
            out.append(np.frombuffer(packed, U64, n, hashes))
            hashes += 8 * n
            continue
        own = np.empty((n, np.dtype(kind).itemsize), U8)
        for i in range(own.shape[1]):
            if n > ALONE:
                own[:, i] = np.frombuffer(expand(packed[at : int(ends[alone])]), U8)
                at, alone = int(ends[alone]), alone + 1
            else:
                own[:, i] = np.frombuffer(head, U8, n, small)
                small += n
        out.append(own.reshape(-1).view(kind))
    return out


def decoded(code: np.ndarray, rest: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Hashes from the numbers of listed words and, in order, the hashes of others."""
    out, own = np.zeros(len(code), U64), code != RARE
    out[own] = listed[code[own]]
    out[~own] = rest
    return out


def steps(numbers: np.ndarray) -> np.ndarray:
    """Numbers below 65,536 as differences, which wrap round; ``np.cumsum`` over 16 bits gives them back."""
    return np.diff(numbers, prepend=0).astype(U16)


def hashed_slices(text: str, hashes: WordHashes) -> Iterator[np.ndarray]:
    """Hashes of the words of a whole text, long texts in slices that end between words."""
    body, a = text.encode("utf-8", "replace"), 0
    while True:
        blank = re.compile(rb"[\x20\t-\r]").search(body, a + SLICE) if len(body) - a > SLICE else None
        e = blank.start() if blank else len(body)
        words = body[a:e].lower().split()
        yield np.fromiter(map(hashes.__getitem__, words), U64, len(words))
        if not blank:
            return
        a = e


def frequent(docs: DataFrame, shards: int, one_in: int = 32, listed: int = LISTED, most: int = 4096) -> Frequent:
    """From a sample: about ``listed`` of the commonest words, and words and pairs (``most`` of each) with more than a quarter of a shard's share."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        flat = np.concatenate(held)
        h, n = np.unique(flat, return_counts=True)
        p, k = np.unique(pair_hash(flat[:-1], flat[1:]), return_counts=True)
        own = k * 16 * shards > len(flat)  # pairs far from frequent are not worth telling of
        return pd.DataFrame({"kind": [0] * len(h) + [1] * int(own.sum()), "h": np.concatenate([h, p[own]]).view(I64), "n": np.concatenate([n, k[own]])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, held, size = WordHashes(), [], 0
        for b in batches:
            for text in b.text:
                for part in hashed_slices(text, hashes):
                    held.append(part)
                    size += len(part)
                if size > 2_000_000:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    counts = keep(some.mapInPandas(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n")), "frequent")
    total = counts.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    counts = counts.withColumn("bin", F.floor(16 * F.log2("n")))
    bins = counts.groupBy("kind", "bin").agg(F.count("*").alias("k")).collect()  # a few hundred rows

    def top(kind: int, most: int, share: int) -> np.ndarray:
        """About ``most`` of those with 1 / ``share`` of the tokens, the commonest first: whole bins of like counts from above, and of the next bin as many as have room, by hash, so that nothing is sorted on the driver."""
        least, held, part = 1 << 60, 0, 0
        for b, k in sorted(((r["bin"], r["k"]) for r in bins if r["kind"] == kind), reverse=True):
            least = b
            part = min(1024, 1024 * (most - held) // k)
            held += k
            if held > most:
                break
        own = (F.col("bin") > least) | ((F.col("bin") == least) & (F.pmod("h", F.lit(1024)) < part))
        rows = counts.filter((F.col("kind") == kind) & own & (F.col("n") * share >= total)).select("h", F.col("bin").cast("short").alias("bin"))
        got = rows.toArrow()  # 10 bytes a row
        h, at = got["h"].to_numpy(), got["bin"].to_numpy()
        return h[np.lexsort((h, -at))].astype(I64).view(U64)

    start = np.array([START], U64)
    common = top(0, listed, total + 1)
    words, pairs = (top(kind, most, 4 * shards) for kind in (0, 1))
    return Frequent(common, np.argsort(common).astype(U32), np.unique(np.concatenate([words, start])), np.unique(np.concatenate([pairs, pair_hash(start, start)])))


class Part(NamedTuple):
    """A document, or a stretch of a long one: ``joint`` is shared by all stretches, ``last`` has the end."""

    key: int | None
    train: bool
    joint: int
    words: np.ndarray
    ahead: tuple[int, int]
    last: bool


#: A piece: n-grams by runs of words that are not frequent (run words, lengths, before, next), then those of frequent words (steps of their numbers, before, next), each with bits for training; then what follows frequent contexts (contexts, next, training counts).
PIECE = (U32, U64, U32, U32, U64, U32, U64, U8, U16, U32, U64, U32, U64, U8, U16, U32, U64, U32)
#: What stays with a block: ids, null ids, training, stretches' marks, tokens; of each shard: runs, n-grams by kind, lists; the documents of n-grams by kind; run lengths and numbers of frequent words; for held-out n-grams the number of the next word; entries of the lists.
STAY = (I64, np.bool_, np.bool_, I64, I64, U32, U16, U32, U32, U16, U16, U32, U32, U16, U16, U16, U32, U32, U32)
#: An answer: for n-grams by kind codes and bits of what is final; counts of the runs' words; for the lists codes and bits of what was seen.
ANSWER = (U16, U8, U16, U8, U32, U16, U8)
COLUMNS = ["kind", "block", "shard", "body"]
SCHEMA = "kind int, block long, shard int, body binary"


def block_pieces(held: list[Part], block: int, shards: int, fr: Frequent) -> pd.DataFrame:
    """Rows of one block: kind 0 what stays, kind 1 a piece for each shard that it has n-grams for."""
    train = np.array([p.train for p in held])
    sizes = np.array([len(p.words) + p.last for p in held])
    flat = np.concatenate([x for p in held for x in (np.array(p.ahead, U64), p.words, np.array([END], U64)[: int(p.last)])]).astype(U64)
    doc = np.repeat(np.arange(len(held)), sizes)
    at = np.arange(int(sizes.sum())) + 2 * doc  # each part has two words ahead
    names, number = np.unique(flat, return_inverse=True)
    u, v, w = number[at], number[at + 1], number[at + 2]
    hot_name, code = place_in(fr.words, names), place_in(fr.listed[fr.order], names)
    code = np.where(code < 0, RARE, np.append(fr.order, 0)[code]).astype(U32)
    coded = lambda x: (code[x], names[x][code[x] == RARE])
    hot = hot_name[v]
    pair = np.full(len(v), -1, I64)
    own = np.flatnonzero(hot >= 0)
    joined = pair_hash(names[u[own]], names[v[own]])
    pair[own] = place_in(fr.pairs, joined)
    to = np.zeros(len(v), I64)
    to[hot < 0] = shard_of(names, shards)[v[hot < 0]]
    to[own] = shard_of(joined, shards)

    # what follows frequent contexts: listed once, with its count in training rows
    pairs_at = np.flatnonzero(pair >= 0)
    key = np.concatenate([hot[own], len(fr.words) + pair[pairs_at]]) * len(names) + np.concatenate([w[own], w[pairs_at]])
    entry, back = np.unique(key, return_inverse=True)
    times = np.bincount(back, np.concatenate([train[doc[own]], train[doc[pairs_at]]]), len(entry)).astype(U32)
    context, nxt = entry // len(names), entry % len(names)
    entry_to = shard_of(fr.contexts[context] ^ (names[nxt] * ODD), shards)
    order = np.argsort(entry_to, kind="stable")
    rank = np.empty(len(order), I64)
    rank[order] = np.arange(len(order))
    word_entry, pair_entry = np.full(len(v), 0, U32), np.full(len(v), 0, U32)
    word_entry[own], pair_entry[pairs_at] = rank[back[: len(own)]], rank[back[len(own) :]]
    context, nxt, times, entry_edges = context[order], nxt[order], times[order], np.searchsorted(entry_to[order], np.arange(shards + 1))

    # n-grams in the order of shards, kinds, words by first place, documents
    first = np.full(len(names), 0, I64)
    first[v[::-1]] = np.arange(len(v))[::-1]
    first[hot_name >= 0] = hot_name[hot_name >= 0]  # so that their numbers go up
    sent = np.flatnonzero(pair < 0)
    order = sent[np.argsort(((to[sent] * 2 + (hot[sent] >= 0)) << 24) + first[v[sent]], kind="stable")]
    edges = np.searchsorted(to[order] * 2 + (hot[order] >= 0), np.arange(2 * shards + 1))
    # the last word of a stretch goes on in another block; its count is asked for all the same, by a run without n-grams
    ends_open = np.setdiff1d(w[np.cumsum(sizes)[~np.array([p.last for p in held])] - 1], v)
    ends_open = ends_open[hot_name[ends_open] < 0]
    tail_to = shard_of(names[ends_open], shards)
    plain_runs, run_lengths, rows, table = [], [], [], []
    for s in np.flatnonzero((edges[2::2] > edges[:-2:2]) | (np.diff(entry_edges) > 0) | (np.bincount(tail_to, minlength=shards) > 0)).tolist():
        n, h = order[edges[2 * s] : edges[2 * s + 1]], order[edges[2 * s + 1] : edges[2 * s + 2]]
        starts = np.flatnonzero(np.concatenate([[True], v[n][1:] != v[n][:-1]])) if len(n) else np.zeros(0, I64)
        tail = ends_open[tail_to == s]
        run = np.concatenate([v[n][starts], tail])
        lengths = np.concatenate([np.diff(np.append(starts, len(n))), np.zeros(len(tail), I64)]).astype(U32)
        x = slice(entry_edges[s], entry_edges[s + 1])
        codes = [coded(y) for y in (run, u[n], w[n], u[h], w[h])]
        c, rest = coded(nxt[x])
        body = pack(
            *codes[0], lengths, *codes[1], *codes[2], np.packbits(train[doc[n]]), steps(hot[h]), *codes[3], *codes[4],
            np.packbits(train[doc[h]]), context[x].astype(U16), c, rest, times[x],
        )
        rows.append((1, block, s, body))
        plain_runs.append(run)
        run_lengths.append(lengths)
        table.append((s, len(run), len(n), len(h), x.stop - x.start))
    runs, lengths = (np.concatenate([np.zeros(0, k), *y]) for k, y in ((I64, plain_runs), (U32, run_lengths)))
    plain, spread = order[hot[order] < 0], order[hot[order] >= 0]
    # numbers of next words: runs in their order, then frequent words, then the end
    number_of = np.full(len(names), len(runs) + len(fr.words), I64)
    number_of[runs] = np.arange(len(runs))
    number_of[hot_name >= 0] = len(runs) + hot_name[hot_name >= 0]
    out_of = lambda e: number_of[w[e[~train[doc[e]]]]].astype(U32)
    stay = pack(
        np.array([0 if p.key is None else p.key for p in held], I64), np.array([p.key is None for p in held]), train,
        np.array([p.joint for p in held], I64), sizes.astype(I64), np.array(table, U32).ravel(),
        steps(doc[plain]), lengths, out_of(plain), steps(doc[spread]), steps(hot[spread]), out_of(spread), word_entry[spread[~train[doc[spread]]]],
        steps(doc[pairs_at]), pair[pairs_at].astype(U16), hot[pairs_at].astype(U16), out_of(pairs_at), pair_entry[pairs_at], word_entry[pairs_at],
    )
    return pd.DataFrame([(0, block, -1, stay), *rows], columns=COLUMNS)


def pieces(docs: DataFrame, shards: int, fr: Frequent, block_tokens: int = 700_000) -> DataFrame:
    """The rows of all blocks. A block has ``block_tokens`` tokens or little more; a longer text is cut into stretches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 32  # a task that is run again reads the same rows in the same order
        hashes, held, tokens = WordHashes(), [], 0
        start, joints = (START, START), 0
        for b in batches:
            for key, none, train, text in zip(b.doc_id, b.none, b.train, b.text, strict=True):
                stretches = [p[i : i + block_tokens] for p in hashed_slices(text, hashes) for i in range(0, max(1, len(p)), block_tokens)]
                joints += len(stretches) > 1
                ahead = start
                for i, words in enumerate(stretches):
                    held.append(Part(None if none else int(key), train, (block >> 32 << 32) + joints if len(stretches) > 1 else -1, words, ahead, i == len(stretches) - 1))
                    ahead = tuple(int(x) for x in [*ahead, *words[-2:]][-2:])
                    tokens += len(words) + 1
                    if tokens >= block_tokens or len(held) == 60_000:
                        yield block_pieces(held, block, shards, fr)
                        held, tokens, block = [], 0, block + 1
        if held:
            yield block_pieces(held, block, shards, fr)

    slim = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("none"), "train", "text")
    return slim.mapInPandas(run, SCHEMA)


def bits(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).astype(bool)


def log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-300))


def answer(bodies: list[tuple[int, int, bytes]], fr: Frequent, discount: float) -> Iterator[pd.DataFrame]:
    """What a shard knows of the pieces of all blocks: kind 1 an answer to each piece, kind 2 its counts of tokens and words and of frequent contexts."""
    listed = fr.listed
    parts = [unpack(b, PIECE) for *_, b in bodies]
    for p in parts:
        p[8] = np.cumsum(p[8], dtype=U16)
    keys = [(block, s) for block, s, _ in bodies]
    bodies.clear()
    joined = lambda i: np.concatenate([p[i] for p in parts])
    runs, lengths = [len(p[2]) for p in parts], joined(2)
    plain_n, spread_n, entries = [len(p[3]) for p in parts], [len(p[8]) for p in parts], [len(p[14]) for p in parts]
    words = lambda i: decoded(joined(i), joined(i + 1), listed)
    run_word = words(0)
    total_plain = sum(plain_n)
    names, number = np.unique(np.concatenate([run_word, fr.words[joined(8)], words(3), words(9), words(5), words(11)]), return_inverse=True)
    number = number.astype(np.int32)
    r, s = len(run_word), sum(spread_n)
    run_id, hot_id = number[:r], number[r : r + s]
    word = np.concatenate([np.repeat(run_id, lengths), hot_id])
    before, nxt = number[r + s : r + 2 * s + total_plain], number[r + 2 * s + total_plain :]
    train = np.concatenate([bits(p[7], k) for p, k in zip(parts, plain_n, strict=True)] + [bits(p[13], k) for p, k in zip(parts, spread_n, strict=True)])
    context, following, times = joined(14).astype(I64), words(15), joined(17)
    del parts, number, run_word
    size = len(names)

    # distinct contexts, n-grams and pairs, with their counts in training rows
    pair, pair_at = np.unique(word.astype(I64) * size + before, return_inverse=True)
    gram, gram_at = np.unique(pair_at * size + nxt, return_inverse=True)
    n3 = np.bincount(gram_at, train, len(gram)).astype(I64)
    gram_pair, gram_next = gram // size, gram % size
    n_pair = np.bincount(gram_pair, n3, len(pair)).astype(I64)
    known3, known_pair = n3 > 0, n_pair > 0
    follow3 = np.bincount(gram_pair[known3], minlength=len(pair))
    plain = np.zeros(size, bool)
    plain[run_id] = True
    own = plain[pair[gram_pair] // size]
    two, two_at = np.unique(pair[gram_pair[own]] // size * size + gram_next[own], return_inverse=True)
    n2 = np.bincount(two_at, n3[own], len(two)).astype(I64)
    known2 = n2 > 0
    n1 = np.bincount(two // size, n2, size).astype(I64)
    follow2 = np.bincount(two[known2] // size, minlength=size)
    del pair_at

    place = np.cumsum(known_pair) - 1
    trie = Trie(
        size,
        (two[known2] // size, two[known2] % size, np.log10(n2[known2] - discount) - log10(n1[two[known2] // size])),
        (pair[known_pair] // size, pair[known_pair] % size, log10(discount * follow3[known_pair] / n_pair[known_pair])),
        (place[gram_pair[known3]], gram_next[known3], np.log10(n3[known3] - discount) - log10(n_pair[gram_pair[known3]])),
    )
    value, seen, _ = trie.lookup(pair[gram_pair] // size, pair[gram_pair] % size, gram_next)
    final = seen.copy()
    # the second level answers what the third doesn't, but for frequent words
    ask = np.flatnonzero(~seen & own)
    wanted = pair[gram_pair[ask]] // size * size + gram_next[ask]
    some, back = np.unique(wanted, return_inverse=True)
    at = trie.after.find(some // size, some % size)
    p2, hit = np.zeros(len(some)), at >= 0
    p2[hit] = trie.after.log_p(at[hit])
    weight = np.where(n1 > 0, log10(discount * follow2 / np.maximum(n1, 1)), 0.0)
    p2[~hit] = weight[some[~hit] // size]
    value[ask] += p2[back]
    final[ask] = hit[back]
    trie.close()
    codes, final = to_codes(value)[gram_at], final[gram_at]
    del value, seen, gram, gram_at

    # what follows frequent contexts: a level of its own, whose contexts' totals only all shards know
    follow_name, follow_at = np.unique(following, return_inverse=True)
    keys2, k_at = np.unique(context * max(1, len(follow_name)) + follow_at, return_inverse=True)
    n_list = np.bincount(k_at, times, len(keys2)).astype(I64)
    known = n_list > 0
    of = keys2 // max(1, len(follow_name))
    level, folder = listed_level(of[known], keys2[known] % max(1, len(follow_name)), np.log10(n_list[known] - discount), len(fr.contexts), len(follow_name))
    found = level.find(of, keys2 % max(1, len(follow_name)))
    list_value = np.zeros(len(keys2))
    list_value[found >= 0] = level.log_p(found[found >= 0])
    del level
    folder.cleanup()
    list_codes, list_seen = to_codes(list_value)[k_at], (found >= 0)[k_at]
    ctx, sums = np.unique(of, return_index=False), np.bincount(of, n_list, len(fr.contexts))
    counts = pack(ctx.astype(U16), sums[ctx].astype(I64), np.bincount(of[known], minlength=len(fr.contexts))[ctx].astype(I64), np.array([n1.sum(), (n1 > 0).sum()], I64))
    yield pd.DataFrame([(2, 0, keys[0][1], counts)], columns=COLUMNS)

    run_count = np.minimum(n1[run_id], np.iinfo(U32).max).astype(U32)
    a = b = c = d = 0
    for (block, s), nr, np_, ns, ne in zip(keys, runs, plain_n, spread_n, entries, strict=True):
        p, q = slice(a, a + np_), slice(total_plain + b, total_plain + b + ns)
        body = pack(codes[p], np.packbits(final[p]), codes[q], np.packbits(final[q]), run_count[c : c + nr], list_codes[d : d + ne], np.packbits(list_seen[d : d + ne]))
        yield pd.DataFrame([(1, block, s, body)], columns=COLUMNS)
        a, b, c, d = a + np_, b + ns, c + nr, d + ne


def listed_level(context: np.ndarray, word: np.ndarray, log_p: np.ndarray, contexts: int, words: int):
    import tempfile

    folder = tempfile.TemporaryDirectory(prefix="trie-")
    return Level(context, word, log_p, contexts, words, folder.name, "listed"), folder


def answers(rows: DataFrame, shards: int, fr: Frequent, discount: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bodies = None, []
        for b in batches:
            for kind, block, s, body in zip(b.kind, b.block, b.shard, b.body, strict=True):
                if kind == 0:
                    yield pd.DataFrame([(0, block, -1, body)], columns=COLUMNS)
                    continue
                if s != now and bodies:
                    yield from answer(bodies, fr, discount)
                    bodies = []
                now = s
                bodies.append((block, s, body))
        if bodies:
            yield from answer(bodies, fr, discount)

    spread = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int")).otherwise(F.col("shard"))
    return rows.withColumn("at", spread).repartition(shards, "at").drop("at").sortWithinPartitions("shard", "block").mapInPandas(run, SCHEMA)


class Totals(NamedTuple):
    """What all shards count together: tokens, distinct words, ends, and for each frequent context its training count and how many words follow it."""

    tokens: int
    words: int
    ends: int
    count: np.ndarray
    follow: np.ndarray


def totals(known: DataFrame, fr: Frequent) -> Totals:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for body in b.body:
                ctx, n, follow, both = unpack(body, (U16, I64, I64, I64))
                yield pd.DataFrame({"c": np.append(ctx.astype(I64), -1), "n": np.append(n, both[0]), "f": np.append(follow, both[1])})

    sums = known.filter("kind = 2").select("body").mapInPandas(run, "c long, n long, f long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    count, follow, plain = np.zeros(len(fr.contexts), I64), np.zeros(len(fr.contexts), I64), (0, 0)
    for row in sums.collect():  # at most one row for each frequent context
        if row["c"] < 0:
            plain = row["n"], row["f"]
        else:
            count[row["c"]], follow[row["c"]] = row["n"], row["f"]
    start = int(place_in(fr.words, np.array([START], U64))[0])
    both = int(place_in(fr.pairs, pair_hash(np.array([START], U64), np.array([START], U64)))[0])
    ends = int(count[len(fr.words) + both])  # texts that begin also end
    words = np.delete(count[: len(fr.words)], start)
    return Totals(int(plain[0] + words.sum() + ends), int(plain[1] + (words > 0).sum() + (ends > 0)), ends, count, follow)


def put_together(stay: bytes, replies: dict[int, bytes], fr: Frequent, t: Totals, discount: float) -> pd.DataFrame:
    """Rows of one block from what stayed and the shards' answers."""
    ids, none, train, joint, sizes, table, doc1, lengths, next1, doc2, hot2, next2, entry2, doc3, pair3, hot3, next3, pair_entry3, word_entry3 = unpack(stay, STAY)
    doc1, doc2, hot2, doc3 = (np.cumsum(x, dtype=U16) for x in (doc1, doc2, hot2, doc3))
    table = table.reshape(-1, 5)
    got = [unpack(replies[s], ANSWER) for s in table[:, 0].tolist()]
    stacked = lambda i, k: np.concatenate([np.zeros(0, k), *(g[i] for g in got)])
    flags = lambda i, col: np.concatenate([np.zeros(0, bool), *(bits(g[i], int(n)) for g, n in zip(got, table[:, col].tolist(), strict=True))])
    value1, final1, value2, final2 = from_codes(stacked(0, U16)), flags(1, 2), from_codes(stacked(2, U16)), flags(3, 3)
    run_count, list_value, list_seen = stacked(4, U32), from_codes(stacked(5, U16)), flags(6, 4)

    n, w = len(ids), len(fr.words)
    start = int(place_in(fr.words, np.array([START], U64))[0])
    log_z = np.log10(t.tokens + 0.1 * (t.words + 1))
    times = np.concatenate([run_count, t.count[:w], [t.ends]]).astype(np.float64)
    p1 = np.log10(times + 0.1) - log_z
    log_total = log10(t.count)
    weight = np.where(t.count > 0, log10(discount * t.follow / np.maximum(t.count, 1)), 0.0)

    def spread_over(e: np.ndarray, held: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(e), values.dtype)
        out[held] = values
        return out

    def second(hot: np.ndarray, entry: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """log10 P(next | frequent word)."""
        return np.where(list_seen[entry], list_value[entry] - log_total[hot], weight[hot] + p1[nxt])

    held1, held2, held3 = ~train[doc1], ~train[doc2], ~train[doc3]
    score1 = value1 + np.where(final1, 0.0, p1[spread_over(doc1, held1, next1)])
    score2, open2 = value2.copy(), np.flatnonzero(~final2)
    all_next2, all_entry2 = spread_over(doc2, held2, next2), spread_over(doc2, held2, entry2)
    score2[open2] += second(hot2[open2], all_entry2[open2], all_next2[open2])
    all_next3 = spread_over(doc3, held3, next3)
    ctx = w + pair3.astype(I64)
    seen3 = list_seen[pair_entry3]
    score3 = np.where(seen3, list_value[pair_entry3] - log_total[ctx], weight[ctx] + second(hot3, word_entry3, all_next3))

    score, base, known, words = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n, I64)
    for d, x in ((doc1, score1), (doc2, score2), (doc3, score3)):
        score += np.bincount(d, x, n)
    of1 = np.repeat(run_count.astype(np.float64), lengths)
    for d, c in ((doc1, of1), (doc2[hot2 != start], t.count[hot2[hot2 != start]]), (doc3[hot3 != start], t.count[hot3[hot3 != start]])):
        base += np.bincount(d, np.log10(c + 0.1), n)
        known += np.bincount(d, c > 0, n)
        words += np.bincount(d, minlength=n)
    ends = sizes - words  # 1 where the text ends here, or in the first of its stretches
    base += ends * np.log10(t.ends + 0.1) - sizes * log_z
    known += ends * (t.ends > 0)
    return pd.DataFrame({"joint": joint, "doc_id": pd.array(pd.arrays.IntegerArray(ids.copy(), none.copy())), "held_out": ~train, "n_tokens": sizes, "n_known": known.astype(I64), "base_score": base, "score": score})


def block_rows(known: DataFrame, fr: Frequent, t: Totals, discount: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stay, replies = None, {}
        for b in batches:
            for kind, s, body in zip(b.kind, b.shard, b.body, strict=True):
                if kind == 0:
                    if stay is not None:
                        yield put_together(stay, replies, fr, t, discount)
                    stay, replies = body, {}
                else:
                    replies[s] = body
        if stay is not None:
            yield put_together(stay, replies, fr, t, discount)

    rows = known.filter("kind < 2").repartition("block").sortWithinPartitions("block", "kind", "shard")
    return rows.mapInPandas(run, "joint long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, discount: float = DISCOUNT, shard_bytes: int = 8 << 20, block_tokens: int = 700_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from rows whose crc32(doc_id) modulo 10 is not 0.

    score: sum of log10 P(word | the two words before). P of an n-gram seen in training is
    (c(h, w) - discount) / c(h); of another, what that leaves of the context's mass times the
    probability after the shorter context, down to the base probability of w; a context without
    training leaves all. The mass that a shorter context gives to seen words is not dealt
    out again, so the probabilities sum to 1 at most. Two starts stand before a text.
    A null or empty text is one end. Rows with one id and one text, and rows without an id,
    are counted each. Texts of any length are scored whole, in stretches of ``block_tokens``.
    With no training rows every probability is that of an unknown word; an empty table gives
    an empty one. Other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    held_out = id_remainder(F.col("doc_id"), 10) == 0
    slim = docs.select("doc_id", (~held_out).alias("train"), text.alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, -(-size // shard_bytes))
    fr = frequent(slim, shards)
    with shuffles_freed(docs.sparkSession):  # pieces are the most that is written, and are not needed beside the answers' shuffle
        known = keep(answers(pieces(slim, shards, fr, block_tokens), shards, fr, discount), "answers")
    t = totals(known, fr)
    rows = block_rows(known, fr, t, discount)
    whole = rows.filter("joint < 0").drop("joint")
    columns = ["n_tokens", "n_known", "base_score", "score"]
    cut = rows.filter("joint >= 0").groupBy("joint").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in columns]).drop("joint")
    out = whole.unionByName(cut)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(t.tokens).cast("long").alias("train_tokens"), "base_score", "score")
