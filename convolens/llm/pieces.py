"""Encoding and decoding with a SentencePiece model through a table of distinct words.

Where no piece has a white space marker behind another character, a text falls apart before each
run of markers, and each such word is segmented by itself. Documents are packed into blocks. A block
sends its distinct words, dealt by a hash of the word, to the buckets of one table; a bucket segments
each of its words once, decodes it once, and answers every block in the order of its request; the block
then puts the ids, and the decoded text, of its words together by position. Requests and answers grow with
a block's distinct words, and no word is asked for more than once by a block, so a frequent word makes no
task larger.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SentencePiece's mark for white space.
MARK = "▁"
WORD = re.compile(" +[^ ]*")
#: A block has so many characters of text, or one longer text.
BLOCK_CHARS = 6 << 20
#: Says that a word's ids decode to the word; no text has this byte.
SAME = b"\xff"
#: Characters of text for each bucket of the table, and how many buckets there are at least and at most.
BUCKET_CHARS, BUCKETS = 16 << 20, (16, 1 << 16)


def public_model(name: str) -> str:
    """Where a model file of the public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_model(path: str) -> bytes:
    """A model file, read on the driver; refused if words can't be segmented one by one with it."""
    model = Path(path).read_bytes()
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece crosses a white space marker")
    probe = "  a ﬁ  b "
    if "".join(sp.encode(probe, out_type=str)) != MARK + probe.replace(" ", MARK):
        raise ValueError("the model changes texts before it segments them, or adds no marker")
    return model


@cache
def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def words(text: str) -> list[str]:
    """The words that a text falls into, each without its first marker, which the model adds to what it gets. Joined by blanks they are the text again; a marker in it counts as a blank."""
    text = text.replace(MARK, " ")
    if "  " not in text and text[:1] != " ":
        return text.split(" ") if text else []
    return [w[1:] for w in WORD.findall(" " + text)]


def segment(sp, asked: list[str]) -> list[list[int]]:
    """The ids of words. Of nothing the model makes no ids, but a marker alone is a piece."""
    alone = [sp.piece_to_id(MARK)]
    return [ids or alone for ids in sp.encode(asked, num_threads=1)]


def packed(items: Iterable[bytes], level: int = 1) -> bytes:
    """Lengths and bytes of a list, compressed."""
    items = list(items)
    lengths = np.array([len(x) for x in items], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(len(items).to_bytes(8, "little") + lengths + b"".join(items))


def unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    ends = (8 + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, 8), dtype=np.int64)).tolist()
    return [raw[a:b] for a, b in zip([8 + 4 * n, *ends], ends, strict=False)]


class Block:
    """Documents in a row. Its key is a hash of what is in it, so that it is the same whenever it is made again."""

    def __init__(self):
        self.keys: list[bytes] = []
        self.texts: list[str] = []
        self.chars = 0

    def add(self, key: bytes, text: str) -> None:
        self.keys.append(key)
        self.texts.append(text)
        self.chars += len(text) + 16

    def distinct(self) -> set[str]:
        return {w for t in self.texts for w in words(t)}

    def payload(self) -> bytes:
        return packed((x for k, t in zip(self.keys, self.texts, strict=True) for x in (k, t.encode())), level=3)

    def key(self) -> bytes:
        h = hashlib.blake2b(digest_size=16)
        for k, t in zip(self.keys, self.texts, strict=True):
            b = t.encode()
            h.update(b"%d %d " % (len(k), len(b)) + k + b)
        return h.digest()


def asked_by(distinct: Iterable[str], buckets: int) -> list[list[str]]:
    """A block's words by bucket, in an order that both sides know."""
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in sorted(distinct):
        out[zlib.crc32(w.encode()) % buckets].append(w)
    return out


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    now = Block()
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            now.add(key.as_py(), text.as_py())
            if now.chars >= BLOCK_CHARS:
                yield now
                now = Block()
    if now.keys:
        yield now


def encode(docs: DataFrame, model: bytes, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): each row's whole text as the model encodes it, without begin or end ids, and the text that it decodes these ids to.

    A null text is empty and has no ids. Rows with equal or null keys stay rows of their own.
    Empty in, empty out; columns of other names are left out. Words have any length; a task
    holds a block, or one longer text. ``docs`` is read twice; rows that come in another order
    the second time make blocks that nobody answered, and those segment their words themselves.
    """
    spark = docs.sparkSession
    shipped: Broadcast = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.to_json(F.struct(F.col(f"`{key}`").alias("k"))).cast("binary").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = min(max(chars // BUCKET_CHARS, BUCKETS[0]), BUCKETS[1])

    def answers_to(sp, asked: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids, what they are decoded to if it is another word, else SAME) of words."""
        ids = segment(sp, asked)
        for w, i, text in zip(asked, ids, sp.decode(ids, num_threads=1) if ids else [], strict=True):
            yield np.array(i, "<i4").tobytes(), SAME if text == w else text.encode()

    def requests(batches):
        for block in blocks(batches):
            lists = asked_by(block.distinct(), buckets)
            held = [i for i, x in enumerate(lists) if x]
            yield pa.RecordBatch.from_pydict({"block": [block.key()] * len(held), "bucket": pa.array(held, pa.int32()), "words": [packed(w.encode() for w in lists[i]) for i in held]})

    def segmented(batches):
        """Rows come sorted by bucket; the table of one bucket is held at a time."""
        sp, bucket, known = processor(shipped.value), None, {}
        for batch in batches:
            ids, texts = [], []
            for b, request in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                asked = unpacked(request.as_py())
                new = [w for w in asked if w not in known]
                known.update(zip(new, answers_to(sp, [w.decode() for w in new]), strict=True))
                ids.append(packed(known[w][0] for w in asked))
                texts.append(packed(known[w][1] for w in asked))
            yield pa.RecordBatch.from_pydict({"block": batch.column(0), "bucket": batch.column(1), "ids": pa.array(ids, pa.binary()), "texts": pa.array(texts, pa.binary())})

    def payloads(batches):
        for block in blocks(batches):
            yield pa.RecordBatch.from_pydict({"block": [block.key()], "docs": [block.payload()]})

    def put_together(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        by_bucket = {b: (i, t) for b, i, t in zip(answers["bucket"], answers["ids"], answers["texts"], strict=True)}
        out: list[tuple] = []
        for data in docs["docs"]:
            held = unpacked(data)
            split = [words(t.decode()) for t in held[1::2]]
            ids: dict[str, bytes] = {}
            others: dict[str, str] = {}
            for i, asked in enumerate(asked_by({w for ws in split for w in ws}, buckets)):
                if i in by_bucket:
                    pairs = zip(*map(unpacked, by_bucket[i]), strict=True)
                else:
                    pairs = answers_to(processor(shipped.value), asked)
                for w, (a, text) in zip(asked, pairs, strict=True):
                    ids[w] = a
                    if text != SAME:
                        others[w] = text.decode()
            for k, ws in zip(held[::2], split, strict=True):
                decoded = " ".join([others.get(w, w) for w in ws] if others else ws)
                out.append((k.decode(), np.frombuffer(b"".join([ids[w] for w in ws]), "<i4"), decoded))
        return pd.DataFrame(out, columns=["k", "ids", "decoded"])

    asked = rows.mapInArrow(requests, "block binary, bucket int, words binary")
    answered = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(segmented, "block binary, bucket int, ids binary, texts binary")
    held = rows.mapInArrow(payloads, "block binary, docs binary")
    joined = held.groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(put_together, "k string, ids array<int>, decoded string")
    return joined.select(F.from_json("k", f"k {kind}")["k"].alias(key), "ids", "decoded")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """Any ids, not only those of texts: ``encoded`` with ``decoded``, the text that the model makes of ``ids``; null and empty ids make an empty text."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = processor(shipped.value)
        for ids in parts:
            yield pd.Series([sp.decode(x.tolist()) if x is not None and len(x) else "" for x in ids], dtype=object)

    return encoded.withColumn("decoded", text_of("ids"))
