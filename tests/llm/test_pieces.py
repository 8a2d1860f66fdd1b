"""Encoding by a table of words against the library's own encoding of whole texts."""

import random

import pytest
import sentencepiece

from convolens.llm import pieces

SCHEMA = "doc_id long, text string, ids string, k string"


@pytest.fixture(scope="module")
def path():
    return pieces.public_model("piece_bpe_32k.model")


def texts():
    r = random.Random(3)
    signs = ["a", "the", "ing", " ", "  ", "    ", "\n", "\t", "▁", "é", "ß", "ﬁ", "é", "　", " ", "😀", "漢字", "\x00", "\x7f", "<s>", "</s>", "<unk>", "<0x0A>", ".", "0", "#", "﻿", "‍"]
    made = ["".join(r.choices(signs, k=r.randint(1, 40))) for _ in range(400)]
    return [None, "", " ", "▁", "  ", "a ", " a", *made, "x" * 20000, "ab " * 30000, " " * 5000, made[3], made[3]]


def test_equals_whole_encoding(spark, path):
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.read_model(path)
    rows = [(None if i % 50 == 7 else i // 2, t, "clash", "clash") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = pieces.encode(docs, model)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = [(k, sp.encode(t or "")) for k, t, *_ in rows]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in got.collect()), key=order) == sorted(((k, ids, sp.decode(ids) if ids else "") for k, ids in want), key=order)


def test_small_blocks_and_strings_as_keys(spark, path, monkeypatch):
    """Many blocks and one-bucket tables give the same ids; keys may be strings."""
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.read_model(path)
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 50)
    rows = [(f'"{i}" é', t) for i, t in enumerate(texts()[:200])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)
    assert {r.doc_id: r.ids for r in pieces.encode(docs, model).collect()} == {k: sp.encode(t or "") for k, t in rows}


def test_each_word_is_segmented_once(spark, path):
    """Requests name a word once a block, and answers hold it once however often it stands in the texts."""
    block = pieces.Block()
    for i in range(100):
        block.add(b"%d" % i, "to be or not to be")
    assert sum(map(len, pieces.asked_by(block.distinct(), 7))) == len(block.distinct()) == 4
    assert all(" ".join(pieces.words(t or "")) == (t or "").replace("▁", " ") for t in texts())


def test_any_ids_are_decoded(spark, path):
    """Also ids that no text is encoded to: bytes out of order, specials, none."""
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path), pieces.read_model(path)
    r = random.Random(4)
    ids = [[r.randrange(sp.get_piece_size()) for _ in range(r.randint(0, 30))] for _ in range(200)] + [[0, 1, 2], [200, 201, 5], None]
    got = pieces.decode(spark.createDataFrame(list(enumerate(ids)), "k long, ids array<int>"), model)
    assert {x.k: x.decoded for x in got.collect()} == {i: sp.decode(x) if x else "" for i, x in enumerate(ids)}


def test_empty_and_refused(spark, path, tmp_path):
    model = pieces.read_model(path)
    empty = spark.createDataFrame([], SCHEMA)
    assert pieces.encode(empty, model).collect() == []
    lists = pieces.unpacked(pieces.packed([b"", b"a", b"\x00" * 9]))
    assert lists == [b"", b"a", b"\x00" * 9] and pieces.unpacked(pieces.packed([])) == []
    (tmp_path / "no.model").write_bytes(b"no model")
    with pytest.raises(Exception):  # noqa: B017
        pieces.read_model(str(tmp_path / "no.model"))
