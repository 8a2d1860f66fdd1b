"""The audit of filters against plain Python."""

from collections import Counter
from itertools import permutations

import pytest

from convolens.llm import audit
from tests.llm.brute import WORD


def brute_masks(rows):
    """(doc_id, part, mask) of rows with doc_id, text, source."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, s in rows:
        x = t or ""
        w = WORD.findall(x)
        m = (len(w) < 50) + 2 * (100 * len(set(w)) < 65 * len(w)) + 4 * (100 * sum("A" <= c <= "Z" for c in x) > 5 * len(x)) + 8 * any(c in "#$%&*|" for c in x) + 16 * (i is not None and first[x] < i)
        out.append((i, s or "", m))
    return out


def brute_audit(masks, good, toxic):
    bit, out, shap = dict(zip("ABCDE", (1, 2, 4, 8, 16), strict=True)), {}, Counter()
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = sum(bit[x] for x in order[:k])
                gone = [i for i, m in own if m & bit[f] and not m & before]
                shap[part, f] += len(gone)
                out[part, order, k + 1] = [f, sum(not m & (before | bit[f]) for _, m in own), len(gone), sum(bool(m & bit[f] and m & before) for _, m in own), sum(m == bit[f] for _, m in own), sum(i in good for i in gone), sum(i in toxic for i in gone)]
    return {k: tuple(v[1:]) + (shap[k[0], v[0]],) for k, v in out.items()}


def checked(spark, docs, labels):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    masks = brute_masks(rows)
    got = audit.masked(docs)
    assert Counter(map(tuple, got.collect())) == Counter(masks)
    of = labels.collect()
    good, toxic = {r.doc_id for r in of if r.quality == 1 and r.doc_id is not None}, {r.doc_id for r in of if r.toxic == 1 and r.doc_id is not None}
    table = audit.audit(docs, labels)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in table.collect()} == brute_audit(masks, good, toxic)
    return masks


def test_against_brute_force(spark, all_docs, labels):
    """Nulls in all columns, empty and long texts, repeated rows and ids, columns of clashing names."""
    masks = checked(spark, all_docs, labels)
    assert {m & 16 for *_, m in masks} == {0, 16} and "" in {p for _, p, _ in masks}


def test_repeated_and_null_labels(spark, docs, labels):
    more = spark.createDataFrame([(3, 1, 1), (3, 0, None), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    checked(spark, docs, labels.unionByName(more))


def test_equal_hashes_are_told_apart_by_text(spark, docs, monkeypatch):
    """All rows in one part: texts alone decide."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(audit, "with_blocks", lambda rows, text: rows.withColumns({"__length": F.lit(1), **{h: F.lit(0).cast("long") for h in audit.HASHES}}))
    few = docs.filter("doc_id in (3, 7, 60, 61)")
    want = {i for i, _, m in brute_masks([(r.doc_id, r.text, r.source) for r in few.collect()]) if m & 16}
    got = {r.doc_id for r in audit.duplicate_ids(few).collect()}
    assert got == want and want


@pytest.mark.parametrize("blocks", [(), (1,), (3, 5, 7)])
def test_any_cut_into_blocks(spark, docs, monkeypatch, blocks):
    names = [f"__b{i}" for i in range(len(blocks) + 1)]
    for k, v in {"BLOCKS": blocks, "HASHES": names, "PART": ["__length", *names]}.items():
        monkeypatch.setattr(audit, k, v)
    want = {i for i, _, m in brute_masks([(r.doc_id, r.text, r.source) for r in docs.collect()]) if m & 16}
    assert {r.doc_id for r in audit.duplicate_ids(docs).collect()} == want


def test_empty(spark, empty, labels, docs):
    assert audit.audit(empty, labels).collect() == []
    assert audit.audit(docs, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0
