"""Whole repeated passages of lines against plain Python."""

from collections import Counter

from convolens.llm import queries
from convolens.llm.linededup import dedup_passages
from tests.llm import brute


def passages(docs, long_words=50):
    """(id, text, removed lines) with each line gone that lies in a piece that stands before, apart from its first copy."""
    none_first = lambda d: (d[0] is not None, d[0] or 0, brute.spark_xxhash(d[1] or ""))

    def pieces(t):
        l = t.split("\n")
        yield from ((i, 2, (l[i], l[i + 1])) for i in range(len(l) - 1))
        yield from ((i, 1, (x,)) for i, x in enumerate(l) if len(x.split()) > long_words)

    first, out = {}, {}
    for d, t in sorted({d for d in docs if d[1] is not None}, key=none_first):
        for i, n, x in pieces(t):
            first.setdefault(x, (d, t, i))
    for d, t in set(docs):
        gone = set()
        for i, n, x in pieces(t) if t is not None else ():
            at = first[x]
            if at != (d, t, i) and not (at[:2] == (d, t) and i < at[2] + n):
                gone |= set(range(i, i + n))
        out[d, t] = ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone) if gone else t, len(gone))
    return [(d, *out[d, t]) for d, t in docs]


def test_all_rows(all_docs, empty):
    got = Counter((r.doc_id, r.text, r.removed_lines) for r in dedup_passages(all_docs).collect())
    assert got == Counter(passages([(r.doc_id, r.text) for r in all_docs.collect()]))
    assert dedup_passages(empty).count() == 0


def test_short_passages_go_whole(spark, tmp_path):
    """Each of 40 passages of two to five lines, and a line of 60 words, goes from a host text with its first and last line."""
    cut = [[f"passage {k} line {i}" for i in range(2 + k % 4)] for k in range(40)] + [[" ".join(f"w{i}" for i in range(60))]]
    rows = [(k, "\n".join([f"before {k}", *p, f"after {k}"])) for k, p in enumerate(cut)]
    rows += [(100 + k, "\n".join([f"host {k}", *p, f"tail {k}"])) for k, p in enumerate(cut)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {**{k: 0 for k in range(len(cut))}, **{100 + k: len(p) for k, p in enumerate(cut)}}


def test_chunks_with_no_line_left(spark):
    t = "\n".join(f"line {i}" for i in range(30))
    r = {x.doc_id: x for x in dedup_passages(spark.createDataFrame([(1, t), (2, t)], "doc_id long, text string")).collect()}
    assert (r[1].text, r[1].removed_chunks) == (t, 0)
    assert (r[2].text, r[2].removed_lines, r[2].removed_chunks) == ("", 30, r[2].n_chunks)
