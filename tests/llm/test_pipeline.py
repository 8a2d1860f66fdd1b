"""The corpus pipeline stage by stage against plain Python."""

from collections import Counter

import corpus_pipeline
from convolens.llm import toxicity
from tests.llm import brute


def write(docs, labels, items, folder):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*cols).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return docs.sparkSession.read.parquet(f"{folder}/documents.parquet")


def test_stages(spark, docs, labels, items, tmp_path):
    sf = str(tmp_path / "in")
    now = write(docs, labels, items, sf)
    stages = dict(corpus_pipeline.STAGES)
    scores = {r.doc_id: r.score for r in toxicity.score(now, toxicity.fit(now, labels)).collect()}
    pairs = lambda df: [tuple(r)[:2] for r in df.select("doc_id", "text").collect()]

    out = stages["toxicity"](spark, now, sf).cache()
    assert out.columns == now.columns
    assert Counter(pairs(out)) == Counter(p for p in pairs(now) if scores[p[0]] < 0.7)
    before, out = out, stages["ngram_jaccard"](spark, out, sf).cache()
    stay = {x[0] for x in brute.jaccard(pairs(before)) if x[0] == x[2]}
    assert out.columns == now.columns and {p[0] for p in pairs(out)} == stay
    before, out = out, stages["decontamination"](spark, out, sf).cache()
    bad = {x[0] for x in brute.contamination(pairs(before), [tuple(r) for r in items.collect()]) if x[-1]}
    assert out.columns == now.columns and {p[0] for p in pairs(out)} == {p[0] for p in pairs(before)} - bad
    before, out = out, stages["mixing"](spark, out, sf).cache()
    assert out.columns == now.columns and Counter(pairs(out)) == Counter(pairs(before))
    before, out = out, stages["sharding"](spark, out, sf)
    assert Counter((r.doc_id, r.shard) for r in out.collect()) == Counter((d, brute.jump(d, 40)) for d, _ in pairs(before))

    run = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, r.shard, r.slot) for r in run.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in out.collect())


def test_empty_tables(spark, empty, labels, items, tmp_path):
    sf = str(tmp_path / "in")
    write(empty, labels, items, sf)
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_stages_on_rows_that_break_things(spark, all_docs, labels, items, tmp_path):
    """Null ids, repeated rows, nulls and blanks, columns whose names the operators use themselves."""
    sf = str(tmp_path / "in")
    write(all_docs, labels, items, sf)
    extra = ["block", "mark", "term", "position"]
    out = all_docs.drop("slot", "shard")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, sf).cache()
        assert out.columns == before.columns and out.count() <= before.count()
        assert all(r.term == "t" and r.position == 1.5 for r in out.select(*extra).collect()), name
    assert out.filter("text is null or trim(text) = ''").count() == all_docs.filter("text is null or trim(text) = ''").count()
    last = corpus_pipeline.sharding_stage(spark, out, sf)
    rows = last.collect()
    assert last.columns == [*out.columns, "shard", "grown_shard", "slot"] and len(rows) == out.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
