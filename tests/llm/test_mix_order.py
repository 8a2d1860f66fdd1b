"""The shards of the pipeline follow the mix."""

import corpus_pipeline
from convolens.llm.mixing import mix


def test_slots_follow_the_mix(spark):
    """Half of the rows are of one source; in the first fifth of a shard, equal weights show and not the raw share."""
    rows = [(i, f"text {i}", "en", "hot" if i % 2 else f"s{i % 10}", 8) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    out = stages["sharding"](spark, stages["mixing"](spark, docs, ""), "")
    assert out.columns == [*docs.columns, "shard", "grown_shard", "slot"]
    at = {r.doc_id: r.position for r in mix(docs, ties=["n_chars", "text"]).collect()}
    shards = {}
    for r in out.collect():
        shards.setdefault(r.shard, []).append((r.slot, at[r.doc_id], r.source))
    early = []
    for x in shards.values():
        x.sort()
        assert [s for s, *_ in x] == list(range(len(x)))
        assert [p for _, p, _ in x] == sorted(p for _, p, _ in x)
        early += [s for *_, s in x[: len(x) // 5]]
    # weights are the square roots of the rows: 3000 against five times 600
    assert abs(early.count("hot") / len(early) - 3000**0.5 / (3000**0.5 + 5 * 600**0.5)) < 0.05
