"""Evaluation: signals of windows, samples of candidates, recall and its errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.operators import ranges

DAY, LONE = 86_400, 9999.0
Z = 1.96


def temporal_isolation(chunks: DataFrame) -> DataFrame:
    """Add ``isolation``: days to the nearer neighbour in the chat; a lone window has 9999."""
    w = W.partitionBy("chat_id").orderBy("start_ts", "chunk_id")
    near = F.least(F.col("start_ts") - F.lag("start_ts").over(w), F.lead("start_ts").over(w) - F.col("start_ts"))
    return chunks.withColumn("isolation", F.coalesce(near / DAY, F.lit(LONE)))


def within_a_day(chunks: DataFrame) -> DataFrame:
    """Add ``n_24h``: windows of the chat that start up to a day before or after, itself too."""
    w = W.partitionBy("chat_id").orderBy(F.col("start_ts")).rangeBetween(-DAY, DAY)
    return chunks.withColumn("n_24h", F.count("*").over(w))


def rank_share(df: DataFrame, value: str, out: str, skip: float | None = None) -> DataFrame:
    """Add the share of values below; values equal to ``skip`` count for none and get 1.

    Counted by value first, then over ranges of values.
    """
    counted = df.filter(F.col(value) != skip) if skip is not None else df
    sizes = counted.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    every = sizes.agg(F.sum("__n").alias("__all"))
    below = ranges.summed_before(sizes, "__v", F.col("__n"), "__b").crossJoin(F.broadcast(every)).select("__v", "__b", "__all")
    return df.join(below, F.col(value) == F.col("__v"), "left").withColumn(out, F.coalesce(F.col("__b") / F.col("__all"), F.lit(1.0))).drop("__v", "__b", "__all")


def quartile_bands(df: DataFrame, value: str, out: str, closed: bool = False) -> DataFrame:
    """Add the band 0 to 3 by the values that stand at n//4, n//2 and 3n//4 of the sorted ones; nulls have none. ``closed``: such a value is in the band below."""
    sizes = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    every = sizes.agg(F.sum("n").alias("all"))
    run = ranges.summed_before(sizes, "v", F.col("n"), "before").crossJoin(F.broadcast(every)).withColumn("upto", F.col("before") + F.col("n"))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("all") * q / 4), F.col("v")))
    cuts = run.agg(at(1).alias("__q1"), at(2).alias("__q2"), at(3).alias("__q3"))
    v = F.col(value)
    below = (lambda q: v <= F.col(q)) if closed else (lambda q: v < F.col(q))
    band = F.when(v.isNull(), None).when(below("__q1"), 0).when(below("__q2"), 1).when(below("__q3"), 2).otherwise(3)
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, band).drop("__q1", "__q2", "__q3")


def minmax(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the value between the least and the greatest as 0 to 1; 0.5 if they are the same."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), 0.5).otherwise((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, scaled).drop("__lo", "__hi")


def length_penalty(tokens: Column) -> Column:
    return F.when(tokens < 150, (150 - tokens) / 150).when(tokens > 600, (tokens - 600) / 600).otherwise(0.0)


def candidate_scores(df: DataFrame) -> DataFrame:
    """Add ``score`` from nn_band, idf_mean, entity_count and token_count."""
    both = minmax(minmax(df, "idf_mean", "__i"), "entity_count", "__e")
    return both.withColumn("score", F.coalesce(F.col("nn_band"), F.lit(0)) / 3 + F.col("__i") + F.col("__e") - length_penalty(F.col("token_count"))).drop("__i", "__e")


def category() -> Column:
    """The first that fits of six kinds of question. The kinds, their order and their bounds."""
    yes = lambda c: F.col(c).cast("int") == 1
    return (F.when(yes("has_geo") | yes("has_attachment"), "media_geo").when(yes("has_url") | yes("has_long_token"), "exact_string")
            .when(yes("is_group") & (F.col("participant_count") >= 3), "person_filtered").when(F.col("isolation_share") >= 0.8, "time_filtered")
            .when(F.col("n_24h") >= 3, "multi_session").otherwise("topical"))


def middle(df: DataFrame, value: str) -> float | None:
    """The median without a task that holds all values: counts by value, summed over ranges."""
    sizes = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    n = sizes.agg(F.sum("n")).first()[0]
    if not n:
        return None
    upto = F.col("before") + F.col("n")
    run = ranges.summed_before(sizes, "v", F.col("n"), "before")
    low, high = run.agg(F.min(F.when(upto > (n - 1) // 2, F.col("v"))), F.min(F.when(upto > n // 2, F.col("v")))).first()
    return (low + high) / 2


def prefilter(df: DataFrame, target: int = 5000, low: int = 40, high: int = 900) -> DataFrame:
    """chunk_id of windows worth a costly signal, of fit length: all if they are few; the first by idf with idf from the median on and two names; the first by idf alone if such are too few."""
    band = df.filter(F.col("token_count").between(low, high))
    mid = middle(band, "idf_mean")
    good = (F.col("idf_mean") >= F.lit(mid)) & (F.col("entity_count") >= 2)
    n, fit = band.agg(F.count("*"), F.count_if(good)).first()
    if n <= target:
        return band.select("chunk_id")
    if fit >= target:
        return band.filter(good).orderBy(F.desc("idf_mean"), F.desc("entity_count"), "chunk_id").limit(target).select("chunk_id")
    return band.orderBy(F.desc("idf_mean"), "chunk_id").limit(target).select("chunk_id")


def stratified(df: DataFrame, target: int = 300, shares: dict[int, float] | None = None) -> DataFrame:
    """The best of each stratum up to its share: band 0 30 %, the middle 40 %, band 3 30 %."""
    shares = shares or {0: 0.3, 1: 0.4, 2: 0.3}
    part = F.when(F.col("nn_band") == 0, 0).when(F.col("nn_band") == 3, 2).otherwise(1)
    want = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (k, round(target * v))])
    ranked = df.withColumn("stratum", part).withColumn("r", F.row_number().over(W.partitionBy("stratum").orderBy(F.desc("score"), "chunk_id")))
    return ranked.filter(F.col("r") <= want[F.col("stratum")]).drop("r")


def every_nth(df: DataFrame, n: int, *order: str) -> DataFrame:
    return ranges.numbered(df, *order, out="__i").filter(F.col("__i") % n == 0).drop("__i")


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The interval of a share, cut to 0 and 1; null without cases."""
    p = hits / n
    mid, half, size = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    none = n == 0
    return F.when(~none, F.greatest(F.lit(0.0), (mid - half) / size)), F.when(~none, F.least(F.lit(1.0), (mid + half) / size))


def mcnemar(only_a: Column, only_b: Column) -> Column:
    return F.when(only_a + only_b > 0, (only_a - only_b) * (only_a - only_b) / (only_a + only_b))


def entry_recall(entries: DataFrame, found: DataFrame, depths: dict[str, int]) -> DataFrame:
    """Add a 0/1 column a depth: whether a positive (entry_id, chunk_id) is in the first places of ``found`` (entry_id, chunk_id, rank)."""
    hit = entries.select("entry_id", F.explode("positives").alias("chunk_id")).join(found, ["entry_id", "chunk_id"])
    best = hit.groupBy("entry_id").agg(F.min("rank").alias("best"))
    return entries.join(best, "entry_id", "left").select(*entries.columns, *[F.coalesce(F.col("best") <= d, F.lit(False)).cast("int").alias(n) for n, d in depths.items()])


def recall_summary(scored: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Recall by category and OVERALL, with its interval for each depth."""
    g = scored.rollup(by).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"{c}_hits") for c in columns])
    out = g.withColumn(by, F.coalesce(by, F.lit("OVERALL")))
    for c in columns:
        lo, hi = wilson(F.col(f"{c}_hits"), F.col("n"))
        out = out.withColumn(c, F.col(f"{c}_hits") / F.col("n")).withColumn(f"{c}_low", lo).withColumn(f"{c}_high", hi)
    return out


def recall_report(scored: DataFrame, by: str, depths: list[str], value: str | None = None, killed: str | None = None) -> DataFrame:
    """(facet, label, n, a column a depth with its interval, gaps, kill_rate): recall by category, by quartile band and over all, in one pass.

    ``depths``: 0/1 columns, in the order of the steps of a search; gap1 is the second's recall less the
    first's, and so on. ``value``: what the bands Q1 to Q4 are of, its quartiles in the band below; rows
    without it are in no band. ``killed``: 0/1, whether filters left no right answer (null: not).
    """
    rows = quartile_bands(scored, value, "__band", closed=True) if value else scored.withColumn("__band", F.lit(None).cast("int"))
    hits = [F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(f"{c}_hits") for c in depths]
    kills = F.coalesce(F.sum(F.col(killed).cast("int")), F.lit(0)) if killed else F.lit(0)
    label = F.col(by).cast("string")
    sets = rows.select(label.alias("__by"), "__band", *depths, *([killed] if killed else [])).groupingSets([["__by"], ["__band"], []], "__by", "__band")
    g = sets.agg(F.grouping("__by").alias("no_by"), F.grouping("__band").alias("no_band"), F.count("*").alias("n"), *hits, kills.alias("kills"))
    facet = F.when(F.col("no_by") == 0, "category").when(F.col("no_band") == 0, "band").otherwise("overall")
    name = F.when(F.col("no_by") == 0, F.col("__by")).when(F.col("no_band") == 0, F.concat(F.lit("Q"), F.col("__band") + 1)).otherwise("OVERALL")
    out = g.withColumn("facet", facet).withColumn("label", name).filter("facet != 'band' or label is not null")
    for c in depths:
        low, high = wilson(F.col(f"{c}_hits"), F.col("n"))
        out = out.withColumn(c, F.when(F.col("n") > 0, F.col(f"{c}_hits") / F.col("n"))).withColumn(f"{c}_low", low).withColumn(f"{c}_high", high)
    gaps = [(F.col(b) - F.col(a)).alias(f"gap{i}") for i, (a, b) in enumerate(zip(depths, depths[1:], strict=False), 1)]
    shares = [x for c in depths for x in (c, f"{c}_low", f"{c}_high")]
    return out.select("facet", "label", "n", *shares, *gaps, F.when(F.col("n") > 0, F.col("kills") / F.col("n")).alias("kill_rate"))


def outcomes(results: DataFrame, by: str, outcome: str, kinds: list[str]) -> DataFrame:
    """(by, a column a kind, n, rate): how often each outcome came, one row a class; the rate is of the first kind among those of ``kinds``. Other outcomes, nulls too, count nowhere."""
    counts = results.filter(F.col(outcome).isin(kinds)).groupBy(by).pivot(outcome, kinds).count().na.fill(0, kinds)
    n = sum((F.col(k) for k in kinds), F.lit(0))
    return counts.withColumn("n", n).withColumn("rate", F.col(kinds[0]) / F.col("n"))


def compare_metrics(a: DataFrame, b: DataFrame, on: list[str], metrics: list[str], by: str | None = None) -> DataFrame:
    """(metric, label, n, mean_a, mean_b, delta, low, high, a_better, b_better, chi2): two targets on the same cases, all metrics in one pass.

    ``a``, ``b``: the columns ``on`` (together a case), a column a metric (number or boolean; greater is
    better) and in ``a`` also ``by``. A case counts for a metric if both targets have a value. The interval is
    of the mean paired difference, null for one case; chi2 is McNemar's over the cases that differ, null without any.
    Rows by ``by``, and OVERALL.
    """
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    x = a.select(*on, group.alias("label"), *[F.col(m).cast("double").alias(f"__a{i}") for i, m in enumerate(metrics)])
    y = b.select(*on, *[F.col(m).cast("double").alias(f"__b{i}") for i, m in enumerate(metrics)])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"__a{i}").alias("a"), F.col(f"__b{i}").alias("b")) for i, m in enumerate(metrics)])
    long = x.join(y, on).select("label", F.inline(pairs)).filter("a is not null and b is not null")
    sets = [["metric", "label"], ["metric"]] if by else [["metric"]]
    d = F.col("b") - F.col("a")
    g = long.groupingSets(sets, "metric", "label").agg(
        F.grouping("label").alias("all"), F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("delta"),
        (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count_if(d < 0).alias("a_better"), F.count_if(d > 0).alias("b_better"),
    )
    label = F.when(F.col("all") == 1, "OVERALL").otherwise(F.col("label"))
    low, high = F.col("delta") - Z * F.col("se"), F.col("delta") + Z * F.col("se")
    return g.select("metric", label.alias("label"), "n", "mean_a", "mean_b", "delta", low.alias("low"), high.alias("high"), "a_better", "b_better", mcnemar(F.col("a_better"), F.col("b_better")).alias("chi2"))


def latency_summary(runs: DataFrame) -> DataFrame:
    """(class, n, p50, p95, longest, rate): ``runs`` has class, seconds and passed (null: not judged)."""
    return runs.groupBy("class").agg(F.count("*").alias("n"), F.median("seconds").alias("p50"), F.percentile("seconds", F.lit(0.95)).alias("p95"), F.max("seconds").alias("longest"), F.avg(F.col("passed").cast("int")).alias("rate"))


def oracle_metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(case_id, n_found, n_truth, precision, recall). Both: (case_id, msg_id)."""
    f, t = found.distinct().withColumn("f", F.lit(1)), truth.distinct().withColumn("t", F.lit(1))
    both = f.join(t, ["case_id", "msg_id"], "full").groupBy("case_id").agg(F.count("f").alias("n_found"), F.count("t").alias("n_truth"), F.count(F.col("f") + F.col("t")).alias("both"))
    return both.select("case_id", "n_found", "n_truth", F.when(F.col("n_found") > 0, F.col("both") / F.col("n_found")).alias("precision"), F.when(F.col("n_truth") > 0, F.col("both") / F.col("n_truth")).alias("recall"))


def payload_checks() -> dict[str, Column]:
    """Invariants of nested sessions (hit_messages, context_messages, day, score), each true, false or null where it does not apply."""
    ids = lambda c: F.transform(c, lambda m: m["msg_id"])
    ordered = lambda c: F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.coalesce(F.get(c, i - 1)["ts"] <= F.get(c, i)["ts"], F.lit(True)))
    h, c = F.col("hit_messages"), F.col("context_messages")
    return {
        "has_hits": F.size(h) > 0,
        "hits_distinct": F.size(F.array_distinct(ids(h))) == F.size(h),
        "context_distinct": F.size(F.array_distinct(ids(c))) == F.size(c),
        "no_overlap": ~F.arrays_overlap(ids(h), ids(c)),
        "hits_in_order": ordered(h),
        "context_in_order": F.when(F.size(c) > 0, ordered(c)),
        "own_messages_unnamed": F.forall(h, lambda m: ~m["is_from_me"] | m["sender"].isNull()),
        "some_content": F.forall(h, lambda m: m["has_attachment"] | (F.trim(F.coalesce(m["text"], F.lit(""))) != "")),
    }


def compare_targets(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """Paired results of two targets: both, only one, neither, the difference and McNemar's statistic."""
    x = a.select(on, F.col(value).cast("int").alias("a")).join(b.select(on, F.col(value).cast("int").alias("b")), on)
    n = x.agg(F.count("*").alias("n"), F.sum("a").alias("a_hits"), F.sum("b").alias("b_hits"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
    return n.withColumn("delta", (F.col("b_hits") - F.col("a_hits")) / F.col("n")).withColumn("chi2", mcnemar(F.col("only_a"), F.col("only_b")))


def answer_checks(answer: DataFrame, parsed, expected: dict | None = None) -> DataFrame:
    """One row of checks of a whole answer (its sessions), each true, false or null where it does not apply.

    ``parsed``: the ParsedQuery that was answered. ``expected``: what the question was made to
    have, as far as it is known: handles, sender (a name), date, from_me, media, results, words.
    """
    e, hits = expected or {}, F.col("hit_messages")
    every = lambda ok: F.bool_and(F.forall(hits, ok))
    given = lambda key, ok: F.lit(bool(ok)) if e.get(key) else F.lit(None).cast("boolean")
    where = lambda applies, c: c if applies else F.lit(None).cast("boolean")
    name = lambda m: F.lower(F.coalesce(m["sender"], F.lit("")))
    low = (e.get("sender") or "").lower()
    others = F.flatten(F.collect_list(F.transform(F.filter(hits, lambda m: ~m["is_from_me"]), name)))
    texts = F.concat(hits, F.col("context_messages"))
    newest = F.array_max(F.transform(hits, lambda m: m["ts"]))
    order = F.array_sort(F.collect_list(F.struct(F.col("place") if "place" in answer.columns else F.lit(0), newest.alias("newest"))))
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.size(order) - 1, F.lit(1))), lambda i: F.coalesce(F.get(order, i - 1)["newest"] >= F.get(order, i)["newest"], F.lit(True)))
    dated = parsed.date_from is not None or parsed.date_to is not None
    inside = lambda m: (m["ts"] >= (parsed.date_from if parsed.date_from is not None else float("-inf"))) & (m["ts"] <= (parsed.date_to if parsed.date_to is not None else float("inf")))
    people = {h.lower() for h in (*parsed.senders, *parsed.participants)}
    recent = F.bool_and(F.col("ordering") == "recent")
    return answer.agg(
        given("handles", people & {h.lower() for h in e.get("handles", [])}).alias("person_filter_applied"),
        where(low, every(lambda m: m["is_from_me"] | name(m).contains(low) | F.lit(low).contains(name(m)))).alias("sender_is_expected"),
        given("date", dated).alias("date_filter_applied"),
        given("from_me", parsed.from_me).alias("self_filter_applied"),
        given("media", parsed.has_media).alias("media_filter_applied"),
        where(e.get("results"), F.count("*") > 0).alias("nonempty"),
        F.bool_and(F.size(hits) > 0).alias("no_empty_sessions"),
        where(parsed.senders, every(lambda m: ~m["is_from_me"])).alias("no_self_in_sender"),
        where(parsed.senders, F.size(F.array_distinct(others)) <= 1).alias("sender_purity"),
        where(dated, every(inside)).alias("date_containment"),
        F.when(recent & (F.count("*") > 1) & F.lit("place" in answer.columns), falling).alias("recency_session_order"),
        F.bool_and(F.size(F.array_distinct(F.transform(hits, lambda m: m["msg_id"]))) == F.size(hits)).alias("hits_distinct"),
        where(e.get("words"), F.bool_or(F.exists(texts, lambda m: F.lower(F.coalesce(m["text"], F.lit(""))).contains(str(e.get("words")).lower())))).alias("lexical_presence"),
        F.bool_and((F.col("n_messages_since_index") >= 0) & ((F.col("n_messages_since_index") > 0) == F.col("index_stale"))).alias("freshness_declared"),
        F.bool_and(F.col("ordering").isin("recent", "relevance")).alias("ordering_declared"),
    )


def newest_metrics(found: DataFrame, truth: DataFrame, members: DataFrame, horizon: float | None = None, head: int = 20) -> DataFrame:
    """(case_id, precision, recall_top, newest_present, newest_is_indexed, indexed_coverage) of questions whose answer can be computed.

    ``found``: (case_id, msg_id). ``truth``: (case_id, msg_id, ts), all that a perfect answer may
    have. ``members``: msg_id of indexed messages. Recall is over the newest ``head`` that the
    index has, as older ones are on later pages and others can't be ranked; with ``horizon`` truth
    beyond it only counts for newest_is_indexed. Cases without truth have no row.
    """
    by = W.partitionBy("case_id").orderBy(F.desc("ts"), F.desc("msg_id"))
    t = truth.distinct().withColumn("first", F.row_number().over(by))
    indexed = (F.col("ts") <= horizon).cast("double") if horizon is not None else F.lit(None).cast("double")
    newest = t.filter("first = 1").select("case_id", indexed.alias("newest_is_indexed"))
    t = t.filter(F.col("ts") <= horizon).withColumn("first", F.row_number().over(by)) if horizon is not None else t
    known = t.join(members.select("msg_id").distinct().withColumn("held", F.lit(1)), "msg_id", "left")
    got = found.select("case_id", "msg_id").distinct().withColumn("got", F.lit(1))
    both = known.join(got, ["case_id", "msg_id"], "left")
    top = F.col("first") <= head
    held = F.count_if(top & F.col("held").isNotNull())
    sums = both.groupBy("case_id").agg(
        F.count("got").alias("right"),
        (held / F.count_if(top)).alias("indexed_coverage"),
        F.when(held > 0, F.count_if(top & F.col("held").isNotNull() & F.col("got").isNotNull()) / held).otherwise(F.count_if(top & F.col("got").isNotNull()) / F.count_if(top)).alias("recall_top"),
        F.max(F.when(F.col("first") == 1, F.coalesce("got", F.lit(0)))).cast("double").alias("newest_present"),
    )
    n = got.groupBy("case_id").agg(F.count("*").alias("n"))
    out = newest.join(sums, "case_id", "left").join(n, "case_id", "left")
    precision = F.when(F.coalesce("n", F.lit(0)) > 0, F.coalesce("right", F.lit(0)) / F.col("n")).otherwise(0.0)
    return out.select("case_id", precision.alias("precision"), "recall_top", "newest_present", "newest_is_indexed", "indexed_coverage")


def filter_kill(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(n, killed, rate): questions none of whose positives the filters let through. ``entries``: entry_id, positives; ``candidates``: (entry_id, chunk_id)."""
    left = entries.select("entry_id", F.explode("positives").alias("chunk_id")).join(candidates, ["entry_id", "chunk_id"], "left_semi").select("entry_id").distinct()
    lost = entries.join(left.withColumn("kept", F.lit(1)), "entry_id", "left")
    return lost.agg(F.count("*").alias("n"), F.count_if(F.col("kept").isNull()).alias("killed")).withColumn("rate", F.when(F.col("n") > 0, F.col("killed") / F.col("n")))
