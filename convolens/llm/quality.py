"""Quality rules with thresholds from mergeable quantile sketches, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.llm.shared import BLANK, keep, let, small, words_of

#: Rules by how their limits follow from a group's sketch: ``fence``, three interquartile ranges beyond the quartiles,
#: on both sides; ``gap``, the middle of the first gap above the bulk of the rows; ``ratio``, of the rows that have the
#: fault at all, the upper quartile as far again as it lies above the lower one, on a logarithmic scale.
RULES = {"word_length": "fence", "symbol_rate": "gap", "dup_line_rate": "ratio", "repeat_rate": "ratio"}
#: The guard: a gap counts above twice the value before it and this share, in tenths of a thousandth.
GUARD = 100


def _repeat_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window found twice or more in the text."""

    def hashes(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]))

    def exact(ws: Column) -> Column:
        grams = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.struct(F.array_join(F.slice(ws, i + 1, n), " ").alias("g"), i.alias("i"))))

        def same(s: Column, x: Column, j: Column) -> Column:
            return F.get(s, j - 1)["g"].eqNullSafe(x["g"]) | F.get(s, j + 1)["g"].eqNullSafe(x["g"])

        places = let(grams, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("last"))
        return F.aggregate(places, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(n), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    # most texts repeat no window, which a set of hashes shows; the others are counted on the words themselves
    return F.when(F.size(words) <= n, F.lit(0)).otherwise(F.when(let(hashes(words), lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(exact(words)))


def features(docs: DataFrame, text: str = "text", keys: list[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """Counts of each whole text; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *keys,
        let(words_of(t), lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("rep"))).alias("w"),
        F.length(F.regexp_replace(t, BLANK, "")).alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
    )
    long = lambda c: F.col(c).cast("long")
    return counted.select(*keys, long("w.n").alias("n_words"), long("word_chars").alias("word_chars"), long("n_symbols").alias("n_symbols"), long("l.dup").alias("n_dup_lines"), long("w.rep").alias("n_repeat_words"), long("l.n").alias("n_lines"))


def _rates() -> dict[str, Column]:
    """Each rule's whole number: hundredths of a character a word, and shares in tenths of a thousandth."""
    per = lambda a, b, k: F.floor(F.col(a) * k / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {"word_length": per("word_chars", "n_words", 100), "symbol_rate": per("n_symbols", "word_chars", 10000), "dup_line_rate": per("n_dup_lines", "n_lines", 10000), "repeat_rate": per("n_repeat_words", "n_words", 10000)}


def _bin(v: Column) -> Column:
    """Log-linear bin of a whole number: 32 bins for each power of two from 64 on, one each below."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * shift + F.expr("0")).cast("long") + F.floor(v / F.pow(F.lit(2.0), shift)).cast("long")


def _bin_floor(b: Column) -> Column:
    shift = F.greatest(F.floor(b / 32) - 1, F.lit(0))
    return ((b - 32 * shift) * F.pow(F.lit(2.0), shift)).cast("long")


def sketch(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rule, bin, n): a quantile sketch of each rule in each group.

    Counts in fixed log-linear bins: two sketches merge by adding counts, in any order
    and with the same result, and a quantile is off by at most 1/32 of its value.
    """
    long = measured.select(*groups, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _bin(F.col(r)).alias("bin")) for r in RULES])).alias("x"))
    return long.groupBy(*groups, "x.rule", "x.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "rule", "bin").agg(F.sum("n").alias("n"))


def limits(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, rule, rows, low, high): a group's limits, null where a side has none, and how many rows they are drawn from.

    All limits are made of the sketch's own values: twice the values give twice the limits.
    """
    kind = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("rule")]
    over = W.partitionBy(*groups, "rule")
    some = sketches.withColumn("kind", kind).filter((F.col("kind") != "ratio") | (F.col("bin") > 0)).withColumn("value", _bin_floor(F.col("bin")))
    run = some.withColumn("upto", F.sum("n").over(over.orderBy("bin"))).withColumn("rows", F.sum("n").over(over)).withColumn("next", F.lead("value").over(over.orderBy("bin")))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("value")))
    gap = F.when((F.col("upto") * 100 >= F.col("rows") * 75) & (F.col("next") > 2 * F.col("value") + GUARD), F.struct("value", "next"))
    sides = run.groupBy(*groups, "rule", "kind").agg(F.max("rows").alias("rows"), at(25).alias("q1"), at(75).alias("q3"), F.min(gap).alias("gap"))
    q1, q3 = F.col("q1"), F.col("q3")
    reach = F.greatest(3 * (q3 - q1), F.floor(q3 / 3))
    middle = F.floor((F.col("gap.value") + F.col("gap.next")) / 2)
    far = F.floor(q3 * q3 / q1)
    high = F.when(F.col("kind") == "fence", q3 + reach).when(F.col("kind") == "gap", middle).otherwise(far).cast("long")
    return sides.select(*groups, "rule", "rows", F.when(F.col("kind") == "fence", q1 - reach).cast("long").alias("low"), high.alias("high"))


def thresholds(measured: DataFrame, min_rows: int = 100) -> DataFrame:
    """(lang, source, rule, low, high), from the sketch of the language and source.

    Limits that are drawn from fewer than ``min_rows`` rows say little; the group then takes those
    of the merged sketch of its language, and if these are too, those of all rows.
    """
    fine = keep(sketch(measured, ["lang", "source"]), "sketch")
    groups = fine.select("lang", "source").distinct().crossJoin(F.broadcast(fine.select("rule").distinct()))  # at most four rules
    levels = []
    for i, by in enumerate((["lang", "source"], ["lang"], [])):
        own = limits(fine if i == 0 else merge(fine, by), by)
        levels.append((i, by, own.select(*[F.col(c).alias(f"{c}{i}") for c in own.columns])))
    chosen = groups
    for i, by, own in levels:
        on = F.col("rule") == F.col(f"rule{i}")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"{c}{i}"))
        chosen = chosen.join(own, on, "left")
    pick = lambda side: F.when(F.col("rows0") >= min_rows, F.col(side + "0")).when(F.col("rows1") >= min_rows, F.col(side + "1")).otherwise(F.col(side + "2"))
    return chosen.select("lang", "source", "rule", pick("low").alias("low"), pick("high").alias("high"))


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document its counts, ``base_failed`` and ``kept``; columns as the query op1 has them, and lang, source, n_lines.

    A text is kept if the base rule passes it and each rule's value lies within the limits of
    its language and source, which come from the texts that the base rule passes. Empty and null texts have zero words and fail the base rule.
    Texts of any length are counted whole. A null language or source is a group of its own;
    they may be of any type that has equality. Rows with equal ids are judged each by itself. An
    empty table gives an empty one. Other columns of ``docs`` are not looked at.
    """
    measured = keep(features(docs, text).withColumns(_rates()), "features")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    wide = thresholds(measured.filter(~failed)).groupBy(F.col("lang").alias("__l"), F.col("source").alias("__s")).agg(*[F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"{r}_{side}") for r in RULES for side in ("low", "high")])
    joined = measured.join(small(keep(wide, "limits")), F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    good = F.lit(True)
    for r in RULES:
        good = good & F.coalesce(F.col(r) <= F.col(f"{r}_high"), F.lit(True)) & F.coalesce(F.col(r) >= F.col(f"{r}_low"), F.lit(True))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & good).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "kept"
    )
