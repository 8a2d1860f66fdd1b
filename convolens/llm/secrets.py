"""Secret scans with multipart credential linking, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.shared import keep, let

#: kind: (order among spans that start together, role, pattern, group whose length counts, least length).
BASE = {
    "assign": (0, "secret", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    "access": (1, "identity", r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (2, "secret", r"[0-9a-f]{32,}", 0, 32),
}
#: Parts that say nothing alone.
WEAK = {
    "ident": (3, "identity", r"(?i)(?:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]+)", 1, 3),
    "opaque": (4, "secret", r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_.-])", 0, 20),
    "endpoint": (5, "endpoint", r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+", 0, 10),
}
#: What must stand in a weak part's scope for it to be reported.
NEEDS = {"ident": ["secret"], "opaque": ["identity"], "endpoint": ["identity", "secret"]}
#: A cheap test that a text must pass before a kind's pattern is tried; all are true of every text that the pattern is found in.
HINTS = {
    "assign": lambda t, low: low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey"),
    "access": lambda t, low: t.contains("AKIA"),
    "hex": lambda t, low: t.rlike("[0-9a-f]{32}"),
    "ident": lambda t, low: low.contains("user") | low.contains("login") | low.contains("account") | low.contains("client"),
    "opaque": lambda t, low: t.rlike("[A-Za-z0-9+/_-]{20}"),
    "endpoint": lambda t, low: t.contains("://"),
}
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,role:string>>"


def _spans(text: Column, low: Column, kind: str) -> Column:
    """Spans of a kind by start: the matches' lengths and those of the pieces between them give the places."""
    rank, role, pattern, group, least = (BASE | WEAK)[kind]
    p = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern).alias("piece"), F.regexp_extract_all(text, p, F.lit(0)).alias("match"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), F.lit(role).alias("role")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    walk = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"])
    return F.when(HINTS[kind](text, low), walk).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def link_parts(parts: DataFrame, keys: list[str], scope: int = 200) -> DataFrame:
    """The weak parts whose scope holds the parts they need: an interval join on bins.

    ``parts``: keys, start, rank, end, kind, role. A weak part reaches ``scope`` code
    points to both sides; it is dealt to each bin of that reach and meets what lies in
    the bin. A bin of ``scope`` code points holds few parts of a kind, as they do not overlap.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = parts.filter(F.col("kind").isin(list(NEEDS))).withColumn("bin", bins(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope))
    other = parts.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    other = other.withColumn("o_bin", bins(F.col("o_start"), F.col("o_end")))
    on = F.col("bin") == F.col("o_bin")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    on = on & (F.col("role") != F.col("o_role")) & (F.col("o_start") <= F.col("end") + scope) & (F.col("o_end") >= F.col("start") - scope)
    met = weak.join(other, on).groupBy(*keys, "start", "rank", "end", "kind", "role").agg(F.collect_set("o_role").alias("near"))
    enough = F.lit(False)
    for kind, needs in NEEDS.items():
        enough = enough | ((F.col("kind") == kind) & (F.size(F.array_intersect("near", F.array(*map(F.lit, needs)))) == len(needs)))
    return met.filter(enough).drop("near")


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = 200) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, ``base`` and ``spans``, arrays of (start, rank, end, kind, role) by start.

    Places are code points, ends exclusive. ``spans`` has the base spans, and the weak
    parts (ident, opaque, endpoint) that complementary parts stand beside. A null or
    empty text has none. Rows with one id and one text are linked together, which
    changes nothing; rows with one id and other texts stay apart. Other columns are not looked at.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    raw = docs.select(F.col(key), F.xxhash64(t).alias("mark"), t.alias("t"), F.lower(t).alias("low"))
    found = raw.select(key, "mark", *[_spans(F.col("t"), F.col("low"), k).alias(k) for k in BASE | WEAK])
    merged = lambda kinds: F.array_sort(F.concat(*kinds))
    # an opaque value inside a base span, as after "secret=", is that span's
    own = F.filter("opaque", lambda w: ~F.exists(F.concat(*BASE), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    found = found.withColumn("opaque", own)
    found = keep(found.select(key, "mark", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], merged(BASE).alias("base"), merged(WEAK).alias("weak")), "spans")
    parts = found.filter(F.size("weak") > 0).select(key, "mark", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    linked = link_parts(parts.select(key, "mark", "s.*"), [key, "mark"], scope)
    more = linked.groupBy(F.col(key).alias("__k"), F.col("mark").alias("__m")).agg(F.collect_list(F.struct("start", "rank", "end", "kind", "role")).alias("more"))
    joined = found.join(more, F.col(key).eqNullSafe(F.col("__k")) & (F.col("mark") == F.col("__m")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return joined.select(key, *[f"n_{k}" for k in BASE], "base", spans.alias("spans"))


def span_digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    base = let(F.col("base"), _listed)
    return scanned.select(key, *[f"n_{k}" for k in BASE], F.sha2(base, 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
