"""What each of five filters removes, in every order of applying them.

Duplicates are found by partition refinement: rows are split by the length of their text, then by
the hash of one block after the other; a row that is alone in its part is done and goes. Only what
is left has its whole text compared. Each row then has a mask of the filters that it fails, and the
orders are worked out on counts of masks.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from convolens.llm.shared import UPPER, keep, small, words_of

FILTERS = "ABCDE"
#: Code points of the first blocks; the last block is the rest of the text.
BLOCKS = (64, 1024)
HASHES = [f"__b{i}" for i in range(len(BLOCKS) + 1)]
PART = ["__length", *HASHES]


def with_blocks(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the length of a text and the hashes of its blocks."""
    starts = [1 + sum(BLOCKS[:i]) for i in range(len(BLOCKS) + 1)]
    lengths = [*BLOCKS, 2**31 - 1]
    blocks = {h: F.xxhash64(F.substring(text, a, n)) for h, a, n in zip(HASHES, starts, lengths, strict=True)}
    return rows.withColumns({"__length": F.length(text), **blocks})


def refined(rows: DataFrame) -> DataFrame:
    """The parts (length, block hashes) that have two rows or more, found by splitting on one column after the other."""
    left, by = rows.select(*PART), []
    for column in PART:
        by.append(column)
        parts = keep(left.groupBy(*by).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n"), "parts")
        if column != PART[-1]:
            left = left.join(small(parts), by, "left_semi")
    return parts


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """doc_id, length and block hashes of the rows whose text is also that of a smaller doc_id.

    A null text is an empty one. A row without a doc_id is no duplicate and makes none; rows
    with one doc_id and one text are not duplicates of each other. Empty in, empty out. Texts
    decide: of a part, all rows are compared with the text of its smallest id, and those that
    differ, whose hashes only happen to be equal, are compared again among themselves.
    """
    rows = with_blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).filter("doc_id is not null"), "__text")
    left = rows.join(small(refined(rows)), PART, "left_semi")
    found = None
    while True:
        # written, so that the join doesn't share the sums' partitioning and a part with many rows can be split
        first = keep(left.groupBy(*PART).agg(F.min_by("__text", "doc_id").alias("__first_text"), F.min("doc_id").alias("__first")), "first")
        beside = left.join(small(first), PART)
        compared = keep(beside.select("doc_id", *PART, "__first", (F.col("__text") == F.col("__first_text")).alias("__same")), "compared")
        same = compared.filter("__same and doc_id > __first").select("doc_id", *PART)
        found = same if found is None else found.unionByName(same)
        if compared.filter("not __same").isEmpty():
            return found.distinct()
        left = keep(beside.filter("__text != __first_text").select("doc_id", *PART, "__text"), "others")


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask: bit i is set if the row fails filter i of ``FILTERS``. A null text is empty; a null source is the part ''."""
    text, words = F.col("__text"), F.col("__words")
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("__text"))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    rows = with_blocks(rows.withColumn("__words", words_of(text)), "__text").select("doc_id", "part", *PART, bits.alias("__bits"))
    again = duplicate_ids(docs).withColumn("__again", F.lit(1 << FILTERS.index("E")))
    return rows.join(again, ["doc_id", *PART], "left").select("doc_id", "part", (F.col("__bits") + F.coalesce("__again", F.lit(0))).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, rows, good and toxic: what the orders are worked out on. An id with several labels counts once, as good or toxic if any says so."""
    of = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("__good"), F.max(F.col("toxic") == 1).alias("__toxic"))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c[2:])
    return masks.join(of, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("rows"), count("__good"), count("__toxic"))


def orders(filters: str = FILTERS) -> list[tuple[str, int, str, int, int]]:
    """(order, step, its filter, its bit, the bits of the filters before it): 600 for five filters."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    return [("".join(o), i + 1, f, bit[f], sum(bit[x] for x in o[:i])) for o in permutations(filters) for i, f in enumerate(o)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Rows without a doc_id count, without labels. Columns of other names are left out. An empty table has no parts and gives no rows.
    """
    counts = keep(mask_counts(masked(docs), labels), "masks")
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(f).alias("f"), F.lit(b).alias("b"), F.lit(p).alias("p")) for o, i, f, b, p in orders()])
    rows = counts.select("*", F.explode(steps).alias("s"))
    fails, before = F.col("mask").bitwiseAND(F.col("s.b")) != 0, F.col("mask").bitwiseAND(F.col("s.p")) != 0
    total = lambda condition, what="rows": F.coalesce(F.sum(F.when(condition, F.col(what))), F.lit(0)).cast("long")
    out = rows.groupBy("part", F.col("s.o").alias("filter_order"), F.col("s.i").alias("step"), F.col("s.f").alias("__filter")).agg(
        total(~fails & ~before).alias("kept"), total(fails & ~before).alias("removed"), total(fails & before).alias("redundant"), total(F.col("mask") == F.col("s.b")).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"), total(fails & ~before, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "__filter"))).drop("__filter")
