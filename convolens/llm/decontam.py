"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations.

The corpus is read once, into postings (document, place, term) of the benchmark's terms,
written in segments that are sorted by term. Everything else is asked of these postings:
how common a term is, where the rarest runs of each window stand (a posting has tags of the
two words after it, so a run's lists are intersected where they are read), and which of an item's other terms
stand at the offsets that such a place implies. Texts are not read again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.shared import BROADCAST_BYTES, ascii_lower, aside, keep, let, small, words_of

#: What stands between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    return words_of(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)


def tag(word: Column) -> Column:
    """15 bits of a word's hash: enough to pass over nearly all places where another word follows."""
    return F.xxhash64(word).bitwiseAND(0x7FFF).cast("int")


def tags(words: Column, at: Column) -> Column:
    """The tags of the next word and of the one after it."""
    return tag(F.get(words, at + 1)).bitwiseOR(F.shiftleft(tag(F.get(words, at + 2)), 15))


def postings(docs: DataFrame, bench: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, pos, tid, nxt, id, mark) and (term, tid): a posting for each place of each of ``bench``'s terms, ``nxt`` the tags of the two words after it.

    A row of ``docs`` (id, mark, text) is a document of its own, numbered by its place in the
    input. Its own posting has tid -1, its number of words as ``pos``, and alone id and mark.
    Terms are broadcast in slices of bounded size, so no token is ever shuffled.
    """
    found = bench.select(F.explode("ws").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id())
    terms = keep(found.unionByName(bench.sparkSession.createDataFrame([("", -1)], "term string, tid long")), "terms")
    slices = 1 + (terms.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0) // BROADCAST_BYTES
    held = docs.select(F.monotonically_increasing_id().alias("doc"), "id", "mark", tokens(F.col("text")).alias("ws"))
    own = F.struct(F.size("ws").alias("pos"), F.lit("").alias("term"), F.lit(0).alias("nxt"))
    each = F.transform("ws", lambda w, i: F.struct(i.alias("pos"), w.alias("term"), tags(F.col("ws"), i).alias("nxt")))
    places = held.select("doc", "id", "mark", F.explode(F.concat(F.array(own), each)).alias("x")).select("doc", "id", "mark", "x.*")
    index = None
    for s in range(slices):
        some = F.broadcast(terms.filter(F.pmod(F.xxhash64("term"), F.lit(slices)) == s))
        part = places.join(some, "term").select("doc", "pos", "tid", "nxt", *[F.when(F.col("tid") == -1, F.col(c)).alias(c) for c in ("id", "mark")])
        index = part if index is None else index.unionByName(part)
    return keep(index.sortWithinPartitions("tid"), "postings"), terms


def layouts(n: int, pieces: int, size: int) -> list[tuple[int, ...]]:
    """All ways to lay ``pieces`` runs of ``size`` words into ``n`` words without overlap, as first places."""
    if not pieces:
        return [()]
    return [(a, *(a + size + x for x in rest)) for a in range(n - pieces * size + 1) for rest in layouts(n - a - size, pieces - 1, size)]


def anchors(items: DataFrame, counts: DataFrame, n: int, near: int) -> DataFrame:
    """(item, at, tid, nxt, words, m): of each window of ``n`` words the rarest ``near + 1`` runs of ``words`` words that do not overlap.

    ``near`` other words can't change all of the runs, so a place of one of them is found for
    every occurrence. A run has three words, or fewer where so many do not fit. Items of fewer
    than ``n`` words give all their pairs, and one of a single word that word. ``items``: item, ws, tids.
    """
    size = max(1, min(3, n // (near + 1)))
    places = items.select("item", F.posexplode("tids").alias("at", "tid")).join(counts, "tid", "left")
    listed = F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).cast("double").alias("n"))))
    weighed = places.groupBy("item").agg(listed.alias("c")).withColumn("m", F.size("c"))
    often = lambda p: reduce(lambda a, k: a * F.get("c", p + k)["n"], range(1, size), F.get("c", p)["n"])
    costs = F.transform(F.sequence(F.lit(0), F.col("m") - size), often)

    def rarest(cs: Column, s: Column) -> Column:
        options = [F.struct(reduce(lambda a, b: a + b, [F.get(cs, s + p) for p in x]).alias("cost"), F.array(*[s + p for p in x]).alias("at")) for x in layouts(n, near + 1, size)]
        return F.array_min(F.array(*options))["at"]

    windows = let(costs, lambda cs: F.flatten(F.transform(F.sequence(F.lit(0), F.col("m") - n), lambda s: rarest(cs, s))))
    short = F.sequence(F.lit(0), F.greatest(F.col("m") - 2, F.lit(0)))
    picked = weighed.select("item", "m", F.explode(F.array_distinct(F.when(F.col("m") >= n, windows).otherwise(short))).alias("at")).join(items, "item")
    words = F.when(F.col("m") >= n, size).otherwise(F.least(F.col("m"), F.lit(2)))
    nxt = tags(F.col("ws"), F.col("at"))
    return picked.select("item", "at", F.get("tids", F.col("at")).alias("tid"), nxt.alias("nxt"), words.alias("words"), "m")


def _covered(equal: Column, n: Column, least: Column) -> Column:
    """Offsets inside some window of ``n`` places of which at least ``least`` are equal."""
    m = F.size(equal)
    good = F.transform(F.sequence(F.lit(0), m - n), lambda s: F.aggregate(F.slice(equal, s + 1, n), F.lit(0), lambda a, e: a + e.cast("int")) >= least)
    return let(good, lambda g: F.filter(F.sequence(F.lit(0), m - 1), lambda o: F.exists(F.slice(g, F.greatest(o - n + 2, F.lit(1)), F.least(n, o + 1)), lambda x: x)))


def find_passages(docs: DataFrame, items: DataFrame, n: int = 10, near: int = 2) -> tuple[DataFrame, DataFrame]:
    """(doc, item_id, hits, near_hits), the word places of documents that lie in windows of items; and (doc, id, mark, n_words) of all documents.

    ``docs``: id, mark, text. ``items``: item_id, text. ``hits`` are the places in windows that
    occur word for word; ``near_hits`` those in windows of which all but ``near`` words stand at
    their places. A window of m < 2 * ``near`` + 2 words may have m // 2 - 1 others, and none below 4.
    All such occurrences are found; words that are put in or left out end one.
    """
    bench = items.select("item_id", tokens(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct()
    bench = keep(bench.withColumn("item", F.xxhash64("item_id", "ws")), "items")
    index, terms = postings(docs, bench)
    counts = keep(index.filter("tid >= 0").groupBy("tid").agg(F.count("*").alias("n")), "counts")
    numbers = bench.select("item", F.posexplode("ws").alias("at", "term")).join(small(terms), "term")
    tids = numbers.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tid"))), lambda x: x["tid"]).alias("tids"))
    bench = keep(bench.join(tids, "item"), "items")
    wanted = keep(anchors(bench, counts, n, near), "anchors")

    # the rarest lists first: a place of one run puts an item at one offset of a document
    i = index.select("doc", "pos", F.col("tid").alias("i_tid"), F.col("nxt").alias("i_nxt")).filter("i_tid >= 0")
    met = None
    for words in (1, 2, 3):
        some = small(keep(wanted.filter(F.col("words") == words), "runs"))
        key = F.lit((0, 0x7FFF, 0x3FFFFFFF)[words - 1])
        found = i.join(some, (F.col("i_tid") == F.col("tid")) & (F.col("i_nxt").bitwiseAND(key) == F.col("nxt").bitwiseAND(key)))
        met = found if met is None else met.unionByName(found)
    place = ["doc", "item", (F.col("pos") - F.col("at")).alias("shift")]
    held = keep(met.select(*place).distinct(), "held")

    # then the item's other terms at their offsets from there
    few = small(keep(held.select(F.col("doc").alias("h_doc")).distinct(), "docs"))
    here = i.join(few, F.col("doc") == F.col("h_doc"), "left_semi")
    asked = held.join(bench.select("item", "tids"), "item").select("doc", "item", "shift", F.posexplode("tids").alias("o", "tid"))
    asked = asked.select(F.col("doc").alias("a_doc"), "item", "shift", "o", "tid", (F.col("shift") + F.col("o")).alias("a_pos"))
    both = asked.join(here, (F.col("a_doc") == F.col("doc")) & (F.col("a_pos") == F.col("pos")) & (F.col("tid") == F.col("i_tid")))
    every = index.filter("tid = -1").select("doc", "id", "mark", F.col("pos").cast("long").alias("n_words"))
    lists = both.groupBy("doc", "item", "shift").agg(F.collect_set("o").alias("os")).join(bench.select("item", "item_id", F.size("tids").alias("m")), "item")
    lists = lists.join(every.select("doc", "n_words"), "doc")
    equal = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.array_contains("os", o))
    width = F.least(F.lit(n), F.col("m"))
    others = F.greatest(F.least(F.lit(near), F.floor(width / 2).cast("int") - 1), F.lit(0))
    lists = lists.withColumn("width", width).withColumn("least", width - others).filter(F.size("os") >= F.col("least")).withColumn("equal", equal)
    inside = lambda p: (p >= 0) & (p < F.col("n_words"))
    at = lambda least: F.filter(F.transform(_covered(F.col("equal"), F.col("width"), least), lambda o: o + F.col("shift")), inside)
    found = lists.select("doc", "item_id", at(F.col("width")).alias("hits"), at(F.col("least")).alias("near_hits")).filter(F.size("near_hits") > 0)
    return keep(found, "found"), every


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, near: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_near, n_items, item_ids (sorted as strings), contaminated.

    Null and empty texts have no words and no hits; an item without words hits nothing, and one
    of fewer than ``n`` words is one window. Texts of any length are indexed whole. Equal rows
    are each found by themselves, with equal results; null ids are kept. Several items with one
    id count once. Other columns are not looked at. Empty tables give empty or clean results.
    """
    d = docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("mark"), "text")
    found, every = find_passages(d, items.select("item_id", "text"), n, near)
    places = lambda c: found.select("doc", F.explode(c).alias("p")).distinct().groupBy("doc").agg(F.count("*").alias(f"n_{c}"))
    name = F.when(F.size("hits") > 0, F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    named = found.groupBy("doc").agg(F.array_sort(F.collect_set(name)).alias("item_ids"))
    result = named.join(places("hits"), "doc", "left").join(places("near_hits"), "doc", "left").withColumnRenamed("doc", "f_doc")
    joined = every.join(result, F.col("doc") == F.col("f_doc"), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hits", F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_near_hits", F.lit(0)).cast("long").alias("n_near"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item word for word.

    Rows with one id and one text go together. Null and empty texts stay, columns of any name
    are kept, an empty table on either side gives ``docs`` as it is.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    found, every = find_passages(docs.select(F.col("doc_id").alias("id"), mark.alias("mark"), "text"), items.select("item_id", "text"), n, 0)
    gone = found.filter(F.size("hits") > 0).select(F.col("doc").alias("f_doc")).distinct()
    gone = keep(every.join(small(keep(gone, "hit")), F.col("doc") == F.col("f_doc")).select(F.col("id").alias("__id"), F.col("mark").alias("__gone")).distinct(), "gone")
    packed, back = aside(docs, "doc_id", "text")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__gone"))
    return back(packed.withColumn("__mark", mark).join(small(gone), on, "left_anti"))
