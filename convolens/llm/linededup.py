"""Removal of chunks and of whole passages of lines that repeat anywhere, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.llm.shared import aside, keep, let, sieve, small, words_of


def chunk_ends(lines: Column, window: int = 2, divisor: int = 4) -> Column:
    """The last line of each chunk: where the rolling hash of the last ``window`` line hashes is 0 modulo ``divisor``.

    A boundary depends on ``window`` lines alone, so that lines put in before a
    passage shift its chunks and leave their contents.
    """
    hashes = F.transform(lines, lambda x: F.xxhash64(x))

    def at(hs: Column) -> Column:
        rolled = lambda i: F.pmod(F.xxhash64(*[F.get(hs, i - k) for k in range(window)]), F.lit(divisor)) == 0
        return F.filter(F.sequence(F.lit(0), F.size(hs) - 1), lambda i: (i == F.size(hs) - 1) | ((i >= window - 1) & rolled(i)))

    return let(hashes, at)


def _chunks(lines: Column) -> Column:
    """Array of struct(k, start, n, text) of all chunks."""

    def cut(p: Column) -> Column:
        def one(end: Column, k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(p["ends"], k - 1) + 1)
            return let(start, lambda s: F.struct(k.alias("k"), s.alias("start"), (end - s + 1).alias("n"), F.array_join(F.slice(p["lines"], s + 1, end - s + 1), "\n").alias("text")))

        return F.transform(p["ends"], one)

    return let(lines, lambda x: let(F.struct(x.alias("lines"), chunk_ends(x).alias("ends")), cut))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_lines: int = 2) -> DataFrame:
    """``docs`` with later copies of multi-line chunks cut out of ``text``, and n_lines, n_chunks, removed_lines, removed_chunks.

    Of the chunks of ``min_lines`` lines or more with the same bytes, the one with the
    least (key, number in its text) stays, anywhere in the table. Equal 64-bit hashes
    only nominate; the bytes are compared with those of the copy that stays. Rows with
    one key and one text count as one document, so both keep or lose the same lines.
    A null text stays null with no lines, an empty one has one empty line; blank lines
    are lines; a null key sorts first. Columns with the added names are replaced.
    """
    added = ["n_lines", "n_chunks", "removed_lines", "removed_chunks"]
    base, back = aside(docs.drop(*added), key, text)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    lines = F.split(F.col(text), "\n")
    many = base.filter(F.col(text).contains("\n")).select(F.col(key).alias("id"), mark.alias("mark"), F.col(text).alias("t"))
    chunks = many.select("id", "mark", F.explode(_chunks(F.split("t", "\n"))).alias("c")).filter(F.col("c.n") >= min_lines)
    marked = keep(chunks.select(F.struct("id", "mark", "c.k").alias("place"), F.xxhash64("c.text").alias("hash")), "chunks")
    repeated = marked.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first != last").select(F.col("hash").alias("h"), "first")
    named = marked.join(repeated, F.col("hash") == F.col("h")).select("hash", "first", "place")

    # only chunks whose hash repeats bring their bytes
    wanted = keep(named.groupBy(F.col("place.id").alias("w_id"), F.col("place.mark").alias("w_mark")).agg(F.collect_set(F.struct(F.col("place.k").alias("k"), "hash", "first")).alias("named")), "named")
    held = many.join(small(wanted), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark"))).select("id", "mark", "named", _chunks(F.split("t", "\n")).alias("c"))
    texts = held.select("id", "mark", F.explode(F.transform("named", lambda x: F.struct(x["k"].alias("k"), x["hash"].alias("hash"), x["first"].alias("first"), F.get("c", x["k"])["text"].alias("bytes")))).alias("x")).select(F.struct("id", "mark", "x.k").alias("place"), "x.hash", "x.first", "x.bytes")
    texts = keep(texts, "bytes")
    kept = texts.filter(F.col("place") == F.col("first")).groupBy(F.col("hash").alias("h")).agg(F.first("bytes").alias("kept"))
    copies = texts.filter(F.col("place") != F.col("first")).join(kept, F.col("hash") == F.col("h")).filter(F.col("bytes") == F.col("kept"))
    gone = copies.groupBy(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark")).agg(F.collect_set("place.k").alias("__gone"))
    gone = small(keep(gone, "gone"))

    joined = base.withColumn("__m", mark).join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    cut = F.when(F.col(text).isNotNull(), _chunks(lines))
    out = joined.withColumn("__c", F.when(F.col("__gone").isNotNull(), cut))
    stays = F.filter("__c", lambda c: ~F.array_contains(F.col("__gone"), c["k"]))
    removed = F.aggregate(F.filter("__c", lambda c: F.array_contains(F.col("__gone"), c["k"])), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    n_chunks = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(chunk_ends(lines)))
    return back(
        out,
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        n_chunks.cast("long").alias("n_chunks"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("removed_lines"),
        F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long").alias("removed_chunks"),
        **{text: F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stays, lambda c: c["text"]), "\n"))},
    )


def _pieces(lines: Column, long_words: int) -> Column:
    """Array of struct(i, n): every two lines in a row (n = 2), and every line of more than ``long_words`` words (n = 1)."""
    at = lambda i, n: F.struct(i.cast("int").alias("i"), F.lit(n).alias("n"))
    pairs = F.when(F.size(lines) > 1, F.transform(F.sequence(F.lit(0), F.size(lines) - 2), lambda i: at(i, 2)))
    # that many words have as many characters and the blanks between
    long = lambda x: (F.length(x) > 2 * long_words) & (F.size(words_of(x)) > long_words)
    single = F.filter(F.transform(lines, lambda x, i: F.when(long(x), at(i, 1))), lambda x: x.isNotNull())
    return F.concat(F.coalesce(pairs, F.array().cast("array<struct<i:int,n:int>>")), single)


def dedup_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", long_words: int = 50) -> DataFrame:
    """``docs`` with later copies of whole passages cut out of ``text``, and n_lines, n_chunks, removed_lines, removed_chunks.

    The rolling hash over two lines is compared at every line and not only at the ends
    of chunks, so a passage of two lines or more that also stands before goes from its
    first line to its last, whatever the text around it; so does a single line of more
    than ``long_words`` words. What is shuffled of a piece that stands once is a hash, and of a text
    without repeated pieces nothing: bitmaps of bounded size tell which may have some. The piece with the least (key, text, line) stays, and a
    piece that overlaps it is no copy. A line that goes stands before, so no line is
    lost from the table. Equal 64-bit hashes only nominate; the bytes are compared.
    Chunks are those of ``chunk_ends``; removed_chunks are those with no line left.
    Nulls, blanks and equal rows are as in ``dedup_lines``.
    """
    added = ["n_lines", "n_chunks", "removed_lines", "removed_chunks"]
    base, back = aside(docs.drop(*added), key, text)
    mark = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    full = base.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), mark.alias("mark"), F.split(F.col(text), "\n").alias("l"))

    def hashed(lines: Column) -> Column:
        hash_of = lambda p: F.when(p["n"] == 2, F.xxhash64(F.get(lines, p["i"]), F.get(lines, p["i"] + 1))).otherwise(F.xxhash64(F.get(lines, p["i"])))
        return F.transform(_pieces(lines, long_words), lambda p: F.struct(p["i"].alias("i"), p["n"].alias("n"), hash_of(p).alias("hash")))

    pieces = full.select("id", "mark", F.explode(hashed(F.col("l"))).alias("p"))
    marked = keep(pieces.select(F.struct("id", "mark", "p.i").alias("place"), "p.n", "p.hash"), "pieces")
    twice = sieve(keep(marked.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash"), "twice"))
    marked = twice(marked, F.col("hash"), "again").filter("again").drop("again")
    repeated = marked.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first != last").select(F.col("hash").alias("h"), "first")
    named = marked.join(repeated, F.col("hash") == F.col("h")).select("hash", "first", "place", "n")

    # only pieces whose hash repeats bring their bytes
    wanted = keep(named.groupBy(F.col("place.id").alias("w_id"), F.col("place.mark").alias("w_mark")).agg(F.collect_set(F.struct(F.col("place.i").alias("i"), "n", "hash", "first")).alias("named")), "named")
    key_of = lambda i, m: F.xxhash64(i, m)
    may_have = sieve(keep(wanted.select(key_of("w_id", "w_mark").alias("key")), "holders"))
    held = may_have(full, key_of("id", "mark"), "has").filter("has").join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    bytes_of = F.transform("named", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["hash"].alias("hash"), x["first"].alias("first"), F.array_join(F.slice("l", x["i"] + 1, x["n"]), "\n").alias("bytes")))
    texts = held.select("id", "mark", F.explode(bytes_of).alias("x")).select(F.struct("id", "mark", "x.i").alias("place"), "x.n", "x.hash", "x.first", "x.bytes")
    texts = keep(texts, "bytes")
    kept = texts.filter(F.col("place") == F.col("first")).groupBy(F.col("hash").alias("h")).agg(F.first("bytes").alias("kept"))
    apart = ~(F.col("place.id").eqNullSafe(F.col("first.id")) & (F.col("place.mark") == F.col("first.mark")) & (F.col("place.i") < F.col("first.i") + F.col("n")))
    copies = texts.filter((F.col("place") != F.col("first")) & apart).join(kept, F.col("hash") == F.col("h")).filter(F.col("bytes") == F.col("kept"))
    gone = copies.groupBy(F.col("place.id").alias("__id"), F.col("place.mark").alias("__mark")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("place.i"), F.col("place.i") + F.col("n") - 1))))).alias("__gone"))
    gone = keep(gone, "gone")

    lines = F.split(F.col(text), "\n")
    may_lose = sieve(keep(gone.select(key_of("__id", "__mark").alias("key")), "losers"))
    some = may_lose(base.withColumn("__m", mark), key_of(key, "__m"), "__has")
    cut = some.filter("__has").join(gone, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left")
    joined = cut.select(*base.columns, "__gone").unionByName(some.filter("not __has").select(*base.columns, F.lit(None).cast("array<int>").alias("__gone")))
    ends = F.when(F.col(text).isNotNull(), chunk_ends(lines))
    # the lines that stay, by number, and the chunks that hold one of them
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    whole = let(F.struct(ends.alias("ends"), stay.alias("stay")), lambda p: F.size(p["ends"]) - F.size(F.filter(p["ends"], lambda end, k: F.exists(p["stay"], lambda i: (i <= end) & (i > F.coalesce(F.get(p["ends"], k - 1), F.lit(-1)))))))
    left = let(lines, lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))
    found = F.col("__gone").isNotNull()
    return back(
        joined,
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(ends)).cast("long").alias("n_chunks"),
        F.when(found, F.size("__gone")).otherwise(F.lit(0)).cast("long").alias("removed_lines"),
        F.when(found, whole).otherwise(F.lit(0)).cast("long").alias("removed_chunks"),
        **{text: F.when(found, left).otherwise(F.col(text))},
    )
