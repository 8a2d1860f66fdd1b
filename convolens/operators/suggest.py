"""Suggestions while one types: an inverted index of the pieces of names, with exact checks.

Names are folded and written once each, with their owners apart, so a participant of many chats
is one name. What a question reads is the list of its rarest piece, and for typing errors the lists of so many
rare pieces that a word within the allowed edits must stand in one of them; texts decide, so
nothing is lost and nothing is wrong. No question scans the names.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.functions.names import fold_name, fold_name_udf, osa_udf

#: Letters of a piece, and of the longest text that is searched with typing errors.
PIECE, LONGEST = 3, 64


def edits_allowed(asked: str) -> int:
    """One from four letters on, two from eight on; none in shorter texts and in those of more than 64."""
    n = len(asked)
    return 0 if n < 4 or n > LONGEST else 1 if n < 8 else 2


def _pieces(padded: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(padded, i, F.lit(PIECE)))


def numbered_pieces(word: Column) -> Column:
    """The pieces of a word with two blanks on both sides; the second of equal ones and those after it carry a number, so that sets of them meet as often as bags would."""
    every = _pieces(F.concat(F.lit("  "), word, F.lit("  ")), F.length(word) + 2)
    before = lambda x, i: F.size(F.filter(F.slice(every, F.lit(1), i), lambda y: y == x))
    return F.transform(every, lambda x, i: F.concat(x, F.when(before(x, i) > 0, before(x, i).cast("string")).otherwise("")))


def _numbered(word: str) -> list[str]:
    padded, seen, out = f"  {word}  ", Counter(), []
    for i in range(len(word) + 2):
        piece = padded[i : i + PIECE]
        out.append(piece + (str(seen[piece]) if seen[piece] else ""))
        seen[piece] += 1
    return out


def write_names(names: DataFrame, root: str) -> NameIndex:
    """Index ``names``: owner (any type), shown. A null or blank name has no entry; equal rows count once; an owner may have many names.

    A name of any length is found by its parts; only words and names of up to 66 letters can be found with typing errors.
    """
    spark = names.sparkSession

    def put(name: str, df: DataFrame, *order: str) -> DataFrame:
        df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    owners = put("owners", names.select("owner", "shown", fold_name_udf("shown").alias("text")).filter("text <> ''").distinct(), "text", "owner")
    texts = owners.select("text").distinct()
    parts = texts.select(F.explode(F.array_distinct(_pieces(F.concat("text", F.lit("  ")), F.length("text")))).alias("piece"), "text")
    inside = put("inside", parts, "piece", "text")
    said = texts.select(F.explode(F.array_distinct(F.array_append(F.split("text", " "), F.col("text")))).alias("word"), "text")
    words = put("words", said.filter(F.length("word") <= LONGEST + 2), "word", "text")
    near = put("near", words.select("word").distinct().select(F.explode(numbered_pieces(F.col("word"))).alias("piece"), "word"), "piece", "word")
    count = lambda kind, df: df.groupBy("piece").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "piece", "n")
    put("counts", count("inside", inside).unionByName(count("near", near)), "kind", "piece")
    return NameIndex(spark, root)


class NameIndex:
    """Questions to what ``write_names`` has written. Asked texts are folded as the names are."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def rarest(self, kind: str, pieces: list[str], n: int) -> list[str]:
        """The ``n`` pieces with the shortest lists; a piece that no name has comes first."""
        found = {r["piece"]: r["n"] for r in self.read("counts").filter((F.col("kind") == kind) & F.col("piece").isin(pieces)).collect()}
        return sorted(pieces, key=lambda p: (found.get(p, 0), p))[:n]

    def texts_with(self, part: str) -> DataFrame:
        """(text): folded names that contain a folded part of one letter or more. A part of one or two letters is a range of pieces."""
        inside = self.read("inside")
        if len(part) < PIECE:
            return inside.filter(F.col("piece").startswith(part)).select("text").distinct()
        (piece,) = self.rarest("inside", [part[i : i + PIECE] for i in range(len(part) - PIECE + 1)], 1)
        return inside.filter((F.col("piece") == piece) & F.col("text").contains(part)).select("text")

    def containing(self, part: str) -> DataFrame:
        """(owner, shown, text) of all names that contain ``part``; every name for a blank one."""
        p, owners = fold_name(part), self.read("owners")
        return owners.join(self.texts_with(p), "text", "left_semi").select("owner", "shown", "text") if p else owners.select("owner", "shown", "text")

    def misspelt(self, asked: str) -> DataFrame:
        """(owner, shown, text, distance) of all names that, whole or in one of their words, are within the allowed edits of ``asked``; neighbours changed round are one edit.

        An edit spoils four pieces at most. So of any 4 k + 1 pieces of the asked text one is left
        in each word within k edits, and the rarest so many are read.
        """
        a = fold_name(asked)
        k = edits_allowed(a)
        rare = self.rarest("near", _numbered(a), 4 * k + 1) if a else []
        words = self.read("near").filter(F.col("piece").isin(rare) & F.length("word").between(len(a) - k, len(a) + k)).select("word").distinct()
        close = words.withColumn("distance", osa_udf("word", F.lit(a))).filter(F.col("distance") <= k)
        texts = self.read("words").join(close, "word").groupBy("text").agg(F.min("distance").alias("distance"))
        return self.read("owners").join(texts, "text").select("owner", "shown", "text", "distance")

    def suggest(self, asked: str, limit: int = 8) -> DataFrame:
        """(owner, shown, distance): each owner once, by its best name; names that begin so, or one of whose words does, then those that contain it, then those with typing errors, each by name and owner."""
        p = fold_name(asked)
        starts = F.col("text").startswith(p) | F.col("text").contains(" " + p)
        hits = self.containing(asked).select("owner", "shown", (~starts).cast("int").alias("later"), F.lit(0).alias("distance"))
        near = self.misspelt(asked).filter(~F.col("text").contains(p)).select("owner", "shown", F.lit(2).alias("later"), "distance")
        best = hits.unionByName(near).groupBy("owner").agg(F.min(F.struct("later", "distance", "shown")).alias("b"))
        return best.orderBy("b", "owner").limit(limit).select("owner", "b.shown", "b.distance")


def chat_names(metadata: DataFrame) -> DataFrame:
    """(owner, shown): the title and the participants of each chat."""
    return metadata.select(F.col("chat_id").alias("owner"), F.explode(F.array_append("participants", F.col("title"))).alias("shown"))


def suggest_chats(index: NameIndex, metadata: DataFrame, chunks: DataFrame, part: str, limit: int = 20) -> DataFrame:
    """(chat_id, title, participant_count, n_chunks, last_ts): chats whose title or a participant contains ``part``, newest first; ``index`` is over ``chat_names``. A chat without windows comes last."""
    hit = index.containing(part).select(F.col("owner").alias("chat_id")).distinct()
    found = metadata.join(hit, "chat_id", "left_semi")
    sizes = chunks.join(hit, "chat_id", "left_semi").groupBy("chat_id").agg(F.count("*").alias("n_chunks"), F.max("end_ts").alias("last_ts"))
    rows = found.join(sizes, "chat_id", "left").orderBy(F.desc_nulls_last("last_ts"), "chat_id").limit(limit)
    return rows.select("chat_id", "title", "participant_count", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "last_ts")
