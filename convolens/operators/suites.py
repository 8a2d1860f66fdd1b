"""Cases for evaluation made from the corpus itself, and what must come out of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from convolens.functions import text as T
from convolens.functions.names import fold_name_udf
from convolens.plans.parse import Contacts, parse_table

# Question templates by class; {n} is a name, {p} a phrase of the corpus.
TEMPLATES = {
    "person_only": ["messages from {n}", "what did {n} say"],
    "person_recency": ["latest from {n}", "recent messages from {n}", "{n}'s latest messages"],
    "person_date": ["messages from {n} last week", "what did {n} say yesterday"],
    "person_media": ["photos from {n}"],
    "self": ["messages I sent", "what did I say"],
    "lexical": ["{p}"],
    "person_topical": ["what did {n} say about {p}"],
}
# Questions that name no one.
NEGATIVES = ["the last thing we said", "with the trip", "about the weekend", "from work", "what happened in may", "tell me about dinner"]


def frequent_names(messages: DataFrame, names: DataFrame, n: int = 12) -> DataFrame:
    """(name, handle): first names of those who write most and that name one contact only."""
    top = messages.filter(F.col("handle").isNotNull() & ~F.col("is_from_me")).groupBy("handle").agg(F.count("*").alias("k"))
    first = top.join(names, "handle").withColumn("name", F.split("display_name", " ")[0])
    alone = first.withColumn("same", F.count("*").over(W.partitionBy(F.lower("name")))).filter("same = 1")
    return alone.orderBy(F.desc("k"), "handle").limit(n).select("name", "handle")


def corpus_phrases(messages: DataFrame, n_words: int = 4, stride: int = 97, most: int = 50) -> DataFrame:
    """(phrase, msg_id): the first words of every so many-th longer message, each phrase once."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[\w']+"), F.lit(0))
    longer = messages.withColumn("w", w).filter((F.size("w") >= n_words) & (F.pmod(F.col("msg_id"), F.lit(stride)) == 0))
    phrases = longer.select(F.array_join(F.slice("w", 1, n_words), " ").alias("phrase"), "msg_id")
    return phrases.groupBy("phrase").agg(F.min("msg_id").alias("msg_id")).orderBy("msg_id").limit(most)


def build_suite(spark, names: DataFrame, phrases: DataFrame) -> DataFrame:
    """(class, query, handle, phrase): every template with every name and phrase that it asks for; both lists are short by their limits."""
    rows = spark.createDataFrame([(c, t) for c, ts in TEMPLATES.items() for t in ts], "class string, template string")
    some = rows.join(F.broadcast(names.limit(100)), F.col("template").contains("{n}"), "left").join(F.broadcast(phrases.select("phrase").limit(100)), F.col("template").contains("{p}"), "left")
    text = F.replace(F.replace("template", F.lit("{n}"), F.coalesce("name", F.lit(""))), F.lit("{p}"), F.coalesce("phrase", F.lit("")))
    return some.select("class", text.alias("query"), "handle", "phrase")


def messages_from(messages: DataFrame, handle: str | None = None, from_me: bool | None = None, start: float | None = None, end: float | None = None, need_file: bool = False) -> DataFrame:
    """What a question about an author must find, by direction, time and attachment, newest first."""
    out = messages.filter(~F.col("is_from_me") & (F.lower("handle") == handle.lower())) if handle else messages
    out = out.filter(F.col("is_from_me") == from_me) if from_me is not None and not handle else out
    out = out.filter(F.col("ts") >= start) if start is not None else out
    out = out.filter(F.col("ts") <= end) if end is not None else out
    out = out.filter("has_attachment") if need_file else out
    return out.select("msg_id", "chat_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("msg_id"))


# Questions about what is no name; {w} is a phrase of the corpus.
CORPUS_NEGATIVES = ["messages from {w}", "what happened with {w}"]
FOLLOWS = r"(?iU)\b(?:from|with)\s+((?:the\s+)?[a-z][a-z'-]+)"


def corpus_negatives(messages: DataFrame, contacts: DataFrame, most: int = 60, shortest: int = 20, longest: int | None = 300) -> DataFrame:
    """(phrase, n): what most often follows "from" and "with" in the texts and names no contact, over all messages; ties by phrase.

    Counts are added up in each task before they are sent, so a phrase of a third of all rows costs no
    more than others. ``contacts``: display_name; a phrase that is one's folded name, or its first
    word, goes, with or without "the" before it.
    """
    size = F.length("text") >= shortest
    size = size & (F.length("text") <= longest) if longest is not None else size
    found = messages.filter(size).select(F.explode(F.regexp_extract_all("text", F.lit(FOLLOWS), F.lit(1))).alias("p"))
    phrase = F.regexp_replace(F.trim(F.lower("p")), r"\s+", " ")
    counts = found.select(phrase.alias("phrase")).filter(F.length("phrase") >= 3).groupBy("phrase").agg(F.count("*").alias("n"))
    full = contacts.select(fold_name_udf("display_name").alias("full")).filter("full != ''")
    names = full.select("full").union(full.select(F.split("full", " ")[0])).distinct()
    bare = counts.withColumn("bare", F.trim(F.regexp_replace(F.regexp_replace("phrase", "^the ", ""), r"[^\w\s]+", " ")))
    return bare.join(names, F.col("bare") == F.col("full"), "left_anti").orderBy(F.desc("n"), "phrase").limit(most).select("phrase", "n")


def probe_cases(spark, contacts: Contacts, negatives: DataFrame | None = None) -> DataFrame:
    """(kind, form, query, handle, typed): questions that name a contact in each way of writing, and questions that name no one, those of ``negatives`` (phrase) too."""
    people = [(n, hs[0]) for n, hs in contacts.rows if hs]
    named = spark.createDataFrame(people, "name string, handle string").withColumn("first", F.split("name", " ")[0])
    forms = named.select("handle", F.explode(T.surface_forms(F.col("first"))).alias("f")).select("handle", "f.form", "f.text")
    ask = F.when(F.col("form") == "possessive", F.concat("text", F.lit(" latest messages"))).otherwise(F.concat(F.lit("messages from "), "text"))
    positive = forms.select(F.lit("positive").alias("kind"), "form", ask.alias("query"), "handle", F.regexp_replace("text", "'s$|[?\"]", "").alias("typed"))
    none = F.lit(None).cast("string")
    plain = spark.createDataFrame([("negative", "plain", q) for q in NEGATIVES], "kind string, form string, query string").withColumns({"handle": none, "typed": none})
    out = positive.unionByName(plain)
    if negatives is not None:
        asked = negatives.select(F.explode(F.array(*[F.replace(F.lit(t), F.lit("{w}"), F.col("phrase")) for t in CORPUS_NEGATIVES])).alias("query"))
        out = out.unionByName(asked.select(F.lit("negative").alias("kind"), F.lit("corpus").alias("form"), "query", none.alias("handle"), none.alias("typed")))
    return out


def parser_probe(spark, contacts: Contacts, now: datetime, negatives: DataFrame | None = None) -> DataFrame:
    """(kind, form, n, passed, rate, gate): how many questions name whom they should, in each way of writing, and those that name no one name no one."""
    parsed = parse_table(probe_cases(spark, contacts, negatives), "query", now, contacts)
    right = F.when(F.col("handle").isNull(), F.size("parsed.participants") == 0).otherwise(F.array_contains("parsed.participants", F.col("handle")))
    rates = parsed.groupBy("kind", "form").agg(F.count("*").alias("n"), F.count_if(right).alias("passed")).withColumn("rate", F.col("passed") / F.col("n"))
    return rates.withColumn("gate", F.col("rate") >= F.when(F.col("form") == "typo", 0.5).otherwise(1.0))


def blind_probe(spark, contacts: Contacts, now: datetime, negatives: DataFrame | None = None) -> DataFrame:
    """(kind, form, n, passed, invented, lost): the same questions without an address book: no one may be named, and no word may get lost.

    What stays to be searched for with contacts must stay without them, and so must the name as it was typed.
    """
    sighted = parse_table(probe_cases(spark, contacts, negatives), "query", now, contacts).withColumnRenamed("parsed", "sighted")
    both = parse_table(sighted, "query", now, None)
    tokens = lambda c: F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\w\s']", " ")), r"\s+"), lambda w: w != "")
    kept, blind = tokens("sighted.semantic"), tokens("parsed.semantic")
    invented = F.size("parsed.participants") + F.size("parsed.senders") > 0
    gone = (F.size(F.array_except(kept, blind)) > 0) | ~F.coalesce(F.contains(F.lower("parsed.semantic"), F.lower("typed")), F.lit(True))
    return both.groupBy("kind", "form").agg(F.count("*").alias("n"), F.count_if(~invented & ~gone).alias("passed"), F.count_if(invented).alias("invented"), F.count_if(gone).alias("lost"))


def question_filter(questions: DataFrame, reject_above: float = 0.40, hard_from: int = 200) -> DataFrame:
    """Add ``verdict`` to questions (query, source_text, source_rank): copied words, not found, trivially hard, or kept."""
    overlap = T.vocabulary_overlap(F.col("query"), F.col("source_text"))
    verdict = F.when(overlap > reject_above, "copied").when(F.col("source_rank").isNull(), "not_found").when(F.col("source_rank") > hard_from, "hard").otherwise("kept")
    return questions.withColumn("overlap", overlap).withColumn("verdict", verdict)


def with_ranks(questions: DataFrame, fused: DataFrame, words: DataFrame, qid: str, source: str, key: str, others: int = 5) -> DataFrame:
    """Add to questions what batch retrieval found: source_rank (null if not found), sparse_first (whether words alone put the source first), and top_others (the best few that are not the source).

    ``fused`` and ``words``: (qid, key, rank).
    """
    own = questions.select(F.col(qid).alias("qid"), F.col(source).alias("__source"))
    mine = F.col(key) == F.col("__source")
    best = fused.join(own, "qid").groupBy("qid").agg(F.min(F.when(mine, F.col("rank"))).alias("source_rank"), F.array_sort(F.collect_list(F.when(~mine & (F.col("rank") <= others), F.struct("rank", key)))).alias("o"))
    first = words.filter("rank = 1").join(own, "qid").select("qid", mine.alias("sparse_first"))
    found = best.select("qid", "source_rank", F.transform("o", lambda x: x[key]).alias("top_others")).join(first, "qid", "left")
    out = questions.join(found, F.col(qid) == found["qid"], "left") if qid != "qid" else questions.join(found, "qid", "left")
    return out.select(*questions.columns, "source_rank", F.coalesce("sparse_first", F.lit(False)).alias("sparse_first"), F.coalesce("top_others", F.array().cast(f"array<{fused.schema[key].dataType.simpleString()}>")).alias("top_others"))
