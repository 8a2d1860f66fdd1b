"""The thin queries opN_<name> over whole tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolens.llm import bytecnn, oracles, pieces, toxicity
from convolens.llm.audit import audit
from convolens.llm.collocations import collocations
from convolens.llm.decontam import decontaminate
from convolens.llm.jaccard import jaccard_join
from convolens.llm.linededup import dedup_passages
from convolens.llm.lm import lm_scores
from convolens.llm.mixing import mix
from convolens.llm.quality import quality_rules
from convolens.llm.secrets import scan_secrets, span_digest
from convolens.llm.sharding import shard_rows
from convolens.llm.shared import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    return shard_rows(sized, "doc_id", 40, ["text_crc32", "size"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytecnn.score(docs, bytecnn.fit(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_near", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    read = pieces.read_model(model or pieces.public_model("piece_bpe_32k.model"))
    out = pieces.encode(table(spark, sf_dir, "documents"), read)
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_lm_score": op3_lm_score,
    "op4_shard": op4_shard,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontaminate": op9_decontaminate,
    "op10_line_dedup": op10_line_dedup,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_sentencepiece": op13_sentencepiece,
}
ORACLE: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY,
    "op2_mix_sources": oracles.MIX,
    "op6_ngram_jaccard": oracles.JACCARD,
    "op4_shard": oracles.SHARD,
    "op9_decontaminate": oracles.DECONTAMINATE,
    "op10_line_dedup": oracles.LINES,
    "op11_collocations": oracles.COLLOCATIONS,
    "op12_filter_audit": oracles.AUDIT,
}
