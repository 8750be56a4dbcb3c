"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, filteraudit, fingerprint, linededup, minhash, packing, pfp, substring, tokencount, tokenfile, toxicity
from .common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.dedup_bytes(read_table(spark, sf_dir, "documents"), digest=True).select("_row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.fingerprints(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"), fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.distinct_count(F.col("sketch")).alias("n_shingles"), fingerprint.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_text"),
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(read_table(spark, sf_dir, "conversations"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_words(read_table(spark, sf_dir, "documents"), digest=True).select("_row.doc_id", "n_words", "n_removed", "kept_sha256")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_toxicity, op3_best_fit_packing, op4_suffix_array_dedup, op5_token_counts, op6_document_fingerprints, op7_benchmark_decontamination, op8_line_dedup, op9_chat_formatting, op10_substring_dedup, op11_token_files, op12_collocations, op13_filter_audit)}

ORACLES = {
    "op8_line_dedup": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
b AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, b.key IS NOT NULL AND k.doc_id <> b.last_doc AS gone FROM k LEFT JOIN b ON k.key = b.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op9_chat_formatting": chat.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_filter_audit": filteraudit.ORACLE_SQL,
}
