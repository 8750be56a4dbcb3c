"""The training-data pipeline over ``documents``: five stages, each one operator.

A stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of documents.

1. toxicity: documents scored 0.3 or more go.
2. line_dedup: repeated lines go from all but the last document that has them;
   ``text`` and ``n_chars`` are those of what stays. A document that loses every
   line stays, with an empty text.
3. near_dedup: one document (the smallest doc_id) of each group of near copies
   stays (five-word shingles, similarity 0.8).
4. decontamination: documents that hold a benchmark passage go.
5. packing: the ids of what stays are packed into sequences of 4096 tokens.

Rows with a null doc_id or text pass stages 1 to 4 and are packed as what they
are; rows that share a doc_id stay or go together in stages 3 and 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, linededup, minhash, packing, toxicity
from ledgerloom.llm.common import discard, keep, kept_within, read_table
from ledgerloom.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs.select(COLUMNS), read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(docs.select(COLUMNS))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs.select(COLUMNS), read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", drop_near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: Tokenization, similarity and packing have no SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote on its way is deleted once its own output stands, and an output once the next one does; the last stage's input stays for its reader."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with kept_within():
            docs = keep(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
