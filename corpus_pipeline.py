"""Corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept.  ``run`` writes each stage's rows as Parquet under the shared checkpoint
folder and reads them again for the next.

1. toxicity: documents that the classifier rejects go;
2. line_dedup: lines that repeat an earlier line go, and documents left without a word;
3. ngram_jaccard: one document of each group of near copies (5-word shingles, Jaccard 0.8) stays;
4. decontamination: documents that hold a benchmark item go;
5. sentencepiece: token ids of what is left, with the text they decode to.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vendora.llm import decontaminate, jaccard_trie, line_dedup, sentencepiece_bpe, toxicity
from vendora.llm.registry import prepare, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # names of its own, so that no column of docs is replaced
    out = line_dedup.dedup(docs, prefix="__line_").filter("NOT __line_all_removed")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__line_n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # five words and 0.8, not op10's own three words and 0.9
    return jaccard_trie.keep_one(docs, k=5, per_100=80).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sentencepiece_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# A trained classifier and a tokenizer aren't SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
