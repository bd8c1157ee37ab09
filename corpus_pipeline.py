"""From raw documents to token ids: five stages, each over all rows that its predecessor kept.

1. language: documents without a letter, or whose cross-entropy no language of the table explains, go.
2. line_dedup: lines of recurring templates go from all but the first document that has them; a document
   that consists of nothing else goes. A document with over half of its words in lines of one earlier document
   stays whole: near copies are judged on whole texts, by the next stage.
3. near_dedup: of each group of documents that links of five-word similarity 0.8 or more join one stays.
4. decontamination: documents that contain a benchmark item go.
5. encoding: the rest as SentencePiece ids.

All stages but the last return the columns of ``documents``. Columns beyond those that a stage needs pass
through; each stage's operator states what nulls, ties, repeated rows and empty tables give.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, langid, line_dedup, sentencepiece_codec, similar
from quire.llm.common import cut, documents
from quire.session import table

#: No SQL expresses trained models and fingerprints; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(docs, spare=0.5)
    emptied = (F.col("n_lines_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = out.filter(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_lines_dropped") > 0, length).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, MODEL)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
