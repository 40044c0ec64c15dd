"""A corpus pipeline of the library's operators over the documents table.

STAGES are applied in order; each stage gets what its predecessor kept and all
but the last return the columns of documents.  Between stages `run` writes
Parquet under the shared checkpoint folder and reads it again, so a stage never
recomputes another's work and survives lost executors.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and empty tables, and ignores further columns:
- language: texts in no learned language go: null texts, texts without a letter,
  and texts that every language's model codes in over 16 bits a byte (twice the
  uniform code); with no labelled document only those without a letter go;
- toxicity: texts scored 0.5 or more go, the rest stays as it is;
- lines: a line of ten characters or more that several documents hold stays in
  the smallest doc_id only; texts may become empty but no row goes; n_chars
  follows the text;
- near_duplicates: of each group of five-word shingle sets with a similarity of
  0.8 or more the smallest doc_id stays; texts without words stay;
- packing: a row for each piece of each document, in sequences of 1024 tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import language_id, line_dedup, minhash, packing, toxicity
from tessaline.llm.common import ensure_checkpoint_dir, table
from tessaline.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language."""
    return language_id.keep_identified(docs.select(*COLUMNS))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models don't call toxic."""
    return toxicity.keep_ordinary(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that an earlier document holds."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs.select(*COLUMNS), width=5, per_cent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("language", language), ("toxicity", toxic), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", pack)]

#: SQL expresses none of the model stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
