"""A training corpus from raw documents: the stages in order, and the whole of them as one query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm.contamination import without_overlaps
from rolecast.llm.line_dedup import dedup_lines
from rolecast.llm.near_dup import first_documents
from rolecast.llm.packing import pack
from rolecast.llm.repetition import repetition_rules
from rolecast.session import work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents; every stage but the last returns them.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    judged = repetition_rules(docs, carry=tuple(COLUMNS))
    return judged.filter("kept").select(*[F.col(f"carried.c{k}").alias(c) for k, c in enumerate(COLUMNS)])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has; ``n_chars`` follows the text."""
    cut = dedup_lines(docs, carry=("lang", "source"))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return first_documents(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text overlaps with no benchmark item."""
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of all documents that are left."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Suffix arrays, SimHash and packing are beyond SQL; the tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written to the shared folder and read from there by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
