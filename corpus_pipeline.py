"""The corpus pipeline: documents in, packed training sequences out; each stage reads what the one before wrote.

Part of the subpackage quern.llm, of which it puts five operators in a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, table
from quern.llm.decontaminate import decontaminate
from quern.llm.jaccard import one_of_each
from quern.llm.packing import pack
from quern.llm.quality import quality_rules
from quern.llm.secrets import redact_secrets


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are; null, empty and short texts go.

    Without a column lang no language can be learned, and the base rules alone judge.
    """
    lang = "lang" if "lang" in docs.columns else None
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "text", *([lang] if lang else []))
    return quality_rules(rows, keep=["_row"], lang_col=lang).where("kept").select("_row.*")


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; texts without words are alone, rows that repeat id and text are one."""
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate, as they are; those without words are clean."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars, where it is there and known, counted anew."""
    masked = redact_secrets(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return masked.select(*(F.col(f"`{c}`") for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens; null and empty texts give the end id."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("near_duplicates", duplicate_stage),
    ("decontamination", benchmark_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't run the vocabulary's merges; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
