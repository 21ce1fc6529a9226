"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's reader alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower Spark's default of 10,000 rows an Arrow batch, as texts can be long; a value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir.

    Where that is unset, a local master (as in tests) gets a temporary folder; a cluster gets an error, since its machines
    don't share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.gettempdir()
    return os.path.join(found.rstrip("/"), f"quern-{spark.sparkContext.applicationId}")


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder of this application, in whatever store it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Remove all tables that the operators wrote for this application; call it when their results have been used."""
    dropped(spark, shared_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files that outlive any executor."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored(), with the path, for tables that are dropped when the next one is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def packed_rows(docs: DataFrame, keep: list[str] | None, text_col: str, *more) -> DataFrame:
    """(_keep, _text, more...): the kept columns (default doc_id) travel as one, so that no name can clash with an operator's own."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or ["doc_id"])).alias("_keep"), F.col(text_col).alias("_text"), *more)


def unpacked_rows(rows: DataFrame, *results) -> DataFrame:
    """The kept columns and the results; where both have a name, the result's counts."""
    own = set(rows.select(*results).columns)
    kept = [f.name for f in rows.schema["_keep"].dataType if f.name not in own]
    return rows.select(*(F.col(f"_keep.`{c}`").alias(c) for c in kept), *results)


def ascii_lower(c):
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


#: Byte table for word splitting: A-Z lowered, digits, a-z and everything beyond ASCII kept, the rest a blank.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(data: bytes) -> list[bytes]:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return data.translate(WORD_TABLE).split()
