"""Typed readers, overwrite sinks and stage tables."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from ledgerlint.functions.text import sentinels_to_null

# Texts that a CSV round trip turns into missing values.
NULL_SENTINELS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def clean_nulls(df: DataFrame, null_sentinels: list[str] | None = None) -> DataFrame:
    """Turn sentinel texts and NaN numbers into NULL, once, at ingestion."""
    sentinels = NULL_SENTINELS if null_sentinels is None else null_sentinels
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, StringType) and sentinels:
            c = sentinels_to_null(c, sentinels)
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: str | StructType,
             null_sentinels: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header line. ``multi_line`` allows line breaks inside quotes; each file is then
    read by one task, otherwise files are split."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line)
          .option("escape", '"').csv(path))
    return clean_nulls(df, null_sentinels)


def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_ranked(df: DataFrame, path: str, order: list) -> None:
    """Write in global order: file n sorts before file n + 1."""
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").parquet(path))


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by the cluster in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="ledgerlint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_RUN: contextvars.ContextVar[str | None] = contextvars.ContextVar("run", default=None)


@contextlib.contextmanager
def stage_tables(spark: SparkSession) -> Iterator[str]:
    """A run whose stage tables end with it. What is written by :func:`materialise` inside lies in one folder, which
    is removed when the run ends well and kept when it fails. Results must be written or collected inside: their
    plans read stage tables. A run inside another has its own folder."""
    folder = f"{shared_folder(spark)}/ledgerlint/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
    _remove(spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)  # any store Spark can write to
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{_RUN.get() or shared_folder(spark) + '/ledgerlint'}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing a stage table; unlike cached blocks it outlives executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
