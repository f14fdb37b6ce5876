"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One or more of the ASCII white-space characters that separate words.
WS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words(text: Column) -> Column:
    """The words of a text: maximal runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, WS), "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable (else a lambda would compute it per element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the cluster's spark.checkpoint.dir. Where that is unset, one of our own in local mode (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/strandloom-shared"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so that a lost executor costs no recomputation.

    Results are lazy and may read the table long after this returns, so it is deleted when the driver ends.
    """
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """While actions run in this block, Arrow batches to Python hold at most ``size``; the setting returns to what it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
