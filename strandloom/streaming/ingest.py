"""Incremental ingestion (IDX-7 to IDX-11) on Structured Streaming: micro-batches upsert passages into a versioned store.

A file source gives at most FILES files per micro-batch; the checkpoint makes a restart continue after the last commit. A
batch is written as a delta of its own rows and becomes visible by its marker, so that a failed batch leaves no trace; every
COMPACT deltas are merged into a full version. Deltas and versions that were merged stay, as readers may still hold them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import ids

FILES = 15
COMPACT = 16
#: Tables that take deltas, and the key by which a delta's rows replace older ones.
KEYS = {"passages": "doc_id"}
SCHEMA = "doc_id long, text string, lang string, source string"


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be indexed, and rows that cannot, with the reason."""
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col("text").isNull() | (F.trim("text") == ""), "no text")
    marked = docs.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


class Store:
    """Versioned parquet tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(conf)

    def versions(self, table: str, kind: str = "v") -> list[int]:
        """Numbers of the complete full versions (kind v) or deltas (kind d) of a table."""
        jvm, fs = self._fs()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n[2:]) for n in names if n.startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{n}/_SUCCESS")))

    def read(self, table: str, schema: str) -> DataFrame:
        found = self.versions(table)
        last = found[-1] if found else -1
        base = self.spark.read.schema(schema).parquet(f"{self.path}/{table}/v={last}") if found else self.spark.createDataFrame([], schema)
        deltas = self.deltas(table, last)
        if not deltas:
            return base
        key = KEYS[table]
        rows = self.spark.read.schema(f"{schema}, version int").parquet(*[f"{self.path}/{table}/d={n}" for n in deltas])
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*base.columns), "version").alias("r")).select("r.*")
        return newest.unionByName(base.join(newest.select(key), key, "left_anti").select(base.columns)) if found else newest

    def deltas(self, table: str, after: int = -1) -> list[int]:
        return [n for n in self.versions(table, "d") if n > after]

    def write(self, table: str, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/v={version}")

    def write_delta(self, table: str, df: DataFrame, version: int) -> None:
        df.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/{table}/d={version}")


PASSAGES = "doc_id long, passage_id string, text string, text_hash string, language string, source_url string"


def to_passages(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", ids.passage_id(ids.chunk_id("doc_id", F.lit(0))).alias("passage_id"), "text", ids.text_hash("text").alias("text_hash"), F.col("lang").alias("language"), F.col("source").alias("source_url"))


def index_batch(store: Store, docs: DataFrame, version: int, compact: int = COMPACT) -> None:
    """IDX-7: rows of the batch replace those with their ids; unreadable ones go to quarantine. Running a batch again changes nothing."""
    good, bad = quarantine(docs)
    full = max(store.versions("passages"), default=-1)
    if version > full:  # else the batch is part of a full version already
        store.write_delta("passages", to_passages(good.dropDuplicates(["doc_id"])), version)
        if len(store.deltas("passages", full)) >= compact:
            store.write("passages", store.read("passages", PASSAGES), version)
    bad.withColumn("batch", F.lit(version)).write.mode("overwrite").parquet(f"{store.path}/quarantine/batch={version}")


def ingest(spark: SparkSession, source: str, store_path: str, checkpoint: str, files: int = FILES, on_batch: Callable | None = None):
    """A stream from parquet files of documents into the store; call ``processAllAvailable`` or wait for it to end."""
    store = Store(spark, store_path)

    def each(df: DataFrame, batch: int) -> None:
        index_batch(store, df, batch + 1)
        if on_batch:
            on_batch(batch)

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def skip_processed(docs: DataFrame, done: DataFrame) -> DataFrame:
    """IDX-7 in batch form: documents that a checkpoint table does not have yet."""
    return docs.join(done.select("doc_id"), "doc_id", "left_anti")


def chunked(df: DataFrame, order: str, size: int = 4096) -> DataFrame:
    """IDX-8: mutations numbered into chunks of at most ``size`` items per section, the last one marked."""
    from pyspark.sql import Window

    w = Window.partitionBy("section").orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy("section"))
    at = F.floor((F.row_number().over(w) - 1) / size).cast("int")
    return df.withColumn("chunk", at).withColumn("last", at == F.floor((n - 1) / size).cast("int"))


class VersionedCache:
    """IDX-9: one cached result per version; a failed refresh serves the stale one and waits twice as long each time."""

    def __init__(self, load: Callable, first_wait: float = 0.25, longest: float = 30.0, clock: Callable = time.monotonic):
        self.load, self.first, self.longest, self.clock = load, first_wait, longest, clock
        self.version = self.value = None
        self.wait, self.until = first_wait, 0.0

    def get(self, version):
        if version == self.version:
            return self.value
        if self.value is not None and self.clock() < self.until:
            return self.value
        try:
            value = self.load(version)
        except Exception:
            if self.value is None:
                raise  # nothing to serve yet: fail at once
            self.until, self.wait = self.clock() + self.wait, min(self.longest, 2 * self.wait)
            return self.value
        self.value, self.version, self.wait, self.until = value, version, self.first, 0.0
        return value


def gather(sources: dict[str, Callable], soft_timeout: float = 30.0) -> tuple[dict, dict[str, str]]:
    """IDX-10: results of several sources by name and the reasons of those that failed or took too long; an error if all did."""
    from concurrent.futures import ThreadPoolExecutor, wait

    pool = ThreadPoolExecutor(max_workers=max(1, len(sources)))
    jobs = {pool.submit(f): n for n, f in sources.items()}
    done, late = wait(jobs, timeout=soft_timeout)
    pool.shutdown(wait=False, cancel_futures=True)
    ok, failed = {}, {jobs[j]: "timeout" for j in late}
    for j in done:
        if j.exception() is None:
            ok[jobs[j]] = j.result()
        else:
            failed[jobs[j]] = str(j.exception())
    if sources and not ok:
        raise RuntimeError(f"all sources failed: {failed}")
    return ok, failed


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension, not in the original design: events per type and tumbling window, for batch or stream."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
