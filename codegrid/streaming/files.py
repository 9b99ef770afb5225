"""Structured Streaming (X1-X5): files arriving in a folder.

The batch operators are narrow projections, so they run unchanged on the
stream (X1, X2). Running totals are a streaming aggregation (X3); the
latest version per file key is keyed state with a time to live, written as a
log of changes (X4); end-of-stream views are batch jobs over the tables the
stream has written (X5). Sinks write one folder per epoch and replace it when
the epoch is replayed. Every query keeps its
checkpoint under the shared ``spark.checkpoint.dir``, so a restarted or
re-planned run continues where it stopped.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ensure_checkpoint_dir
from ..sources import listing
from ..sources.tree import BINARY_SCHEMA, tree_files


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}-d"


# ------------------------------------------------------------------ X1
#: files of a micro-batch: enough that its fixed costs (jobs, commits, state) are shared by many small files
MAX_FILES = 50_000
#: what a stream of small files needs: some hundred to a task, for listing and for reading; by default a batch lists up to 10000 paths
#: in a task each, and a file counts as 4 MB
FILE_SETTINGS = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "100", "spark.sql.files.openCostInBytes": "256k"}


def stream_files(spark: SparkSession, root: str, repo: str | None = None, max_files_per_trigger: int = MAX_FILES,
                 **filters) -> DataFrame:
    """Newly arrived files under ``root`` as ``files`` rows (same filters as
    the batch reader). Run it with ``FILE_SETTINGS``. A local root is streamed by its inventory (``listing``): a batch takes whole pieces of it, those
    of this call hold at most ``max_files_per_trigger`` files. Other roots are listed by Spark's source, whose driver holds every path."""
    piece = min(listing.PIECE, max_files_per_trigger)
    found = listing.inventory(spark, root, piece)
    if found is not None:
        listing.follow(spark, root, piece)
        raw = (spark.readStream.schema(listing.META).option("recursiveFileLookup", "true")
               .option("maxFilesPerTrigger", max_files_per_trigger // piece).parquet(found))
        return tree_files(raw, root, repo, **filters)
    raw = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
           .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files_per_trigger)
           .load(root.rstrip("/")))
    return tree_files(raw, root, repo, **filters)


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", foreach_batch=None,
                      fmt: str = "parquet", folder: str | None = None, settings: dict[str, str] | None = None) -> str:
    """Run a streaming frame over everything available, then stop; returns the output folder. Called again with the same
    ``folder``, it goes on where the last run stopped: what has been read is not read again, and state is kept.
    ``settings`` hold while it runs."""
    spark = df.sparkSession
    out = folder or _scratch(spark, name)
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    writer = (df.writeStream.outputMode(output_mode)
              .option("checkpointLocation", out + "/_checkpoint").trigger(availableNow=True))
    try:  # a query takes its settings when it starts; its source reads those of the session, batch after batch
        if foreach_batch is not None:
            q = writer.foreachBatch(lambda batch, epoch: foreach_batch(batch, epoch, out + "/data")).start()
        else:
            q = writer.format(fmt).start(out + "/data")
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if q.exception() is not None:
        raise q.exception()
    return out + "/data"


# ------------------------------------------------------------------ X2
def stream_symbols(files_stream: DataFrame, extractor) -> DataFrame:
    """Stateless extraction per micro-batch (any narrow batch operator)."""
    return extractor(files_stream)


# ------------------------------------------------------------------ X3
def running_totals(files_stream: DataFrame) -> DataFrame:
    """Running file count per language (complete / update mode)."""
    return files_stream.groupBy("language").agg(F.count("*").alias("files"))


def write_complete(batch: DataFrame, epoch: int, path: str) -> None:
    """foreachBatch sink for complete mode: the batch *is* the result."""
    batch.write.mode("overwrite").parquet(path)


# ------------------------------------------------------------------ X4
#: what ``latest_version`` needs: a store with column families, and no batches without data, which state that is to expire would ask for endlessly
LATEST_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                   "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class _Latest(StatefulProcessor):
    """Keeps the newest (version, ts) of a key and lets through what is newer."""

    def __init__(self, key: str, version: str, ts: str, columns: list[str], ttl_seconds: int) -> None:
        self.key, self.version, self.ts, self.columns, self.ttl_ms = key, version, ts, columns, ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "version long, ts long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = self.newest.get() if self.newest.exists() else None
        best = None
        for pdf in rows:
            pdf = pdf.set_axis([self.key, self.version, self.ts, *self.columns, "_at"], axis=1)  # Spark renames some
            part = pdf if best is None else pd.concat([best, pdf])
            best = part.sort_values([self.version, "_at", *self.columns], kind="stable").tail(1)
        if best is None:
            return
        now = (int(best[self.version].iloc[0]), int(best["_at"].iloc[0]))
        if held is None or now > (held[0], held[1]):
            self.newest.update(now)
            yield best[[self.key, self.version, self.ts, *self.columns]]

    def close(self) -> None:
        pass


def latest_version(stream: DataFrame, key: str, version: str, ts: str, payload: list[str], ttl_seconds: int = 7 * 86400) -> DataFrame:
    """Rows (key, version, ts, payload) that are newer than all their key had before (update mode). The newest version and time of a key are
    keyed state in RocksDB; the state of a key that gets no newer version for ``ttl_seconds`` is evicted. Re-delivered and
    older rows are absorbed; after an eviction one may pass again, which the view of the log (``latest_view``) absorbs. No row is dropped for being late.
    Rows with a null key, version or ts are no versions and are left out; equal versions go by ts, then by the payload. Run it with ``LATEST_SETTINGS``."""
    kinds = dict(stream.dtypes)
    rows = (stream.select(key, version, ts, *payload).dropna(subset=[key, version, ts])
            .withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))))
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, version, ts, *payload))
    return rows.groupBy(key).transformWithStateInPandas(_Latest(key, version, ts, payload, ttl_seconds), schema, "Update", "ProcessingTime")


def drop_redelivered(stream: DataFrame, key: list[str], ts: str, watermark: str = "1 day") -> DataFrame:
    """Re-delivered rows (same key, e.g. file and version) arriving within
    the watermark are dropped; append mode, bounded state."""
    stream = stream.withColumn("_event_time", F.col(ts).cast("timestamp"))
    return stream.withWatermark("_event_time", watermark).dropDuplicatesWithinWatermark(key).drop("_event_time")


def write_epoch(batch: DataFrame, epoch: int, path: str) -> None:
    """foreachBatch sink: the rows of an epoch are one folder, which a replay of that epoch replaces."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={epoch}")


def latest_view(spark: SparkSession, log: str, key: str, version: str, ts: str, payload: list[str]) -> DataFrame:
    """The newest row of each key in the log that ``latest_version`` has written by ``write_epoch``."""
    rows = spark.read.parquet(log)
    return rows.groupBy(key).agg(F.max(F.struct(version, ts, *payload)).alias("latest")).select(key, "latest.*")


# ------------------------------------------------------------------ X5
def write_tables(builders: dict):
    """foreachBatch writer of several derived tables per epoch: ``builders`` maps a table's name to a function from the
    batch's files to its rows. Each table has one folder per epoch, which a replay replaces, so a batch that is written
    twice, or only in part before a failure, counts once."""
    def write(batch: DataFrame, epoch: int, path: str) -> None:
        batch.persist()
        try:
            for name, build in builders.items():
                write_epoch(build(batch), epoch, f"{path}/{name}")
        finally:
            batch.unpersist()
    return write


def read_tables(spark: SparkSession, path: str, names) -> dict[str, DataFrame]:
    """The tables that ``write_tables`` has written, over all epochs."""
    return {name: spark.read.parquet(f"{path}/{name}").drop("batch_id") for name in names}


def summary(files: DataFrame) -> DataFrame:
    """End-of-stream summary: (files, languages) of all files (language) that came, languages sorted and joined by ', '."""
    per = files.groupBy("language").agg(F.count("*").alias("n"))  # a few rows, whatever came
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.array_join(F.array_sort(F.collect_list("language")), ", ").alias("languages"))
