"""Incremental catalog, frontier and metrics over streams of fetched pages."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webcatalog.operators.normalize import valid
from webcatalog.operators.report import metrics_by_window
from webcatalog.operators.state import latest
from webcatalog.plans.catalog import page_records, stamped
from webcatalog.schemas import PRODUCT_COLUMNS


def page_stream(spark: SparkSession, path: str, ddl: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_catalog(
    pages: DataFrame, compiled: DataFrame, table: str, checkpoint: str, regex: bool | None = None
) -> StreamingQuery:
    """Upsert every micro-batch of pages into a catalog table, as a change log.

    A batch writes only its own winners into ``log/started=<ms>/batch_id=<n>``, so the cost
    follows the batch, not the catalog. A start of a stream has a folder of its own: it never
    overwrites what an earlier one wrote, and a batch that is replayed after a restart merely
    repeats its rows. Readers resolve the latest row per key (:func:`read_incremental`);
    :func:`compact` folds the log. One stream writes to a table at a time.
    """
    folder = f"{table}/log/started={time.time_ns() // 1_000_000}"

    def write(batch: DataFrame, batch_id: int) -> None:
        records = stamped(valid(page_records(batch, compiled, regex=regex)), F.current_timestamp())
        rows = records.withColumn("write_order", F.struct("seq", "rec_no"))
        winners = latest(rows.select(*PRODUCT_COLUMNS, "write_order"), "dedup_key", "write_order")
        winners.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _rows(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows below a folder, with ``at``, the place of their batch; None where there are none."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException:
        return None
    return rows.withColumn("at", F.struct(F.col("started").cast("long").alias("started"), F.col("batch_id").cast("long").alias("batch_id"))).drop("started", "batch_id")


def _current(spark: SparkSession, table: str) -> DataFrame:
    """Latest row per key of the newest base and the batches after it."""
    base, log = _rows(spark, f"{table}/base"), _rows(spark, f"{table}/log")
    if base is None:
        return latest(log, "dedup_key", F.struct("at", "write_order"))
    newest = base.agg(F.max("at").alias("at")).first().at
    at = F.struct(F.lit(newest.started).cast("long").alias("started"), F.lit(newest.batch_id).cast("long").alias("batch_id"))
    rows = base.where(F.col("at") == at)
    if log is not None:
        rows = rows.unionByName(log.where(F.col("at") > at))
    return latest(rows, "dedup_key", F.struct("at", "write_order"))


def read_incremental(spark: SparkSession, table: str) -> DataFrame:
    """Current catalog of a change log: the latest batch wins per key."""
    return _current(spark, table).select(*PRODUCT_COLUMNS)


def compact(spark: SparkSession, table: str) -> None:
    """Fold base and log into a new base beside the log.

    The base is named by the last batch it holds; a stream that runs on adds batches after it.
    Folded batches and older bases may then be deleted.
    """
    log = _rows(spark, f"{table}/log")
    last = log.agg(F.max("at").alias("at")).first().at
    upto = F.struct(F.lit(last.started).cast("long").alias("started"), F.lit(last.batch_id).cast("long").alias("batch_id"))
    folded = _current(spark, table).where(F.col("at") <= upto).drop("at")
    folded.write.mode("errorifexists").parquet(f"{table}/base/started={last.started}/batch_id={last.batch_id}")


def stream_frontier(urls: DataFrame, within: str | None = None, at: str = "at") -> DataFrame:
    """Insert-if-absent over a stream of discovered URLs.

    With ``within`` a URL is remembered for that long (bounded state); without, for ever.
    """
    if within is None:
        return urls.dropDuplicates(["url"])
    return urls.withWatermark(at, within).dropDuplicatesWithinWatermark(["url"])


def stream_metrics(log: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Windowed run metrics; rows later than ``delay`` behind the newest are dropped."""
    return metrics_by_window(log.withWatermark("at", delay), width)


def write_metrics(metrics: DataFrame, table: str, checkpoint: str):
    """Append the windows that each micro-batch of ``stream_metrics`` changes to ``table``, replay-safe by batch.

    A batch that runs again replaces its own folder; ``read_metrics`` takes a window's newest values.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    stream = metrics.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()


def read_metrics(spark: SparkSession, table: str) -> DataFrame:
    """One row per window: (window_start, pages, failures, coverage)."""
    values = ["pages", "failures", "coverage"]
    rows = spark.read.schema("window_start timestamp, pages long, failures long, coverage double, batch_id long").parquet(table)
    newest = rows.groupBy("window_start").agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select("window_start", "v.*")
