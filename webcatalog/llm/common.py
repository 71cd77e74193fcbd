"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcatalog.session import ship_package

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Steps in which a share of all hashes is taken.
SHARES = 1 << 30
#: Whole texts to a Python worker at once; Spark's own number is meant for narrow rows.
TEXTS_PER_BATCH = 500


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and batches that bound their memory."""
    if int(spark.conf.get(BATCH_ROWS)) > TEXTS_PER_BATCH:
        spark.conf.set(BATCH_ROWS, str(TEXTS_PER_BATCH))
    return ship_package(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session without the setting gets a temporary folder only in local mode, where one
    machine runs everything; elsewhere a machine's own folder would be unreadable.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='llm-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and outlives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the table is whole, so its shuffles are no longer needed
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["written_path"] = path  # for drop_tables
    return table


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("written_path", None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_tie(column: str = "text"):
    """What tells texts apart among rows of one or no doc_id: their SHA-256, null taken as empty."""
    return F.unhex(F.sha2(whole_text(column).cast("binary"), 256))


def sampled(rows: DataFrame, total: int, most: int, keys: list[str]) -> DataFrame:
    """The ``most`` of the ``total`` rows with the smallest hashes of ``keys``.

    A cut of the hashes that leaves somewhat more than these comes before the sort, so what a task sorts and sends
    doesn't grow with the table.
    """
    turn = F.pmod(F.xxhash64(*keys), F.lit(SHARES))
    cut = SHARES if total <= most else min(SHARES, int((1.2 * most + 100) / total * SHARES))
    return rows.where(turn < cut).orderBy(turn, *keys).limit(most)


def row_tie(docs: DataFrame):
    """A digest of 128 bits of whole rows, nulls told apart: rows with equal ones are equal."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    parts = [*columns, *(c.isNull() for c in columns)]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def whole_text(column: str = "text"):
    """The text, null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))
