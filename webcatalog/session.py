"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_BATCH_ROWS, _PAGES_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def build_session(app: str = "webcatalog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; cluster settings win where present."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        _BATCH_ROWS: str(_PAGES_PER_BATCH),
        "spark.ui.enabled": "false",
        # Methods beyond what the JIT compiles run slower than plain expression evaluation.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Call-site capture makes building large column expressions slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="webcatalog-")) / "webcatalog_src.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches that bound the pages a Python worker holds; Spark's own number is meant for narrow rows."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= _PAGES_PER_BATCH:
        spark.conf.set(_BATCH_ROWS, str(_PAGES_PER_BATCH))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a session in local mode may go without one and gets a temporary folder; on a cluster
    the machines could not read each other's.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='webcatalog-ckpt-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)
