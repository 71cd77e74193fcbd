"""Sinks: catalog exports, run summary, profiles, recipes and table swaps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.operators.normalize import to_flat_rows
from webcatalog.operators.profiles import profile_domain
from webcatalog.operators.state import latest


def export_json(products: DataFrame, path: str) -> str:
    """JSON lines: nested columns stay objects, the category path is one joined string."""
    rows = products.withColumn("category_path", F.array_join("category_path", " > "))
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def export_csv(products: DataFrame, path: str) -> str:
    """CSV with a header: the fixed flat columns, nested ones as JSON text."""
    writer = to_flat_rows(products).write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path)
    return path


EXPORTERS = {"json": export_json, "csv": export_csv}


def export_all(products: DataFrame, folder: str, formats: Iterable[str]) -> list[str]:
    """Write each known format; unknown ones are skipped, an empty catalog writes nothing."""
    wanted = [f for f in EXPORTERS if f in set(formats)]
    cached = products.persist()
    try:
        if cached.isEmpty():
            return []
        return [EXPORTERS[f](cached, f"{folder}/products_{f}") for f in wanted]
    finally:
        cached.unpersist()


def write_run_summary(summary: DataFrame, path: str) -> str:
    """The one-row summary as a single JSON file."""
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def save_profiles(existing: DataFrame | None, saved: DataFrame, order: str = "version") -> DataFrame:
    """Profile table after a save: the last one per (domain, template) replaces the old one."""
    keyed = lambda df: df.withColumn(
        "_key", F.concat_ws("/", profile_domain(F.col("site")), "template")
    )
    new = latest(keyed(saved), "_key", order)
    if existing is None:
        return new.drop("_key")
    kept = keyed(existing).join(new.select("_key"), "_key", "left_anti")
    return kept.unionByName(new).drop("_key")


def save_source_recipes(existing: DataFrame | None, saved: DataFrame, order: str = "seq") -> DataFrame:
    """Recipe table after a save: the last recipe per domain wins."""
    new = latest(saved, "domain", order).drop(order)
    if existing is None:
        return new
    return existing.join(new.select("domain"), "domain", "left_anti").unionByName(new)


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> str:
    """Parquet table at a fresh path: results of a merge never overwrite what they read."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path
