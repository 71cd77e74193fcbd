"""Scans: pages, profiles, recipes, responses, catalog and state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcatalog.schemas import RULE_DDL
from webcatalog.sources.recipes import read_source_recipes  # noqa: F401


def spread(df: DataFrame) -> DataFrame:
    """Give a scan with fewer splits than cores enough partitions for CPU-heavy steps.

    A large scan already has them and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages from Parquet; missing optional columns get their defaults."""
    pages = spread(spark.read.parquet(path))
    defaults = {
        "status": F.lit(200), "kind": F.lit("category"),
        "source_category": F.lit(None).cast("string"), "seq": F.col("page_id"),
    }
    return pages.withColumns({k: v for k, v in defaults.items() if k not in pages.columns})


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """A directory of ``.html`` files, one page each; the file path stands for the URL."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(
        F.xxhash64(F.input_file_name()).alias("page_id"), F.input_file_name().alias("url"),
        F.lit(200).alias("status"), F.col("value").alias("html"),
    )


_PROFILE_FILE_DDL = (
    "site string, template string, cardinality string, `match` struct<url_glob: string>,"
    " item_selector string, discovery map<string, string>,"
    f" fields map<string, {RULE_DDL}>, template_signature string, last_validated string,"
    " ttl_hours int, field_confidence map<string, double>, version int, authored_by string"
)


def _json_files(spark: SparkSession, root: str, ddl: str, names: str) -> DataFrame:
    # File sources skip names that start with ``_``, so recipes never show up as profiles.
    reader = spark.read.schema(ddl).option("multiLine", True).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", names).json(root)


def read_profiles(spark: SparkSession, root: str, names: str = "*.json") -> DataFrame:
    """Profile documents ``<domain>/<template>.json``; unknown keys are dropped.

    A file holds one document or an array of them.
    """
    files = _json_files(spark, root, _PROFILE_FILE_DDL, names)
    filled = files.withColumns(
        {
            "url_glob": F.col("match.url_glob"),
            "cardinality": F.coalesce("cardinality", F.lit("one")),
            "discovery": F.coalesce("discovery", F.create_map().cast("map<string, string>")),
            "ttl_hours": F.coalesce("ttl_hours", F.lit(168)),
            "field_confidence": F.coalesce("field_confidence", F.create_map().cast("map<string, double>")),
            "version": F.coalesce("version", F.lit(1)),
            "authored_by": F.coalesce("authored_by", F.lit("hand")),
        }
    )
    columns = [
        "site", "template", "cardinality", "url_glob", "item_selector", "discovery", "fields",
        "template_signature", "last_validated", "ttl_hours", "field_confidence", "version",
        "authored_by",
    ]
    return filled.select(*columns)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The product table in (source_category, name) order."""
    return spark.read.parquet(path).orderBy("source_category", "name")


def read_api_responses(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Frontier, dead-letter or help table."""
    return spark.read.parquet(path)
