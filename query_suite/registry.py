"""Query registry and the table readers the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webcatalog import fixtures
from webcatalog.operators.profiles import compile_profiles
from webcatalog.session import ship_package, small_batches
from webcatalog.sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the tables of one folder and the archives derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    @property
    def part(self) -> DataFrame:
        return spread(self.read("part"))  # rendering and parsing pages is CPU work

    def profiles(self) -> DataFrame:
        return compile_profiles(fixtures.profiles(self.spark))

    def listings(self) -> DataFrame:
        return fixtures.listing_pages(self.part)

    def cards(self) -> DataFrame:
        return fixtures.css_pages(self.part)

    def details(self) -> DataFrame:
        return fixtures.detail_pages(self.part)

    def responses(self) -> DataFrame:
        return fixtures.api_responses(self.part, self.read("supplier"))

    def products(self) -> DataFrame:
        return fixtures.products(self.part)

    def log(self) -> DataFrame:
        return fixtures.crawl_log(self.read("events"))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name, with its SQL counterpart where there is one."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(small_batches(ship_package(spark)), folder))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


# --- SQL fragments shared by several oracles -------------------------------------------------

# The catalog that ``fixtures.products`` derives.
PRODUCTS_SQL = """products AS (
  SELECT 'P' || p_partkey AS dedup_key, p_name || ' ' || p_partkey AS name, 'P' || p_partkey AS sku,
    CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS brand,
    'Parts > ' || p_type AS category_path,
    CASE WHEN p_partkey % 29 <> 0 THEN p_type END AS source_category,
    'https://shop.example.com/product/' || p_partkey AS product_url,
    CASE WHEN p_partkey % 23 <> 0 THEN p_retailprice END AS price,
    'USD' AS currency, CAST(NULL AS VARCHAR) AS pack_size,
    CASE p_size % 5 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'preorder'
      WHEN 3 THEN 'discontinued' ELSE 'unknown' END AS availability,
    CASE WHEN p_size % 7 <> 0 THEN 'A ' || p_name END AS description,
    CASE WHEN p_partkey % 3 = 0 THEN '{"Size":"' || p_size || '"}' ELSE '{}' END AS specifications,
    CASE WHEN p_partkey % 6 <> 0 THEN '["/img/' || p_partkey || '"]' ELSE '[]' END AS image_urls,
    CASE WHEN p_partkey % 4 = 0 THEN p_size / 10.0::DOUBLE END AS rating,
    p_partkey, p_size, p_name
  FROM part)"""

# Listing page number, identifiers and addresses of each part.
PAGED_SQL = """paged AS (
  SELECT part.*, p_partkey // 625 + 1 AS page, max(p_partkey // 625 + 1) OVER () AS last_page,
    replace(lower(p_brand), '#', '-') AS slug,
    ((p_partkey // 625 + 1) * 1000 + CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT)) AS seq
  FROM part),
places AS (
  SELECT *, seq * 10 + 1 AS page_id, seq * 10 + 2 AS card_id,
    'https://shop.example.com/catalog/' || slug || CASE WHEN page > 1 THEN '?p=' || page ELSE '' END AS url,
    'http://www.cards.example.org/list/' || slug || '/page-' || page || '.html' AS card_url
  FROM paged)"""

STATE_SQL = """CASE p_size % 5 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'preorder'
      WHEN 3 THEN 'discontinued' ELSE 'unknown' END"""

SIGNATURE_SQL = """substr(sha256('{{"blocks": {blocks}, "landmarks": ["html", "head", "body", "header", "nav",'
    || ' "main", "footer", "form"], "types": [{types}]}}'), 1, 16)"""
LISTING_SIGNATURE = SIGNATURE_SQL.format(blocks=3, types='"BreadcrumbList", "ItemList"')
DETAIL_SIGNATURE = SIGNATURE_SQL.format(blocks=2, types='"BreadcrumbList", "Product"')
CARD_SIGNATURE = SIGNATURE_SQL.format(blocks=0, types="")
