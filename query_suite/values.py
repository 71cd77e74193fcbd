"""Normalisation, scoring and export rows over records with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from query_suite.registry import PRODUCTS_SQL, STATE_SQL, Tables, query
from webcatalog import fixtures
from webcatalog.operators import normalize as N
from webcatalog.operators.report import field_coverage as catalog_coverage

# The clean form of ``fixtures.dirty_records``.
DIRTY_SQL = f"""dirty AS (
  SELECT p_partkey AS page_id, p_partkey AS n,
    CASE WHEN p_partkey % 19 <> 0 AND p_partkey % 13 <> 0 THEN p_name END AS name,
    p_partkey % 17 = 0 AS bad_sku,
    CASE WHEN p_partkey % 5 <> 0 THEN 'p-' || p_partkey END AS sku,
    CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand,
    CASE p_partkey % 6 WHEN 0 THEN p_retailprice WHEN 1 THEN 1234.5 WHEN 2 THEN 10.5 WHEN 3 THEN 99.0
      WHEN 4 THEN -12.0 END::DOUBLE AS price,
    {STATE_SQL} AS availability,
    CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'Parts > ' || p_type END AS category_path,
    CASE WHEN p_partkey % 2 = 0 THEN 'https://shop.example.com/catalog/list/img/' || p_partkey || '.png' END AS image,
    CASE WHEN p_partkey % 7 <> 0 THEN 'https://shop.example.com/catalog/item/' || p_partkey
      ELSE 'https://shop.example.com/catalog/list/' || (p_partkey % 50) END AS product_url,
    CASE WHEN p_partkey % 10 < 3 THEN 'fine part' END AS description
  FROM part),
kept AS (SELECT * FROM dirty WHERE name IS NOT NULL AND NOT bad_sku),
scored AS (
  SELECT *, (1 + (sku IS NOT NULL)::INT + (brand IS NOT NULL)::INT + (price IS NOT NULL)::INT + 1
    + (description IS NOT NULL)::INT + (image IS NOT NULL)::INT + 1) / 8.0::DOUBLE AS coverage FROM kept)"""


def _normalized(t: Tables) -> DataFrame:
    return N.normalize(fixtures.dirty_records(t.part))


def _valid(t: Tables) -> DataFrame:
    return N.valid(_normalized(t))


@query("norm_availability", f"WITH {DIRTY_SQL} SELECT page_id, availability FROM kept")
def norm_availability(t: Tables) -> DataFrame:
    return _valid(t).select("page_id", "availability")


@query("norm_price", f"WITH {DIRTY_SQL} SELECT page_id, price FROM kept")
def norm_price(t: Tables) -> DataFrame:
    return _valid(t).select("page_id", "price")


@query("norm_category_path", f"WITH {DIRTY_SQL} SELECT page_id, category_path FROM kept")
def norm_category_path(t: Tables) -> DataFrame:
    return _valid(t).select("page_id", F.array_join("category_path", " > ").alias("category_path"))


@query("dedup_key", f"WITH {DIRTY_SQL} SELECT page_id, coalesce(upper(sku), lower(product_url)) AS dedup_key FROM kept")
def dedup_key(t: Tables) -> DataFrame:
    return _valid(t).select("page_id", "dedup_key")


@query(
    "normalize_records",
    f"""WITH {DIRTY_SQL}
       SELECT page_id, name, sku, sku AS item_number_trimmed, brand, category_path, product_url, price, 'USD' AS currency,
         availability, description, image, 'css' AS extraction_tier FROM kept""",
)
def normalize_records(t: Tables) -> DataFrame:
    return _valid(t).select(
        "page_id", "name", "sku", F.nullif(F.trim("item_number"), F.lit("")).alias("item_number_trimmed"), "brand",
        F.array_join("category_path", " > ").alias("category_path"), "product_url", "price", "currency",
        "availability", "description", F.get("image_urls", F.lit(0)).alias("image"), "extraction_tier",
    )


@query(
    "validation_failures",
    f"""WITH {DIRTY_SQL}
       SELECT page_id, CASE WHEN name IS NULL THEN 'record has no product name' ELSE 'type:sku' END AS reason
       FROM dirty WHERE name IS NULL OR bad_sku""",
)
def validation_failures(t: Tables) -> DataFrame:
    return N.rejected(_normalized(t)).select("page_id", "reason")


@query("record_coverage", f"WITH {DIRTY_SQL} SELECT page_id, coverage FROM scored")
def record_coverage(t: Tables) -> DataFrame:
    return N.with_coverage(_valid(t)).select("page_id", "coverage")


@query(
    "low_coverage_pages",
    f"""WITH {DIRTY_SQL},
       pages10 AS (SELECT DISTINCT page_id // 10 AS page_id FROM dirty),
       means AS (SELECT page_id // 10 AS page_id, avg(coverage) AS coverage, count(*) AS records FROM scored GROUP BY 1)
       SELECT page_id, coalesce(coverage, 0) AS coverage, CAST(coalesce(records, 0) AS BIGINT) AS records
       FROM pages10 LEFT JOIN means USING (page_id) WHERE coalesce(coverage, 0) < 0.73""",
)
def low_coverage_pages(t: Tables) -> DataFrame:
    # Ten records share a page here.
    grouped = (F.col("page_id") / 10).cast("long")
    scored = N.with_coverage(_valid(t)).withColumn("page_id", grouped)
    pages = t.part.select((F.col("p_partkey") / 10).cast("long").alias("page_id")).distinct()
    return N.low_coverage_pages(pages, scored, 0.73)


@query(
    "missing_fields",
    f"""WITH {DIRTY_SQL},
       firsts AS (SELECT n // 10 AS page_id, arg_min(concat_ws(',',
           CASE WHEN sku IS NULL THEN 'sku' END, CASE WHEN brand IS NULL THEN 'brand' END,
           CASE WHEN coalesce(price, 0) = 0 THEN 'price' END,
           CASE WHEN description IS NULL THEN 'description' END, CASE WHEN image IS NULL THEN 'image_urls' END), n) AS missing
         FROM kept GROUP BY 1)
       SELECT page_id, coalesce(missing, 'name,sku,brand,price,availability,description,image_urls,category_path') AS missing
       FROM (SELECT DISTINCT n // 10 AS page_id FROM dirty) LEFT JOIN firsts USING (page_id)""",
)
def missing_fields(t: Tables) -> DataFrame:
    page = (F.col("page_id") / 10).cast("long")
    records = _valid(t).withColumn("rec_no", F.col("page_id")).withColumn("page_id", page)
    pages = t.part.select((F.col("p_partkey") / 10).cast("long").alias("page_id")).distinct()
    missing = N.missing_fields(pages, records)
    return missing.select("page_id", F.array_join("missing", ",").alias("missing"))


@query(
    "field_coverage",
    f"""WITH {PRODUCTS_SQL}, shares AS (SELECT
         count(name) / count(*) AS name, count(sku) / count(*) AS sku, count(brand) / count(*) AS brand,
         count(price) / count(*) AS price, count(*) FILTER (availability <> 'unknown') / count(*) AS availability,
         count(description) / count(*) AS description,
         count(*) FILTER (image_urls <> '[]') / count(*) AS image_urls, 1.0 AS category_path,
         count(*) FILTER (specifications <> '{{}}') / count(*) AS specifications,
         count(rating) / count(*) AS rating, 0.0 AS alternatives FROM products)
       SELECT field, round(coverage::DOUBLE, 3) AS coverage FROM (UNPIVOT (SELECT COLUMNS(*)::DOUBLE FROM shares)
         ON COLUMNS(*) INTO NAME field VALUE coverage)""",
)
def field_coverage(t: Tables) -> DataFrame:
    return catalog_coverage(t.products())


@query(
    "export_flat_rows",
    f"""WITH {PRODUCTS_SQL}
       SELECT dedup_key, name, sku, sku AS item_number, brand, category_path, source_category, product_url, price, currency,
         pack_size, availability, description, specifications, image_urls, rating, '[]' AS variants,
         '[]' AS alternatives, 'jsonld' AS extraction_tier FROM products""",
)
def export_flat_rows(t: Tables) -> DataFrame:
    return N.to_flat_rows(t.products()).drop("scraped_at")
