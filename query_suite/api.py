"""API path over rendered response pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from query_suite.registry import Tables, query
from webcatalog.functions.values import member
from webcatalog.operators import api as A
from webcatalog.operators.report import completeness as check_totals
from webcatalog.operators.report import extracted_counts
from webcatalog.options import Options
from webcatalog.plans.catalog import build_catalog_api as build

HITS_SQL = """hits AS (
  SELECT part.*, s_name, p_partkey // 600 AS api_page,
    'https://shop.example.com/catalog/' || lower(p_type) AS page_url
  FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 10),
visible AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY api_page, p_partkey) AS n
  FROM hits WHERE p_partkey % 4 <> 0)"""


@query("api_explode_hits", f"WITH {HITS_SQL} SELECT page_url, p_type AS category_id, api_page, p_name || ' ' || p_partkey AS name FROM hits")
def api_explode_hits(t: Tables) -> DataFrame:
    hits = A.explode_hits(t.responses())
    return hits.select("page_url", "category_id", F.col("api_page").cast("long").alias("api_page"), A.hit_text("name").alias("name"))


@query(
    "api_stops_at_empty_page",
    f"""WITH {HITS_SQL} SELECT p_type AS category_id, CAST(count(*) AS BIGINT) AS hits FROM hits WHERE api_page < 1 GROUP BY 1""",
)
def api_stops_at_empty_page(t: Tables) -> DataFrame:
    emptied = F.when(F.col("api_page") == 1, F.lit('{"hits":[],"nbPages":99}')).otherwise(F.col("body"))
    hits = A.explode_hits(t.responses().withColumn("body", emptied))
    return hits.groupBy("category_id").agg(F.count("*").alias("hits"))


@query("api_visible_hits", f"WITH {HITS_SQL} SELECT 'https://shop.example.com/product/' || p_partkey AS url FROM visible")
def api_visible_hits(t: Tables) -> DataFrame:
    return A.visible_hits(A.explode_hits(t.responses())).select(A.hit_text("url").alias("url"))


@query("api_cap", f"WITH {HITS_SQL} SELECT 'https://shop.example.com/product/' || p_partkey AS url FROM visible WHERE n <= 20")
def api_cap(t: Tables) -> DataFrame:
    return A.cap_hits(A.visible_hits(A.explode_hits(t.responses())), 20).select(A.hit_text("url").alias("url"))


@query(
    "api_variant_skus",
    f"WITH {HITS_SQL} SELECT p_name || ' ' || p_partkey AS name, '77-' || p_partkey || ',88' || p_partkey AS variants FROM hits",
)
def api_variant_skus(t: Tables) -> DataFrame:
    hits = A.explode_hits(t.responses())
    return hits.select(A.hit_text("name").alias("name"), A.variant_sku_list(member(F.col("hit"), "sku")).alias("variants"))


@query(
    "api_map_hits",
    f"""WITH {HITS_SQL}
       SELECT p_name || ' ' || p_partkey AS name, 'P' || p_partkey AS sku,
         CASE WHEN p_size % 3 <> 0 THEN 'M' || p_partkey END AS item_number, s_name AS brand, p_retailprice AS price,
         CASE WHEN p_size % 4 = 0 THEN 'In Stock' WHEN p_size % 5 = 0 THEN 'InStock' ELSE 'OutOfStock' END AS availability,
         CASE WHEN p_size % 2 = 0 THEN 'https://img.example.com/' ELSE 'https://img.example.com/t/' END || p_partkey AS image_urls,
         'Parts > ' || p_type AS category FROM hits""",
)
def api_map_hits(t: Tables) -> DataFrame:
    raw = A.map_hits(A.explode_hits(t.responses()))
    text = lambda name: F.try_variant_get(F.col("fields")[name], "$", "string").alias(name)
    return raw.select(
        text("name"), text("sku"), text("item_number"), text("brand"),
        F.try_variant_get(F.col("fields")["price"], "$", "double").alias("price"),
        text("availability"), text("image_urls"), text("category"),
    )


def _config_pages(t: Tables) -> DataFrame:
    """Driver pages with a search configuration planted in two thirds of them."""
    n = F.col("page_id")
    index = F.when(n % 4 == 0, "store_default_products_name_asc").otherwise("store_eu_products_v2")
    planted = F.concat(
        F.lit('<script>var c={"applicationId":"APP'), n.cast("string"),
        F.when(n % 3 == 1, '","apiKey":"k').otherwise('","x":"k'), n.cast("string"),
        F.lit('","indexName":"'), index, F.lit('","categoryId":"'), (n + 100).cast("string"), F.lit('"};</script>'),
    )
    return t.read("pages").select("page_id", "url", F.concat("html", F.when(n % 3 != 0, planted).otherwise("")).alias("html"))


@query(
    "api_config",
    """SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'APP' || page_id END AS app_id,
         CASE WHEN page_id % 3 = 1 THEN 'k' || page_id END AS api_key,
         CASE WHEN page_id % 3 = 1 THEN CASE WHEN page_id % 4 = 0 THEN 'store_default_products_name_asc'
           ELSE 'store_eu_products_v2' END END AS index_name,
         CASE WHEN page_id % 3 <> 0 THEN CAST(page_id + 100 AS VARCHAR) END AS category_id,
         page_id % 3 = 1 AS resolved FROM pages""",
)
def api_config(t: Tables) -> DataFrame:
    return A.api_config(_config_pages(t)).drop("url")


def _captured(t: Tables) -> DataFrame:
    """Responses as a browser would capture them: product lists, repeats, widgets and noise."""
    n_capture = F.col("api_page") * 4
    endpoint = F.concat(F.lit("https://api.example.com/q/"), F.lower("category_id"))
    base = t.responses().select("page_url", "category_id", "api_page", "body", endpoint.alias("endpoint"))
    listing = base.select(
        "page_url", n_capture.alias("capture_no"),
        F.concat("endpoint", F.lit("?page="), F.col("api_page").cast("string")).alias("endpoint"), F.lit("POST").alias("method"),
        F.when(F.col("api_page") % 2 == 0, '{"facetFilters":[["categories.level1:x"]]}').alias("post_data"), "body",
    )
    widget = base.select(
        "page_url", (n_capture + 1).alias("capture_no"), F.lit("https://api.example.com/best").alias("endpoint"),
        F.lit("GET").alias("method"), F.lit(None).cast("string").alias("post_data"),
        F.lit('{"count":9999,"items":[{"title":"x","price":1},{"title":"y","url":"u"}]}').alias("body"),
    )
    noise = base.select(
        "page_url", (n_capture + 2).alias("capture_no"), F.lit("https://log.example.com").alias("endpoint"),
        F.lit("POST").alias("method"), F.lit(None).cast("string").alias("post_data"),
        F.lit('{"events":[{"t":1},{"t":2}],"broken').alias("body"),
    )
    return listing.unionByName(widget).unionByName(noise)


_GROUPS_SQL = """pages_of AS (SELECT page_url, p_type, api_page, count(*) AS n FROM hits GROUP BY ALL)"""


@query(
    "record_arrays",
    f"""WITH {HITS_SQL}, {_GROUPS_SQL}
       SELECT page_url, CAST(api_page * 4 AS INT) AS capture_no, 'hits' AS path, CAST(n AS INT) AS n_records, n AS total,
         api_page % 2 = 0 AS category_scoped FROM pages_of
       UNION ALL SELECT page_url, CAST(api_page * 4 + 1 AS INT), 'items', 2, 9999, false FROM pages_of""",
)
def record_arrays(t: Tables) -> DataFrame:
    found = A.find_record_arrays(_captured(t))
    return found.select("page_url", "capture_no", "path", "n_records", "total", "category_scoped")


# Captures of one endpoint that name the same total count once, as first seen.
_BEST_SQL = """once AS (SELECT page_url, n, min(api_page) AS api_page FROM pages_of GROUP BY ALL),
  best AS (SELECT page_url, arg_max(struct_pack(capture_no := api_page * 4, total := n),
    n * 1000000 - api_page) AS b FROM once WHERE api_page % 2 = 0 GROUP BY page_url)"""


@query(
    "best_api",
    f"""WITH {HITS_SQL}, {_GROUPS_SQL}, {_BEST_SQL}
       SELECT page_url, CAST(b.capture_no AS INT) AS capture_no, b.total AS total, true AS category_scoped FROM best""",
)
def best_api(t: Tables) -> DataFrame:
    best = A.best_product_api(A.find_record_arrays(_captured(t)))
    return best.select("page_url", "capture_no", "total", "category_scoped")


@query(
    "completeness",
    f"""WITH {HITS_SQL}, {_GROUPS_SQL}, {_BEST_SQL},
       totals AS (SELECT page_url AS url, p_type, b.total AS api_total FROM best
         JOIN (SELECT DISTINCT page_url, p_type FROM hits) USING (page_url)),
       got AS (SELECT page_url AS url, count(*) AS extracted FROM visible GROUP BY 1)
       SELECT url, CAST(coalesce(extracted, 0) AS BIGINT) AS extracted,
         CASE WHEN p_type < 'M' THEN api_total WHEN p_type < 'P' THEN 90 END AS expected,
         coalesce(coalesce(extracted, 0) >= CASE WHEN p_type < 'M' THEN api_total WHEN p_type < 'P' THEN 90 END, false) AS complete,
         CASE WHEN p_type < 'M' THEN 'data-api:https://api.example.com/q/' || lower(p_type)
           WHEN p_type < 'P' THEN 'html:total-text' ELSE 'unknown' END AS method
       FROM totals LEFT JOIN got USING (url)""",
)
def completeness(t: Tables) -> DataFrame:
    best = A.best_product_api(A.find_record_arrays(_captured(t).join(
        t.part.where("p_type < 'M'").select(F.concat(F.lit("https://shop.example.com/catalog/"), F.lower("p_type")).alias("page_url")).distinct(),
        "page_url", "left_semi",
    )))
    html = F.when(F.col("p_type") < "P", "<b>page 1 of 9</b> 90 Products and 1,234 items").otherwise("<p>5 items, no count</p>")
    pages = t.part.select(
        F.concat(F.lit("https://shop.example.com/catalog/"), F.lower("p_type")).alias("url"), html.alias("html")
    ).distinct()
    counts = extracted_counts(A.visible_hits(A.explode_hits(t.responses())))
    return check_totals(pages, counts, best).drop("recommended_action")


@query(
    "build_catalog_api",
    f"""WITH {HITS_SQL}
       SELECT 'P' || p_partkey AS dedup_key, p_name || ' ' || p_partkey AS name,
         CASE WHEN p_size % 3 <> 0 THEN 'M' || p_partkey ELSE 'P' || p_partkey END AS item_number, s_name AS brand,
         'Parts > ' || p_type AS category_path, p_type AS source_category, p_retailprice AS price,
         CASE WHEN p_size % 4 = 0 OR p_size % 5 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability,
         CAST(2 AS INT) AS n_variants, 'api' AS extraction_tier FROM visible""",
)
def build_catalog_api(t: Tables) -> DataFrame:
    catalog = build(t.responses(), Options())
    return catalog.select(
        "dedup_key", "name", "item_number", "brand", F.array_join("category_path", " > ").alias("category_path"),
        "source_category", "price", "availability", F.size("variants").alias("n_variants"), "extraction_tier",
    )
