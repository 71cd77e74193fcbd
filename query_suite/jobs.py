"""End-to-end jobs, enrichment and model-response ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from query_suite.registry import PAGED_SQL, PRODUCTS_SQL, STATE_SQL, Tables, query
from webcatalog import fixtures
from webcatalog.operators import enrich as E
from webcatalog.operators.pages import with_documents
from webcatalog.options import Options
from webcatalog.plans import catalog as J
from webcatalog.plans.crawl import crawl_archive as crawl
from webcatalog.sources.readers import read_pages


@query(
    "build_catalog",
    f"""SELECT 'P' || p_partkey AS dedup_key, p_name || ' ' || p_partkey AS name, 'P' || p_partkey AS sku, p_brand AS brand,
         'Parts > ' || p_type AS category_path, p_brand AS source_category,
         'https://shop.example.com/product/' || p_partkey AS product_url, p_retailprice AS price, 'USD' AS currency,
         {STATE_SQL} AS availability,
         CASE WHEN p_size % 7 <> 0 THEN 'A ' || p_name || ' of type ' || p_type END AS description,
         'https://shop.example.com/img/' || p_partkey || '.jpg' AS image, 'jsonld' AS extraction_tier FROM part""",
)
def build_catalog(t: Tables) -> DataFrame:
    catalog = J.build_catalog(t.listings(), t.profiles(), regex=False)
    return catalog.select(
        "dedup_key", "name", "sku", "brand", F.array_join("category_path", " > ").alias("category_path"),
        "source_category", "product_url", "price", "currency", "availability", "description",
        F.get("image_urls", F.lit(0)).alias("image"), "extraction_tier",
    )


_CRAWL_SQL = f"""WITH {PAGED_SQL}
       SELECT DISTINCT url, CAST(page - 1 AS INT) AS hop, 'cat ' || p_brand AS source_category, 'done' AS status FROM places
       UNION ALL SELECT 'https://shop.example.com/catalog/' || slug || '?p=' || (max(page) + 1), CAST(max(page) AS INT),
         'cat ' || p_brand, 'failed' FROM places GROUP BY slug, p_brand HAVING max(page) < max(last_page)"""


def _crawl_seeds(t: Tables) -> DataFrame:
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    return t.part.select("p_brand", brand.alias("slug")).distinct().select(
        F.regexp_extract("slug", r"(\d+)$", 1).cast("long").alias("seq"),
        F.concat(F.lit("cat "), "p_brand").alias("name"), fixtures.listing_url(F.col("slug"), F.lit(1)).alias("url"),
    )


@query("crawl_archive", _CRAWL_SQL)
def crawl_archive(t: Tables) -> DataFrame:
    done = crawl(t.listings(), t.profiles(), _crawl_seeds(t))
    return done.select("url", "hop", "source_category", "status")


@query("crawl_duplicates", _CRAWL_SQL)
def crawl_duplicates(t: Tables) -> DataFrame:
    """Every page was fetched three times, blocked but for the last."""
    pages = t.listings()
    blocked = pages.withColumn("html", F.lit("<title>Just a moment...</title>")).withColumn("page_id", -F.col("page_id"))
    archive = pages.unionByName(blocked).unionByName(blocked.withColumn("page_id", F.col("page_id") - 1))
    done = crawl(archive, t.profiles(), _crawl_seeds(t))
    return done.select("url", "hop", "source_category", "status")


@query(
    "crawl_archive_capped",
    f"""WITH {PAGED_SQL}, queue AS (
         SELECT DISTINCT url, page - 1 AS hop, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS seed, true AS ok FROM places
         UNION ALL SELECT 'https://shop.example.com/catalog/' || slug || '?p=' || (max(page) + 1), max(page),
           CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT), false FROM places GROUP BY slug, p_brand HAVING max(page) < max(last_page)),
       last AS (SELECT hop, seed FROM queue WHERE ok ORDER BY hop, seed LIMIT 1 OFFSET 39)
       SELECT url, CAST(q.hop AS INT) AS hop, CASE WHEN (q.hop, q.seed) > (l.hop, l.seed) THEN 'pending' WHEN ok THEN 'done' ELSE 'failed' END AS status
       FROM queue q LEFT JOIN last l ON true WHERE l.hop IS NULL OR q.hop = 0 OR (q.hop - 1, q.seed) < (l.hop, l.seed)""",
)
def crawl_archive_capped(t: Tables) -> DataFrame:
    done = crawl(t.listings(), t.profiles(), _crawl_seeds(t), Options(max_pages=40))
    return done.select("url", "hop", "status")


@query(
    "enrich_products",
    f"""WITH {PRODUCTS_SQL},
       longer AS (SELECT *, 'The ' || p_name || ' is a part of type ' || split_part(category_path, ' > ', 2) || ' and size ' || p_size
         AS detail FROM products)
       SELECT dedup_key, detail AS description, 'Brand;Size' AS spec_keys, CAST(2 AS INT) AS n_alternatives,
         CASE WHEN image_urls = '[]' THEN 'https://shop.example.com/img/' || p_partkey || '.jpg' ELSE '/img/' || p_partkey END AS image,
         'mixed' AS extraction_tier FROM longer""",
)
def enrich_products(t: Tables) -> DataFrame:
    enriched = J.enrich_from_details(t.products(), t.details(), t.profiles())
    return enriched.select(
        "dedup_key", "description", F.array_join(F.array_sort(F.map_keys("specifications")), ";").alias("spec_keys"),
        F.size("alternatives").alias("n_alternatives"), F.get("image_urls", F.lit(0)).alias("image"), "extraction_tier",
    )


@query(
    "gap_fill",
    f"""WITH {PRODUCTS_SQL}
       SELECT dedup_key,
         CASE WHEN description IS NULL AND p_partkey % 2 = 0 THEN 'cand ' || p_partkey ELSE description END AS description,
         CASE WHEN brand IS NULL AND p_partkey % 2 = 0 THEN 'B' || p_partkey ELSE brand END AS brand,
         CASE WHEN p_partkey % 2 = 0 THEN 'mixed' ELSE 'jsonld' END AS extraction_tier
       FROM products WHERE p_partkey % 20 <> 19 OR p_partkey % 2 = 1
       UNION ALL SELECT 'C' || p_partkey, 'cand ' || p_partkey, 'B' || p_partkey, 'llm' FROM part WHERE p_partkey % 50 = 49""",
)
def gap_fill(t: Tables) -> DataFrame:
    # Ten parts share a page; even parts have a candidate, found by SKU or (every fourth) by name.
    n = F.regexp_extract("dedup_key", r"(\d+)$", 1).cast("long")
    keyed = t.products().withColumn("n", n).withColumn("rec_no", n).withColumn("page_id", (n / 10).cast("long"))
    candidates = keyed.where("n % 2 = 0").withColumns(
        {
            "sku": F.when(F.col("n") % 4 == 0, F.lower("sku")).otherwise(F.lit("other")),
            "name": F.upper("name"),
            "description": F.concat(F.lit("cand "), F.col("n").cast("string")),
            "brand": F.concat(F.lit("B"), F.col("n").cast("string")),
            "extraction_tier": F.lit("llm"),
        }
    )
    lonely = keyed.where("n % 50 = 49").withColumns(
        {
            "dedup_key": F.concat(F.lit("C"), F.col("n").cast("string")),
            "page_id": -F.col("n"),
            "description": F.concat(F.lit("cand "), F.col("n").cast("string")),
            "brand": F.concat(F.lit("B"), F.col("n").cast("string")),
            "extraction_tier": F.lit("llm"),
        }
    )
    filled = E.gap_fill(keyed, candidates.unionByName(lonely))
    return filled.select("dedup_key", "description", "brand", "extraction_tier")


# A claim per document: its first words, a planted foreign word, its source and two letters.
_CLAIMS_SQL = """claims AS (
  SELECT doc_id, substr(text, 3, 18) AS name, CASE WHEN doc_id % 3 = 0 THEN 'zzqx-nope' ELSE lang END AS brand,
    substr(text, 1, 12) AS description, lower(text) AS haystack FROM documents)"""


def _claims(t: Tables) -> DataFrame:
    return t.read("documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), "doc_id",
        F.substring("text", 3, 18).alias("name"),
        F.when(F.col("doc_id") % 3 == 0, "zzqx-nope").otherwise(F.col("lang")).alias("brand"),
        F.substring("text", 1, 12).alias("description"),
    )


_SPACES = "' ' || chr(9) || chr(10) || chr(13)"


@query(
    "grounding",
    f"""WITH {_CLAIMS_SQL}, trimmed AS (SELECT doc_id, name, brand, description, trim(name, {_SPACES}) AS n,
         trim(description, {_SPACES}) AS d, haystack FROM claims)
       SELECT doc_id, length(n) < 3 OR contains(haystack, lower(n)) AS name_ok,
         length(brand) < 3 OR contains(haystack, brand) AS brand_ok,
         length(d) < 3 OR contains(haystack, lower(d)) AS description_ok FROM trimmed""",
)
def grounding(t: Tables) -> DataFrame:
    texts = t.read("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url"), "text")
    checked = E.ground_texts(_claims(t), texts, ["name", "brand", "description"])
    return checked.select(
        "doc_id", *[F.col(c).isNotNull().alias(f"{c}_ok") for c in ("name", "brand", "description")]
    )


@query(
    "ingest_responses",
    """SELECT p_partkey * 10 + 3 AS page_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS brand,
         CAST(p_size AS DOUBLE) AS price, 'Size=' || p_size AS specs,
         'https://shop.example.com/product/' || p_partkey AS product_url, 'llm' AS extraction_tier FROM part
       WHERE p_partkey % 7 <> 0""",
)
def ingest_responses(t: Tables) -> DataFrame:
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    brand = F.when(F.col("p_partkey") % 3 == 0, "GhostBrand").otherwise(F.upper("p_brand"))
    claim = F.concat(
        F.lit('{"name": "'), "p_name", F.lit('", "brand": "'), brand, F.lit('", "price": "about '), size,
        F.lit('", "specifications": {"Size": "'), size, F.lit('", "Ghost": "not on the page"}}'),
    )
    text = (
        F.when(F.col("p_partkey") % 7 == 0, "Sorry, {I cannot} do that")
        .when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Here:\n```json\n["), claim, F.lit(', 5, "x"]\n```\nDone {}')))
        .otherwise(F.concat(F.lit("Result "), claim, F.lit(" and } more")))
    )
    responses = t.part.select(fixtures.product_url(key).alias("url"), text.alias("text"))
    documents = with_documents(t.details().select("page_id", "url", "source_category", "html"))
    found = E.ingest_responses(responses, documents)
    specs = F.array_join(F.transform(F.map_entries("specifications"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    # Brands were checked without regard to case and keep the response's spelling.
    return found.select(
        "page_id", "name", F.replace("brand", F.lit("BRAND"), F.lit("Brand")).alias("brand"), "price", specs.alias("specs"),
        "product_url", "extraction_tier",
    )


@query(
    "route_pages",
    f"""WITH {PAGED_SQL}
       SELECT -page_id - 1 AS page_id, CASE WHEN page_id % 5 = 0 THEN 'blocked' ELSE 'no_profile' END AS route, CAST(0 AS BIGINT) AS records FROM pages
       UNION ALL SELECT page_id, CASE WHEN seq % 4 = 0 THEN 'blocked' ELSE 'ok' END,
         CASE WHEN seq % 4 = 0 THEN 0 ELSE count(*) END FROM places GROUP BY page_id, seq
       UNION ALL SELECT p_partkey * 10 + 3, CASE WHEN p_partkey % 3 = 0 THEN 'low_coverage' ELSE 'ok' END,
         CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END FROM part""",
)
def route_pages(t: Tables) -> DataFrame:
    columns = ["page_id", "url", "status", "kind", "source_category", "seq", "html"]
    pages = read_pages(t.spark, t.path("pages")).withColumn(
        "status", F.when(F.col("page_id") % 5 == 0, 429).otherwise(200)
    ).withColumn("page_id", -F.col("page_id") - 1)
    listings = t.listings().withColumn(
        "html", F.when(F.col("seq") % 4 == 0, "<title>Just a moment...</title>").otherwise(F.col("html"))
    )
    # Every third detail page has lost its structured data, so nothing names the product.
    details = t.details().withColumn(
        "html",
        F.when(F.col("seq") % 3 == 0, F.regexp_replace("html", "(?s)<script.*?</script>", "")).otherwise(F.col("html")),
    )
    everything = pages.select(*columns)
    for more in (listings, details):
        everything = everything.unionByName(more.select(*columns))
    return J.route_pages(everything, t.profiles()).select("page_id", "route", "records")
