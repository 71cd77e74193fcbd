"""Reports over the derived catalog and the crawl log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from query_suite.registry import LISTING_SIGNATURE, PAGED_SQL, PRODUCTS_SQL, Tables, query
from query_suite.state import LOG_SQL
from webcatalog.operators import pages as P
from webcatalog.operators import profiles as PR
from webcatalog.operators import report as R
from webcatalog.operators import state as S
from webcatalog.session import checkpoint_folder
from webcatalog.sources.readers import read_catalog
from webcatalog.sources.writers import write_table


@query(
    "catalog_summary",
    f"""WITH {PRODUCTS_SQL}
       SELECT CAST(count(*) AS BIGINT) AS total_products, min(price) AS price_min, max(price) AS price_max,
         round(avg(price), 2) AS price_avg, CAST(count(*) FILTER (availability = 'in_stock') AS BIGINT) AS in_stock FROM products""",
)
def catalog_summary(t: Tables) -> DataFrame:
    return R.catalog_summary(t.products())


@query(
    "count_by_category",
    f"WITH {PRODUCTS_SQL} SELECT source_category, CAST(count(*) AS BIGINT) AS products FROM products GROUP BY 1",
)
def count_by_category(t: Tables) -> DataFrame:
    return R.count_by_category(t.products())


@query(
    "top_brands",
    f"""WITH {PRODUCTS_SQL}, firsts AS (
         SELECT brand, count(*) AS products, min(struct_pack(a := coalesce(source_category, ''), b := name)) AS first
         FROM products WHERE brand IS NOT NULL GROUP BY brand)
       SELECT brand, CAST(products AS BIGINT) AS products FROM firsts ORDER BY products DESC, first LIMIT 10""",
)
def top_brands(t: Tables) -> DataFrame:
    return R.top_brands(t.products())


_REPORT_SQL = """SELECT name, sku, brand, category_path, source_category, price, currency, availability, pack_size, product_url
       FROM products"""


@query("report_view", f"WITH {PRODUCTS_SQL} {_REPORT_SQL}")
def report_view(t: Tables) -> DataFrame:
    return R.report_view(t.products()).withColumn("category_path", F.array_join("category_path", " > "))


@query(
    "catalog_question",
    f"""WITH {PRODUCTS_SQL} SELECT brand, name, price FROM products
       WHERE name LIKE '%ring%' AND price < 1000 AND availability = 'in_stock'""",
)
def catalog_question(t: Tables) -> DataFrame:
    question = """SELECT brand, name, price FROM catalog
                  WHERE name LIKE '%ring%' AND price < 1000 AND availability = 'in_stock' ORDER BY price, name"""
    return R.ask(t.products(), question)


@query(
    "catalog_scan",
    f"""WITH {PRODUCTS_SQL} SELECT row_number() OVER (ORDER BY source_category NULLS FIRST, name) AS place, source_category, name, dedup_key
       FROM products""",
)
def catalog_scan(t: Tables) -> DataFrame:
    """The stored catalog in the reader's order, each row with its place: partitions follow each other."""
    path = write_table(t.products(), f"{checkpoint_folder(t.spark)}/suite-catalog-{uuid.uuid4().hex}")
    rows = read_catalog(t.spark, path).select("source_category", "name", "dedup_key", F.monotonically_increasing_id().alias("at"))
    part, nth = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select("source_category", "name", "dedup_key", part.alias("part"), nth.alias("nth"))
    rows = t.spark.read.schema(rows.schema).parquet(write_table(rows, f"{path}-placed"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("rows"))
    earlier = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("part", earlier.alias("before"))  # a row for each partition
    placed = rows.join(before, "part").withColumn("place", F.col("before") + F.col("nth") + 1)
    return placed.select("place", "source_category", "name", "dedup_key")


@query(
    "stats_report",
    f"""WITH {PRODUCTS_SQL}, {LOG_SQL},
       failed AS (SELECT url, max(seq) % 2 = 0 AS resolved FROM log WHERE status = 'failed' GROUP BY url)
       SELECT 'products' AS section, NULL AS item, CAST(count(*) AS BIGINT) AS n FROM products
       UNION ALL SELECT 'category', source_category, count(*) FROM products GROUP BY source_category
       UNION ALL SELECT 'dead_letters', NULL, count(*) FROM failed
       UNION ALL SELECT 'help', url, 1 FROM failed WHERE NOT resolved""",
)
def stats_report(t: Tables) -> DataFrame:
    failed = t.log().where("status = 'failed'")
    letters = S.dead_letter(None, failed.select(
        "url", F.lit("e").alias("error"), F.lit(1).alias("attempts"), F.col("at").alias("failed_at"), "seq"
    ))
    requests = S.request_help(None, failed.select(
        "url", F.col("seq").cast("string").alias("reason"), F.lit("a").alias("suggested_action"),
        F.col("at").alias("requested_at"), "seq",
    )).withColumn("resolved", F.col("reason").cast("long") % 2 == 0)
    return R.stats_report(t.products(), letters, requests)


@query(
    "metrics_by_window",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, CAST(count(*) AS BIGINT) AS pages,
         CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failures, round(avg(value), 4) AS coverage
       FROM events GROUP BY 1""",
)
def metrics_by_window(t: Tables) -> DataFrame:
    windows = R.metrics_by_window(t.log().withColumn("coverage", F.col("value")))
    return windows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "pages", "failures",
        F.round("coverage", 4).alias("coverage"),
    )


@query(
    "signature_drift",
    f"""WITH {PAGED_SQL}, expected AS (
         SELECT DISTINCT page_id, url, seq, CASE WHEN seq % 3 = 0 THEN 'pages' ELSE 'listing' END AS template FROM places)
       SELECT url, 'stale-signature' AS expected, {LISTING_SIGNATURE} AS observed FROM expected WHERE template = 'listing'""",
)
def signature_drift(t: Tables) -> DataFrame:
    # Two templates: one pinned to an outdated signature, one that its first page pins.
    signed = P.template_signatures(P.with_documents(t.listings().select("page_id", "url", "seq", "html")))
    split = signed.select(
        F.lit("shop.example.com").alias("domain"),
        F.when(F.col("seq") % 3 == 0, "pages").otherwise("listing").alias("template"), "url", "seq", "signature",
        F.when(F.col("seq") % 3 != 0, "stale-signature").alias("template_signature"),
    )
    return R.signature_drift(split).select("url", "expected", "observed")


@query(
    "run_summary",
    f"""WITH {LOG_SQL}
       SELECT CAST(count(*) AS BIGINT) AS pages_fetched,
         CAST(count(*) FILTER (status = 'done' AND kind = 'category') AS BIGINT) AS categories_done,
         CAST(count(*) FILTER (status = 'failed' AND seq % 2 = 0) AS BIGINT) AS blocked,
         CAST(count(*) FILTER (status = 'done' AND kind = 'category') AS BIGINT) AS products_stored,
         round(avg(value / 200) FILTER (status = 'done' AND kind = 'category'), 3) AS avg_coverage,
         CAST(count(*) FILTER (status = 'done' AND value < 20) AS BIGINT) AS low_coverage_records,
         CAST(count(*) FILTER (seq % 11 = 0) AS BIGINT) AS validation_failures,
         CAST(count(*) FILTER (seq % 11 = 1) AS BIGINT) AS type_failures,
         CAST(0 AS BIGINT) AS signature_drifts,
         CAST(count(DISTINCT url) FILTER (status = 'failed') AS BIGINT) AS dead_letters,
         CAST(0 AS BIGINT) AS manual_help_requests,
         CAST(count(*) FILTER (kind = 'product') AS BIGINT) AS products_found,
         CAST(count(*) FILTER (seq % 5 <> 0) AS BIGINT) AS cache_hits,
         CAST(count(*) FILTER (seq % 5 = 0) AS BIGINT) AS cache_misses,
         CAST(0 AS BIGINT) AS llm_invocations FROM log""",
)
def run_summary(t: Tables) -> DataFrame:
    log = t.log()
    ok = F.col("status") == "done"
    fetches = log.select(
        "kind", "at", ok.alias("ok"), F.lit(True).alias("fetched"), (~ok & (F.col("seq") % 2 == 0)).alias("blocked")
    )
    records = log.where(ok).select(
        (F.col("value") / 200).alias("coverage"), (F.col("kind") == "category").alias("listing"),
        (F.col("value") < 20).alias("low_coverage"),
    )
    rejects = log.where("seq % 11 < 2").select(
        F.when(F.col("seq") % 11 == 0, "record has no product name").otherwise("type:sku").alias("reason")
    )
    letters = S.dead_letter(None, log.where(~ok).select(
        "url", F.lit("e").alias("error"), F.lit(1).alias("attempts"), F.col("at").alias("failed_at"), "seq"
    ))
    matches = log.select(F.when(F.col("seq") % 5 != 0, "t").alias("template"))
    summary = R.run_summary(fetches, records, rejects, letters=letters, links=log.select("kind"), matches=matches)
    return summary.drop("started_at", "finished_at")


@query(
    "pinned_signatures",
    f"""WITH {PAGED_SQL} SELECT p_brand AS template, {LISTING_SIGNATURE} AS template_signature FROM places GROUP BY p_brand""",
)
def pinned_signatures(t: Tables) -> DataFrame:
    docs = P.with_documents(t.listings().select("page_id", "url", "seq", F.col("source_category").alias("template"), "html"))
    signed = P.template_signatures(docs).withColumns(
        {"domain": PR.profile_domain(F.col("url")), "template_signature": F.lit(None).cast("string")}
    )
    return R.pinned_signatures(signed).select("template", "template_signature")
