"""Reports over the catalog and over a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, strip
from webcatalog.schemas import CATALOG_COVERAGE_FIELDS, REPORT_COLUMNS
from webcatalog.session import reliable_checkpoint
from webcatalog.sources.local import broadcast_if_small

# Fixed pattern of a result count in page source.
TOTAL_TEXT = r"(?i)\b(\d{2,6})\s*(?:products|items|results)\b"


def catalog_summary(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count("*").alias("total_products"),
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.round(F.avg("price"), 2).alias("price_avg"),
        F.count_if(F.col("availability") == "in_stock").alias("in_stock"),
    )


def count_by_category(products: DataFrame) -> DataFrame:
    return products.groupBy("source_category").agg(F.count("*").alias("products"))


def top_brands(products: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent brands; ties go to the one that comes first in (category, name) order."""
    branded = products.where(F.coalesce("brand", F.lit("")) != "")
    counts = branded.groupBy("brand").agg(
        F.count("*").alias("products"), F.min(F.struct("source_category", "name")).alias("first")
    )
    return counts.orderBy(F.desc("products"), F.asc("first")).limit(n).select("brand", "products")


def _populated(products: DataFrame, field: str) -> Column:
    """Populated in the stored catalog: unlike the record score, ``unknown`` is empty here."""
    kind = products.schema[field].dataType.typeName()
    if kind in ("array", "map"):
        return F.coalesce(F.size(field) > 0, F.lit(False))
    if kind == "string":
        return F.coalesce(~F.col(field).isin("unknown") & ~strip(F.col(field)).isin("", "[]", "{}"), F.lit(False))
    return F.col(field).isNotNull()


def field_coverage(products: DataFrame) -> DataFrame:
    """Share of products with each of the eleven fields; no rows for an empty catalog."""
    shares = products.agg(
        F.count("*").alias("n"),
        *[F.avg(_populated(products, f).cast("int")).alias(f) for f in CATALOG_COVERAGE_FIELDS],
    )
    pairs = ", ".join(f"'{f}', {f}" for f in CATALOG_COVERAGE_FIELDS)
    return shares.where("n > 0").select(
        F.expr(f"stack({len(CATALOG_COVERAGE_FIELDS)}, {pairs}) as (field, share)")
    ).select("field", F.round("share", 3).alias("coverage"))


def report_view(products: DataFrame, name: str | None = None) -> DataFrame:
    """The ten report columns; registered as a temporary view when a name is given."""
    view = products.select(*REPORT_COLUMNS)
    if name:
        view.createOrReplaceTempView(name)
    return view


def ask(products: DataFrame, question: str, view: str = "catalog") -> DataFrame:
    """Answer a question put as Spark SQL over the report view."""
    report_view(products, view)
    return products.sparkSession.sql(question)


def completeness(pages: DataFrame, extracted: DataFrame, apis: DataFrame | None = None) -> DataFrame:
    """Extracted records per category page against its true total.

    The total comes from the page's best API, else from a count in the page source, else it
    is unknown; an unknown total is never complete. ``extracted(url, extracted)`` and
    ``apis(page_url, endpoint, total)`` are keyed by page.
    """
    text_total = blank_to_null(F.regexp_extract("html", TOTAL_TEXT, 1)).cast("long")
    joined = pages.select("url", text_total.alias("text_total")).join(extracted, "url", "left")
    if apis is None:
        joined = joined.withColumns({"api_total": F.lit(None).cast("long"), "endpoint": F.lit(None).cast("string")})
    else:
        known = apis.select(
            F.col("page_url").alias("url"), "endpoint",
            F.nullif(F.col("total"), F.lit(0)).alias("api_total"),
        )
        joined = joined.join(known, "url", "left")
    expected = F.coalesce("api_total", "text_total")
    got = F.coalesce("extracted", F.lit(0)).cast("long")
    complete = F.coalesce(got >= expected, F.lit(False))
    method = (
        F.when(
            F.col("api_total").isNotNull(),
            F.concat(F.lit("data-api:"), F.substring_index("endpoint", "?", 1)),
        )
        .when(F.col("text_total").isNotNull(), "html:total-text")
        .otherwise("unknown")
    )
    action = F.when(
        expected.isNull(), F.lit("total unknown: probe the data API of the page or ask a person")
    ).when(
        ~complete,
        F.concat(F.lit("incomplete: "), got.cast("string"), F.lit(" of "), expected.cast("string"),
                 F.lit("; page through the data API or ask a person")),
    )
    return joined.select(
        "url", got.alias("extracted"), expected.alias("expected"), complete.alias("complete"),
        method.alias("method"), action.alias("recommended_action"),
    )


def extracted_counts(records: DataFrame, url: str = "page_url") -> DataFrame:
    return records.groupBy(F.col(url).alias("url")).agg(F.count("*").alias("extracted"))


def signature_drift(signed: DataFrame) -> DataFrame:
    """Pages whose signature differs from their profile's.

    ``signed``: domain, template, url, seq, signature, template_signature. A profile without a
    signature is pinned to the one of its first page. The narrow table is written first, so the
    pages behind it are parsed once.
    """
    names = ["domain", "template", "url", "seq", "signature", "template_signature"]
    signed = reliable_checkpoint(signed.select(*names))
    pins = signed.where("template_signature is null").groupBy("domain", "template").agg(
        F.min_by("signature", "seq").alias("pinned")
    )
    expected = F.coalesce("template_signature", "pinned")
    return (
        signed.join(broadcast_if_small(pins), ["domain", "template"], "left")
        .withColumn("expected", expected)
        .where(F.col("signature") != F.col("expected"))
        .select("domain", "template", "url", "expected", F.col("signature").alias("observed"))
    )


def pinned_signatures(signed: DataFrame) -> DataFrame:
    return signed.where("template_signature is null").groupBy("domain", "template").agg(
        F.min_by("signature", "seq").alias("template_signature")
    )


def run_summary(
    fetches: DataFrame, records: DataFrame, rejects: DataFrame, drifts: DataFrame | None = None,
    letters: DataFrame | None = None, requests: DataFrame | None = None,
    links: DataFrame | None = None, matches: DataFrame | None = None, invocations: int = 0,
) -> DataFrame:
    """One row of run counters from the outputs of the stages.

    ``fetches``: kind, ok, blocked, low_coverage, at per page; ``records``: coverage and
    ``listing`` per stored record. Detail pages do not enter the mean coverage but their
    records do count as low-coverage ones.
    """
    zero = F.lit(0).cast("long")
    total = lambda df: df.agg(F.count("*")).scalar() if df is not None else zero
    stored = F.col("listing")
    parts = {
        "products_stored": records.agg(F.count_if(stored)).scalar(),
        "avg_coverage": records.agg(
            F.round(F.coalesce(F.avg(F.when(stored, F.col("coverage"))), F.lit(0.0)), 3)
        ).scalar(),
        "low_coverage_records": records.agg(F.count_if("low_coverage")).scalar(),
        "validation_failures": rejects.agg(
            F.count_if(F.col("reason") == "record has no product name")
        ).scalar(),
        "type_failures": rejects.agg(F.count_if(F.col("reason").startswith("type:"))).scalar(),
        "signature_drifts": total(drifts),
        "dead_letters": total(letters),
        "manual_help_requests": total(requests),
        "products_found": total(links.where("kind = 'product'") if links is not None else None),
        "cache_hits": total(matches.where("template is not null") if matches is not None else None),
        "cache_misses": total(matches.where("template is null") if matches is not None else None),
        "llm_invocations": F.lit(invocations).cast("long"),
    }
    return fetches.agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at"),
        F.count_if("fetched").alias("pages_fetched"),
        F.count_if(F.col("ok") & (F.col("kind") == "category")).alias("categories_done"),
        F.count_if("blocked").alias("blocked"),
    ).withColumns(parts)


def stats_report(products: DataFrame, letters: DataFrame, requests: DataFrame) -> DataFrame:
    """Long form (section, item, n): products by category, dead letters, open help requests."""
    section = lambda df, name, item: df.select(
        F.lit(name).alias("section"), item.alias("item"), F.col("n")
    )
    total = lambda df: df.agg(F.count("*").alias("n"))
    by_category = count_by_category(products).withColumnRenamed("products", "n")
    open_requests = requests.where("not resolved").withColumn("n", F.lit(1).cast("long"))
    none = F.lit(None).cast("string")
    return (
        section(total(products), "products", none)
        .unionByName(section(by_category, "category", F.col("source_category")))
        .unionByName(section(total(letters), "dead_letters", none))
        .unionByName(section(open_requests, "help", F.col("url")))
    )


def metrics_by_window(log: DataFrame, width: str = "1 hour") -> DataFrame:
    """Pages, failures and mean coverage per time window of a fetch log (at, status, coverage).

    Works on a batch table and, with a watermark on ``at``, on a stream.
    """
    return (
        log.groupBy(F.window("at", width).alias("w"))
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("status") == "failed").alias("failures"),
            F.avg("coverage").alias("coverage"),
        )
        .select(F.col("w.start").alias("window_start"), "pages", "failures", "coverage")
    )


