"""Catalog jobs: listings, details and API responses to products; routing; exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.html import EXTRACTED_TYPES
from webcatalog.operators import api as A
from webcatalog.operators.enrich import enrich_products, gap_fill, ground_fields, response_records
from webcatalog.operators.extract import extract_records
from webcatalog.operators.normalize import normalize, valid, with_coverage
from webcatalog.operators.pages import clean_text, is_blocked, revalidation_sample, with_documents
from webcatalog.operators.profiles import match_profiles, template_for
from webcatalog.operators.state import upsert_products
from webcatalog.options import Options
from webcatalog.schemas import PRODUCT_COLUMNS
from webcatalog.session import reliable_checkpoint
from webcatalog.sources.writers import export_all, write_run_summary


def match_pages(pages: DataFrame, compiled: DataFrame) -> DataFrame:
    """Parsed pages with their profile; blocked pages get an empty document."""
    blocked = is_blocked(F.col("status"), F.col("html"))
    flagged = pages.withColumn("blocked", blocked).withColumn(
        "html", F.when(~F.col("blocked"), F.col("html"))
    )
    return match_profiles(with_documents(flagged, EXTRACTED_TYPES), compiled, template_for(F.col("kind")))


def page_records(
    pages: DataFrame, compiled: DataFrame, tier: str | None = None, regex: bool | None = None
) -> DataFrame:
    """Normalised records of pages (page_id, rec_no, seq, reason, product columns)."""
    matched = match_pages(pages, compiled).where("not blocked")
    raw = extract_records(matched, regex=regex).withColumnRenamed("url", "page_url")
    if tier:
        raw = raw.withColumn("tier", F.lit(tier))
    keep = ["page_id", "seq", "rec_no", "page_url", "source_category", "tier", "fields"]
    return normalize(raw.select(*keep))


def stamped(products: DataFrame, at: Column) -> DataFrame:
    return products.withColumns({"scraped_at": at, "updated_at": at})


def build_catalog(
    pages: DataFrame,
    compiled: DataFrame,
    existing: DataFrame | None = None,
    as_of: Column | None = None,
    options: Options = Options(),
    repair: Callable[[DataFrame], DataFrame] | None = None,
    regex: bool | None = None,
    revalidation_rate: float = 0.0,
) -> DataFrame:
    """Products from listing pages, upserted on their key in page order.

    ``repair`` is the hook for batch inference. It takes the pages whose records cover too
    little, those without any record included, and a share ``revalidation_rate`` of all pages
    (page_id, url, source_category, seq, page_text), and returns model answers
    (page_id, text). The objects in them are checked against the page text and fill gaps.
    """
    if repair is None:
        records = valid(page_records(pages, compiled, regex=regex))
    else:
        records = _repaired(pages, compiled, repair, options, regex, revalidation_rate)
    stamp = as_of if as_of is not None else F.current_timestamp()
    batch = stamped(records, stamp).withColumn("_at", F.struct("seq", "rec_no"))
    return upsert_products(existing, batch.select(*PRODUCT_COLUMNS, "_at"), "_at").select(*PRODUCT_COLUMNS)


def _repaired(
    pages: DataFrame, compiled: DataFrame, repair: Callable[[DataFrame], DataFrame], options: Options,
    regex: bool | None, revalidation_rate: float,
) -> DataFrame:
    """Valid records, those of low-coverage pages completed from the hook's grounded answers.

    Drafts, the pages asked about and the answers are each written once, so the hook, which may
    be costly and give different answers every time, runs once.
    """
    matched = match_pages(pages, compiled).where("not blocked and template is not null")
    raw = extract_records(matched, regex=regex, keep_empty=True).withColumnRenamed("url", "page_url")
    keep = ["page_id", "seq", "rec_no", "page_url", "source_category", "tier", "fields"]
    rows = reliable_checkpoint(normalize(raw.select(*keep, F.col("page_url").alias("asked_url"))))
    good = F.col("rec_no").isNotNull() & F.col("reason").isNull()
    scored = with_coverage(rows, options.strict_availability).groupBy("page_id").agg(
        F.first("asked_url").alias("url"), F.coalesce(F.avg(F.when(good, F.col("coverage"))), F.lit(0.0)).alias("c")
    )
    low = scored.where(F.col("c") < options.min_coverage)
    again = revalidation_sample(scored, revalidation_rate)
    ids = reliable_checkpoint(low.union(again).select("page_id").distinct())
    markup = pages.select("page_id", "url", "source_category", "seq", "html").join(ids, "page_id", "left_semi")
    asked = reliable_checkpoint(
        with_documents(markup, EXTRACTED_TYPES).withColumn("page_text", clean_text(F.col("doc"), None)).drop("doc")
    )
    answers = reliable_checkpoint(repair(asked).select("page_id", "text"))
    found = response_records(answers).join(asked, "page_id")
    grounded = found.withColumn("fields", ground_fields(F.col("fields"), F.lower("page_text"), F.col("url")))
    candidates = grounded.select(
        "page_id", "seq", "rec_no", F.col("url").alias("page_url"), "source_category", F.lit("llm").alias("tier"), "fields",
        F.col("url").alias("asked_url"),
    )
    drafts = valid(rows.where("rec_no is not null"))
    filled = gap_fill(drafts.join(ids, "page_id", "left_semi"), valid(normalize(candidates)))
    return drafts.join(ids, "page_id", "left_anti").unionByName(filled).drop("asked_url")


def enrich_from_details(
    products: DataFrame, pages: DataFrame, compiled: DataFrame, as_of: Column | None = None,
    regex: bool | None = None,
) -> DataFrame:
    """Detail-page pass: extract product pages and merge them into the catalog."""
    details = valid(page_records(pages, compiled, tier="mixed", regex=regex))
    if as_of is not None:
        details = stamped(details, as_of)
    return enrich_products(products, details, "seq")


def api_records(
    responses: DataFrame, options: Options = Options(), config: DataFrame | None = None
) -> DataFrame:
    """Normalised records of API responses; only resolved categories count with a config."""
    if config is not None:
        ready = config.where("resolved").select(F.col("url").alias("page_url"))
        responses = responses.join(ready, "page_url", "left_semi")
    hits = A.cap_hits(A.visible_hits(A.explode_hits(responses)), options.max_products)
    raw = A.map_hits(hits)
    own = F.try_variant_get(F.col("fields")["product_url"], "$", "string")
    return normalize(raw.withColumn("page_url", F.coalesce(F.nullif(own, F.lit("")), F.col("page_url"))))


def build_catalog_api(
    responses: DataFrame,
    options: Options = Options(),
    config: DataFrame | None = None,
    existing: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Products from paged API responses, upserted in queue order.

    That is (``seq`` of the response's category, where there is one, category, page, hit).
    """
    records = valid(api_records(responses, options, config))
    order = F.struct("seq", "category_id", "api_page", "hit_no")
    stamp = as_of if as_of is not None else F.current_timestamp()
    batch = stamped(records, stamp).withColumn("_at", order)
    return upsert_products(existing, batch.select(*PRODUCT_COLUMNS, "_at"), "_at").select(*PRODUCT_COLUMNS)


def route_pages(
    pages: DataFrame, compiled: DataFrame, options: Options = Options(), config: DataFrame | None = None
) -> DataFrame:
    """Where each page goes: blocked, api_undiscoverable, no_profile, low_coverage or ok.

    One pass: records stay beside their page row, so a single partially aggregated shuffle on
    ``page_id`` scores every page, those without records included.
    """
    matched = match_pages(pages, compiled).withColumn("has_profile", F.col("template").isNotNull())
    raw = extract_records(matched, keep_empty=True).withColumnRenamed("url", "page_url")
    staged = raw.withColumn("asked_url", F.col("page_url"))
    records = with_coverage(normalize(staged), options.strict_availability)
    good = F.col("rec_no").isNotNull() & F.col("reason").isNull()
    scored = records.groupBy("page_id").agg(
        F.first("asked_url").alias("url"), F.first("kind").alias("kind"), F.first("status").alias("status"),
        F.first("blocked").alias("blocked"), F.first("has_profile").alias("has_profile"),
        F.count_if(good).alias("records"),
        F.coalesce(F.avg(F.when(good, F.col("coverage"))), F.lit(0.0)).alias("coverage"),
    )
    undiscovered = F.lit(False)
    if config is not None:
        scored = scored.join(config.select("page_id", "resolved"), "page_id", "left")
        undiscovered = (F.col("kind") == "category") & ~F.coalesce("resolved", F.lit(False))
    route = (
        F.when(F.col("blocked"), "blocked")
        .when(undiscovered, "api_undiscoverable")
        .when(~F.col("has_profile"), "no_profile")
        .when(F.col("coverage") < options.min_coverage, "low_coverage")
        .otherwise("ok")
    )
    return scored.select("page_id", "url", "kind", "status", "records", "coverage", route.alias("route"))


def route_help(routed: DataFrame, at: Column) -> DataFrame:
    """Help requests for a person: one per blocked, undiscoverable or profile-less page."""
    reason = (
        F.when(
            F.col("route") == "blocked",
            F.concat(F.lit("blocked: HTTP "), F.col("status").cast("string"), F.lit(" (access denied)")),
        )
        .when(F.col("route") == "no_profile", "no extraction profile for this page")
        .when(F.col("route") == "api_undiscoverable", "API configuration or category id not found")
    )
    action = (
        F.when(F.col("route") == "blocked", "Confirm that access is permitted or supply the page.")
        .when(F.col("route") == "no_profile", "Write a profile for this template.")
        .otherwise("Provide the API credentials and category id.")
    )
    return routed.where(reason.isNotNull()).select(
        "url", reason.alias("reason"), action.alias("suggested_action"), at.alias("requested_at"),
        F.col("page_id").alias("seq"),
    )


def route_failures(routed: DataFrame, at: Column) -> DataFrame:
    """Dead letters: blocked pages, with the status that said so."""
    return routed.where("route = 'blocked'").select(
        "url", F.concat(F.lit("blocked: HTTP "), F.col("status").cast("string")).alias("error"),
        F.lit(1).alias("attempts"), at.alias("failed_at"), F.col("page_id").alias("seq"),
    )


def export_run(products: DataFrame, summary: DataFrame, folder: str, options: Options = Options()) -> list[str]:
    """Write the catalog in every format and the run summary next to it."""
    written = export_all(products, folder, options.formats)
    return written + [write_run_summary(summary, f"{folder}/run_summary")] if written else []
