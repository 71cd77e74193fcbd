"""Enrichment: detail pages into listings, model candidates into drafts, profile evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import explode_rows, let
from webcatalog.functions.text import first_json
from webcatalog.functions.values import get_items, is_grounded, text_of, variant, view
from webcatalog.operators.extract import extract_records
from webcatalog.operators.normalize import coverage, normalize, valid
from webcatalog.operators.pages import clean_text, signature

# Fixed scalar fields whose value must occur in the page text.
GROUNDED_FIELDS = ["name", "sku", "brand", "description"]


def enrich_products(products: DataFrame, details: DataFrame, order: Column | str) -> DataFrame:
    """Merge detail-page fields into listing products; a listing is never degraded.

    Per key: the last non-empty specifications and alternatives, the first of the longest
    descriptions and of the largest image lists. Description and images replace the listing's
    only when strictly longer. The tier becomes ``mixed`` where anything was set. ``details``
    may carry ``updated_at``, which then moves with the change.
    """
    order = F.col(order) if isinstance(order, str) else order
    stamped = "updated_at" in details.columns and "updated_at" in products.columns
    at = F.col("updated_at") if stamped else F.lit(None).cast("timestamp")
    ranked = details.withColumn("_seq", order).withColumn("_at", at)
    nonempty = lambda c: F.when(F.size(c) > 0, F.col("_seq"))
    # The most of something, the earliest on ties: order by size, then against the order.
    widest = lambda size: F.when(size > 0, F.struct(size.alias("n"), (-F.col("_seq")).alias("at")))
    best = ranked.groupBy("dedup_key").agg(
        F.max_by("specifications", nonempty("specifications")).alias("d_specs"),
        F.max_by("alternatives", nonempty("alternatives")).alias("d_alts"),
        F.max_by("description", widest(F.length("description"))).alias("d_text"),
        F.max_by("image_urls", widest(F.size("image_urls"))).alias("d_images"),
        F.max("_at").alias("d_at"),
    )
    longer = F.coalesce(
        F.length("d_text") > F.length(F.coalesce("description", F.lit(""))), F.lit(False)
    )
    more = F.coalesce(F.size("d_images") > F.size(F.coalesce("image_urls", F.array())), F.lit(False))
    specs, alts = F.col("d_specs").isNotNull(), F.col("d_alts").isNotNull()
    changed = specs | alts | longer | more
    updates = {
        "specifications": F.coalesce("d_specs", "specifications"),
        "alternatives": F.coalesce("d_alts", "alternatives"),
        "description": F.when(longer, F.col("d_text")).otherwise(F.col("description")),
        "image_urls": F.when(more, F.col("d_images")).otherwise(F.col("image_urls")),
        "extraction_tier": F.when(changed, "mixed").otherwise(F.col("extraction_tier")),
    }
    if stamped:
        updates["updated_at"] = F.when(changed, F.col("d_at")).otherwise(F.col("updated_at"))
    joined = products.join(best, "dedup_key", "left")
    return joined.select(*[updates[c].alias(c) if c in updates else c for c in products.columns])


def gap_fill(drafts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Fill empty description, specifications, brand and images of drafts from candidates.

    Both sides carry ``page_id`` and ``rec_no``. Within a page a draft matches on upper-cased
    SKU (a missing SKU counts as the empty one), else on lower-cased name; the later candidate
    wins a key. A match makes the tier ``mixed``. Pages without drafts take their candidates.
    """
    gaps = ["description", "specifications", "brand", "image_urls"]
    sku_key, name_key = F.upper(F.coalesce("sku", F.lit(""))), F.lower("name")
    keyed = candidates.select(
        "page_id", "rec_no", F.struct(*gaps).alias("c"),
        F.posexplode(F.array(sku_key, name_key)).alias("slot", "key"),
    )
    index = keyed.groupBy("page_id", "key").agg(
        F.max_by("c", F.struct("rec_no", "slot")).alias("c")
    )
    by = lambda name: index.select("page_id", F.col("key").alias(f"_{name}_key"), F.col("c").alias(f"_{name}"))
    joined = (
        drafts.withColumn("_sku_key", sku_key)
        .withColumn("_name_key", name_key)
        .join(by("sku"), ["page_id", "_sku_key"], "left")
        .join(by("name"), ["page_id", "_name_key"], "left")
        .withColumn("_match", F.coalesce("_sku", "_name"))
    )
    matched = F.col("_match").isNotNull()
    empty = {
        "description": F.coalesce("description", F.lit("")) == "",
        "brand": F.coalesce("brand", F.lit("")) == "",
        "specifications": F.size("specifications") == 0,
        "image_urls": F.size("image_urls") == 0,
    }
    updates = {f: F.when(matched & empty[f], F.col(f"_match.{f}")).otherwise(F.col(f)) for f in gaps}
    updates["extraction_tier"] = F.when(matched, "mixed").otherwise(F.col("extraction_tier"))
    filled = joined.select(*[updates[c].alias(c) if c in updates else c for c in drafts.columns])
    undrafted = candidates.join(drafts.select("page_id"), "page_id", "left_anti")
    return filled.unionByName(undrafted.select(*drafts.columns))


def response_records(responses: DataFrame) -> DataFrame:
    """Candidate objects in model responses (url, text): one row per JSON object, in order."""
    parsed = responses.withColumn("_json", F.try_parse_json(first_json("text"))).drop("text")
    listed = F.coalesce(get_items(F.col("_json")), F.array("_json"))
    staged = parsed.select(*[c for c in parsed.columns if c != "_json"], listed.alias("items"))
    keep = [c for c in staged.columns if c != "items"]
    fields = F.try_variant_get("item", "$", "map<string, variant>")
    rows = explode_rows(staged, keep, "items", "rec_no", "item")
    return rows.withColumn("fields", fields).drop("item").where(F.col("fields").isNotNull())


def ground_fields(fields: Column, haystack: Column, url: Column) -> Column:
    """Drop checked values that the page text does not contain; default the product URL."""
    present = lambda v: F.coalesce(is_grounded(text_of(view(v)), haystack), F.lit(False))
    default = F.create_map(F.lit("product_url"), variant(url))

    def checked(kept: Column) -> Column:
        specs = F.map_filter(
            F.try_variant_get(F.try_element_at(kept, F.lit("specifications")), "$", "map<string, variant>"),
            lambda _, v: present(v),
        )
        return let(specs, lambda found: F.transform_values(
            kept, lambda k, v: F.when((k == "specifications") & found.isNotNull(), F.to_variant_object(found)).otherwise(v),
        ))

    # Each step once: a page's text may be long, and every look at a value searches it.
    kept = F.map_filter(fields, lambda k, v: ~k.isin(GROUNDED_FIELDS) | present(v))
    return let(let(kept, checked), lambda found: F.when(F.map_contains_key(found, "product_url"), found).otherwise(
        F.map_concat(found, default)
    ))


def ground_candidates(candidates: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates (url, rec_no, fields) joined to their page and checked against its text.

    ``limit`` cuts the text; by default all of it counts.
    """
    pages = documents.select(
        "page_id", "url", "source_category",
        F.lower(clean_text(F.col("doc"), limit)).alias("_haystack"),
    )
    # Texts are never broadcast: they are a multiple of the files that Spark's estimate goes by.
    joined = candidates.join(pages.hint("merge"), "url")
    return joined.withColumn(
        "fields", ground_fields(F.col("fields"), F.col("_haystack"), F.col("url"))
    ).drop("_haystack")


def ingest_responses(responses: DataFrame, documents: DataFrame, limit: int | None = None) -> DataFrame:
    """Model responses to grounded, normalised products of tier ``llm``."""
    grounded = ground_candidates(response_records(responses), documents, limit)
    raw = grounded.select(
        "page_id", "rec_no", F.col("url").alias("page_url"), "source_category",
        F.lit("llm").alias("tier"), "fields",
    )
    return valid(normalize(raw))


def ground_texts(candidates: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """Plain-text form of the check: null out columns whose value the text lacks.

    ``candidates`` and ``texts(url, text)`` join on url.
    """
    joined = candidates.join(texts.select("url", F.lower("text").alias("_haystack")), "url")
    checked = {c: F.when(is_grounded(F.col(c), F.col("_haystack")), F.col(c)) for c in columns}
    return joined.withColumns(checked).drop("_haystack")


def evaluate_profiles(matched: DataFrame, regex: bool | None = None) -> DataFrame:
    """Score candidate profiles on sample pages (documents joined to compiled candidates).

    Per profile: best record coverage (3 decimals), number of valid records, signature of its
    first page. Nothing is filtered: a profile without valid records scores 0. ``regex``: as in
    :func:`extract_records`.
    """
    signed = matched.withColumn("signature", signature(F.col("doc")))
    raw = extract_records(signed, regex, keep_empty=True).withColumnRenamed("url", "page_url")
    records = normalize(raw).withColumn("coverage", coverage())
    good = F.col("rec_no").isNotNull() & F.col("reason").isNull()
    return records.groupBy("domain", "template").agg(
        F.count_if(F.coalesce("rec_no", F.lit(0)) == 0).alias("pages"),
        F.min_by("signature", "page_id").alias("signature"),
        F.coalesce(F.round(F.max(F.when(good, F.col("coverage"))), 3), F.lit(0.0)).alias("coverage"),
        F.count_if(good).alias("valid_records"),
    )
