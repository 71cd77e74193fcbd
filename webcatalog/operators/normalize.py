"""Raw records to clean products: normalise, quarantine, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, let, reusable, strip
from webcatalog.functions.urls import abs_url, split_url
from webcatalog.functions.values import (
    as_text,
    availability,
    category_path,
    dedup_key,
    first_truthy,
    is_text,
    member,
    member_text,
    not_text,
    text_of,
    to_float,
    to_list,
    truthy,
    view,
)
from webcatalog.schemas import ALTERNATIVE_DDL, COVERAGE_FIELDS, FLAT_COLUMNS, VARIANT_ITEM_DDL

_RAW_FIELDS = [
    "name", "sku", "item_number", "brand", "category", "product_url", "price", "currency",
    "pack_size", "availability", "description", "specifications", "image_urls", "rating",
    "variants", "alternatives",
]


@reusable
def _reason() -> Column:
    """Why a record is not a valid product; null for a valid one."""
    bad_member = lambda items, *keys: F.exists(
        items,
        lambda x: F.exists(F.array(*[view(member(x["v"], k)) for k in keys]), not_text),
    )
    plain = ("sku", "brand", "description", "pack_size", "item_number", "currency", "product_url")
    wrong = {f: not_text(F.col(f"_{f}")) for f in plain}
    wrong["image_urls"] = F.exists("_images", lambda x: truthy(x) & not_text(x))
    wrong["variants"] = bad_member("_variants", "sku", "pack", "pack_size")
    wrong["alternatives"] = bad_member("_alternatives", "name", "sku")
    named = F.coalesce(F.col("_name_text") != "", F.lit(False))
    reason = F.when(~named, F.lit("record has no product name"))
    for field, failed in wrong.items():
        reason = reason.when(failed, F.lit(f"type:{field}"))
    return reason


@reusable
def _views() -> list[Column]:
    """One view per raw field, so each value is typed and read once."""
    return [view(F.try_element_at("fields", F.lit(f))).alias(f"_{f}") for f in _RAW_FIELDS]


@reusable
def _parts() -> dict[str, Column]:
    objects = lambda name: F.filter(to_list(F.col(name)), lambda x: x["kind"] == "OBJ")
    own_url = F.when(is_text(F.col("_product_url")), F.col("_product_url.text"))
    base = F.coalesce(blank_to_null(F.col("page_url")), blank_to_null(own_url), F.lit(""))
    return {
        "_name_text": F.when(truthy(F.col("_name")), strip(text_of(F.col("_name")))),
        "_item_number": first_truthy(F.col("_item_number"), F.col("_sku")),
        "_currency": first_truthy(F.col("_currency")),
        "_product_url": first_truthy(F.col("_product_url")),
        "_sku_text": blank_to_null(strip(F.col("_sku.text"))),
        "_images": to_list(F.col("_image_urls")),
        "_variants": objects("_variants"),
        "_alternatives": objects("_alternatives"),
        "_top": split_url(base),
    }


@reusable
def _location() -> Column:
    top = F.col("_top")
    return F.coalesce(abs_url(F.col("_product_url.text"), top), top["raw"])


@reusable
def _product() -> list[Column]:
    top = F.col("_top")
    variant_items = F.transform(
        "_variants",
        lambda x: F.struct(
            member_text(x["v"], "sku").alias("sku"),
            F.coalesce(
                blank_to_null(member_text(x["v"], "pack")), blank_to_null(member_text(x["v"], "pack_size"))
            ).alias("pack_size"),
            let(view(member(x["v"], "price")), to_float).alias("price"),
            availability(member_text(x["v"], "availability")).alias("availability"),
        ),
    ).cast(f"array<{VARIANT_ITEM_DDL}>")
    alternative_items = F.transform(
        "_alternatives",
        lambda x: F.struct(
            blank_to_null(strip(member_text(x["v"], "name"))).alias("name"),
            abs_url(member_text(x["v"], "url"), top).alias("url"),
            member_text(x["v"], "sku").alias("sku"),
        ),
    ).cast(f"array<{ALTERNATIVE_DDL}>")
    specs = F.coalesce(
        F.transform_values(
            F.try_variant_get(F.col("_specifications.v"), "$", "map<string, variant>"),
            lambda _, v: F.coalesce(as_text(v), F.lit("None")),
        ),
        F.create_map().cast("map<string, string>"),
    )
    images = F.filter(
        F.transform("_images", lambda x: abs_url(x["text"], top)), lambda u: u.isNotNull()
    )
    return [
        dedup_key(F.col("_sku_text"), F.col("_url")).alias("dedup_key"),
        F.col("_name_text").alias("name"),
        F.col("_sku_text").alias("sku"),
        F.col("_item_number.text").alias("item_number"),
        blank_to_null(strip(F.col("_brand.text"))).alias("brand"),
        category_path(F.col("_category"), F.col("source_category")).alias("category_path"),
        F.col("source_category"),
        F.col("_url").alias("product_url"),
        to_float(F.col("_price")).alias("price"),
        F.coalesce(F.col("_currency.text"), F.lit("USD")).alias("currency"),
        F.col("_pack_size.text").alias("pack_size"),
        availability(text_of(F.col("_availability"))).alias("availability"),
        blank_to_null(strip(F.col("_description.text"))).alias("description"),
        specs.alias("specifications"),
        images.alias("image_urls"),
        to_float(F.col("_rating")).alias("rating"),
        variant_items.alias("variants"),
        alternative_items.alias("alternatives"),
        F.col("tier").alias("extraction_tier"),
    ]


def normalize(raw: DataFrame) -> DataFrame:
    """Products of raw records, plus ``reason`` for rows that are not valid products.

    Input: ``page_url``, ``source_category``, ``tier``, ``fields map<string, variant>``; other
    columns pass through. ``reason`` is ``record has no product name`` or ``type:<field>``
    (a text field holding something else).
    """
    passed = [c for c in raw.columns if c not in ("fields", "tier", "page_url", "source_category")]
    seen = raw.select(*passed, "tier", "page_url", "source_category", *_views())
    located = seen.withColumns(_parts()).withColumn("_url", _location())
    # The reason goes through a one-row generator: a filter on it then stays above this point
    # instead of being rewritten down to the raw values, which would evaluate all of this twice.
    judged = located.select("*", F.explode(F.array(_reason())).alias("reason"))
    return judged.select(*passed, "reason", *_product())


def valid(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason is null").drop("reason")


def rejected(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason is not null")


def _filled(field: str, strict_availability: bool) -> Column:
    if field == "availability":
        # An unknown state still counts as present unless the caller is strict.
        return F.col(field) != "unknown" if strict_availability else F.col(field).isNotNull()
    if field in ("image_urls", "category_path"):
        return F.size(field) > 0
    if field == "price":
        return F.col(field).isNotNull()
    return F.coalesce(F.col(field), F.lit("")) != ""


def coverage(strict_availability: bool = False) -> Column:
    """Share of the eight coverage fields a product fills."""
    hits = [
        F.coalesce(_filled(f, strict_availability), F.lit(False)).cast("int")
        for f in COVERAGE_FIELDS
    ]
    return sum(hits[1:], hits[0]) / F.lit(float(len(hits)))


def with_coverage(products: DataFrame, strict_availability: bool = False) -> DataFrame:
    return products.withColumn("coverage", coverage(strict_availability))


def page_coverage(products: DataFrame) -> DataFrame:
    """Mean record coverage per page, with the record count."""
    return products.groupBy("page_id").agg(
        F.avg("coverage").alias("coverage"), F.count("*").alias("records")
    )


def low_coverage_pages(pages: DataFrame, products: DataFrame, min_coverage: float) -> DataFrame:
    """Pages below the gate; a page without a single valid record has coverage 0."""
    scored = pages.select("page_id").join(page_coverage(products), "page_id", "left")
    return scored.select(
        "page_id",
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("records", F.lit(0)).alias("records"),
    ).where(F.col("coverage") < min_coverage)


def missing_fields(pages: DataFrame, products: DataFrame) -> DataFrame:
    """Coverage fields the first record of each page lacks; all of them without a record."""
    absent = {
        "price": F.coalesce(F.col("price") == 0, F.lit(True)),
        "availability": F.lit(False),
        "image_urls": F.size("image_urls") == 0,
        "category_path": F.size("category_path") == 0,
    }
    flags = [
        F.when(absent.get(f, F.coalesce(F.col(f), F.lit("")) == ""), F.lit(f))
        for f in COVERAGE_FIELDS
    ]
    firsts = products.groupBy("page_id").agg(
        F.min_by(F.array_compact(F.array(*flags)), "rec_no").alias("missing")
    )
    everything = F.array(*[F.lit(f) for f in COVERAGE_FIELDS])
    return pages.select("page_id").join(firsts, "page_id", "left").select(
        "page_id", F.coalesce("missing", everything).alias("missing")
    )


def to_flat_rows(products: DataFrame) -> DataFrame:
    """One text-friendly row per product: joined category path, nested columns as JSON."""
    keep_nulls = {"ignoreNullFields": "false"}
    nested = ("specifications", "image_urls", "variants", "alternatives")
    flat = {
        "category_path": F.array_join("category_path", " > "),
        **{c: F.to_json(c, keep_nulls) for c in nested},
    }
    return products.withColumns(flat).select(*FLAT_COLUMNS)
