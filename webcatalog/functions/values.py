"""Value expressions: loosely typed (VARIANT) input to clean catalog values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, distinct_by, let, strip

# Fixed spellings of the availability states.
AVAILABILITY = {
    "instock": "in_stock",
    "in_stock": "in_stock",
    "outofstock": "out_of_stock",
    "out_of_stock": "out_of_stock",
    "soldout": "out_of_stock",
    "preorder": "preorder",
    "backorder": "preorder",
    "discontinued": "discontinued",
}
_NUMBER = r"[-+]?\d[\d,]*\.?\d*"


def variant(value: Column) -> Column:
    """A string column as a VARIANT scalar."""
    return value.cast("variant")


def view(v: Column) -> Column:
    """``struct<v, kind, text>`` of a JSON value; null for a missing one or JSON null.

    ``kind`` is STR, BOO, NUM, ARR or OBJ. Taking the view once keeps the expressions that
    look at the same value several times small.
    """
    name = F.substring(F.schema_of_variant(v), 1, 3)
    kind = F.when(name.isin("BIG", "DEC", "DOU", "FLO"), "NUM").otherwise(name)
    text = F.try_variant_get(v, "$", "string")
    return F.when(
        ~F.is_variant_null(v), F.struct(v.alias("v"), kind.alias("kind"), text.alias("text"))
    )


def member(v: Column, key: str) -> Column:
    """Member of a JSON object as it is (JSON null included); null for other values."""
    return F.try_variant_get(v, f"$['{key}']", "variant")


def member_text(v: Column, key: str) -> Column:
    """String form of an object's member; null for a missing one, a list or an object."""
    return F.try_variant_get(v, f"$['{key}']", "string")


def get_items(v: Column) -> Column:
    """Items of a JSON array; null for other values."""
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(seen: Column) -> Column:
    """Text form of a viewed value; booleans are capitalised, containers are JSON text."""
    return F.when(seen["kind"] == "BOO", F.initcap(seen["text"])).otherwise(seen["text"])


def as_text(v: Column) -> Column:
    return let(view(v), text_of)


def is_text(seen: Column) -> Column:
    return seen["kind"] == "STR"


def not_text(seen: Column) -> Column:
    """A value is present and is something else than a string."""
    return F.coalesce(seen["kind"] != "STR", F.lit(False))


def truthy(seen: Column) -> Column:
    """False for null, blank text, zero, false and empty containers."""
    text = seen["text"]
    return F.coalesce(
        F.when(seen["kind"] == "STR", text != "")
        .when(seen["kind"] == "NUM", text.try_cast("double") != 0)
        .otherwise(~text.isin("false", "[]", "{}")),
        F.lit(False),
    )


def first_truthy(*seen: Column) -> Column:
    """First truthy of several viewed values."""
    return F.get(F.filter(F.array(*seen), truthy), F.lit(0))


def availability(text: Column) -> Column:
    word = F.replace(
        F.substring_index(F.lower(strip(text)), "/", -1), F.lit(" "), F.lit("")
    )
    lookup = F.create_map(*[F.lit(x) for pair in AVAILABILITY.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, word), F.lit("unknown"))


def number_in(text: Column) -> Column:
    """First number in a text once thousands commas are gone."""
    found = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), _NUMBER, 0)
    return blank_to_null(found).try_cast("double")


def to_float(seen: Column) -> Column:
    """Numbers as they are, booleans as 1 and 0, else the first number in the text."""
    text = seen["text"]
    return (
        F.when(seen["kind"] == "NUM", text.try_cast("double"))
        .when(seen["kind"] == "BOO", F.when(text == "true", 1.0).otherwise(0.0))
        .otherwise(number_in(text))
    )


def to_list(seen: Column) -> Column:
    """JSON array items without nulls, or the single value as a one-item list, as views."""
    items = F.when(seen["kind"] == "ARR", get_items(seen["v"])).when(
        seen.isNotNull(), F.array(seen["v"])
    )
    views = F.filter(F.transform(items, view), lambda x: x.isNotNull())
    return F.coalesce(views, F.array().cast("array<struct<v: variant, kind: string, text: string>>"))


def split_path(text: Column) -> Column:
    parts = F.transform(F.split(text, "[>/]"), strip)
    return F.filter(parts, lambda p: p != "")


def with_fallback(parts: Column, fallback: Column) -> Column:
    empty = F.array().cast("array<string>")
    return (
        F.when(F.size(parts) > 0, parts)
        .when(F.coalesce(fallback, F.lit("")) != "", F.array(fallback))
        .otherwise(empty)
    )


def category_path(seen: Column, fallback: Column) -> Column:
    """A list as it is, a text split at ``>`` or ``/``, else the source category."""
    listed = F.transform(get_items(seen["v"]), lambda x: strip(as_text(x)))
    parts = (
        F.when(seen["kind"] == "ARR", F.filter(listed, lambda p: p != ""))
        .when(seen["kind"] == "STR", split_path(seen["text"]))
        .otherwise(F.array().cast("array<string>"))
    )
    return let(F.coalesce(parts, F.array().cast("array<string>")), lambda p: with_fallback(p, fallback))


def dedup_key(sku: Column, url: Column) -> Column:
    return F.coalesce(blank_to_null(F.upper(strip(sku))), F.lower(strip(url)))


def is_expired(last_validated: Column, ttl_hours: Column, as_of: Column) -> Column:
    deadline = F.try_to_timestamp(last_validated) + F.make_interval(hours=ttl_hours)
    return F.coalesce(as_of > deadline, F.lit(True))


def is_grounded(value: Column, haystack: Column) -> Column:
    """Very short values pass; longer ones must occur in the (lower-cased) page text."""
    text = strip(value)
    return F.coalesce(
        (F.length(text) < 3) | F.contains(haystack, F.lower(text)), F.lit(False)
    )


def variant_skus(v: Column) -> Column:
    """``struct<primary, others>``: the first code, then the rest without spelling twins."""
    bare = lambda c: F.replace(as_text(c), F.lit("-"), F.lit(""))
    codes = get_items(v)
    rest = F.filter(F.slice(codes, 2, 1 << 30), lambda c: bare(c) != "")
    first = F.get(codes, F.lit(0))
    return F.struct(
        F.when(codes.isNull(), v).otherwise(first).alias("primary"),
        F.coalesce(distinct_by(rest, bare), F.array().cast("array<variant>")).alias("others"),
    )
