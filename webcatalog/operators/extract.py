"""Extraction: apply profile rules to parsed pages and emit raw records.

Everything happens in the page's own row (arrays and higher-order functions), so a job over
any number of pages extracts without a shuffle: only the profile join may move data.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import (
    blank_to_null,
    distinct_by,
    explode_rows,
    last_wins_map,
    let,
    reusable,
    strip,
)
from webcatalog.functions.selectors import all_inside, element_text, element_value, first_inside, select
from webcatalog.functions.values import first_truthy, member, text_of, variant, view



def typed_nodes(doc: Column, type_name: str) -> Column:
    """Parsed JSON-LD nodes of a type, in document order."""
    kept = F.filter(doc["nodes"], lambda n: F.array_contains(n["types"], type_name))
    return F.filter(F.transform(kept, lambda n: F.try_parse_json(n["json"])), lambda v: v.isNotNull())


def product_nodes(doc: Column) -> Column:
    """Product nodes, first per ``@id``, else ``sku``, else ``name``."""
    key = lambda n: text_of(
        first_truthy(*[view(member(n, k)) for k in ("@id", "sku", "name")])
    )
    return let(typed_nodes(doc, "Product"), lambda nodes: distinct_by(nodes, key))


def _members(v: Column) -> Column:
    """Members of a JSON object, or of the first item of a list."""
    return F.coalesce(
        F.try_variant_get(v, "$", "map<string, variant>"),
        F.try_variant_get(v, "$[0]", "map<string, variant>"),
    )


def jsonld_path(members: Column, path: Column) -> Column:
    """Follow a dotted path from a node's members; a list on the way stands for its first item.

    Works on member maps: a path built per row would have to be parsed again for every value.
    """
    tokens = F.split(F.coalesce(path, F.lit("")), r"\.")
    named = F.lower(F.get(tokens, F.lit(0))) == "product"
    steps = F.when(named, F.slice(tokens, 2, 1 << 30)).otherwise(tokens)

    def follow(keys: Column) -> Column:
        first = F.try_element_at(members, F.get(keys, F.lit(0)))
        return F.aggregate(
            F.slice(keys, 2, 1 << 30), first, lambda cur, key: F.try_element_at(_members(cur), key)
        )

    return let(let(steps, follow), lambda found: F.when(~F.is_variant_null(found), found))


def _regex_values(texts: pa.Array, patterns: pa.Array, groups: pa.Array) -> pa.Array:
    out = []
    for page_texts, page_patterns, page_groups in zip(
        texts.to_pylist(), patterns.to_pylist(), groups.to_pylist()
    ):
        rules = list(zip(page_patterns or [], page_groups or []))
        out.append([[_search(p, g, t) for p, g in rules] for t in page_texts or []])
    return pa.array(out, pa.list_(pa.list_(pa.string())))


def _search(pattern: str | None, group: int, text: str) -> str | None:
    try:
        found = re.search(pattern, text, re.IGNORECASE | re.DOTALL) if pattern else None
        return found.group(group).strip() if found else None
    except (re.error, IndexError, AttributeError):
        return None


def regex_values(texts: Column, patterns: Column, groups: Column) -> Column:
    """``values[i][j]``: group of the first match of pattern j in text i, trimmed.

    Python's dialect, and a bad pattern or missing group gives null instead of failing the
    job, so this is the one rule family evaluated in an Arrow step.
    """
    return F.arrow_udf(_regex_values, "array<array<string>>")(texts, patterns, groups)


def _label_rows(rows: Column, labels: Column, texts: Column, require_colon: Column) -> Column:
    def entry(row: Column) -> Column:
        label = element_text(texts, first_inside(labels, row))
        rest = F.substr(element_text(texts, row), F.length(label) + 1)
        return F.struct(
            strip(F.regexp_replace(label, ":+$", "")).alias("key"),
            F.trim(rest, F.lit(" :–-")).alias("value"),
            F.rtrim(label).endswith(":").alias("colon"),
        )

    kept = F.filter(
        F.transform(rows, entry),
        lambda e: (e["key"] != "") & (e["value"] != "")
        & (e["colon"] | ~F.coalesce(require_colon, F.lit(False))),
    )
    return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def _pair_rows(rows: Column, keys: Column, values: Column, texts: Column) -> Column:
    entries = F.transform(
        rows,
        lambda row: F.struct(
            F.regexp_replace(
                element_text(texts, first_inside(keys, row)), ":+$", ""
            ).alias("key"),
            element_text(texts, first_inside(values, row)).alias("value"),
        ),
    )
    return F.filter(entries, lambda e: (e["key"] != "") & e["value"].isNotNull())


def _sub_records(rows: Column, rule: Column, hits: Column, texts: Column) -> Column:
    def value(row: Column, sub: Column) -> Column:
        found = let(F.try_element_at(hits, sub["value"]), lambda es: first_inside(es, row))
        return F.when(sub["value"].startswith("@"), element_value(texts, row, sub["value"])).otherwise(
            F.when(found.isNotNull(), element_value(texts, found, rule["attr"]))
        )

    records = F.transform(
        rows,
        lambda row: F.map_from_entries(
            F.transform(
                F.map_entries(rule["fields"]),
                lambda sub: F.struct(sub["key"].alias("key"), value(row, sub).alias("value")),
            )
        ),
    )
    return F.filter(
        records,
        lambda r: F.exists(F.map_values(r), lambda v: F.coalesce(v, F.lit("")) != ""),
    )


def css_value(rule: Column, hits: Column, texts: Column, scope: Column) -> Column:
    """Value of a CSS rule within a scope element, as VARIANT; null when nothing matches."""
    as_map = lambda entries: let(
        entries, lambda es: F.when(F.size(es) > 0, F.to_variant_object(last_wins_map(es)))
    )
    hit = lambda name: F.try_element_at(hits, name)

    def of(rows: Column) -> Column:
        labels = as_map(let(hit(rule["label"]), lambda ls: _label_rows(rows, ls, texts, rule["require_colon"])))
        of_pair = F.struct(hit(F.get(rule["kv"], F.lit(0))).alias("keys"), hit(F.get(rule["kv"], F.lit(1))).alias("values"))
        pairs = as_map(let(of_pair, lambda p: _pair_rows(rows, p["keys"], p["values"], texts)))
        subs = let(
            _sub_records(rows, rule, hits, texts),
            lambda rs: F.when(F.size(rs) > 0, F.to_variant_object(rs)),
        )
        every = F.to_variant_object(F.transform(rows, lambda e: element_value(texts, e, rule["attr"])))
        return (
            F.when(F.coalesce(F.size(rows), F.lit(0)) == 0, None)
            .when(rule["label"].isNotNull(), labels)
            .when(rule["kv"].isNotNull(), pairs)
            .when(rule["fields"].isNotNull(), subs)
            .when(F.coalesce(rule["all"], F.lit(False)), every)
            .otherwise(variant(element_value(texts, F.get(rows, F.lit(0)), rule["attr"])))
        )

    return let(let(hit(rule["selector"]), lambda es: all_inside(es, scope)), of)


@reusable
def _mode() -> Column:
    has_products = F.exists("doc.nodes", lambda n: F.array_contains(n["types"], "Product"))
    return (
        F.when(F.col("rules").isNull(), None)
        .when(F.col("cardinality") != "many", "one")
        .when(has_products, "nodes")
        .when(F.coalesce(F.col("item_selector"), F.lit("")) != "", "items")
        .otherwise("none")
    )


@reusable
def _items() -> Column:
    steps = F.try_element_at("selectors", F.col("item_selector"))
    return F.when(F.col("mode") == "items", select(F.col("doc.elems"), steps))


def plan_pages(matched: DataFrame) -> DataFrame:
    """Add ``mode`` (nodes, items, one, none) and, for item pages, the ``items`` elements."""
    return matched.withColumn("mode", _mode()).withColumn("items", _items())


def extraction_notes(matched: DataFrame) -> DataFrame:
    """Why a page gave no records, and which selectors of its profile are not supported."""
    planned = plan_pages(matched)
    unsupported = F.map_keys(F.map_filter("selectors", lambda _, steps: steps.isNull()))
    notes = F.array_compact(
        F.concat(
            F.array(
                F.when(
                    (F.col("mode") == "items") & (F.size("items") == 0),
                    F.concat(F.lit("item_selector '"), "item_selector", F.lit("' matched nothing")),
                ),
                F.when(
                    F.col("mode") == "none",
                    F.lit("no Product nodes and no item_selector for 'many' profile"),
                ),
            ),
            F.transform(unsupported, lambda s: F.concat(F.lit("unsupported selector: "), s)),
        )
    )
    staged = planned.select("page_id", "url", notes.alias("notes"))
    return explode_rows(staged, ["page_id", "url"], "notes", "note_no", "note").drop("note_no")


def _regex_rules() -> Column:
    return F.filter("rules", lambda r: r["value"]["source"] == "regex")


def _searched(planned: DataFrame) -> DataFrame:
    """Add ``regex_values``: per scope text (page or item) the value of each regex rule."""
    rules, texts = _regex_rules(), F.col("doc.texts")
    item_texts = F.transform("items", lambda e: element_text(texts, e))
    scope_texts = F.when(F.col("mode") == "items", item_texts).otherwise(
        F.array(F.array_join(texts, " "))
    )
    values = regex_values(
        F.when(F.size(rules) > 0, scope_texts),
        F.transform(rules, lambda r: r["value"]["pattern"]),
        F.transform(rules, lambda r: F.coalesce(r["value"]["group"], F.lit(1))),
    )
    return planned.withColumn("regex_values", values)


@reusable
def _records() -> Column:
    """Array of field maps of a planned page, one per scope.

    A scope is what a record is read from: a Product node (with the whole page for CSS rules)
    or an item element. Selectors are matched once per page and cut to each scope.
    """
    elems, texts, item_mode = F.col("doc.elems"), F.col("doc.texts"), F.col("mode") == "items"
    nothing = F.lit(None).cast("variant")
    scope = lambda idx, tail, node, at: F.struct(
        idx.alias("idx"), tail.alias("tail"), _members(node).alias("members"), at.alias("at")
    )
    page_scope = lambda node: scope(F.lit(-1), F.lit(2**31 - 1), node, F.lit(0))
    nodes = let(
        product_nodes(F.col("doc")),
        lambda ns: F.when(F.col("mode") == "nodes", ns).otherwise(F.array(F.get(ns, F.lit(0)))),
    )
    scopes = F.when(
        item_mode, F.transform("items", lambda e, i: scope(e["idx"], e["tail"], nothing, i))
    ).when(F.col("mode").isin("nodes", "one"), F.transform(nodes, page_scope))
    regex_fields = F.transform(_regex_rules(), lambda r: r["key"])

    def field(rule: Column, page: Column, sc: Column) -> Column:
        body = rule["value"]
        source = F.coalesce(body["source"], F.when(item_mode, "css").otherwise("jsonld"))
        at = F.array_position(page["regex_fields"], rule["key"]).cast("int") - 1
        found = F.get(F.get(page["regex_values"], sc["at"]), at)
        return (
            F.when((source == "jsonld") & ~item_mode, jsonld_path(sc["members"], body["path"]))
            .when(source.isin("css", "attr"), css_value(body, page["hits"], texts, sc))
            .when(source == "regex", variant(found))
        )

    def record(page: Column, sc: Column) -> Column:
        # The page URL stands in for a record's own one; a rule that finds none clears it.
        values = F.transform(
            "rules", lambda r: F.struct(r["key"].alias("key"), field(r, page, sc).alias("value"))
        )
        default = F.struct(F.lit("product_url").alias("key"), variant(F.col("url")).alias("value"))
        named = F.exists("rules", lambda r: r["key"] == "product_url")
        return F.map_from_entries(
            F.when(named, values).otherwise(F.concat(values, F.array(default)))
        )

    hits = F.transform_values("selectors", lambda _, steps: select(elems, steps))
    page = F.struct(
        hits.alias("hits"), F.col("regex_values"), regex_fields.alias("regex_fields")
    )
    return let(page, lambda p: F.transform(scopes, lambda sc: record(p, sc)))


_PLAN_COLUMNS = [
    "doc", "mode", "items", "regex_values", "rules", "selectors", "glob_regex", "url_glob",
    "item_selector", "discovery", "cardinality", "template_signature", "last_validated",
    "ttl_hours", "version", "profile_tier",
]


def extract_records(
    matched: DataFrame, regex: bool | None = None, keep_empty: bool = False
) -> DataFrame:
    """Raw records of pages that carry a document and a compiled profile.

    Output: the page's own columns, ``rec_no``, ``tier`` and ``fields map<string, variant>``.
    ``regex=False`` leaves the Arrow step for regex rules out of the plan. ``keep_empty`` keeps
    a row (with null ``rec_no``) for pages without any record.
    """
    planned = plan_pages(matched)
    if not keep_empty:
        planned = planned.where("mode is not null")
    if regex is False:
        planned = planned.withColumn("regex_values", F.lit(None).cast("array<array<string>>"))
    else:
        planned = _searched(planned)
    kept = [c for c in matched.columns if c not in _PLAN_COLUMNS]
    staged = planned.select(
        *kept, F.col("profile_tier").alias("tier"), _records().alias("records")
    )
    exploded = staged.select(
        *kept, "tier", F.posexplode_outer("records").alias("rec_no", "fields")
    )
    return exploded if keep_empty else exploded.where("rec_no is not null")
