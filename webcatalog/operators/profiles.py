"""Extraction profiles: compile, match to pages, expire, label."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.selectors import SELECTOR_ARROW, SELECTOR_DDL, compile_selector
from webcatalog.functions.urls import domain_of, url_path
from webcatalog.functions.values import is_expired
from webcatalog.sources.local import broadcast_if_small

_COMPILED_DDL = f"struct<glob: string, selectors: map<string, {SELECTOR_DDL}>>"
_COMPILED = pa.struct(
    [("glob", pa.string()), ("selectors", pa.map_(pa.string(), SELECTOR_ARROW))]
)


def glob_to_regex(glob: str | None) -> str | None:
    """Anchored Java pattern of a shell glob in which ``*`` also crosses slashes."""
    if not glob:
        return None
    out, at = "", 0
    while at < len(glob):
        char, at = glob[at], at + 1
        close = glob.find("]", at + 1 + glob.startswith("!", at)) if char == "[" else -1
        if char in "*?":
            out += ".*" if char == "*" else "."
        elif close > 0:
            body, at = glob[at:close], close + 1
            negated, body = ("^", body[1:]) if body.startswith("!") else ("", body)
            # An inverted range holds no character, so it is dropped.
            body = re.sub(r"(.)-(.)", lambda m: m.group() if m[1] <= m[2] else "", body)
            inner = re.sub(r"[^\w-]", lambda m: "\\" + m.group(), body, flags=re.ASCII)
            out += f"[{negated}{inner}]" if inner else ("." if negated else "(?!)")
        else:
            out += re.sub(r"[^\w/]", lambda m: "\\" + m.group(), char, flags=re.ASCII)
    return rf"(?s)\A{out}\z"


def _compile(globs: pa.Array, selectors: pa.Array) -> pa.Array:
    rows = [
        {"glob": glob_to_regex(g), "selectors": [(s, compile_selector(s)) for s in wanted or []]}
        for g, wanted in zip(globs.to_pylist(), selectors.to_pylist())
    ]
    return pa.array(rows, _COMPILED)


def profile_domain(site: Column) -> Column:
    named = site.contains("//") | site.contains(".")
    return F.when(named, domain_of(site)).otherwise(site)


def _rule_selectors(rules: Column) -> Column:
    of_rule = lambda rule: F.concat(
        F.array(rule["value"]["selector"], rule["value"]["label"]),
        F.coalesce(rule["value"]["kv"], F.array().cast("array<string>")),
        F.coalesce(
            F.filter(F.map_values(rule["value"]["fields"]), lambda s: ~s.startswith("@")),
            F.array().cast("array<string>"),
        ),
    )
    return F.flatten(F.transform(rules, of_rule))


def compile_profiles(profiles: DataFrame) -> DataFrame:
    """One row per (domain, template): rules as an array plus compiled selectors and glob."""
    discovery = F.coalesce(
        F.map_values("discovery"), F.array().cast("array<string>")
    )
    selectors = F.array_distinct(
        F.filter(
            F.concat(_rule_selectors(F.col("rules")), discovery, F.array("item_selector")),
            lambda s: s.isNotNull(),
        )
    )
    return (
        profiles.withColumn("domain", profile_domain(F.col("site")))
        .withColumn("rules", F.map_entries("fields"))
        .withColumn("compiled", F.arrow_udf(_compile, _COMPILED_DDL)("url_glob", selectors))
        .select(
            "domain", "template", "cardinality", "url_glob", "item_selector", "discovery",
            "rules", F.col("compiled.glob").alias("glob_regex"),
            F.col("compiled.selectors").alias("selectors"),
            profile_tier(F.col("rules")).alias("profile_tier"),
            "template_signature", "last_validated", "ttl_hours", "version",
        )
    )


def profile_tier(rules: Column) -> Column:
    """The single rule source of a profile, or ``mixed``."""
    sources = F.array_distinct(
        F.transform(rules, lambda r: F.coalesce(r["value"]["source"], F.lit("jsonld")))
    )
    return F.when(F.size(sources) > 1, "mixed").otherwise(
        F.coalesce(F.get(sources, F.lit(0)), F.lit("jsonld"))
    )


def profile_tiers(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        profile_domain(F.col("site")).alias("domain"), "template",
        profile_tier(F.map_entries("fields")).alias("tier"),
    )


def template_for(kind: Column) -> Column:
    """Template a page is looked up under, from what the frontier says it is."""
    return F.when(kind == "product", "product-detail").otherwise("catalog-listing")


def match_templates(pages: DataFrame, compiled: DataFrame, template: Column) -> DataFrame:
    """Add ``domain`` and ``template``: the page's own template where its domain has it, else
    the one with the longest matching glob (name order breaks ties); null without any.

    Only (template, glob) pairs are gathered per domain, so the build side stays small enough
    to broadcast; a larger one falls back to a sort-merge join that AQE splits on skew.
    """
    choices = compiled.groupBy("domain").agg(
        F.collect_list(F.struct("template", "glob_regex", "url_glob")).alias("choices")
    )
    path = url_path(F.col("url"))
    exact = F.exists("choices", lambda c: c["template"] == F.col("wanted_template"))
    fitting = F.filter(
        "choices", lambda c: c["glob_regex"].isNull() | F.regexp_like(F.col("path"), c["glob_regex"])
    )
    ranked = F.transform(
        fitting,
        lambda c: F.struct(
            (-F.length(F.coalesce(c["url_glob"], F.lit("")))).alias("rank"),
            c["template"].alias("template"),
        ),
    )
    return (
        pages.withColumn("domain", domain_of(F.col("url")))
        .withColumn("wanted_template", template)
        .withColumn("path", path)
        .join(broadcast_if_small(choices), "domain", "left")
        .withColumn(
            "template",
            F.when(exact, F.col("wanted_template")).otherwise(F.array_min(ranked)["template"]),
        )
        .drop("choices", "path", "wanted_template")
    )


def match_profiles(pages: DataFrame, compiled: DataFrame, template: Column) -> DataFrame:
    """Left join of pages with their profile (see :func:`match_templates`)."""
    return match_templates(pages, compiled, template).join(
        broadcast_if_small(compiled), ["domain", "template"], "left"
    )


def expired_profiles(profiles: DataFrame, as_of: Column) -> DataFrame:
    return profiles.withColumn(
        "expired", is_expired(F.col("last_validated"), F.col("ttl_hours"), as_of)
    )


def resolve_source(
    seeds: DataFrame, recipes: DataFrame, default: str = "html", pinned: str | None = None
) -> DataFrame:
    """One row: the backend of the first seed domain with a learned recipe, unless pinned."""
    learned = (
        seeds.withColumn("domain", domain_of(F.col("url")))
        .groupBy("domain")
        .agg(F.min("seq").alias("seq"))
        .join(recipes.where("coalesce(backend, '') <> ''"), "domain")
    )
    first = lambda name: F.min_by(name, "seq")
    picked = learned.agg(
        first("backend").alias("backend"), first("domain").alias("domain"),
        first("params").alias("params"),
    )
    if pinned:
        return picked.select(
            F.lit(pinned).alias("backend"), F.lit(None).cast("string").alias("domain"),
            F.lit(None).cast("map<string, string>").alias("params"),
        )
    return picked.withColumn("backend", F.coalesce("backend", F.lit(default)))
