"""Page jobs: parse, block detection, template signatures and text views."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, let, lines
from webcatalog.functions.html import CHROME, HIDDEN, parse_html

# Fixed marks of an access-denied or challenge page.
BLOCK_STATUSES = [401, 403, 429]
BLOCK_MARKERS = [
    "just a moment", "attention required", "cf-browser-verification", "cf-chl-",
    "/cdn-cgi/challenge", "access denied", "enable javascript",
]
# Marks further down belong to a page's own text.
BLOCK_HEAD = 4000
# Fixed order of the landmark tags in a template signature.
LANDMARKS = ["html", "head", "body", "header", "nav", "main", "footer", "form"]
HINT_TAGS = ["h1", "h2", "h3", "table", "ul", "dl"]


def with_documents(pages: DataFrame, node_types: Iterable[str] | None = None) -> DataFrame:
    """Replace ``html`` by the parsed ``doc`` column, so raw markup is never carried along.

    ``node_types``: as in :func:`parse_html`.
    """
    return pages.withColumn("doc", parse_html("html", node_types)).drop("html")


def _cut(text: Column, limit: int | None) -> Column:
    return text if limit is None else F.substring(text, 1, limit)


def is_blocked(status: Column, html: Column, head_chars: int | None = BLOCK_HEAD) -> Column:
    """Whether the status or a mark in the first ``head_chars`` characters (None: all) says so."""
    # Plain searches: alternatives of a pattern would be tried at every character.
    found = lambda head: reduce(or_, [F.contains(head, F.lit(m)) for m in BLOCK_MARKERS])
    marked = let(F.lower(_cut(html, head_chars)), found)
    return F.coalesce(status.isin(BLOCK_STATUSES), F.lit(False)) | F.coalesce(marked, F.lit(False))


def flag_blocked(pages: DataFrame) -> DataFrame:
    return pages.withColumn("blocked", is_blocked(F.col("status"), F.col("html")))


def signature(doc: Column) -> Column:
    """Structural fingerprint: top-level JSON-LD types, block count and landmark tags."""
    tags = F.transform(doc["elems"], lambda e: e["tag"])
    quoted = [F.when(F.array_contains(tags, t), F.lit(f'"{t}"')) for t in LANDMARKS]
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    text = F.concat(
        F.lit('{"blocks": '), doc["blocks"].cast("string"),
        F.lit(', "landmarks": '), listed(F.array(*quoted)),
        F.lit(', "types": '), listed(doc["block_types"]), F.lit("}"),
    )
    return F.substring(F.sha2(text, 256), 1, 16)


def template_signatures(documents: DataFrame) -> DataFrame:
    return documents.withColumn("signature", signature(F.col("doc"))).drop("doc")


def visible_texts(doc: Column, dropped: int) -> Column:
    """Strings of the page outside elements of the dropped kinds."""
    return F.filter(
        doc["texts"],
        lambda _, i: F.get(doc["text_skip"], i).bitwiseAND(F.lit(dropped)) == 0,
    )


def clean_text(doc: Column, limit: int | None = 6000) -> Column:
    """Readable page text, one stripped line per string, cut at ``limit`` characters (None: whole)."""
    joined = F.array_join(visible_texts(doc, HIDDEN | CHROME), "\n")
    return _cut(F.array_join(lines(joined), "\n"), limit)


def clean_texts(documents: DataFrame, limit: int | None = 6000) -> DataFrame:
    return documents.withColumn("text", clean_text(F.col("doc"), limit)).drop("doc")


def jsonld_sample(documents: DataFrame, limit: int | None = 3000, nodes: int = 3) -> DataFrame:
    """Single-valued node types of each page, and the JSON of its first ``nodes`` nodes."""
    single = F.filter("doc.nodes", lambda n: ~n["listed"])
    types = F.array_sort(F.array_distinct(F.flatten(F.transform(single, lambda n: n["types"]))))
    first = F.transform(F.slice("doc.nodes", 1, nodes), lambda n: n["json"])
    sample = F.when(
        F.size(first) > 0, F.concat(F.lit("["), F.array_join(first, ", "), F.lit("]"))
    ).otherwise("(none)")
    return documents.withColumn("jsonld_types", types).withColumn(
        "jsonld_sample", _cut(sample, limit)
    ).drop("doc")


def structure_hint(doc: Column, limit: int | None = 2500, chars: int = 60, classes_shown: int = 3) -> Column:
    """Outline lines ``tag.classes :: first characters``.

    Cutting the joined lines at ``limit`` equals stopping at the first line beyond it.
    """
    texts, skips = doc["texts"], doc["text_skip"]

    def line(e: Column) -> Column:
        classes = F.array_join(F.slice(e["classes"], 1, classes_shown), ".")
        own = F.filter(
            F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]),
            lambda _, i: F.get(skips, e["t0"] + i).bitwiseAND(F.lit(HIDDEN)) == 0,
        )
        # So many characters never need more strings.
        text = F.substring(F.array_join(F.slice(own, 1, chars), " "), 1, chars)
        suffix = F.coalesce(F.concat(F.lit("."), blank_to_null(classes)), F.lit(""))
        return F.concat(e["tag"], suffix, F.lit(" :: "), text)

    marked = F.filter(
        doc["elems"],
        lambda e: e["tag"].isin(HINT_TAGS) & (e["skip"].bitwiseAND(F.lit(HIDDEN)) == 0),
    )
    return _cut(F.array_join(F.transform(marked, line), "\n"), limit)


def structure_hints(documents: DataFrame, limit: int | None = 2500) -> DataFrame:
    return documents.withColumn("hints", structure_hint(F.col("doc"), limit)).drop("doc")


def revalidation_sample(pages: DataFrame, rate: float, salt: str = "") -> DataFrame:
    """A repeatable share of the pages, chosen by a hash of the URL."""
    digest = F.substring(F.md5(F.concat(F.col("url"), F.lit(salt))), 1, 6)
    return pages.where(F.conv(digest, 16, 10).cast("long") < F.lit(int(rate * 16**6)))


def build_prompts(
    pages: DataFrame, template: str, **columns: str | Column
) -> DataFrame:
    """Render a ``{name}`` template per row, for offline batch inference elsewhere."""
    text: Column = F.lit(template)
    for name, value in columns.items():
        value = F.col(value) if isinstance(value, str) else value
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit("(none)")))
    return pages.withColumn("prompt", text)
