"""Link discovery: products, sub-categories, breadcrumbs and next pages of parsed pages.

All layers are expressions over the page's own row; the long ``links`` table comes out of one
explode, so discovery never shuffles pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, distinct_by, explode_rows, let, reusable
from webcatalog.functions.selectors import element_text, select
from webcatalog.functions.urls import (
    abs_url,
    query_params,
    split_url,
    strip_fragment,
    url_host,
    url_path,
    url_query,
    url_scheme,
)
from webcatalog.functions.values import get_items, member, member_text
from webcatalog.operators.extract import typed_nodes
from webcatalog.operators.pages import signature

# Fixed labels and symbols of a next-page control.
NEXT_WORDS = [
    "next", "next page", "older", "older posts", "more", "load more", "show more",
    "siguiente", "suivant", "weiter", "下一页", "下一頁",
]
NEXT_SYMBOLS = [">", "›", "»", "→", "≫", ">>"]
# Fixed pattern of a page number in a path.
PATH_PAGE = r"(?i)(?:page[-/_]?|/p/)(\d+)"

_NO_STRINGS = "array<string>"
_NO_LINKS = "array<struct<url: string, name: string>>"


def _chosen(name: str) -> Column:
    """Elements of the profile's own discovery selector; none without one."""
    selector = F.try_element_at("discovery", F.lit(name))
    return select(F.col("doc.elems"), F.try_element_at("selectors", selector))


def _hrefs(elems: Column) -> Column:
    found = F.transform(elems, lambda e: F.try_element_at(e["attrs"], F.lit("href")))
    return F.filter(found, lambda h: F.coalesce(h, F.lit("")) != "")


def _page_number(path: Column) -> Column:
    return F.regexp_extract(path, PATH_PAGE, 1).try_cast("decimal(38,0)")


def _digits(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit("^[0-9]+$")), text.try_cast("decimal(38,0)"))


def next_page_urls(doc: Column, url: Column, chosen: Column) -> Column:
    """Next-page URLs in order of trust, each once.

    Layers: the profile's selector, ``rel=next``, labelled controls, a query parameter one
    above the current value, a page number in the path one above the current one. All layers
    contribute. Only links to the same host and to another page count.
    """
    texts = doc["texts"]

    def anchor(e: Column) -> Column:
        get = lambda name: F.try_element_at(e["attrs"], F.lit(name))
        label = F.coalesce(
            blank_to_null(element_text(texts, e)), blank_to_null(get("aria-label")),
            blank_to_null(get("title")), F.lit(""),
        )
        return F.struct(
            get("href").alias("href"),
            F.coalesce(F.array_contains(F.split(F.lower(get("rel")), r"\s+"), "next"), F.lit(False)).alias("rel"),
            F.lower(F.trim(label)).isin(NEXT_WORDS + NEXT_SYMBOLS).alias("labelled"),
            F.coalesce(F.lower(F.array_join(e["classes"], " ")).contains("next"), F.lit(False)).alias("classed"),
            (e["tag"] == "a").alias("is_a"),
        )

    def target(a: Column, here: Column) -> Column:
        return F.struct(
            a["href"].alias("href"), a["rel"].alias("rel"),
            (a["is_a"] & (a["labelled"] | a["classed"])).alias("control"),
            a["is_a"].alias("is_a"),
            F.coalesce(abs_url(a["href"], here["split"]), here["url"]).alias("url"),
        )

    def allowed(target_url: Column, here: Column) -> Column:
        host = url_host(target_url)
        return (
            url_scheme(target_url).isin("http", "https")
            & ((host == "") | (here["host"] == "") | (host == here["host"]))
            & (strip_fragment(target_url) != strip_fragment(here["url"]))
        )

    def same_host(target_url: Column, here: Column) -> Column:
        host = url_host(target_url)
        return (host == "") | (here["host"] == "") | (host == here["host"])

    def counts_up(target_url: Column, here: Column) -> Column:
        params = query_params(target_url)
        return F.exists(
            distinct_by(params, lambda p: p["key"]),
            lambda p: _digits(p["value"]) == F.coalesce(
                _digits(F.get(F.filter(here["params"], lambda q: q["key"] == p["key"]), F.lit(0))["value"]),
                F.lit(1).cast("decimal(38,0)"),
            ) + 1,
        )

    def layers(here: Column) -> Column:
        marked = F.transform(
            F.filter(doc["elems"], lambda e: e["tag"].isin("a", "link") & F.map_contains_key(e["attrs"], "href")),
            anchor,
        )
        own = F.transform(_hrefs(chosen), lambda h: abs_url(h, here["split"]))

        def gather(targets: Column) -> Column:
            pick = lambda test: F.transform(F.filter(targets, test), lambda t: t["url"])
            has = lambda t: F.coalesce(t["href"], F.lit("")) != ""
            path_of = lambda t: url_path(t["url"])
            return F.concat(
                own,
                pick(lambda t: t["rel"] & has(t)),
                pick(lambda t: t["control"] & has(t)),
                pick(
                    lambda t: t["is_a"] & has(t) & same_host(t["url"], here)
                    & (path_of(t) == here["path"]) & (url_query(t["url"]) != "")
                    & F.coalesce(counts_up(t["url"], here), F.lit(False))
                ),
                pick(
                    lambda t: t["is_a"] & has(t) & same_host(t["url"], here) & (path_of(t) != here["path"])
                    & F.coalesce(_page_number(path_of(t)) == here["number"] + 1, F.lit(False))
                ),
            )

        found = let(F.transform(marked, lambda a: target(a, here)), gather)
        return F.array_distinct(F.filter(found, lambda u: allowed(u, here)))

    here = F.struct(
        url.alias("url"), split_url(url).alias("split"), url_host(url).alias("host"),
        url_path(url).alias("path"), query_params(url).alias("params"),
        F.coalesce(_page_number(url_path(url)), F.lit(1).cast("decimal(38,0)")).alias("number"),
    )
    return F.coalesce(let(here, layers), F.array().cast(_NO_STRINGS))


def _offer_url(item: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(item, "$.offers.url", "string"),
        F.try_variant_get(item, "$.offers[0].url", "string"),
    )


def _has_type(node: Column, name: str) -> Column:
    declared = member(node, "@type")
    listed = F.exists(get_items(declared), lambda t: F.try_variant_get(t, "$", "string") == name)
    return F.coalesce(listed, member_text(node, "@type") == name, F.lit(False))


def list_entries(doc: Column, url: Column) -> Column:
    """Product and sub-category entries of every ItemList, in document order."""

    def entries(node: Column) -> Column:
        named = F.coalesce(F.contains(member_text(node, "name"), F.lit("Product")), F.lit(False))

        def entry(el: Column) -> Column:
            item = member(el, "item")
            is_product = _has_type(item, "Product") | named
            target = F.when(
                is_product,
                F.coalesce(
                    blank_to_null(member_text(el, "url")), blank_to_null(member_text(item, "url")),
                    _offer_url(item),
                ),
            ).when(_has_type(item, "CollectionPage"), member_text(item, "url"))
            return F.struct(
                F.when(is_product, "product").otherwise("subcategory").alias("kind"),
                target.alias("href"),
                F.coalesce(member_text(item, "name"), F.lit("")).alias("name"),
            )

        return F.transform(get_items(member(node, "itemListElement")), entry)

    found = F.flatten(F.filter(F.transform(typed_nodes(doc, "ItemList"), entries), lambda x: x.isNotNull()))
    kept = F.filter(found, lambda x: F.coalesce(x["href"], F.lit("")) != "")
    resolved = lambda top: F.transform(
        kept, lambda x: F.struct(x["kind"], abs_url(x["href"], top).alias("url"), x["name"])
    )
    return let(split_url(url), resolved)


def breadcrumb(doc: Column) -> Column:
    """Names of the last non-empty BreadcrumbList; empty without one."""
    names = F.transform(
        typed_nodes(doc, "BreadcrumbList"),
        lambda n: F.filter(
            F.transform(get_items(member(n, "itemListElement")), lambda e: member_text(e, "name")),
            lambda t: F.coalesce(t, F.lit("")) != "",
        ),
    )
    filled = F.filter(names, lambda n: F.coalesce(F.size(n), F.lit(0)) > 0)
    return F.coalesce(F.try_element_at(filled, F.lit(-1)), F.array().cast(_NO_STRINGS))


@reusable
def _link_columns(profiled: bool) -> dict[str, Column]:
    doc, url = F.col("doc"), F.col("url")
    urls_of = lambda elems: let(
        split_url(url), lambda top: F.transform(_hrefs(elems), lambda h: abs_url(h, top))
    )
    fallback = F.filter(
        doc["elems"],
        lambda e: (e["tag"] == "a")
        & F.coalesce(F.try_element_at(e["attrs"], F.lit("href")).contains("/product/"), F.lit(False)),
    )
    listed = lambda entries, kind: F.filter(entries, lambda x: x["kind"] == kind)
    listed_urls = F.transform(listed(F.col("_entries"), "product"), lambda x: x["url"])
    if profiled:
        listed_urls = F.concat(urls_of(_chosen("product_link")), listed_urls)
    products = let(
        listed_urls, lambda us: F.when(F.size(us) > 0, us).otherwise(urls_of(fallback))
    )
    subs = F.array_distinct(
        F.transform(
            listed(F.col("_entries"), "subcategory"),
            lambda x: F.struct(x["url"].alias("url"), x["name"].alias("name")),
        )
    )
    return {
        "product_urls": F.coalesce(F.array_distinct(products), F.array().cast(_NO_STRINGS)),
        "subcategories": F.coalesce(subs, F.array().cast(_NO_LINKS)),
        "breadcrumb": breadcrumb(doc),
    }


@reusable
def _entries_column() -> Column:
    return list_entries(F.col("doc"), F.col("url"))


@reusable
def _next_column(profiled: bool) -> Column:
    chosen = _chosen("next_page") if profiled else F.slice("doc.elems", 1, 0)
    return next_page_urls(F.col("doc"), F.col("url"), chosen)


def with_links(matched: DataFrame, next_pages: bool = True) -> DataFrame:
    """Add ``product_urls``, ``subcategories``, ``breadcrumb`` and ``next_pages`` arrays.

    Pages may carry ``discovery`` and ``selectors`` from their profile; without these columns
    only the generic layers apply.
    """
    profiled = "discovery" in matched.columns
    out = matched.withColumn("_entries", _entries_column()).withColumns(_link_columns(profiled))
    if next_pages:
        out = out.withColumn("next_pages", _next_column(profiled))
    return out.drop("_entries")


def discover_links(matched: DataFrame) -> DataFrame:
    """Long table ``links(page_id, kind, pos, url, name)``; ``pos`` counts within a kind."""
    linked = with_links(matched)
    rows = lambda items, kind, url, name: F.transform(
        items,
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), url(x).alias("url"), name(x).alias("name")),
    )
    nothing = lambda _: F.lit(None).cast("string")
    links = F.concat(
        rows(F.col("product_urls"), "product", lambda x: x, nothing),
        rows(F.col("subcategories"), "subcategory", lambda x: x["url"], lambda x: x["name"]),
        rows(F.col("next_pages"), "next_page", lambda x: x, nothing),
        rows(F.col("breadcrumb"), "breadcrumb", nothing, lambda x: x),
    )
    staged = linked.select("page_id", links.alias("links"))
    return explode_rows(staged, ["page_id"], "links", "n", "link").select("page_id", "link.*")


def find_next_pages(matched: DataFrame) -> DataFrame:
    urls = _next_column("discovery" in matched.columns)
    staged = matched.select("page_id", F.col("url").alias("page_url"), urls.alias("urls"))
    return explode_rows(staged, ["page_id", "page_url"], "urls", "pos", "url")


def discover_summary(matched: DataFrame) -> DataFrame:
    """Per page: link counts, breadcrumb, profile flag and template signature."""
    linked = with_links(matched, next_pages=False)
    return linked.select(
        "page_id", "url",
        F.size("product_urls").alias("products_found"),
        F.size("subcategories").alias("subcategories_found"),
        F.array_join("breadcrumb", " > ").alias("breadcrumb"),
        F.col("rules").isNotNull().alias("has_profile"),
        signature(F.col("doc")).alias("signature"),
    )
