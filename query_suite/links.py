"""Link resolution, discovery, profile matching and exclusion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from query_suite.registry import LISTING_SIGNATURE, PAGED_SQL, Tables, query
from webcatalog.functions.basics import explode_rows
from webcatalog.functions.urls import abs_url, domain_of, split_url, url_host, url_scheme
from webcatalog.operators import discover as D
from webcatalog.operators import profiles as PR
from webcatalog.operators import robots as R
from webcatalog.operators.pages import with_documents
from webcatalog.schemas import PROFILE_DDL
from webcatalog.sources.local import local_table
from webcatalog.sources.readers import read_pages


def _matched(t: Tables, pages: DataFrame) -> DataFrame:
    documents = with_documents(pages.select("page_id", "url", "kind", "seq", "source_category", "html"))
    return PR.match_profiles(documents, t.profiles(), PR.template_for(F.col("kind")))


@query(
    "resolve_links",
    """SELECT page_id, regexp_extract(url, '^https?://[^/?#]+', 0) || replace(href, '&amp;', '&') AS link
       FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""",
)
def resolve_links(t: Tables) -> DataFrame:
    docs = with_documents(read_pages(t.spark, t.path("pages")).select("page_id", "url", "html"))
    anchors = F.filter("doc.elems", lambda e: e["tag"] == "a")
    hrefs = docs.select(
        "page_id", "url", F.transform(anchors, lambda e: F.try_element_at(e["attrs"], F.lit("href"))).alias("hrefs")
    )
    rows = explode_rows(hrefs, ["page_id", "url"], "hrefs", "pos", "href")
    return rows.select("page_id", abs_url(F.col("href"), split_url(F.col("url"))).alias("link"))


@query(
    "next_pages",
    f"""WITH {PAGED_SQL}
       SELECT DISTINCT page_id, 'https://shop.example.com/catalog/' || slug || '?p=' || (page + 1) AS url
       FROM places WHERE page < last_page
       UNION ALL SELECT DISTINCT card_id, 'http://www.cards.example.org/list/' || slug || '/page-' || (page + 1) || '.html'
       FROM places WHERE page < last_page""",
)
def next_pages(t: Tables) -> DataFrame:
    columns = ["page_id", "url", "kind", "seq", "source_category", "html"]
    pages = t.listings().select(*columns).unionByName(t.cards().select(*columns))
    return D.find_next_pages(_matched(t, pages)).select("page_id", "url")


@query(
    "discover_products",
    f"""WITH {PAGED_SQL}
       SELECT page_id, 'https://shop.example.com/product/' || p_partkey AS url FROM places
       UNION ALL SELECT card_id, 'http://www.cards.example.org/list/product/' || p_partkey FROM places""",
)
def discover_products(t: Tables) -> DataFrame:
    # The card pages go through the generic layers only, which exercises the anchor fallback.
    listed = D.with_links(_matched(t, t.listings()), next_pages=False).select("page_id", "product_urls")
    cards = D.with_links(with_documents(t.cards().select("page_id", "url", "html")), next_pages=False)
    both = listed.unionByName(cards.select("page_id", "product_urls"))
    return explode_rows(both, ["page_id"], "product_urls", "pos", "url").select("page_id", "url")


@query(
    "discover_subcategories",
    f"""WITH {PAGED_SQL}
       SELECT DISTINCT page_id, 'https://shop.example.com/catalog/' || slug || '/' || lower(p_type) AS url, p_type AS name
       FROM places""",
)
def discover_subcategories(t: Tables) -> DataFrame:
    links = D.discover_links(_matched(t, t.listings()))
    return links.where("kind = 'subcategory'").select("page_id", "url", "name")


@query(
    "breadcrumbs",
    f"""WITH {PAGED_SQL}
       SELECT DISTINCT page_id, 'Home > ' || p_brand AS breadcrumb FROM places
       UNION ALL SELECT p_partkey * 10 + 3, 'Home > ' || p_type FROM part""",
)
def breadcrumbs(t: Tables) -> DataFrame:
    pages = t.listings().select("page_id", "html").unionByName(t.details().select("page_id", "html"))
    docs = with_documents(pages)
    return docs.select("page_id", F.array_join(D.breadcrumb(F.col("doc")), " > ").alias("breadcrumb"))


@query(
    "discover_summary",
    f"""WITH {PAGED_SQL}
       SELECT page_id, CAST(count(*) AS BIGINT) AS products_found,
         CAST(count(DISTINCT p_type) AS BIGINT) AS subcategories_found,
         'Home > ' || min(p_brand) AS breadcrumb, true AS has_profile, {LISTING_SIGNATURE} AS signature
       FROM places GROUP BY page_id""",
)
def discover_summary(t: Tables) -> DataFrame:
    s = D.discover_summary(_matched(t, t.listings()))
    return s.select(
        "page_id", F.col("products_found").cast("long").alias("products_found"),
        F.col("subcategories_found").cast("long").alias("subcategories_found"),
        "breadcrumb", "has_profile", "signature",
    )


def _site_profiles(t: Tables) -> DataFrame:
    """Profiles for the sites in ``pages``: some own a listing template, some have globs only."""
    sites = t.read("pages").select(domain_of(F.col("url")).alias("site")).distinct()
    n = F.length("site")
    rows = F.array(
        F.when(n % 3 == 0, F.struct(F.lit("catalog-listing").alias("template"), F.lit("/never/*").alias("url_glob"))),
        F.when(n % 3 == 1, F.struct(F.lit("english").alias("template"), F.lit("/en/*").alias("url_glob"))),
        F.when(n % 3 == 1, F.struct(F.lit("dotted").alias("template"), F.lit("/??/*.html").alias("url_glob"))),
        F.when(n % 5 == 0, F.struct(F.lit("any").alias("template"), F.lit(None).cast("string").alias("url_glob"))),
    )
    chosen = sites.select("site", F.inline(F.array_compact(rows)))
    empty = local_table(t.spark, [], PROFILE_DDL)
    return empty.unionByName(chosen, allowMissingColumns=True)


@query(
    "match_profiles",
    r"""WITH split AS (
         SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') AS domain,
           regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
       SELECT page_id, domain, CASE
         WHEN length(domain) % 3 = 0 THEN 'catalog-listing'
         WHEN length(domain) % 3 = 1 AND regexp_full_match(path, '/../.*\.html') THEN 'dotted'
         WHEN length(domain) % 3 = 1 AND path LIKE '/en/%' THEN 'english'
         WHEN length(domain) % 5 = 0 THEN 'any' END AS template FROM split""",
)
def match_profiles(t: Tables) -> DataFrame:
    compiled = PR.compile_profiles(_site_profiles(t))
    return PR.match_templates(t.read("pages"), compiled, F.lit("catalog-listing")).select(
        "page_id", "domain", "template"
    )


@query(
    "profile_expiry",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true
         WHEN 2 THEN p_size * 24 < 240 ELSE false END AS expired FROM part""",
)
def profile_expiry(t: Tables) -> DataFrame:
    validated = F.element_at(
        F.array(F.lit(None), F.lit("soon"), F.lit("2024-01-01T00:00:00+00:00"), F.lit("2024-01-10T23:30:00.5+00:00")),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    rows = t.part.select("p_partkey", validated.alias("last_validated"), (F.col("p_size") * 24).alias("ttl_hours"))
    as_of = F.lit("2024-01-11T00:00:00Z").cast("timestamp")
    return PR.expired_profiles(rows, as_of).select("p_partkey", "expired")


@query(
    "resolve_source",
    """SELECT CASE WHEN s_suppkey % 7 = 3 THEN 'api' ELSE 'html' END AS backend,
         'shop' || (s_suppkey % 7) || '.example.com' AS domain
       FROM supplier WHERE s_suppkey % 7 IN (3, 5) AND s_acctbal > 0 ORDER BY s_suppkey LIMIT 1""",
)
def resolve_source(t: Tables) -> DataFrame:
    seeds = t.read("supplier").where("s_acctbal > 0").select(
        F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"),
        F.concat(F.lit("https://www.shop"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".example.com/c")).alias("url"),
    )
    recipes = local_table(
        t.spark,
        [("shop3.example.com", "api", {"category_id": "9"}), ("shop5.example.com", "html", {}),
         ("shop1.example.com", None, {})],
        "domain string, backend string, params map<string, string>",
    )
    return PR.resolve_source(seeds, recipes).select("backend", "domain")


def _robots(t: Tables) -> DataFrame:
    """A robots body per host of ``pages``, by the length of the host name."""
    url = F.col("url")
    host = F.concat(url_scheme(url), F.lit("://"), url_host(url))
    n = F.length("host")
    body = (
        F.when(n % 4 == 0, "User-agent: *\nDisallow: /en/ # english\nAllow: /\n")
        .when(n % 4 == 1, "User-agent: webcatalog\nCrawl-delay: 2\nDisallow:\n\nUser-agent: *\nDisallow: /\n")
        .when(n % 4 == 2, "User-agent: *\nAllow: /fr/\nDisallow: /*\nDisallow: /%66\nDisallow: /de/9\nDisallow: /search?q=\n")
        .otherwise("User-agent: other\nDisallow: /\n")
    )
    hosts = t.read("pages").select(host.alias("host")).distinct()
    return hosts.select("host", F.when(n % 5 == 0, 404).otherwise(200).alias("status"), body.alias("body"))


@query(
    "robots_filter",
    r"""WITH split AS (
         SELECT page_id, length(regexp_extract(url, '^https?://[^/?#]*', 0)) AS n,
           regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages)
       SELECT page_id FROM split WHERE n % 5 = 0 OR n % 4 = 1 OR n % 4 = 3
         OR (n % 4 = 0 AND path NOT LIKE '/en/%')
         OR (n % 4 = 2 AND (path LIKE '/fr/%' OR NOT (path LIKE '/f%' OR path LIKE '/de/9%')))""",
)
def robots_filter(t: Tables) -> DataFrame:
    rules = R.robots_rules(_robots(t), "webcatalog/0.1")
    return R.robots_filter(t.read("pages").select("page_id", "url"), rules).select("page_id")


@query(
    "crawl_delays",
    r"""SELECT DISTINCT host, CASE WHEN length(host) % 4 = 1 AND length(host) % 5 <> 0 THEN 2.0::DOUBLE END AS delay
       FROM (SELECT regexp_extract(url, '^https?://[^/?#]*', 0) AS host FROM pages)""",
)
def crawl_delays(t: Tables) -> DataFrame:
    return R.crawl_delays(t.read("pages"), R.robots_rules(_robots(t), "webcatalog/0.1"))
