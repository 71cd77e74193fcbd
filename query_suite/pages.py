"""Page scans, signatures and text views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from query_suite.registry import (
    CARD_SIGNATURE,
    DETAIL_SIGNATURE,
    LISTING_SIGNATURE,
    PAGED_SQL,
    Tables,
    query,
)
from webcatalog.functions.urls import domain_of, infer_template
from webcatalog.operators import pages as P
from webcatalog.sources.readers import read_pages

# Strings of a page outside script, style, comments, nav and footer, in document order.
_PARTS = """list_filter(list_transform(string_split_regex(
      regexp_replace({html}, '<!--.*?-->|<script.*?</script>|<style.*?</style>{more}', '<x>', 'gs'),
      '<[^>]*>'), lambda s: trim(s)), lambda s: s <> '')"""
_UNESCAPED = (
    "replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'),"
    " '&#x27;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
)
CLEAN_SQL = _UNESCAPED.format(
    "array_to_string(" + _PARTS.format(html="html", more="|<nav>.*?</nav>|<footer>.*?</footer>") + ", chr(10))"
)
HINTS_SQL = (
    "'ul :: ' || substr("
    + _UNESCAPED.format(
        "array_to_string(" + _PARTS.format(html="regexp_extract(html, '<nav>.*?</nav>', 0, 's')", more="") + ", ' ')"
    )
    + ", 1, 60) || chr(10) || 'h1 :: ' || substr("
    + _UNESCAPED.format("trim(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'))")
    + ", 1, 60)"
)


@query(
    "scan_pages",
    "SELECT page_id, url, 200 AS status, CAST(length(html) AS BIGINT) AS html_chars FROM pages",
)
def scan_pages(t: Tables) -> DataFrame:
    pages = read_pages(t.spark, t.path("pages"))
    return pages.select("page_id", "url", "status", F.length("html").cast("long").alias("html_chars"))


@query(
    "domain_counts",
    """SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain,
         CAST(count(*) AS BIGINT) AS pages FROM pages GROUP BY 1""",
)
def domain_counts(t: Tables) -> DataFrame:
    return t.read("pages").groupBy(domain_of(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"))


@query(
    "infer_template",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'product-detail' WHEN 1 THEN 'catalog-listing'
         ELSE 'generic' END AS template FROM part""",
)
def infer_templates(t: Tables) -> DataFrame:
    folder = F.element_at(
        F.array(F.lit("product/"), F.lit("catalog/"), F.lit("x?u=/product/")), (F.col("p_partkey") % 3 + 1).cast("int")
    )
    url = F.concat(F.lit("https://shop.example.com/"), folder, F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", infer_template(url).alias("template"))


@query(
    "blocked_pages",
    """WITH planted AS (
         SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 403 ELSE 200 END AS status,
           CASE WHEN page_id % 7 = 0 THEN '<p>Just a Moment...</p>' ELSE '' END || html AS html FROM pages)
       SELECT page_id, (status IN (401, 403, 429) OR regexp_matches(lower(substr(html, 1, 4000)),
         'just a moment|attention required|cf-browser-verification|cf-chl-|/cdn-cgi/challenge|access denied|enable javascript'))
         AS blocked FROM planted""",
)
def blocked_pages(t: Tables) -> DataFrame:
    planted = t.read("pages").select(
        "page_id", F.when(F.col("page_id") % 10 == 0, 403).otherwise(200).alias("status"),
        F.concat(F.when(F.col("page_id") % 7 == 0, "<p>Just a Moment...</p>").otherwise(""), "html").alias("html"),
    )
    return P.flag_blocked(planted).select("page_id", "blocked")


@query(
    "template_signatures",
    f"""WITH {PAGED_SQL}
       SELECT page_id, url, substr(sha256('{{"blocks": 0, "landmarks": ["html", "head", "body", "nav", "footer"], "types": []}}'), 1, 16)
         AS signature FROM pages
       UNION ALL SELECT DISTINCT page_id, url, {LISTING_SIGNATURE} FROM places
       UNION ALL SELECT DISTINCT card_id, card_url, {CARD_SIGNATURE} FROM places
       UNION ALL SELECT p_partkey * 10 + 3, 'https://shop.example.com/product/' || p_partkey, {DETAIL_SIGNATURE} FROM part""",
)
def template_signatures(t: Tables) -> DataFrame:
    columns = ["page_id", "url", "html"]
    pages = read_pages(t.spark, t.path("pages")).select(*columns)
    for more in (t.listings(), t.cards(), t.details()):
        pages = pages.unionByName(more.select(*columns))
    return P.template_signatures(P.with_documents(pages))


def _documents(t: Tables) -> DataFrame:
    return P.with_documents(read_pages(t.spark, t.path("pages")).select("page_id", "url", "html"))


@query(
    "clean_text",
    f"""SELECT page_id, CAST(length(x) AS BIGINT) AS chars, md5(x) AS text_md5
       FROM (SELECT page_id, substr({CLEAN_SQL}, 1, 6000) AS x FROM pages)""",
)
def clean_text(t: Tables) -> DataFrame:
    return P.clean_texts(_documents(t)).select(
        "page_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5")
    )


@query("structure_hints", f"SELECT page_id, {HINTS_SQL} AS hints FROM pages")
def structure_hints(t: Tables) -> DataFrame:
    return P.structure_hints(_documents(t)).select("page_id", "hints")


@query(
    "prompts",
    f"""SELECT page_id, md5('URL: ' || url || chr(10) || 'Types: (none)' || chr(10) || 'Outline:' || chr(10) || {HINTS_SQL})
       AS prompt_md5 FROM pages""",
)
def prompts(t: Tables) -> DataFrame:
    pages = P.jsonld_sample(_documents(t).withColumn("hints", P.structure_hint(F.col("doc"))))
    types = F.when(F.size("jsonld_types") > 0, F.array_join("jsonld_types", ", "))
    template = "URL: {url}\nTypes: {types}\nOutline:\n{hints}"
    built = P.build_prompts(pages, template, url="url", types=types, hints="hints")
    return built.select("page_id", F.md5("prompt").alias("prompt_md5"))


@query(
    "jsonld_sample",
    f"""WITH {PAGED_SQL}
       SELECT DISTINCT page_id, 'Brand,BreadcrumbList,CollectionPage,ItemList,ListItem,Offer,Product' AS types,
         '[{{"@type": "BreadcrumbList", "itemListElement": [{{"@type": "ListItem", "position": 1, "name": "Home"}}, '
         || crumb || ']}}, {{"@type": "ListItem", "position": 1, "name": "Home"}}, ' || crumb || ']' AS sample
       FROM (SELECT *, '{{"@type": "ListItem", "position": 2, "name": "' || p_brand || '"}}' AS crumb FROM places)""",
)
def jsonld_sample(t: Tables) -> DataFrame:
    docs = P.with_documents(t.listings().select("page_id", "html"))
    return P.jsonld_sample(docs).select(
        "page_id", F.array_join("jsonld_types", ",").alias("types"), F.col("jsonld_sample").alias("sample")
    )


@query(
    "revalidation_sample",
    "SELECT page_id FROM pages WHERE CAST('0x' || substr(md5(url || 'r1'), 1, 6) AS BIGINT) < 3355443",
)
def revalidation_sample(t: Tables) -> DataFrame:
    return P.revalidation_sample(t.read("pages"), 0.2, "r1").select("page_id")
