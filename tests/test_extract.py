"""Extraction, discovery and normalisation rules on small pages."""

import json

import pytest
from pyspark.sql import functions as F

from webcatalog.fixtures import _rule
from webcatalog.operators import discover as D
from webcatalog.operators import extract as X
from webcatalog.operators import normalize as N
from webcatalog.operators.pages import with_documents
from webcatalog.operators.profiles import compile_profiles, glob_to_regex, match_templates
from webcatalog.schemas import PROFILE_DDL
from webcatalog.sources.local import local_table


def profile(spark, fields, cardinality="many", item_selector=None, discovery=None, **more):
    base = dict(site="x.org", template="t", cardinality=cardinality, url_glob=None, item_selector=item_selector,
                discovery=discovery or {}, fields=fields, template_signature=None, last_validated=None, ttl_hours=1,
                field_confidence={}, version=1, authored_by="hand")
    return tuple({**base, **more}.values())


def matched(spark, pages, *profiles):
    compiled = compile_profiles(local_table(spark, list(profiles), PROFILE_DDL))
    documents = with_documents(pages)
    return match_templates(documents, compiled, F.lit("t")).join(compiled, ["domain", "template"], "left")


def records(spark, pages, *profiles):
    rows = X.extract_records(matched(spark, pages, *profiles)).select(
        "page_id", "rec_no", "tier", F.to_json("fields", {"ignoreNullFields": "false"}).alias("j")
    )
    return [(r.page_id, r.tier, json.loads(r.j)) for r in rows.orderBy("page_id", "rec_no").collect()]


def ld(data):
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


def node(path):
    return _rule(source="jsonld", path=path)


def css(selector, attr=None, **more):
    return _rule(source="css", selector=selector, attr=attr, **more)


def test_jsonld_nodes_merge_by_id_sku_name(spark, pages_of):
    p = lambda **k: {"@type": "Product", **k}
    html = ld([p(sku="1", name="a"), {"x": [p(sku="1", name="b")]}, p(name="c"), p(), p(), p(**{"@id": "", "sku": 0, "name": "c"})])
    got = records(spark, pages_of(("http://x.org/", html)), profile(spark, {"name": node("Product.name")}))
    assert [f["name"] for _, _, f in got] == ["a", "c", None, None]
    assert got[0][2]["product_url"] == "http://x.org/" and got[0][1] == "jsonld"


def test_jsonld_path_takes_first_of_inner_lists(spark, pages_of):
    html = ld({"@type": ["Thing", "Product"], "offers": [{"price": "5", "tags": [1, 2]}, {"price": "6"}], "b": {"n": 1.50},
               "empty": [], "nil": None})
    rules = {"p": node("product.offers.price"), "t": node("offers.tags"), "n": node("b.n"), "e": node("empty.x"),
             "s": node("b.n.z"), "z": node("nil"), "m": node("Product.missing.x"), "product_url": node("url")}
    (got,) = records(spark, pages_of(("http://x.org/", html)), profile(spark, rules))
    assert got[2] == {"p": "5", "t": [1, 2], "n": 1.5, "e": None, "s": None, "z": None, "m": None, "product_url": None}


def test_css_items_are_read_relative_to_each_item(spark, pages_of):
    html = "".join(
        f'<article class="pod"><h3><a href="/{i}" title="N{i}">x</a></h3><p class="price">£{i}.50</p></article>' for i in (1, 2)
    )
    fields = {"name": css("h3 a", "@title"), "price": css("p.price"), "far": node("Product.name"), "none": css("em"),
              "code": _rule(source="regex", pattern=r"£(\d)"), "default": _rule(selector="a", attr="@href")}
    got = records(spark, pages_of(("http://x.org/", html)), profile(spark, fields, item_selector="article.pod"))
    assert [(f["name"], f["price"], f["code"], f["default"], f["far"], f["none"]) for _, _, f in got] == [
        ("N1", "£1.50", "1", "/1", None, None), ("N2", "£2.50", "2", "/2", None, None),
    ]
    assert got[0][1] == "mixed"


def test_rule_families(spark, pages_of):
    html = (
        "<ul><li><strong>Brand:</strong> Acme – </li><li><strong>Tip</strong> use it</li><li><strong>Brand:</strong> Last</li>"
        "<li>plain</li></ul><table><tr><th>K:</th><td></td></tr><tr><th>K2</th><td>v</td></tr><tr><td>only</td></tr></table>"
        "<a class='r' href='/1'>One</a><a class='r'></a><i></i><i>x</i>"
    )
    fields = {
        "labels": css("li", label="strong"), "colon": css("li", label="strong", require_colon=True), "kv": css("tr", kv=["th", "td"]),
        "subs": css("a.r", fields={"n": "@text", "u": "@href"}), "nested": css("table", fields={"h": "th", "none": "em"}),
        "all": css("i", all=True), "one": css("i"), "nokv": css("p", kv=["a", "b"]), "rx": _rule(source="regex", pattern=r"USE\s(it)"),
        "both": css("li", label="strong", kv=["a", "b"], all=True), "none": _rule(source="other"), "empty": css(None),
    }
    (got,) = records(spark, pages_of(("http://x.org/", html)), profile(spark, fields, "one"))
    f = got[2]
    assert f["labels"] == {"Brand": "Last", "Tip": "use it"} and f["colon"] == {"Brand": "Last"} and f["both"] == f["labels"]
    assert f["kv"] == {"K": "", "K2": "v"} and f["nokv"] is None
    assert f["subs"] == [{"n": "One", "u": "/1"}] and f["nested"] == [{"h": "K:", "none": None}]
    assert f["all"] == [None, "x"] and f["one"] is None and f["rx"] == "it" and f["none"] is None and f["empty"] is None


def test_notes_and_pages_without_profile(spark, pages_of):
    pages = pages_of(("http://x.org/", "<p>"), ("http://other.org/", "<p>"))
    none, item = profile(spark, {"a": css("a:hover")}), profile(spark, {}, item_selector="b")
    notes = lambda p: sorted(r.note for r in X.extraction_notes(matched(spark, pages, p)).collect())
    assert notes(none) == ["no Product nodes and no item_selector for 'many' profile", "unsupported selector: a:hover"]
    assert notes(item) == ["item_selector 'b' matched nothing"]
    assert records(spark, pages, profile(spark, {"n": css("p")}, "one"))[0][0] == 0


@pytest.mark.parametrize("glob, path, hit", [
    ("/catalog/*", "/catalog/a/b", True), ("/catalog/*", "/Catalog/a", False), ("/a?c", "/abc", True), ("/x[0-9].html", "/x5.html", True),
    ("/x[!0-9]", "/x5", False), ("/a.b", "/acb", False), ("/[", "/[", True), ("*", "", True), ("/p/*", "/p/\n", True),
    ("/a+(b)|c", "/a+(b)|c", True), ("/[&&]x", "/&x", True),
])
def test_globs(spark, glob, path, hit):
    found = spark.createDataFrame([(path, glob_to_regex(glob))], "p string, g string")
    assert found.select(F.regexp_like("p", F.col("g")).alias("x")).first().x is hit


def test_longest_glob_then_name_breaks_ties(spark, pages_of):
    globs = {"b": "/long/*", "a": "/long/*", "short": "/*", "any": None}
    profiles = [profile(spark, {}, template=t, url_glob=g) for t, g in globs.items()]
    compiled = compile_profiles(local_table(spark, profiles, PROFILE_DDL))
    pages = pages_of(("http://www.x.org/long/1", ""), ("http://x.org/1", ""), ("http://y.org/", ""))
    got = match_templates(pages, compiled, F.lit("absent")).orderBy("page_id").collect()
    assert [r.template for r in got] == ["a", "short", None]


NEXT = [
    ('<a rel="prev next" href="?p=2">x</a>', ["http://h.org/list?p=2"]), ('<link rel=NEXT href="/list?z=9">', ["http://h.org/list?z=9"]),
    ('<a href="?start=2">2</a>', ["http://h.org/list?start=2"]), ('<a href="?start=3">3</a>', []), ("<a href='/more'>Next ›</a>", []),
    ("<a href='/more'> Load More </a>", ["http://h.org/more"]), ("<a href='/m' aria-label='Next'></a>", ["http://h.org/m"]),
    ("<a href='/m' class='btn-Next'>go</a>", ["http://h.org/m"]), ("<a href='/list/page-2.html'>2</a>", ["http://h.org/list/page-2.html"]),
    ("<a href='/x/p/2'>2</a>", ["http://h.org/x/p/2"]), ("<a href='http://other.org/?p=2' rel=next>2</a>", []),
    ("<a rel=next href='#top'>n</a>", []), ("<a rel=next href='mailto:a@b'>n</a>", []), ("<a rel=next>n</a>", []),
    ('<a href="?id=2">i</a><a rel="next" href="?q=5">n</a><a href="?id=2">i</a>', ["http://h.org/list?q=5", "http://h.org/list?id=2"]),
    ("<a href='?p=2&amp;s=a'>2</a>", ["http://h.org/list?p=2&s=a"]), ("<span class=next><a href='/n'>on</a></span>", []),
]


def test_next_pages(spark, pages_of):
    pages = pages_of(*[("http://h.org/list", html) for html, _ in NEXT])
    rows = D.find_next_pages(with_documents(pages)).orderBy("page_id", "pos").collect()
    for i, (html, expected) in enumerate(NEXT):
        assert [r.url for r in rows if r.page_id == i] == expected, html
    second = pages_of(("http://h.org/list?p=2&x=7", '<a href="?p=3&x=7">3</a><a href="?p=1">1</a><a href="?x=8&p=2">8</a>'))
    assert [r.url for r in D.find_next_pages(with_documents(second)).orderBy("pos").collect()] == [
        "http://h.org/list?p=3&x=7", "http://h.org/list?x=8&p=2",
    ]


def test_discovery_layers(spark, pages_of):
    listed = ld({"@type": "ItemList", "name": "x", "itemListElement": [
        {"url": "/p/1", "item": {"@type": "Product"}}, {"item": {"@type": ["Product"], "offers": [{"url": "/p/2"}]}},
        {"item": {"@type": "Product", "url": "/p/1"}}, {"item": {"@type": "CollectionPage", "name": "Sub", "url": "/c/1"}},
        {"item": {"@type": "Other", "url": "/o"}}, "text", {"item": 5}]})
    named = ld({"@type": "ItemList", "name": "All Products", "itemListElement": [{"item": {"@type": "CollectionPage", "url": "/n"}}]})
    crumbs = ld([{"@type": "BreadcrumbList", "itemListElement": [{"name": "A"}, {"item": {"name": "no"}}, {"name": "B"}]},
                 {"@type": "BreadcrumbList", "itemListElement": []}])
    anchors = "<a href='/product/9'>9</a><a href='https://far.org/product/8'>8</a><a href='/x'>x</a>"
    pages = pages_of(("http://h.org/a", listed + named + crumbs + anchors), ("http://h.org/b", anchors))
    links = D.discover_links(with_documents(pages)).orderBy("page_id", "kind", "pos").collect()
    of = lambda page, kind: [(r.url, r.name) for r in links if r.page_id == page and r.kind == kind]
    assert [u for u, _ in of(0, "product")] == ["http://h.org/p/1", "http://h.org/p/2", "http://h.org/n"]
    assert of(0, "subcategory") == [("http://h.org/c/1", "Sub")]
    assert [n for _, n in of(0, "breadcrumb")] == ["A", "B"]
    assert [u for u, _ in of(1, "product")] == ["http://h.org/product/9", "https://far.org/product/8"]


def raw(spark, *objects, page_url="http://h.org/dir/page"):
    rows = [(i, page_url, "Cat", "css", json.dumps(o)) for i, o in enumerate(objects)]
    frame = spark.createDataFrame(rows, "rec_no int, page_url string, source_category string, tier string, j string")
    return frame.withColumn("fields", F.try_variant_get(F.try_parse_json("j"), "$", "map<string, variant>")).drop("j")


def test_normalize_full_record(spark):
    record = {
        "name": "  Glove ", "sku": " ab1 ", "brand": " ", "price": "8.49", "availability": "http://schema.org/InStock",
        "image_urls": "i.png", "product_url": "../p/1", "category": "A / B", "rating": 4.5, "currency": "",
        "specifications": {"Size": 5, "Null": None, "Yes": True}, "description": "d",
        "variants": [{"sku": "v", "pack": "10", "price": "2,5"}, {"pack_size": "3", "availability": "SoldOut"}, "no"],
        "alternatives": [{"name": " ", "url": "/x"}, {"name": "n", "sku": "s"}],
    }
    p = N.valid(N.normalize(raw(spark, record))).first()
    assert (p.name, p.sku, p.item_number, p.brand, p.price, p.rating, p.currency) == ("Glove", "ab1", " ab1 ", None, 8.49, 4.5, "USD")
    assert p.dedup_key == "AB1" and p.product_url == "http://h.org/p/1" and p.image_urls == ["http://h.org/dir/i.png"]
    assert p.specifications == {"Size": "5", "Null": "None", "Yes": "True"} and p.category_path == ["A", "B"]
    assert [tuple(v) for v in p.variants] == [("v", "10", 25.0, "unknown"), (None, "3", None, "out_of_stock")]
    assert [tuple(a) for a in p.alternatives] == [(None, "http://h.org/x", None), ("n", None, "s")]


def test_normalize_rejects_and_quarantines(spark):
    bad = [{}, {"name": " "}, {"name": 0}, {"name": "n", "sku": 5}, {"name": "n", "currency": 1}, {"name": "n", "variants": [{"sku": 1}]},
           {"name": "n", "image_urls": [{"url": "u"}]}, {"name": 7}, {"name": "n", "image_urls": [None, ""]}]
    got = [r.reason for r in N.normalize(raw(spark, *bad)).orderBy("rec_no").collect()]
    assert got == ["record has no product name"] * 3 + ["type:sku", "type:currency", "type:variants",
                                                        "type:image_urls", None, None]


def test_coverage_counts_unknown_availability_unless_strict(spark):
    full = {"name": "n", "sku": "s", "brand": "b", "price": 0, "availability": "InStock", "description": "d", "image_urls": ["i"], "category": "c"}
    products = N.valid(N.normalize(raw(spark, full, {"name": "n"}).withColumn("source_category", F.lit(None).cast("string"))))
    score = lambda strict: [r.coverage for r in N.with_coverage(products, strict).orderBy("rec_no").collect()]
    assert score(False) == [1.0, 0.25] and score(True) == [1.0, 0.125]


def test_profiles_are_scored_without_a_step_for_regex_rules(spark):
    from query_suite import QUERIES

    scored = QUERIES["evaluate_profiles"](spark, "/root/testdata/sf0.001")
    assert "_regex_values" not in scored._jdf.queryExecution().optimizedPlan().toString()
