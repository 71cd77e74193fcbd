"""Keyed merges, enrichment, API paging and reports."""

import json

from pyspark.sql import functions as F

from webcatalog import fixtures
from webcatalog.operators import api as A
from webcatalog.operators import changes as C
from webcatalog.operators import enrich as E
from webcatalog.operators import report as R
from webcatalog.operators import robots as RB
from webcatalog.operators import state as S
from webcatalog.operators.pages import with_documents


def table(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_upsert_takes_the_whole_last_row_and_is_idempotent(spark):
    ddl = "dedup_key string, name string, brand string, seq int"
    batch = table(spark, ddl, ("a", "one", "x", 1), ("a", "two", None, 2), ("b", "b", "y", 1))
    first = S.upsert_products(None, batch, "seq").select("dedup_key", "name", "brand")
    assert rows(first, "dedup_key") == [("a", "two", None), ("b", "b", "y")]
    again = S.upsert_products(first, batch.repartition(3), "seq")
    assert rows(again, "dedup_key") == rows(first, "dedup_key")
    later = S.upsert_products(first, table(spark, ddl, ("b", "new", None, -5)), "seq")
    assert rows(later, "dedup_key") == [("a", "two", None), ("b", "new", None)]


def test_frontier_life(spark):
    seeds = table(spark, "seq long, name string, url string", (1, "A", "u1"), (2, "B", "u1"), (3, "C", "u2"))
    at = F.lit("2024-01-01").cast("timestamp")
    frontier = S.seed_frontier(seeds, at)
    assert [(r.url, r.source_category, r.attempts) for r in frontier.orderBy("seq").collect()] == [("u1", "A", 0), ("u2", "C", 0)]
    more = table(spark, "url string, kind string, source_category string, seq long", ("u2", "product", "Z", 9), ("u3", "product", "Z", 10))
    frontier = S.enqueue(frontier, more.withColumn("at", at))
    outcomes = table(spark, "url string, status string, seq long", ("u1", "failed", 1), ("u1", "done", 2)).withColumn("at", at)
    frontier = S.mark(frontier, outcomes)
    assert rows(frontier.select("url", "kind", "status", "attempts"), "url") == [
        ("u1", "category", "done", 2), ("u2", "category", "pending", 0), ("u3", "product", "pending", 0),
    ]
    assert [r.url for r in S.cap_products(frontier, 5).collect()] == ["u3"] and S.cap_products(frontier, None).count() == 1
    failures = table(spark, "url string, error string, attempts int, seq long", ("u3", "e1", 1, 1), ("u3", "e2", 2, 2)).withColumn("failed_at", at)
    marked, letters = S.fail(frontier, None, failures)
    assert rows(letters.select("url", "error", "attempts"), "url") == [("u3", "e2", 2)]
    assert marked.where("url = 'u3'").first().status == "failed" and S.reset_frontier(marked).count() == 0


def test_help_keeps_its_resolved_mark(spark):
    ddl = "url string, reason string, suggested_action string, requested_at timestamp, seq long"
    state = S.request_help(None, table(spark, ddl, ("a", "r", "x", None, 1))).withColumn("resolved", F.lit(True))
    state = S.request_help(state, table(spark, ddl, ("a", "r2", "x", None, 2), ("b", "r", "x", None, 3)))
    assert rows(state.select("url", "reason", "resolved"), "url") == [("a", "r2", True), ("b", "r", False)]
    assert [r.url for r in S.help_queue(state).collect()] == ["b"]


def _products(spark, *items):
    base = dict(dedup_key="k", name="n", sku=None, brand=None, description=None, specifications={}, image_urls=[],
                alternatives=[], extraction_tier="jsonld", page_id=1, rec_no=0, seq=0)
    ddl = ("dedup_key string, name string, sku string, brand string, description string, specifications map<string,string>,"
           " image_urls array<string>, alternatives array<struct<name: string, url: string, sku: string>>, extraction_tier string,"
           " page_id long, rec_no int, seq int")  # fmt: skip
    return spark.createDataFrame([tuple({**base, **i}.values()) for i in items], ddl)


def test_enrichment_never_degrades(spark):
    listing = _products(spark, dict(description="abc", image_urls=["1"], specifications={"a": "1"}), dict(dedup_key="z"))
    details = _products(
        spark, dict(seq=1, description="four", specifications={"b": "2"}), dict(seq=2, description="FOUR", image_urls=["x"]),
        dict(seq=3, description="no", specifications={}), dict(dedup_key="absent", description="q"),
    )
    got = {r.dedup_key: r for r in E.enrich_products(listing, details, "seq").collect()}
    k = got["k"]
    assert (k.description, k.specifications, k.image_urls, k.extraction_tier) == ("four", {"b": "2"}, ["1"], "mixed")
    assert got["z"].extraction_tier == "jsonld" and set(got) == {"k", "z"}
    same = E.enrich_products(listing, _products(spark, dict(description="abc", image_urls=["2"])), "seq")
    assert {r.extraction_tier for r in same.collect()} == {"jsonld"}


def test_gap_fill_key_quirks(spark):
    drafts = _products(spark, dict(sku="S1", name="One"), dict(name="Two", rec_no=1), dict(page_id=2, sku="Q", name="THREE", brand="own"))
    candidates = _products(
        spark, dict(sku="s1", name="x", brand="by-sku", rec_no=0), dict(name="lone", brand="first", rec_no=1),
        dict(name="other", brand="last", rec_no=2), dict(page_id=2, sku="T", name="three", brand="b", description="d"),
        dict(page_id=3, sku="N", name="new", dedup_key="n3"),
    )
    got = E.gap_fill(drafts, candidates).orderBy("page_id", "rec_no").collect()
    # A draft without SKU takes the last candidate without one, before its name is tried.
    assert [(r.page_id, r.brand, r.description, r.extraction_tier) for r in got] == [
        (1, "by-sku", None, "mixed"), (1, "last", None, "mixed"), (2, "own", "d", "mixed"), (3, None, None, "jsonld"),
    ]


def test_ungrounded_values_are_dropped(spark, pages_of):
    pages = with_documents(pages_of(("http://x.org/1", "<header>ZZZ-NOPE</header><h1>Real Widget</h1><p>ab 10 mm")))
    text = json.dumps([{"name": "real widget", "brand": "GhostBrand", "sku": "ZZZ-NOPE", "price": "9.5", "description": "ab",
                        "specifications": {"w": "10 mm", "x": "20 mm"}}, {"name": "Ghost"}, 5])
    responses = table(spark, "url string, text string", ("http://x.org/1", f"Sure: {text}"), ("http://x.org/1", "none"))
    (p,) = E.ingest_responses(responses, pages).collect()
    assert (p.name, p.brand, p.sku, p.price, p.description, p.specifications) == ("real widget", None, None, 9.5, "ab", {"w": "10 mm"})
    assert p.product_url == "http://x.org/1" and p.extraction_tier == "llm" and p.source_category == "Cat"


def _responses(spark, *pages):
    ddl = "page_url string, category_id string, source_category string, api_page int, body string"
    return table(spark, ddl, *[("u", "1", "Cat", n, b if isinstance(b, str) else json.dumps(b)) for n, b in pages])


def test_api_paging_stops(spark):
    hit = lambda n: {"name": n}
    names = lambda *p: [n for (n,) in rows(A.explode_hits(_responses(spark, *p)).select(A.hit_text("name").alias("n")), "n")]
    assert names((0, {"hits": [hit("a")], "nbPages": 3}), (1, {"hits": []}), (2, {"hits": [hit("c")], "nbPages": 3})) == ["a"]
    assert names((0, {"hits": [hit("a")]}), (1, {"hits": [hit("b")], "nbPages": 2})) == ["a"]
    assert names((0, {"hits": [hit("a")], "nbPages": 2}), (1, {"hits": [hit("b")], "nbPages": 2}), (2, {"hits": [hit("c")]})) == ["a", "b"]
    assert names((0, "not json"), (1, {"hits": [hit("b")], "nbPages": 2})) == []


def test_api_hits_to_products(spark):
    hits = [
        {"name": "A", "sku": ["P", "1-2", "12"], "price": {"USD": {"default": 9.99}}, "thumbnail_url": "t", "visibility_catalog": True,
         "categories_without_path": ["X", "Y"], "in_stock": 1, "url": "http://h/p"},
        {"name": "B", "sku": "solo", "price": 5, "image_url": "", "visibility_catalog": 1, "stock_status_label": "Sold Out"},
        {"name": "C", "visibility_catalog": 0}, {"name": "D", "visibility_catalog": "1"},
    ]
    raw = A.map_hits(A.visible_hits(A.explode_hits(_responses(spark, (0, {"hits": hits})))))
    from webcatalog.operators.normalize import normalize, valid

    a, b = valid(normalize(raw)).orderBy("name").collect()
    assert (a.sku, a.price, a.image_urls, a.category_path, a.availability) == ("P", 9.99, ["t"], ["X", "Y"], "in_stock")
    assert [v.sku for v in a.variants] == ["1-2"] and a.product_url == "http://h/p"
    assert (b.sku, b.price, b.image_urls, b.category_path, b.availability, b.variants) == ("solo", None, [], ["Cat"], "out_of_stock", [])


def test_record_arrays_and_best_api(spark):
    deep = {"results": [{"nbHits": 40, "hits": [{"objectName": 1, "SKU": 2, "x": 3}]}, {"total": True, "hits": [{"title": 1}]}]}
    flat = {"count": 900, "list": [{"price": 1}, {"name": 1}]}
    scoped = '{"facetFilters":"categories.level1"}'
    ddl = "page_url string, capture_no int, endpoint string, method string, post_data string, body string"
    captured = table(
        spark, ddl, ("p", 0, "e?x=1", "POST", None, json.dumps(flat)), ("p", 1, "e?x=2", "POST", scoped, json.dumps(flat)),
        ("p", 2, "d", "POST", scoped, json.dumps(deep)), ("q", 0, "e", "GET", None, "[["), ("q", 1, "e", "GET", None, "[" * 5000),
    )
    found = A.find_record_arrays(captured)
    assert rows(found.select("capture_no", "path", "n_records", "total", "category_scoped"), "capture_no") == [
        (0, "list", 2, 900, False), (1, "list", 2, 900, True), (2, "results.0.hits", 1, 40, True),
    ]
    best = A.best_product_api(found).collect()
    assert [(r.page_url, r.endpoint, r.total) for r in best] == [("p", "d", 40)]


def test_completeness(spark):
    html = ["<p>100 products</p>", "<p>100 Products found</p>", "no count", "1,234 items", "5 items", "10 <b>items</b>"]
    pages = table(spark, "url string, html string", *[(str(i), h) for i, h in enumerate(html)])
    got = table(spark, "url string, extracted long", ("0", 15), ("1", 100), ("2", 9))
    verdicts = rows(R.completeness(pages, got).select("url", "extracted", "expected", "complete", "method"), "url")
    text, unknown = "html:total-text", "unknown"
    assert verdicts == [("0", 15, 100, False, text), ("1", 100, 100, True, text), ("2", 9, None, False, unknown),
                        ("3", 0, 234, False, text), ("4", 0, None, False, unknown), ("5", 0, None, False, unknown)]
    apis = table(spark, "page_url string, endpoint string, total long", ("0", "http://a/q?x", 15), ("1", "e", 0))
    api = {r.url: r for r in R.completeness(pages, got, apis).collect()}
    assert (api["0"].complete, api["0"].method) == (True, "data-api:http://a/q") and api["1"].method == text


def test_robots(spark):
    bodies = table(
        spark, "host string, status int, body string",
        ("http://a", 200, "User-agent: *\nDisallow: /\n\nUser-agent: webcat\nUser-agent: b\nAllow: /p/ok\nDisallow: /p\nCrawl-delay: 3"),
        ("http://b", 200, "User-agent: *\nDisallow:\nDisallow: /x"), ("http://c", 503, "User-agent: *\nDisallow: /"),
    )
    rules = RB.robots_rules(bodies, "webcat/1.0")
    urls = ["http://a/p/ok/1", "http://a/p/no", "http://a", "http://b/x", "http://c/", "http://d/y"]
    frame = table(spark, "url string", *[(u,) for u in urls])
    allowed = [u for (u,) in rows(RB.robots_filter(frame, rules), "url")]
    assert allowed == ["http://a", "http://a/p/ok/1", "http://b/x", "http://c/", "http://d/y"]
    assert {r.host: r.delay for r in RB.crawl_delays(frame, rules).collect()}["http://a"] == 3.0


BODIES = [
    "User-agent: *\nDisallow: /search?q=\nDisallow: /~joe\nDisallow: /caf%C3%A9\nDisallow: /a+b\nDisallow: /100%",
    "User-agent: *\nAllow: /x/y?\nDisallow: /x\nDisallow: /\u00e9t\u00e9 # summer\nCrawl-delay: 5",
    "# c\r\nUSER-AGENT : WebCat\r\nuser-agent: other\r\nDisallow:/p\r\nAllow: /\r\n\r\nUser-agent: *\r\nDisallow: /",
    "Disallow: /early\nUser-agent: web\n\nDisallow: /lost\nUser-agent: *\nUser-agent: webcat\nDisallow: *\nUser-agent: cat\nDisallow: /c\nCrawl-delay: x",
    "User-agent: webcat\nRequest-rate: 1/2\nSitemap: http://s/\nUser-agent: *\nDisallow: /q", "nonsense", "", "User-agent: *\nDisallow: /%7Ejoe/%\nDisallow: /b?#",
    "User-agent: a\nDisallow: /1\n \nUser-agent: *\nDisallow: /2\n\nUser-agent: *\nDisallow: /3",
]
TAILS = ["", "/", "?x=1", "/search?q=1", "/search%3Fq%3D1", "/%7Ejoe/a", "/~joe/a", "/caf\u00e9", "/caf%c3%a9/x", "/a+b", "/a%2Bb", "/100%", "/100%25/x",
         "/x/y?z", "/x/y?", "/x/z", "/%C3%A9t%C3%A9", "/p", "/early", "/lost", "/c/1", "/q#f", "/~joe/%", "/b", "/1", "/2/x", "/3"]


def test_robots_agree_with_the_standard_library(spark):
    import urllib.robotparser

    bodies = table(spark, "host string, status int, body string", *[(f"http://h{i}", 200, b) for i, b in enumerate(BODIES)])
    urls = [f"http://h{i}{t}" for i in range(len(BODIES)) for t in TAILS]
    rules = RB.robots_rules(bodies, "WebCat/1.0")
    got = {r.url: r.allowed for r in RB.with_allowed(table(spark, "url string", *[(u,) for u in urls]), rules).collect()}
    delays = {r.host: r.delay for r in rules.collect()}
    for i, body in enumerate(BODIES):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        for tail in TAILS:
            url = f"http://h{i}{tail}"
            assert got[url] == parser.can_fetch("WebCat/1.0", url), (body, url)
        assert delays[f"http://h{i}"] == parser.crawl_delay("WebCat/1.0")


def test_changes_across_buckets(spark):
    seen = table(spark, "dedup_key string, at string, price double, availability string",
                 ("a", "2024-01-01", 5.0, "in_stock"), ("a", "2024-01-20", 4.0, "in_stock"), ("a", "2024-03-01", 6.0, "in_stock"),
                 ("a", "2024-03-02", 6.0, "in_stock"), ("a", "2024-04-01", 1.0, "out_of_stock"), ("b", "2024-04-01", None, None))
    alerts = C.change_alerts(seen.withColumn("at", F.to_timestamp("at")), order=("at",))
    assert [(r.dedup_key, r.price, r.event) for r in alerts.orderBy("dedup_key", "at").collect()] == [
        ("a", 5.0, "new"), ("a", 4.0, "price_drop"), ("a", 6.0, "price_rise"), ("a", 1.0, "out_of_stock"), ("b", None, "new"),
    ]


def test_empty_catalog_reports(spark, part):
    empty = fixtures.products(part).limit(0)
    assert R.field_coverage(empty).count() == 0
    assert R.catalog_summary(empty).first().total_products == 0


def test_drift_pins_the_first_signature(spark):
    ddl = "domain string, template string, url string, seq long, signature string, template_signature string"
    signed = table(spark, ddl, ("d", "t", "1", 2, "B", None), ("d", "t", "2", 1, "A", None), ("d", "u", "3", 1, "X", "Y"))
    assert rows(R.signature_drift(signed).select("url", "expected", "observed"), "url") == [("1", "A", "B"), ("3", "Y", "X")]


def test_page_texts_are_not_broadcast_for_grounding(spark, pages_of, tmp_path):
    pages_of(("http://s/p", "<p>" + "filler " * 3000 + "Widget</p>")).write.parquet(f"{tmp_path}/pages")
    docs = with_documents(spark.read.parquet(f"{tmp_path}/pages"))  # a small file
    answers = spark.createDataFrame([("http://s/p", '{"name": "Widget", "brand": "Ghost"}')], "url string, text string")
    found = E.ingest_responses(answers, docs).select("name", "brand")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert [tuple(r) for r in found.collect()] == [("Widget", None)]
