"""Crawl, catalog jobs, routing, sources and sinks, streams, and the query suite."""

import json
import shutil
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from query_suite import ORACLES, QUERIES
from webcatalog import fixtures
from webcatalog.options import Options
from webcatalog.operators import extract as X
from webcatalog.operators.report import catalog_summary
from webcatalog.operators.profiles import compile_profiles
from webcatalog.plans import catalog as J
from webcatalog.plans import crawl as CR
from webcatalog.sources import html_files, readers, writers
from webcatalog.sources.local import broadcast_if_small, local_table
from webcatalog.streaming import incremental as I

def AT():
    return F.lit("2024-01-01").cast("timestamp")


@pytest.fixture(scope="module")
def listings(part):
    return fixtures.listing_pages(part)


def seeds(spark, *pairs):
    return spark.createDataFrame([(i, n, u) for i, (n, u) in enumerate(pairs)], "seq long, name string, url string")


SHOP = "https://shop.example.com/catalog/"


def _page(url, *links, sub=()):
    anchors = "".join(f'<a rel="next" href="{link}">n</a>' for link in links)
    items = ",".join(
        f'{{"item":{{"@type":"CollectionPage","url":"{u}","name":"{n}"}}}}' for u, n in sub
    )
    block = f'<script type="application/ld+json">{{"@type":"ItemList","itemListElement":[{items}]}}</script>'
    return (SHOP + url, block + anchors)


def crawled(spark, pages, compiled, *starts, **options):
    out = CR.crawl_archive(pages, compiled, seeds(spark, *starts), Options(**options))
    rows = out.orderBy("hop", "place").collect()
    return [(r.url.removeprefix(SHOP), r.hop, r.source_category, r.status) for r in rows]


def test_crawl_chain_cycle_and_missing_page(spark, pages_of, compiled):
    pages = pages_of(_page("a", "b"), _page("b", "c"), _page("c", "a"), _page("x", "gone"), _page("y", "b"))
    start = [("A", SHOP + "a"), ("X", SHOP + "x"), ("Y", SHOP + "y")]
    expected = [("a", 0, "A", "done"), ("x", 0, "X", "done"), ("y", 0, "Y", "done"), ("b", 1, "A", "done"),
                ("gone", 1, "X", "failed"), ("c", 2, "A", "done")]
    assert crawled(spark, pages, compiled, *start, max_pages=None) == expected
    capped = crawled(spark, pages, compiled, *start, max_pages=4)
    assert [u for u, _, _, s in capped if s == "done"] == ["a", "x", "y", "b"]
    assert capped[4:] == [("gone", 1, "X", "pending")]  # b reaches the cap and queues nothing
    assert crawled(spark, pages, compiled, *start, max_pages=0) == [(u, 0, c, "pending") for u, c in (("a", "A"), ("x", "X"), ("y", "Y"))]


def test_crawl_of_an_archive_that_holds_every_page_twice(spark, pages_of, compiled):
    chain = [_page(f"p{i}", f"p{i + 1}") for i in range(200)]
    got = crawled(spark, pages_of(*chain, *chain), compiled, ("A", SHOP + "p0"))
    assert got == [(f"p{i}", i, "A", "done" if i < 200 else "failed") for i in range(201)]


def test_capped_crawl_queues_links_of_visited_pages_only(spark, pages_of, compiled):
    chain = pages_of(*[_page(f"p{i}", f"p{i + 1}") for i in range(5)])
    assert crawled(spark, chain, compiled, ("A", SHOP + "p0"), max_pages=2) == [("p0", 0, "A", "done"), ("p1", 1, "A", "done")]
    wide = pages_of(_page("a", "a2", "a3", sub=[(SHOP + "s", "S")]), _page("a2", "a4"), _page("a3"), _page("s", sub=[(SHOP + "t", "T")]), _page("t"))
    got = crawled(spark, wide, compiled, ("A", SHOP + "a"), ("B", SHOP + "b"), follow_subcategories=True, max_pages=2)
    assert got == [("a", 0, "A", "done"), ("b", 0, "B", "failed"), ("s", 1, "S", "done"), ("a2", 1, "A", "pending"),
                   ("a3", 1, "A", "pending"), ("t", 2, "T", "pending")]


def test_crawl_long_chain_by_doubling_equals_hops(spark, pages_of, compiled):
    chain = [_page(f"p{i}", f"p{i + 1}") for i in range(21)]
    pages = pages_of(*chain)
    links = CR.archive_links(pages, compiled)
    start = seeds(spark, ("A", SHOP + "p0"), ("B", SHOP + "p5")).select(
        "url", F.lit(0).alias("hop"), F.col("seq").alias("place"), F.col("name").alias("source_category")
    )
    by = lambda df: sorted((r.url, r.hop, r.source_category) for r in df.collect())
    assert links.count() == 21
    doubled = by(CR._by_doubling(start, links, None))
    assert doubled == by(CR._by_hop(start, links, None)) and len(doubled) == 22


def test_crawl_branches_in_queue_order(spark, pages_of, compiled):
    pages = pages_of(
        _page("a", "a2", "a3", sub=[(SHOP + "s", "Sub"), (SHOP + "t", "")]), _page("a2", "z"), _page("a3"), _page("s"), _page("t", "z"),
        _page("z"), ("https://elsewhere.org/q", "<p>"), _page("blocked"),
    )
    pages = pages.withColumn("status", F.when(F.col("url").endswith("a3"), 403).otherwise(200))
    got = crawled(spark, pages, compiled, ("A", SHOP + "a"), follow_subcategories=True, max_pages=None)
    assert got == [("a", 0, "A", "done"), ("s", 1, "Sub", "done"), ("t", 1, "A", "done"), ("a2", 1, "A", "done"),
                   ("a3", 1, "A", "failed"), ("z", 2, "A", "done")]
    flat = crawled(spark, pages, compiled, ("A", SHOP + "a"), ("E", "https://elsewhere.org/q"), max_pages=2)
    assert [(u, s) for u, _, _, s in flat if s == "done"] == [("a", "done"), ("a2", "done")]
    assert [u for u, *_ in crawled(spark, pages, compiled, ("A", SHOP + "a"), follow_pagination=False)] == ["a"]


def test_two_listing_pages_make_four_products(spark, pages_of, compiled):
    def listing(page):
        items = [{"@type": "ListItem", "item": {"@type": "Product", "name": f"N{page}{i}", "sku": f"S{page}{i}",
                  "offers": {"@type": "Offer", "price": "1.5", "url": f"/product/{page}{i}"}}} for i in (1, 2)]
        link = '<a rel="next" href="?p=2">n</a>' if page == 1 else ""
        return f'<script type="application/ld+json">{json.dumps({"@type": "ItemList", "itemListElement": items})}</script><main>{link}</main>'

    pages = pages_of((SHOP + "g", listing(1)), (SHOP + "g?p=2", listing(2)))
    for cap, n in ((None, 4), (1, 2)):
        done = CR.crawl_archive(pages, compiled, seeds(spark, ("G", SHOP + "g")), Options(max_pages=cap))
        catalog = J.build_catalog(CR.visited_pages(done, pages), compiled, as_of=AT(), regex=False)
        assert catalog_summary(catalog).first().total_products == n
        assert {r.source_category for r in catalog.collect()} == {"G"}


def test_catalog_does_not_depend_on_partitioning(spark, listings, compiled):
    build = lambda pages: sorted(J.build_catalog(pages, compiled, as_of=AT()).drop("specifications").collect())
    assert build(listings) == build(listings.repartition(5, "url").orderBy(F.desc("url")))


def test_repair_hook_runs_once_and_is_grounded(spark, pages_of, compiled):
    bare = '<script type="application/ld+json">{"@type":"Product","name":"Thing","sku":"A1"}</script><p>Thing, made by Bolt.</p>'
    pages = pages_of(
        (SHOP + "g", bare), (SHOP + "h", "<p>A Lamp without any data</p>"), ("https://nobody.org/x", "<p>A Lamp</p>"),
        (SHOP + "i", "Just a moment..."), (SHOP + "j", "<p>nothing</p>"),
    ).withColumn("source_category", F.lit(None).cast("string"))
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def answer(text):
        asked.add(1)
        if "nothing" in text:
            return "I can't tell"
        name = "Lamp" if "Lamp" in text else "Thing"
        return json.dumps([{"name": name, "sku": "A1" if name == "Thing" else None, "brand": "Bolt", "description": "Invented text"}])

    repaired = J.build_catalog(pages, compiled, as_of=AT(), repair=lambda p: p.select("page_id", answer("page_text").alias("text")))
    rows = {r.name: r for r in repaired.collect()}
    assert asked.value == 3 and set(rows) == {"Thing", "Lamp"}
    assert (rows["Thing"].brand, rows["Thing"].description, rows["Thing"].extraction_tier) == ("Bolt", None, "mixed")
    assert (rows["Lamp"].brand, rows["Lamp"].extraction_tier) == (None, "llm")


def test_detail_pass_runs_regex_rules(spark, pages_of, compiled):
    rules = {"name": {"source": "css", "selector": "h1"}, "sku": {"source": "css", "selector": "b"},
             "description": {"source": "regex", "pattern": "Story: ([^<]+)", "group": 1}}
    table = fixtures.profiles(spark)
    row = table.where("template = 'product-detail'").limit(1)
    blank = {f.name: F.lit(None).cast(f.dataType) for f in table.schema["fields"].dataType.valueType.fields}
    rule = lambda spec: F.struct(*[(F.lit(spec[k]).cast(table.schema["fields"].dataType.valueType[k].dataType) if k in spec else v).alias(k) for k, v in blank.items()])
    fields = F.create_map(*[x for k, spec in rules.items() for x in (F.lit(k), rule(spec))])
    own = compile_profiles(row.withColumn("fields", fields))
    pages = pages_of((SHOP.replace("catalog/", "product/") + "7", "<h1>Thing</h1><b>A7</b><p>Story: long ago</p>"), kind="product")
    found = J.page_records(pages, own, tier="mixed").collect()
    listing = fixtures.products(spark.createDataFrame([(7, "x", "m", "b", "t", 1, "c", 1.0)],
                                "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double"))
    listing = listing.withColumns({"dedup_key": F.lit(found[0].dedup_key), "description": F.lit(None).cast("string")})
    assert J.enrich_from_details(listing, pages, own).first().description == "long ago"


def test_api_products_are_won_by_the_later_queue_entry(spark):
    hit = lambda brand: json.dumps({"nbPages": 1, "hits": [{"name": "N", "sku": ["S1"], "manufacturer_name": brand, "visibility_catalog": 1}]})
    rows = [("u9", "9", "first", 1, 0, hit("early")), ("u2", "2", "second", 2, 0, hit("late"))]
    table = spark.createDataFrame(rows, "page_url string, category_id string, source_category string, seq long, api_page int, body string")
    assert J.build_catalog_api(table, as_of=AT()).first().brand == "late"


def test_blocked_page_is_routed_to_a_person(spark, pages_of, compiled):
    pages = pages_of(("https://x.org/a", "Just a moment..."), status=403)
    routed = J.route_pages(pages, compiled)
    assert routed.first().route == "blocked" and J.build_catalog(pages, compiled, as_of=AT()).count() == 0
    assert J.route_help(routed, AT()).first().reason == "blocked: HTTP 403 (access denied)"
    assert J.route_failures(routed, AT()).first().error == "blocked: HTTP 403"
    plain = pages_of(("https://x.org/a", "<p>"), ("https://x.org/b", "<p>"))
    config = spark.createDataFrame([(0, False), (1, True)], "page_id long, resolved boolean")
    assert [r.route for r in J.route_pages(plain, compiled, config=config).orderBy("page_id").collect()] == ["api_undiscoverable", "no_profile"]


def test_profile_and_recipe_files(spark, tmp_path):
    folder = tmp_path / "shop.org"
    folder.mkdir()
    profile = {"site": "shop.org", "template": "cat", "cardinality": "many", "match": {"url_glob": "/c/*", "signals": ["x"]}, "unknown": 1,
               "fields": {"name": {"source": "css", "selector": "h1", "_note": "n"}, "rx": {"source": "regex", "pattern": "a", "group": 2}}}
    (folder / "cat.json").write_text(json.dumps(profile, indent=2))
    (folder / "_source.json").write_text(json.dumps({"backend": "api", "params": {"root": "R"}}))
    profiles = readers.read_profiles(spark, str(tmp_path))
    row = profiles.first()
    assert profiles.count() == 1 and row.url_glob == "/c/*" and row.ttl_hours == 168 and row.fields["rx"]["group"] == 2
    assert compile_profiles(profiles).first().profile_tier == "mixed"
    assert [tuple(r) for r in readers.read_source_recipes(spark, str(tmp_path)).collect()] == [("shop.org", "api", {"root": "R"})]
    changed = profiles.withColumns({"version": F.lit(2), "site": F.lit("https://www.shop.org/")})
    saved = writers.save_profiles(profiles, changed.unionByName(changed.withColumn("version", F.lit(1))))
    assert [r.version for r in saved.collect()] == [2]
    recipes = local_table(spark, [("a", "api", {}, 1), ("a", "html", {}, 2)], "domain string, backend string, params map<string,string>, seq int")
    assert [r.backend for r in writers.save_source_recipes(None, recipes).collect()] == ["html"]


def test_exports_round_trip(spark, part, tmp_path):
    products = fixtures.products(part)
    summary = catalog_summary(products)
    written = J.export_run(products, summary, str(tmp_path / "out"), Options(formats=("json", "csv", "other")))
    assert len(written) == 3 and J.export_run(products.limit(0), summary, str(tmp_path / "none")) == []
    back = spark.read.json(str(tmp_path / "out/products_json"))
    assert back.count() == part.count() and "updated_at" in back.columns
    assert back.where("dedup_key = 'P1'").first().category_path.startswith("Parts > ")
    flat = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out/products_csv"))
    assert len(flat.columns) == 20 and json.loads(flat.where("dedup_key = 'P3'").first().specifications)["Size"].isdigit()
    assert spark.read.json(str(tmp_path / "out/run_summary")).count() == 1


def test_html_folder_scan(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>one\n<p>two")
    page = readers.read_html_files(spark, str(tmp_path)).first()
    assert page.html == "<p>one\n<p>two" and page.url.endswith("a.html")


def test_pages_written_as_files_come_back_whole(spark, tmp_path):
    texts = ["a\n\n", "", "x\r\n", " é\ufeff ", "\ufeff<p>", "a" * 70_000, "same", "same"]
    rows = [(i // 2, "https://x.org/", text) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = QUERIES["scan_html_files"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted((i, text) for i, _, text in rows)


def test_page_files_lie_in_few_folders_and_need_plain_names(spark, tmp_path):
    pages = spark.range(200).selectExpr("concat('p', id) AS name", "concat('<p>', id) AS html")
    html_files.write_html_files(pages, str(tmp_path / "out"), folders=8)
    files = list((tmp_path / "out").glob("*/*.html"))
    assert len(list((tmp_path / "out").iterdir())) <= 8
    assert {f.name: f.read_text() for f in files} == {f"p{i}.html": f"<p>{i}" for i in range(200)}
    for name in ("a/b", "_a", ".", ""):
        with pytest.raises(Exception, match="not a file name"):
            html_files.write_html_files(pages.limit(1).selectExpr(f"'{name}' AS name", "html"), str(tmp_path / "bad"))


PAGE_DDL = "page_id long, url string, status int, source_category string, kind string, seq long, page int, n_items int, html string"


def test_stream_catalog_equals_batch_and_survives_replay(spark, listings, compiled, tmp_path):
    source, table = str(tmp_path / "pages"), str(tmp_path / "catalog")
    listings.repartition(3).write.parquet(source)
    stream = lambda ck: I.stream_catalog(
        I.page_stream(spark, source, PAGE_DDL, files_per_batch=1), compiled, table, str(tmp_path / ck), regex=False
    ).awaitTermination()
    plain = lambda df: sorted(tuple(r) for r in df.select("dedup_key", "name", "price", "description").collect())
    stream("ck1")
    expected = plain(J.build_catalog(listings, compiled, as_of=AT()))
    assert plain(I.read_incremental(spark, table)) == expected
    I.compact(spark, table)
    assert plain(I.read_incremental(spark, table)) == expected
    stream("ck2")  # a lost checkpoint replays every batch after the base
    assert plain(I.read_incremental(spark, table)) == expected
    shutil.rmtree(f"{table}/log")
    assert plain(I.read_incremental(spark, table)) == expected  # the base is whole


def _drain(df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def test_stream_frontier_and_metrics(spark, tmp_path):
    log = fixtures.crawl_log(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).withColumn("coverage", F.col("value"))
    path = str(tmp_path / "log")
    log.repartition(3).write.parquet(path)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    stream = lambda: spark.readStream.schema(ddl).parquet(path)
    urls = {r.url for r in log.select("url").distinct().collect()}
    assert sorted(r.url for r in _drain(I.stream_frontier(stream()), "f1").collect()) == sorted(urls)
    assert {r.url for r in _drain(I.stream_frontier(stream(), "60 days"), "f2").collect()} == urls
    from webcatalog.operators.report import metrics_by_window

    batch = {r.window_start: r.pages for r in metrics_by_window(log).collect()}
    windows = {r.window_start: r.pages for r in _drain(I.stream_metrics(stream(), delay="60 days"), "f3").collect()}
    assert all(batch[k] == n for k, n in windows.items())


def test_broadcast_is_asked_for_only_below_the_limit(spark):
    big = spark.createDataFrame(spark.range(50).select(F.repeat(F.lit("x"), 100).alias("t"), "id").rdd, "t string, id long")
    plan = lambda limit: spark.range(9).join(broadcast_if_small(big, limit), "id")._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(10**6) and "broadcast" not in plan(100)


def test_page_jobs_do_not_shuffle_pages(spark, pages_of, compiled):
    matched = J.match_pages(pages_of((SHOP + "a", "<p>")), compiled)
    plan = X.extract_records(matched)._jdf.queryExecution().executedPlan().toString()
    exchanges = re.findall(r"(?<!Broadcast)Exchange hashpartitioning\(([a-z_]+)", plan)
    assert set(exchanges) <= {"domain"} and plan.count("BroadcastHashJoin") == 2


def test_suite_is_complete():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 75
    text = " ".join(p.read_text() for p in Path(__file__).parent.parent.glob("webcatalog/**/*.py"))
    assert "localCheckpoint" not in text and ".crossJoin(" not in text


def test_stream_query_gives_every_core_a_file(spark, monkeypatch):
    """Each of its three batches holds as many files as there are cores, so no core waits for one file's task."""
    from query_suite import QUERIES, stores

    seen = []
    whole = stores.I.page_stream
    monkeypatch.setattr(stores.I, "page_stream", lambda s, path, ddl, files_per_batch: seen.append((path, files_per_batch)) or whole(s, path, ddl, files_per_batch))
    rows = QUERIES["stream_catalog"](spark, "/root/testdata/sf0.001")
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    ((path, per_batch),) = seen
    cores = spark.sparkContext.defaultParallelism
    assert per_batch >= cores
    assert spark.read.parquet(path).select("_metadata.file_path").distinct().count() > cores
