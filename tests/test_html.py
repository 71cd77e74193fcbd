"""Parse pass, selectors and page views."""

import hashlib

import pytest
from pyspark.sql import functions as F

from webcatalog.functions.html import _Page
from webcatalog.functions.selectors import compile_selector, element_text, element_value, select
from webcatalog.operators import pages as P
from webcatalog.sources.local import local_table


def doc(pages_of, *htmls):
    return P.with_documents(pages_of(*[(f"http://x.org/{i}", h) for i, h in enumerate(htmls)]))


def tags(html):
    page = _Page(html)
    return [(t, page.tags[p] if p >= 0 else None) for t, p in zip(page.tags, page.parents)]


def test_implied_structure_and_unclosed_items():
    assert tags("<title>t</title><ul><li>a<li>b</ul><p>c<div>d</div>") == [
        ("html", None), ("head", "html"), ("title", "head"), ("body", "html"), ("ul", "body"),
        ("li", "ul"), ("li", "ul"), ("p", "body"), ("div", "body"),
    ]
    # Only the innermost open element is closed implicitly: a bold paragraph keeps its child.
    assert ("p", "b") in tags("<article><p><b>x<br><p>y</p></article>")
    assert ("td", "tr") in tags("<table><tr><td>1<td>2<tr><td>3</table>")


def test_text_entities_comments_and_raw_elements():
    page = _Page("<p>a &amp; b &copy;c &nosuch; &ampx<!-- no -->d</p><script>if (a<b) '</p>'</script><p>e")
    assert page.texts == ["a & b ©c &nosuch; &ampx", "d", "e"]


@pytest.mark.parametrize("html", ["", "   ", "<", "<a href='x", "<!-- open", "</p></div>", "a < b > c", "<b><i></b></i>"])
def test_broken_markup_is_survived(html):
    page = _Page(html)
    assert all(tail >= i for i, tail in enumerate(page.tails))


def test_close_tag_stays_inside_a_stronger_element():
    assert tags("<span><div>a</span>b</div>c")[-2:] == [("span", "body"), ("div", "span")]


def test_jsonld_nodes_in_document_order_and_bad_blocks_count():
    page = _Page(
        '<script type="application/ld+json">{"@type":["A","B"],"x":[{"@type":"Product","p":NaN}]}</script>'
        '<script type="application/ld+json">{broken</script><script>{"@type":"No"}</script>'
    )
    assert page.blocks == 2 and page.block_types == {"A", "B"}
    assert [t for t, *_ in page.nodes] == [["A", "B"], ["Product"]]
    assert page.nodes[1][2] == '{"@type": "Product", "p": null}'


SELECTOR_HTML = (
    '<div id="top" class="a b"><h3><a href="/x/1" title="T1">one</a></h3><p class="price">£1</p></div>'
    '<div class="b"><section><h3><a href="/y/2">two <i>!</i></a></h3></section></div>'
)


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("a", ["one", "two !"]), ("div.a a", ["one"]), ("div > h3 a", ["one"]), ("div h3 > a", ["one", "two !"]),
        ("#top a", ["one"]), ('a[href*="/y/"]', ["two !"]), ("a[title]", ["one"]), ("a[href^='/x']", ["one"]),
        ("a[href$='2']", ["two !"]), ("div.b.a p.price", ["£1"]), (".price, i", ["£1", "!"]), ("i,p , a[title=T1]", ["one", "£1", "!"]),
        ("section > a", []), ("div > section > h3", ["two !"]), ("*.price", ["£1"]), ("h3, div > h3", ["one", "two !"]),
    ],
)
def test_selectors(spark, pages_of, selector, texts):
    steps = local_table(spark, [(0, compile_selector(selector))], "page_id long, steps " + _ddl())
    found = doc(pages_of, SELECTOR_HTML).join(steps, "page_id").select(
        F.transform(select(F.col("doc.elems"), F.col("steps")), lambda e: element_text(F.col("doc.texts"), e)).alias("t")
    )
    assert found.first()["t"] == texts


def _ddl():
    from webcatalog.functions.selectors import SELECTOR_DDL

    return SELECTOR_DDL


@pytest.mark.parametrize("selector", ["", "a:hover", "a + b", "a ~ b", "div >", "a[", "[lang|=en]", ">a"])
def test_unsupported_selectors_compile_to_nothing(selector):
    assert compile_selector(selector) is None


def test_element_value(spark, pages_of):
    page = doc(pages_of, '<a class="x  y" href="">  </a>')
    anchor = F.filter("doc.elems", lambda e: e["tag"] == "a")[0]
    row = page.select(
        *[element_value(F.col("doc.texts"), anchor, F.lit(a).cast("string")).alias(str(i))
          for i, a in enumerate([None, "@text", "@href", "class", "@none"])]
    ).first()
    assert list(row) == [None, None, "", "x y", None]


def test_golden_signatures(spark, pages_of):
    chrome = "<head></head><header></header><nav></nav><main></main><footer></footer><form></form>"
    block = '<script type="application/ld+json">{{"@type":"{}","o":{{"@type":"Offer"}}}}</script>'.format
    htmls = [
        "<html><head></head><body><header></header><footer></footer><form></form></body></html>",
        chrome + block("ItemList") + block("BreadcrumbList"),
        chrome + block("Product") + block("BreadcrumbList"),
        '<script type="application/ld+json">[{"@type":"Ä"},{"@graph":[{"@type":"X"}]}]</script>',
    ]
    got = [r.signature for r in P.template_signatures(doc(pages_of, *htmls)).orderBy("page_id").collect()]
    # Signatures of three known templates.
    assert got[:3] == ["8964238c714d5b8b", "a0f4ce0062fe14fd", "ae6e741e0d451877"]
    text = '{"blocks": 1, "landmarks": ["html", "head"], "types": ["\\u00c4"]}'
    assert got[3] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_blocked(spark, pages_of):
    long = "x" * 4000
    pages = pages_of(("u", "Just a Moment..."), ("u", long + "access denied"), ("u", "<noscript>Enable JavaScript</noscript>"))
    assert [r.blocked for r in P.flag_blocked(pages).orderBy("page_id").collect()] == [True, False, True]
    refused = P.flag_blocked(pages_of(("u", "fine"), status=401))
    assert refused.first().blocked


def test_clean_text_and_hints(spark, pages_of):
    html = (
        "<header>no</header><h1 class='a b c d'>Big\n  title</h1><noscript><h2>no</h2></noscript>"
        "<ul><li>x<li>y</ul><svg><p>no</p></svg><p>tail \x0b here"
    )
    documents = doc(pages_of, html)
    assert P.clean_texts(documents).first().text == "Big\ntitle\nx\ny\ntail\nhere"
    assert P.clean_texts(documents, 5).first().text == "Big\nt"
    assert P.structure_hints(documents).first().hints == "h1.a.b.c :: Big\n  title\nul :: x y"
    assert P.structure_hints(documents, 12).first().hints == "h1.a.b.c :: "


def test_revalidation_sample_is_repeatable(spark):
    pages = spark.range(4000).select(F.concat(F.lit("http://x/"), "id").alias("url"))
    first = {r.url for r in P.revalidation_sample(pages, 0.05, "s").collect()}
    again = {r.url for r in P.revalidation_sample(pages.repartition(7), 0.05, "s").collect()}
    assert first == again and 120 < len(first) < 280


def test_prompts(spark, pages_of):
    pages = pages_of(("http://x", "h")).withColumn("hints", F.lit(None).cast("string"))
    built = P.build_prompts(pages, "U={url} H={hints}", url="url", hints="hints")
    assert built.first().prompt == "U=http://x H=(none)"


def test_unclosed_marks_take_linear_time():
    import time

    from webcatalog.functions.html import _Page

    for part in ("<!--", '<a b="', "<a b='", '<a b=">" ', "<script", "</script", "<a ", "<!-- > "):
        start = time.process_time()
        _Page(part * (1_000_000 // len(part)))
        _Page("<script>" + part * (1_000_000 // len(part)))
        assert time.process_time() - start < 5, part
    page = _Page("<p>one<!-- c --><b t='x>y'>two</b><!-- open <i>three</i>")
    assert page.texts == ["one", "two", "three"]


def test_pages_are_parsed_in_parts_of_bounded_memory(monkeypatch):
    """A batch is never held parsed as a whole, and its pages come out complete and in order."""
    import pyarrow as pa

    from webcatalog.functions import html as H

    made = []
    monkeypatch.setattr(F, "arrow_udf", lambda fn, ddl: lambda html: made.append(fn))
    H.parse_html("html")
    pages = [f"<p>page {i}</p>" + "<i>x</i>" * (i % 7) * 400 for i in range(3000)] + [None, "", "<b>y</b>" * 200_000]
    parts = list(made[0](iter([pa.array(pages), pa.array([], pa.string())])))
    assert max(len(p) for p in parts) < 1100
    texts = [page["texts"] for part in parts for page in part.to_pylist()]
    assert [len(t) for t in texts] == [1 + (i % 7) * 400 for i in range(3000)] + [0, 0, 200_000]
    assert [t[0] for t in texts[:3000]] == [f"page {i}" for i in range(3000)]


def test_blocked_marks_are_found_with_one_look_at_the_head(spark):
    heads = ["<title>Just A Moment...</title>", "x" * 3990 + "access denied", "x" * 3980 + "access denied", "fine", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, html string")
    out = df.select("i", P.is_blocked(F.lit(200), F.col("html")).alias("b"))
    assert [r.b for r in out.orderBy("i").collect()] == [True, False, True, False, False]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and plan.count("lower(") == 1


def test_a_part_is_parsed_without_collections_and_leaves_the_collector_as_it_was(monkeypatch):
    import gc

    from webcatalog.functions import html

    seen, built = [], html._documents
    monkeypatch.setattr(html, "_documents", lambda pages: (seen.append(gc.isenabled()), built(pages))[1])
    assert html._parsed(["<p class='a b' id=x>y", None, ""], None).to_pylist()[0]["elems"][2]["attrs"] == [("id", "x")]
    assert seen == [False] and gc.isenabled()
