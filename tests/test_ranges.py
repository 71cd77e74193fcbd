"""Elements inside others are a range of those in document order."""

import random
import time

from pyspark.sql import functions as F
from test_extract import matched, profile, records

from webcatalog.fixtures import _rule
from webcatalog.functions.selectors import all_inside, first_after, first_inside
from webcatalog.operators import extract as X


def test_ranges_match_a_scan(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        hits = sorted(rng.sample(range(60), rng.randrange(0, 25)))
        low = rng.randrange(-1, 60)
        rows.append((k, hits, low, rng.choice([low, low + rng.randrange(0, 20), 2**31 - 1])))
    rows.append((999, None, 3, 5))
    table = spark.createDataFrame(rows, "k int, hits array<int>, idx int, tail int")
    elems = F.transform("hits", lambda i: F.struct(i.alias("idx"), i.alias("tail")))
    table = table.withColumn("elems", elems).withColumn("outer", F.struct("idx", "tail"))
    found = table.select(
        "k", first_after(F.col("elems"), F.col("idx")).alias("at"), all_inside(F.col("elems"), F.col("outer"))["idx"].alias("inside"),
        first_inside(F.col("elems"), F.col("outer"))["idx"].alias("first"),
    )
    got = {r.k: (r.at, r.inside, r.first) for r in found.collect()}
    assert got.pop(999)[1:] == (None, None)
    for k, hits, low, tail in rows[:-1]:
        inside = [i for i in hits if low < i <= tail]
        assert got[k] == (sum(i <= low for i in hits), inside, inside[0] if inside else None)


FIELDS = {
    "name": _rule(source="css", selector="h3"), "links": _rule(source="css", selector="a", attr="href", all=True),
    "specs": _rule(source="css", selector="li", label="b"), "pairs": _rule(source="css", selector="tr", kv=["th", "td"]),
    "variants": _rule(source="css", selector="p", fields={"sku": "i", "kind": "@class"}),
}


def page(n):
    item = lambda i: (
        f'<div class="item"><h3>n{i}</h3><a href="/{i}">x</a><a href="/{i}/b">y</a><ul><li><b>Size:</b> {i}</li><li>none</li></ul>'
        f'<table><tr><th>k{i}</th><td>v</td></tr><tr><td>alone</td></tr></table><p class="c{i}"><i>S{i}</i></p><p>no</p></div>'
    )
    return "<html><body><h3>outside</h3>" + "".join(map(item, range(n))) + "<a href='/after'>z</a></body></html>"


def test_every_item_sees_its_own_elements(spark):
    pages = spark.createDataFrame([(1, "https://x.org/list", page(70))], "page_id long, url string, html string")
    got = [r for _, _, r in records(spark, pages, profile(spark, FIELDS, item_selector=".item"))]
    assert len(got) == 70
    for i, r in enumerate(got):
        assert r["name"] == f"n{i}" and r["links"] == [f"/{i}", f"/{i}/b"] and r["specs"] == {"Size": str(i)}
        assert r["pairs"] == {f"k{i}": "v"} and r["variants"][0] == {"sku": f"S{i}", "kind": f"c{i}"}


def test_cost_follows_the_number_of_items(spark):
    took = {}
    for n in (250, 4000):  # the first also compiles
        html = "<html><body>" + "".join(f'<div class="item"><h3>n{i}</h3><b>{i}</b></div>' for i in range(n)) + "</body></html>"
        pages = spark.createDataFrame([(1, "https://x.org/list", html)], "page_id long, url string, html string")
        fields = {"name": _rule(source="css", selector="h3"), "price": _rule(source="css", selector="b")}
        found = X.extract_records(matched(spark, pages, profile(spark, fields, item_selector=".item")), regex=False)
        began = time.time()
        assert found.count() == n
        took[n] = time.time() - began
    assert took[4000] < 16 * took[250] + 4
