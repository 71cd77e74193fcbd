"""Value and URL expressions against plain-Python statements of the same rules."""

import re
from urllib.parse import urljoin, urlparse

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webcatalog.functions import urls as U
from webcatalog.functions import values as V
from webcatalog.functions.basics import strip
from webcatalog.functions.text import find_json


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def from_json(spark, texts, expression):
    return column(spark, texts, lambda x: expression(V.view(F.try_parse_json(x))))


def test_availability(spark):
    cases = {
        "https://schema.org/InStock": "in_stock", " In Stock ": "in_stock", "in stock (22)": "unknown", "pre-order": "unknown",
        "BackOrder": "preorder", "SoldOut": "out_of_stock", "x/": "unknown", "out_of_stock": "out_of_stock",
        "Discontinued": "discontinued", "in stock": "unknown", "": "unknown", None: "unknown",
    }
    assert column(spark, list(cases), V.availability) == list(cases.values())


def test_to_float(spark):
    cases = {
        '"1,234.50"': 1234.5, '"£10.50"': 10.5, '".99"': 99.0, '"SKU-12"': -12.0, '"1.234,56"': 1.23456, '"n/a"': None,
        "8.49": 8.49, "7": 7.0, "true": 1.0, "false": 0.0, "null": None, '{"a": 5}': 5.0, "1e3": 1000.0, '["3.5"]': 3.5,
    }
    assert from_json(spark, list(cases), V.to_float) == list(cases.values())


def test_truthy(spark):
    false = ['""', "0", "0.0", "false", "null", "[]", "{}"]
    true = ['"0"', "1", "-0.5", "true", "[0]", '{"a":null}', '" "']
    assert from_json(spark, false, V.truthy) == [False] * len(false)
    assert from_json(spark, true, V.truthy) == [True] * len(true)


def test_category_path(spark):
    cases = {
        '"A > B/C "': ["A", "B", "C"], '" "': ["fb"], '["x", " ", 3]': ["x", "3"], "[]": ["fb"], "null": ["fb"], "5": ["fb"],
    }
    assert from_json(spark, list(cases), lambda v: V.category_path(v, F.lit("fb"))) == list(cases.values())
    assert from_json(spark, ["null"], lambda v: V.category_path(v, F.lit(None).cast("string"))) == [[]]


def test_variant_skus(spark):
    text = '["A-1", "12-34", "1234", "5", "-", "12-34"]'
    others = column(spark, [text, '"solo"', "[]"], lambda x: F.transform(
        V.variant_skus(F.try_parse_json(x))["others"], lambda s: F.try_variant_get(s, "$", "string")))
    primary = column(spark, [text, '"solo"', "[]"], lambda x: F.try_variant_get(
        V.variant_skus(F.try_parse_json(x))["primary"], "$", "string"))
    assert others == [["12-34", "5"], [], []] and primary == ["A-1", "solo", None]


def test_expiry(spark):
    as_of = F.lit("2024-01-02T00:00:00Z").cast("timestamp")
    values = [None, "soon", "2024-01-01T00:00:01+00:00", "2023-12-31T23:59:59+00:00"]
    assert column(spark, values, lambda x: V.is_expired(x, F.lit(24), as_of)) == [True, True, False, True]


def test_dedup_key(spark):
    rows = spark.createDataFrame([(" ab ", "U"), ("　", " HTTP://X "), (None, "y")], "s string, u string")
    assert [r.k for r in rows.select(V.dedup_key(F.col("s"), F.col("u")).alias("k")).collect()] == ["AB", "http://x", "y"]


@pytest.mark.parametrize("text, found", [
    ('x {"a": [1, 2]} tail }', '{"a": [1, 2]}'), ('```json\n[1, "]"]\n``` {"b":1}', '[1, "]"]'), ("nothing", None),
    ('{"a": "\\"}"} rest', '{"a": "\\"}"}'), ("{broken", None), (None, None), ('[{"a": NaN}]', '[{"a": null}]'),
])
def test_first_json(text, found):
    assert find_json(text) == found


BASES = ["http://a.com/b/c?x=1#f", "https://a.com", "https://a.com/", "http://a.com/b//c/d", "http://u@a.com:80/x.html", "u", "a/b"]
LEADS = ["", "/", "//h.org/", "http://h.org", "https:", "mailto:", "?q=1", "#f", " "]
MIDDLES = ["", "a", "..", "../a", "./b.html", "a//b", "a/../..", "c d", "../../é", "a/./", "/a"]
ENDS = ["", "?p=2", "#top", "?a=1#b", "?", "#"]


def test_abs_url_agrees_with_the_standard_library(spark):
    rows = [(b, x + y + z) for b in BASES for x in LEADS for y in MIDDLES for z in ENDS]
    frame = spark.createDataFrame(rows, "b string, r string")
    got = frame.select("b", "r", U.abs_url(F.col("r"), U.split_url(F.col("b"))).alias("u")).collect()
    wrong = [(r.b, r.r, r.u, urljoin(r.b, r.r)) for r in got if (r.u or "") != (urljoin(r.b, r.r) if r.r else "")]
    assert not wrong, wrong[:5]


_TEXTS = st.lists(st.text("0123456789.,-+ £a\t\n　", max_size=12), min_size=100, max_size=100)


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(_TEXTS)
def test_numbers_and_strip_agree_with_python(spark, texts):
    def number(text):
        found = re.search(r"[-+]?\d[\d,]*\.?\d*", text.replace(",", ""))
        return float(found.group()) if found else None

    assert column(spark, texts, V.number_in) == [number(t) for t in texts]
    assert column(spark, texts, strip) == [t.strip() for t in texts]


URLS = ["https://WWW.Shop.com:8080/a?b#c", "http://x.org", "no-scheme/path", "https://u:p@www.y.org/p", "//z.com/x", "www.q.com", ""]


def test_domain_of(spark):
    def expected(url):
        host = (urlparse(url).netloc or url).lower()
        return re.sub(r"^www\.", "", host)

    assert column(spark, URLS, U.domain_of) == [expected(u) for u in URLS]


def test_query_params(spark):
    got = column(spark, ["http://x/?a=1&b=&a=2&c&d=%41+b&e=%zz#f=1"], U.query_params)
    assert [(p.key, p.value) for p in got[0]] == [("a", "1"), ("a", "2"), ("d", "A b"), ("e", "%zz")]


def test_strip_takes_every_white_space_and_tries_no_pattern(spark):
    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    cases = [spaces + "a" + spaces + "b" + spaces, spaces, "", None, "a", " ​ ", "é\r\n", "filler text " * 5000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    rows = df.select("i", strip(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == [None if c is None else c.strip() for c in cases]
    plan = df.select(strip(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
