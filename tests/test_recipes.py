"""Recipe files: read and written by executors, one small file a domain."""

import json

import pytest

from webcatalog.schemas import RECIPE_DDL
from webcatalog.sources import recipes as R


def put(root, domain, content):
    (root / domain).mkdir()
    (root / domain / "_source.json").write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")


def rows(df):
    return sorted(((r.domain, r.backend, r.params) for r in df.collect()), key=lambda r: r[0])


def test_recipe_blocks_and_values(spark, tmp_path):
    put(tmp_path, "a.org", {"backend": "api", "api": {"root": "R", "n": 3, "on": True, "none": None, "list": ["é"]}, "params": {"x": "y"}})
    put(tmp_path, "b.org", {"backend": "html", "params": {"x": "y"}})
    put(tmp_path, "c.org", {"note": "no backend"})
    put(tmp_path, "d.org", {"backend": "params", "params": "text"})
    (tmp_path / "e.org").mkdir()
    (tmp_path / "e.org" / "cat.json").write_text("{}")
    (tmp_path / "_source.json").write_text("{}")
    want = [
        ("a.org", "api", {"root": "R", "n": "3", "on": "true", "none": None, "list": '["é"]'}),
        ("b.org", "html", {"x": "y"}), ("c.org", None, {}), ("d.org", "params", {}),
    ]
    assert rows(R.read_source_recipes(spark, str(tmp_path))) == want
    assert rows(R.read_source_recipes(spark, f"file://{tmp_path}/")) == want


def test_many_folders_are_dealt_to_tasks(spark, tmp_path):
    for i in range(23):
        put(tmp_path, f"d{i}.org", {"backend": "api"})
    table = R.read_source_recipes(spark, str(tmp_path), folders_per_task=5)
    assert table.count() == 23 and table.rdd.getNumPartitions() == 5


def test_no_folder_and_broken_file(spark, tmp_path):
    assert R.read_source_recipes(spark, str(tmp_path / "none")).count() == 0
    assert R.read_source_recipes(spark, str(tmp_path)).count() == 0
    put(tmp_path, "bad.org", "[1]")
    with pytest.raises(Exception, match="bad.org/_source.json: a recipe is a JSON object"):
        R.read_source_recipes(spark, str(tmp_path)).collect()


def test_round_trip_replaces_files(spark, tmp_path):
    first = spark.createDataFrame([("a.org", "api", {"q": "ü\n"}), ("b.org", None, None), ("c d", "x", {"n": None})], RECIPE_DDL)
    root = str(tmp_path / "deep" / "root")
    R.write_source_recipes(first, root)
    want = [("a.org", "api", {"q": "ü\n"}), ("b.org", None, {}), ("c d", "x", {"n": None})]
    assert rows(R.read_source_recipes(spark, root)) == want
    R.write_source_recipes(spark.createDataFrame([("a.org", "html", {})], RECIPE_DDL), root)
    assert rows(R.read_source_recipes(spark, root)) == [("a.org", "html", {}), *want[1:]]


@pytest.mark.parametrize("domain", [None, "", "..", "a/b"])
def test_a_domain_stays_inside_the_root(spark, tmp_path, domain):
    bad = spark.createDataFrame([(domain, "api", {})], RECIPE_DDL)
    with pytest.raises(Exception, match="not a domain"):
        R.write_source_recipes(bad, str(tmp_path / "root"))
