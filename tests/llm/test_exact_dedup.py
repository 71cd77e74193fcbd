import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from webcatalog.llm import exact_dedup
from webcatalog.llm.common import fresh_path, ready

SCHEMA = "doc_id long, text string, digest string, row int"  # clashing names
ROWS = [
    (5, "a b", "x", 1), (2, "ab", None, 1), (9, "a  b\n", "y", 2), (1, "other", "z", 3), (None, "other", "z", 3), (None, "other", "z", 3),
    (3, None, None, None), (4, "", None, None), (6, " \t\r\n", None, None), (7, "a b", None, None), (8, "long " * 50_000, None, None),
    (8, "long " * 50_000, None, None),
]


def brute(rows):
    groups = defaultdict(list)
    for k, (doc_id, text, *_) in enumerate(rows):
        text = text or ""
        groups[re.sub("[\x20\x09-\x0d]", "", text)].append((-len(text), doc_id is None, doc_id or 0, k, doc_id))
    out = []
    for text, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=repr)


def new_index(spark, buckets=4):
    return exact_dedup.DigestIndex(ready(spark), fresh_path(spark, "test-index"), buckets)


def test_one_delivery(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.deduplicate(docs, new_index(spark))
    got, want = found(out), brute(ROWS)
    # which of wholly equal rows stays is open
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert [r for r in got if r[0] not in (None, 8)] == [r for r in want if r[0] not in (None, 8)]
    assert sum(r[3] for r in got) == len({r[4] for r in want})
    assert not out.where("known").count()


def test_empty(spark):
    index = new_index(spark)
    assert found(exact_dedup.deduplicate(spark.createDataFrame([], SCHEMA), index)) == []
    assert index.rows().count() == 0


def test_deliveries_meet_the_index(spark):
    index = new_index(spark)
    first = spark.createDataFrame([(1, "one"), (2, "two"), (3, "t w o")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "one   and longer than before"), (5, "o n e"), (6, "three")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.deduplicate(first, index, "a").where("kept").orderBy("doc_id").collect()] == [1, 3]
    got = {r.doc_id: r for r in exact_dedup.deduplicate(second, index, "b").collect()}
    assert not got[5].kept and got[5].keep_id == 1 and got[5].known and got[6].kept and got[4].kept
    assert index.rows().count() == 4
    again = exact_dedup.deduplicate(second, index, "c")  # appends nothing
    assert again.where("kept").count() == 0 and index.rows().count() == 4
    opened = exact_dedup.DigestIndex(spark, index.folder)  # as a later session would
    assert opened.buckets == 4 and opened.rows().count() == 4


def test_index_side_is_not_shuffled(spark):
    index = new_index(spark)
    exact_dedup.deduplicate(spark.createDataFrame(ROWS, SCHEMA), index)
    groups = exact_dedup.groups_of(exact_dedup.digests(spark.createDataFrame(ROWS, SCHEMA)))
    plan = index.unknown(groups)._jdf.queryExecution().executedPlan().toString()
    right = plan[plan.rindex("Scan parquet spark_catalog") - 400 :] if "spark_catalog" in plan else plan
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and "Exchange" not in right.split("Scan parquet spark_catalog")[0].rsplit("Sort ", 1)[-1]
    small = index.compact(fresh_path(spark, "test-index"))
    assert small.rows().count() == index.rows().count()
    assert small.rows().select(F.input_file_name()).distinct().count() <= 4


def test_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.deduplicate(docs, new_index(spark))
    assert out.where("kept").count() == 2001 and out.where("keep_id = 0").count() == 1000
