"""Rows of one doc_id, or of none, whose texts share a 32-bit hash are still different texts."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from webcatalog.llm import mixing, secret_scan, suffix_dedup
from webcatalog.llm.common import ready


@pytest.fixture(scope="module")
def pair(spark):
    """Two texts of over 100 bytes with equal 32-bit hashes, the first with a secret."""
    n = 400_000
    text = F.concat(F.when(F.col("id") % 2 == 0, F.lit("password = 'q8Zr41xPLmT7' ")).otherwise(F.lit("")), F.repeat(F.concat(F.col("id"), F.lit(" ")), 20))
    rows = ready(spark).range(n).select(text.alias("text"), (F.col("id") % 2).alias("kind"))
    twins = rows.groupBy(F.hash("text").alias("h")).agg(F.collect_set("kind").alias("kinds"), F.sort_array(F.collect_list("text"), asc=False).alias("texts"))
    found = twins.where("size(kinds) = 2").first()
    return found.texts[:2]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_unlike_texts_keep_all_their_bytes(spark, pair, doc_id):
    lone = {t: suffix_dedup.remove_repeats(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().n_removed for t in pair}
    docs = spark.createDataFrame([(doc_id, t) for t in pair], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == Counter((doc_id, len(t), lone[t]) for t in pair)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_only_the_text_with_the_secret_is_masked(spark, pair, doc_id):
    docs = spark.createDataFrame([(doc_id, t) for t in pair], "doc_id long, text string")
    secret, clean = sorted(pair, key=lambda t: "password" not in t)
    at = secret.index("q8Zr")
    findings = secret_scan.scan(docs).withColumn("is_secret", F.col("start") == at).where(F.col("value") == "q8Zr41xPLmT7")
    got = sorted(r.text for r in secret_scan.redact(docs, findings).collect())
    assert got == sorted([secret.replace("q8Zr41xPLmT7", "[secret]"), clean])


def test_rows_that_differ_in_other_columns_all_stay_in_the_mixture(spark):
    rows = [(1, "x y", "s", "de"), (1, "x y", "s", "en"), (None, "x y", "s", None), (1, "x y", None, "s"), (2, "z", "t", "de"), (2, "z", "t", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    assert Counter(tuple(r) for r in mixing.realise(docs, repetition_limit=1.0).collect()) == Counter(rows)
