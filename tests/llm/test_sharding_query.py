from __future__ import annotations

from webcatalog.llm.queries import QUERIES


def test_null_ids_spread_over_the_shards(spark, tmp_path):
    rows = [(None, f"text {k}", "en", "s", 7) for k in range(300)] + [(1, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op1_sharding"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "slot", "shard"]
    rows = got.collect()
    assert len(rows) == 301 and len({r.shard for r in rows if r.doc_id is None}) > 100
