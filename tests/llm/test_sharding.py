from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import xxhash

from webcatalog.llm import sharding
from webcatalog.llm.queries import QUERIES, SHARDS

FOLDER = "/root/testdata/sf0.001"


def slow_table(shards, size):
    """Every shard's whole preference list, then turns."""
    lists = []
    for s in shards:
        at, stride = xxhash.xxh64_intdigest(s, 1) % size, xxhash.xxh64_intdigest(s, 2) % (size - 1) + 1
        lists.append([(at + stride * j) % size for j in range(size)])
    owner = {}
    while len(owner) < size:
        for k, order in enumerate(lists):
            if len(owner) < size:
                owner[next(s for s in order if s not in owner)] = k
    return [owner[s] for s in range(size)]


def test_table_against_brute_force():
    for n, size in ((1, 2), (3, 7), (5, 101), (7, 211)):
        shards = [f"s{k}" for k in range(n)]
        assert sharding.lookup_table(shards, size).tolist() == slow_table(shards, size)


def test_table_is_even_and_stable():
    full = sharding.lookup_table(SHARDS)
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(SHARDS[:-1])
    moved = (full != fewer) & (full != len(SHARDS) - 1)
    assert moved.mean() < 0.05


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 2_000_029)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_query(spark):
    rows = QUERIES["op1_sharding"](spark, FOLDER).collect()
    docs = [r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    owner = sharding.lookup_table(SHARDS)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        slot = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little", signed=True), 42)
        slot = (slot - (1 << 64) if slot >> 63 else slot) % sharding.TABLE_SIZE
        assert (r.slot, r.shard) == (slot, SHARDS[owner[slot]])


def test_edges(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "b", "x"), (1, "a", "x"), *[(None, f"t{k}", None) for k in range(50)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    placed = sharding.assign_shards(docs, ["doc_id"], ["p", "q", "r"], 101)
    got = placed.collect()
    assert len(got) == 53 and len({r.shard for r in got if r.doc_id == 1}) == 1
    assert len({r.shard for r in got if r.doc_id is None}) == 3
    assert sharding.assign_shards(docs.limit(0), ["doc_id"], ["p"], 2).count() == 0
    sharding.write_shards(placed, f"{tmp_path}/s", 2)
    assert Counter(r.shard for r in spark.read.parquet(f"{tmp_path}/s").collect()) == Counter(r.shard for r in got)
