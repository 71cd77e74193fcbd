from __future__ import annotations

import numpy as np
import pytest
import xxhash

from webcatalog.llm import simhash
from webcatalog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in SPACE else c for c in lowered).split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_components(bits):
    """Component (smallest id reachable) of each id, all pairs compared."""
    ids = sorted(bits)
    values = np.array([bits[i] for i in ids], dtype=np.uint64)
    label = dict(zip(ids, ids))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    for i, row in zip(ids, near):  # ids ascend, so a flood from each new one names its component
        if label[i] < i:
            continue
        stack = [i]
        while stack:
            k = stack.pop()
            for j in np.flatnonzero(near[ids.index(k)]):
                if label[ids[j]] > i:
                    label[ids[j]] = i
                    stack.append(ids[j])
    return label


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "a b\tc d", "É É é İ x y", "x " * 500, "a b c d e"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_against_brute_force(spark):
    rows = QUERIES["op10_simhash"](spark, FOLDER).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    bits = {i: slow_fingerprint(t) for i, t in docs.items()}
    label = slow_components(bits)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{bits[r.doc_id]:016x}", label[r.doc_id])


@pytest.mark.parametrize("limit", [1, 512])
def test_links_of_random_and_crowded_bits(spark, limit):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False)) for b in base for n in (1, 2, 3, 3, 4, 6)]
    crowd = [(7 << 32) | int(x) for x in rng.integers(0, 64, 30)]
    bits = sorted({*map(int, base), *near, *crowd, 0, (1 << 64) - 1})
    table = spark.createDataFrame([(signed(b),) for b in bits], "bits long")
    got = {(r.a, r.b) for r in simhash.ball_links(table, limit).collect()}
    want = {
        tuple(sorted((signed(a), signed(b))))
        for i, a in enumerate(bits) for b in bits[:i] if bin(a ^ b).count("1") <= 3
    }
    assert got == want


def test_edges_of_the_input(spark):
    long = "word " * 40_000
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 5), (2, None, 0), (3, "", 0), (None, "a b c d e f", 1), (4, long, 1), (5, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits int").withColumnRenamed("bits", "component_id")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 4), (5, 4)]
    kept = simhash.keep_first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    alone = spark.createDataFrame([(None, "x y z"), (None, "X y z"), (None, "other words")], "doc_id long, text string")
    assert simhash.keep_first_of_each(alone).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
