from __future__ import annotations

import hashlib
import random

import pytest

from webcatalog.llm import suffix_dedup
from webcatalog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def slow(texts):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} with every 100-byte string in a set."""
    seen, out = set(), {}
    for doc_id in sorted(texts):
        raw = (texts[doc_id] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def as_dict(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_query_against_brute_force(spark):
    rows = QUERIES["op5_suffix_dedup"](spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert as_dict(rows) == slow(texts)


@pytest.mark.parametrize("limit", [1, 100_000])
def test_repetitive_texts(spark, limit):
    rng = random.Random(limit)
    line = "".join(rng.choice("abcdeé ") for _ in range(170))
    texts = {0: "x" * 450, 1: "x" * 99, 2: "xy" * 200, 3: None, 4: "", 5: line, 6: line[:100], 7: line[1:100]}
    for k in range(10, 60):
        own = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 150))) for _ in range(2)]
        texts[k] = own[0] + line[rng.randint(0, 40) : rng.randint(120, 170)] + own[1]
    texts[61] = texts[20] + texts[21] + texts[20]
    texts[62] = "ab" * 3000 + line + "ab" * 3000
    docs = spark.createDataFrame([(k, v, "s", 1) for k, v in texts.items()], "doc_id long, text string, tie string, start int")
    got = suffix_dedup.remove_repeats(docs.repartition(5), limit).collect()
    assert as_dict(got) == slow(texts)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    parts = ["".join(rng.choice("ab ") for _ in range(130)) for _ in range(4)]
    texts = [bytes("".join(rng.choice(parts) for _ in range(6)), "ascii") for _ in range(20)]
    import numpy as np

    data, lengths = b"".join(texts), np.array([len(t) for t in texts])
    fp, start, n, a = suffix_dedup.phrases(data, lengths)
    # Each string lies in one phrase, and a phrase ends with its text.
    ends = np.cumsum(lengths)
    covered = np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)])
    want = np.concatenate([np.arange(e - t, e - 99) for e, t in zip(ends, lengths)])
    assert covered.tolist() == want.tolist()
    triggers = {}
    for f, s, k, d in zip(fp.tolist(), start.tolist(), n.tolist(), a.tolist()):
        for j in range(k):
            assert triggers.setdefault(data[s + j : s + j + 100], (f, d - j)) == (f, d - j)


def test_repeated_rows_and_empty_table(spark):
    long = "0123456789" * 30 + "abc"
    rows = [(1, "z" * 50), (1, "z" * 50), (2, long), (2, long), (2, "other " * 3), (None, "q" * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    first = slow({1: long})[1]
    assert got == sorted([(-1, 100, 0), (1, 50, 0), (1, 50, 0), (2, 303, first[1]), (2, 303, 303), (2, 18, 0)])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_phrases_of_a_trigger_stay_together(spark):
    """Small broadcast limits and uncoalesced partitions, as on a cluster: the lookup sees whole triggers."""
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(170))
    own = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))
    texts = {k: own() + line[rng.randint(0, 40) : rng.randint(120, 170)] + own() for k in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(12)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "3000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert as_dict(suffix_dedup.remove_repeats(docs, 20).collect()) == slow(texts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_smallest_ids_keep_their_id(spark):
    texts = {-(1 << 63): "0123456789" * 12, 5 - (1 << 63): "0123456789" * 12 + "abc", 7: "q" * 99}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert as_dict(suffix_dedup.remove_repeats(docs).collect()) == slow(texts)
