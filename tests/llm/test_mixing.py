from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from webcatalog.llm import mixing
from webcatalog.llm.common import written
from webcatalog.llm.queries import QUERIES, REPETITION_LIMIT

FOLDER = "/root/testdata/sf0.001"


def slow_weights(tokens, entropy=None, limit=None):
    """Passes of each source, by plain bisection on the driver."""
    total = sum(tokens.values())
    p = {s: t / total for s, t in tokens.items() if t}

    def at(a):
        raw = {s: x**a for s, x in p.items()}
        z = sum(raw.values())
        return {s: x / z for s, x in raw.items()}

    def good(a):
        w = at(a)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) >= entropy
        ratios = [w[s] / p[s] for s in p]
        return max(ratios) / min(ratios) <= limit

    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if good(middle) == (entropy is not None):
            low = middle
        else:
            high = middle
    a = low if entropy is not None else high
    if (entropy is not None and good(1.0)) or (limit is not None and not good(1.0)):
        a = 1.0
    w = at(a)
    least = min(w[s] / p[s] for s in p)
    return {s: w[s] / p[s] / least for s in p}


def test_query_against_brute_force(spark):
    rows = QUERIES["op7_mixing"](spark, FOLDER).collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    tokens = Counter()
    for r in docs:
        tokens[r.source] += words[r.doc_id]
    passes = slow_weights(tokens, limit=REPETITION_LIMIT)
    used, epochs = Counter(), defaultdict(Counter)
    for r in rows:
        assert r.tokens == words[r.doc_id]
        used[r.source] += r.tokens
        epochs[r.doc_id][r.epoch] += 1
    for r in docs:
        whole = math.floor(passes[r.source] + 1e-6)
        assert all(epochs[r.doc_id][e] == 1 for e in range(whole))
        assert set(epochs[r.doc_id].values()) == {1} and max(epochs[r.doc_id]) <= whole
    for s in tokens:
        largest = max(words[r.doc_id] for r in docs if r.source == s)
        assert abs(used[s] - passes[s] * tokens[s]) <= largest


@pytest.mark.parametrize("target", [{"target_entropy": 1.0}, {"target_entropy": 1.09}, {"repetition_limit": 1.0}, {"repetition_limit": 30.0}])
def test_exponent(spark, target):
    tokens = {"a": 9000, "b": 900, "c": 100}
    rows = [(k, "w " * 10, s) for s, t in tokens.items() for k in range(t // 10)]
    sized = written(mixing.sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")), "sizes")
    due = {r.source: r.passes for r in mixing.weights(sized, target.get("target_entropy"), target.get("repetition_limit")).collect()}
    want = slow_weights(tokens, target.get("target_entropy"), target.get("repetition_limit"))
    assert all(abs(due[s] - want[s]) < 1e-4 * want[s] for s in tokens)


def test_edges(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, "x", 1), (3, "", "empty", 1), (None, "c", None, 1), (4, "w " * 20_000, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    got = mixing.realise(docs, repetition_limit=3.0)
    assert got.columns == docs.columns
    count = Counter((r.doc_id, r.source) for r in got.collect())
    assert set(count) == {(1, "x"), (2, "x"), (3, "empty"), (None, None), (4, "y")}
    assert count[(1, "x")] >= 2 and count[(3, "empty")] == count[(4, "y")] == 1 and count[(None, None)] == 3
    assert mixing.realise(docs.limit(0), repetition_limit=2.0).count() == 0
    assert mixing.realise(docs.where("text IS NULL OR text = ''"), repetition_limit=2.0).count() == 2
    with pytest.raises(ValueError):
        mixing.realise(docs).count()
