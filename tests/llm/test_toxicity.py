from __future__ import annotations

import numpy as np

from webcatalog.llm import toxicity
from webcatalog.llm.queries import TOXICITY

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"), TOXICITY)
    scored = {r.doc_id: r.rejected for r in toxicity.score(docs, chain, "toxic").collect()}
    held = labels.where("doc_id % 2 = 1").collect()  # a few labels contradict their texts
    found = [scored[r.doc_id] for r in held if r.toxic == 1]
    clean = [scored[r.doc_id] for r in held if r.toxic == 0]
    assert sum(found) >= 0.9 * len(found) and sum(clean) <= 0.005 * len(clean)


def test_chain_uses_the_earlier_category():
    rng = np.random.default_rng(3)
    first = rng.integers(0, 2, 2000)
    sets = [[0] if f else [1] for f in first]
    labels = np.column_stack([first, first]).astype(float)
    chain = toxicity.fit_chain({"a": 0, "b": 1}, ["one", "two"], sets, labels, np.arange(2000) % toxicity.FOLDS)
    assert chain.models[1].dense[0] > 0.5
    found = chain.probabilities([[0], [1], []])
    assert found[0, 1] > 0.9 > 0.1 > found[1, 1]


def test_edges(spark):
    rows = [(1, "bad word"), (1, "bad word"), (2, None), (3, ""), (None, "bad " * 50_000)]
    docs = spark.createDataFrame([(*r, 9.0) for r in rows], "doc_id long, text string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, none, TOXICITY)
    got = toxicity.score(docs, chain, "toxic").collect()
    assert len(got) == 5 and not any(r.rejected for r in got) and all(r.p_toxic < 1e-9 for r in got)
    one = spark.createDataFrame([(1, None, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, one, TOXICITY)
    assert all(r.p_toxic > 0.99 for r in toxicity.score(docs, chain, "toxic").collect())
    assert toxicity.score(docs.limit(0), chain, "toxic").count() == 0


def test_threshold():
    scores, target = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1.0, 0.0, 0.0])
    assert 0.2 < toxicity.best_threshold(scores, target) < 0.8
    assert toxicity.best_threshold(scores, np.zeros(4)) == 0.5
