from __future__ import annotations

import numpy as np

from webcatalog.llm import toxicity
from webcatalog.llm.common import ready
from webcatalog.llm.queries import QUERIES, TOXICITY

FOLDER = "/root/testdata/sf0.01"


def test_query_catches_labelled_documents_of_the_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    caught = np.mean([rows[r.doc_id].toxic for r in labels if r.toxic])
    left = np.mean([not rows[r.doc_id].toxic for r in labels if not r.toxic])
    assert caught >= 0.9 and left >= 0.95


def test_one_text_and_one_label_for_each_id(spark, monkeypatch):
    docs = [(k, f"good words {k}" if k % 2 else f"nasty insult {k}") for k in range(60)] + [(99, f"nasty insult {k}") for k in range(5000)]
    labels = [(k, 1, 1 - k % 2) for k in range(60)] + [(99, 0, 0), (99, 1, 1), (None, 1, 1)]
    docs = ready(spark).createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *a: seen.append(a) or fit(*a))
    chain = toxicity.train(docs, labels, TOXICITY)
    _, _, sets, marks, _ = seen[0]
    assert len(sets) == 61 and marks[-1].tolist() == [1.0, 1.0]  # the largest label of each category
    scored = toxicity.score(docs, chain, "toxic")
    assert scored.where("doc_id = 99 AND NOT rejected").count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    rows = [(k, f"w{k % 7} bad" if k % 3 == 0 else f"w{k % 7} fine") for k in range(4000)]
    docs = ready(spark).createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(4000)], "doc_id long, quality int, toxic int")
    seen = []
    fit = toxicity.fit_chain
    monkeypatch.setattr(toxicity, "fit_chain", lambda *a: seen.append(len(a[2])) or fit(*a))
    toxicity.train(docs, labels, TOXICITY, sample_rows=400)
    assert 300 < seen[0] < 500
