from __future__ import annotations

from collections import Counter

import corpus_pipeline
from webcatalog.llm import simhash

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean, toxic = [i for i, t in labels.items() if not t], [i for i, t in labels.items() if t]
    assert sum(i in ids for i in clean) >= 0.9 * len(clean) and sum(i in ids for i in toxic) <= 0.3 * len(toxic)

    texts = {r.doc_id: r.text for r in kept.collect()}
    first = stages["simhash_near_dedup"](spark, kept, FOLDER)
    bits = {i: simhash.fingerprint(t) for i, t in texts.items()}
    left = sorted(r.doc_id for r in first.collect())
    group = {i: i for i in bits}
    for _ in bits:
        new = {i: min(group[j] for j in bits if bin(bits[i] ^ bits[j]).count("1") <= 3) for i in bits}
        if new == group:
            break
        group = new
    assert left == sorted(set(group.values())) and first.columns == docs.columns

    masked = stages["secret_scan"](spark, first, FOLDER)
    assert masked.columns == docs.columns and sorted(r.doc_id for r in masked.collect()) == left
    changed = {r.doc_id: r.text for r in masked.collect() if r.text != texts[r.doc_id]}
    assert all("[secret]" in t for t in changed.values())

    mixed = stages["mixing"](spark, masked, FOLDER)
    uses = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and sorted(uses) == left and max(uses.values()) <= 2

    packed = stages["packing"](spark, mixed, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(left)
    assert sum(r.length for r in packed if r.doc_id == left[0]) == uses[left[0]] * next(r.doc_tokens for r in packed if r.doc_id == left[0])


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
