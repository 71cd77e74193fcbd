import math
import re
from collections import Counter

from webcatalog.llm import lexical_search
from webcatalog.llm.common import ready

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = [
    (1, "The cat, the CAT and the dog.", 7), (2, "cats concatenate cat-cat_cat", 7), (3, None, 7), (4, "  ...  ", 7), (5, "été ÉTÉ caté 42", 7),
    (6, "cat", 7), (7, "cat", 7), (7, "cat", 7), (None, "cat", 7), (8, "dog " * 30_000 + "cat", 7), (9, "a\x00b\x7fc [cat]`dog`", 7),
]
ITEMS = [(1, "cat dog"), (2, "Cat cat été"), (3, ""), (4, None), (5, "nowhere"), (6, "the AND 42 b c"), (6, "dog"), (None, "concatenate")]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top):
    counted = [(d, Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    big_n, big_l = len(counted), sum(sum(c.values()) for _, c in counted)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * big_n) // big_l
            score = 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(t in x for _, x in counted) + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) if c[t] else 0
            if score:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if no_id else d, -s) for k, (s, no_id, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    docs = ready(spark).createDataFrame(docs, "doc_id long, text string, item_id int")
    out = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), **options)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_matches_brute_force(spark):
    assert found(spark, DOCS, ITEMS) == brute(DOCS, ITEMS, 20)


def test_ties_and_top(spark):
    assert found(spark, DOCS, ITEMS, top=2) == brute(DOCS, ITEMS, 2)


def test_blocks_of_items_give_the_same(spark):
    assert found(spark, DOCS, ITEMS, block_terms=4) == brute(DOCS, ITEMS, 20)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == [] and found(spark, DOCS, []) == [] and found(spark, [(1, None, 2)], ITEMS) == []


def test_scores_in_small_steps(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 3)  # goes along with the function
    assert found(spark, DOCS, ITEMS) == brute(DOCS, ITEMS, 20)


def test_best_keeps_smallest_ids_among_equal_scores():
    import numpy as np

    best = lexical_search._Best(2)
    for doc in (9, 3, 5, 1):
        best.add(np.array([0]), np.array([doc]), np.array([10]))
    assert best.doc.tolist() == [1, 3] and best.floor(2).tolist() == [10, 1]
