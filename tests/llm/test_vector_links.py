from __future__ import annotations

import numpy as np

from webcatalog.llm import vector_links
from webcatalog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def slow(rows, threshold=0.93):
    """{vec_id: (n_links, component_id)} with all pairs."""
    usable = [
        (i, np.array(e, float), l) for i, e, l in rows
        if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
    ]
    links = {i: set() for i, *_ in rows}
    for a in range(len(usable)):
        for b in range(a):
            (i, x, l), (j, y, m) = usable[a], usable[b]
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in sorted(links):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = (len(links[i]), min(seen))
    return out


def test_query_against_brute_force(spark):
    rows = QUERIES["op8_vector_links"](spark, FOLDER).collect()
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    want = slow([(r.vec_id, r.embedding, r.label) for r in table])
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((1000, 48))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n = rng.standard_normal(a.shape)
    n -= (n * a).sum(1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    b = 0.9301 * a + np.sqrt(1 - 0.9301**2) * n
    found = vector_links.links_in_tile(a, b, 0.93)
    assert np.diag(found).mean() > 0.99
    assert not (found & (a @ b.T < 0.93 - 1e-12)).any()


def test_forest_spans():
    links = np.zeros((4, 5), bool)
    links[0, [1, 2]] = links[1, 2] = links[3, 4] = True
    assert sorted(vector_links.forest(links)) == [(0, 1), (0, 2), (1, 2), (3, 4)]


def test_edges_and_small_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 8))
    rows = [(k, (base[k % 6] + 0.05 * rng.standard_normal(8)).tolist(), k % 2) for k in range(120)]
    rows += [(200 + k, base[0].tolist(), 0) for k in range(30)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [nan] * 8, [inf] * 8, [1.0] * 3, [2.0] * 3, [1.0] * 8]
    rows += [(300 + k, e, 1) for k, e in enumerate(odd)] + [(400, base[0].tolist(), None)]
    table = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    got = vector_links.link(table.repartition(4)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == slow(rows)
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [3.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in vector_links.link(twice).collect())[1:] == [(1, 1, 1), (1, 1, 1)]
    assert vector_links.link(table.limit(0)).count() == 0
