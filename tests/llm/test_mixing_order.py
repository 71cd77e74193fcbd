from __future__ import annotations

from collections import Counter
from itertools import groupby

from webcatalog.llm import mixing
from webcatalog.llm.common import written


def test_stage_keeps_the_order_of_the_mixture(spark):
    rows = [(k, f"w{k} " * 900, s) for k, s in enumerate(["a"] * 400 + ["b"] * 90)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string")
    mixed = mixing.mix(written(mixing.sizes(docs), "sizes"), repetition_limit=3.0).collect()
    got = [r.doc_id for r in mixing.realise(docs, repetition_limit=3.0).collect()]
    assert len({r.mix_order for r in mixed}) > 5 and len(got) == len(mixed)
    at = 0
    for _, rows_of in groupby(sorted(mixed, key=lambda r: r.mix_order), key=lambda r: r.mix_order):
        want = Counter(r.doc_id for r in rows_of)
        assert Counter(got[at : at + want.total()]) == want
        at += want.total()
