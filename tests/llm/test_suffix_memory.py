from __future__ import annotations

import inspect
import random
import tracemalloc

import pyarrow as pa

from webcatalog.llm import suffix_dedup


def test_strings_of_a_trigger_stay_within_memory():
    rng = random.Random(1)
    batches = [
        pa.RecordBatch.from_pylist([
            {"fp": 1, "doc_id": k, "tie": 0, "start": 0, "a": 68, "content": rng.randbytes(168)} for k in range(n, n + 100)
        ]) for n in range(0, 500, 100)
    ]
    tracemalloc.start()
    assert sum(b.num_rows for b in suffix_dedup._suffixes(iter(batches))) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    limit = inspect.signature(suffix_dedup.repeated_spans).parameters["crowd_limit"].default
    assert peak / 500 * limit < 200e6
