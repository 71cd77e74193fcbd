from __future__ import annotations

import re

from webcatalog.llm import quality
from webcatalog.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def slow_measure(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    covered = set()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 8))
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(covered), sum(a == b for a, b in zip(words, words[1:]))


TEXTS = [
    None, "", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "é ü a\x0bb\x1cc", "l\nl\n\n \n \nl # | <",
    "one two three four five six seven eight nine one two three four five six seven eight", "a\r\nb\na\r\nb", "1 2 3 4 5 6 7 8 9 " * 3 + "z",
]


def test_measures_against_brute_force():
    for text in TEXTS:
        assert quality.measure(text) == slow_measure(text), text


def test_buckets_hold_their_values(spark):
    values = [0, 1, 63, 64, 127, 128, 129, 255, 256, 1000, 4095, 123_456_789]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bucket("v").alias("b")).collect()
    assert all(r.b <= r.v <= r.b * (1 + 1 / 64) for r in rows)
    assert [r.b for r in rows[:5]] == values[:5]


def test_query_matches_measures(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op4_quality"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_measure(texts[r.doc_id]) if len(texts[r.doc_id] or "") < 3000 else None
        if want:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_stutters) == want
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_kept_follows_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in QUERIES["op4_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert sum(good) > 0.93 * len(good) and sum(bad) < 0.2 * len(bad)


def test_groups_and_edges(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    text = lambda k: " ".join(words[(k + i * (1 + k % 3)) % 10] + str(i) for i in range(30))
    rows = [(k, text(k), "xx", "big", 1) for k in range(250)] + [(1000 + k, text(k), None, None, 1) for k in range(3)]
    rows += [(2000, " ".join(w + "###" for w in text(1).split()), "xx", "big", 1), (2001, None, "xx", "big", 1), (0, text(0), "xx", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rows int")
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[k].kept and by_id[k].level == 0 for k in range(250))
    assert all(by_id[1000 + k].kept and by_id[1000 + k].level == 2 for k in range(3))
    assert not by_id[2000].kept and not by_id[2000].base_failed and by_id[2001].base_failed
    assert quality.judge(docs.limit(0)).count() == 0
