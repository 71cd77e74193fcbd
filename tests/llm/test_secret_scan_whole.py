"""The parts of the secret scan that its first tests don't reach."""

from __future__ import annotations

import random
import re
import string
from collections import Counter

import pyarrow as pa

from webcatalog.llm import secret_scan
from webcatalog.llm.queries import QUERIES


def rare_secrets():
    rng = random.Random(8)
    mixed = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) + "7"
    rows = [(k, f"seen on 2024-0{k % 9 + 1}-1{k % 10} in report-{rng.randint(100, 999)}.txt") for k in range(1500)]
    rows += [(2000 + k, f"password={mixed(24)} here") for k in range(12)]
    return rows


def fits(monkeypatch):
    """Labels (no secret, secret) of each table that a forest is fitted on."""
    seen = []

    class Watched(secret_scan.RandomForestClassifier):
        def fit(self, table):
            counts = dict(table.groupBy("label").count().collect())
            seen.append((counts[0], counts[1]))
            return super().fit(table)

    monkeypatch.setattr(secret_scan, "RandomForestClassifier", Watched)
    return seen


def test_forest_is_fitted_where_secrets_are_few(spark, tmp_path, monkeypatch):
    seen = fits(monkeypatch)
    docs = spark.createDataFrame(rare_secrets(), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op9_secret_scan"](spark, str(tmp_path)).collect()
    assert len(seen) == 1 and seen[0][1] == 12
    assert {r.doc_id for r in rows if r.is_secret} == set(range(2000, 2012))


def test_rare_label_is_in_a_bounded_sample(spark, monkeypatch):
    seen = fits(monkeypatch)
    docs = spark.createDataFrame(rare_secrets(), "doc_id long, text string")
    found = secret_scan.scan(docs, sample_rows=100).collect()
    assert seen == [(50, 12)]
    assert {r.doc_id for r in found if r.is_secret} == set(range(2000, 2012))


def test_every_word_of_every_text_counts(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    monkeypatch.setattr(secret_scan, "HELD_WORDS", 50)  # words are passed on many times
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "tie": [b""] * 300, "text": texts})
    got = Counter()
    for out in secret_scan._scan(iter([batch])):
        for r in out.to_pylist():
            if r["kind"] == "word":
                got[r["word"]] += r["n"]
    assert got == Counter(re.findall("[a-z]{3,}", " ".join(texts)))


FORMS = [
    ('{{"password": "{}"}}', "hunter2!"), ('"api_key": "{}",', "q8Zr41xPLm"), ("'token': '{}'", "a9f3kk21bb"), ("api-key: {}", "zz91-kfmq-71"),
    ("pwd={}", "S3same!open"), ("Authorization: Bearer {}", "eyJhbGciOi.eyJzdWIi.s1gn-x"), ('password = "{}"', "correcthorsebatterystaple"),
    ("password={}", "Tr0ub4dor&3x!yz99"), ('client_secret => "{}"', "mnbvcxzasd"), ('"Authorization": "Bearer {}"', "abcDEF123456"), ('passphrase: "{}"', "correct hörse battery staple"),
]


def test_common_forms_are_found_whole_and_masked(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(len(FORMS) * 6):
        form, value = FORMS[k % len(FORMS)]
        rows.append((k, f"first line {rng.random()} " + form.format(value) + " and the rest"))
        want[k] = rows[-1][1].replace(value, "[secret]")
    rows += [(1000 + k, f"author: Someone{k}, the secret: nobody knows; password: required. See report-{k:04d}.txt") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_scan.scan(docs)
    texts = {r.doc_id: r.text for r in secret_scan.redact(docs, found).collect()}
    assert {k: texts[k] for k in want} == want
    assert all(texts[k] == t for k, t in rows if k >= 1000)


def test_values_and_ordinary_assignments():
    values = lambda t: [(t[s:e], secret_scan.likely(t[s:e], q)) for s, e, q in secret_scan.assigned_values(t)]
    for form, value in FORMS:
        assert values(form.format(value)) == [(value, True)]
    assert not any(ok for _, ok in values('password = os.environ["X"], token: None; secret: "${VAULT}" password=********'))
    assert values("author: Somebody compass: northwards authority=central") == []
    spans = [(c["start"], c["end"]) for c in secret_scan.candidates("password=Tr0ub4dor&3x!yz99 card 4041894974608795")]
    assert spans == [(9, 26), (32, 48)]
