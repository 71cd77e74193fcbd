"""Secret scanning with a random forest that removes false positives.

Candidates are the whole values, quoted or up to the next space, that follow a credential's name,
whatever their characters; and elsewhere runs of ``CANDIDATE`` with a digit, or of 16 characters
with two capitals. Between name and value may stand a closing quote, ``=``, ``:``, ``=>`` or ``:=``,
a scheme word (Bearer, Basic, Token) and an opening quote. The forest judges candidates by length, make-up,
character transitions, dictionary coverage, whether they stand in a path or address, and the
words beside them. Transitions and dictionary are counted over all texts: transitions between
the characters of their letter words, and the ``DICTIONARY`` commonest words. Every word of
every text counts; a task adds up to ``HELD_WORDS`` distinct words before it passes them on.

The tables hold no labelled findings, so ``silver`` labels them: provider formats and values
assigned to a credential's name are secrets, unless they look like a placeholder or an unquoted
short word; other candidates are not. The forest doesn't see which rule fired, only the value and its surroundings,
so it can overrule a label. A table of labelled
findings (doc_id, start, secret) takes its place where given. The forest is fitted on at most
``sample_rows`` findings, half of them of each label (smallest hashes), so that rare secrets are
always among them; weights make up for the share that is taken of a label. Scanning and counting
cover all rows and whole texts.

Defined results: null text has no candidates; where all labels are of one kind there is nothing
to learn, and that kind is the probability, 0 or 1, of every finding; repeated rows give their
findings each; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import SHARES, drop_tables, sampled, text_tie, written

SAMPLE_ROWS, DICTIONARY, NEIGHBOURS, HELD_WORDS = 20_000, 20_000, 2_000, 50_000
CANDIDATE = r"[A-Za-z0-9_+/.@\-]{8,}={0,2}"
MASK = "[secret]"
_CANDIDATE, _DIGIT, _WORD = re.compile(CANDIDATE), re.compile(r"\d"), re.compile(r"[A-Za-z]{3,}")
_UPPERS = re.compile("[A-Z].*[A-Z]")
_BESIDE = re.compile(r"\w+|[=:\"'/@#]")
_SIGN = re.compile(r"[=:]")
_NAME = re.compile(
    r"(?i)(?:(pass(?:word|wd|phrase|code)|(?<![a-z])pass|pwd)|secret|token|credentials?|(?:api|access|private|auth|signing|encryption)[_\- ]?key"
    r"|(?<![a-z])auth(?:orization)?)(?:[_.\-][\w.\-]*|\d+)?[\"'`]?\s*$"
)
_VALUE = re.compile(r"(?i)[=:>]{0,2}\s*(?:(?:bearer|basic|token)\s+)?(?:([\"'`])((?:(?!\1)[^\n\\]|\\.)*)\1|(\S+))")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token)\s+")
_AFTER = ".,;:)]}>\"'`"
LEAST_VALUE = 6
_PLACEHOLDER = re.compile(
    r"(?i)none|null|nil|true|false|undefined|required|optional|changeme|redacted|password|secret|token"
    r"|(.)\1*|<.*|\[.*|\$\{?\w*\}?.{0,2}|\{\{?.*|%.*%|(?:os\.|process\.|env\.|self\.|config\.|settings\.|getenv).*|\w+(?:\.\w+)*\(.*"
)
_PROVIDER = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}")
#: Character classes for transitions: letters, digits each as one, upper case as one, others.
CLASSES = 30
_CLASS = np.full(128, 29, np.int64)
_CLASS[ord("a") : ord("z") + 1] = range(26)
_CLASS[ord("A") : ord("Z") + 1] = 26
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[[ord(c) for c in "-_/.+@="]] = 28
FEATURES = [
    "length", "digits", "uppers", "marks", "hex", "entropy", "transitions", "coverage", "in_path",
    "before_1", "before_2", "after_1",
]
SCAN = (
    "kind string, doc_id long, tie binary, start int, end int, value string, assigned boolean, in_path boolean,"
    " before_1 string, before_2 string, after_1 string, word string, n long, counts array<long>"
)
_SCAN = pa.schema([
    ("kind", pa.string()), ("doc_id", pa.int64()), ("tie", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
    ("assigned", pa.bool_()), ("in_path", pa.bool_()), ("before_1", pa.string()), ("before_2", pa.string()), ("after_1", pa.string()),
    ("word", pa.string()), ("n", pa.int64()), ("counts", pa.list_(pa.int64())),
])
KEPT = ["doc_id", "tie", "start", "end", "value", "label"]


def assigned_values(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, quoted) of values that follow a credential's name, in order, without overlaps."""
    after = 0
    for m in _SIGN.finditer(text):
        if m.start() < after:
            continue
        name = _NAME.search(text[max(0, m.start() - 80) : m.start()])
        found = name and _VALUE.match(text, m.end())
        if not found:
            continue
        quoted = found[1] is not None
        start, end = found.span(2 if quoted else 3)
        if quoted:
            scheme = _SCHEME.match(text, start, end)
            start = scheme.end() if scheme else start
            if not name[1] and re.search(r"\s", text[start:end]):
                continue  # a sentence; only passwords hold spaces
        else:
            end = start + len(text[start:end].rstrip(_AFTER))
            start = end - len(text[start:end].lstrip("\"'`"))
        if end - start >= LEAST_VALUE:
            yield start, end, quoted
            after = end


def candidates(text: str) -> Iterator[dict]:
    """Candidates of one text with what stands beside them; positions are code points."""
    named = list(assigned_values(text))
    for start, end, quoted in named:
        yield _candidate(text, start, end, text[start:end], likely(text[start:end], quoted))
    starts, ends = [x[0] for x in named], [x[1] for x in named]
    for m in _CANDIDATE.finditer(text):
        value = m.group().rstrip(".")
        if len(value) < 8 or not (_DIGIT.search(value) or (len(value) >= 16 and _UPPERS.search(value))):
            continue
        start, end = m.start(), m.start() + len(value)
        if bisect_right(ends, start) == bisect_left(starts, end):  # overlaps no value above
            yield _candidate(text, start, end, value, False)


def _candidate(text: str, start: int, end: int, value: str, assigned: bool) -> dict:
    head, tail = text[max(0, start - 80) : start], text[end : end + 40]
    beside, after = _BESIDE.findall(head.lower()), _BESIDE.findall(tail.lower())
    return {
        "start": start, "end": end, "value": value, "assigned": assigned,
        "in_path": "/" in value or head.endswith(("/", "\\")) or "://" in head.rsplit(" ", 1)[-1],
        "before_1": beside[-1] if beside else "", "before_2": beside[-2] if len(beside) > 1 else "", "after_1": after[0] if after else "",
    }


def likely(value: str, quoted: bool) -> bool:
    """Whether a value behind a credential's name may be one: no placeholder, no plain word of a sentence."""
    if _PLACEHOLDER.fullmatch(value):
        return False
    return quoted or len(value) >= 16 or not value.isalpha()


def silver(value: str, assigned: bool) -> bool:
    return bool(_PROVIDER.fullmatch(value)) or (assigned and bool(re.search(r"[^\W\d_]", value)))


def _classes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.where(raw < 128, _CLASS[np.minimum(raw, 127)], 29)


def transition_counts(text: str) -> np.ndarray:
    """Transitions between character classes inside the letter words of a text."""
    classes = _classes(text)
    letters = classes < 27
    pairs = (classes[:-1] * CLASSES + classes[1:])[letters[:-1] & letters[1:]]
    return np.bincount(pairs, minlength=CLASSES * CLASSES)


def _word_rows(words: Counter) -> pa.RecordBatch:
    columns = {"kind": ["word"] * len(words), "word": list(words), "n": list(words.values())}
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(words), f.type) for f in _SCAN]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCAN)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates, and at the end of the task its counts."""
    transitions, words = np.zeros(CLASSES * CLASSES, np.int64), Counter()
    for batch in batches:
        found = []
        for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text = text.as_py()
            found += [{"kind": "candidate", "doc_id": doc_id, "tie": tie} | c for c in candidates(text)]
            transitions += transition_counts(text)
            words.update(_WORD.findall(text.lower()))
            if len(words) > HELD_WORDS:
                yield _word_rows(words)
                words.clear()
        yield pa.RecordBatch.from_pylist(found, schema=_SCAN)
    yield _word_rows(words)
    yield pa.RecordBatch.from_pylist([{"kind": "transitions", "counts": transitions.tolist()}], schema=_SCAN)


def _features(transitions: np.ndarray, dictionary: set[str], neighbours: dict[tuple[str, str], float]):
    table = transitions.reshape(CLASSES, CLASSES) + 1.0
    logs = np.log(table / table.sum(axis=1, keepdims=True))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                v, n = r["value"], len(r["value"])
                classes = _classes(v)
                counts = np.array(list(Counter(v).values())) / n
                rows.append((
                    n, sum(c.isdigit() for c in v) / n, sum(c.isupper() for c in v) / n, sum(not c.isalnum() for c in v) / n,
                    float(bool(re.fullmatch("[0-9a-fA-F]+", v))), float(-(counts * np.log2(counts)).sum()),
                    float(logs[classes[:-1], classes[1:]].mean()), sum(len(w) for w in _WORD.findall(v.lower()) if w in dictionary) / n,
                    float(r["in_path"]),
                    *(neighbours.get((c, r[c]), 0.0) for c in ("before_1", "before_2", "after_1")),
                ))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FEATURES)
            arrays = [batch.column(c) for c in KEPT] + [pa.array(c, pa.float64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, [*KEPT, *(f"f_{c}" for c in FEATURES)])

    return features


def scan(docs: DataFrame, labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(doc_id, tie, start, end, value, p_secret, is_secret)`` of every candidate."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_tie().alias("tie"), text.alias("text"))
    scanned = written(rows.mapInArrow(_scan, SCAN), "scan")
    found = scanned.where("kind = 'candidate'")
    words = written(scanned.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n")), "words")
    dictionary = {r.word for r in commonest(words, DICTIONARY).select("word").collect()}  # DICTIONARY rows
    cells = scanned.where("kind = 'transitions'").select(F.posexplode("counts").alias("cell", "n"))
    transitions = np.zeros(CLASSES * CLASSES)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # CLASSES squared rows
        transitions[r.cell] = r.n

    is_silver = F.pandas_udf("int")(
        lambda value, assigned: pd.Series([int(silver(v, a)) for v, a in zip(value, assigned, strict=True)], dtype="int32")
    )
    if labelled is None:
        found = found.withColumn("label", is_silver("value", "assigned"))
    else:
        marks = labelled.select("doc_id", "start", F.col("secret").cast("int").alias("label")).dropDuplicates(["doc_id", "start"])
        found = found.join(marks, ["doc_id", "start"], "left")
    found, made = written(found, "findings"), scanned
    drop_tables(made, words)
    totals = {r.label: r.n for r in found.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [sampled(found.where(F.col("label") == k), n, sample_rows // 2, ["doc_id", "start", "value"]) for k, n in totals.items()]
    sample = written(reduce(DataFrame.union, parts, found.limit(0)), "labelled")  # the documented bound
    share = sample.agg(F.avg("label")).first()[0]
    enough = len(totals) == 2
    neighbours = _neighbours(sample, share) if enough else {}
    numbers = ", ".join(f"f_{c} double" for c in FEATURES)
    kept = "doc_id long, tie binary, start int, end int, value string, label int"
    describe = _features(transitions, dictionary, neighbours)
    columns = [*KEPT, "in_path", "before_1", "before_2", "after_1"]
    as_rows = lambda df: df.select(columns).mapInArrow(describe, f"{kept}, {numbers}")
    result = ["doc_id", "tie", "start", "end", "value"]
    if not enough:
        p = F.coalesce(F.col("label").cast("double"), F.lit(float(share or 0)))
        return found.select(*result, p.alias("p_secret"), (p > 0.5).alias("is_secret"))
    assemble = VectorAssembler(inputCols=[f"f_{c}" for c in FEATURES], outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=40, maxDepth=6, seed=7)
    taken = {k: min(n, sample_rows // 2) for k, n in totals.items()}
    weight = F.when(F.col("label") == 1, totals[1] / taken[1]).otherwise(totals[0] / taken[0])
    model = forest.fit(assemble.transform(written(as_rows(sample), "labelled-features")).withColumn("weight", weight))
    judged = model.transform(assemble.transform(as_rows(found)))
    p = vector_to_array("probability")[1]
    return judged.select(*result, p.alias("p_secret"), (p > 0.5).alias("is_secret"))


def commonest(words: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the commonest rows of the written table ``words(word, n)``, without a sort.

    The cut is read off a histogram of the counts (7 significant bits, so a few thousand rows at most); of the counts
    at the cut a share by hash makes up the number.
    """
    shift = "greatest(length(bin(n)) - 7, 0)"
    rounded = words.withColumn("about", F.expr(f"shiftleft(shiftright(n, {shift}), {shift})"))
    left, cut, share = most, 0, 0.0
    for r in sorted(rounded.groupBy("about").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.about):
        if r.words > left:
            cut, share = r.about, left / r.words
            break
        left -= r.words
    at_cut = (F.col("about") == cut) & (F.pmod(F.xxhash64("word"), F.lit(SHARES)) < int(share * SHARES))
    return rounded.where((F.col("about") > cut) | at_cut)


def _neighbours(sample: DataFrame, share: float) -> dict[tuple[str, str], float]:
    """How much a word beside a finding speaks for a secret, in log-odds; the commonest NEIGHBOURS words."""
    beside = F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("word")) for c in ("before_1", "before_2", "after_1")])
    counts = sample.select("label", F.inline(beside)).groupBy("side", "word").agg(F.count("*").alias("n"), F.sum("label").alias("yes"))
    top = counts.where("n >= 3").orderBy(F.desc("n"), "side", "word").limit(NEIGHBOURS).collect()
    prior = math.log(share / (1 - share))
    return {(r.side, r.word): math.log((r.yes + share) / (r.n - r.yes + 1 - share)) - prior for r in top}


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``findings`` replaced by ``MASK``; ``n_chars`` follows where there is one."""
    spans = findings.where("is_secret").groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    spans = written(spans, "secret-spans").select(F.struct("doc_id", "tie").alias("of"), "spans")
    keyed = docs.withColumn("keyed", F.struct("doc_id", text_tie().alias("tie")))
    joined = keyed.join(spans, F.col("keyed") == F.col("of"), "left")

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans, strict=True):
            for x in reversed(found if found is not None else []):
                t = t[: x["start"]] + MASK + t[x["end"] :]
            out.append(t)
        return pd.Series(out, dtype=object)

    out = joined.withColumn("text", F.when(F.col("spans").isNotNull(), masked("text", "spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
