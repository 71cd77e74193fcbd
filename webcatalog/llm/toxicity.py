"""Toxicity by a classifier chain.

Categories are label columns with 0 and 1, predicted in turn by linear (logistic) models. The
model of a category also sees the probabilities of the categories before it: in training those
are out-of-fold predictions, so that it learns how far they can be trusted; in use they come
from the models fitted on the whole sample.

Texts are sets of features: lower-case words and their first four to six letters, which catch
inflected forms. The features that separate the labels best (chi-square of each category,
counted over the sample in Spark) are kept, ``FEATURES`` at most.

Bounds, both parameters: the models are fitted on the driver from ``sample_rows`` labelled documents
(the smallest hashes of doc_id) and ``features`` features. Everything else covers all rows,
whole texts, without a shuffle.

Defined results: a doc_id of several label rows has the largest label of each category, and of several
texts the one with the smallest SHA-256 teaches; null text has no features; rows with a null label do not teach that
category; a category with one label value only gets that value's share as its probability, and
0 without labels; repeated rows are scored alike; columns named like the results are replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import drop_tables, sampled, written

SAMPLE_ROWS, FEATURES, FOLDS = 20_000, 768, 4
STEMS = (4, 5, 6)
MIN_DOCUMENTS = 3
RIDGE, STEPS = 0.1, 80
_WORD = re.compile(r"\w+")


def features_of(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    stems = {f"{w[:n]}*" for n in STEMS for w in words if len(w) > n}
    return words | stems


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """A logistic model over present features and dense inputs."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def predict(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        return _sigmoid(rows.times(self.weights) + dense @ self.dense + self.bias)


class Rows:
    """Sets of feature numbers: row k holds ``index[cuts[k]:cuts[k + 1]]``."""

    def __init__(self, sets: Sequence[Sequence[int]]) -> None:
        self.count = len(sets)
        self.index = np.fromiter((i for s in sets for i in s), np.int64)
        self.row = np.repeat(np.arange(self.count), [len(s) for s in sets])

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.index], self.count)

    def transposed(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, values[self.row], size)


def fit_linear(rows: Rows, dense: np.ndarray, target: np.ndarray, use: np.ndarray, size: int) -> Linear:
    """Ridge-penalised logistic regression on the rows in ``use``, by accelerated gradient steps."""
    n = max(1, int(use.sum()))
    share = float(target[use].mean()) if use.any() else 0.0
    if share in (0.0, 1.0):
        return Linear(np.zeros(size), np.zeros(dense.shape[1]), 30.0 if share else -30.0)
    w, d, b = np.zeros(size), np.zeros(dense.shape[1]), float(np.log(share / (1 - share)))
    at = (w, d, b)
    rate = 4.0
    for step in range(1, STEPS + 1):
        error = np.where(use, _sigmoid(rows.times(at[0]) + dense @ at[1] + at[2]) - target, 0.0) / n
        new = (
            at[0] - rate * (rows.transposed(error, size) + RIDGE / n * at[0]),
            at[1] - rate * (error @ dense),
            at[2] - rate * float(error.sum()),
        )
        pull = (step - 1) / (step + 2)
        at = tuple(x + pull * (x - y) for x, y in zip(new, (w, d, b), strict=True))
        w, d, b = new
    return Linear(w, d, b)


@dataclass
class Chain:
    """Fitted models of ``categories`` in order, and the threshold of each."""

    categories: list[str]
    numbers: dict[str, int]
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, sets: Sequence[Sequence[int]]) -> np.ndarray:
        rows = Rows(sets)
        found = np.zeros((rows.count, 0))
        for model in self.models:
            found = np.column_stack([found, model.predict(rows, found)])
        return found

    def numbers_of(self, text: str | None) -> list[int]:
        get = self.numbers.get
        return [i for f in features_of(text) if (i := get(f)) is not None]


def fit_chain(numbers: dict[str, int], categories: list[str], sets: list[list[int]], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """``labels``: a column for each category, NaN where unknown."""
    chain, rows = Chain(categories, numbers), Rows(sets)
    size = max(1, len(numbers))
    dense = np.zeros((rows.count, 0))
    for k in range(len(categories)):
        known = ~np.isnan(labels[:, k])
        target = np.nan_to_num(labels[:, k])
        held_out = np.zeros(rows.count)
        for fold in range(FOLDS):
            model = fit_linear(rows, dense, target, known & (folds != fold), size)
            held_out = np.where(folds == fold, model.predict(rows, dense), held_out)
        chain.models.append(fit_linear(rows, dense, target, known, size))
        chain.thresholds.append(best_threshold(held_out[known], target[known]))
        dense = np.column_stack([dense, held_out])
    return chain


def best_threshold(scores: np.ndarray, target: np.ndarray) -> float:
    """The middle, in log-odds, of the best F1 range over held-out scores; 0.5 without both labels."""
    if not 0 < target.sum() < len(target):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(target[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + target.sum())
    best = int(np.argmax(f1))
    low = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    ends = np.clip([scores[order[best]], low], 1e-9, 1 - 1e-9)
    return float(_sigmoid(np.log(ends / (1 - ends)).mean()))


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str],
    sample_rows: int = SAMPLE_ROWS, features: int = FEATURES,
) -> Chain:
    """Fit the chain. ``categories`` maps names, in chain order, to SQL over the columns of ``labels``."""
    names = list(categories)
    marks = labels.select("doc_id", *[F.expr(f"CAST({sql} AS DOUBLE)").alias(c) for c, sql in categories.items()])
    marks = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    marks = written(marks, "marks")
    sample = written(sampled(marks, marks.count(), sample_rows, ["doc_id"]), "sample")  # the documented bound
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.sha2("text", 256).alias("digest"), "text")).alias("first"))
    texts = written(texts.select("doc_id", "first.text").join(F.broadcast(sample), "doc_id"), "texts")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.drop(columns=["doc_id", "text"])
            found["feature"] = [sorted(features_of(t)) for t in batch["text"]]
            yield found.explode("feature").dropna(subset=["feature"])

    schema = ", ".join(f"{c} double" for c in names)
    each = texts.mapInPandas(explode, f"{schema}, feature string")
    counts = each.groupBy("feature").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"pos_{c}") for c in names], *[F.count(c).alias(f"known_{c}") for c in names]
    )
    counts = written(counts.where(F.col("n") >= MIN_DOCUMENTS), "feature-counts")
    totals = sample.agg(*[F.sum(c).alias(f"pos_{c}") for c in names], *[F.count(c).alias(f"n_{c}") for c in names]).first()
    chosen: set[str] = set()
    for c in names:
        pos, n = totals[f"pos_{c}"] or 0.0, totals[f"n_{c}"]
        if not 0 < pos < n:
            continue
        expected = F.col(f"known_{c}") * (pos / n)
        score = F.pow(F.col(f"pos_{c}") - expected, F.lit(2)) / expected
        best = counts.where(F.col(f"known_{c}") > 0).orderBy(score.desc(), "feature").limit(features // len(names))
        chosen |= {r.feature for r in best.select("feature").collect()}
    numbers = {f: i for i, f in enumerate(sorted(chosen))}
    reader = Chain(names, numbers)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["numbers"] = [reader.numbers_of(t) for t in batch.pop("text")]
            yield batch

    rows = texts.mapInPandas(encode, f"doc_id long, {schema}, numbers array<long>").toPandas()  # one for each of the sample
    rows = rows.sort_values("doc_id")
    drop_tables(marks, sample, texts, counts)
    folds = (rows["doc_id"].to_numpy(np.int64) * 2654435761 >> 16) % FOLDS
    return fit_chain(numbers, names, [list(s) for s in rows["numbers"]], rows[names].to_numpy(float), folds)


def score(docs: DataFrame, chain: Chain, rejects: str) -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``rejected``: category ``rejects`` passes its threshold."""

    @F.pandas_udf("array<double>")
    def probabilities(texts: pd.Series) -> pd.Series:
        found = chain.probabilities([chain.numbers_of(t) for t in texts])
        return pd.Series(list(found))

    scored = docs.drop(*[f"p_{c}" for c in chain.categories]).withColumn("chain_scores", probabilities("text"))
    for k, c in enumerate(chain.categories):
        scored = scored.withColumn(f"p_{c}", F.col("chain_scores")[k])
    limit = chain.thresholds[chain.categories.index(rejects)]
    return scored.withColumn("rejected", F.col(f"p_{rejects}") > limit).drop("chain_scores")
