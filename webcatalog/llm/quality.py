"""Quality rules with thresholds that adapt to each language and source.

A first pass measures whole texts. Its measures, as whole numbers, go into quantile sketches:
counts of log-linear buckets (``bucket``: the six bits after the leading one are kept, so a
bucket's floor is within 1/64 of its values). Sketches merge by adding counts, in any order and
with equal results; they are built for each (language, source), merged for the language and
again for all, and the most specific one with ``MIN_ROWS`` rows sets the thresholds: quartiles
widened by ``REACH`` times their distance, or by a floor where the group hardly varies. The
thresholds are then joined back to the measures.

Defined results: null text has no words, a text without words fails the base rule; null
language or source is a group of its own; repeated rows are measured and returned each;
further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import written

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_ROWS = 200
REACH = 3
#: Measures: SQL, the least spread a group is credited with, whether low values fail too.
MEASURES = {
    "word_length": ("100 * word_chars div n_words", 40, True),
    "symbols": ("10000 * n_symbols div word_chars", 100, False),
    "duplicate_lines": ("10000 * n_dup_lines div n_words", 100, False),
    "repeats": ("10000 * n_repeat_words div n_words", 1000, False),
    "stutter": ("10000 * n_stutters div n_words", 300, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included.

    Windows are named exactly: names of twice the length number the pairs of shorter names.
    """
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    size = 1
    while size < window:
        step = min(size, window - size)
        pairs = names[: len(names) - step] * (len(words) + 1) + names[step:]
        names = np.unique(pairs, return_inverse=True)[1]
        size += step
    repeats = np.flatnonzero(np.bincount(names)[names] > 1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, repeats, 1)
    np.add.at(covered, repeats + window, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of one text; words end at ASCII white space, a stutter is a word equal to the one before."""
    raw = (text or "").encode()
    words = raw.split()
    chars = sum(map(len, map(bytes.decode, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    stutters = sum(map(eq, words, words[1:]))
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), stutters


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t.as_py()) for t in batch.column(3)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(COUNTS)
        arrays = [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", *COUNTS])


def measures(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, COUNTS, base_failed)``, each text read whole and once."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    found = docs.select("doc_id", "lang", "source", "text").mapInArrow(_measures, schema)
    return found.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def bucket(value: Column) -> Column:
    """Floor of the sketch bucket of a whole number from 0 on."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts ``(level, lang, source, measure, bucket, n)`` of rows that pass the base rule."""
    each = F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(F.expr(sql)).alias("bucket")) for m, (sql, _, _) in MEASURES.items()
    ])
    rows = measured.where("NOT base_failed").select("lang", "source", F.inline(each))
    finest = written(rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n")), "sketches")
    by_lang = finest.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    columns = ("level", "lang", "source", "measure", "bucket", "n")
    return (
        finest.withColumn("level", F.lit(0)).select(*columns)
        .union(by_lang.withColumns({"level": F.lit(1), "source": none}).select(*columns))
        .union(overall.withColumns({"level": F.lit(2), "lang": none, "source": none}).select(*columns))
    )


def thresholds(measured: DataFrame) -> DataFrame:
    """``(level, lang, source, rows, low_*, high_*)`` for every sketched group."""
    marks = sketches(measured).selectExpr(
        "*",
        "sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto",
        "sum(n) OVER (PARTITION BY level, lang, source, measure) AS rows",
    )
    quartiles = marks.groupBy("level", "lang", "source", "measure").agg(
        F.max("rows").alias("rows"),
        F.expr("min(CASE WHEN 4 * upto >= rows THEN bucket END)").alias("q1"),
        F.expr("min(CASE WHEN 4 * upto >= 3 * rows THEN bucket END)").alias("q3"),
    )
    limits = []
    for m, (_, floor, _) in MEASURES.items():
        span = f"{REACH} * greatest(q3 - q1, {floor})"
        limits += [F.expr(f"max(CASE WHEN measure = '{m}' THEN q1 - {span} END)").alias(f"low_{m}"),
                   F.expr(f"max(CASE WHEN measure = '{m}' THEN q3 + {span} END)").alias(f"high_{m}")]
    return quartiles.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *limits)


def judge(docs: DataFrame) -> DataFrame:
    """``(doc_id, COUNTS, base_failed, kept, level)``; ``level`` tells whose thresholds applied."""
    measured = written(measures(docs), "measures")
    limits = written(thresholds(measured), "thresholds").withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    names = [f"{side}_{m}" for m in MEASURES for side in ("low", "high")]
    chosen = measured
    for level in (0, 1, 2):
        rows = limits.where((F.col("level") == level) & ((F.col("rows") >= MIN_ROWS) | (F.lit(level) == 2)))
        rows = rows.select("of_lang", "of_source", F.struct("level", *names).alias(f"limits_{level}"))
        match = F.lit(True)
        if level < 2:
            match = F.col("lang").eqNullSafe(F.col("of_lang"))
        if level < 1:
            match = match & F.col("source").eqNullSafe(F.col("of_source"))
        # Level 2 is a single row.
        chosen = chosen.join(F.broadcast(rows) if level == 2 else rows, match, "left").drop("of_lang", "of_source")
    chosen = chosen.withColumn("limits", F.coalesce("limits_0", "limits_1", "limits_2"))
    inside = F.lit(True)
    for m, (sql, _, both) in MEASURES.items():
        inside = inside & (F.expr(sql) <= F.col(f"limits.high_{m}"))
        if both:
            inside = inside & (F.expr(sql) >= F.col(f"limits.low_{m}"))
    return chosen.select(
        "doc_id", *COUNTS, "base_failed",
        F.when(F.col("base_failed"), False).otherwise(inside).alias("kept"), F.col("limits.level").alias("level"),
    )
