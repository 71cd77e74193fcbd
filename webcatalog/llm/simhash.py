"""SimHash near-duplicates by meet-in-the-middle ball hashing.

``fingerprints`` gives each text 64 bits: A-Z are lowered, words are runs outside ASCII white
space, and every 3-word shingle (repeats included) votes with its XXH64 under seed 42.

``ball_links`` finds all pairs of distinct fingerprints within three bits. Three differing
bits leave at least one 32-bit half with at most one, half the radius. Each fingerprint
therefore sends, for either half, the half itself and its 32 one-bit variants; fingerprints
that meet on a variant are compared in full. Rows grow with the fingerprints (66 each) and
never with the square of a group: equal fingerprints are one class before that, and a half
that many fingerprints share is first divided by the ball of the remaining bits (``_narrow``).

Defined results: null text counts as empty; a text without words has fingerprint zero and is
linked like any other; repeated rows share a class; a null doc_id keeps its row and joins the
class of its text, but never names it unless the class has no other id. Extra columns of the
input are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import drop_tables, text_tie, whole_text, written
from webcatalog.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; of all words where there are fewer."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    shingles = [joined[s:e] for s, e in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of one text."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    votes = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], ["doc_id", "tie", "bits"])


def _tie():
    return F.xxhash64(whole_text())


def fingerprints(docs: DataFrame, wide: bool = False) -> DataFrame:
    """``(doc_id, tie, bits)`` of every row: ``tie`` the text's hash (SHA-256 if ``wide``), ``bits`` the fingerprint as a signed long."""
    tie, kind = (text_tie(), "binary") if wide else (_tie(), "long")
    return docs.select("doc_id", tie.alias("tie"), "text").mapInArrow(_fingerprints, f"doc_id long, tie {kind}, bits long")


def _half(bits: str, side: int) -> str:
    return f"shiftrightunsigned({bits}, 32)" if side else f"({bits} & 4294967295)"


def _close(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def ball_links(classes: DataFrame, group_limit: int = 512) -> DataFrame:
    """``(a, b)`` with a < b for distinct fingerprints (column ``bits``) within three bits.

    A pair may be listed once for each variant on which it meets. Halves that more than
    ``group_limit`` fingerprints share go through ``_narrow``; both ways find every pair.
    """
    halves = F.array(*[F.struct(F.lit(s).alias("side"), F.expr(_half("bits", s)).alias("half")) for s in (0, 1)])
    own = classes.select("bits", F.inline(halves))
    own = own.select("bits", "half", F.expr("side * 4294967296L + half").alias("key"))
    big = written(own.groupBy("key").count().where(F.col("count") > group_limit).select("key"), "halves")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    ball_of = own.select(F.col("bits").alias("b"), "key", F.explode(ball).alias("flip"))
    ball_of = ball_of.select("b", F.col("key").bitwiseXOR(F.col("flip")).alias("key"))
    # Spark can't tell how many rows a ball has: without the hint it may broadcast them all.
    meet = own.select(F.col("bits").alias("a"), "key").join(ball_of.join(big, "key", "left_anti").hint("merge"), "key")
    direct = meet.where((F.col("a") != F.col("b")) & _close("a", "b")).select("a", "b")
    found = direct.union(_narrow(own, big, ball))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _narrow(own: DataFrame, big: DataFrame, ball) -> DataFrame:
    """Pairs that meet on a crowded half.

    Their other halves differ by three bits at most, so one 16-bit quarter of them differs by
    one at most: those that meet on the half are met again on the ball of that quarter.
    """
    around = big.select(F.col("key").alias("hub"), F.explode(ball).alias("flip"))
    around = around.select("hub", F.col("hub").bitwiseXOR(F.col("flip")).alias("key"))
    other = "CASE WHEN hub < 4294967296L THEN shiftrightunsigned(bits, 32) ELSE bits & 4294967295 END"
    quarters = "array(named_struct('q', 0, 'part', other & 65535), named_struct('q', 1, 'part', shiftrightunsigned(other, 16)))"

    def parts(rows: DataFrame) -> DataFrame:
        return rows.withColumn("other", F.expr(other)).select("hub", "bits", F.inline(F.expr(quarters)))

    left = parts(own.join(big.select("key", F.col("key").alias("hub")), "key"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(16)])
    right = parts(own.join(around, "key")).withColumn("flip", F.explode(flips))
    right = right.select("hub", "q", F.col("part").bitwiseXOR(F.col("flip")).alias("part"), F.col("bits").alias("b"))
    meet = left.withColumnRenamed("bits", "a").join(right.hint("merge"), ["hub", "q", "part"])
    return meet.where((F.col("a") != F.col("b")) & _close("a", "b")).select("a", "b")


def _grouped(marks: DataFrame, group_limit: int) -> DataFrame:
    """``marks`` with ``component``, a fingerprint, and ``component_id``."""
    classes = marks.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    found = components(ball_links(classes.select("bits"), group_limit))
    named = classes.join(found.withColumnRenamed("node", "bits"), "bits", "left")
    named = named.withColumn("component", F.coalesce("component", "bits"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(names, "component").select("bits", "component", "component_id")
    return marks.join(named, "bits")


def near_duplicates(docs: DataFrame, group_limit: int = 512) -> DataFrame:
    """``(doc_id, tie, bits, component_id, kept)`` for every row of ``docs``."""
    grouped = _grouped(written(fingerprints(docs), "fingerprints"), group_limit)
    return grouped.select("doc_id", "tie", "bits", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first_of_each(docs: DataFrame, group_limit: int = 512) -> DataFrame:
    """``docs`` with one row for each component: the one of its smallest doc_id, null last.

    Of rows with that doc_id the one with the smallest digest of the text stays, once. Texts are exchanged once: a
    struct is never null and the nulls inside compare equal, so its two steps share an exchange.
    """
    marks = written(fingerprints(docs, wide=True), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    first = _grouped(marks, group_limit).groupBy("component").agg(F.min(rank).alias("r"))
    first = written(first.select(F.struct("r.doc_id", "r.tie").alias("first")), "first-of-each")
    drop_tables(marks)
    once = docs.withColumn("of", F.struct("doc_id", text_tie().alias("tie"))).join(first, F.col("of") == F.col("first"), "left_semi")
    return once.dropDuplicates(["of"]).select(docs.columns)
