"""Ranked lexical search by scanning documents with an Aho-Corasick automaton.

The terms of all items, each between boundary guards, form one automaton that is broadcast. A
scan folds a text's bytes (A-Z to a-z, separators to the guard) and reads term frequencies off
the automaton's outputs; documents are never indexed. The scan leaves narrow rows
``(doc_id, n, terms, tfs)``, from which Spark takes N, L and the document frequencies. A second
pass over those rows follows the outputs to the items that hold them and scores.

Blocks: an automaton holds the items of one block, ``BLOCK_TERMS`` term occurrences on average (or
one longer item), so that what is broadcast and what the driver reads is bounded; more items mean
more blocks, each with a scan of its own. Every task keeps ``top`` documents for each item of its block
and sends only those; ranking them takes two steps, within salted parts of an item and over them.

Scores are exact: 64-bit integers throughout (numpy's int64 wraps nowhere below 2**63).

Defined results: a null text has no terms and isn't counted; an item without terms (or whose terms no
document holds) has no rows; every row of ``items`` is an item and every row of ``docs`` a document, also
with equal or null ids; documents with null ids come last among equal scores; columns beside ids and text
are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webcatalog.llm.common import drop_tables, written

TOP = 20
BLOCK_TERMS = 200_000
#: Cells of the table of scores that a task fills at once.
CELLS = 2_000_000
SALTS = 32

GUARD = b" "
#: Every byte of a text as it counts: A-Z in lower case, separators as the guard, the rest as it is.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)

SCANNED = "doc_id long, n long, terms array<int>, tfs array<long>"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Outputs the position of each term that stands between guards. Bytes are taken as Latin-1."""
    built = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        built.add_word((GUARD + term + GUARD).decode("latin-1"), k)
    built.make_automaton()
    return built


def scan(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of every document that has a term at all (n of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            ids, sizes, found, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = (text or b"").translate(FOLD)
                n = len(folded.split())
                if n:
                    tf = Counter(k for _, k in machine.iter((GUARD + folded + GUARD).decode("latin-1")))
                    ids.append(doc_id)
                    sizes.append(n)
                    found.append(list(tf))
                    times.append(list(tf.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(count, SCANNED)


class _Best:
    """The best ``top`` documents of each item so far, as three aligned columns."""

    def __init__(self, top: int):
        self.top = top
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def floor(self, items: int) -> np.ndarray:
        """What a document must reach to matter to each item: 1, or the score of the last of ``top``."""
        counts = np.bincount(self.item, minlength=items)
        low = np.full(items, np.iinfo(np.int64).max)
        np.minimum.at(low, self.item, self.score)
        return np.where(counts >= self.top, low, 1)

    def add(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        item, doc, score = (np.concatenate(x) for x in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        first = np.searchsorted(item, item, side="left")
        keep = np.arange(len(item)) - first < self.top
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]


def best_documents(scanned: DataFrame, weight: np.ndarray, held: tuple[np.ndarray, np.ndarray], items: int, average: tuple[int, int], top: int) -> DataFrame:
    """``(item, doc_id, score)``: each task's ``top`` documents of each item.

    ``weight`` is that of each term; ``held`` is (ends, items): the items of term k, one for each time
    they hold it, up to ``ends[k]``; ``average`` is (N, L).
    """
    shared = scanned.sparkSession.sparkContext.broadcast((weight, *held))
    no_id = np.iinfo(np.int64).max

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, ends, holders = shared.value
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        best, step = _Best(top), max(1, CELLS // max(items, 1))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                docs = batch.column(0).fill_null(no_id).to_numpy(zero_copy_only=False)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                m = 75 + (25 * n * average[0]) // average[1]
                term = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(docs)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
                value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
                table = np.zeros(len(docs) * items, np.int64)
                width = ends[term] - begins[term]
                upto = np.cumsum(width)
                part = np.searchsorted(upto, np.arange(CELLS, (upto[-1] if len(upto) else 0) + CELLS, CELLS), side="right")
                start = 0
                for stop in np.unique(np.append(part, len(term))):  # so many pairs of terms and items at once, or one term's
                    cut = slice(start, max(stop, start + 1))
                    if start < len(term):
                        t, many = term[cut], width[cut]
                        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        item = holders[np.repeat(begins[t], many) + inside]
                        np.add.at(table, np.repeat(row[cut], many) * items + item, np.repeat(value[cut], many))
                    start = cut.stop
                table = table.reshape(len(docs), items)
                at_doc, at_item = np.nonzero(table >= best.floor(items))
                best.add(at_item, docs[at_doc], table[at_doc, at_item])
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.doc == no_id), pa.array(best.score, pa.int64())],
            names=["item", "doc_id", "score"],
        )

    return scanned.mapInArrow(rank, FOUND)


def _block(spark: SparkSession, docs: DataFrame, items: list, top: int) -> DataFrame:
    """The ranked documents of one block of items, each ``(item_id, text)``."""
    counts = [Counter(terms_of(bytes(x["text"]))) for x in items]
    terms = sorted(set().union(*counts))
    number = {t: k for k, t in enumerate(terms)}
    pairs = np.array([(number[t], i) for i, c in enumerate(counts) for t, times in c.items() for _ in range(times)], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    held = np.searchsorted(pairs[:, 0], np.arange(len(terms)), side="right"), pairs[:, 1]

    scanned = written(scan(docs, terms), "scanned")
    n_docs, n_terms = scanned.agg(F.count("*"), F.sum("n")).first()
    df = dict(scanned.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the block
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(terms))], np.int64)
    found = best_documents(scanned, weight, held, len(items), (n_docs, n_terms or 1), top)
    names = spark.createDataFrame([(i, x["item_id"]) for i, x in enumerate(items)], "item int, item_id long")
    ranked = written(first_of_each(found, top).join(F.broadcast(names), "item"), "ranked")
    drop_tables(scanned)
    return ranked


def first_of_each(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item by falling score, then doc_id, as ``(item, rank, doc_id, score)``."""
    order = F.desc("score"), F.asc_nulls_last("doc_id")
    salted = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    within = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    over = within.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    return over.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item of ``items(item_id, text)``."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    sized = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"), size.alias("terms")).where("terms > 0")
    total = sized.agg(F.sum("terms")).first()[0] or 0
    blocks = -(-total // block_terms)
    dealt = sized.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1))).alias("block"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        if block := dealt.where(F.col("block") == k).collect():
            out = out.union(_block(spark, docs, block, top).select("item_id", "rank", "doc_id", "score"))
    return out
