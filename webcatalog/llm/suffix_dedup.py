"""Removal of repeated 100-byte strings by prefix-free parsing.

A text is read as UTF-8 bytes. A hash of every ``GRAM`` bytes triggers phrases: each 100-byte
string takes the smallest hash inside it as its trigger, and the strings of one trigger make
one phrase. Neighbouring phrases overlap by 99 bytes, so every 100-byte string is a prefix of
exactly one phrase suffix, and equal strings lie in phrases of the same trigger, at the same
distance from it. Repeats of 100 bytes then come from two tables:

* the parse: occurrences of phrases by (trigger, content, doc_id, start). All but the first
  occurrence of a phrase are repeats as a whole, however often it occurs;
* the dictionary: distinct phrases whose trigger has another distinct phrase. Only their
  suffixes can differ phrase by phrase and still share strings; a hash table of a trigger,
  filled in corpus order, looks them up by (distance to the trigger, 100 bytes), and all but
  the earliest of equal ones are repeats. Suffixes themselves are not sorted.

The suffix order of the parse itself is not needed: 99 bytes of overlap settle every
comparison of 100 bytes within the dictionary.

Scale: a task first reduces its own occurrences to one for each phrase, so a phrase of
billions of copies reaches the shuffle once a block; texts move only where phrases of the
dictionary are cut out and where the result is made. Triggers with more than ``crowd_limit``
dictionary phrases are not gathered but divided by string (``_crowded``).

Defined results: null text is empty; order is (doc_id, hash of the text, start) with null
first, which breaks ties of repeated doc_ids; a row equal to an earlier one in both is
removed whole if it has 100 bytes; further columns are ignored; an empty table gives an empty
table. Inside, the 2**40 smallest doc_ids stand for rows without one, told apart by a second hash of the text,
so that unlike texts don't fall together however many rows lack an id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcatalog.llm.common import whole_text, written

LENGTH = 100
GRAM = 32
#: Bytes of text hashed at once, and phrases that a task reduces at once.
CHUNK_BYTES, BLOCK_PHRASES = 4 << 20, 1_000_000
#: Dictionary phrases of a trigger whose strings (69 each at most) one task holds in a hash table of about 100 MB.
CROWD_LIMIT = 3_000
NO_ID, NO_IDS = -(1 << 63), 1 << 40
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)

PHRASES = "fp long, h long, doc_id long, tie long, start int, n_a long"
_PHRASES = pa.schema([("fp", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n_a", pa.int64())])
CONTENT = "fp long, doc_id long, tie long, start int, a int, content binary, crowd long"
SPANS = "doc_id long, tie long, start int, n int"
_SPANS = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])


def gram_hashes(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position on."""
    lanes = np.empty(len(data), np.uint64)
    padded = data + bytes(8)
    for shift in range(8):
        part = lanes[shift::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), shift)
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        h += lanes[8 * k : 8 * k + n] * _MIX[k]
        h ^= h >> np.uint64(31)
        h *= _MIX[4]
    h ^= h >> np.uint64(29)
    return h


def phrases(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts laid end to end: (trigger hash, start, strings in it, trigger - start).

    Equal smallest hashes (of which 32 bits are compared) are won by the leftmost, which is
    the same one in equal strings.
    """
    ends = np.cumsum(lengths)
    edge = np.zeros(len(data) + 1, np.int64)
    long = lengths >= LENGTH
    np.add.at(edge, (ends - lengths)[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(starts):
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(data)
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    trigger = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
    counts = np.diff(np.append(first, len(starts)))
    return h[trigger[first]], starts[first], counts, trigger[first] - starts[first]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    ids, ties, texts, size = [], [], [], 0
    for doc_id, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        raw = text.as_py().encode()
        if texts and size + len(raw) > CHUNK_BYTES:
            yield ids, ties, texts
            ids, ties, texts, size = [], [], [], 0
        ids.append(doc_id)
        ties.append(tie)
        texts.append(raw)
        size += len(raw)
    if texts:
        yield ids, ties, texts


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrase rows of a task, each block reduced to first occurrences and spans of repeats."""
    block, held = [], 0
    for batch in batches:
        for ids, ties, texts in _chunks(batch):
            data, lengths = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            fp, start, n, a = phrases(data, lengths)
            contents = map(data.__getitem__, map(slice, start.tolist(), (start + n + LENGTH - 1).tolist()))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, contents), np.uint64, len(start))
            ends = np.cumsum(lengths)
            doc = np.searchsorted(ends, start, "right")
            block.append((fp, h, np.array(ids, np.int64)[doc], np.array(ties, np.int64)[doc], start - (ends - lengths)[doc], n, a))
            held += len(start)
            if held >= BLOCK_PHRASES:
                yield from _reduced(block)
                block, held = [], 0
    if held:
        yield from _reduced(block)


def _reduced(block: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    columns = [np.concatenate(c) for c in zip(*block, strict=True)]
    order = np.lexsort((columns[4], columns[3], columns[2]))
    fp, h, doc, tie, start, n, a = (c[order] for c in columns)
    _, first, of = np.unique(fp * _MIX[0] ^ h, return_index=True, return_inverse=True)
    is_first = np.zeros(len(fp), bool)
    is_first[first] = True
    at = first[of]
    same_place = (doc == doc[at]) & (tie == tie[at]) & (start == start[at])
    yield _phrase_rows(fp, h, doc, tie, start, n * 128 + a + 1, is_first)
    # Repeats that follow each other become one span. They have no trigger: spread by position.
    again = np.flatnonzero(~is_first & ~same_place)
    if len(again):
        doc, tie, start, n = doc[again], tie[again], start[again], n[again]
        joins = (doc[1:] == doc[:-1]) & (tie[1:] == tie[:-1]) & (start[1:] == start[:-1] + n[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~joins)))
        n = np.add.reduceat(n, head)
        doc, tie, start = doc[head], tie[head], start[head]
        spread = (doc.astype(np.uint64) * _MIX[1] ^ start.astype(np.uint64)) * _MIX[2]
        yield _phrase_rows(spread, spread, doc, tie, start, n * 128, np.ones(len(head), bool))


def _phrase_rows(fp, h, doc, tie, start, n_a, chosen) -> pa.RecordBatch:
    columns = (fp.view(np.int64), h.view(np.int64), doc, tie, start.astype(np.int32), n_a)
    return pa.RecordBatch.from_arrays([pa.array(c[chosen]) for c in columns], schema=_PHRASES)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases asked for: columns doc_id, tie, text, asked(fp, start, n, a, crowd)."""
    for batch in batches:
        rows = []
        for doc_id, tie, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            for x in asked:
                content = raw[x["start"] : x["start"] + x["n"] + LENGTH - 1]
                rows.append((x["fp"], doc_id, tie, x["start"], x["a"], content, x["crowd"]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        names = ["fp", "doc_id", "tie", "start", "a", "content", "crowd"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated strings among dictionary phrases, which come sorted by trigger, then place."""
    group, seen = None, {}
    for batch in batches:
        found = []
        for fp, doc_id, tie, start, a, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if fp != group:
                group, seen = fp, {}
            began = None
            for k in range(len(content) - LENGTH + 1):
                here = (doc_id, tie, start + k)
                repeated = seen.setdefault((a - k, content[k : k + LENGTH]), here) != here
                if repeated and began is None:
                    began = k
                if began is not None and not repeated:
                    found.append((doc_id, tie, start + began, k - began))
                    began = None
            if began is not None:
                found.append((doc_id, tie, start + began, len(content) - LENGTH + 1 - began))
        columns = zip(*found, strict=True) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS, strict=True)], schema=_SPANS)


def _crowded(content: DataFrame) -> DataFrame:
    """As ``_suffixes``, with each string as a row: minima combine before the shuffle."""
    strings = content.withColumn("k", F.explode(F.expr(f"sequence(0, length(content) - {LENGTH})")))
    strings = strings.select(
        "doc_id", "tie", (F.col("start") + F.col("k")).alias("start"), "fp", (F.col("a") - F.col("k")).alias("distance"),
        F.sha2(F.expr(f"substring(content, k + 1, {LENGTH})"), 256).alias("string"),
    )
    keys = ["fp", "distance", "string"]
    firsts = strings.groupBy(*keys).agg(F.min(F.struct("doc_id", "tie", "start")).alias("first"))
    later = strings.join(firsts, keys).where(F.struct("doc_id", "tie", "start") != F.col("first"))
    return later.select("doc_id", "tie", "start", F.lit(1).alias("n"))


def _keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", whole_text().alias("text"))
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(NO_IDS))
    return rows.select(F.coalesce("doc_id", no_id).alias("doc_id"), F.xxhash64("text").alias("tie"), "text", F.col("doc_id").alias("id"))


def repeated_spans(docs: DataFrame, crowd_limit: int = CROWD_LIMIT) -> DataFrame:
    """``(doc_id, tie, start, n)``: the strings of 100 bytes at ``start .. start + n - 1`` are repeats."""
    keyed = _keyed(docs)
    rows = keyed.drop("id").mapInArrow(_parse, PHRASES).repartition("fp").sortWithinPartitions("fp", "h", "doc_id", "tie", "start")
    place = F.struct("doc_id", "tie", "start")
    of_phrase = Window.partitionBy("fp", "h").orderBy("doc_id", "tie", "start")
    of_trigger = Window.partitionBy("fp")
    rows = rows.withColumn("first", F.first(place).over(of_phrase)).withColumn("nth", F.row_number().over(of_phrase))
    rows = rows.withColumn("crowd", F.sum(F.when(F.col("nth") == 1, 1)).over(of_trigger))
    span, later = F.col("n_a") % 128 == 0, place != F.col("first")
    rows = rows.where(span | later | ((F.col("nth") == 1) & (F.col("crowd") > 1)))
    parse = written(
        rows.select(
            "fp", "doc_id", "tie", "start", F.expr("n_a div 128").cast("int").alias("n"), F.expr("n_a % 128 - 1").cast("int").alias("a"),
            "crowd", (span | later).alias("repeat"),
        ),
        "parse",
    )
    asked = F.collect_list(F.struct("fp", "start", "n", "a", "crowd")).alias("asked")  # of one text
    wanted = parse.where("NOT repeat").groupBy("doc_id", "tie").agg(asked)
    cut = keyed.join(wanted, ["doc_id", "tie"]).select("doc_id", "tie", "text", "asked").mapInArrow(_cut, CONTENT)
    dictionary = written(cut, "dictionary")
    # Straight from the table: above a join on ``fp`` Spark drops the repartition, and may then read the join's
    # shuffle locally or split it, so that a trigger lies in several tasks.
    few = dictionary.where(F.col("crowd") <= crowd_limit).drop("crowd").repartition("fp")
    few = few.sortWithinPartitions("fp", "doc_id", "tie", "start")
    found = few.mapInArrow(_suffixes, SPANS).union(_crowded(dictionary.where(F.col("crowd") > crowd_limit)))
    return parse.where("repeat").select("doc_id", "tie", "start", "n").union(found)


def removed_runs(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of bytes that the strings of ``spans`` cover."""
    runs: list[tuple[int, int]] = []
    for start, end in sorted((x["start"], x["start"] + x["n"] + LENGTH - 1) for x in spans):
        if runs and start <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((start, min(end, size)))
    return runs


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, copy, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode()
            runs = removed_runs(spans or [], len(raw))
            if copy > 1 and len(raw) >= LENGTH:
                runs = [(0, len(raw))]
            edges = [0, *(x for run in runs for x in run), len(raw)]
            kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            flat = [{"start": s, "end": e} for s, e in runs]
            rows.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), flat))
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), runs_type)
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def remove_repeats(docs: DataFrame, crowd_limit: int = CROWD_LIMIT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, runs)`` for every row; ``runs`` are the removed bytes."""
    spans = written(repeated_spans(docs, crowd_limit), "spans")
    of_text = spans.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = _keyed(docs).join(of_text, ["doc_id", "tie"], "left")
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "tie").orderBy("doc_id")))
    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
        " runs array<struct<start: long, end: long>>"
    )
    return rows.select("id", "text", "copy", "spans").mapInArrow(_remove, schema)
