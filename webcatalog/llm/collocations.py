"""Phrase collocations, counted in HAT-tries.

A task counts the phrases of its texts in a HAT-trie: a shallow trie over word ids (first word, then
second word) whose leaves are hash containers of the remaining words. A container that outgrows
``BURST`` entries bursts into a trie node with a container for each next word. When a trie
holds ``LIMIT`` entries, its largest subtrees are spilled whole, each as a run sorted by
phrase, until half is free. Runs go to a table; ranges of its order are the prefix partitions in which
runs are merged. The ranges follow the data, so a prefix with a third of all rows gets many of them.

The tries get only phrases that may reach ``min_count``, as most others occur once. Three rounds over the
texts find these: words are counted, then 64-bit hashes of word pairs, then those of longer phrases, each
only where its parts may be frequent (its count can't be higher than theirs). A round leaves a bitmap over hashes,
``BITS`` bits at most, which is broadcast. Equal hashes add up, so nothing frequent is lost; a false
positive costs time and changes nothing, as the tries count by word, and so the bitmap needn't grow with the data.

``collocations`` scores the frequent phrases. Cutting one after k words gives l and r, the counts of its
two parts, and floor(2000000 * a / (l + r)); the lowest cut counts. Phrases of which a
longer frequent phrase holds nearly all occurrences are dropped. Arithmetic is on decimals.

Defined results: null text has no words, null language is ``und``; repeated rows count as often as they occur;
rows of one language only meet in its ranking, which takes two steps over salted parts; columns beside
lang and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcatalog.llm.common import drop_tables, written

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
BURST, LIMIT = 2048, 500_000
#: Bits of a word's number in a task, above what ``LIMIT`` and a chunk can add.
WORD_BITS = 21
#: Words of texts, hashes of phrases, phrases and rows of a run that a task handles at once.
CHUNK, HASHES, HELD, RUN_ROWS = 100_000, 4_000_000, 1_000_000, 20_000
BITS = 1 << 28
SALTS = 64
OTHER = "und"

#: What ends a piece; never part of a word.
END = b"."
#: A-Z in lower case, all ends of pieces alike, tabs as spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else END[0] if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))
RUNS = "lang string, phrase string, f long"
_MASK = (1 << WORD_BITS) - 1
_BREAK = np.array([-1])


class Node(dict):
    """A burst container: next word -> container."""


class HatTrie:
    """Counts of phrases of word ids.

    A phrase is its first word and a tail: the other ids plus one, ``WORD_BITS`` bits each, the next one lowest.
    """

    def __init__(self, burst: int = BURST):
        self.root: dict[int, dict] = {}
        self.entries, self.burst = 0, burst

    def add(self, first: int, tail: int, count: int = 1) -> None:
        under = self.root.get(first)
        if under is None:
            self.root[first] = {tail: count}
            self.entries += 1
            return
        key = tail
        if type(under) is Node:
            node, word, key = under, tail & _MASK, tail >> WORD_BITS
            under = node.get(word)
            if under is None:
                node[word] = {key: count}
                self.entries += 1
                return
            if key in under:
                under[key] += count
            else:
                under[key] = count
                self.entries += 1
        elif key in under:
            under[key] += count
        else:
            under[key] = count
            self.entries += 1
            if len(under) > self.burst:
                self._burst(first, under)

    def _burst(self, first: int, container: dict[int, int]) -> None:
        node = self.root[first] = Node()
        for tail, count in container.items():
            node.setdefault(tail & _MASK, {})[tail >> WORD_BITS] = count

    def size(self, first: int) -> int:
        under = self.root[first]
        return sum(map(len, under.values())) if type(under) is Node else len(under)

    def spill(self, left: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Whole subtrees, largest first, as (first word, its tails and counts), until ``left`` entries stay."""
        for n, first in sorted(((self.size(w), w) for w in self.root), reverse=True):
            if self.entries <= left:
                return
            self.entries -= n
            under = self.root.pop(first)
            if type(under) is Node:
                yield first, [(rest << WORD_BITS | word, c) for word, tails in under.items() for rest, c in tails.items()]
            else:
                yield first, list(under.items())


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their first words and of their last one."""
    z = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (y + np.uint64(0x632BE59BD9B4E019))
    return (z ^ (z >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class Bitmap:
    """Which hashes may be present; ``bits`` is a power of two."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits, self.set = bits, np.zeros(bits // 8, np.uint8)
        for part, octets in parts.items():
            self.set[part << 12 : (part + 1) << 12] = np.frombuffer(octets, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.set[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(hashes: DataFrame) -> Bitmap:
    """Of the written table ``hashes(h)``: 16 bits for each, ``BITS`` at most."""
    bits = min(BITS, max(1 << 15, 1 << (16 * hashes.count()).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    parts = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part"))
    rows = parts.agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("set")).collect()  # BITS / 8 bytes at most
    return Bitmap(bits, {r["part"]: bytes(r["set"]) for r in rows})


class _Known(dict):
    """Word -> id in one language; -1 for words that are too rare, and for the end of a piece."""

    def __init__(self, lang: str, words: _Words):
        self.lang, self.prefix, self.words = lang, lang.encode() + b"\0", words
        self[END] = -1

    def __missing__(self, word: bytes) -> int:
        words, h = self.words, xxhash.xxh64_intdigest(self.prefix + word, 42)
        words.met += 1
        if words.bits is not None and not words.bits[(h & words.last) >> 3] >> (h & 7) & 1:
            self[word] = -1
            return -1
        self[word] = k = len(words.words)
        words.words.append(word)
        words.langs.append(self.lang)
        words.hash.append(h)
        return k


class _Words:
    """The words that a task has met, numbered; whole texts become arrays of their numbers."""

    def __init__(self, frequent: Bitmap | None):
        self.bits, self.last = (frequent.set.tobytes(), frequent.bits - 1) if frequent else (None, 0)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, _Known] = {}
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.hash = array("Q")
        self.met = 0

    def ids(self, lang: str, words: list[bytes]) -> np.ndarray:
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = _Known(lang, self)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def chunks(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int]]:
        """(ids, starts): word ids of texts, -1 between pieces; only phrases within the first ``starts`` begin here."""
        held, n = [], 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = text.translate(FOLD).replace(END, b" . ").split()
            if n and n + len(words) > CHUNK:
                yield np.concatenate(held), n
                held, n = [], 0
            if len(words) < CHUNK:
                held += [self.ids(lang, words), _BREAK]
                n += len(words) + 1
                continue
            for at in range(0, len(words), CHUNK):  # overlaps by the rest of a phrase
                yield self.ids(lang, words[at : at + CHUNK + LONGEST - 1]), CHUNK
        if n:
            yield np.concatenate(held), n

    def phrases(self, ids: np.ndarray, starts: int, *filters: Bitmap | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, positions, hashes) of the phrases of two and more words whose parts may be frequent.

        ``filters`` are those of phrases of two, three .. words; None lets all pass.
        """
        hashes = np.frombuffer(self.hash, np.uint64)[ids] if self.hash else np.zeros(len(ids), np.uint64)
        x, good = hashes, ids >= 0
        for size, known in enumerate(filters, 2):
            m = max(0, len(ids) - size + 1)
            x, good = mix(x[:m], hashes[size - 1 :]), good[:m] & good[1 : m + 1]
            at = np.flatnonzero(good)
            if known is not None:
                at = at[known.has(x[at])]
                good = np.zeros(m, bool)
                good[at] = True
            at = at[at < starts]
            yield size, at, x[at]


def _rows(langs: list[str], phrases: list[bytes], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"]
    )


def _counting(count):
    """``count`` without the garbage collector, which would walk millions of live objects; none are cyclic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from count(batches)
        finally:
            gc.enable()

    return run


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(OTHER))
    return docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_runs(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(lang, phrase, f)``: the words of each task, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = _Words(None), np.zeros(0, np.int64)

        def run() -> Iterator[pa.RecordBatch]:
            rows = sorted((lang, w, c) for lang, w, c in zip(words.langs, words.words, total.tolist(), strict=True) if c)
            for at in range(0, len(rows), RUN_ROWS):
                yield _rows(*zip(*rows[at : at + RUN_ROWS], strict=True))

        for batch in batches:
            for ids, starts in words.chunks(batch):
                found = ids[:starts]
                new = np.bincount(found[found >= 0], minlength=len(words.words))
                new[: len(total)] += total
                total = new
                if words.met >= limit:
                    yield from run()
                    words.forget()
                    total = total[:0]
        yield from run()

    return _texts(docs).mapInArrow(_counting(count), RUNS)


def hash_counts(docs: DataFrame, frequent: Bitmap, sizes: Sequence[int], *filters: Bitmap | None, limit: int = LIMIT) -> DataFrame:
    """``(h, f)``: hashes of phrases of ``sizes`` words with their counts; a hash occurs in several rows."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, filters))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tests = shared.value
        words, held, n = _Words(known), [], 0

        def summed() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))], names=["h", "f"])

        for batch in batches:
            for ids, starts in words.chunks(batch):
                found = [h for size, _, h in words.phrases(ids, starts, *tests) if size in sizes]
                held += found
                n += sum(map(len, found))
                if n >= HASHES:
                    yield summed()
                    held, n = [], 0
                if words.met >= limit:
                    words.forget()
        if n:
            yield summed()

    return _texts(docs).mapInArrow(_counting(count), "h long, f long")


def phrase_runs(docs: DataFrame, frequent: Bitmap, *filters: Bitmap, limit: int = LIMIT, burst: int = BURST) -> DataFrame:
    """``(lang, phrase, f)``: the sorted runs that the tries of all tasks spill; a phrase occurs in several."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, filters))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tests = shared.value
        words, trie, held, n = _Words(known), HatTrie(burst), [], 0

        def fill() -> Iterator[pa.RecordBatch]:
            """Into the trie with what is held, in its order, equal phrases together."""
            first, tail = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((tail, first))
            first, tail = first[order], tail[order]
            new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (tail[1:] != tail[:-1]))) if len(first) else np.zeros(0, np.int64)
            counts = np.diff(np.append(new, len(first)))
            for f, t, c in zip(first[new].tolist(), tail[new].tolist(), counts.tolist(), strict=True):
                trie.add(f, t, c)
                if trie.entries >= limit:
                    yield from runs(limit // 2)
            held.clear()

        def runs(left: int) -> Iterator[pa.RecordBatch]:
            """Rows of whole subtrees, each sorted by phrase."""
            langs, phrases, counts = [], [], []
            for first, tails in trie.spill(left):
                head = words.words[first]
                name = lambda t, head=head: b" ".join([head, *[words.words[(t >> s & _MASK) - 1] for s in range(0, t.bit_length(), WORD_BITS)]])
                run = sorted((name(t), c) for t, c in tails)
                langs += [words.langs[first]] * len(run)
                phrases += [p for p, _ in run]
                counts += [c for _, c in run]
                if len(counts) >= RUN_ROWS:
                    yield _rows(langs, phrases, counts)
                    langs, phrases, counts = [], [], []
            yield _rows(langs, phrases, counts)

        for batch in batches:
            for ids, starts in words.chunks(batch):
                for size, at, _ in words.phrases(ids, starts, *tests):
                    held.append((ids[at], sum((ids[at + j] + 1) << WORD_BITS * (j - 1) for j in range(1, size))))
                    n += len(at)
                forget = words.met >= limit
                if held and (n >= HELD or forget):
                    yield from fill()
                    n = 0
                if forget:
                    yield from runs(0)
                    words.forget()
        if held:
            yield from fill()
        yield from runs(0)

    return _texts(docs).mapInArrow(_counting(count), RUNS)


def merged(table: DataFrame) -> DataFrame:
    """``(lang, phrase, f)``, a row for each phrase: runs merged within ranges of their order."""
    return table.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _frequent_hashes(found: DataFrame, min_count: int) -> Bitmap:
    kept = written(found.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select("h"), "hashes")
    out = bitmap(kept)
    drop_tables(kept)
    return out


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, limit: int = LIMIT, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, f, words)`` of one to ``LONGEST`` words with ``min_count`` or more occurrences; ``(lang, n)``."""
    frequent = lambda table: written(merged(table).where(F.col("f") >= min_count), "phrases")
    found = written(word_runs(docs, limit), "word-runs")
    totals = written(found.groupBy("lang").agg(F.sum("f").alias("n")), "words")
    words = frequent(found)
    drop_tables(found)
    hashed = written(words.select(F.xxhash64(F.concat("lang", F.lit("\0"), "phrase")).alias("h")), "hashes")
    known = bitmap(hashed)
    pairs = _frequent_hashes(hash_counts(docs, known, (2,), None, limit=limit), min_count)
    sizes = range(3, LONGEST + 1)
    longer = _frequent_hashes(hash_counts(docs, known, sizes, pairs, *[None for _ in sizes], limit=limit), min_count)
    found = written(phrase_runs(docs, known, pairs, *[longer for _ in sizes], limit=limit, burst=burst), "phrase-runs")
    phrases = frequent(found)
    every = written(words.union(phrases).withColumn("words", F.split("phrase", " ")), "frequent")
    drop_tables(found, hashed, words, phrases)
    return every, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, limit: int = LIMIT, burst: int = BURST) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language."""
    phrases, totals = frequent_phrases(docs, min_count, limit, burst)
    size = F.size("words")
    candidates = phrases.where(size > 1)
    part = lambda begin, n: F.array_join(F.slice("words", begin, n), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size).alias("rest"))
    counted = lambda name, f: phrases.select(F.col("lang").alias(f"{f}_lang"), F.col("phrase").alias(name), F.col("f").alias(f))
    for name, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counted(f"{f}_{name}", f), (F.col("lang") == F.col(f"{f}_lang")) & (F.col(name) == F.col(f"{f}_{name}")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("above", F.lit(2_000_000).cast("decimal(7,0)") * wide("a")).withColumn("below", wide("l") + wide("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(n).alias("n")) for n in range(2, LONGEST) for at in range(1, LONGEST - n + 2)])
    inside = candidates.where(size > 2).select("lang", F.col("f").alias("longer"), "words", F.explode(spans).alias("span"))
    inside = inside.where((F.col("span.n") < size) & (F.col("span.at") + F.col("span.n") <= size + 1))
    inside = inside.select("lang", part(F.col("span.at"), F.col("span.n")).alias("phrase"), "longer")
    held = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(held, ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(F.lit(100).cast("decimal(3,0)") * wide("longer") < F.lit(80).cast("decimal(2,0)") * wide("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salted = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    within = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
