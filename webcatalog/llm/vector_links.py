"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on ``PROJECTIONS`` Gaussian directions. Two vectors at the cosine
threshold differ by a normal variable of known spread in each projection, so the number of
projections in which one falls into the window of ``REACH`` spreads around the other is
binomial. ``collision_count`` is the largest count that pairs at the threshold reach with
probability ``RECALL`` (closer pairs reach it more often); pairs that do are verified by their
cosine in double precision, so no link is wrong.

Vectors of a label are sorted by the first projection and cut into chunks of ``CHUNK``. Chunks
whose ranges lie within ``FAR`` spreads (missed by 7 pairs in a million) meet as tiles of
bounded size; inside a tile every projection is sorted and windows are counted. Equal vectors
are one class before that, and a tile returns sums of links and a spanning forest, not its
pairs, so neither copies nor dense groups multiply rows. A label of any size is many chunks.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and
those with a null label, link with nothing; vectors of different lengths don't link; repeated
rows count as vectors of their own; a null vec_id names no component, unless it is alone.
Classes are told apart by a 64-bit hash. Further columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import written
from webcatalog.llm.components import components

THRESHOLD = 0.93
PROJECTIONS, REACH, RECALL, FAR = 24, 1.6, 0.9999, 4.5
CHUNK, QUERIES = 1024, 256
SEED = 11


def spread(threshold: float) -> float:
    """Standard deviation, in a projection, of the difference of unit vectors at the threshold."""
    return math.sqrt(2 - 2 * threshold)


def collision_count(projections: int = PROJECTIONS, reach: float = REACH, recall: float = RECALL) -> int:
    p = math.erf(reach / math.sqrt(2))
    missed = 0.0
    for count in range(projections + 1):
        missed += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if missed > 1 - recall:
            return count
    return projections


def directions(size: int) -> np.ndarray:
    return np.random.default_rng([SEED, size]).standard_normal((size, PROJECTIONS))


def classes_of(vectors: DataFrame) -> DataFrame:
    """``(key, label, size, copies, first_id, embedding)`` of distinct vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", "label", e.alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    usable = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~bad & (norm > 0))
    return usable.groupBy(F.xxhash64("label", "embedding").alias("key")).agg(
        F.min("label").alias("label"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.min("embedding").alias("embedding")
    ).withColumn("size", F.size("embedding"))


def _first_projection(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.empty(batch.num_rows)
        for k, v in enumerate(batch.column("embedding")):
            x = np.array(v.as_py())
            at[k] = x @ directions(len(x))[:, 0] / np.linalg.norm(x)
        yield batch.append_column("at", pa.array(at))


CHUNKS = "grp string, chunk string, low double, high double, keys array<long>, copies array<long>, size int, vectors binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of rows sorted by (label, size, at); a chunk is named by its group and first key."""
    group, held = None, []

    def chunk() -> pa.RecordBatch:
        keys = [r["key"] for r in held]
        return pa.RecordBatch.from_pylist([{
            "grp": group, "chunk": f"{group}/{keys[0]}", "low": held[0]["at"], "high": held[-1]["at"], "keys": keys,
            "copies": [r["copies"] for r in held], "size": held[0]["size"], "vectors": np.array([r["embedding"] for r in held]).tobytes(),
        }], schema=pa.schema([
            ("grp", pa.string()), ("chunk", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("keys", pa.list_(pa.int64())),
            ("copies", pa.list_(pa.int64())), ("size", pa.int32()), ("vectors", pa.binary()),
        ]))

    for batch in batches:
        for row in batch.to_pylist():
            name = f"{row['label']}/{row['size']}"
            if held and (name != group or len(held) == CHUNK):
                yield chunk()
                held = []
            group = name
            held.append(row)
    if held:
        yield chunk()


def _unit(vectors: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(vectors).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1)[:, None]


def links_in_tile(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (unit vectors) link, from counted collisions, then verified."""
    project = directions(a.shape[1])
    pa_, pb = a @ project, b @ project
    width, least = REACH * spread(threshold), collision_count()
    order = np.argsort(pb, axis=0)
    found = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(a), QUERIES):
        queries = pa_[at : at + QUERIES]
        rows = np.arange(len(queries))
        counts = np.zeros((len(queries), len(b)), np.int8)
        for k in range(PROJECTIONS):
            line = pb[order[:, k], k]
            marks = np.zeros((len(queries), len(b) + 1), np.int8)
            np.add.at(marks, (rows, np.searchsorted(line, queries[:, k] - width, "left")), 1)
            np.add.at(marks, (rows, np.searchsorted(line, queries[:, k] + width, "right")), -1)
            counts[:, order[:, k]] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
        i, j = np.nonzero(counts >= least)
        for part in range(0, len(i), 1 << 16):
            x, y = i[part : part + (1 << 16)] + at, j[part : part + (1 << 16)]
            close = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            found[x[close], y[close]] = True
    return found


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of ``links`` that span its components."""
    rows_left, out = links.any(axis=1), []
    free = np.ones(links.shape[1], bool)
    for root in np.flatnonzero(rows_left):
        if not rows_left[root]:
            continue
        rows_left[root] = False
        rows = [int(root)]
        while rows:
            row = rows.pop()
            columns = np.flatnonzero(links[row] & free)
            free[columns] = False
            for column in columns.tolist():
                out.append((row, column))
                more = np.flatnonzero(links[:, column] & rows_left)
                rows_left[more] = False
                out += [(r, column) for r in more.tolist()]
                rows += more.tolist()
    return out


def _tiles(threshold: float):
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                same = t["chunk"] == t["chunk_b"]
                a, b = _unit(t["vectors"], t["size"]), _unit(t["vectors_b"], t["size"])
                found = links_in_tile(a, b, threshold)
                if same:
                    np.fill_diagonal(found, False)
                of_a = found @ np.array(t["copies_b"], np.int64)
                sums = [(k, None, int(n)) for k, n in zip(t["keys"], of_a, strict=True) if n]
                if not same:
                    of_b = np.array(t["copies"], np.int64) @ found
                    sums += [(k, None, int(n)) for k, n in zip(t["keys_b"], of_b, strict=True) if n]
                pairs = [(t["keys"][i], t["keys_b"][j], 0) for i, j in forest(found)]
                columns = zip(*[*sums, *pairs], strict=True) if sums or pairs else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["a", "b", "n"])

    return tiles


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``."""
    classes = written(classes_of(vectors), "classes")
    kind = classes.schema["label"].dataType.simpleString()
    columns = f"key long, label {kind}, copies long, embedding array<double>, size int"
    placed = classes.select("key", "label", "copies", "embedding", "size").mapInArrow(_first_projection, f"{columns}, at double")
    placed = placed.repartitionByRange("label", "size", "at", "key").sortWithinPartitions("label", "size", "at", "key")
    chunks = written(placed.mapInArrow(_chunks, CHUNKS), "chunks")
    narrow = chunks.select("grp", "chunk", "low", "high")
    other = narrow.select("grp", *[F.col(c).alias(f"{c}_b") for c in ("chunk", "low", "high")])
    gap = FAR * spread(threshold)
    in_order = (F.col("low") < F.col("low_b")) | ((F.col("low") == F.col("low_b")) & (F.col("chunk") <= F.col("chunk_b")))
    pairs = narrow.join(other, "grp").where(in_order & (F.col("low_b") - F.col("high") <= gap)).select("chunk", "chunk_b")
    left = chunks.select("chunk", "keys", "copies", "size", "vectors")
    right = chunks.select(F.col("chunk").alias("chunk_b"), *[F.col(c).alias(f"{c}_b") for c in ("keys", "copies", "vectors")])
    met = pairs.join(left, "chunk").join(right, "chunk_b")
    found = written(met.mapInArrow(_tiles(threshold), "a long, b long, n long"), "tiles")
    sums = found.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.select("key", "copies", "first_id").join(joined.withColumnRenamed("node", "key"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    names = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(names, "component").join(sums, "key", "left")
    named = named.select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    rows = vectors.select("vec_id", F.xxhash64("label", F.col("embedding").cast("array<double>")).alias("key"))
    # Rows that can't link have no class: their key is met by none.
    out = rows.join(named, "key", "left")
    n, component = F.coalesce("n_links", F.lit(0).cast("long")), F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select("vec_id", n.alias("n_links"), component.alias("component_id"), kept.alias("kept"))
