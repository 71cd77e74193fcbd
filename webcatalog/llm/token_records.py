"""Token ids as length-delimited binary records with an offset index.

Data file, one record after another (numbers are little-endian):

    u64 length | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload

A payload is one sequence: u8 whether it has a doc_id, i64 doc_id (0 without), then its ids,
u16 each for vocabularies up to 65,536 and u32 beyond. Masking turns the checksum right by 15
bits and adds a constant, so that data which holds checksums is not mistaken for them. The
index file beside it has the u64 offset of each record; with it readers start anywhere and
in any order. A manifest table lists the files of the tasks that committed (path, place in the
order, records, ids), so files of lost or repeated attempts are never read.

Rows are dealt out by range of doc_id, then hash of the text, which puts them in ascending
order (null first, repeated rows side by side) without any task holding more than its range;
a file is closed at ``FILE_BYTES``.

Defined results: null or empty text gives the end id alone; repeated rows give a record each;
further columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from struct import calcsize, pack, unpack_from

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webcatalog.llm.common import whole_text
from webcatalog.llm.encode import encoder

END_ID = 0
FILE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
MASK = 0xA282EAD8
LENGTH, CHECK, HEAD = "<Q", "<I", "<?q"
MANIFEST = "path string, partition int, file int, records long, ids long, width int"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = pack(LENGTH, len(payload))
    return b"".join((length, pack(CHECK, masked(length)), payload, pack(CHECK, masked(payload))))


def unframe(data, offset: int) -> memoryview:
    """The payload of the record at ``offset``; raises ValueError where a checksum differs."""
    view = memoryview(data)
    length = bytes(view[offset : offset + 8])
    if len(length) < 8 or unpack_from(CHECK, view, offset + 8)[0] != masked(length):
        raise ValueError(f"broken record length at {offset}")
    end = offset + 12 + unpack_from(LENGTH, length)[0]
    payload = view[offset + 12 : end]
    if end + 4 > len(view) or unpack_from(CHECK, view, end)[0] != masked(payload):
        raise ValueError(f"broken record at {offset}")
    return payload


class _File:
    """A data file and its index, being written by one attempt of one task."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str) -> None:
        self.system, self.path = system, f"{folder}/{name}.rec"
        self.out = system.open_output_stream(self.path)
        self.offsets: list[int] = []
        self.size = self.ids = 0

    def add(self, payload: bytes, ids: int) -> None:
        record = frame(payload)
        self.out.write(record)
        self.offsets.append(self.size)
        self.size += len(record)
        self.ids += ids

    def close(self) -> None:
        self.out.close()
        with self.system.open_output_stream(f"{self.path}.idx") as index:
            index.write(np.array(self.offsets, dtype="<u8").tobytes())


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) under ``folder``, a URI that all executors share; the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        narrow = encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        kind = np.dtype("<u2" if narrow else "<u4")
        system, base = fs.FileSystem.from_uri(f"{folder}/data")
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        end, file, files = np.array([end_id], dtype="<u4").tobytes(), None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if file is None or file.size >= FILE_BYTES:
                    name = f"part-{task.partitionId():06d}-{len(files):04d}-{task.taskAttemptId()}"
                    files.append(file := _File(system, base, name))
                ids = np.frombuffer(encode(text.as_py()) + end, dtype="<u4")
                file.add(pack(HEAD, doc_id is not None, doc_id or 0) + ids.astype(kind).tobytes(), len(ids))
                if file.size >= FILE_BYTES:
                    file.close()
        if file is not None and file.size < FILE_BYTES:
            file.close()
        yield pa.RecordBatch.from_pylist(
            [{"path": f.path, "partition": task.partitionId(), "file": i, "records": len(f.offsets), "ids": f.ids, "width": kind.itemsize}
             for i, f in enumerate(files)],
            schema=pa.schema([("path", pa.string()), ("partition", pa.int32()), ("file", pa.int32()), ("records", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]),
        )

    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_records(spark: SparkSession, folder: str, seed: int | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every record; ``ids`` are unsigned 32-bit little-endian.

    ``start`` counts the ids of all records before. Each file is one task's work. With a
    ``seed``, files and the records of each are visited in an order that the seed fixes.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = Window.orderBy("partition", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # one row a file
    system_uri = f"{folder}/data"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(system_uri)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{row['path']}.idx") as index:
                    offsets = np.frombuffer(index.read(), dtype="<u8")
                with system.open_input_file(row["path"]) as data:
                    content = data.read_buffer()
                sizes = np.diff(np.append(offsets, content.size)).astype(np.int64)
                counts = (sizes - 16 - calcsize(HEAD)) // row["width"]
                starts = row["start"] + np.cumsum(counts) - counts
                order = np.arange(len(offsets))
                if seed is not None:
                    order = np.random.default_rng([seed, row["partition"], row["file"]]).permutation(order)
                step = max(1, int(BATCH_BYTES // max(1, counts.mean() * 4)))
                for at in range(0, len(order), step):
                    names, ids = [], []
                    for k in order[at : at + step].tolist():
                        payload = unframe(content, int(offsets[k]))
                        has_id, doc_id = unpack_from(HEAD, payload)
                        names.append(doc_id if has_id else None)
                        ids.append(np.frombuffer(payload[calcsize(HEAD) :], f"<u{row['width']}").astype("<u4").tobytes())
                    chosen = order[at : at + step]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.int64()), pa.array(starts[chosen]), pa.array(counts[chosen]), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    n_files = max(1, manifest.count())
    if seed is not None:
        files = files.orderBy(F.xxhash64("path", F.lit(seed)))
    dealt = files.repartition(n_files)  # round robin: a file for each task
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
