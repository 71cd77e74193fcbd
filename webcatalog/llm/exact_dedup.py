"""Exact duplicates by a persistent digest index.

The index is a table of one row for each known text, ``(digest, keep_id, chars, size, delivery)``,
bucketed and sorted by ``digest`` (SHA-256 of the text without its white space). A delivery of
documents is reduced to its distinct digests, which meet the index in a sort-merge anti-join:
the index side is read as it lies, without an exchange, and the unknown digests are appended,
again one sorted file for each bucket. The index outlives the session: ``DigestIndex`` opens a
folder by its layout file. ``compact`` leaves one sorted file for each bucket after many deliveries.

Of a delivery's equal texts the one with the most code points stays, then the smallest doc_id. A text
that the index knows already loses to the one indexed. Adding a delivery again appends nothing,
so a job that died may be repeated.

Scale: texts are read once and become narrow rows; groups are counted with partial aggregation
before the shuffle, and the join that tells each row its group's keeper is one that AQE may split,
so that a text with a third of all rows is spread over many tasks. Deliveries are appended by one
writer at a time.

Defined results: null text is the empty text, and all empty ones are equal; null ids rank last, and
of rows with equal ids and lengths exactly one stays; columns beside doc_id and text are ignored; an
empty table gives an empty table and leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcatalog.llm.common import whole_text, written

#: White space that does not count, as a regular expression.
BLANK = "[ \\t-\\r]+"
BUCKETS = 64


class DigestIndex:
    """The digest index in ``folder``; made with ``buckets`` buckets where there is none yet."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = self._layout(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"  # of the table in this session's catalog
        self._open("rows")

    def _layout(self, buckets: int) -> int:
        spark, path = self.spark, f"{self.folder}/layout"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit("rows").alias("folder")).write.parquet(path)
        return spark.read.parquet(path).first()["buckets"]

    def _open(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # external: the files stay
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, chars BIGINT, size BIGINT, delivery STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{folder}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups(digest, ...)`` that the index lacks."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, delivery: str) -> None:
        """Add ``groups(digest, keep_id, chars, size)``, whose digests the index lacks."""
        rows = groups.select("digest", "keep_id", "chars", "size", F.lit(delivery).alias("delivery"))
        rows = rows.repartition(self.buckets, "digest")  # a bucket is one task, so one file
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name, format="parquet", path=self._path())
        self.spark.catalog.refreshTable(self.name)

    def _path(self) -> str:
        return f"{self.folder}/rows"

    def compact(self, folder: str) -> DigestIndex:
        """The same index in a new folder, one sorted file for each bucket; buckets aren't shuffled."""
        fresh = DigestIndex(self.spark, folder, self.buckets)
        rows = self.rows().sortWithinPartitions("digest")
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(fresh.name, format="parquet", path=fresh._path())
        self.spark.catalog.refreshTable(fresh.name)
        return fresh


def digests(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, digest, chars)`` of every row; ``row`` is unique once the result is written."""
    text = whole_text()
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, BLANK, "").cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )


def groups_of(keyed: DataFrame) -> DataFrame:
    """``(digest, keep_id, keep_row, chars, size)``: the keeper of each distinct text of a delivery."""
    order = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    best = keyed.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("size"))
    return best.select(
        "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), (-F.col("best.shorter")).alias("chars"), "size"
    )


def deduplicate(docs: DataFrame, index: DigestIndex, delivery: str = "") -> DataFrame:
    """A row for each of ``docs``: ``(doc_id, keep_id, group_size, kept, text_sha256, known)``.

    ``group_size`` counts the delivery's equal texts; ``known`` says that the index had the text
    before, so that none of them stays and ``keep_id`` is the indexed one.
    """
    delivery = delivery or uuid.uuid4().hex
    keyed = written(digests(docs), "digests")
    groups = written(groups_of(keyed), "digest_groups")
    index.append(index.unknown(groups), delivery)
    now = index.rows().select("digest", F.col("keep_id").alias("first_id"), (F.col("delivery") != delivery).alias("known"))
    decided = groups.join(now.hint("merge"), "digest")  # every digest of the delivery is indexed now
    decided = decided.select("digest", "first_id", "keep_row", "size", "known")
    return keyed.join(decided, "digest").select(
        "doc_id", F.col("first_id").alias("keep_id"), F.col("size").alias("group_size"),
        (~F.col("known") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "known",
    )
