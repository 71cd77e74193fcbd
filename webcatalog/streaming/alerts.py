"""Change alerts over a stream of observations that come in any order, some of them late."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from webcatalog.operators.changes import change_alerts

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a group that are held before they go to the state store.
_HELD = 50_000


def _rank(value) -> tuple:
    """A place in Spark's order: null first, NaN last."""
    if value is None:
        return (0, 0)
    return (2, 0) if value != value else (1, value)


def _event(price, availability, before) -> str | None:
    if before is None:
        return "new"
    if availability == "out_of_stock" and before[1] is not None and before[1] != "out_of_stock":
        return "out_of_stock"
    if price is None or before[0] is None or _rank(price) == _rank(before[0]):
        return None
    return "price_drop" if _rank(price) < _rank(before[0]) else "price_rise"


class _Alerts(StatefulProcessor):
    """Holds the open time buckets of a group of keys; a timer at the end of the first compares the rows of all that ended, in order.

    A call to the state store costs far more than a row, so calls follow groups and their open buckets, not
    keys. A bucket's rows lie in parts, one more for each batch, and the last values of the group's keys in one
    value: a task holds those, and the rows of one bucket of one group.
    """

    def __init__(self, seen: StructType, width_ms: int) -> None:
        self.seen, self.width = seen, width_ms
        self.names = [name for name in seen.names if name != "_key"]
        self.result = Row("_key", *self.names, "prev_price", "prev_availability", "event", "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        long = lambda name: StructField(name, LongType())
        many = lambda name, fields: StructType([StructField(name, ArrayType(StructType(fields)))])
        self.rows = handle.getMapState("rows", StructType([long("ends"), long("part")]), many("rows", self.seen.fields))
        self.open = handle.getValueState("open", many("open", [long("ends"), long("parts")]))
        last = [self.seen["_key"], self.seen["price"], self.seen["availability"], long("done")]
        self.last = handle.getValueState("last", many("last", last))

    def _row(self, values: tuple, before: tuple | None, event: str | None, late: bool) -> Row:
        return self.result(*values, *(before or (None, None))[:2], event, late)

    def _known(self) -> tuple[dict[int, int], dict[str, tuple]]:
        """Parts of each open bucket; price, availability and the end of the last compared bucket of each key."""
        parts, last = self.open.get(), self.last.get()
        return dict(map(tuple, parts[0])) if parts else {}, {k: tuple(v) for k, *v in last[0]} if last else {}

    def _keep(self, fresh: dict[int, list], parts: dict[int, int]) -> None:
        for ends, values in fresh.items():
            self.rows.updateValue((ends, parts.get(ends, 0)), (values,))
            parts[ends] = parts.get(ends, 0) + 1
        fresh.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        parts, last = self._known()
        first = min(parts, default=None)
        fresh: dict[int, list] = {}
        held = 0
        for row in rows:
            values = tuple(row)[: len(self.seen)]
            if values[0] is None or values[1] is None:
                continue
            ends = (values[1] // (1000 * self.width) + 1) * self.width
            before = last.get(values[0])
            if before is not None and ends <= before[2]:
                yield self._row(values, None, None, True)
                continue
            fresh.setdefault(ends, []).append(values)
            held += 1
            if held == _HELD:
                self._keep(fresh, parts)
                held = 0
        self._keep(fresh, parts)
        if not parts:
            return
        self.open.update((list(parts.items()),))
        if first != min(parts):
            if first is not None:
                self.handle.deleteTimer(first)
            self.handle.registerTimer(min(parts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        parts, last = self._known()
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for ends in sorted(e for e in parts if e <= until):
            rows = []
            for part in range(parts.pop(ends)):
                rows += map(tuple, self.rows.getValue((ends, part))[0])
                self.rows.removeKey((ends, part))
            for values in sorted(rows, key=lambda v: (v[0], *map(_rank, v[1:]))):
                name, *_, price, availability = values
                before = last.get(name)
                yield self._row(values, before, _event(price, availability, before), False)
                last[name] = (price, availability, ends)
        self.last.update(([(k, *v) for k, v in last.items()],))
        if parts:
            self.open.update((list(parts.items()),))
            self.handle.registerTimer(min(parts))
        else:
            self.open.clear()


def stream_alerts(
    observations: DataFrame, delay: str = "1 day", width_ms: int = 86_400_000,
    key: str = "dedup_key", order: tuple[str, ...] = ("scraped_at",), groups: int = 512,
) -> DataFrame:
    """Every observation (key, order columns, price, availability) next to the one before it.

    A row comes out once ``delay`` has passed since its time bucket of ``width_ms`` ended, with ``event``
    as in :func:`change_alerts` (null: nothing to report). ``order[0]`` must be a timestamp; rows equal in
    ``order`` follow price and availability. A row whose bucket has been compared for its key comes out
    at once with ``late`` set and no event: :func:`read_alerts` works it in. Rows without a time
    are left out, and rows without a key only move the clock, so an empty row far in the
    future closes all that is open. Further columns are ignored. Keys share the state of one of
    ``groups``, a number that stays as long as the checkpoint: more groups hold less each and call the state store more often.
    """
    seen = observations.withWatermark(order[0], delay).select(
        # Without the clock itself: Spark would drop late rows by that column.
        F.unix_micros(order[0]).alias(order[0]), *order[1:], "price", "availability",
        F.col(key).cast("string").alias("_key"),
    )
    if len(set(seen.columns)) < len(order) + 3:
        raise ValueError("order must not name price or availability: they settle ties already")
    seen = seen.select("_key", *seen.drop("_key").columns)
    plain = seen.drop("_key").schema.fields
    # Observations without a key are dealt out too; they only move the clock.
    dealt = F.when(F.col("_key").isNull(), F.xxhash64(*seen.columns)).otherwise(F.xxhash64("_key"))
    out = StructType(
        [seen.schema["_key"], *plain, StructField("prev_price", seen.schema["price"].dataType),
         StructField("prev_availability", StringType()), StructField("event", StringType()), StructField("late", BooleanType())]
    )
    grouped = seen.withColumn("_group", F.pmod(dealt, F.lit(groups)).cast("int")).groupBy("_group")
    compared = grouped.transformWithState(_Alerts(seen.schema, width_ms), out, "Append", "EventTime")
    return compared.withColumnRenamed("_key", key).withColumn(order[0], F.timestamp_micros(order[0]))


def write_alerts(alerts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append what each micro-batch of ``stream_alerts`` gives to ``table``; a batch that runs again replaces its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("late").parquet(f"{table}/batch_id={batch_id}")

    conf = alerts.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKSDB)  # timers need it; the stream keeps its own copy of the settings
    try:
        stream = alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return stream.trigger(availableNow=True).start()
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def read_alerts(
    spark: SparkSession, table: str, schema: StructType, key: str = "dedup_key", order: tuple[str, ...] = ("scraped_at",),
    bucket: str = "month",
) -> DataFrame:
    """The alerts of all observations so far, as :func:`change_alerts` gives them for the closed buckets.

    ``schema`` is that of ``stream_alerts``. Keys with late rows, and only those, are compared anew.
    """
    rows = spark.read.schema(schema).parquet(table).drop("batch_id")
    late, on_time = rows.where("late"), rows.where("not late")
    touched = late.select(key).distinct()
    kept = on_time.where("event is not null").join(touched, key, "left_anti").drop("late")
    again = rows.join(touched, key, "left_semi").drop("prev_price", "prev_availability", "event", "late")
    full_order = (*order, "price", "availability")
    redone = change_alerts(again, key, full_order, F.date_trunc(bucket, F.col(order[0])))
    return kept.unionByName(redone)
