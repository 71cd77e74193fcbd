"""The alerts stream against the batch form: shuffled files, late rows, ties, nulls, restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webcatalog.operators.changes import change_alerts
from webcatalog.streaming.alerts import read_alerts, stream_alerts, write_alerts

DDL = "dedup_key string, scraped_at timestamp, seq long, price double, availability string"
ORDER = ("scraped_at", "seq")
END = [(None, datetime(2100, 1, 1), None, None, None)]
DAY = 86_400_000


def _write(spark, folder, *files):
    for rows in files:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _stream(spark, folder, delay="3 days", width_ms=DAY):
    seen = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    alerts = stream_alerts(seen, delay, width_ms, order=ORDER)
    write_alerts(alerts, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return alerts.schema


def _plain(df):
    names = ["dedup_key", *ORDER, "price", "availability", "prev_price", "prev_availability", "event"]
    return sorted(repr(tuple(r)) for r in df.select(*names).collect())  # as text: NaN equals NaN


def _batch(spark, rows):
    seen = spark.createDataFrame(rows, DDL).where("dedup_key is not null and scraped_at is not null")
    return _plain(change_alerts(seen, order=(*ORDER, "price", "availability")))


def _rows(n, keys, days, seed):
    r, start = random.Random(seed), datetime(2024, 1, 1)
    out = [
        (f"k{r.randrange(keys)}", start + timedelta(hours=r.randrange(24 * days)), r.choice([None, r.randrange(3)]),
         r.choice([None, 1.0, 2.0, float("nan"), r.random()]), r.choice([None, "in_stock", "out_of_stock"]))
        for _ in range(n)
    ]
    return out + out[: n // 20]


def test_shuffled_and_late_files_give_the_alerts_of_the_batch(spark, tmp_path):
    rows = _rows(300, 6, 20, 1)
    rows += [(None, datetime(2024, 1, 5), 1, 1.0, "in_stock"), ("k1", None, 1, 1.0, "in_stock")]
    random.Random(2).shuffle(rows)
    folder = str(tmp_path)
    _write(spark, folder, rows[:120], rows[120:240], rows[240:], END)
    schema = _stream(spark, folder)
    assert _plain(read_alerts(spark, f"{folder}/table", schema, order=ORDER)) == _batch(spark, rows)
    written = spark.read.schema(schema).parquet(f"{folder}/table")
    assert written.where("late").count() > 0 and written.count() == sum(r[0] is not None and r[1] is not None for r in rows)


def test_rows_within_the_delay_are_not_late_and_a_stream_goes_on(spark, tmp_path):
    rows = sorted(_rows(120, 4, 10, 3), key=lambda r: r[1])
    folder = str(tmp_path)
    _write(spark, folder, rows[30:60], rows[:30], rows[60:90])
    _stream(spark, folder, "30 days")
    _write(spark, folder, rows[90:], END)
    schema = _stream(spark, folder, "30 days")  # the same checkpoint, after a stop
    written = spark.read.schema(schema).parquet(f"{folder}/table")
    assert written.where("late").count() == 0
    assert _plain(read_alerts(spark, f"{folder}/table", schema, order=ORDER)) == _batch(spark, rows)


def test_only_keys_with_late_rows_are_compared_anew(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d)
    early = [("a", day(2), 1, 5.0, "in_stock"), ("a", day(20), 2, 4.0, "in_stock"), ("b", day(2), 3, 1.0, "in_stock")]
    middle, late = [("b", day(25), 5, 2.0, "out_of_stock")], [("a", day(1), 4, 9.0, "in_stock")]
    folder = str(tmp_path)
    _write(spark, folder, early, middle, late, END)
    schema = _stream(spark, folder)
    alerts = read_alerts(spark, f"{folder}/table", schema, order=ORDER)
    assert [(r.dedup_key, r.price, r.event) for r in alerts.orderBy("dedup_key", "scraped_at").collect()] == [
        ("a", 9.0, "new"), ("a", 5.0, "price_drop"), ("a", 4.0, "price_drop"), ("b", 1.0, "new"), ("b", 2.0, "out_of_stock")
    ]
    assert _plain(alerts) == _batch(spark, early + middle + late)
    written = spark.read.schema(schema).parquet(f"{folder}/table")
    assert [(r.dedup_key, r.price) for r in written.where("late").collect()] == [("a", 9.0)]


def test_keys_share_state_and_timers(spark, tmp_path):
    rows = _rows(3000, 2500, 300, 4)
    folder = str(tmp_path)
    _write(spark, folder, rows, END)
    seen = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    alerts = stream_alerts(seen, "3 days", 100 * DAY, order=ORDER, groups=16)
    stream = write_alerts(alerts, f"{folder}/table", f"{folder}/checkpoint")
    stream.awaitTermination()
    timers = [s["customMetrics"]["numRegisteredTimers"] for p in stream.recentProgress for s in p["stateOperators"]]
    assert 0 < max(timers) <= 16  # one for each group, however many keys and buckets it has
    assert _plain(read_alerts(spark, f"{folder}/table", alerts.schema, order=ORDER)) == _batch(spark, rows)


def test_an_order_that_names_the_price_is_refused(spark):
    seen = spark.readStream.schema(DDL).parquet("/root/testdata/none-*")
    with pytest.raises(ValueError):
        stream_alerts(seen, order=("scraped_at", "price"))
