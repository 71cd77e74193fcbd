"""Catalog change alerts: new products, price moves, products going out of stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous_values(
    rows: DataFrame, key: str, order: list[str], bucket: Column, values: list[str]
) -> DataFrame:
    """Add ``prev_<value>`` of the preceding row per key, and ``is_first``.

    A plain ``lag`` would sort a hot key in one task. Here rows are ordered within
    (key, bucket) only; the last values of each bucket, one row per bucket, link the buckets.
    ``bucket`` must not decrease along ``order``.
    """
    bucketed = rows.withColumn("_bucket", bucket)
    last = bucketed.groupBy(key, "_bucket").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    chain = Window.partitionBy(key).orderBy("_bucket")
    before = last.select(key, "_bucket", F.lag("_last").over(chain).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    lagged = bucketed.withColumn("_prev", F.lag(F.struct(*values)).over(inside)).join(
        before, [key, "_bucket"], "left"
    )
    prev = F.coalesce("_prev", "_before")
    out = lagged.withColumn("_p", prev)
    return out.select(
        *rows.columns,
        *[F.col(f"_p.{v}").alias(f"prev_{v}") for v in values],
        F.col("_p").isNull().alias("is_first"),
    )


def change_alerts(
    observations: DataFrame, key: str = "dedup_key", order: tuple[str, ...] = ("scraped_at",),
    bucket: Column | None = None,
) -> DataFrame:
    """Observations (key, price, availability, order columns) that are an event.

    ``new``, ``price_drop``, ``price_rise``, ``out_of_stock`` (the latter wins over a price move).
    """
    bucket = bucket if bucket is not None else F.date_trunc("month", F.col(order[0]))
    seen = previous_values(observations, key, list(order), bucket, ["price", "availability"])
    gone = (F.col("availability") == "out_of_stock") & (F.col("prev_availability") != "out_of_stock")
    event = (
        F.when(F.col("is_first"), "new")
        .when(gone, "out_of_stock")
        .when(F.col("price") < F.col("prev_price"), "price_drop")
        .when(F.col("price") > F.col("prev_price"), "price_rise")
    )
    return seen.withColumn("event", event).where("event is not null").drop("is_first")
