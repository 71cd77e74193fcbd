"""Crawl state and catalog tables: keyed merges as aggregations, never as sorted groups.

Order is always an explicit ``seq``; ``max_by``/``min_by`` combine on the map side, so one hot
key costs no more than its share of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    """The last row per key, all columns taken from that one row (nulls included)."""
    return _one_row(rows, key, order, F.max_by)


def earliest(rows: DataFrame, key: str, order: Column | str) -> DataFrame:
    return _one_row(rows, key, order, F.min_by)


def _one_row(rows: DataFrame, key: str, order: Column | str, pick) -> DataFrame:
    others = [c for c in rows.columns if c != key]
    order = F.col(order) if isinstance(order, str) else order
    picked = rows.groupBy(key).agg(pick(F.struct(*others), order).alias("row"))
    return picked.select(key, "row.*").select(*rows.columns)


def upsert_products(existing: DataFrame | None, batch: DataFrame, order: Column | str) -> DataFrame:
    """Upsert on ``dedup_key``: the last write wins on every column.

    ``order`` ranks the rows of the batch; any batch row replaces an existing one. A first load
    (``existing=None``) is a plain aggregation of the batch.
    """
    order = F.col(order) if isinstance(order, str) else order
    columns = [c for c in (existing.columns if existing is not None else batch.columns)]
    new = batch.withColumn("_order", F.struct(F.lit(1).alias("age"), order.alias("at")))
    if existing is not None:
        kind = new.schema["_order"].dataType["at"].dataType
        old = existing.withColumn(
            "_order", F.struct(F.lit(0).alias("age"), F.lit(None).cast(kind).alias("at"))
        )
        new = old.unionByName(new.select(*columns, "_order"))
    return latest(new, "dedup_key", "_order").drop("_order").select(*columns)


def enqueue(frontier: DataFrame | None, urls: DataFrame) -> DataFrame:
    """Insert-if-absent: new URLs enter as pending, the first writer (by ``seq``) wins.

    ``urls`` has url, kind, source_category, seq and at.
    """
    first = earliest(urls, "url", "seq").select(
        "url", "kind", F.lit("pending").alias("status"), "source_category",
        F.lit(0).alias("attempts"), F.col("at").alias("updated_at"), "seq",
    )
    if frontier is None:
        return first
    return frontier.unionByName(first.join(frontier.select("url"), "url", "left_anti"))


def seed_frontier(seeds: DataFrame, at: Column) -> DataFrame:
    """Seeds (seq, name, url) as category rows of a fresh frontier."""
    return enqueue(
        None,
        seeds.select(
            "url", F.lit("category").alias("kind"), F.col("name").alias("source_category"), "seq",
            at.alias("at"),
        ),
    )


def pending(frontier: DataFrame, kind: str | None = None) -> DataFrame:
    rows = frontier.where("status = 'pending'")
    return rows.where(F.col("kind") == kind) if kind else rows


def mark(frontier: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Apply fetch outcomes (url, status, at, seq): last status wins, each one counts as an attempt."""
    last = outcomes.groupBy("url").agg(
        F.count("*").cast("int").alias("tries"),
        F.max_by(F.struct("status", "at"), "seq").alias("last"),
    )
    done = F.col("tries").isNotNull()
    return frontier.join(last, "url", "left").select(
        "url", "kind",
        F.when(done, F.col("last.status")).otherwise(F.col("status")).alias("status"),
        "source_category",
        (F.col("attempts") + F.coalesce("tries", F.lit(0))).alias("attempts"),
        F.when(done, F.col("last.at")).otherwise(F.col("updated_at")).alias("updated_at"),
        "seq",
    )


def dead_letter(state: DataFrame | None, failures: DataFrame) -> DataFrame:
    """Upsert failures (url, error, attempts, failed_at, seq) on url."""
    new = latest(failures, "url", "seq").drop("seq")
    if state is None:
        return new
    return state.join(new.select("url"), "url", "left_anti").unionByName(new)


def fail(
    frontier: DataFrame, letters: DataFrame | None, failures: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Dead-letter the failures and mark their URLs as failed."""
    outcomes = failures.select("url", F.lit("failed").alias("status"), F.col("failed_at").alias("at"), "seq")
    return mark(frontier, outcomes), dead_letter(letters, failures)


def request_help(state: DataFrame | None, requests: DataFrame) -> DataFrame:
    """Upsert help requests (url, reason, suggested_action, requested_at, seq).

    A repeated request replaces reason, action and time but keeps the ``resolved`` mark.
    """
    new = latest(requests, "url", "seq").drop("seq")
    if state is None:
        return new.withColumn("resolved", F.lit(False))
    resolved = state.select("url", F.col("resolved").alias("_resolved"))
    merged = new.join(resolved, "url", "left").select(
        *new.columns, F.coalesce("_resolved", F.lit(False)).alias("resolved")
    )
    return state.join(new.select("url"), "url", "left_anti").unionByName(merged)


def help_queue(state: DataFrame, include_resolved: bool = False) -> DataFrame:
    return state if include_resolved else state.where("not resolved")


def reset_frontier(frontier: DataFrame) -> DataFrame:
    """A fresh run forgets the frontier only; catalog and dead letters stay."""
    return frontier.limit(0)


def cap_products(frontier: DataFrame, max_products: int | None) -> DataFrame:
    """First pending product URLs in enqueue order; 0 or None keeps them all."""
    rows = pending(frontier, "product")
    return rows.orderBy("seq").limit(max_products) if max_products else rows


def product_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("products"))
