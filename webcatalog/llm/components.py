"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcatalog.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a long, b long)``.

    ``component`` is the smallest node that links reach. Each round points a node's
    neighbours at its smallest one (large star, then small star), so rounds grow with the
    logarithm of the longest path. Minima combine before the shuffle, and the join back to
    the links is one that AQE may split, so a hub's links need not meet in one task. Every
    round is written to the shared folder. Null ends and self-links are ignored; an empty
    table gives an empty table.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, upward=True)
        edges = written(_star(large.where("a > b"), upward=False), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select("b", "b").distinct())


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """Links from each node's neighbours (only larger ones if ``upward``) to its smallest."""
    lows = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    joined = edges.join(lows, "a")
    if upward:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(
            lows.select("a", F.col("low").alias("b"))
        )
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and fingerprint of the links."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
