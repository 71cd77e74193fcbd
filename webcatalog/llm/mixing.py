"""Temperature mixing of sources to target weights.

A source's share p of all tokens becomes the weight p**a / sum(p**a). The exponent a is found
by bisection (sixteen parts at a time, each round one aggregation over the table of sources):
the largest a whose weights reach ``target_entropy`` (nats), or the smallest whose sources are
repeated at most ``repetition_limit`` times as often as the least repeated one.

The budget is the smallest that holds the least repeated source once, so weights are met by
repeating small sources and no document is lost. A source that is due r passes gets floor(r)
whole ones, and of the last one as many documents as the rest of its budget holds. Every pass
permutes the source's blocks (documents grouped by hash, ``BLOCK_TOKENS`` each) by a hash of
(source, block, pass); ``mix_order`` sorts passes of all sources into one stream.

Scale: documents are handled as narrow rows. The running sum within the last pass is taken in
two steps, over up to ``BUCKETS`` ranges of the permutation and inside each, so that a source
with a third of all rows spreads over many tasks.

Defined results: null source is a source; null text has no tokens; sources without tokens get
one pass and no weight; rows that are equal in all columns count as often as they occur, and rows that
differ in any are told apart; columns named like the
results are ignored or replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcatalog.llm.common import drop_tables, row_tie, whole_text, written

BLOCK_TOKENS = 65_536
BUCKETS = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """``(doc_id, tie, source, tokens)``: words of each whole text; ``tie`` is the row's digest."""
    text = whole_text()
    return docs.select(
        "doc_id", row_tie(docs).alias("tie"), "source", F.regexp_count(text, F.lit("[^ \\x09-\\x0D]+")).cast("long").alias("tokens")
    )


def _spread(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest ratio of repetitions) of the weights at each exponent."""
    sums = [F.sum(F.pow("p", F.lit(a))) for a in exponents]
    logs = [F.sum(F.pow("p", F.lit(a)) * F.log("p")) for a in exponents]
    row = shares.agg(F.min("p"), F.max("p"), *sums, *logs).first()
    low, high = row[0], row[1]
    out = []
    for k, a in enumerate(exponents):
        z, m = row[2 + k], row[2 + len(exponents) + k]
        out.append((math.log(z) - a * m / z, max((low / high) ** (a - 1), (low / high) ** (1 - a))))
    return out


def find_exponent(shares: DataFrame, target_entropy: float | None, repetition_limit: float | None, rounds: int = 7) -> float:
    """The exponent in [0, 1] that meets the target; 1 where even that does, 0 where none does."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")
    if shares.isEmpty():
        return 1.0

    def meets(found: tuple[float, float]) -> bool:
        return found[0] >= target_entropy if target_entropy is not None else found[1] <= repetition_limit

    # Falling exponents raise the entropy and the repetitions: one bound holds below, the other above.
    rising = repetition_limit is not None
    low, high = 0.0, 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * k / 16 for k in range(17)]
        good = [meets(x) for x in _spread(shares, grid)]
        if rising:
            k = good.index(True) if True in good else 16
            low, high = grid[max(0, k - 1)], grid[k]
        else:
            k = max((i for i, g in enumerate(good) if g), default=0)
            low, high = grid[k], grid[min(16, k + 1)]
    return high if rising else low


def weights(sized: DataFrame, target_entropy: float | None, repetition_limit: float | None) -> DataFrame:
    """``(source, source_tokens, share, weight, passes)`` of every source."""
    totals = written(sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens")), "sources")
    tokens = totals.agg(F.sum("source_tokens")).first()[0] or 0
    share = F.col("source_tokens") / F.lit(max(tokens, 1))
    has_tokens = F.col("source_tokens") > 0
    a = find_exponent(totals.where(has_tokens).select(share.alias("p")), target_entropy, repetition_limit)
    raw = F.pow(share, F.lit(a))
    norm, least = totals.where(has_tokens).agg(F.sum(raw), F.min(raw / share)).first()
    weight = F.when(has_tokens, raw / F.lit(norm)).otherwise(0.0)
    passes = F.when(has_tokens, F.round(raw / share / F.lit(least), 9)).otherwise(1.0)
    return totals.select("source", "source_tokens", share.alias("share"), weight.alias("weight"), passes.alias("passes"))


def mix(
    sized: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, seed: int = 0,
) -> DataFrame:
    """``(doc_id, tie, source, tokens, epoch, block, mix_order)``, a row for each time a document is used.

    ``sized`` is the written result of ``sizes``.
    """
    due = written(weights(sized, target_entropy, repetition_limit), "weights").withColumnRenamed("source", "of_source")
    rows = sized.join(due, F.col("source").eqNullSafe(F.col("of_source")))
    blocks = F.greatest(F.lit(1), F.expr(f"source_tokens div {BLOCK_TOKENS}"))
    rows = rows.select(
        "doc_id", "tie", "source", "tokens", F.floor("passes").alias("whole"),
        F.round((F.col("passes") - F.floor("passes")) * F.col("source_tokens")).cast("long").alias("rest"),
        F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), blocks).alias("block"),
    )
    order = lambda epoch: F.xxhash64("source", "block", epoch, F.lit(seed))
    whole = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
    last = rows.where("rest > 0").withColumn("epoch", F.col("whole"))
    last = last.withColumn("turn", order("epoch"))
    last = last.withColumn("range", F.pmod(F.col("turn"), F.lit(BUCKETS)))
    ranges = last.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
    ranges = ranges.select(
        F.col("source").alias("of_source"), F.col("range").alias("of_range"), F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("source", "range").orderBy("turn", "block", F.xxhash64("doc_id", "tie", "epoch"), "doc_id", "tie")
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("upto", F.sum("tokens").over(inside))
    last = last.join(ranges, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("range") == F.col("of_range")))
    last = last.where("2 * (before + upto) - tokens <= 2 * rest")  # its middle lies within the budget
    columns = ["doc_id", "tie", "source", "tokens", "epoch", "block"]
    both = whole.select(*columns).union(last.select(*columns))
    return both.withColumn("mix_order", order("epoch"))


def realise(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, one for each use, in ``mix_order`` over the partitions.

    Rows of one block and pass follow each other in the order of a hash.
    """
    sized = written(sizes(docs), "sizes")
    mixed = mix(sized, target_entropy, repetition_limit, seed)
    place = F.xxhash64("tie", "epoch", F.lit(seed)).alias("place")
    uses = written(mixed.select("tie", "epoch", "mix_order", place), "uses")
    drop_tables(sized)
    uses = uses.select(F.col("tie").alias("used"), F.struct("mix_order", "place", "epoch", "tie").alias("use"))
    once = docs.withColumn("of", row_tie(docs)).dropDuplicates(["of"])  # each of equal rows has its own uses
    joined = once.join(uses, F.col("of") == F.col("used"))  # rows already lie by ``of``
    return joined.repartitionByRange("use.mix_order", "use.place").sortWithinPartitions("use").select(docs.columns)
