"""Small building blocks for the other column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as Unicode defines it, plus the ASCII separators, for ``strip``.
_SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Every kind of line break.
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
# The same one by one: a pair of two leaves a blank line, which ``lines`` drops.
_BREAK = r"[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"


def reusable(build: Callable) -> Callable:
    """Keep what ``build(*args)`` returns for the life of the JVM.

    For large column expressions over fixed column names: they are plain expression trees, and
    assembling one takes far longer than using it again.
    """
    made: dict = {}

    @functools.wraps(build)
    def get(*args):
        key = (id(SparkContext._active_spark_context._jvm), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any Unicode kind.

    Looks at both ends only: a pattern would be tried at every character of a long text.
    """
    return F.trim(text, F.lit(_SPACE))


def lines(text: Column) -> Column:
    """Split at every kind of line break, strip each line and drop blank ones."""
    parts = F.split(text, _BREAK)
    return F.filter(F.transform(parts, strip), lambda line: line != "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def distinct_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """Items of an array whose key appears for the first time; null keys all stay."""
    first = lambda keys, i: F.array_position(keys, F.get(keys, i)) == (i + 1)
    return let(
        F.transform(items, key),
        lambda keys: F.filter(items, lambda _, i: F.coalesce(first(keys, i), F.lit(True))),
    )


def last_wins_map(entries: Column) -> Column:
    """Map from ``struct(key, value)`` entries where a later entry replaces an earlier one."""
    return F.map_from_entries(
        F.filter(
            entries,
            lambda entry, i: ~F.exists(
                F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == entry["key"]
            ),
        )
    )


def explode_rows(df: DataFrame, keep: list[str], items: str, pos: str, value: str) -> DataFrame:
    """One row per array item.

    The outer form plus a null test on the position: an inner explode would make the optimizer
    infer ``size(items) > 0`` below it and so compute a costly array expression twice.
    """
    exploded = df.select(*keep, F.posexplode_outer(items).alias(pos, value))
    return exploded.where(F.col(pos).isNotNull())
