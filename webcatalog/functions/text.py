"""JSON found in free text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_START = re.compile(r"[{\[]")
_DECODER = json.JSONDecoder(parse_constant=lambda _: None)


def find_json(text: str | None) -> str | None:
    """First JSON object or array of a text (inside a fence if there is one), re-serialised."""
    text = (text or "").strip()
    fenced = _FENCE.search(text)
    if fenced:
        text = fenced[1].strip()
    start = _START.search(text)
    if start is None:
        return None
    try:
        return json.dumps(_DECODER.raw_decode(text, start.start())[0])
    except (ValueError, RecursionError):
        return None


def _find(texts: pa.Array) -> pa.Array:
    return pa.array([find_json(t) for t in texts.to_pylist()], pa.string())


def first_json(text: Column | str) -> Column:
    return F.arrow_udf(_find, "string")(text)
