"""CSS selectors as data, matched by Catalyst expressions over a document's elements.

Selectors live in profile tables, so they are compiled once per distinct profile (a short
Arrow step over that small table) into arrays of steps. Matching a step is a filter over the
page's elements; a combinator is an interval test against the elements matched so far.
Supported: tag, ``*``, ``.class``, ``#id``, attribute tests, descendant, child and comma.
Anything else compiles to null and is reported in the extraction notes.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, let

SELECTOR_DDL = (
    "array<array<struct<child: boolean, root: boolean, tag: string, classes: array<string>,"
    " tests: array<struct<name: string, op: string, value: string>>>>>"
)
_STEP = pa.struct(
    [
        ("child", pa.bool_()),
        ("root", pa.bool_()),
        ("tag", pa.string()),
        ("classes", pa.list_(pa.string())),
        (
            "tests",
            pa.list_(pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())])),
        ),
    ]
)
SELECTOR_ARROW = pa.list_(pa.list_(_STEP))

_NAME = r"-?[_a-zA-Z\u0080-\U0010ffff][-\w\u0080-\U0010ffff]*"
_ATTR = rf"""\[\s*({_NAME})\s*(?:([*^$~|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]"']+))\s*)?\]"""
_PIECE = re.compile(rf"\.({_NAME})|#({_NAME})|{_ATTR}")
_COMPOUND = re.compile(rf"(\*|{_NAME})?((?:\.{_NAME}|#{_NAME}|{_ATTR})*)")
_COMBINATOR = re.compile(r"\s*([>,])\s*|\s+")


def compile_selector(selector: str | None) -> list[list[dict]] | None:
    """Steps of each comma-separated alternative; null when the syntax is not supported."""
    text = (selector or "").strip()
    chains, steps, link, at = [], [], "", 0
    while True:
        match = _COMPOUND.match(text, at)
        if not match.group():
            return None
        pieces = [p.groups() for p in _PIECE.finditer(match[2])]
        tests = [
            {"name": "id", "op": "=", "value": ident} if ident
            else {"name": name.lower(), "op": op or "", "value": double or single or bare or ""}
            for cls, ident, name, op, double, single, bare in pieces
            if not cls
        ]
        if any(t["op"] == "|=" for t in tests):
            return None
        tag = None if match[1] in (None, "*") else match[1].lower()
        steps.append(
            {"child": link == ">", "root": not steps, "tag": tag,
             "classes": [p[0] for p in pieces if p[0]], "tests": tests}
        )
        at = match.end()
        if at == len(text):
            return chains + [steps]
        gap = _COMBINATOR.match(text, at)
        if gap is None:
            return None
        link, at = gap[1] or " ", gap.end()
        if link == ",":
            chains.append(steps)
            steps = []


def attribute(elem: Column, name: Column) -> Column:
    """Attribute value of an element; ``class`` comes back space-joined."""
    return F.when(name == "class", F.array_join(elem["classes"], " ")).otherwise(
        F.try_element_at(elem["attrs"], name)
    )


def _passes(elem: Column, test: Column) -> Column:
    wanted, op = test["value"], test["op"]

    def check(value: Column) -> Column:
        return (
            F.when(op == "", value.isNotNull())
            .when(op == "=", value == wanted)
            .when(wanted == "", F.lit(False))
            .when(op == "*=", value.contains(wanted))
            .when(op == "^=", value.startswith(wanted))
            .when(op == "$=", value.endswith(wanted))
            .otherwise(F.array_contains(F.split(value, r"\s+"), wanted))
        )

    return F.coalesce(let(attribute(elem, test["name"]), check), F.lit(False))


def _matches(elem: Column, step: Column) -> Column:
    return (
        (step["tag"].isNull() | (step["tag"] == elem["tag"]))
        & F.forall(
            step["classes"],
            lambda c: F.coalesce(F.array_contains(elem["classes"], c), F.lit(False)),
        )
        & F.forall(step["tests"], lambda t: _passes(elem, t))
    )


def _chain(elems: Column, steps: Column) -> Column:
    def advance(found: Column, step: Column) -> Column:
        return F.filter(
            elems,
            lambda e: _matches(e, step)
            & (
                step["root"]
                | F.exists(
                    found,
                    lambda above: F.when(step["child"], e["parent"] == above["idx"]).otherwise(
                        inside(e, above)
                    ),
                )
            ),
        )

    return F.aggregate(steps, F.slice(elems, 1, 0), advance)


def inside(elem: Column, outer: Column) -> Column:
    return (elem["idx"] > outer["idx"]) & (elem["idx"] <= outer["tail"])


def first_after(elems: Column, number: Column) -> Column:
    """Position (from 0) of the first of ``elems`` whose number is above ``number``; their count if none is.

    ``elems`` are in document order, so halving finds it in as many steps as the count has bits.
    """
    halve = lambda span, middle: F.when(
        (span["lo"] < span["hi"]) & (F.get(elems, middle)["idx"] <= number),
        F.struct((middle + 1).alias("lo"), span["hi"].alias("hi")),
    ).otherwise(F.struct(span["lo"].alias("lo"), F.least(span["hi"], middle).alias("hi")))
    step = lambda span, _: let(F.shiftright(span["lo"] + span["hi"], 1), lambda middle: halve(span, middle))
    whole = F.struct(F.lit(0).alias("lo"), F.greatest(F.size(elems), F.lit(0)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(F.size(elems)))), whole, step, lambda span: span["lo"])


def all_inside(elems: Column, outer: Column) -> Column:
    """The elements inside ``outer``: a slice of ``elems``, which are in document order."""
    bounds = F.struct(first_after(elems, outer["idx"]).alias("lo"), first_after(elems, outer["tail"]).alias("hi"))
    return let(bounds, lambda b: F.slice(elems, b["lo"] + 1, b["hi"] - b["lo"]))


def first_inside(elems: Column, outer: Column) -> Column:
    """The first element inside ``outer``, null without one."""
    return let(F.get(elems, first_after(elems, outer["idx"])), lambda e: F.when(e["idx"] <= outer["tail"], e))


def select(elems: Column, selector: Column) -> Column:
    """Elements matching a compiled selector, in document order; empty without one."""
    found = F.flatten(F.transform(selector, lambda chain: _chain(elems, chain)))
    return let(
        F.coalesce(found, F.slice(elems, 1, 0)),
        lambda some: F.when(F.size(selector) > 1, _in_order(elems, some)).otherwise(some),
    )


def _in_order(elems: Column, some: Column) -> Column:
    numbers = F.transform(some, lambda e: e["idx"])
    return let(numbers, lambda ns: F.filter(elems, lambda e: F.array_contains(ns, e["idx"])))


def element_text(texts: Column, elem: Column, sep: str = " ") -> Column:
    return F.array_join(F.slice(texts, elem["t0"] + 1, elem["t1"] - elem["t0"]), sep)


def element_value(texts: Column, elem: Column, attr: Column) -> Column:
    """Text (null when empty) or the named attribute of an element."""
    wants_text = attr.isNull() | attr.isin("@text", "text")
    return F.when(wants_text, blank_to_null(element_text(texts, elem))).otherwise(
        attribute(elem, F.regexp_replace(attr, "^@", ""))
    )
