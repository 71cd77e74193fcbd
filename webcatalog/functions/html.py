"""The parse pass: raw HTML to a flat, position-indexed document column.

This is the only Python step of the HTML jobs. It ships just the ``html`` column through
Arrow and returns one struct per page, so every later step (selectors, links, JSON-LD
records, text views) is a Catalyst expression over the page's own row and needs no shuffle.

Elements are numbered in document order. ``tail`` is the number of the last descendant, so
"is inside" is an interval test; ``t0``/``t1`` delimit the element's strings within
``texts``, so element text is a slice and nothing is stored twice.
"""

from __future__ import annotations

import gc
import html as _html
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN, CHROME = 1, 2  # bits of ``skip`` / ``text_skip``

DOC_DDL = (
    "struct<elems: array<struct<idx: int, tail: int, parent: int, tag: string,"
    " classes: array<string>, attrs: map<string, string>, t0: int, t1: int, skip: int>>,"
    " texts: array<string>, text_skip: array<int>, blocks: int, block_types: array<string>,"
    " nodes: array<struct<types: array<string>, listed: boolean, json: string>>>"
)

_ELEM = pa.struct(
    [
        ("idx", pa.int32()),
        ("tail", pa.int32()),
        ("parent", pa.int32()),
        ("tag", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("t0", pa.int32()),
        ("t1", pa.int32()),
        ("skip", pa.int32()),
    ]
)
_NODE = pa.struct([("types", pa.list_(pa.string())), ("listed", pa.bool_()), ("json", pa.string())])

_COMMENT = r"!--.*?-->|"
_QUOTED = r"(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|"


def _token(comments: bool, quotes: bool) -> re.Pattern:
    loose = r"(?P<loose>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>"
    tags = (_QUOTED if quotes else r"(?P<open>(?!))(?P<attrs>)|") + loose
    return re.compile(f"<(?:{_COMMENT if comments else ''}[!?][^>]*>|/(?P<close>[a-zA-Z][^\\s/>]*)[^>]*>|{tags})", re.S)


# By whether a comment's end lies ahead, and whether quotes are still worth following.
_TOKENS = {(c, q): _token(c, q) for c in (True, False) for q in (True, False)}
# Tags with unclosed quotes are tried up to so many times the page's length in all.
_TRIES = 20
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\s*$")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")

# Fixed values of the HTML grammar.
_VOID = frozenset(
    "area base basefont br col embed frame hr img input link meta param source track wbr".split()
)
_RAW = frozenset(["script", "style"])
_RAW_ENDS = {tag: re.compile(f"</{tag}[^>]*>", re.I) for tag in _RAW}
_HEAD_ONLY = frozenset(["script", "style", "meta", "link", "title", "base"])
_BLOCKS = frozenset(
    "address article aside blockquote center dd dir div dl dt fieldset footer form h1 h2 h3 h4 h5"
    " h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_ENDS_ITEM = {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]),
    "tr": frozenset(["td", "th", "tr", "p"]),
    "tbody": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "p"]),
    "thead": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "p"]),
    "tfoot": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "p"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
    "a": frozenset(["a"]),
}
# A close tag cannot close through an open element of higher rank.
_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}
_SKIP_BITS = {
    "script": HIDDEN, "style": HIDDEN, "noscript": HIDDEN, "svg": HIDDEN,
    "header": CHROME, "footer": CHROME, "nav": CHROME,
}
# The node types that extraction and discovery read.
EXTRACTED_TYPES = ("Product", "ItemList", "BreadcrumbList")
# Markup parsed at once: its Python objects take a multiple of it. A page counts for so much at least.
_PART_BYTES, _PAGE_BYTES = 1 << 20, 1 << 10
# These many nodes of a page always keep their JSON.
_SAMPLE_NODES = 3


def _decode(text: str) -> str:
    return _ENTITY.sub(lambda m: _html.unescape(m.group()), text) if "&" in text else text


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(source):
        out.setdefault(name.lower(), _decode(double or single or bare))
    return out


class _Page:
    """Elements, strings and JSON-LD of one page."""

    __slots__ = ("tags", "parents", "tails", "classes", "attrs", "t0", "t1", "skip",
                 "texts", "text_skip", "blocks", "block_types", "nodes", "stack",
                 "seen_head", "seen_body", "kept_types")

    def __init__(self, source: str, kept_types: frozenset[str] | None = None) -> None:
        self.kept_types = kept_types
        self.tags, self.parents, self.tails, self.classes, self.attrs = [], [], [], [], []
        self.t0, self.t1, self.skip, self.texts, self.text_skip = [], [], [], [], []
        self.blocks, self.block_types, self.nodes, self.stack = 0, set(), [], []
        self.seen_head = self.seen_body = False
        if not source.strip():
            return
        self._push("html", {})
        self._scan(source)
        self._pop_to(0)

    def _scan(self, source: str) -> None:
        at, wasted = 0, 0
        comments, quotes = source.rfind("-->"), True
        last = source.rfind(">")  # beyond it nothing can be markup
        while at <= last and (match := _TOKENS[at < comments, quotes].search(source, at)):
            if match.start() > at:
                self._text(source[at : match.start()])
            at = match.end()
            close, name, markup, loose, rest = match.groups()
            if loose:
                wasted += len(source) - at
                quotes = wasted <= _TRIES * len(source)
                name, markup = loose, rest
            if close:
                self._close(close.lower())
            elif name:
                tag = name.lower()
                attrs = _attributes(markup) if markup else {}
                self._open(tag, attrs)
                if tag in _RAW:
                    end = _RAW_ENDS[tag].search(source, at) if at <= last else None
                    stop, at = (end.start(), end.end()) if end else (len(source),) * 2
                    if tag == "script" and attrs.get("type") == "application/ld+json":
                        self._jsonld(source[match.end() : stop])
                    self._pop_to(len(self.stack) - 1)
                elif tag in _VOID or (markup and _SELF_CLOSED.search(markup)):
                    if self.tags[self.stack[-1]] == tag and tag not in ("html", "head", "body"):
                        self._pop_to(len(self.stack) - 1)
        if at < len(source):
            self._text(source[at:])

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        stack, tags, skip = self.stack, self.tags, self.skip
        above = stack[-1] if stack else -1
        stack.append(len(tags))
        tags.append(tag)
        self.parents.append(above)
        self.tails.append(0)
        self.t0.append(len(self.texts))
        self.t1.append(0)
        names = attrs.pop("class", None) if attrs else None
        self.classes.append(None if names is None else names.split())
        self.attrs.append(list(attrs.items()) if attrs else ())
        skip.append((skip[above] if above >= 0 else 0) | _SKIP_BITS.get(tag, 0))

    def _pop_to(self, depth: int) -> None:
        stack, tails, t1 = self.stack, self.tails, self.t1
        last, texts = len(self.tags) - 1, len(self.texts)
        while len(stack) > depth:
            idx = stack.pop()
            tails[idx] = last
            t1[idx] = texts

    def _open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":  # the root exists already: it only takes over the attributes
            names = attrs.pop("class", None)
            self.classes[0] = names.split() if names is not None else self.classes[0]
            self.attrs[0] = self.attrs[0] or list(attrs.items())
            return
        if tag == "head":
            if self.seen_head or self.seen_body:
                return
            self.seen_head = True
        elif tag == "body":
            if self.seen_body:
                return
            self._enter_body(push=False)
        elif not self.seen_body:
            if tag not in _HEAD_ONLY:
                self._enter_body(push=True)
            elif not self.seen_head:
                self.seen_head = True
                self._push("head", {})
        ends = _ENDS_ITEM.get(tag)
        if ends is None:
            ends = ("p",) if tag in _BLOCKS else ()
        while len(self.stack) > 1 and self.tags[self.stack[-1]] in ends:
            self._pop_to(len(self.stack) - 1)
        self._push(tag, attrs)

    def _enter_body(self, push: bool) -> None:
        self._pop_to(1)
        self.seen_body = True
        if push:
            self._push("body", {})

    def _close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return  # both stay open until the end, so trailing markup keeps its place
        stack, tags, rank = self.stack, self.tags, None
        for depth in range(len(stack) - 1, 0, -1):
            name = tags[stack[depth]]
            if name == tag:
                self._pop_to(depth)
                return
            if rank is None:
                rank = _RANK.get(tag, 100)
            if _RANK.get(name, 100) > rank:
                return

    def _text(self, raw: str) -> None:
        text = _decode(raw).strip()
        if not text:
            return
        if len(self.stack) == 1 and not self.seen_body:
            self._enter_body(push=True)
        elif self.tags[self.stack[-1]] == "head":
            self._enter_body(push=True)
        self.texts.append(text)
        self.text_skip.append(self.skip[self.stack[-1]])

    def _jsonld(self, raw: str) -> None:
        self.blocks += 1
        try:
            data = json.loads(raw, parse_constant=lambda _: None)
            for top in data if isinstance(data, list) else [data]:
                if isinstance(top, dict):
                    self.block_types.update(_types(top))
            self._walk(data)
        except (ValueError, RecursionError):
            return

    def _walk(self, data) -> None:
        pending = [data]
        while pending:  # pre-order, without recursion
            item = pending.pop()
            if isinstance(item, list):
                pending.extend(reversed(item))
            elif isinstance(item, dict):
                types = _types(item)
                keep = self.kept_types is None or len(self.nodes) < _SAMPLE_NODES or not self.kept_types.isdisjoint(types)
                self.nodes.append((types, isinstance(item.get("@type"), list), _dumped(item) if keep else None))
                pending.extend(reversed(list(item.values())))


_JSON = json.JSONEncoder(ensure_ascii=False)


def _dumped(item: dict) -> str:
    text = _JSON.encode(item)
    if text.isascii():
        return text
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair
        return json.dumps(item)
    return text


def _types(node: dict) -> list[str]:
    declared = node.get("@type")
    names = declared if isinstance(declared, list) else [declared]
    return [n.encode("utf-8", "replace").decode() for n in names if isinstance(n, str)]


def _lists(groups: list[list], value_type: pa.DataType) -> pa.Array:
    offsets, flat = [0], []
    for group in groups:
        flat.extend(group)
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(flat, value_type), type=pa.list_(value_type)
    )


def _maps(groups: list) -> pa.Array:
    """Maps of (name, value) pairs."""
    offsets, pairs = [0], []
    for group in groups:
        pairs.extend(group)
        offsets.append(len(pairs))
    names, values = zip(*pairs) if pairs else ((), ())
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))


def _nodes(pages: list[_Page]) -> pa.Array:
    offsets, flat = [0], []
    for page in pages:
        flat.extend(page.nodes)
        offsets.append(len(flat))
    columns = zip(*flat) if flat else [()] * len(_NODE)
    nodes = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _NODE)], fields=list(_NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def _documents(pages: list[_Page]) -> pa.StructArray:
    bounds, idx, columns = [0], [], {name: [] for name in _ELEM.names if name != "idx"}
    for page in pages:
        idx.extend(range(len(page.tags)))
        for name, values in zip(
            columns,
            (page.tails, page.parents, page.tags, page.classes, page.attrs,
             page.t0, page.t1, page.skip),
        ):
            columns[name].extend(values)
        bounds.append(len(idx))
    columns["idx"] = idx
    elems = pa.StructArray.from_arrays(
        [_maps(columns["attrs"]) if f.name == "attrs" else pa.array(columns[f.name], f.type) for f in _ELEM],
        fields=list(_ELEM),
    )
    parts = {
        "elems": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), elems),
        "texts": _lists([p.texts for p in pages], pa.string()),
        "text_skip": _lists([p.text_skip for p in pages], pa.int32()),
        "blocks": pa.array([p.blocks for p in pages], pa.int32()),
        "block_types": _lists(
            [[json.dumps(t) for t in sorted(p.block_types)] for p in pages], pa.string()
        ),
        "nodes": _nodes(pages),
    }
    return pa.StructArray.from_arrays(list(parts.values()), names=list(parts))


def _parsed(texts: list[str | None], kept: frozenset[str] | None) -> pa.StructArray:
    """Pages of one part, without looking for cycles among their many small objects: they have none."""
    collects = gc.isenabled()
    gc.disable()
    try:
        return _documents([_Page(text or "", kept) for text in texts])
    finally:
        if collects:
            gc.enable()


def _parts(source: pa.Array) -> Iterator[pa.Array]:
    """A batch of pages in parts of ``_PART_BYTES`` (a longer page alone), at least one."""
    sizes = pc.fill_null(pc.binary_length(source), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > _PART_BYTES:
            yield source.slice(start, i - start)
            start, held = i, 0
        held += size + _PAGE_BYTES
    yield source.slice(start)


def parse_html(html: Column | str, node_types: Iterable[str] | None = None) -> Column:
    """Document struct of an HTML column (see ``DOC_DDL``).

    ``node_types`` names the JSON-LD types whose nodes keep their JSON (the first three nodes
    of a page always do); by default all nodes do.
    """
    kept = None if node_types is None else frozenset(node_types)

    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for source in batches:
            for part in _parts(source):
                yield _parsed(part.to_pylist(), kept)

    return F.arrow_udf(parse, DOC_DDL)(html)
