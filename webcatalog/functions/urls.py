"""URL expressions: splitting, resolving, domains, templates and query parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcatalog.functions.basics import blank_to_null, let

# scheme, authority with its slashes, path, query with its mark, fragment with its mark
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
# Fixed set of schemes whose references may be relative.
_RELATIVE_SCHEMES = ["", "http", "https", "ftp", "file", "sftp"]


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def url_scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def url_host(url: Column) -> Column:
    """Authority as written, with port and user info; empty when there is none."""
    return F.substring(_part(url, 2), 3, 1 << 30)


def url_path(url: Column) -> Column:
    return _part(url, 3)


def url_query(url: Column) -> Column:
    return F.substring(_part(url, 4), 2, 1 << 30)


def strip_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def domain_of(url: Column) -> Column:
    """Lower-cased authority (the whole text without one), minus a leading ``www.``."""
    host = F.lower(F.coalesce(blank_to_null(url_host(url)), url))
    return F.regexp_replace(host, r"^www\.", "")


def infer_template(url: Column) -> Column:
    path = url_path(url)
    return (
        F.when(path.contains("/product/"), "product-detail")
        .when(path.contains("/catalog/"), "catalog-listing")
        .otherwise("generic")
    )


def _tail(query: Column, fragment: Column) -> Column:
    keep = lambda c: F.when(F.length(c) > 1, c).otherwise("")
    return F.concat(keep(query), keep(fragment))


def _clean_path(segments: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    # A reference that ends in dots names a folder, so it keeps a closing slash.
    walk = F.when(
        F.element_at(segments, -1).isin(".", ".."), F.concat(segments, F.array(F.lit("")))
    ).otherwise(segments)
    walked = F.aggregate(
        walk,
        F.array().cast("array<string>"),
        lambda kept, seg: F.when(seg == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .when(seg == ".", kept)
        .otherwise(F.concat(kept, F.array(seg))),
    )
    return F.coalesce(blank_to_null(F.array_join(walked, "/")), F.lit("/"))


def _merged_segments(base_path: Column, path: Column) -> Column:
    # The base without its last segment, then the reference; empty segments only count at
    # either end of a merged path.
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    joined = F.regexp_replace(F.concat(folder, path), "/{2,}", "/")
    return F.split(F.when(path.startswith("/"), path).otherwise(joined), "/")


def split_url(url: Column) -> Column:
    """``struct<raw, scheme, host, path, query, fragment>``; host, query and fragment keep
    their marks."""
    return F.struct(
        url.alias("raw"),
        url_scheme(url).alias("scheme"),
        _part(url, 2).alias("host"),
        url_path(url).alias("path"),
        _part(url, 4).alias("query"),
        _part(url, 5).alias("fragment"),
    )


def _resolve(ref: Column, top: Column, href: Column) -> Column:
    scheme = F.when(top["scheme"] == "", "").otherwise(F.concat(top["scheme"], F.lit(":")))
    same_page = (ref["path"] == "") & (F.length(ref["query"]) <= 1)
    merged = F.when(ref["path"] == "", top["path"]).otherwise(
        let(_merged_segments(top["path"], ref["path"]), _clean_path)
    )
    query = F.when(same_page, top["query"]).otherwise(ref["query"])
    own = F.concat(
        F.when(ref["scheme"] == "", scheme).otherwise(F.concat(ref["scheme"], F.lit(":"))),
        ref["host"], ref["path"], _tail(ref["query"], ref["fragment"]),
    )

    def joined(path: Column) -> Column:
        # ``..`` beyond the root may eat the leading slash; an authority needs it back.
        bare = (F.length(top["host"]) > 2) & (path != "") & ~path.startswith("/")
        slash = F.when(bare, F.lit("/")).otherwise("")
        return F.concat(scheme, top["host"], slash, path, _tail(query, ref["fragment"]))

    foreign = (ref["scheme"] != "") & (ref["scheme"] != top["scheme"])
    return (
        F.when(foreign | ~top["scheme"].isin(_RELATIVE_SCHEMES), href)
        .when(F.length(ref["host"]) > 2, own)
        .otherwise(let(merged, joined))
    )


def abs_url(href: Column, base: Column) -> Column:
    """Resolve a reference against a split base URL (:func:`split_url`); null for an empty one."""
    tidy = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    resolved = let(split_url(tidy), lambda ref: _resolve(ref, base, href))
    return F.when(href != "", F.when(F.coalesce(base["raw"], F.lit("")) == "", href).otherwise(resolved))


def query_params(url: Column) -> Column:
    """``array<struct<key, value>>`` of the non-blank query parameters, decoded, in order."""
    decode = lambda text: F.coalesce(F.try_url_decode(text), text)
    pairs = F.transform(
        F.split(url_query(url), "&"),
        lambda pair: F.struct(
            decode(F.substring_index(pair, "=", 1)).alias("key"),
            F.when(
                pair.contains("="), decode(F.substr(pair, F.instr(pair, "=") + 1))
            ).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")
