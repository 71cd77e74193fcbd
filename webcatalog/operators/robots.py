"""Exclusion rules: robots bodies to rule rows, and the filter they imply.

Bodies are read by column expressions: lines, then groups of agents and rules in one pass.
Rule paths and URLs are compared percent-decoded, so it doesn't matter how either is quoted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.basics import LINE_BREAK, first_where, strip
from webcatalog.functions.urls import url_host, url_scheme
from webcatalog.sources.local import broadcast_if_small

_GROUP = "struct<rules: array<struct<path: string, allow: boolean>>, delay: double>"
# ``state``: 0 outside a group, 1 after an agent line, 2 after a rule of the group.
_ACC = f"struct<state: int, own: boolean, any: boolean, group: {_GROUP}, mine: {_GROUP}, common: {_GROUP}>"


def unquoted(text: Column) -> Column:
    """Percent-decoded text; a plus stays one, and a percent sign that starts no code stays."""
    whole = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(whole), text)


def _tidy(path: Column) -> Column:
    """Without the marks of an empty query or fragment."""
    return F.regexp_replace(F.regexp_replace(path, "#$", ""), r"\?(?=#|$)", "")


def _lines(body: Column) -> Column:
    """``array<struct<blank, key, value>>`` of the lines of a body."""

    def line(raw: Column) -> Column:
        text = strip(F.regexp_replace(raw, "#.*$", ""))
        named = text.contains(":")
        value = strip(F.substr(text, F.instr(text, ":") + 1))
        return F.struct(
            (raw == "").alias("blank"), F.when(named, F.lower(strip(F.substring_index(text, ":", 1)))).alias("key"),
            F.when(named, unquoted(value)).alias("value"),
        )

    return F.transform(F.split(F.coalesce(body, F.lit("")), LINE_BREAK), line)


def _closed(acc: Column) -> dict[str, Column]:
    """``mine`` and ``common`` once the current group counts: the first group of each kind does."""
    ends = acc["state"] == 2
    mine = ends & acc["own"] & ~acc["any"] & acc["mine"].isNull()
    common = ends & acc["any"] & acc["common"].isNull()
    return {
        "mine": F.when(mine, acc["group"]).otherwise(acc["mine"]),
        "common": F.when(common, acc["group"]).otherwise(acc["common"]),
    }


def _step(agent: str):
    nothing = F.lit(None).cast(_GROUP)

    def packed(**parts: Column) -> Column:
        order = ("state", "own", "any", "group", "mine", "common")
        return F.struct(*[parts[k].alias(k) for k in order]).cast(_ACC)

    def fresh() -> Column:
        return F.struct(F.array().cast("array<struct<path: string, allow: boolean>>").alias("rules"), F.lit(None).cast("double").alias("delay"))

    def step(acc: Column, line: Column) -> Column:
        closed = _closed(acc)
        outside = packed(state=F.lit(0), own=F.lit(False), any=F.lit(False), group=fresh(), **closed)
        new = acc["state"] == 2  # an agent line after rules opens the next group
        named = F.lit(agent).contains(F.lower(line["value"]))
        joined = packed(
            state=F.lit(1), own=F.when(new, named).otherwise(acc["own"] | named),
            any=F.when(new, line["value"] == "*").otherwise(acc["any"] | (line["value"] == "*")),
            group=F.when(new, fresh()).otherwise(acc["group"]),
            mine=F.when(new, closed["mine"]).otherwise(acc["mine"]), common=F.when(new, closed["common"]).otherwise(acc["common"]),
        )
        rule = F.struct(
            _tidy(line["value"]).alias("path"), ((line["key"] == "allow") | (line["value"] == "")).alias("allow")
        )
        is_rule = line["key"].isin("allow", "disallow")
        delay = F.when((line["key"] == "crawl-delay") & line["value"].rlike(r"^\d+$"), line["value"].try_cast("double"))
        group = F.struct(
            F.when(is_rule, F.concat(acc["group"]["rules"], F.array(rule))).otherwise(acc["group"]["rules"]).alias("rules"),
            F.coalesce(delay, acc["group"]["delay"]).alias("delay"),
        )
        ruled = packed(state=F.lit(2), own=acc["own"], any=acc["any"], group=group, mine=acc["mine"], common=acc["common"])
        counts = is_rule | line["key"].isin("crawl-delay", "request-rate")
        return (
            F.when(line["blank"], outside)
            .when(line["key"] == "user-agent", joined)
            .when(counts & (acc["state"] != 0), ruled)
            .otherwise(acc)
        )

    start = packed(state=F.lit(0), own=F.lit(False), any=F.lit(False), group=fresh(), mine=nothing, common=nothing)
    return start, step


def robots_rules(robots: DataFrame, user_agent: str) -> DataFrame:
    """Per host (scheme and authority): the rules and crawl delay that bind the agent.

    The agent's own group wins over ``*``; anything but a 200 response binds nobody.
    """
    start, step = _step(user_agent.split("/")[0].lower())
    read = robots.where("status = 200").select("host", F.aggregate(_lines(F.col("body")), start, step).alias("acc"))
    last = _closed(F.col("acc"))
    chosen = read.select("host", F.coalesce(last["mine"], last["common"]).alias("r"))
    rules = F.coalesce("r.rules", F.array().cast("array<struct<path: string, allow: boolean>>"))
    return chosen.select("host", rules.alias("rules"), F.col("r.delay").alias("delay"))


def _host_key():
    url = F.col("url")
    return F.concat(url_scheme(url), F.lit("://"), url_host(url))


def with_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed``: the first rule whose path is a prefix decides; no rule allows."""
    rest = _tidy(F.regexp_replace(unquoted(F.col("url")), "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""))
    path = F.when(rest == "", "/").otherwise(rest)
    joined = urls.withColumn("host", _host_key()).withColumn("_path", path).join(
        broadcast_if_small(rules), "host", "left"
    )
    hit = first_where(
        F.col("rules"), lambda r: (r["path"] == "*") | F.col("_path").startswith(r["path"])
    )
    return joined.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop(
        "rules", "delay", "_path", "host"
    )


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    return with_allowed(urls, rules).where("allowed").drop("allowed")


def crawl_delays(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Delay per host of the given URLs; null where none is declared."""
    hosts = urls.select(_host_key().alias("host")).distinct()
    return hosts.join(rules.select("host", "delay"), "host", "left")
