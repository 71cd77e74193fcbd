"""Crawl state and keyed merges; ``events`` serves as the crawl log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from query_suite.registry import Tables, query
from webcatalog.operators import changes as C
from webcatalog.operators import state as S

LOG_SQL = """log AS (
  SELECT event_id AS seq, ts AS seen_at, 'https://h' || user_id || '.example/p/' || (event_id % 500) AS url,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
    CASE WHEN event_type = 'view' THEN 'category' ELSE 'product' END AS kind,
    'user ' || user_id AS source_category, value FROM events)"""
# A third of the log (by hour of the day) has been queued before.
QUEUE_SQL = f"""{LOG_SQL},
old AS (SELECT url, min(seq) AS seq, arg_min(kind, seq) AS kind, arg_min(source_category, seq) AS source_category
  FROM log WHERE hour(seen_at) < 8 GROUP BY url),
new AS (SELECT url, min(seq) AS seq, arg_min(kind, seq) AS kind, arg_min(source_category, seq) AS source_category
  FROM log WHERE hour(seen_at) >= 8 GROUP BY url),
queue AS (SELECT * FROM old UNION ALL SELECT * FROM new WHERE url NOT IN (SELECT url FROM old)),
outcomes AS (SELECT url, count(*) AS tries, arg_max(status, seq) AS status FROM log
  WHERE hour(seen_at) BETWEEN 10 AND 12 GROUP BY url),
marked AS (SELECT queue.url, kind, coalesce(outcomes.status, 'pending') AS status, source_category,
  coalesce(tries, 0) AS attempts, seq FROM queue LEFT JOIN outcomes USING (url))"""


def _frontier(t: Tables) -> DataFrame:
    log = t.log()
    old = S.enqueue(None, log.where("hour(at) < 8"))
    return S.enqueue(old, log.where("hour(at) >= 8"))


def _marked(t: Tables) -> DataFrame:
    outcomes = t.log().where("hour(at) between 10 and 12").select("url", "status", "at", "seq")
    return S.mark(_frontier(t), outcomes)


@query(
    "frontier_enqueue",
    f"WITH {QUEUE_SQL} SELECT url, kind, 'pending' AS status, source_category, 0 AS attempts, seq FROM queue",
)
def frontier_enqueue(t: Tables) -> DataFrame:
    return _frontier(t).drop("updated_at")


@query(
    "frontier_mark",
    f"WITH {QUEUE_SQL} SELECT url, kind, status, source_category, CAST(attempts AS INT) AS attempts, seq FROM marked",
)
def frontier_mark(t: Tables) -> DataFrame:
    return _marked(t).drop("updated_at")


@query(
    "frontier_pending",
    f"WITH {QUEUE_SQL} SELECT url, source_category, seq FROM marked WHERE status = 'pending' AND kind = 'category'",
)
def frontier_pending(t: Tables) -> DataFrame:
    return S.pending(_marked(t), "category").select("url", "source_category", "seq")


@query(
    "cap_products",
    f"WITH {QUEUE_SQL} SELECT url, seq FROM marked WHERE status = 'pending' AND kind = 'product' ORDER BY seq LIMIT 40",
)
def cap_products(t: Tables) -> DataFrame:
    return S.cap_products(_marked(t), 40).select("url", "seq")


@query(
    "dead_letters",
    f"""WITH {QUEUE_SQL},
       fails AS (SELECT url, arg_max('boom ' || seq, seq) AS error, max(seq) AS seq, count(*) AS n FROM log
         WHERE status = 'failed' AND hour(seen_at) >= 12 GROUP BY url),
       before AS (SELECT url, arg_max('boom ' || seq, seq) AS error FROM log
         WHERE status = 'failed' AND hour(seen_at) < 12 GROUP BY url),
       letters AS (SELECT url, error FROM fails UNION ALL SELECT url, error FROM before WHERE url NOT IN (SELECT url FROM fails))
       SELECT letters.url, error, CASE WHEN fails.url IS NOT NULL THEN 'failed' ELSE 'pending' END AS status,
         CAST(coalesce(n, 0) AS INT) AS attempts
       FROM letters LEFT JOIN queue USING (url) LEFT JOIN fails USING (url, error)""",
)
def dead_letters(t: Tables) -> DataFrame:
    failures = t.log().where("status = 'failed'").select(
        "url", F.concat(F.lit("boom "), F.col("seq").cast("string")).alias("error"), F.lit(1).alias("attempts"),
        F.col("at").alias("failed_at"), "seq",
    )
    before = S.dead_letter(None, failures.where("hour(failed_at) < 12"))
    frontier, letters = S.fail(_frontier(t), before, failures.where("hour(failed_at) >= 12"))
    state = frontier.select("url", "status", F.col("attempts").alias("tries"))
    return letters.select("url", "error").join(state, "url", "left").select(
        "url", "error", "status", F.col("tries").alias("attempts")
    )


@query(
    "help_requests",
    f"""WITH {LOG_SQL},
       old AS (SELECT url, arg_max('r' || seq, seq) AS reason, max(seq) % 3 = 0 AS resolved FROM log
         WHERE status = 'failed' AND hour(seen_at) < 12 GROUP BY url),
       new AS (SELECT url, arg_max('r' || seq, seq) AS reason FROM log WHERE status = 'failed' AND hour(seen_at) >= 12 GROUP BY url)
       SELECT url, coalesce(new.reason, old.reason) AS reason, coalesce(old.resolved, false) AS resolved
       FROM old FULL JOIN new USING (url)""",
)
def help_requests(t: Tables) -> DataFrame:
    requests = t.log().where("status = 'failed'").select(
        "url", F.concat(F.lit("r"), F.col("seq").cast("string")).alias("reason"), F.lit("look").alias("suggested_action"),
        F.col("at").alias("requested_at"), "seq",
    )
    number = F.substring("reason", 2, 20).cast("long")
    old = S.request_help(None, requests.where("hour(requested_at) < 12")).withColumn("resolved", number % 3 == 0)
    state = S.request_help(old, requests.where("hour(requested_at) >= 12"))
    return S.help_queue(state, include_resolved=True).select("url", "reason", "resolved")


OBSERVED_SQL = """observed AS (
  SELECT 'P' || l_partkey AS dedup_key, l_shipdate AS seen_at, l_orderkey, l_linenumber, l_extendedprice AS price,
    CASE WHEN l_returnflag = 'R' THEN 'out_of_stock' ELSE 'in_stock' END AS availability,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'n' || l_suppkey END AS brand FROM lineitem)"""


def observed(t: Tables) -> DataFrame:
    return t.read("lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dedup_key"),
        F.col("l_shipdate").alias("at"), "l_orderkey", "l_linenumber", "l_suppkey",
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", "out_of_stock").otherwise("in_stock").alias("availability"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("brand"),
    )


@query(
    "upsert_products",
    f"""WITH {OBSERVED_SQL}, ranked AS (
         SELECT *, row_number() OVER (PARTITION BY dedup_key
           ORDER BY seen_at >= TIMESTAMP '1999-01-01' DESC, seen_at DESC, l_orderkey DESC, l_linenumber DESC, price DESC) AS rn FROM observed)
       SELECT dedup_key, price, availability, brand FROM ranked WHERE rn = 1""",
)
def upsert_products(t: Tables) -> DataFrame:
    # Older observations make the stored table, the later ones come as a batch.
    order = F.struct("at", "l_orderkey", "l_linenumber", "price")
    columns = ["dedup_key", "price", "availability", "brand"]
    rows = observed(t).select(*columns, order.alias("seq"), "at")
    later = F.col("at") >= F.lit("1999-01-01").cast("timestamp_ntz")
    stored = S.upsert_products(None, rows.where(~later).select(*columns, "seq"), "seq").select(*columns)
    return S.upsert_products(stored, rows.where(later).select(*columns, "seq"), "seq").select(*columns)


PRICE_CHANGES_SQL = f"""WITH {OBSERVED_SQL}, lagged AS (
  SELECT *, lag(price) OVER w AS prev_price, lag(availability) OVER w AS prev_availability,
    row_number() OVER w = 1 AS is_first FROM observed
  WINDOW w AS (PARTITION BY dedup_key ORDER BY seen_at, l_orderkey, l_linenumber, price)),
events AS (SELECT *, CASE WHEN is_first THEN 'new'
    WHEN availability = 'out_of_stock' AND prev_availability <> 'out_of_stock' THEN 'out_of_stock'
    WHEN price < prev_price THEN 'price_drop' WHEN price > prev_price THEN 'price_rise' END AS event FROM lagged)
SELECT dedup_key, l_orderkey, l_linenumber, price, prev_price, event FROM events WHERE event IS NOT NULL"""


@query("price_changes", PRICE_CHANGES_SQL)
def price_changes(t: Tables) -> DataFrame:
    bucket = F.date_trunc("year", F.col("at"))
    order = ("at", "l_orderkey", "l_linenumber", "price")
    alerts = C.change_alerts(observed(t), order=order, bucket=bucket)
    return alerts.select("dedup_key", "l_orderkey", "l_linenumber", "price", "prev_price", "event")
