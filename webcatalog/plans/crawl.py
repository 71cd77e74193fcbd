"""Archive crawl: follow pagination (and sub-categories) over a table of archived pages.

The page archive is parsed once into a narrow link table with one row per URL, written to the
checkpoint folder. Where every page has at most one successor (plain pagination) reachability
is found by doubling: after k rounds all pages within 2^k hops are known, so depth 1000 costs
ten rounds. Branching archives take one join per hop, and a hop writes only what it found.
Both are exact and give the same order: ``hop``, then ``place``, a number that ascends in queue
order within the hop.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcatalog.functions.html import EXTRACTED_TYPES
from webcatalog.operators.discover import with_links
from webcatalog.operators.pages import is_blocked, with_documents
from webcatalog.operators.profiles import match_profiles
from webcatalog.options import Options
from webcatalog.session import checkpoint_folder, reliable_checkpoint


def archive_links(pages: DataFrame, compiled: DataFrame, options: Options = Options()) -> DataFrame:
    """Per archived page: ``blocked``, ``ok`` and the category links to follow, in queue order."""
    flagged = pages.withColumn("blocked", is_blocked(F.col("status"), F.col("html")))
    documents = with_documents(flagged.select("page_id", "url", "blocked", "html"), EXTRACTED_TYPES)
    matched = match_profiles(documents, compiled, F.lit("catalog-listing"))
    ok = ~F.col("blocked") & F.col("template").isNotNull()
    nothing = F.array().cast("array<struct<url: string, name: string, sub: boolean>>")
    link = lambda url, name, sub: F.struct(url.alias("url"), name.alias("name"), F.lit(sub).alias("sub"))
    subs, nexts = nothing, nothing
    if options.follow_subcategories:
        subs = F.transform("subcategories", lambda s: link(s["url"], s["name"], True))
    if options.follow_pagination:
        nexts = F.transform("next_pages", lambda u: link(u, F.lit(None).cast("string"), False))
    links = F.concat(subs, nexts)
    every = with_links(matched, next_pages=options.follow_pagination).select(
        "page_id", "url", "blocked", ok.alias("ok"), F.when(ok, links).otherwise(nothing).alias("links")
    )
    latest = F.max_by(F.struct("page_id", "blocked", "ok", "links"), "page_id")  # of a re-fetched page
    return every.groupBy("url").agg(latest.alias("p")).select("url", "p.*")


def _first_seen(rows: DataFrame) -> DataFrame:
    """One row per URL: the earliest by (hop, place)."""
    picked = rows.groupBy("url").agg(F.min(F.struct("hop", "place", "source_category")).alias("r"))
    return picked.select("url", "r.*")


def _by_doubling(seeds: DataFrame, links: DataFrame, max_hops: int | None) -> DataFrame:
    """Pages keep the place of the seed they come from, which is also their parent's."""
    jump = reliable_checkpoint(
        links.where("size(links) = 1").select(F.col("url").alias("src"), F.col("links")[0]["url"].alias("dst"))
    )
    reached, width, known = reliable_checkpoint(seeds), 1, None
    while True:
        ahead = reached.join(jump, F.col("url") == F.col("src")).select(
            F.col("dst").alias("url"), (F.col("hop") + width).alias("hop"), "place", "source_category"
        )
        reached = reliable_checkpoint(_first_seen(reached.unionByName(ahead)))
        size = reached.count()
        width *= 2
        if size == known or (max_hops is not None and width > max_hops + 1):
            return reached.withColumns({"parent": F.col("place"), "sub": F.lit(False)})
        known = size
        left, right = jump.alias("l"), jump.alias("r")
        jump = reliable_checkpoint(
            left.join(right, F.col("l.dst") == F.col("r.src")).select("l.src", "r.dst")
        )


_LEVEL = "url string, hop int, place long, source_category string, parent long, sub boolean"


def _by_hop(seeds: DataFrame, links: DataFrame, cap: int | None) -> DataFrame:
    """Every hop is a folder of its own; with a cap, one hop past the one that reaches it is kept."""
    spark = seeds.sparkSession
    folder = f"{checkpoint_folder(spark)}/crawl-{uuid.uuid4().hex}"
    start = seeds.withColumns({"parent": F.lit(None).cast("long"), "sub": F.lit(True)})
    start.select(*[c.split()[0] for c in _LEVEL.split(", ")]).write.parquet(f"{folder}/level=0")
    seen = lambda: spark.read.schema(_LEVEL).parquet(folder)
    hop, visited = 0, 0
    while cap is None or visited < cap:
        found = spark.read.schema(_LEVEL).parquet(f"{folder}/level={hop}").drop("parent", "sub").join(links, "url")
        if cap is not None:
            visited += found.where("ok").count()
        ahead = found.select("place", "source_category", F.posexplode("links").alias("pos", "link")).select(
            F.col("link.url").alias("url"), F.col("place").alias("parent"), "pos", F.col("link.sub").alias("sub"),
            F.coalesce(F.nullif(F.col("link.name"), F.lit("")), F.col("source_category")).alias("source_category"),
        )
        first = ahead.groupBy("url").agg(F.min(F.struct("parent", "pos", "source_category", "sub")).alias("r")).select("url", "r.*")
        new = first.join(seen().select("url"), "url", "left_anti")
        queue = new.repartitionByRange("parent", "pos", "url").sortWithinPartitions("parent", "pos", "url")
        placed = queue.select(
            "url", F.lit(hop + 1).alias("hop"), F.monotonically_increasing_id().alias("place"), "source_category", "parent", "sub"
        )
        hop += 1
        placed.write.parquet(f"{folder}/level={hop}")
        if spark.read.schema(_LEVEL).parquet(f"{folder}/level={hop}").isEmpty():
            break
    return seen()


def crawl_archive(
    pages: DataFrame, compiled: DataFrame, seeds: DataFrame, options: Options = Options()
) -> DataFrame:
    """Frontier after a crawl of the archive: one row per queued category URL.

    Columns: url, hop, place (ascending in queue order within its hop), source_category,
    page_id, status (done, failed, pending) and error. Pages that are missing, blocked or
    without a profile fail and do not count toward ``max_pages``. A capped crawl has queued the
    links of the pages before the one that reaches the cap, and that page's sub-categories.
    Of a URL archived more than once the row with the largest page_id counts.
    """
    cap = options.max_pages
    links = reliable_checkpoint(archive_links(pages, compiled, options))
    start = _first_seen(
        seeds.select(
            "url", F.lit(0).alias("hop"), F.col("seq").cast("long").alias("place"), F.col("name").alias("source_category")
        )
    )
    widest = links.agg(F.max(F.size("links"))).first()[0] or 0
    if widest > 1 or options.follow_subcategories:
        queued = _by_hop(start, links, cap)
    else:
        queued = _by_doubling(start, links, cap)
    joined = queued.join(links.drop("links"), "url", "left")
    error = (
        F.when(F.col("ok").isNull(), "not in the archive")
        .when(F.col("blocked"), "blocked")
        .when(~F.col("ok"), "no profile")
    )
    outcome = joined.withColumn("error", error)
    ended = F.when(F.col("error").isNull(), "done").otherwise("failed")
    if cap is None:
        return _shaped(outcome, ended)
    if cap <= 0:
        return _shaped(outcome.where("hop = 0"), F.lit("pending"))
    # The cap is a small number, so its boundary row is found by a top-k, not a full sort.
    at, parent = F.struct("hop", "place"), F.struct((F.col("hop") - 1).alias("hop"), F.col("parent").alias("place"))
    first = outcome.where("error is null").select(at.alias("at")).orderBy("at").limit(cap)
    full = first.agg(F.count("*")).scalar() >= cap
    last = first.agg(F.max("at")).scalar()
    in_time = (F.col("hop") == 0) | (parent < last) | (F.col("sub") & (parent == last))
    beyond = F.coalesce(full & (at > last), F.lit(False))
    kept = outcome.where(~F.coalesce(full, F.lit(False)) | in_time)
    return _shaped(kept, F.when(beyond, "pending").otherwise(ended))


def _shaped(outcome: DataFrame, status: Column) -> DataFrame:
    return outcome.select(
        "url", "hop", "place", "source_category", "page_id", status.alias("status"),
        F.when(status == "failed", F.col("error")).alias("error"),
    )


def visited_pages(crawled: DataFrame, pages: DataFrame) -> DataFrame:
    """The archived pages a crawl visited, labelled with the category they were reached under."""
    order = F.struct("hop", "place")
    done = crawled.where("status = 'done'").select(
        "page_id", order.alias("seq"), F.col("source_category")
    )
    return pages.drop("source_category", "seq").join(done, "page_id")
