"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Every query runs to a no-op sink, so all its columns are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from query_suite import QUERIES  # noqa: E402
from webcatalog.session import build_session  # noqa: E402

HEADLINE = [
    "build_catalog", "crawl_archive", "clean_text", "template_signatures", "upsert_products", "route_pages",
    "extract_css_listing", "extract_detail", "next_pages", "discover_products", "build_catalog_api",
    "enrich_products", "normalize_records", "field_coverage", "frontier_mark", "price_changes",
    "metrics_by_window", "grounding", "ingest_responses",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the workers and load the classes apart from what is timed.
    QUERIES["clean_text"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    count = lambda t: spark.read.parquet(f"{folder}/{t}.parquet").count()
    pages, products = count("pages"), count("part")
    result = {
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
        "pages_per_sec": {"clean_text": round(pages / seconds["clean_text"], 1)},
        "products_per_sec": {
            q: round(products / seconds[q], 1) for q in ("build_catalog", "extract_detail", "build_catalog_api")
        },
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
