from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from webcatalog import fixtures  # noqa: E402
from webcatalog.operators.profiles import compile_profiles  # noqa: E402
from webcatalog.session import build_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def part(spark):
    return spark.read.parquet(f"{TESTDATA}/part.parquet")


@pytest.fixture(scope="session")
def compiled(spark):
    return compile_profiles(fixtures.profiles(spark))


@pytest.fixture(scope="session")
def pages_of(spark):
    """Pages table from (url, html) pairs."""

    def build(*pairs, kind="category", category="Cat", status=200):
        rows = [(i, url, status, html, kind, category, i) for i, (url, html) in enumerate(pairs)]
        return spark.createDataFrame(
            rows,
            "page_id long, url string, status int, html string, kind string,"
            " source_category string, seq long",
        )

    return build
