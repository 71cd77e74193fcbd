"""Queries over the given tables, each with the SQL that must give the same rows."""

from query_suite import api, extraction, jobs, links, pages, reports, state, stores, values  # noqa: F401
from query_suite.registry import ORACLES, QUERIES  # noqa: F401
