"""Run options."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Knobs of a run; the defaults are the documented ones."""

    backend: str = "html"  # html | api
    pinned: bool = False  # an explicit backend beats learned recipes
    follow_product_pages: bool = True
    follow_subcategories: bool = False
    follow_pagination: bool = True
    max_products: int | None = None
    max_pages: int | None = None
    min_coverage: float = 0.55
    revalidation_rate: float = 0.05
    profile_ttl_hours: int = 168
    strict_availability: bool = False
    formats: tuple[str, ...] = ("json", "csv")
    # Search-API discovery: index used unless the page names another one with this prefix.
    default_index: str = "store_default_products_name_asc"
    index_prefix: str = "store_"
    user_agent: str = "webcatalog/0.1"
