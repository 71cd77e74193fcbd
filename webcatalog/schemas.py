"""Table schemas shared by the jobs."""

from __future__ import annotations

from pyspark.sql import types as T


def ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


# One field rule of an extraction profile, as users write it.
RULE_DDL = (
    "struct<source: string, path: string, selector: string, attr: string, label: string,"
    " require_colon: boolean, kv: array<string>, fields: map<string, string>, `all`: boolean,"
    " pattern: string, `group`: int>"
)

PROFILE_DDL = (
    "site string, template string, cardinality string, url_glob string, item_selector string,"
    f" discovery map<string, string>, fields map<string, {RULE_DDL}>, template_signature string,"
    " last_validated string, ttl_hours int, field_confidence map<string, double>, version int,"
    " authored_by string"
)

VARIANT_ITEM_DDL = (
    "struct<sku: string, pack_size: string, price: double, availability: string>"
)
ALTERNATIVE_DDL = "struct<name: string, url: string, sku: string>"

PRODUCT_DDL = (
    "dedup_key string, name string, sku string, item_number string, brand string,"
    " category_path array<string>, source_category string, product_url string, price double,"
    " currency string, pack_size string, availability string, description string,"
    " specifications map<string, string>, image_urls array<string>, rating double,"
    f" variants array<{VARIANT_ITEM_DDL}>, alternatives array<{ALTERNATIVE_DDL}>,"
    " extraction_tier string, scraped_at timestamp, updated_at timestamp"
)

# Fixed column order of the flat (CSV) product row.
FLAT_COLUMNS = [
    "dedup_key", "name", "sku", "item_number", "brand", "category_path",
    "source_category", "product_url", "price", "currency", "pack_size",
    "availability", "description", "specifications", "image_urls", "rating",
    "variants", "alternatives", "extraction_tier", "scraped_at",
]

# Fixed projection used for reports.
REPORT_COLUMNS = [
    "name", "sku", "brand", "category_path", "source_category",
    "price", "currency", "availability", "pack_size", "product_url",
]

# Fixed fields behind the per-record coverage score.
COVERAGE_FIELDS = [
    "name", "sku", "brand", "price", "availability", "description", "image_urls", "category_path",
]

# Fixed fields of the catalog-level coverage report.
CATALOG_COVERAGE_FIELDS = COVERAGE_FIELDS + ["specifications", "rating", "alternatives"]

FRONTIER_DDL = (
    "url string, kind string, status string, source_category string, attempts int,"
    " updated_at timestamp, seq long"
)
DEAD_LETTER_DDL = "url string, error string, attempts int, failed_at timestamp"
HELP_DDL = (
    "url string, reason string, suggested_action string, requested_at timestamp, resolved boolean"
)
RECIPE_DDL = "domain string, backend string, params map<string, string>"

PRODUCT_COLUMNS = FLAT_COLUMNS + ["updated_at"]
