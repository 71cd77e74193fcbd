"""Rendered archives: pages, API responses and logs that Spark derives from plain tables.

They stand in for captured sites in the tests and the query suite. Everything is a DataFrame
expression over the input tables, so the archives grow with them. Listings are cut by ranges
of the part key, never by counting within a brand, so no group can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcatalog.schemas import PROFILE_DDL
from webcatalog.sources.local import local_table

SITE = "https://shop.example.com"
PAGE_RANGE = 625  # part keys per listing page and brand; 25 brands give about 25 products

# Spellings of the availability states that parts cycle through by size.
AVAILABILITY_TEXTS = [
    "https://schema.org/InStock", "OutOfStock", "http://schema.org/PreOrder",
    "Discontinued", "In stock (22)",
]
AVAILABILITY_STATES = ["in_stock", "out_of_stock", "preorder", "discontinued", "unknown"]


def availability_text(size: Column) -> Column:
    texts = F.array(*[F.lit(t) for t in AVAILABILITY_TEXTS])
    return F.get(texts, F.pmod(size, F.lit(5)).cast("int"))


def _brand_slug() -> Column:
    return F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))


def listing_url(slug: Column, page: Column) -> Column:
    base = F.concat(F.lit(f"{SITE}/catalog/"), slug)
    return F.when(page == 1, base).otherwise(F.concat(base, F.lit("?p="), page.cast("string")))


def _with_pages(parts: DataFrame) -> DataFrame:
    """Add the listing page of each part (1-based) and whether a further page exists."""
    last_key = parts.agg(F.max("p_partkey")).scalar()
    return parts.withColumns(
        {
            "page": (F.col("p_partkey") / PAGE_RANGE).cast("int") + 1,
            "last_page": (last_key / PAGE_RANGE).cast("int") + 1,
            "slug": _brand_slug(),
        }
    )


def _grouped(parts: DataFrame, **items: Column) -> DataFrame:
    """Items of each (brand, page) in key order; a group spans at most PAGE_RANGE keys."""
    spark = parts.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = _with_pages(parts).repartition(partitions, "slug", "page")
    ordered = {
        name: F.transform(
            F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item")))),
            lambda x: x["item"],
        ).alias(name)
        for name, item in items.items()
    }
    return spread.groupBy("slug", "page", "last_page").agg(
        F.min("p_brand").alias("brand"), F.count("*").cast("int").alias("n_items"), *ordered.values()
    )


def _key() -> Column:
    return F.col("p_partkey").cast("string")


def product_url(key: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/product/"), key)


def _offer() -> Column:
    return F.named_struct(
        F.lit("@type"), F.lit("Offer"), F.lit("price"), F.col("p_retailprice").cast("string"),
        F.lit("priceCurrency"), F.lit("USD"),
        F.lit("availability"), availability_text(F.col("p_size")),
        F.lit("url"), F.concat(F.lit("/product/"), _key()),
    )


def product_node(description: Column) -> Column:
    return F.named_struct(
        F.lit("@type"), F.lit("Product"),
        F.lit("@id"), F.concat(F.lit("#p"), _key()),
        F.lit("name"), F.concat(F.col("p_name"), F.lit(" "), _key()),
        F.lit("sku"), F.concat(F.lit("P"), _key()),
        F.lit("brand"), F.named_struct(F.lit("@type"), F.lit("Brand"), F.lit("name"), F.col("p_brand")),
        F.lit("category"), F.concat(F.lit("Parts > "), F.col("p_type")),
        F.lit("image"), F.array(F.concat(F.lit("/img/"), _key(), F.lit(".jpg"))),
        F.lit("description"), description,
        F.lit("offers"), _offer(),
    )


def _script(*json_texts: Column) -> Column:
    parts = [
        F.concat(F.lit('<script type="application/ld+json">'), j, F.lit("</script>"))
        for j in json_texts
    ]
    return F.concat(*parts)


def _crumbs(*names: Column) -> Column:
    items = F.array(
        *[
            F.named_struct(
                F.lit("@type"), F.lit("ListItem"), F.lit("position"), F.lit(i + 1), F.lit("name"), n
            )
            for i, n in enumerate(names)
        ]
    )
    return F.to_json(
        F.named_struct(F.lit("@type"), F.lit("BreadcrumbList"), F.lit("itemListElement"), items)
    )


def _shell(title: Column, scripts: Column, body: Column, extra_head: Column | None = None) -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), title, F.lit("</title>"), scripts,
        extra_head if extra_head is not None else F.lit(""),
        F.lit("</head><body><header><form action='/search'></form></header>"
              "<nav><a href='/'>Home</a></nav><main>"),
        body, F.lit("</main><footer>(c)</footer></body></html>"),
    )


def listing_pages(parts: DataFrame) -> DataFrame:
    """JSON-LD listing pages: product list, sub-category list, breadcrumb and next link.

    Every description is cut for parts whose size is a multiple of seven, and the SKU of
    every eleventh part is missing from its node.
    """
    described = F.when(
        F.col("p_size") % 7 != 0, F.concat(F.lit("A "), "p_name", F.lit(" of type "), "p_type")
    )
    element = F.to_json(
        F.named_struct(
            F.lit("@type"), F.lit("ListItem"), F.lit("url"), F.concat(F.lit("/product/"), _key()),
            F.lit("item"), product_node(described),
        )
    )
    pages = _grouped(parts, elements=element, types=F.col("p_type"))
    sub = F.transform(
        F.array_sort(F.array_distinct("types")),
        lambda t: F.concat(
            F.lit('{"@type":"ListItem","item":{"@type":"CollectionPage","name":"'), t,
            F.lit('","url":"/catalog/'), F.col("slug"), F.lit("/"), F.lower(t), F.lit('"}}'),
        ),
    )
    item_list = lambda name, items: F.concat(
        F.lit('{"@type":"ItemList","name":"'), F.lit(name), F.lit('","itemListElement":['),
        F.array_join(items, ","), F.lit("]}"),
    )
    next_link = F.when(
        F.col("page") < F.col("last_page"),
        F.concat(
            F.lit('<a rel="next" href="?p='), (F.col("page") + 1).cast("string"), F.lit('">Next</a>')
        ),
    ).otherwise("")
    body = F.concat(
        F.lit("<h1 class='t'>"), F.col("brand"), F.lit("</h1><p>"),
        F.lpad(F.col("n_items").cast("string"), 2, "0"), F.lit(" products</p>"), next_link,
    )
    scripts = _script(
        _crumbs(F.lit("Home"), F.col("brand")),
        item_list("Products", F.col("elements")), item_list("Types", sub),
    )
    return _numbered(pages, "jsonld").select(
        "page_id", listing_url(F.col("slug"), F.col("page")).alias("url"),
        F.lit(200).alias("status"), F.col("brand").alias("source_category"),
        F.lit("category").alias("kind"), "seq", "page", "n_items",
        _shell(F.col("brand"), scripts, body).alias("html"),
    )


def _numbered(pages: DataFrame, salt: str) -> DataFrame:
    seq = F.col("page").cast("long") * 1000 + F.regexp_extract("slug", r"(\d+)$", 1).cast("long")
    return pages.withColumn("seq", seq).withColumn(
        "page_id", seq * 10 + {"jsonld": 1, "css": 2}[salt]
    )


def css_pages(parts: DataFrame) -> DataFrame:
    """Listing pages without JSON-LD: one ``article.pod`` card per part."""
    card = F.concat(
        F.lit('<article class="pod x"><h3><a href="../product/'), _key(), F.lit('" title="'),
        F.col("p_name"), F.lit(" "), _key(), F.lit('">'), F.substring("p_name", 1, 4),
        F.lit("...</a></h3><p class=price>$"), F.format_number("p_retailprice", 2),
        F.lit("</p><p class='avail y'> "),
        F.when(F.col("p_size") % 2 == 0, "In stock").otherwise("Sold out"),
        F.lit("<br></p><div class='img'><img src='/media/"), _key(), F.lit(".png'></div>"
              "<ul><li>code: SKU"), _key(), F.lit("</li></ul></article>"),
    )
    pages = _grouped(parts, cards=card)
    next_link = F.when(
        F.col("page") < F.col("last_page"),
        F.concat(F.lit("<ul><li class='next'><a href='page-"), (F.col("page") + 1).cast("string"),
                 F.lit(".html'>go on</a></li></ul>")),
    ).otherwise("")
    body = F.concat(
        F.lit("<section class='grid'>"), F.array_join("cards", ""), F.lit("</section>"), next_link
    )
    return _numbered(pages, "css").select(
        "page_id",
        F.concat(F.lit("http://www.cards.example.org/list/"), F.col("slug"), F.lit("/page-"),
                 F.col("page").cast("string"), F.lit(".html")).alias("url"),
        F.lit(200).alias("status"), F.col("brand").alias("source_category"),
        F.lit("category").alias("kind"), "seq", "page", "n_items",
        _shell(F.col("brand"), F.lit(""), body).alias("html"),
    )


def detail_pages(parts: DataFrame) -> DataFrame:
    """One detail page per part with spec rows, a key/value table and related links."""
    described = F.concat(
        F.lit("The "), "p_name", F.lit(" is a part of type "), "p_type", F.lit(" and size "),
        F.col("p_size").cast("string"),
    )
    node = F.to_json(product_node(described))
    related = F.concat(
        *[
            F.concat(
                F.lit("<a class='rel' href='/product/"), (F.col("p_partkey") + i).cast("string"),
                F.lit("'>Part "), (F.col("p_partkey") + i).cast("string"), F.lit("</a>"),
            )
            for i in (1, 2)
        ]
    )
    body = F.concat(
        F.lit("<h1>"), F.col("p_name"), F.lit("</h1><ul class='specs'><li><strong>Size:</strong> "),
        F.col("p_size").cast("string"), F.lit("</li><li><strong>Brand:</strong> "), F.col("p_brand"),
        F.lit("</li><li><strong>Great</strong> value</li></ul><table id='kv'><tr><th>Type:</th><td>"),
        F.col("p_type"), F.lit("</td></tr><tr><th>Weight</th><td>"),
        (F.col("p_size") * 10).cast("string"), F.lit(" g</td></tr></table>"),
        F.lit("<p>Ref. no: <i>R-"), _key(), F.lit("</i></p>"), related,
    )
    return parts.select(
        (F.col("p_partkey") * 10 + 3).alias("page_id"), product_url(_key()).alias("url"),
        F.lit(200).alias("status"), F.col("p_brand").alias("source_category"),
        F.lit("product").alias("kind"), F.col("p_partkey").alias("seq"),
        _shell(F.col("p_name"), _script(_crumbs(F.lit("Home"), F.col("p_type")), node), body).alias("html"),
    )


def api_responses(parts: DataFrame, suppliers: DataFrame, per_page: int = 100) -> DataFrame:
    """Paged hit arrays per category (part type); pages are key ranges, so groups stay small."""
    joined = parts.withColumn("s_suppkey", F.col("p_partkey") % 10).join(
        suppliers.select(F.col("s_suppkey").cast("long"), "s_name"), "s_suppkey", "left"
    )
    hit = F.to_json(
        F.named_struct(
            F.lit("name"), F.concat(F.col("p_name"), F.lit(" "), _key()),
            F.lit("sku"), F.array(
                F.concat(F.lit("P"), _key()), F.concat(F.lit("77-"), _key()),
                F.concat(F.lit("77"), _key()), F.concat(F.lit("88"), _key()),
            ),
            F.lit("manufacturer_part_number"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("M"), _key())),
            F.lit("manufacturer_name"), F.col("s_name"),
            F.lit("price"), F.named_struct(F.lit("USD"), F.named_struct(F.lit("default"), F.col("p_retailprice"))),
            F.lit("image_url"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("https://img.example.com/"), _key())),
            F.lit("thumbnail_url"), F.concat(F.lit("https://img.example.com/t/"), _key()),
            F.lit("categories_without_path"), F.array(F.lit("Parts"), F.col("p_type")),
            F.lit("stock_status_label"), F.when(F.col("p_size") % 4 == 0, "In Stock"),
            F.lit("in_stock"), F.when(F.col("p_size") % 5 == 0, 1).otherwise(0),
            F.lit("visibility_catalog"), F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1),
            F.lit("url"), product_url(_key()),
        )
    )
    # Six types: a range of 6 * per_page keys gives pages of about per_page hits.
    paged = joined.withColumn("api_page", (F.col("p_partkey") / (6 * per_page)).cast("int"))
    pages = paged.groupBy("p_type", "api_page").agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", hit.alias("hit")))).alias("hits")
    )
    n_pages = paged.groupBy("p_type").agg((F.max("api_page") + 1).alias("n_pages"))
    body = F.concat(
        F.lit('{"hits":['), F.array_join(F.transform("hits", lambda h: h["hit"]), ","),
        F.lit('],"nbPages":'), F.col("n_pages").cast("string"),
        F.lit(',"nbHits":'), F.size("hits").cast("string"), F.lit("}"),
    )
    return pages.join(n_pages, "p_type").select(
        F.concat(F.lit(f"{SITE}/catalog/"), F.lower("p_type")).alias("page_url"),
        F.col("p_type").alias("category_id"), F.col("p_type").alias("source_category"),
        "api_page", body.alias("body"),
    )


def dirty_records(parts: DataFrame) -> DataFrame:
    """Raw records with planted faults, picked by the part key."""
    n = F.col("p_partkey")
    pick = lambda m, *texts: F.get(
        F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]), (n % m).cast("int")
    )
    text = lambda c: c.cast("variant")
    blank_name = F.when(n % 13 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.col("p_name"), F.lit("  "))
    )
    price = pick(
        6, F.col("p_retailprice").cast("string"), "1,234.50", "£10.50", ".99", "SKU-12", "n/a"
    )
    sku = F.when(n % 17 == 0, text(n)).otherwise(
        text(F.when(n % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" p-"), _key())))
    )
    fields = F.create_map(
        F.lit("name"), text(F.when(n % 19 != 0, blank_name)),
        F.lit("sku"), sku,
        F.lit("brand"), text(F.when(n % 3 != 0, F.col("p_brand"))),
        F.lit("price"), text(price),
        F.lit("availability"), text(availability_text(F.col("p_size"))),
        F.lit("category"), text(F.when(n % 4 == 0, F.lit(None)).otherwise(
            F.concat(F.lit(" Parts > "), F.col("p_type"), F.lit("/ ")))),
        F.lit("image_urls"), text(F.when(n % 2 == 0, F.concat(F.lit("img/"), _key(), F.lit(".png")))),
        F.lit("product_url"), text(F.when(n % 7 != 0, F.concat(F.lit("../item/"), _key()))),
        F.lit("description"), text(F.when(n % 10 < 3, F.lit(" fine part "))),
    )
    return parts.select(
        n.alias("page_id"), F.lit(0).alias("rec_no"),
        F.concat(F.lit(f"{SITE}/catalog/list/"), (n % 50).cast("string")).alias("page_url"),
        F.col("p_brand").alias("source_category"), F.lit("css").alias("tier"), fields.alias("fields"),
    )


def crawl_log(events: DataFrame) -> DataFrame:
    """One fetch outcome per event; errors failed, the URL set is far smaller than the log."""
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"),
        F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example/p/"),
                 (F.col("event_id") % 500).cast("string")).alias("url"),
        F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"),
        F.when(F.col("event_type") == "view", "category").otherwise("product").alias("kind"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("source_category"),
        "event_type", "value",
    )


def _rule(**parts) -> tuple:
    names = ["source", "path", "selector", "attr", "label", "require_colon", "kv", "fields", "all",
             "pattern", "group"]
    return tuple(parts.get(n) for n in names)


def _jsonld(path: str) -> tuple:
    return _rule(source="jsonld", path=path)


_NODE_RULES = {
    "name": _jsonld("Product.name"), "sku": _jsonld("Product.sku"),
    "brand": _jsonld("Product.brand.name"), "price": _jsonld("Product.offers.price"),
    "currency": _jsonld("Product.offers.priceCurrency"),
    "availability": _jsonld("Product.offers.availability"),
    "image_urls": _jsonld("Product.image"), "description": _jsonld("Product.description"),
    "category": _jsonld("Product.category"), "product_url": _jsonld("Product.offers.url"),
    "rating": _jsonld("Product.aggregateRating.ratingValue"),
}


def profile_rows() -> list[tuple]:
    """Profiles of the rendered sites."""
    css = lambda sel, attr=None, **more: _rule(source="css", selector=sel, attr=attr, **more)
    detail = {
        **{k: v for k, v in _NODE_RULES.items() if k not in ("category", "rating")},
        "specifications": css("li", label="strong", require_colon=True),
        "alternatives": css("a.rel", fields={"name": "@text", "url": "@href"}),
    }
    return [
        ("shop.example.com", "catalog-listing", "many", "/catalog/*", None, {}, _NODE_RULES,
         None, "2024-01-10T00:00:00+00:00", 168, {"name": 1.0}, 1, "hand"),
        ("shop.example.com", "product-detail", "one", "/product/*", None, {}, detail,
         None, "2024-01-01T00:00:00+00:00", 24, {"name": 1.0}, 1, "hand"),
        ("https://www.cards.example.org", "cards", "many", "/list/*", "article.pod",
         {"product_link": "h3 > a[href]", "next_page": "li.next a"},
         {"name": css("h3 a", "@title"), "price": css("p.price"),
          "availability": css("p.avail"), "image_urls": css(".img img", "@src"),
          "product_url": css("h3 a", "@href"),
          "sku": _rule(source="regex", pattern=r"code:\s*(sku\d+)", group=1)},
         None, None, 168, {}, 1, "hand"),
    ]


def profiles(spark: SparkSession) -> DataFrame:
    return local_table(spark, profile_rows(), PROFILE_DDL)


def products(parts: DataFrame, as_of: str = "2024-01-01 00:00:00") -> DataFrame:
    """A stored catalog straight from the parts, with planted gaps."""
    n, size = F.col("p_partkey"), F.col("p_size")
    states = F.array(*[F.lit(s) for s in AVAILABILITY_STATES])
    at = F.lit(as_of).cast("timestamp")
    keep = lambda when, value: F.when(when, value)
    return parts.select(
        F.concat(F.lit("P"), _key()).alias("dedup_key"),
        F.concat("p_name", F.lit(" "), _key()).alias("name"),
        F.concat(F.lit("P"), _key()).alias("sku"),
        F.concat(F.lit("P"), _key()).alias("item_number"),
        keep(n % 11 != 0, F.col("p_brand")).alias("brand"),
        F.array(F.lit("Parts"), F.col("p_type")).alias("category_path"),
        keep(n % 29 != 0, F.col("p_type")).alias("source_category"),
        product_url(_key()).alias("product_url"),
        keep(n % 23 != 0, F.col("p_retailprice")).alias("price"),
        F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("pack_size"),
        F.get(states, F.pmod(size, F.lit(5)).cast("int")).alias("availability"),
        keep(size % 7 != 0, F.concat(F.lit("A "), "p_name")).alias("description"),
        F.when(n % 3 == 0, F.create_map(F.lit("Size"), size.cast("string")))
        .otherwise(F.create_map().cast("map<string, string>")).alias("specifications"),
        F.when(n % 6 != 0, F.array(F.concat(F.lit("/img/"), _key())))
        .otherwise(F.array().cast("array<string>")).alias("image_urls"),
        keep(n % 4 == 0, size / 10.0).alias("rating"),
        F.array().cast("array<struct<sku: string, pack_size: string, price: double, availability: string>>").alias("variants"),
        F.array().cast("array<struct<name: string, url: string, sku: string>>").alias("alternatives"),
        F.lit("jsonld").alias("extraction_tier"), at.alias("scraped_at"), at.alias("updated_at"),
    )
