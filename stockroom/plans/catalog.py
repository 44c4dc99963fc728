"""Product catalogue: public pages, admin lists, detail documents, categories, services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import labels as L
from stockroom.functions import predicates as P
from stockroom.functions.money import backfilled_price_label
from stockroom.functions.text import shorten
from stockroom.operators.filters import search
from stockroom.operators.keyed import KeyedOrder, first_per_key
from stockroom.operators.nesting import child_arrays, with_children

def catalog_order():
    return [F.desc("is_featured"), F.asc("sort_order"), F.desc("created_at"), F.desc("id")]


def with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """Category columns beside the product; products without a category stay."""
    wanted = {"name": "category_name", "slug": "category_slug", "icon": "category_icon",
              "color_from": "color_from", "color_to": "color_to"}
    side = categories.select(F.col("id").alias("category_id"),
                             *[F.col(c).alias(n) for c, n in wanted.items() if c in categories.columns])
    return products.join(side, "category_id", "left")


def with_user_name(df: DataFrame, users: DataFrame, key: str, name: str) -> DataFrame:
    """The full name of the user `key` points to; can be applied for several keys of the same frame."""
    side = users.select(F.col("id").alias(key), F.col("full_name").alias(name))
    return df.join(side, key, "left")


def published_products(products: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(products.where(P.published()), categories)


def catalog(products: DataFrame, categories: DataFrame, tags: DataFrame, term: str | None = None,
            category: str | None = None, featured: bool = False, tag: str | None = None,
            ascii_only: bool = False) -> DataFrame:
    """The public catalogue with its optional filters; the caller pages it by `catalog_order()`."""
    found = search(products.where(P.published()), term, ["name", "short_desc", "material"], ascii_only)
    if featured:
        found = found.where("is_featured")
    if tag:
        tagged = tags.where(F.col("tag") == tag).select(F.col("product_id").alias("id"))
        found = found.join(tagged, "id", "left_semi")
    found = with_category(found, categories)
    return found.where(F.col("category_slug") == category) if category else found


def featured_products(products: DataFrame, categories: DataFrame, limit: int = 6) -> DataFrame:
    chosen = products.where(P.published() & F.col("is_featured"))
    top = chosen.orderBy(F.asc("sort_order"), F.desc("created_at"), F.desc("id")).limit(limit)
    return with_category(top, categories)


def new_products(products: DataFrame, categories: DataFrame, users: DataFrame) -> DataFrame:
    """The website team's queue."""
    queue = products.where(P.in_work_queue())
    return with_user_name(with_category(queue, categories), users, "created_by", "created_by_name")


def product_status_filter(products: DataFrame, status: str | None) -> DataFrame:
    """`low_stock` and `out_of_stock` look at the stock, every other value at the publish status."""
    if not status:
        return products
    stock = F.col("warehouse_stock")
    special = {"low_stock": P.low_stock(stock), "out_of_stock": P.out_of_stock(stock)}
    return products.where(special.get(status, F.col("publish_status") == status))


def is_visible(role: Column) -> Column:
    """Marketing sees published products only."""
    return (role != "marketing") | (F.col("publish_status") == "published")


def visible_products(products: DataFrame, role: str) -> DataFrame:
    return products.where(is_visible(F.lit(role)))


def admin_products(products: DataFrame, categories: DataFrame, users: DataFrame, role: str = "superadmin",
                   term: str | None = None, category: str | None = None, status: str | None = None,
                   ascii_only: bool = False) -> DataFrame:
    found = product_status_filter(visible_products(products, role), status)
    found = with_category(search(found, term, ["name"], ascii_only), categories)
    if category:
        found = found.where(F.col("category_slug") == category)
    return with_user_name(found, users, "created_by", "created_by_name")


def shown_price(role: Column) -> Column:
    """Purchase price for the warehouse, selling price for the website and marketing, the label for anybody else."""
    return (F.when(role.isin("admin_gudang", "superadmin"), F.col("cost_price").cast("string"))
            .when(role.isin("admin_website", "marketing"), F.col("sell_price").cast("string"))
            .otherwise(F.coalesce(F.nullif("price_label", F.lit("")), F.lit("—"))))


def mask_prices(products: DataFrame, role: str) -> DataFrame:
    """One `shown_price` for the role. The price columns themselves are dropped."""
    return products.withColumn("shown_price", shown_price(F.lit(role))).drop("cost_price", "sell_price")


def products_by_role(products: DataFrame) -> DataFrame:
    """What every role sees of every product, from one scan."""
    each = products.withColumn("role", F.explode(F.array(*map(F.lit, V.ROLES))))
    return each.where(is_visible(F.col("role"))).withColumn("shown_price", shown_price(F.col("role"))).drop("cost_price", "sell_price")


def product_badges(products: DataFrame) -> DataFrame:
    stock = F.col("warehouse_stock")
    return products.select("id", "name", "warehouse_stock", L.stock_badge(stock).alias("badge"),
                           L.list_colour(stock).alias("list_colour"), L.summary_colour(stock).alias("summary_colour"),
                           L.status_label(F.col("publish_status")).alias("status_label"))


def primary_images(images: DataFrame) -> DataFrame:
    """One image per product: primary first, then the lowest sort order."""
    return first_per_key(images, ["product_id"], [F.desc("is_primary"), F.asc("sort_order"), F.asc("id")], 1)


def product_documents(products: DataFrame, categories: DataFrame, users: DataFrame, images: DataFrame,
                      tags: DataFrame, **keyed) -> DataFrame:
    """Product detail with its images and tags.

    Images come in parts of bounded size. A product's tags are a set the product itself holds (one row
    per distinct tag), kept in part 1.
    """
    ranked = images.withColumn("_rank", F.when(F.col("is_primary"), 0).otherwise(1))
    pictures = child_arrays(ranked, "product_id", ["_rank", "sort_order", "id"],
                            ["id", "filename", "is_primary", "sort_order"], "images", **keyed)
    labels = child_arrays(tags.distinct(), "product_id", ["tag"], ["tag"], "tags", **keyed)
    parts = pictures.join(labels, ["product_id", "part_no"], "full")
    detail = with_user_name(with_user_name(with_category(products, categories), users, "created_by", "created_by_name"),
                            users, "published_by", "published_by_name")
    joined = detail.join(parts.withColumnRenamed("product_id", "id"), "id", "left")
    return (joined.withColumn("part_no", F.coalesce("part_no", F.lit(1).cast("bigint")))
            .withColumn("images", F.coalesce("images", F.array().cast(pictures.schema["images"].dataType)))
            .withColumn("tags", F.transform(F.coalesce("tags", F.array().cast(labels.schema["tags"].dataType)),
                                            lambda t: t["tag"])))


def category_counts(categories: DataFrame, products: DataFrame, active_only: bool) -> DataFrame:
    """Products per category, empty categories included. `active_only` is the public view of both sides."""
    if active_only:
        categories, products = categories.where("is_active"), products.where("is_active")
    counts = products.groupBy("category_id").agg(F.count("id").alias("product_count"))
    joined = categories.join(counts.withColumnRenamed("category_id", "id"), "id", "left")
    return joined.withColumn("product_count", F.coalesce("product_count", F.lit(0)))


def services(table: DataFrame, active_only: bool = True) -> DataFrame:
    return table.where("is_active") if active_only else table


def service_documents(table: DataFrame, gallery: DataFrame, **keyed) -> DataFrame:
    pictures = child_arrays(gallery, "service_id", ["sort_order", "id"], ["filename", "sort_order"], "gallery", **keyed)
    return with_children(services(table), "id", pictures, "service_id", "gallery")


def related_services(table: DataFrame, count: int = 3) -> DataFrame:
    """For every active service the first `count` others in display order.

    Whatever the service, its related ones are among the first `count` + 1 of all, so only those few rows
    meet every service.
    """
    active = services(table)
    first = active.orderBy("sort_order", "id").limit(count + 1)
    head = first.agg(F.sort_array(F.collect_list(F.struct("sort_order", "id", "slug"))).alias("head")).scalar()
    others = F.slice(F.filter(F.col("_head"), lambda s: s["id"] != F.col("id")), 1, count)
    return (active.select("id", "slug").withColumn("_head", head)
            .select("id", "slug", F.posexplode(others).alias("at", "other"))
            .select("id", "slug", (F.col("at") + 1).cast("bigint").alias("position"),
                    F.col("other.id").alias("related_id"), F.col("other.slug").alias("related_slug")))


def next_image_order(images: DataFrame) -> DataFrame:
    return images.groupBy("product_id").agg(
        (F.coalesce(F.max("sort_order"), F.lit(0)) + 1).cast("bigint").alias("next_sort_order"))


def append_images(images: DataFrame, new_images: DataFrame, **keyed) -> DataFrame:
    """New images of a product follow its highest sort order, in upload order (`id`)."""
    ranked = KeyedOrder(new_images, ["product_id"], ["id"], **keyed).row_number("_position").result()
    start = next_image_order(images)
    # A product without images starts at 1, as one whose highest order is 0 does.
    placed = (ranked.join(start, "product_id", "left")
              .withColumn("sort_order", (F.coalesce("next_sort_order", F.lit(1)) + F.col("_position") - 1).cast("int"))
              .withColumn("is_primary", F.lit(False)))
    return images.unionByName(placed.select(*images.columns))


def set_primary(images: DataFrame, products: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest chosen image per product becomes primary, and its file the product's thumbnail.

    An image of another product clears the primary mark but still lends its file name.
    """
    last = changes.groupBy("product_id").agg(F.max_by("image_id", F.struct("created_at", "id")).alias("_chosen"))
    marked = (images.join(last, "product_id", "left")
              .withColumn("is_primary", F.when(F.col("_chosen").isNull(), F.col("is_primary"))
                          .otherwise(F.col("id") == F.col("_chosen"))).select(*images.columns))
    files = images.select(F.col("id").alias("_chosen"), F.col("filename").alias("_file"))
    chosen = last.join(files, "_chosen").select(F.col("product_id").alias("id"), "_file")
    shown = (products.join(chosen, "id", "left")
             .withColumn("thumbnail", F.coalesce("_file", "thumbnail")).select(*products.columns))
    return marked, shown


def backfill_price_label(products: DataFrame) -> DataFrame:
    return products.withColumn("price_label", backfilled_price_label(F.col("price_label"), F.col("sell_price")))


def top_viewed(products: DataFrame, count: int = 5, label_chars: int = 18) -> DataFrame:
    return (products.where("is_active").orderBy(F.desc("view_count"), F.asc("id")).limit(count)
            .select("id", "name", "slug", "view_count", shorten(F.col("name"), label_chars).alias("label")))
