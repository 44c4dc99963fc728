"""The registered queries: each reads the given tables through the adapters and runs a library job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom import fixed_values as V
from stockroom.functions import labels as L
from stockroom.functions import parse
from stockroom.functions import text as X
from stockroom.functions.money import money, outstanding, rupiah
from stockroom.operators import checks, feeds
from stockroom.operators.paging import page_after, page_info, page_of, save_pages, saved_page
from stockroom.plans import (audit, catalog, customers, kpis, ledger, migrate, notify, orders, pricing, reconcile,
                             shoppers, site, slugs, stock, workflow)
from stockroom.schemas import UNIQUE_KEYS
from stockroom.session import work_path, written
from stockroom.sources.saved import change_buckets, read_buckets, save_buckets
from stockroom.sources.search_index import save_search, search_saved
from stockroom.sources.sinks import write_documents
from stockroom.sources.tables import load_tags, read_table, save_table
from stockroom.sources.testdata import AS_OF, EVENTS_AS_OF, MOVE_ORDER, StreamTables, TestTables
from stockroom.streaming import flow, posting, run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(TestTables(spark, sf_dir))
    return build


def _long(*columns: str) -> list:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


# --- stock reports ------------------------------------------------------------------------------
@query
def stock_summary(t):
    return stock.stock_summary(t.products, t.categories, t.stock_transactions)


@query
def inventory_value(t):
    return stock.inventory_value(t.products)


@query
def stock_flow_7d(t):
    return stock.stock_flow(t.stock_transactions, AS_OF)


@query
def low_stock_top10(t):
    return stock.watch_list(t.products, t.categories)


@query
def recent_transactions(t):
    order = [F.desc(c) for c in MOVE_ORDER]
    return stock.recent_transactions(t.stock_transactions, t.products, t.users, order).select(
        "id", "product_id", "type", "qty", "created_at", "product_name", "sku", "created_by_name")


@query
def transactions_filtered(t):
    return stock.transactions_report(
        t.stock_transactions, t.products, t.suppliers, t.users, kind="in", date_from=dt.date(1998, 1, 1),
        date_to=dt.date(1999, 12, 31), term="RING", ascii_only=True).select(
        "id", "product_id", "qty", "qty_before", "qty_after", "reference_no", "product_name", "sku", "unit",
        "supplier_name", "created_by_name", "created_at", "signed_qty", "type_label")


@query
def transaction_report_all(t):
    return stock.transactions_report(t.stock_transactions, t.products, t.suppliers, t.users).groupBy(
        "type", "type_label").agg(F.count(F.lit(1)).alias("row_count"), F.count("supplier_name").alias("supplier_rows"),
                                  F.sum(F.col("qty").cast("bigint")).alias("qty"))


@query
def stock_report_sorted(t):
    report = stock.stock_report(t.products, t.categories)
    return report.orderBy(*stock.report_order("publish_status", "desc"))


@query
def stock_report_top_value(t):
    report = stock.stock_report(t.products, t.categories, term="bolt", ascii_only=True)
    return page_of(report, stock.report_order("stock_value", "DESC"), 2, 25)


# --- catalogue ----------------------------------------------------------------------------------
CATALOG_COLUMNS = ["id", "name", "slug", "short_desc", "price_label", "is_featured", "sort_order", "created_at",
                   "warehouse_stock", "category_name", "category_slug", "category_icon"]


@query
def catalog_page(t):
    return page_of(catalog.catalog(t.products, t.categories, t.product_tags), catalog.catalog_order(), 2, 12).select(
        *CATALOG_COLUMNS)


@query
def catalog_search(t):
    return catalog.catalog(t.products, t.categories, t.product_tags, term="BRAND#1", category="economy",
                           ascii_only=True).select(*CATALOG_COLUMNS)


@query
def catalog_search_any_accent(t):
    return catalog.catalog(t.products, t.categories, t.product_tags, term="Rîng").select("id", "name")


@query
def catalog_by_tag(t):
    return catalog.catalog(t.products, t.categories, t.product_tags, tag="ring", featured=True).select(*CATALOG_COLUMNS)


@query
def catalog_page_info(t):
    return page_info(catalog.catalog(t.products, t.categories, t.product_tags), 2, 12)


@query
def featured_products(t):
    return catalog.featured_products(t.products, t.categories).select("id", "name", "slug", "category_name")


@query
def published_products(t):
    return catalog.published_products(t.products, t.categories).select(*CATALOG_COLUMNS, "color_from", "color_to")


@query
def new_products(t):
    return catalog.new_products(t.products, t.categories, t.users).select(
        "id", "name", "publish_status", "category_name", "created_by_name", "created_at")


@query
def admin_products_low_stock(t):
    return catalog.admin_products(t.products, t.categories, t.users, status="low_stock").select(
        "id", "name", "publish_status", "warehouse_stock", "category_name", "created_by_name")


@query
def admin_products_out_of_stock(t):
    return catalog.admin_products(t.products, t.categories, t.users, status="out_of_stock", category="promo").select(
        "id", "name", "publish_status", "category_slug")


@query
def product_visibility_by_role(t):
    return catalog.products_by_role(t.products).select("role", "id", "shown_price")


@query
def product_editors(t):
    named = catalog.with_user_name(catalog.with_user_name(t.products, t.users, "created_by", "created_by_name"),
                                   t.users, "published_by", "published_by_name")
    return named.select("id", "created_by_name", "published_by_name")


@query
def product_badges(t):
    return catalog.product_badges(t.products)


@query
def category_counts_active(t):
    return catalog.category_counts(t.categories, t.products, True).select("id", "name", "product_count")


@query
def category_counts_all(t):
    return catalog.category_counts(t.categories, t.products, False).select("id", "name", "product_count")


@query
def top_viewed(t):
    return catalog.top_viewed(t.products)


@query
def primary_images(t):
    return catalog.primary_images(t.product_images).select("product_id", "id", "filename", "is_primary")


@query
def next_image_order(t):
    return catalog.next_image_order(t.product_images)


@query
def append_images(t):
    added = t.product_images.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000)
    return catalog.append_images(t.product_images, added).select("id", "product_id", "is_primary", *_long("sort_order"))


@query
def primary_switch(t):
    changes = t.product_images.select((F.col("id") + 5).alias("id"), "product_id", F.col("id").alias("image_id"),
                                      F.timestamp_seconds("sort_order").alias("created_at")).where("image_id % 4 = 1")
    images, _ = catalog.set_primary(t.product_images, t.products, changes)
    return images.select("id", "product_id", "is_primary")


@query
def primary_switch_thumbnails(t):
    changes = t.product_images.select((F.col("id") + 5).alias("id"), "product_id", F.col("id").alias("image_id"),
                                      F.timestamp_seconds("sort_order").alias("created_at")).where("image_id % 4 = 1")
    return catalog.set_primary(t.product_images, t.products, changes)[1].select("id", "thumbnail")


@query
def product_documents(t):
    return catalog.product_documents(t.products, t.categories, t.users, t.product_images, t.product_tags).select(
        "id", "part_no", "category_name", "created_by_name", "published_by_name",
        F.array_join(F.transform("images", lambda i: i["filename"]), ",").alias("image_files"),
        F.array_join("tags", ",").alias("tag_list"))


@query
def price_label_backfill(t):
    return catalog.backfill_price_label(t.products).select("id", "price_label")


@query
def tag_load(t):
    typed = t.products.select(F.concat("slug").alias("slug"), F.explode(X.split_tags(
        F.concat_ws(",", "material", "name", F.lit(" "), "material"))).alias("tag"))
    return load_tags(t.products, typed)


def _edited_tags(t):
    edited = t.products.where("id % 10 = 3").select(F.col("id").alias("product_id"),
                                                    X.split_tags(F.concat("material", F.lit(", sale,,sale"))).alias("tags"))
    return edited, edited.select("product_id", F.explode("tags").alias("tag"))


@query
def tag_replacement(t):
    edited, fresh = _edited_tags(t)
    return feeds.replace_children(t.product_tags, edited, "product_id", fresh)


@query
def slug_assign(t):
    new = t.products.where("id % 3 <> 0").select((F.col("id") + 1_000_000).alias("id"), "name")
    existing = t.products.where("id % 3 = 0").select(F.concat("name", F.lit(" "), F.col("warehouse_stock").cast("string")).alias("n"))
    return slugs.assign_slugs(new, existing.select(X.slugify(F.col("n")).alias("slug"))).select("id", "slug")


@query
def publish_changes(t):
    changes = _publish_feed(t)
    return workflow.apply_publish(t.products, changes)[0].select("id", "publish_status", "is_active", "published_by")


@query
def publish_rejects(t):
    return workflow.apply_publish(t.products, _publish_feed(t))[1].select("id", "product_id", "reason")


def _publish_feed(t):
    eid = F.col("id")
    statuses = ["published", "hidden", "review", "sold", "archived"]
    return t.activity_logs.select(
        eid, (eid * 3 % 2500).alias("product_id"),
        F.element_at(F.array(*map(F.lit, statuses)), (eid % 5 + 1).cast("int")).alias("status"),
        F.col("user_id").alias("changed_by"), "created_at")


# --- orders -------------------------------------------------------------------------------------
@query
def order_list_filtered(t):
    return orders.order_list(t.orders, t.order_items, t.users, status="confirmed", payment_status="partial", term="ord-1998",
                             date_from=dt.date(1998, 2, 1), date_to=dt.date(1998, 11, 30), ascii_only=True).select(
        "id", "order_number", "status", "total", "created_at", "created_by_name", "item_count")


@query
def order_page(t):
    return orders.order_page(t.orders, t.order_items, t.users, page=3, limit=500).select(
        "id", "order_number", "status", "created_at", "created_by_name", "item_count")


@query
def order_page_after(t):
    last = [dt.datetime(1999, 1, 10), 5000]
    return page_after(t.orders, [("created_at", False), ("id", False)], last, 50).select("id", "created_at", "total")


@query
def order_summary(t):
    return orders.order_summary(t.orders, t.order_items, t.customers, t.users).select(
        "id", "order_number", "status", "total", "customer_name_ref", "created_by_name", "item_count")


@query
def order_stats(t):
    return orders.order_stats(t.orders, AS_OF)


@query
def orders_30d(t):
    return orders.orders_daily(t.orders, AS_OF)


@query
def customer_order_history(t):
    return orders.customer_orders(t.orders, 7).select("id", "order_number", "status", "total", "created_at")


@query
def order_documents(t):
    return orders.order_documents(t.orders, t.order_items, t.products, t.users).select(
        "id", "part_no", "created_by_name", "confirmed_by_name", F.size("items").cast("bigint").alias("item_count"),
        F.array_join(F.transform("items", lambda i: F.concat_ws(
            "/", i["row_no"].cast("string"), i["product_name"], i["qty"].cast("string"), F.coalesce(i["slug"], F.lit("-")))),
            ";").alias("lines"))


@query
def invoice_headers(t):
    return orders.invoice_headers(t.orders, t.customers, t.users).select(
        "id", "order_number", "customer_addr", "customer_phone", "customer_email", "created_by_name", "outstanding",
        rupiah(F.col("total")).alias("total_label"), L.date_label(F.col("created_at")).alias("date_label"),
        L.status_label(F.col("payment_status")).alias("payment_label"))


@query
def invoice_lines(t):
    return orders.invoice_lines(t.orders, t.order_items).select(
        "order_id", "order_number", "line_no", "product_name", "qty", "unit_price", "subtotal")


@query
def invoice_documents(t):
    return orders.invoice_documents(t.orders, t.order_items, t.customers, t.users, t.settings)


@query
def line_resolution(t):
    typed = t.order_items.select(
        "id", "order_id", "qty", "unit_price", "supplier_key",
        F.when(F.col("id") % 5 == 0, F.lit("special work")).otherwise(
            F.concat(F.lit("[SKU-"), (F.col("supplier_key") * 7 % 300).cast("string"), F.lit("] small ring"))).alias("label"))
    return orders.resolve_lines(typed, t.products).select(
        "id", "order_id", "label", "product_id", "product_sku", *_long("qty"), "unit_price", "was_capped")


@query
def order_numbers(t):
    return pricing.assign_order_numbers(t.orders.drop("order_number")).select("id", "order_number")


@query
def order_numbers_continued(t):
    new = t.orders.where("id % 3 = 0").drop("order_number")
    return pricing.assign_order_numbers(new, t.orders.where("id % 3 <> 0")).select("id", "order_number")


def _intake(t):
    oid = F.col("id")
    headers = t.orders.select(
        oid.alias("order_ref"), F.when(oid % 17 == 0, "  ").otherwise(F.concat(F.lit(" "), "customer_name")).alias("customer_name"),
        F.when(oid % 9 == 0, "none").otherwise(((oid % 7 - 1) * 1000).cast("string")).alias("discount"),
        F.concat((oid % 5 * 50).cast("string"), F.lit(".5 flat")).alias("shipping_cost"))
    item = F.col("id")
    items = t.order_items.select(
        # Line numbers repeat in this data; the supplier tells them apart as far as faults go.
        F.col("order_id").alias("order_ref"), F.struct(item.alias("id"), "supplier_key").alias("line_no"),
        F.when(F.col("supplier_key") % 97 == 5, "").otherwise(F.col("product_name")).alias("product_name"),
        F.when(item % 101 == 0, "many").when(item % 103 == 0, "-2").when(item % 107 == 0, "0")
        .otherwise(F.concat(F.col("qty").cast("string"), F.lit(" pcs"))).alias("qty"),
        F.when(item % 109 == 0, "-5").when(item % 113 == 0, "0.00").otherwise(F.col("unit_price").cast("string")).alias("unit_price"))
    return headers, items


@query
def order_pricing(t):
    return pricing.price_orders(*_intake(t))[0].select(
        "order_ref", "customer_name", "subtotal", "discount", "shipping_cost", "total")


@query
def order_price_lines(t):
    lines = pricing.price_orders(*_intake(t))[1]
    return lines.groupBy("order_ref").agg(F.count(F.lit(1)).alias("line_count"), F.sum("qty").alias("qty"),
                                          F.sum("subtotal").cast("decimal(25,2)").alias("subtotal"))


@query
def order_price_rejects(t):
    rejects = pricing.price_orders(*_intake(t))[2]
    return rejects.select("order_ref", "reason")


def _edits(t):
    oid = F.col("id")
    edits = t.orders.where("id % 4 < 2").select(
        (oid * 10).alias("id"), oid.alias("order_id"), "created_at",
        F.when(oid % 3 == 0, oid % 50).alias("customer_id"), F.when(oid % 6 == 1, "").otherwise("New name").alias("customer_name"),
        (oid % 4 * 10 - 10).cast("string").alias("discount"), F.lit("15").alias("shipping_cost"),
        F.when(oid % 3 == 0, "0800").otherwise("").alias("customer_phone"),
        F.when(oid % 5 == 0, "2000-01-02").alias("delivery_date"))
    edit_items = t.order_items.where("order_id % 8 < 3").select(
        (F.col("order_id") * 10).alias("edit_id"), F.col("id").alias("line_no"), "product_id", "product_name", "product_sku",
        F.when(F.col("id") % 11 == 0, "-4").otherwise(F.col("qty").cast("string")).alias("qty"),
        F.col("unit_price").cast("string").alias("unit_price"), F.when(F.col("id") % 4 == 0, "set").otherwise("").alias("unit"),
        F.when(F.col("id") % 6 == 0, "gift").alias("notes"))
    return edits, edit_items


@query
def order_reprice(t):
    edits, edit_items = _edits(t)
    return pricing.reprice(t.orders, t.order_items, edits, edit_items)[0].select(
        "id", "customer_id", "customer_name", "customer_phone", "customer_email", "delivery_date", "subtotal", "discount",
        "shipping_cost", "total")


@query
def order_reprice_items(t):
    edits, edit_items = _edits(t)
    items = t.order_items.withColumn("notes", F.lit("old"))
    return pricing.reprice(t.orders, items, edits, edit_items)[1].select(
        "order_id", "product_id", "product_name", "product_sku", *_long("qty"), "unit", "unit_price", "subtotal", "notes")


@query
def order_reprice_rejects(t):
    edits, edit_items = _edits(t)
    return pricing.reprice(t.orders, t.order_items, edits, edit_items)[2].select("id", "order_id", "reason")


# --- workflow and ledger ------------------------------------------------------------------------
def _fresh_orders(t):
    """Orders as they are before their change feed."""
    return t.orders.withColumn("status", F.lit("pending")).withColumn("payment_status", F.lit("unpaid"))


@query
def status_transitions(t):
    return workflow.transitions(t.order_changes, _fresh_orders(t)).select(
        "id", "order_id", "old_status", "new_status", "old_payment", "new_payment")


@query
def status_movements(t):
    return workflow.status_movements(t.order_changes, _fresh_orders(t), t.order_items.drop("id")).select(
        "change_id", "order_id", "type", "reference_type", "product_id", "qty", "created_at")


@query
def paid_spend(t):
    fresh = _fresh_orders(t)
    return workflow.paid_spend(workflow.transitions(t.order_changes, fresh), fresh)


@query
def orders_after_changes(t):
    fresh = _fresh_orders(t).withColumn("notes", F.lit(None).cast("string"))
    cid = F.col("id")
    changes = t.order_changes.withColumns({
        "amount_paid": F.when(cid % 3 == 0, F.concat(((cid % 7 - 2) * 1000).cast("string"), F.lit(" rp"))),
        "notes": F.when(cid % 5 == 0, F.concat(F.lit("note "), cid.cast("string"))).otherwise("")})
    return workflow.apply_changes(fresh, workflow.transitions(changes, fresh)).select(
        "id", "status", "payment_status", "confirmed_by", "amount_paid", "notes")


def _opening(t, factor: int):
    return t.products.select(F.col("id").alias("product_id"), (F.col("warehouse_stock") * factor).cast("bigint").alias("opening_qty"))


@query
def ledger_running(t):
    """Balances with everything accepted."""
    rows, _ = ledger.valid_movements(_opening(t, 1), t.movements)
    return ledger.all_accepted(rows, MOVE_ORDER).select(
        "product_id", "created_at", "id", "type", *_long("qty"), "qty_before", "qty_after")


def _bare_movements(t):
    """Movements without the columns that no figure of the ledger is asked for: the replay carries all that it is given."""
    return t.movements.select("product_id", *MOVE_ORDER)


@query
def ledger_posted(t):
    """Balances with short issues refused."""
    posted, _ = ledger.post_ledger(_opening(t, 1), _bare_movements(t), MOVE_ORDER)
    return posted.select("product_id", "created_at", "id", "type", "qty", "qty_before", "qty_after")


@query
def ledger_rejects(t):
    _, rejects = ledger.post_ledger(_opening(t, 1), _bare_movements(t), MOVE_ORDER)
    return rejects.select("product_id", "created_at", "id", *_long("qty"), "reason")


@query
def ledger_closing(t):
    opening = _opening(t, 1)
    return ledger.closing_stock(opening, ledger.post_ledger(opening, _bare_movements(t), MOVE_ORDER)[0], MOVE_ORDER)


@query
def publish_after_stock(t):
    posted, _ = ledger.post_ledger(_opening(t, 1), _bare_movements(t), MOVE_ORDER)
    return ledger.publish_after_stock(t.products, posted, MOVE_ORDER).select("id", "publish_status")


@query
def settled_changes(t):
    """All-or-nothing order changes against scarce stock: outcome and stock moved per change."""
    accepted, moved, _ = workflow.settle_order_changes(t.order_changes, _fresh_orders(t), t.order_items, _opening(t, 20))
    sums = moved.groupBy(F.col("change_id").alias("id")).agg(
        F.count(F.lit(1)).alias("moved_products"), F.sum("qty").alias("moved_qty"), F.min("qty_after").alias("lowest_after"))
    return t.order_changes.select("id", "order_id").join(
        accepted.select("id", "old_status", "new_status", "new_payment"), "id", "left").join(sums, "id", "left")


# --- customers ----------------------------------------------------------------------------------
@query
def customer_rollup(t):
    return customers.customer_rollup(t.customers, t.orders).select("id", "name", "total_orders_count", "total_spend_actual")


@query
def customer_search(t):
    return customers.customer_rollup(t.customers, t.orders, "C1", True).select("id", "name", "total_orders_count")


@query
def customer_last10(t):
    return customers.last_orders(t.orders)


@query
def customer_documents(t):
    return customers.customer_documents(t.customers, t.orders).select(
        "id", "name", F.array_join(F.transform("orders", lambda o: o["order_number"]), ",").alias("order_numbers"))


@query
def supplier_search(t):
    return customers.supplier_list(t.suppliers, "7", True).select("id", "code", "name")


@query
def deletable_customers(t):
    return checks.deletable_customers(t.customers, t.orders)[0].select("id", "name")


@query
def blocked_customers(t):
    return checks.deletable_customers(t.customers, t.orders)[1].select("id", "order_count", "reason")


@query
def deletable_orders(t):
    return checks.deletable_orders(t.orders)[0].select("id", "payment_status")


# --- dashboards ---------------------------------------------------------------------------------
@query
def admin_kpis(t):
    return kpis.admin_kpis(t, AS_OF)


@query
def warehouse_kpis(t):
    return kpis.warehouse_kpis(t, AS_OF)


@query
def executive_kpis(t):
    return kpis.executive_kpis(t, AS_OF, EVENTS_AS_OF)


@query
def marketing_figures(t):
    return kpis.role_kpis(t, AS_OF, "marketing")


@query
def marketing_newest_orders(t):
    return kpis.marketing_dashboard(t, AS_OF)["newest_orders"].select("id", "order_number", "total", "created_at")


# --- users, sessions, audit ---------------------------------------------------------------------
@query
def users_by_role(t):
    return audit.users_by_role(t.users)


@query
def user_list(t):
    return audit.safe_users(t.users, "USER1", "admin_gudang", True)


@query
def activity_log_filtered(t):
    found = audit.activity(t.activity_logs, module="Products", action="CREATE", user_id=5)
    return page_of(found, [F.desc("created_at"), F.desc("id")], 1, 200, V.MAX_LOG_PAGE).select(
        "id", "user_id", "module", "action", "created_at")


@query
def recent_logs(t):
    return audit.recent_logs(t.activity_logs).select("id", "username", "action", "created_at")


@query
def open_sessions(t):
    return audit.open_sessions(t.sessions, t.users).select("id", "ip_address", "expires_at", "created_at", "username", "role")


@query
def active_sessions(t):
    return audit.live_sessions(t.sessions, EVENTS_AS_OF).select("id", "user_id", "expires_at")


@query
def role_violations(t):
    return audit.audit_role_violations(t.activity_logs, audit.permission_matrix(t.spark)).select("id", "role", "module", "action")


@query
def rate_audit_15m(t):
    requests = t.activity_logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return audit.rate_audit(requests, "ip_address", 2).select(
        "ip_address", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "request_count")


@query
def audit_rows(t):
    eid = F.col("id")
    changes = t.activity_logs.select(
        F.when(eid % 10 != 0, F.col("user_id")).alias("user_id"), "username", "role", "action", "module", "description",
        "record_id", "record_type", F.when(eid % 2 == 0, F.col("ip_address")).alias("forwarded_for"),
        F.lit("127.0.0.1").alias("remote_address"), F.when(eid % 7 == 0, 500).otherwise(200).alias("status_code"),
        F.when(eid % 3 == 0, False).alias("success"), "created_at")
    return audit.audit_rows(changes).select("user_id", "action", "record_id", "ip_address")


@query
def user_switches(t):
    return audit.apply_user_events(t.users, t.sessions, t.user_events)[0].select("id", "is_active")


@query
def sessions_after_events(t):
    return audit.apply_user_events(t.users, t.sessions, t.user_events)[1].select("id", "user_id", "is_active")


@query
def user_validation(t):
    uid = F.col("id")
    feed = t.customers.select(
        uid, F.when(uid % 11 == 0, " ").otherwise(F.col("code")).alias("username"),
        F.when(uid % 13 == 0, "root").otherwise("marketing").alias("role"),
        F.repeat(F.lit("x"), (uid % 30).cast("int")).alias("password"), "email")
    bad = checks.validate(feed, checks.new_user_rules())[1]
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


def _user_patches(t):
    return t.user_events.select(
        F.col("user_id").alias("id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id").cast("string"))).alias("phone"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("name "), F.col("id").cast("string"))).alias("full_name"),
        "created_at", F.col("id").alias("seq"))


@query
def user_patches(t):
    return feeds.apply_patch(t.users, _user_patches(t), "id", ["created_at", "seq"], ["phone", "full_name"])[0].select(
        "id", "phone", "full_name", "email")


# --- notifications ------------------------------------------------------------------------------
@query
def notification_feed(t):
    return notify.notifications_for(t.notifications, "marketing", 4).orderBy(F.desc("created_at"), F.desc("id")).limit(20).select(
        "id", "target_role", "target_user", "title", "created_at")


@query
def notification_inboxes(t):
    return notify.inboxes(t.notifications, t.users)


@query
def unread_counts(t):
    return notify.unread_counts(t.notifications, t.users)


@query
def notification_reads(t):
    single = t.notifications.where("id % 5 = 0").select(F.col("id").alias("notification_id"), F.lit(None).cast("string").alias("role"),
                                                      F.lit(None).cast("bigint").alias("user_id"), "created_at")
    every = t.user_events.where("action = 'logout'").join(t.users.select(F.col("id").alias("user_id"), "role"), "user_id").where(
        "role = 'admin_gudang' or user_id = 4").select(F.lit(None).cast("bigint").alias("notification_id"), "role", "user_id", "created_at")
    return notify.apply_reads(t.notifications, single.unionByName(every)).select("id", "is_read")


def _some_by_hand(transactions):
    """The transactions, every fifth of which belongs to no order."""
    return transactions.withColumn("order_id", F.when(F.col("id") % 5 != 0, F.col("order_id")))


@query
def notification_fanout(t):
    fresh = _fresh_orders(t)
    paid = workflow.into_paid(workflow.transitions(t.order_changes, fresh))
    rows = (notify.order_created(t.orders).unionByName(notify.order_paid(paid, fresh))
            .unionByName(notify.stock_alert(_some_by_hand(t.stock_transactions), t.products))
            .unionByName(notify.contact_received(t.contacts)).unionByName(notify.product_created(t.products)))
    return rows.select("target_role", "type", "title", "message", "link", "source", "source_id", "created_at")


# --- site ---------------------------------------------------------------------------------------
@query
def settings_public(t):
    return site.public_settings(t.settings).select("key", "value")


@query
def settings_public_group(t):
    return site.public_settings(t.settings, "hero").select("key", "value", "type")


@query
def settings_groups(t):
    return site.settings_groups(t.settings)


@query
def settings_latest(t):
    return site.latest_settings(t.setting_feed)


@query
def settings_bulk_upsert(t):
    return site.upsert_settings(t.settings, t.setting_feed.withColumn("value", F.concat(F.lit("new "), "value")), False)[0].select("key", "value")


@query
def settings_typed(t):
    sid = F.col("id")
    mixed = t.settings.withColumns({
        "value": F.when(sid % 3 == 0, F.concat(sid.cast("string"), F.lit(".5")))
        .when(sid % 3 == 1, F.when(sid % 2 == 0, "true").otherwise("0")).otherwise(F.col("value")),
        "type": F.when(sid % 3 == 0, "number").when(sid % 3 == 1, "boolean").otherwise("text")})
    return site.typed_settings(mixed)


@query
def settings_single_upsert(t):
    own = t.setting_feed.withColumn("key", F.concat(F.lit("own_"), "key"))
    return site.upsert_settings(t.settings, t.setting_feed.unionByName(own), True)[0].select("key", "value", "type", "group_name")


@query
def contacts_unread(t):
    found = site.contacts(t.contacts, False)
    return page_of(found, [F.desc("created_at"), F.desc("id")], 1, 20).select("id", "name", "subject", "created_at")


@query
def recent_contacts(t):
    return site.recent_contacts(t.contacts)


@query
def testimonials_shown(t):
    return site.testimonials(t.testimonials).select("id", "name", "rating", "initial", "stars", "content", "sort_order")


@query
def service_list(t):
    return catalog.services(t.services).select("id", "name", "slug", "sort_order")


@query
def service_documents(t):
    return catalog.service_documents(t.services, t.service_gallery).select(
        "id", "part_no", F.array_join(F.transform("gallery", lambda g: g["filename"]), ",").alias("files"))


@query
def service_info(t):
    return site.service_info(t.services)


@query
def related_services(t):
    return catalog.related_services(t.services)


# --- shoppers -----------------------------------------------------------------------------------
@query
def view_counts(t):
    return shoppers.view_counts(t.product_views, t.products)


@query
def recently_viewed(t):
    return shoppers.recently_viewed(t.product_views).select("user_id", "product_id", "viewed_at", *_long("position"))


@query
def favourites(t):
    return shoppers.favourites(t.favourite_toggles)


# --- integrity ----------------------------------------------------------------------------------
@query
def duplicate_names(t):
    return checks.duplicate_keys(t.products, ["name"])


@query
def cascade_delete(t):
    gone = t.products.where("id % 9 = 0")
    tables = feeds.delete_cascade({"products": t.products, "product_images": t.product_images, "product_tags": t.product_tags,
                                   "order_items": t.order_items, "stock_transactions": t.stock_transactions}, "products", gone)
    counts = None
    for name in ("products", "product_images", "product_tags", "order_items", "stock_transactions"):
        held = "product_id" if name != "products" else "id"
        one = tables[name].agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"), F.count(held).alias("linked_count"))
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query
def nullify_refs(t):
    gone = t.categories.where("sort_order > 6")
    return feeds.nullify(t.products, "category_id", gone).select("id", "category_id")


@query
def migrate_v1(t):
    return migrate.migrate_products(t.products.drop("publish_status"), EVENTS_AS_OF).select("id", "publish_status", "published_at")


@query
def migrate_v1_users(t):
    uid = F.col("id")
    old = t.users.withColumn("role", F.when(uid % 2 == 0, "admin").otherwise(F.col("role"))).withColumn(
        "username", F.when(uid == 3, "admin").otherwise(F.col("username")))
    return migrate.migrate_users(old).select("id", "username", "role")


@query
def order_reconciliation(t):
    return reconcile.order_differences(t.orders, t.order_items)


@query
def stock_reconciliation(t):
    return reconcile.stock_differences(t.products, t.stock_transactions, MOVE_ORDER)


@query
def ledger_reconciliation(t):
    return reconcile.broken_links(t.stock_transactions, MOVE_ORDER).select(
        "product_id", "created_at", "id", "qty_before", "previous_after")


@query
def price_reconciliation(t):
    return reconcile.price_differences(t.stock_transactions).select("id", "product_id", "total_price", "computed_total")


@query
def deleted_order_stock(t):
    return reconcile.restored_after_delete(t.orders.where("id % 10 <> 0"), t.stock_transactions)


# --- column functions ---------------------------------------------------------------------------
@query
def order_labels(t):
    created = F.col("created_at")
    return t.orders.select(
        "id", L.status_label(F.col("status")).alias("status_label"), rupiah(F.col("total")).alias("total_label"),
        L.date_label(created).alias("date_label"), L.day_label(created).alias("day_label"),
        L.date_time_label(created).alias("time_label"), L.number_of(F.col("order_number")).alias("number"),
        X.shorten(F.col("customer_email"), 15).alias("short_email"), outstanding(F.col("total"), F.col("amount_paid")).alias("outstanding"))


@query
def lenient_parsing(t):
    raw = F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_name"))
    number = F.concat(F.col("p_retailprice").cast("string"), F.lit("/pc"))
    return t.raw("part").select(
        F.col("p_partkey").alias("id"), parse.int_prefix(raw).alias("size"), parse.int_or_zero(F.col("p_name")).alias("zero"),
        parse.money_prefix(number).alias("price"), money(parse.money_or_zero(F.col("p_brand"))).alias("no_price"),
        parse.flag(F.col("p_size") % 2).alias("odd"), X.slugify(F.concat("p_brand", F.lit(" -  "), "p_name")).alias("slug"),
        X.normalise_login(F.concat(F.lit(" "), "p_brand")).alias("login"))


# --- streams ------------------------------------------------------------------------------------
# Each runs its stream over the files until all input is used, and returns what was written.
def _places(t, name: str) -> tuple[str, str]:
    path = work_path(t.spark, name)
    return f"{path}/out", f"{path}/checkpoint"


def _streams(t) -> StreamTables:
    return StreamTables(t.spark, t.sf_dir)


def _updated(t, stream, name: str, keys: list[str]) -> DataFrame:
    path, checkpoint = _places(t, name)
    run.update_to(stream, path, checkpoint).awaitTermination()
    return run.newest_rows(t.spark, path, keys)


def _appended(t, stream, name: str) -> DataFrame:
    path, checkpoint = _places(t, name)
    run.append_to(stream, path, checkpoint).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


@query
def stream_orders_daily(t):
    return _updated(t, flow.daily_orders(_streams(t).orders), "orders-daily", ["day"])


@query
def stream_stock_flow(t):
    return _updated(t, flow.daily_flow(_streams(t).stock_transactions), "stock-flow", ["day"])


@query
def stream_rate_audit(t):
    rates = _updated(t, flow.request_rates(_streams(t).activity_logs, limit=2), "rate-audit", ["ip_address", "window_start"])
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_view_counts(t):
    return _updated(t, flow.view_counters(_streams(t).product_views, t.products), "view-counts", ["product_id"])


@query
def stream_audit_ingest(t):
    return _appended(t, flow.audit_ingest(_streams(t).activity_logs), "audit").select("id", "role", "action", "created_at")


@query
def stream_order_notes(t):
    return _appended(t, notify.order_created(_streams(t).orders), "order-notes").select("target_role", "message", "source_id")


@query
def stream_stock_alerts(t):
    return _appended(t, notify.stock_alert(_some_by_hand(_streams(t).stock_transactions), t.products), "stock-alerts").select(
        "target_role", "message", "source_id", "created_at")


@query
def stream_expired_sessions(t):
    return _appended(t, flow.expired_sessions(_streams(t).sessions), "expired-sessions")


def _in_parts(t, rows: DataFrame, by: list[str], name: str, count: int = 3):
    """`rows` as a stream and, its parts in order of `by`: each step of the iterator lets one more arrive."""
    path = work_path(t.spark, name)
    parts = written(rows.repartitionByRange(count, *by).withColumn("_part", F.spark_partition_id()), f"{name}-parts")

    def put(k: int) -> None:
        parts.where(F.col("_part") == k).drop("_part").write.mode("append").parquet(path)

    def arrive():
        for k in range(count):
            if k:
                put(k)
            yield k

    put(0)
    return run.read_files(t.spark, path, rows.schema), arrive()


def _restarted(parts, start) -> None:
    """Start the stream anew for every part that arrives: each time it goes on from its checkpoint."""
    for _ in parts:
        start().awaitTermination()


def _posted_in_parts(t, name: str) -> DataFrame:
    stream, parts = _in_parts(t, t.movements, MOVE_ORDER, name)
    path, checkpoint = _places(t, name)
    _restarted(parts, lambda: posting.post_stream(stream, _opening(t, 1), path, checkpoint, MOVE_ORDER))
    return t.spark.read.parquet(path)


@query
def stream_ledger(t):
    """Three batches, with a restart before each."""
    return _posted_in_parts(t, "ledger").where("reason is null").select(
        "product_id", "created_at", "id", "type", "qty", "qty_before", "qty_after")


@query
def stream_rejects(t):
    return _posted_in_parts(t, "rejects").where("reason is not null").select("product_id", "created_at", "id", "qty", "reason")


@query
def stream_posted_alerts(t):
    """Alerts from balances that the same stream has posted."""
    movements = _some_by_hand(t.movements)
    stream, parts = _in_parts(t, movements, MOVE_ORDER, "alerts")
    path, checkpoint = _places(t, "alerts")
    _restarted(parts, lambda: posting.alert_stream(stream, _opening(t, 1), t.products, path, checkpoint, MOVE_ORDER))
    return t.spark.read.parquet(path).select("target_role", "message", "source_id", "created_at")


@query
def stream_paid_spend(t):
    stream, parts = _in_parts(t, t.order_changes, workflow.CHANGE_ORDER, "spend")
    path, checkpoint = _places(t, "spend")
    _restarted(parts, lambda: posting.spend_stream(stream, _fresh_orders(t), path, checkpoint))
    return posting.total_spend(t.spark, path, t.orders)


@query
def stream_payment_notes(t):
    """Changes and orders both arrive in parts; payments meet their orders across batches."""
    changes, parts = _in_parts(t, t.order_changes, workflow.CHANGE_ORDER, "paid")
    placed, order_parts = _in_parts(t, t.orders, ["created_at", "id"], "placed")
    path, checkpoint = _places(t, "payment-notes")
    _restarted(zip(order_parts, parts), lambda: posting.payment_notes(changes, placed, _fresh_orders(t), path, checkpoint))
    return t.spark.read.parquet(path).select("target_role", "type", "message", "source_id", "created_at")


@query
def stream_top_viewed(t):
    stream, parts = _in_parts(t, t.product_views, ["created_at", "id"], "top-views")
    path, checkpoint = _places(t, "top-viewed")
    _restarted(parts, lambda: run.whole_to(flow.most_viewed(stream, t.products), path, checkpoint))
    return run.newest_result(t.spark, path)


# --- further audits, streams and sinks --------------------------------------------------------------
def _attempts(events):
    """Sign-in attempts from one of two addresses; every third one succeeds."""
    return events.select(F.col("event_id").alias("id"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 2).cast("string")).alias("ip_address"),
                         (F.col("event_id") % 3 == 0).alias("success"), F.col("ts").alias("created_at"))


@query
def failed_logins(t):
    failed = _attempts(t.raw("events")).where("not success")
    return audit.rate_audit(failed, "ip_address", 2).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_failed_logins(t):
    rates = _updated(t, flow.failed_logins(_attempts(_streams(t).raw("events")), limit=2), "failed-logins", ["ip_address", "window_start"])
    return rates.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query
def stream_contact_notes(t):
    return _appended(t, notify.contact_received(_streams(t).contacts), "contact-notes").select("target_role", "message", "source_id")


@query
def stream_product_notes(t):
    return _appended(t, notify.product_created(_streams(t).products), "product-notes").select("target_role", "message", "source_id")


@query
def contacts_marked(t):
    reads = t.contacts.where("id % 3 = 0").select(F.col("id").alias("contact_id"))
    return site.mark_contacts_read(t.contacts, reads).select("id", "is_read")


@query
def unique_key_clashes(t):
    """The declared keys, and the line ids of this data, which do clash."""
    tables = {"orders": t.orders, "products": t.products, "customers": t.customers, "suppliers": t.suppliers, "settings": t.settings,
              "product_tags": t.product_tags, "order_items": t.order_items}
    parts = [checks.duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("clash_count")).select(
        F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "clash_count")
        for name, df in tables.items() for keys in UNIQUE_KEYS.get(name, [["id"]])]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _spoilt(df: DataFrame, **faults) -> DataFrame:
    """`df` with a wrong value in every n-th row: column=(n, value)."""
    return df.withColumns({c: F.when(F.col("id") % n != 0, F.col(c)).otherwise(F.lit(value)) for c, (n, value) in faults.items()})


@query
def table_faults(t):
    """Rows that break their table's declaration: missing values and values outside their lists."""
    tables = {
        "products": _spoilt(t.products, name=(11, None), publish_status=(7, "sold")),
        "orders": _spoilt(t.orders, order_number=(17, None), status=(9, "lost"), payment_status=(13, "later")),
        "stock_transactions": _spoilt(t.stock_transactions, type=(19, "moved"), reference_type=(23, "gift")),
        "admin_users": _spoilt(t.users, email=(5, None), role=(3, "owner")),
        "settings": _spoilt(t.settings, type=(2, "blob")),
    }
    parts = [checks.validate(df, checks.table_rules(name, df.columns))[1].select(
        F.lit(name).alias("table_name"), "id", F.array_join("reasons", ",").alias("reasons")) for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def order_change_faults(t):
    cid = F.col("id")
    changes = t.order_changes.select(
        "id", F.when(cid % 10 == 0, "lost").when(cid % 10 > 2, "confirmed").alias("status"),
        F.when(cid % 10 == 1, "maybe").when(cid % 10 > 2, "paid").alias("payment_status"),
        F.when(cid % 10 > 2, "5").alias("amount_paid"), F.lit("").alias("notes"))
    return checks.validate(changes, checks.order_change_rules())[1].select("id", F.array_join("reasons", ",").alias("reasons"))


@query
def orders_saved(t):
    """Written by day and read back with the fixed schema."""
    root = work_path(t.spark, "saved")
    save_table(t.orders, "orders", root)
    return read_table(t.spark, "orders", root).select("id", "order_number", "status", "total", "created_at")


@query
def order_documents_saved(t):
    """The order documents, written as JSON lines and read back; orders without items have none."""
    path = work_path(t.spark, "documents")
    write_documents(orders.order_documents(t.orders, t.order_items, t.products, t.users).select("id", "part_no", "confirmed_by_name", "items"), path)
    back = t.spark.read.schema("id long, part_no long, confirmed_by_name string, items array<struct<product_id:long,qty:long,slug:string>>").json(path)
    lines = F.coalesce("items", F.array().cast("array<struct<product_id:bigint,qty:bigint,slug:string>>"))
    return back.select("id", "confirmed_by_name", F.size(lines).cast("long").alias("line_count"),
                       F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["qty"]).alias("qty"),
                       F.size(F.filter(lines, lambda x: x["slug"].isNotNull())).cast("long").alias("known_products"))


@query
def invoice_document_lines(t):
    """The invoice documents, line by line, with their header and company data beside each."""
    made = orders.invoice_documents(t.orders, t.order_items, t.customers, t.users, t.settings)
    lines = made.select("id", "order_number", "customer_addr", "customer_phone", "outstanding", "company", F.explode_outer("items").alias("item"))
    company = F.array_join(F.array_sort(F.transform(F.map_entries("company"), lambda e: F.concat_ws("=", e["key"], F.substring(e["value"], 1, 6)))), ";")
    return lines.select("id", "order_number", "customer_addr", "customer_phone", "outstanding", F.col("item.row_no").cast("bigint").alias("line_no"),
                        "item.product_name", "item.product_sku", F.col("item.qty").cast("bigint").alias("qty"), "item.unit_price",
                        F.col("item.subtotal").alias("line_total"), company.alias("company"))


@query
def stock_export(t):
    """The exported stock report, read back: every row numbered in the report's order."""
    path = work_path(t.spark, "stock-export")
    stock.export_stock_report(t.products, t.categories, t.settings, path, sort="publish_status", direction="desc")
    return t.spark.read.parquet(f"{path}/rows").select("row_no", "id", "sku", "publish_status", "category_name", "stock_value")


@query
def stock_export_header(t):
    path = work_path(t.spark, "stock-export")
    stock.export_stock_report(t.products, t.categories, t.settings, path, term="bolt")
    return t.spark.read.parquet(f"{path}/header").drop("company")


@query
def transactions_export(t):
    """The exported movement report of two years, read back."""
    path = work_path(t.spark, "transactions-export")
    stock.export_transaction_report(t.stock_transactions, t.products, t.suppliers, t.users, t.settings, path, order=[F.desc(c) for c in MOVE_ORDER],
                                    date_from=dt.date(1996, 1, 1), date_to=dt.date(1997, 12, 31))
    return t.spark.read.parquet(f"{path}/rows").select("row_no", "id", "product_id", "created_at", *_long("qty"), "type_label", "supplier_name")


# --- saved tables -----------------------------------------------------------------------------------
ORDER_PAGES = [("created_at", False), ("id", False)]


@query
def order_last_page(t):
    """The last page of all orders, from the index of page starts."""
    path = work_path(t.spark, "order-pages")
    save_pages(t.orders, ORDER_PAGES, path, 50)
    last = t.spark.read.parquet(f"{path}/pages").agg(F.max("page")).first()[0]
    return saved_page(t.spark, ORDER_PAGES, path, last).select("id", "order_number", "created_at", "total")


@query
def catalog_deep_page(t):
    path = work_path(t.spark, "catalog-pages")
    order = [("is_featured", False), ("sort_order", True), ("created_at", False), ("id", False)]
    save_pages(catalog.catalog(t.products, t.categories, t.product_tags), order, path, 7)
    return saved_page(t.spark, order, path, 3).select(*CATALOG_COLUMNS)


@query
def user_patches_saved(t):
    """Patches applied to the buckets of a saved table that they touch, and the table read back."""
    path = work_path(t.spark, "users")
    save_buckets(t.users, "id", path, 16)
    patches = _user_patches(t)
    change_buckets(t.spark, "id", path, patches, lambda rows: feeds.apply_patch(rows, patches, "id", ["created_at", "seq"], ["phone", "full_name"])[0], 16)
    return read_buckets(t.spark, path).select("id", "phone", "full_name", "email")


@query
def tag_replacement_saved(t):
    """Tags replaced in the buckets of the edited products."""
    path = work_path(t.spark, "tags")
    save_buckets(t.product_tags, "product_id", path, 32)
    edited, fresh = _edited_tags(t)
    change_buckets(t.spark, "product_id", path, edited, lambda rows: feeds.replace_children(rows, edited, "product_id", fresh), 32)
    return read_buckets(t.spark, path).select("product_id", "tag")


@query
def catalog_search_indexed(t):
    """The search of catalog_search over a saved table with postings."""
    path = work_path(t.spark, "product-search")
    columns = ["name", "short_desc", "material"]
    save_search(t.products, "id", columns, path)
    found = search_saved(t.spark, "id", path, "BRAND#1", columns)
    return catalog.catalog(found, t.categories, t.product_tags, category="economy").select(*CATALOG_COLUMNS)


@query
def customer_search_indexed(t):
    path = work_path(t.spark, "customer-search")
    columns = ["name", "code", "phone", "email"]
    save_search(t.customers, "id", columns, path)
    return search_saved(t.spark, "id", path, "s15", columns).select("id", "name", "code")
