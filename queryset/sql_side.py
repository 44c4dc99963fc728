"""Oracle SQL for the registered queries (DuckDB), on the same Parquet views."""

from __future__ import annotations

from queryset.entities import PUBLIC, names, with_entities
from stockroom.fixed_values import INVOICE_SETTINGS, PUBLISH_STATUSES, STATUS_LABELS

ORACLE: dict[str, str] = {}


def add(name: str, sql: str, *recursive: str) -> None:
    ORACLE[name] = with_entities(sql, *recursive)


AS_OF = "DATE '1998-06-30'"
NOW = "TIMESTAMP '2024-01-30 00:00:00'"
DEDUCTED = "('confirmed', 'processing', 'ready', 'delivered')"
MOVE_ORDER = "created_at, id, supplier_key, qty, type"


def rp(x: str) -> str:
    """Rupiah text of an amount with two decimals."""
    whole = f"regexp_replace(reverse(regexp_replace(reverse(floor({x})::BIGINT::VARCHAR), '(\\d{{3}})', '\\1.', 'g')), '^\\.', '')"
    cents = f"rtrim(lpad((({x} * 100)::BIGINT % 100)::VARCHAR, 2, '0'), '0')"
    return f"(CASE WHEN coalesce({x}, 0) = 0 THEN 'Rp 0' ELSE 'Rp ' || {whole} || CASE WHEN {cents} = '' THEN '' ELSE ',' || {cents} END END)"


def status_label(x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_LABELS.items())
    return f"CASE {x} {cases} ELSE {x} END"


MONTHS = "['Jan', 'Feb', 'Mar', 'Apr', 'Mei', 'Jun', 'Jul', 'Agu', 'Sep', 'Okt', 'Nov', 'Des']"


def date_label(x: str) -> str:
    return f"strftime({x}, '%d ') || {MONTHS}[month({x})] || strftime({x}, ' %Y')"


# --- stock reports ------------------------------------------------------------------------------
add("stock_summary", """
SELECT p.id, p.sku, p.name, p.warehouse_stock, p.unit, p.publish_status, c.name AS category_name,
  coalesce(sum(CASE WHEN st.type = 'in' THEN st.qty ELSE 0 END), 0)::BIGINT AS total_in,
  coalesce(sum(CASE WHEN st.type = 'out' THEN st.qty ELSE 0 END), 0)::BIGINT AS total_out
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id LEFT JOIN stock_transactions_t st ON st.product_id = p.id
GROUP BY ALL""")
add("inventory_value", "SELECT coalesce(sum(warehouse_stock * cost_price), 0)::DECIMAL(25,2) AS inventory_value FROM products_t")
add("stock_flow_7d", f"""
SELECT d.day::DATE AS day, strftime(d.day, '%d/%m') AS label,
  coalesce(sum(CASE WHEN st.type = 'in' THEN st.qty END), 0)::BIGINT AS stock_in,
  coalesce(sum(CASE WHEN st.type = 'out' THEN st.qty END), 0)::BIGINT AS stock_out
FROM (SELECT unnest(generate_series({AS_OF} - 6, {AS_OF}, INTERVAL 1 DAY)) AS day) d
LEFT JOIN stock_transactions_t st ON st.created_at::DATE = d.day::DATE GROUP BY 1, 2""")
add("low_stock_top10", """
SELECT p.id, p.name, p.sku, p.warehouse_stock, p.unit, c.name AS category_name
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id WHERE p.warehouse_stock <= 5
ORDER BY p.warehouse_stock, p.id LIMIT 10""")
add("recent_transactions", """
SELECT st.id, st.product_id, st.type, st.qty, st.created_at, p.name AS product_name, p.sku, u.full_name AS created_by_name
FROM stock_transactions_t st LEFT JOIN products_t p ON p.id = st.product_id LEFT JOIN users_t u ON u.id = st.created_by
ORDER BY st.created_at DESC, st.id DESC, st.supplier_key DESC, st.qty DESC, st.type DESC LIMIT 10""")
add("transactions_filtered", """
SELECT st.id, st.product_id, st.qty, st.qty_before, st.qty_after, st.reference_no, p.name AS product_name, p.sku, p.unit,
  s.name AS supplier_name, u.full_name AS created_by_name, st.created_at,
  CASE st.type WHEN 'in' THEN '+' WHEN 'out' THEN '-' ELSE '±' END || st.qty AS signed_qty, 'Masuk' AS type_label
FROM stock_transactions_t st LEFT JOIN products_t p ON p.id = st.product_id LEFT JOIN suppliers_t s ON s.id = st.supplier_id
LEFT JOIN users_t u ON u.id = st.created_by
WHERE st.type = 'in' AND st.created_at::DATE >= DATE '1998-01-01' AND st.created_at::DATE <= DATE '1999-12-31'
  AND (p.name ILIKE '%ring%' OR p.sku ILIKE '%ring%' OR st.reference_no ILIKE '%ring%')""")
add("transaction_report_all", f"""
SELECT st.type, {status_label('st.type')} AS type_label, count(*) AS row_count, count(s.name) AS supplier_rows, sum(qty)::BIGINT AS qty
FROM stock_transactions_t st LEFT JOIN suppliers_t s ON s.id = st.supplier_id GROUP BY 1, 2""")
_REPORT = """
SELECT p.id, p.sku, p.name, p.warehouse_stock, p.unit, p.cost_price, p.sell_price, p.publish_status, c.name AS category_name,
  (p.warehouse_stock * p.cost_price)::DECIMAL(15,2) AS stock_value
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id"""
add("stock_report_sorted", _REPORT)
add("stock_report_top_value", _REPORT + " WHERE p.name ILIKE '%bolt%' OR p.sku ILIKE '%bolt%' ORDER BY stock_value DESC, p.name, p.id LIMIT 25 OFFSET 25")

# --- catalogue ----------------------------------------------------------------------------------
_CATALOG = """
SELECT p.id, p.name, p.slug, p.short_desc, p.price_label, p.is_featured, p.sort_order, p.created_at, p.warehouse_stock,
  c.name AS category_name, c.slug AS category_slug, c.icon AS category_icon
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id WHERE p.publish_status = 'published' AND p.is_active"""
_CATALOG_ORDER = " ORDER BY p.is_featured DESC, p.sort_order, p.created_at DESC, p.id DESC"
add("catalog_page", _CATALOG + _CATALOG_ORDER + " LIMIT 12 OFFSET 12")
add("catalog_search", _CATALOG + " AND (p.name ILIKE '%brand#1%' OR p.short_desc ILIKE '%brand#1%' OR p.material ILIKE '%brand#1%') AND c.slug = 'economy'")
add("catalog_search_any_accent", "SELECT id, name FROM products_t WHERE publish_status = 'published' AND is_active AND (name ILIKE '%ring%' OR short_desc ILIKE '%ring%' OR material ILIKE '%ring%')")
add("catalog_by_tag", _CATALOG + " AND p.is_featured AND EXISTS (SELECT 1 FROM product_tags_t pt WHERE pt.product_id = p.id AND pt.tag = 'ring')")
add("catalog_page_info", """
SELECT total, 2::BIGINT AS page, 12::BIGINT AS "limit", ceil(total / 12)::BIGINT AS total_pages, 13::BIGINT AS shown_from,
  least(24, total) AS shown_to FROM (SELECT count(*) AS total FROM products_t WHERE publish_status = 'published' AND is_active)""")
add("featured_products", """
SELECT p.id, p.name, p.slug, c.name AS category_name FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id
WHERE p.publish_status = 'published' AND p.is_active AND p.is_featured ORDER BY p.sort_order, p.created_at DESC, p.id DESC LIMIT 6""")
add("published_products", _CATALOG.replace("c.icon AS category_icon", "c.icon AS category_icon, c.color_from, c.color_to"))
add("new_products", """
SELECT p.id, p.name, p.publish_status, c.name AS category_name, u.full_name AS created_by_name, p.created_at
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id LEFT JOIN users_t u ON u.id = p.created_by
WHERE p.publish_status IN ('new', 'draft', 'review', 'ready')""")
add("admin_products_low_stock", """
SELECT p.id, p.name, p.publish_status, p.warehouse_stock, c.name AS category_name, u.full_name AS created_by_name
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id LEFT JOIN users_t u ON u.id = p.created_by
WHERE p.warehouse_stock <= 3 AND p.warehouse_stock > 0""")
add("admin_products_out_of_stock", """
SELECT p.id, p.name, p.publish_status, c.slug AS category_slug FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id
WHERE p.warehouse_stock = 0 AND c.slug = 'promo'""")
add("product_visibility_by_role", """
SELECT role, id, (CASE WHEN role IN ('superadmin', 'admin_gudang') THEN cost_price ELSE sell_price END)::VARCHAR AS shown_price
FROM products_t, (VALUES ('superadmin'), ('admin_gudang'), ('admin_website'), ('marketing')) r(role)
WHERE role <> 'marketing' OR publish_status = 'published'""")
add("product_editors", """
SELECT p.id, u.full_name AS created_by_name, b.full_name AS published_by_name
FROM products_t p LEFT JOIN users_t u ON u.id = p.created_by LEFT JOIN users_t b ON b.id = p.published_by""")
add("product_badges", f"""
SELECT id, name, warehouse_stock, CASE WHEN warehouse_stock = 0 THEN 'SOLD OUT' WHEN warehouse_stock <= 3 THEN 'STOK TERBATAS' END AS badge,
  CASE WHEN warehouse_stock <= 3 THEN 'danger' WHEN warehouse_stock <= 10 THEN 'warning' ELSE 'success' END AS list_colour,
  CASE WHEN warehouse_stock = 0 THEN 'danger' WHEN warehouse_stock <= 5 THEN 'warning' ELSE 'success' END AS summary_colour,
  {status_label('publish_status')} AS status_label FROM products_t""")
add("category_counts_active", """
SELECT c.id, c.name, count(p.id) AS product_count FROM categories_t c LEFT JOIN products_t p ON p.category_id = c.id AND p.is_active
WHERE c.is_active GROUP BY 1, 2""")
add("category_counts_all", "SELECT c.id, c.name, count(p.id) AS product_count FROM categories_t c LEFT JOIN products_t p ON p.category_id = c.id GROUP BY 1, 2")
add("top_viewed", """
SELECT id, name, slug, view_count, CASE WHEN length(name) > 18 THEN substr(name, 1, 18) || '...' ELSE name END AS label
FROM products_t WHERE is_active ORDER BY view_count DESC, id LIMIT 5""")
add("primary_images", """
SELECT product_id, id, filename, is_primary FROM product_images_t
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY is_primary DESC, sort_order, id) = 1""")
add("next_image_order", "SELECT product_id, (coalesce(max(sort_order), 0) + 1)::BIGINT AS next_sort_order FROM product_images_t GROUP BY 1")
add("append_images", """
SELECT id, product_id, is_primary, sort_order::BIGINT AS sort_order FROM product_images_t
UNION ALL
SELECT a.id + 1000000, a.product_id, false, (m.top + row_number() OVER (PARTITION BY a.product_id ORDER BY a.id))::BIGINT
FROM product_images_t a JOIN (SELECT product_id, max(sort_order) AS top FROM product_images_t GROUP BY 1) m USING (product_id)
WHERE a.id % 3 = 0""")
_CHOSEN = """(SELECT product_id, arg_max(id, struct_pack(a := sort_order, b := id)) AS chosen FROM product_images_t
  WHERE id % 4 = 1 GROUP BY 1)"""
add("primary_switch", f"""
SELECT i.id, i.product_id, CASE WHEN c.chosen IS NULL THEN i.is_primary ELSE i.id = c.chosen END AS is_primary
FROM product_images_t i LEFT JOIN {_CHOSEN} c USING (product_id)""")
add("primary_switch_thumbnails", f"""
SELECT p.id, CASE WHEN c.chosen IS NULL THEN p.thumbnail ELSE 'img-' || c.chosen || '.jpg' END AS thumbnail
FROM products_t p LEFT JOIN {_CHOSEN} c ON c.product_id = p.id""")
add("product_documents", """
SELECT p.id, 1::BIGINT AS part_no, c.name AS category_name, u.full_name AS created_by_name, b.full_name AS published_by_name,
  coalesce(i.files, '') AS image_files, coalesce(g.tags, '') AS tag_list
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id LEFT JOIN users_t u ON u.id = p.created_by
LEFT JOIN users_t b ON b.id = p.published_by
LEFT JOIN (SELECT product_id, string_agg(filename, ',' ORDER BY is_primary DESC, sort_order, id) AS files FROM product_images_t GROUP BY 1) i
  ON i.product_id = p.id
LEFT JOIN (SELECT product_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM product_tags_t GROUP BY 1) g ON g.product_id = p.id""")
add("price_label_backfill", f"""
SELECT id, CASE WHEN (price_label IN ('', 'Hubungi Kami') OR starts_with(price_label, 'Mulai Rp 0')) AND sell_price > 0
  THEN 'Mulai ' || {rp('sell_price')} ELSE price_label END AS price_label FROM products_t""")
add("tag_load", """
SELECT id AS product_id, unnest(list_distinct([material, name])) AS tag FROM products_t""")
add("tag_replacement", """
SELECT product_id, tag FROM product_tags_t WHERE product_id % 10 <> 3
UNION ALL SELECT id, unnest([material, 'sale']) FROM products_t WHERE id % 10 = 3""")
_SLUG = "replace(name, ' ', '-')"
add("slug_assign", f"""
SELECT n.id, CASE WHEN EXISTS (SELECT 1 FROM olds o WHERE starts_with(o.slug, n.base))
  OR EXISTS (SELECT 1 FROM news m WHERE m.id < n.id AND starts_with(m.base, n.base)) THEN n.base || '-' || n.id ELSE n.base END AS slug
FROM news n""", f"news AS (SELECT id + 1000000 AS id, {_SLUG} AS base FROM products_t WHERE id % 3 <> 0)",
    f"olds AS (SELECT DISTINCT {_SLUG} || '-' || warehouse_stock AS slug FROM products_t WHERE id % 3 = 0)")
_PUBLISH_FEED = """(SELECT id, id * 3 % 2500 AS product_id, ['published', 'hidden', 'review', 'sold', 'archived'][id % 5 + 1] AS status,
  user_id AS changed_by, created_at FROM activity_logs_t)"""
add("publish_changes", f"""
SELECT p.id, coalesce(l.status, p.publish_status) AS publish_status, coalesce(l.status = 'published', p.is_active) AS is_active,
  coalesce(b.changed_by, p.published_by) AS published_by
FROM products_t p
LEFT JOIN (SELECT * FROM {_PUBLISH_FEED} WHERE status <> 'sold'
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC) = 1) l ON l.product_id = p.id
LEFT JOIN (SELECT * FROM {_PUBLISH_FEED} WHERE status = 'published'
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC) = 1) b ON b.product_id = p.id""")
add("publish_rejects", f"""
SELECT f.id, f.product_id, CASE WHEN f.status = 'sold' THEN 'status_invalid' ELSE 'product_not_found' END AS reason
FROM {_PUBLISH_FEED} f WHERE f.status = 'sold' OR f.product_id NOT IN (SELECT id FROM products_t)""")

# --- orders -------------------------------------------------------------------------------------
_COUNTED = "(SELECT order_id, count(*) AS n FROM order_items_t GROUP BY 1)"
add("order_list_filtered", """
SELECT o.id, o.order_number, o.status, o.total, o.created_at, u.full_name AS created_by_name, count(oi.id) AS item_count
FROM orders_t o LEFT JOIN users_t u ON u.id = o.created_by LEFT JOIN order_items_t oi ON oi.order_id = o.id
WHERE o.status = 'confirmed' AND o.payment_status = 'partial' AND o.created_at::DATE >= DATE '1998-02-01'
  AND o.created_at::DATE <= DATE '1998-11-30'
  AND (o.order_number ILIKE '%ord-1998%' OR o.customer_name ILIKE '%ord-1998%' OR o.customer_phone ILIKE '%ord-1998%')
GROUP BY ALL""")
add("order_page", f"""
SELECT o.id, o.order_number, o.status, o.created_at, u.full_name AS created_by_name, coalesce(i.n, 0) AS item_count
FROM (SELECT * FROM orders_t ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 200) o
LEFT JOIN users_t u ON u.id = o.created_by LEFT JOIN {_COUNTED} i ON i.order_id = o.id""")
add("order_page_after", """
SELECT id, created_at, total FROM orders_t WHERE created_at < TIMESTAMP '1999-01-10' OR (created_at = TIMESTAMP '1999-01-10' AND id < 5000)
ORDER BY created_at DESC, id DESC LIMIT 50""")
add("order_summary", f"""
SELECT o.id, o.order_number, o.status, o.total, c.name AS customer_name_ref, u.full_name AS created_by_name, coalesce(i.n, 0) AS item_count
FROM orders_t o LEFT JOIN customers_t c ON c.id = o.customer_id LEFT JOIN users_t u ON u.id = o.created_by
LEFT JOIN {_COUNTED} i ON i.order_id = o.id""")
_MONTH = f"(year(created_at) = year({AS_OF}) AND month(created_at) = month({AS_OF}))"
add("order_stats", f"""
SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending,
  count(*) FILTER (status IN ('confirmed', 'processing')) AS processing, count(*) FILTER (status = 'delivered') AS delivered,
  count(*) FILTER (created_at::DATE = {AS_OF}) AS today_count, count(*) FILTER ({_MONTH}) AS this_month_count,
  count(*) FILTER (status = 'confirmed' AND {_MONTH}) AS month_confirmed_count,
  count(*) FILTER (status IN ('cancelled', 'refunded') AND {_MONTH}) AS cancelled_count FROM orders_t""")
add("orders_30d", f"""
SELECT d.day::DATE AS day, strftime(d.day, '%d/%m') AS label, count(o.id) AS order_count
FROM (SELECT unnest(generate_series({AS_OF} - 29, {AS_OF}, INTERVAL 1 DAY)) AS day) d
LEFT JOIN orders_t o ON o.created_at::DATE = d.day::DATE GROUP BY 1, 2""")
add("customer_order_history", "SELECT id, order_number, status, total, created_at FROM orders_t WHERE customer_id = 7 ORDER BY created_at DESC, id DESC LIMIT 50")
_LINE_ORDER = "id, product_name, supplier_key, qty, subtotal"
_NUMBERED = f"(SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {_LINE_ORDER}) AS line_no FROM order_items_t)"
add("order_documents", f"""
SELECT o.id, 1::BIGINT AS part_no, u.full_name AS created_by_name, f.full_name AS confirmed_by_name, coalesce(l.n, 0) AS item_count,
  coalesce(l.lines, '') AS lines
FROM orders_t o LEFT JOIN users_t u ON u.id = o.created_by LEFT JOIN users_t f ON f.id = o.confirmed_by
LEFT JOIN (SELECT i.order_id, count(*) AS n, string_agg(i.line_no || '/' || i.product_name || '/' || i.qty || '/' || coalesce(p.slug, '-'), ';'
  ORDER BY i.line_no) AS lines FROM {_NUMBERED} i LEFT JOIN products_t p ON p.id = i.product_id GROUP BY 1) l ON l.order_id = o.id""")
add("invoice_headers", f"""
SELECT o.id, o.order_number, coalesce(nullif(c.address, ''), o.customer_addr) AS customer_addr,
  coalesce(nullif(c.phone, ''), o.customer_phone) AS customer_phone, coalesce(nullif(c.email, ''), o.customer_email) AS customer_email,
  u.full_name AS created_by_name, CASE WHEN o.total - o.amount_paid > 0 THEN (o.total - o.amount_paid)::DECIMAL(15,2) END AS outstanding,
  {rp('o.total')} AS total_label, {date_label('o.created_at')} AS date_label, {status_label('o.payment_status')} AS payment_label
FROM orders_t o LEFT JOIN users_t u ON u.id = o.created_by LEFT JOIN customers_t c ON c.id = o.customer_id""")
add("invoice_lines", f"""
SELECT i.order_id, o.order_number, i.line_no, i.product_name, i.qty, i.unit_price, i.subtotal
FROM {_NUMBERED} i JOIN orders_t o ON o.id = i.order_id""")
add("line_resolution", """
SELECT t.id, t.order_id, t.label, p.id AS product_id, p.sku AS product_sku,
  (CASE WHEN p.id IS NULL THEN t.qty ELSE least(t.qty, p.warehouse_stock) END)::BIGINT AS qty,
  coalesce(p.sell_price, t.unit_price) AS unit_price, p.id IS NOT NULL AND p.warehouse_stock < t.qty AS was_capped
FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 'special work' ELSE '[SKU-' || (supplier_key * 7 % 300) || '] small ring' END AS label
  FROM order_items_t) t LEFT JOIN products_t p ON '[' || p.sku || '] ' || p.name = t.label""")


def number(seq: str) -> str:
    return f"'ORD-' || year(created_at) || '-' || lpad(({seq})::VARCHAR, greatest(4, length(({seq})::VARCHAR))::INTEGER, '0')"


add("order_numbers", f"SELECT id, {number('row_number() OVER (PARTITION BY year(created_at) ORDER BY created_at, id)')} AS order_number FROM orders_t")
add("order_numbers_continued", f"""
SELECT id, {number('seq')} AS order_number FROM (
  SELECT n.*, row_number() OVER (PARTITION BY year(n.created_at) ORDER BY n.created_at, n.id) + coalesce(m.last, 0) AS seq
  FROM orders_t n LEFT JOIN (SELECT split_part(order_number, '-', 2)::INTEGER AS y, max(split_part(order_number, '-', 3)::BIGINT) AS last
    FROM orders_t WHERE id % 3 <> 0 GROUP BY 1) m ON m.y = year(n.created_at) WHERE n.id % 3 = 0)""")
_HEADERS = """heads AS (SELECT id AS order_ref, CASE WHEN id % 17 = 0 THEN '  ' ELSE ' ' || customer_name END AS customer_name,
  CASE WHEN id % 9 = 0 THEN 0 ELSE greatest((id % 7 - 1) * 1000, 0) END::DECIMAL(15,2) AS discount,
  (id % 5 * 50 + 0.5)::DECIMAL(15,2) AS shipping_cost FROM orders_t)"""
_ITEMS = """lines AS (SELECT order_id AS order_ref, qty, unit_price, id::HUGEINT * 10000000 + supplier_key AS place,
  CASE WHEN supplier_key % 97 = 5 OR (id % 107 = 0 AND id % 101 <> 0 AND id % 103 <> 0) OR (id % 113 = 0 AND id % 109 <> 0) THEN 'item_incomplete'
    WHEN id % 101 = 0 OR id % 103 = 0 THEN 'qty_invalid' WHEN id % 109 = 0 THEN 'price_invalid' END AS fault FROM order_items_t)"""
_JUDGED = """judged AS (SELECT h.*, CASE WHEN trim(h.customer_name) = '' THEN 'customer_missing' WHEN count(l.order_ref) = 0 THEN 'no_items'
  ELSE arg_min(l.fault, l.place) FILTER (l.fault IS NOT NULL) END AS reason, sum(l.qty * l.unit_price)::DECIMAL(15,2) AS subtotal, count(l.order_ref) AS line_count,
  sum(l.qty)::BIGINT AS qty FROM heads h LEFT JOIN lines l USING (order_ref)
  GROUP BY h.order_ref, h.customer_name, h.discount, h.shipping_cost)"""
add("order_pricing", """
SELECT order_ref, trim(customer_name) AS customer_name, subtotal, discount, shipping_cost,
  greatest(subtotal - discount + shipping_cost, 0)::DECIMAL(15,2) AS total FROM judged WHERE reason IS NULL""", _HEADERS, _ITEMS, _JUDGED)
add("order_price_lines", "SELECT order_ref, line_count, qty, subtotal::DECIMAL(25,2) AS subtotal FROM judged WHERE reason IS NULL", _HEADERS, _ITEMS, _JUDGED)
add("order_price_rejects", "SELECT order_ref, reason FROM judged WHERE reason IS NOT NULL", _HEADERS, _ITEMS, _JUDGED)
_EDIT_SUMS = """sums AS (SELECT order_id, count(*) AS n, sum(CASE WHEN id % 11 = 0 THEN 0 ELSE qty END * unit_price)::DECIMAL(15,2) AS head_sum,
  sum((CASE WHEN id % 11 = 0 THEN 1 ELSE qty END * unit_price)::DECIMAL(15,2))::DECIMAL(25,2) AS row_sum
  FROM order_items_t WHERE order_id % 8 < 3 GROUP BY 1)"""
_EDITED = """edited AS (SELECT o.id AS order_id, id % 4 < 2 AND status NOT IN ('delivered', 'cancelled', 'refunded') AS on_it FROM orders_t o)"""
add("order_reprice", """
SELECT id, customer_id, customer_name, customer_phone, customer_email, delivery_date, subtotal, discount, shipping_cost,
  CASE WHEN on_it THEN greatest(subtotal - discount + shipping_cost, 0)::DECIMAL(15,2) ELSE total END AS total
FROM (SELECT o.id, CASE WHEN on_it AND o.id % 3 = 0 THEN o.id % 50 ELSE o.customer_id END AS customer_id,
  CASE WHEN on_it AND o.id % 6 <> 1 THEN 'New name' ELSE o.customer_name END AS customer_name,
  CASE WHEN on_it THEN CASE WHEN o.id % 3 = 0 THEN '0800' END ELSE o.customer_phone END AS customer_phone,
  CASE WHEN on_it THEN NULL ELSE o.customer_email END AS customer_email,
  CASE WHEN on_it THEN CASE WHEN o.id % 5 = 0 THEN DATE '2000-01-02' END ELSE o.delivery_date END AS delivery_date,
  CASE WHEN on_it THEN coalesce(s.head_sum, o.subtotal) ELSE o.subtotal END AS subtotal,
  CASE WHEN on_it THEN greatest(o.id % 4 * 10 - 10, 0) ELSE o.discount END::DECIMAL(15,2) AS discount,
  CASE WHEN on_it THEN 15 ELSE o.shipping_cost END::DECIMAL(15,2) AS shipping_cost, o.total, on_it
  FROM orders_t o JOIN edited e ON e.order_id = o.id LEFT JOIN sums s ON s.order_id = o.id)""", _EDIT_SUMS, _EDITED)
add("order_reprice_items", """
SELECT order_id, product_id, product_name, product_sku, CASE WHEN fresh AND id % 11 = 0 THEN 1 ELSE qty END::BIGINT AS qty,
  CASE WHEN fresh AND id % 4 = 0 THEN 'set' ELSE 'unit' END AS unit, unit_price,
  CASE WHEN fresh THEN (CASE WHEN id % 11 = 0 THEN 1 ELSE qty END * unit_price)::DECIMAL(15,2) ELSE subtotal END AS subtotal,
  CASE WHEN fresh AND id % 6 = 0 THEN 'gift' WHEN NOT fresh THEN 'old' END AS notes
FROM (SELECT i.*, e.on_it AND i.order_id % 8 < 3 AS fresh FROM order_items_t i JOIN edited e USING (order_id))""", _EDITED)
add("order_reprice_rejects", """
SELECT id * 10 AS id, id AS order_id, 'order_closed' AS reason FROM orders_t WHERE id % 4 < 2 AND status IN ('delivered', 'cancelled', 'refunded')""")

# --- workflow and ledger ------------------------------------------------------------------------
_TRANSITIONS = f"""trans AS (SELECT id, order_id, changed_by, created_at, status, payment_status, coalesce(os, 'pending') AS old_status, coalesce(op, 'unpaid') AS old_payment,
  coalesce(status, os, 'pending') AS new_status, coalesce(payment_status, op, 'unpaid') AS new_payment
  FROM (SELECT *, last_value(status IGNORE NULLS) OVER w AS os, last_value(payment_status IGNORE NULLS) OVER w AS op FROM order_changes_t
    WINDOW w AS (PARTITION BY order_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""
add("status_transitions", "SELECT id, order_id, old_status, new_status, old_payment, new_payment FROM trans", _TRANSITIONS)
_MOVED = f"""moved AS (SELECT *, CASE WHEN new_status IN {DEDUCTED} THEN 'out' ELSE 'in' END AS type FROM trans
  WHERE (old_status IN {DEDUCTED}) <> (new_status IN {DEDUCTED}))"""
add("status_movements", """
SELECT m.id AS change_id, m.order_id, m.type, CASE m.type WHEN 'out' THEN 'sale' ELSE 'return' END AS reference_type, i.product_id, i.qty,
  m.created_at FROM moved m JOIN order_items_t i ON i.order_id = m.order_id WHERE i.product_id IS NOT NULL""", _TRANSITIONS, _MOVED)
add("paid_spend", """
SELECT o.customer_id, sum(o.total)::DECIMAL(25,2) AS added_spend, count(*) AS paid_count FROM trans t JOIN orders_t o ON o.id = t.order_id
WHERE t.new_payment = 'paid' AND t.old_payment <> 'paid' AND o.customer_id IS NOT NULL GROUP BY 1""", _TRANSITIONS)
add("orders_after_changes", """
SELECT o.id, l.new_status AS status, l.new_payment AS payment_status, coalesce(b.changed_by, o.confirmed_by) AS confirmed_by,
  coalesce(a.paid, o.amount_paid) AS amount_paid, n.notes
FROM orders_t o JOIN (SELECT * FROM trans QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, id DESC) = 1) l ON l.order_id = o.id
LEFT JOIN (SELECT * FROM trans WHERE status = 'confirmed' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, id DESC) = 1) b
  ON b.order_id = o.id
LEFT JOIN (SELECT order_id, greatest((id % 7 - 2) * 1000, 0)::DECIMAL(15,2) AS paid FROM trans WHERE id % 3 = 0
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, id DESC) = 1) a ON a.order_id = o.id
LEFT JOIN (SELECT order_id, 'note ' || id AS notes FROM trans WHERE id % 5 = 0
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, id DESC) = 1) n ON n.order_id = o.id""", _TRANSITIONS)
_BALANCES = f"""segs AS (SELECT s.*, p.warehouse_stock AS stock, sum((type = 'adjustment')::INTEGER) OVER (PARTITION BY product_id ORDER BY {MOVE_ORDER}
    ROWS UNBOUNDED PRECEDING) AS seg FROM stock_transactions_t s JOIN (SELECT id AS pid, warehouse_stock FROM products_t) p ON p.pid = s.product_id),
  sums AS (SELECT *, sum(CASE type WHEN 'in' THEN qty WHEN 'out' THEN -qty ELSE qty END)
    OVER (PARTITION BY product_id, seg ORDER BY type <> 'adjustment', {MOVE_ORDER} ROWS UNBOUNDED PRECEDING) AS run FROM segs)"""


def balances(factor: int) -> str:
    return f"""(SELECT *, qa - CASE type WHEN 'in' THEN qty WHEN 'out' THEN -qty ELSE 0 END AS qb FROM
      (SELECT *, CASE WHEN seg = 0 THEN stock * {factor} + run ELSE run END AS qa FROM sums))"""


add("ledger_running", f"""
SELECT product_id, created_at, id, type, qty::BIGINT AS qty,
  (CASE WHEN type = 'adjustment' THEN coalesce(lag(qa) OVER (PARTITION BY product_id ORDER BY {MOVE_ORDER}), stock) ELSE qb END)::BIGINT AS qty_before,
  qa::BIGINT AS qty_after FROM {balances(1)}""", _BALANCES)
# Row by row: step n books the n-th movement of every product.
_STEPS = f"""moves AS (SELECT s.*, row_number() OVER (PARTITION BY product_id ORDER BY {MOVE_ORDER}) AS n FROM stock_transactions_t s),
  steps AS (SELECT id AS product_id, 0::BIGINT AS n, 0::BIGINT AS qb, warehouse_stock::BIGINT AS qa, true AS ok FROM products_t
    UNION ALL
    SELECT m.product_id, m.n, s.qa, CASE m.type WHEN 'in' THEN s.qa + m.qty WHEN 'adjustment' THEN m.qty
      ELSE CASE WHEN s.qa >= m.qty THEN s.qa - m.qty ELSE s.qa END END::BIGINT, m.type <> 'out' OR s.qa >= m.qty
    FROM steps s JOIN moves m ON m.product_id = s.product_id AND m.n = s.n + 1)"""
add("ledger_posted", """
SELECT product_id, created_at, id, type, (CASE WHEN type = 'adjustment' THEN abs(qa - qb) ELSE qty END)::BIGINT AS qty, qb AS qty_before,
  qa AS qty_after FROM moves JOIN steps USING (product_id, n) WHERE ok""", _STEPS)
add("ledger_rejects", "SELECT product_id, created_at, id, qty::BIGINT AS qty, 'insufficient_stock' AS reason FROM moves JOIN steps USING (product_id, n) WHERE NOT ok", _STEPS)
add("ledger_closing", "SELECT product_id, arg_max(qa, n) AS closing_qty FROM steps GROUP BY 1", _STEPS)
add("publish_after_stock", """
SELECT p.id, CASE WHEN p.publish_status IN ('published', 'out_of_stock') THEN coalesce(e.status, p.publish_status) ELSE p.publish_status END
  AS publish_status
FROM products_t p LEFT JOIN (SELECT product_id, arg_max(CASE type WHEN 'out' THEN 'out_of_stock' ELSE 'published' END, n) AS status
  FROM moves JOIN steps USING (product_id, n) WHERE ok AND ((type = 'out' AND qa = 0) OR (type = 'in' AND qb = 0)) GROUP BY 1) e
  ON e.product_id = p.id""", _STEPS)

# --- customers ----------------------------------------------------------------------------------
_ROLLUP = """
SELECT c.id, c.name, count(o.id) AS total_orders_count, coalesce(sum(o.total), 0)::DECIMAL(25,2) AS total_spend_actual
FROM customers_t c LEFT JOIN orders_t o ON o.customer_id = c.id GROUP BY 1, 2"""
add("customer_rollup", _ROLLUP)
add("customer_search", """
SELECT c.id, c.name, count(o.id) AS total_orders_count FROM customers_t c LEFT JOIN orders_t o ON o.customer_id = c.id
WHERE c.name ILIKE '%c1%' OR c.code ILIKE '%c1%' OR c.phone ILIKE '%c1%' OR c.email ILIKE '%c1%' GROUP BY 1, 2""")
_LAST10 = """(SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) AS order_rank, id, order_number,
  status, total, created_at FROM orders_t WHERE customer_id IS NOT NULL)"""
add("customer_last10", f"SELECT * FROM {_LAST10} WHERE order_rank <= 10")
add("customer_documents", f"""
SELECT c.id, c.name, coalesce(string_agg(l.order_number, ',' ORDER BY l.order_rank) FILTER (l.order_rank <= 10), '') AS order_numbers
FROM customers_t c LEFT JOIN {_LAST10} l ON l.customer_id = c.id GROUP BY 1, 2""")
add("supplier_search", "SELECT id, code, name FROM suppliers_t WHERE name ILIKE '%7%' OR code ILIKE '%7%' OR contact_name ILIKE '%7%'")
add("deletable_customers", "SELECT id, name FROM customers_t c WHERE NOT EXISTS (SELECT 1 FROM orders_t o WHERE o.customer_id = c.id)")
add("blocked_customers", "SELECT customer_id AS id, count(*) AS order_count, 'customer_has_orders' AS reason FROM orders_t WHERE customer_id IS NOT NULL GROUP BY 1")
add("deletable_orders", "SELECT id, payment_status FROM orders_t WHERE payment_status <> 'paid'")

# --- dashboards ---------------------------------------------------------------------------------
_ADMIN = f"""
SELECT (SELECT count(*) FROM products_t WHERE is_active) AS total_products,
  (SELECT count(*) FROM categories_t WHERE is_active) AS total_categories,
  (SELECT count(*) FROM services_t WHERE is_active) AS total_services,
  (SELECT count(*) FROM testimonials_t) AS total_testimonials,
  (SELECT count(*) FROM contacts_t WHERE NOT is_read) AS unread_contacts, (SELECT count(*) FROM contacts_t) AS total_contacts,
  (SELECT count(*) FROM products_t WHERE is_featured AND is_active) AS featured_products,
  (SELECT count(*) FROM customers_t) AS total_customers, (SELECT count(*) FROM orders_t) AS total_orders,
  (SELECT count(*) FROM orders_t WHERE created_at::DATE = {AS_OF}) AS today_orders,
  (SELECT count(*) FROM suppliers_t) AS total_suppliers"""
add("admin_kpis", _ADMIN)
add("warehouse_kpis", f"""
SELECT (SELECT count(*) FROM products_t) AS total_products,
  (SELECT count(*) FROM products_t WHERE warehouse_stock <= 3 AND warehouse_stock > 0) AS low_stock,
  (SELECT count(*) FROM products_t WHERE warehouse_stock = 0) AS out_of_stock,
  (SELECT count(*) FROM suppliers_t WHERE is_active) AS total_suppliers,
  (SELECT count(*) FROM customers_t WHERE is_active) AS total_customers,
  (SELECT count(*) FROM orders_t WHERE status IN ('pending', 'confirmed', 'processing')) AS pending_orders,
  (SELECT coalesce(sum(qty), 0)::BIGINT FROM stock_transactions_t WHERE type = 'in' AND created_at::DATE = {AS_OF}) AS stock_in_today,
  (SELECT coalesce(sum(qty), 0)::BIGINT FROM stock_transactions_t WHERE type = 'out' AND created_at::DATE = {AS_OF}) AS stock_out_today,
  (SELECT coalesce(sum(warehouse_stock * cost_price), 0)::DECIMAL(25,2) FROM products_t) AS inventory_value""")
add("executive_kpis", f"""
SELECT (SELECT count(*) FROM users_t WHERE is_active) AS total_users,
  (SELECT count(*) FROM sessions_t WHERE is_active AND expires_at > {NOW}) AS active_sessions,
  (SELECT count(*) FROM orders_t) AS total_orders, (SELECT count(*) FROM orders_t WHERE status = 'pending') AS pending_orders,
  (SELECT count(*) FROM customers_t) AS total_customers, (SELECT count(*) FROM suppliers_t) AS total_suppliers,
  (SELECT count(*) FROM products_t) AS total_products,
  (SELECT count(*) FROM products_t WHERE publish_status IN ('new', 'draft', 'review')) AS new_products,
  (SELECT count(*) FROM orders_t WHERE created_at::DATE = {AS_OF}) AS today_orders,
  (SELECT count(*) FROM orders_t WHERE status = 'confirmed' AND {_MONTH}) AS month_confirmed,
  (SELECT count(*) FROM products_t WHERE warehouse_stock <= 3) AS low_stock,
  (SELECT count(*) FROM products_t WHERE warehouse_stock = 0) AS out_of_stock,
  (SELECT count(*) FROM contacts_t WHERE NOT is_read) AS unread_contacts,
  (SELECT coalesce(sum(warehouse_stock * cost_price), 0)::DECIMAL(25,2) FROM products_t) AS inventory_value""")
add("marketing_figures", f"SELECT total_products, today_orders, total_customers, unread_contacts, featured_products FROM ({_ADMIN})")
add("marketing_newest_orders", "SELECT id, order_number, total, created_at FROM orders_t ORDER BY created_at DESC, id DESC LIMIT 5")

# --- users, sessions, audit ---------------------------------------------------------------------
add("users_by_role", "SELECT role, count(*) AS user_count FROM users_t WHERE is_active GROUP BY 1")
add("user_list", """
SELECT id, username, email, full_name, phone, role, is_active, last_login, created_at FROM users_t
WHERE role = 'admin_gudang' AND (username ILIKE '%user1%' OR full_name ILIKE '%user1%' OR email ILIKE '%user1%')""")
add("activity_log_filtered", """
SELECT id, user_id, module, action, created_at FROM activity_logs_t WHERE user_id = 5 AND module = 'Products' AND action = 'CREATE'
ORDER BY created_at DESC, id DESC LIMIT 200""")
add("recent_logs", "SELECT id, username, action, created_at FROM activity_logs_t ORDER BY created_at DESC, id DESC LIMIT 10")
add("open_sessions", """
SELECT s.id, s.ip_address, s.expires_at, s.created_at, u.username, u.role FROM sessions_t s LEFT JOIN users_t u ON u.id = s.user_id
WHERE s.is_active ORDER BY s.created_at DESC, s.id DESC LIMIT 100""")
add("active_sessions", f"SELECT id, user_id, expires_at FROM sessions_t WHERE is_active AND expires_at > {NOW}")
add("role_violations", """
SELECT id, role, module, action FROM activity_logs_t WHERE NOT CASE action
  WHEN 'UPDATE_CMS' THEN role IN ('superadmin', 'admin_website') WHEN 'STOCK_OUT' THEN role IN ('superadmin', 'admin_gudang')
  WHEN 'CREATE_ORDER' THEN role IN ('superadmin', 'admin_gudang', 'marketing') WHEN 'CREATE_USER' THEN role = 'superadmin'
  WHEN 'CREATE' THEN role IN ('superadmin', 'admin_gudang') END""")
add("rate_audit_15m", """
SELECT ip_address, time_bucket(INTERVAL 15 MINUTE, created_at) AS window_start, count(*) AS request_count
FROM activity_logs_t GROUP BY 1, 2 HAVING count(*) > 2""")
add("audit_rows", """
SELECT user_id, action, record_id, CASE WHEN id % 2 = 0 THEN ip_address ELSE '127.0.0.1' END AS ip_address FROM activity_logs_t
WHERE id % 10 <> 0 AND id % 7 <> 0 AND id % 3 <> 0""")
add("user_switches", """
SELECT u.id, CASE WHEN coalesce(f.n, 0) % 2 = 1 THEN NOT u.is_active ELSE u.is_active END AS is_active
FROM users_t u LEFT JOIN (SELECT user_id, count(*) AS n FROM user_events_t WHERE action = 'toggle' GROUP BY 1) f ON f.user_id = u.id""")
add("sessions_after_events", """
SELECT s.id, s.user_id, s.is_active AND NOT EXISTS (SELECT 1 FROM closing c WHERE c.user_id = s.user_id AND c.created_at >= s.created_at) AS is_active
FROM sessions_t s""", """closing AS (SELECT * FROM (SELECT e.*, u.is_active AS start,
  sum((e.action = 'toggle')::INTEGER) OVER (PARTITION BY e.user_id ORDER BY e.created_at, e.id ROWS UNBOUNDED PRECEDING) AS toggles
  FROM user_events_t e JOIN users_t u ON u.id = e.user_id)
  WHERE action IN ('reset', 'logout') OR (action = 'toggle' AND NOT CASE WHEN toggles % 2 = 0 THEN start ELSE NOT start END))""")
add("user_validation", """
SELECT id, concat_ws(',', CASE WHEN id % 11 = 0 THEN 'login_missing' END, CASE WHEN id % 13 = 0 THEN 'role_invalid' END,
  CASE WHEN id % 30 < 8 THEN 'password_length' END, CASE WHEN id % 5 = 0 THEN 'email_invalid' END) AS reasons
FROM customers_t WHERE id % 11 = 0 OR id % 13 = 0 OR id % 30 < 8 OR id % 5 = 0""")
add("user_patches", """
SELECT u.id, coalesce(p.v, u.phone) AS phone, coalesce(n.v, u.full_name) AS full_name, u.email FROM users_t u
LEFT JOIN (SELECT user_id, 'p' || arg_max(id, struct_pack(a := created_at, b := id)) AS v FROM user_events_t WHERE id % 2 = 0 GROUP BY 1) p ON p.user_id = u.id
LEFT JOIN (SELECT user_id, 'name ' || arg_max(id, struct_pack(a := created_at, b := id)) AS v FROM user_events_t WHERE id % 3 = 0 GROUP BY 1) n ON n.user_id = u.id""")

# --- notifications ------------------------------------------------------------------------------
add("notification_feed", """
SELECT id, target_role, target_user, title, created_at FROM notifications_t
WHERE target_role = 'marketing' OR target_user = 4 OR target_role IS NULL ORDER BY created_at DESC, id DESC LIMIT 20""")
add("notification_inboxes", """
SELECT u.id AS user_id, n.id, n.created_at, n.title, n.is_read FROM users_t u JOIN notifications_t n
  ON n.target_role = u.role OR n.target_user = u.id OR n.target_role IS NULL
QUALIFY row_number() OVER (PARTITION BY u.id ORDER BY n.created_at DESC, n.id DESC) <= 20""")
add("unread_counts", """
SELECT u.id AS user_id, u.role, count(n.id) AS unread FROM users_t u LEFT JOIN notifications_t n
  ON NOT n.is_read AND (n.target_role = u.role OR n.target_user = u.id) GROUP BY 1, 2""")
add("notification_reads", """
SELECT n.id, n.is_read OR n.id % 5 = 0 OR EXISTS (SELECT 1 FROM marks m WHERE m.created_at >= n.created_at
  AND (m.role = n.target_role OR m.user_id = n.target_user)) AS is_read FROM notifications_t n""",
    """marks AS (SELECT e.user_id, u.role, e.created_at FROM user_events_t e JOIN users_t u ON u.id = e.user_id
  WHERE e.action = 'logout' AND (u.role = 'admin_gudang' OR u.id = 4))""")
add("notification_fanout", f"""
SELECT r AS target_role, 'success' AS type, 'Pesanan Baru Masuk' AS title,
  'Order ' || order_number || ' dari ' || customer_name || ' senilai ' || {rp('total')} AS message, '/admin/panel.html#orders' AS link,
  'order' AS source, id AS source_id, created_at FROM orders_t, (VALUES ('marketing'), ('superadmin')) v(r)
UNION ALL
SELECT r, 'success', 'Pembayaran Diterima', 'Pembayaran untuk order ' || o.order_number || ' telah LUNAS.', '/admin/panel.html#orders', 'payment',
  t.id, t.created_at FROM trans t JOIN orders_t o ON o.id = t.order_id, (VALUES ('marketing'), ('superadmin')) v(r)
WHERE t.new_payment = 'paid' AND t.old_payment <> 'paid'
UNION ALL
SELECT 'admin_gudang', 'warning', 'Stok Kritis!', 'Stok produk "' || p.name || '" tersisa ' || s.qty_after || ' unit. Harap segera re-stock.',
  '/admin/panel.html#stock', 'stock', s.id, s.created_at FROM stock_transactions_t s JOIN products_t p ON p.id = s.product_id
WHERE s.type = 'out' AND s.qty_after <= 3 AND s.id % 5 <> 0
UNION ALL
SELECT r, 'info', 'Pesan Baru dari Website', 'Pesan dari ' || name || ': "' || coalesce(subject, 'Tanpa Subjek') || '"', '/admin/panel.html#contacts',
  'contact', id, created_at FROM contacts_t, (VALUES ('admin_website'), ('superadmin')) v(r)
UNION ALL
SELECT 'admin_website', 'info', 'Produk Baru dari Gudang', 'Produk "' || name || '" siap untuk diproses di CMS Website.',
  '/admin/panel.html#products-new', 'product', id, created_at FROM products_t""", _TRANSITIONS)

# --- site ---------------------------------------------------------------------------------------
_IS_PUBLIC = f"key IN ({names(PUBLIC)})"
add("settings_public", f"SELECT key, value FROM settings_t WHERE {_IS_PUBLIC}")
add("settings_public_group", f"SELECT key, value, type FROM settings_t WHERE {_IS_PUBLIC} AND group_name = 'hero'")
add("settings_groups", """
SELECT group_name, row_number() OVER (PARTITION BY group_name ORDER BY id) AS position, key, value, type FROM settings_t""")
add("settings_typed", """
SELECT key, type, group_name, value AS text_value, CASE WHEN type = 'number' THEN try_cast(value AS DOUBLE) END AS number_value,
  CASE WHEN type = 'boolean' THEN value IN ('1', 'true') END AS boolean_value
FROM (SELECT key, group_name, CASE id % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' ELSE 'text' END AS type,
  CASE id % 3 WHEN 0 THEN id::VARCHAR || '.5' WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'true' ELSE '0' END ELSE value END AS value FROM settings_t)""")
add("settings_latest", """
SELECT key, arg_max(value, struct_pack(a := created_at, b := id)) AS value, max(created_at) AS updated_at, count(*) AS write_count
FROM setting_feed_t GROUP BY 1""")
add("settings_bulk_upsert", "SELECT key, 'new ' || value AS value FROM settings_t")
add("settings_single_upsert", """
SELECT key, value, type, group_name FROM settings_t
UNION ALL SELECT 'own_' || key, value, 'text', 'general' FROM settings_t""")
add("contacts_unread", "SELECT id, name, subject, created_at FROM contacts_t WHERE NOT is_read ORDER BY created_at DESC, id DESC LIMIT 20")
add("recent_contacts", "SELECT id, name, subject, created_at, is_read FROM contacts_t ORDER BY created_at DESC, id DESC LIMIT 5")
add("testimonials_shown", """
SELECT id, name, rating, 'R' AS initial, repeat('★', rating) || repeat('☆', 5 - rating) AS stars, content, sort_order
FROM testimonials_t WHERE is_active""")
add("service_list", "SELECT id, name, slug, sort_order FROM services_t WHERE is_active")
add("service_documents", """
SELECT s.id, 1::BIGINT AS part_no, coalesce(string_agg(g.filename, ',' ORDER BY g.sort_order, g.id), '') AS files
FROM services_t s LEFT JOIN service_gallery_t g ON g.service_id = s.id WHERE s.is_active GROUP BY 1""")
add("service_info", """
SELECT id, 1::BIGINT AS position, 'Lead time' AS label, ' ' || (id % 8) || ' weeks' AS text FROM services_t
UNION ALL SELECT page_id, 2, 'Site', ' http://' || split_part(url, '/', 3) FROM pages
UNION ALL SELECT id, 3, NULL, 'Free advice' FROM services_t""")
add("related_services", """
SELECT a.id, a.slug, row_number() OVER (PARTITION BY a.id ORDER BY b.sort_order, b.id) AS position, b.id AS related_id, b.slug AS related_slug
FROM services_t a JOIN services_t b ON a.id <> b.id WHERE a.is_active AND b.is_active
QUALIFY position <= 3""")

# --- shoppers -----------------------------------------------------------------------------------
add("view_counts", """
SELECT v.product_id, count(*) AS view_count FROM product_views_t v JOIN products_t p ON p.id = v.product_id
WHERE p.publish_status = 'published' AND p.is_active GROUP BY 1""")
add("recently_viewed", """
SELECT user_id, product_id, viewed_at, position FROM (SELECT user_id, product_id, max(created_at) AS viewed_at,
  row_number() OVER (PARTITION BY user_id ORDER BY max(created_at) DESC, max(id) DESC) AS position FROM product_views_t GROUP BY 1, 2)
WHERE position <= 10""")
add("favourites", "SELECT user_id, product_id, count(*) AS toggle_count FROM favourite_toggles_t GROUP BY 1, 2 HAVING count(*) % 2 = 1")

# --- integrity ----------------------------------------------------------------------------------
add("duplicate_names", "SELECT name, count(*) AS row_count FROM products_t GROUP BY 1 HAVING count(*) > 1")
add("cascade_delete", """
SELECT 'products' AS table_name, count(*) AS row_count, count(*) AS linked_count FROM products_t WHERE id % 9 <> 0
UNION ALL SELECT 'product_images', count(*), count(*) FROM product_images_t WHERE product_id % 9 <> 0
UNION ALL SELECT 'product_tags', count(*), count(*) FROM product_tags_t WHERE product_id % 9 <> 0
UNION ALL SELECT 'order_items', count(*), count(*) FILTER (product_id % 9 <> 0) FROM order_items_t
UNION ALL SELECT 'stock_transactions', count(*), count(*) FROM stock_transactions_t WHERE product_id % 9 <> 0""")
add("nullify_refs", """
SELECT p.id, CASE WHEN c.sort_order > 6 THEN NULL ELSE p.category_id END AS category_id
FROM products_t p LEFT JOIN categories_t c ON c.id = p.category_id""")
add("migrate_v1", f"""
SELECT id, CASE WHEN is_active THEN 'published' ELSE 'hidden' END AS publish_status, CASE WHEN is_active THEN {NOW} END AS published_at
FROM products_t""")
add("migrate_v1_users", """
SELECT id, CASE WHEN id = 3 THEN 'admin' ELSE username END AS username,
  CASE WHEN id = 3 THEN 'superadmin' WHEN id % 2 = 0 THEN 'admin_website' ELSE role END AS role FROM users_t""")
add("order_reconciliation", """
SELECT o.id, o.order_number, o.subtotal, coalesce(i.s, 0)::DECIMAL(25,2) AS item_sum, (o.subtotal - coalesce(i.s, 0))::DECIMAL(26,2) AS difference
FROM orders_t o LEFT JOIN (SELECT order_id, sum(subtotal) AS s FROM order_items_t GROUP BY 1) i ON i.order_id = o.id
WHERE o.subtotal <> coalesce(i.s, 0)""")
add("stock_reconciliation", """
SELECT p.id, p.sku, p.warehouse_stock, l.qty_after AS ledger_qty FROM products_t p JOIN (SELECT * FROM stock_transactions_t
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC, supplier_key DESC, qty DESC, type DESC) = 1) l
  ON l.product_id = p.id WHERE p.warehouse_stock <> l.qty_after""")
add("ledger_reconciliation", f"""
SELECT product_id, created_at, id, qty_before, previous_after FROM (SELECT *,
  lag(qty_after) OVER (PARTITION BY product_id ORDER BY {MOVE_ORDER}) AS previous_after FROM stock_transactions_t)
WHERE previous_after <> qty_before""")
add("price_reconciliation", """
SELECT id, product_id, total_price, (qty * unit_price)::DECIMAL(25,2) AS computed_total FROM stock_transactions_t
WHERE (qty * unit_price) <> total_price""")
add("deleted_order_stock", """
SELECT order_id, product_id, sum(qty)::BIGINT AS held_qty FROM stock_transactions_t WHERE order_id IS NOT NULL AND order_id % 10 = 0 GROUP BY 1, 2""")

# --- column functions ---------------------------------------------------------------------------
add("order_labels", f"""
SELECT id, {status_label('status')} AS status_label, {rp('total')} AS total_label, {date_label('created_at')} AS date_label,
  strftime(created_at, '%d/%m') AS day_label, {date_label('created_at')} || strftime(created_at, ', %H.%M') AS time_label,
  id AS number, CASE WHEN length(customer_email) > 15 THEN substr(customer_email, 1, 15) || '...' ELSE customer_email END AS short_email,
  CASE WHEN total > amount_paid THEN (total - amount_paid)::DECIMAL(15,2) END AS outstanding FROM orders_t""")
add("lenient_parsing", """
SELECT p_partkey AS id, p_size::BIGINT AS size, 0::BIGINT AS zero, p_retailprice::DECIMAL(15,2) AS price, 0::DECIMAL(15,2) AS no_price,
  p_size % 2 = 1 AS odd, lower(replace(p_brand, '#', '')) || '-' || replace(p_name, ' ', '-') AS slug, lower(p_brand) AS login FROM part""")

# --- streams ------------------------------------------------------------------------------------
add("stream_orders_daily", "SELECT created_at::DATE AS day, count(*) AS order_count FROM orders_t GROUP BY 1")
add("stream_stock_flow", """
SELECT created_at::DATE AS day, coalesce(sum(qty) FILTER (type = 'in'), 0)::BIGINT AS stock_in,
  coalesce(sum(qty) FILTER (type = 'out'), 0)::BIGINT AS stock_out FROM stock_transactions_t GROUP BY 1""")
ORACLE["stream_rate_audit"] = ORACLE["rate_audit_15m"]
add("stream_view_counts", """
SELECT v.product_id, count(*) AS view_count FROM product_views_t v JOIN products_t p ON p.id = v.product_id
WHERE p.publish_status = 'published' AND p.is_active GROUP BY 1""")
add("stream_audit_ingest", "SELECT id, role, action, created_at FROM activity_logs_t")
add("stream_order_notes", f"""
SELECT r AS target_role, 'Order ' || order_number || ' dari ' || customer_name || ' senilai ' || {rp('total')} AS message, id AS source_id
FROM orders_t, (VALUES ('marketing'), ('superadmin')) v(r)""")
add("stream_stock_alerts", """
SELECT 'admin_gudang' AS target_role, 'Stok produk "' || p.name || '" tersisa ' || s.qty_after || ' unit. Harap segera re-stock.' AS message,
  s.id AS source_id, s.created_at FROM stock_transactions_t s JOIN products_t p ON p.id = s.product_id
WHERE s.type = 'out' AND s.qty_after <= 3 AND s.id % 5 <> 0""")
# Sessions whose one-minute slot ended before the last login that opened a session.
add("stream_expired_sessions", """
SELECT id, user_id, expires_at AS expired_at FROM sessions_t WHERE is_active
  AND time_bucket(INTERVAL 1 MINUTE, expires_at) + INTERVAL 1 MINUTE
    <= (SELECT date_trunc('millisecond', max(created_at)) FROM sessions_t WHERE is_active)""")
ORACLE["stream_ledger"] = ORACLE["ledger_posted"]
ORACLE["stream_paid_spend"] = ORACLE["paid_spend"]
ORACLE["stream_rejects"] = ORACLE["ledger_rejects"]
add("stream_posted_alerts", """
SELECT 'admin_gudang' AS target_role, 'Stok produk "' || p.name || '" tersisa ' || qa || ' unit. Harap segera re-stock.' AS message,
  m.id AS source_id, m.created_at FROM moves m JOIN steps USING (product_id, n) JOIN products_t p ON p.id = m.product_id
WHERE ok AND m.type = 'out' AND qa <= 3 AND m.id % 5 <> 0""", _STEPS)

add("stream_payment_notes", """
SELECT r AS target_role, 'success' AS type, 'Pembayaran untuk order ' || o.order_number || ' telah LUNAS.' AS message, t.id AS source_id, t.created_at
FROM trans t JOIN orders_t o ON o.id = t.order_id, (VALUES ('marketing'), ('superadmin')) v(r)
WHERE t.new_payment = 'paid' AND t.old_payment <> 'paid'""", _TRANSITIONS)
add("stream_top_viewed", """
SELECT p.id, p.name, p.slug, v.view_count, CASE WHEN length(p.name) > 18 THEN substr(p.name, 1, 18) || '...' ELSE p.name END AS label
FROM (SELECT product_id, count(*) AS view_count FROM product_views_t GROUP BY 1) v JOIN products_t p ON p.id = v.product_id
WHERE p.is_active ORDER BY v.view_count DESC, p.id LIMIT 5""")

# --- further audits, streams and sinks --------------------------------------------------------------
add("failed_logins", """
SELECT ip_address, window_start, count(*) AS request_count FROM (SELECT '10.0.0.' || (user_id % 2) AS ip_address,
  time_bucket(INTERVAL '15 minutes', ts) AS window_start FROM events WHERE event_id % 3 <> 0) GROUP BY 1, 2 HAVING count(*) > 2""")
ORACLE["stream_failed_logins"] = ORACLE["failed_logins"]
add("stream_contact_notes", """
SELECT r AS target_role, 'Pesan dari ' || name || ': "' || coalesce(subject, 'Tanpa Subjek') || '"' AS message, id AS source_id
FROM contacts_t, (VALUES ('admin_website'), ('superadmin')) v(r)""")
add("stream_product_notes", """
SELECT 'admin_website' AS target_role, 'Produk "' || name || '" siap untuk diproses di CMS Website.' AS message, id AS source_id FROM products_t""")
add("contacts_marked", "SELECT id, is_read OR id % 3 = 0 AS is_read FROM contacts_t")
add("unique_key_clashes", """
SELECT 'orders' AS table_name, 'order_number' AS key_columns, count(*) AS clash_count FROM (SELECT order_number FROM orders_t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'products', 'slug', count(*) FROM (SELECT slug FROM products_t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'products', 'sku', count(*) FROM (SELECT sku FROM products_t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'customers', 'code', count(*) FROM (SELECT code FROM customers_t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'suppliers', 'code', count(*) FROM (SELECT code FROM suppliers_t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'settings', 'key', count(*) FROM (SELECT key FROM settings_t GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'product_tags', 'product_id,tag', count(*) FROM (SELECT product_id, tag FROM product_tags_t GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'order_items', 'id', count(*) FROM (SELECT id FROM order_items_t GROUP BY 1 HAVING count(*) > 1)""")
_FAULTS = {"products": [("name_missing", 11), ("publish_status_invalid", 7)],
           "orders": [("order_number_missing", 17), ("status_invalid", 9), ("payment_status_invalid", 13)],
           "stock_transactions": [("type_invalid", 19), ("reference_type_invalid", 23)],
           "admin_users": [("email_missing", 5), ("role_invalid", 3)], "settings": [("type_invalid", 2)]}
add("table_faults", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, id, concat_ws(',', {', '.join(f"CASE WHEN id % {n} = 0 THEN '{reason}' END" for reason, n in faults)}) AS reasons "
    f"FROM {'users' if name == 'admin_users' else name}_t WHERE {' OR '.join(f'id % {n} = 0' for _, n in faults)}" for name, faults in _FAULTS.items()))
add("order_change_faults", """
SELECT id, CASE WHEN id % 10 = 0 THEN 'status_invalid' WHEN id % 10 = 1 THEN 'payment_invalid' ELSE 'nothing_to_change' END AS reasons
FROM order_changes_t WHERE id % 10 < 3""")
add("orders_saved", "SELECT id, order_number, status, total, created_at FROM orders_t")
add("order_documents_saved", """
SELECT o.id, f.full_name AS confirmed_by_name, count(i.id) AS line_count, coalesce(sum(i.qty), 0)::BIGINT AS qty, count(p.id) AS known_products
FROM orders_t o LEFT JOIN users_t f ON f.id = o.confirmed_by LEFT JOIN order_items_t i ON i.order_id = o.id
LEFT JOIN products_t p ON p.id = i.product_id GROUP BY 1, 2""")
add("invoice_document_lines", f"""
SELECT o.id, o.order_number, coalesce(nullif(c.address, ''), o.customer_addr) AS customer_addr,
  coalesce(nullif(c.phone, ''), o.customer_phone) AS customer_phone,
  CASE WHEN o.total - o.amount_paid > 0 THEN (o.total - o.amount_paid)::DECIMAL(15,2) END AS outstanding,
  i.line_no, i.product_name, i.product_sku, i.qty::BIGINT AS qty, i.unit_price, i.subtotal AS line_total,
  (SELECT string_agg(key || '=' || value[1:6], ';' ORDER BY key || '=' || value[1:6]) FROM settings_t WHERE key IN ({names(INVOICE_SETTINGS)})) AS company
FROM orders_t o LEFT JOIN customers_t c ON c.id = o.customer_id LEFT JOIN {_NUMBERED} i ON i.order_id = o.id""")
add("stock_export", f"""
SELECT row_number() OVER (ORDER BY list_position([{names(PUBLISH_STATUSES)}], publish_status) DESC, name, id) AS row_no, id, sku, publish_status,
  category_name, stock_value FROM ({_REPORT})""")
ORACLE["stock_export_header"] = ORACLE["inventory_value"]
add("transactions_export", f"""
SELECT row_number() OVER (ORDER BY {', '.join(c.strip() + ' DESC' for c in MOVE_ORDER.split(','))}) AS row_no, st.id, st.product_id, st.created_at,
  st.qty::BIGINT AS qty, {status_label('st.type')} AS type_label, s.name AS supplier_name
FROM stock_transactions_t st LEFT JOIN (SELECT id AS sid, name FROM suppliers_t) s ON s.sid = st.supplier_id
WHERE created_at::DATE BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")

# --- saved tables -----------------------------------------------------------------------------------
add("order_last_page", """
SELECT id, order_number, created_at, total FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM orders_t)
WHERE n > (SELECT (count(*) - 1) // 50 * 50 FROM orders_t)""")
add("catalog_deep_page", _CATALOG + _CATALOG_ORDER + " LIMIT 7 OFFSET 14")
ORACLE["user_patches_saved"] = ORACLE["user_patches"]
ORACLE["tag_replacement_saved"] = ORACLE["tag_replacement"]
ORACLE["catalog_search_indexed"] = ORACLE["catalog_search"]
add("customer_search_indexed", """
SELECT id, name, code FROM customers_t
WHERE name ILIKE '%s15%' OR code ILIKE '%s15%' OR phone ILIKE '%s15%' OR email ILIKE '%s15%'""")
