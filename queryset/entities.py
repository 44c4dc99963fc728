"""The business tables as SQL over the Parquet views, written independently of the Spark adapters."""

from __future__ import annotations

import re

from stockroom.fixed_values import PUBLIC_SETTINGS as PUBLIC
from stockroom.sources.testdata import PRIVATE_SETTINGS as PRIVATE


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


KEY_LIST = f"[{names(PUBLIC + PRIVATE)}]"

ENTITIES = {
    "products_t": """
        SELECT p_partkey AS id,
          CASE WHEN p_partkey % 41 <> 0 THEN ('0x' || substr(md5(p_type), 1, 8))::BIGINT END AS category_id,
          p_name AS name, replace(p_name, ' ', '-') || '-' || p_partkey AS slug, 'SKU-' || p_partkey AS sku,
          p_brand || ' ' || p_type AS short_desc, p_brand AS material,
          ['', 'Hubungi Kami', 'Mulai Rp 0', 'Mulai Rp 5.000'][p_partkey % 4 + 1] AS price_label,
          CASE WHEN p_partkey % 3 <> 0 THEN 'thumb-' || p_partkey || '.jpg' END AS thumbnail,
          (p_size % 12)::INTEGER AS warehouse_stock, ['unit', 'set'][p_size % 2 + 1] AS unit,
          (p_retailprice::DECIMAL(15,2) * 0.60)::DECIMAL(15,2) AS cost_price,
          p_retailprice::DECIMAL(15,2) AS sell_price,
          ['published', 'new', 'draft', 'review', 'ready', 'hidden', 'out_of_stock', 'archived'][p_partkey % 8 + 1]
            AS publish_status,
          p_partkey % 5 = 0 AS is_featured, p_partkey % 8 = 0 AS is_active, (p_size % 7)::INTEGER AS sort_order,
          ((p_size * p_partkey) % 1000)::INTEGER AS view_count, p_partkey % 12 AS created_by,
          CASE WHEN p_partkey % 8 = 0 THEN p_partkey % 9 END AS published_by,
          TIMESTAMP '2020-01-01' + to_hours(p_partkey::BIGINT) AS created_at
        FROM part""",
    "categories_t": """
        SELECT ('0x' || substr(md5(name), 1, 8))::BIGINT AS id, name, lower(name) AS slug, name[1] AS icon,
          '#111111' AS color_from, '#eeeeee' AS color_to, length(name)::INTEGER AS sort_order, name <> 'SMALL' AS is_active
        FROM (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT 'CLEARANCE')""",
    "product_tags_t": "SELECT DISTINCT p_partkey AS product_id, unnest(string_split(p_name, ' ')) AS tag FROM part",
    "product_images_t": """
        SELECT event_id AS id, event_id % (SELECT count(*) FROM part) AS product_id, 'img-' || event_id || '.jpg' AS filename,
          event_id % 7 = 0 AS is_primary, (event_id % 5)::INTEGER AS sort_order FROM events WHERE event_type = 'click'""",
    "users_t": """
        SELECT s_suppkey AS id, 'user' || s_suppkey AS username, 'user' || s_suppkey || '@example.com' AS email,
          s_name AS full_name, '08' || s_suppkey AS phone,
          ['superadmin', 'admin_gudang', 'admin_website', 'marketing'][s_suppkey % 4 + 1] AS role, s_acctbal > 0 AS is_active,
          CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_hours((s_suppkey * 7)::BIGINT) END AS last_login,
          TIMESTAMP '2023-01-01' + to_hours(s_suppkey::BIGINT) AS created_at FROM supplier""",
    "suppliers_t": """
        SELECT s_suppkey AS id, 'SUP' || s_suppkey AS code, s_name AS name, 'Contact ' || s_suppkey AS contact_name,
          '08' || s_suppkey AS phone, 'City ' || s_nationkey AS city, s_acctbal > 0 AS is_active FROM supplier""",
    "customers_t": """
        SELECT c_custkey AS id, 'CUS' || c_custkey AS code, c_name AS name,
          CASE WHEN c_custkey % 7 <> 0 THEN '08' || c_custkey END AS phone,
          CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'c' || c_custkey || '@example.com' END AS email,
          CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Street ' || c_custkey END AS address,
          c_mktsegment AS city, c_acctbal > 0 AS is_active FROM customer""",
    "orders_t": """
        SELECT *, CASE WHEN status IN ('confirmed', 'processing', 'ready', 'delivered') THEN id % 10 END AS confirmed_by
        FROM (SELECT o_orderkey AS id,
          'ORD-' || year(o_orderdate) || '-' || lpad(o_orderkey::VARCHAR, greatest(4, length(o_orderkey::VARCHAR))::INTEGER, '0')
            AS order_number,
          CASE WHEN o_orderkey % 53 <> 0 THEN o_custkey END AS customer_id, 'Buyer ' || o_custkey AS customer_name,
          '07' || o_custkey AS customer_phone, 'b' || o_custkey || '@example.org' AS customer_email,
          'Road ' || o_custkey AS customer_addr,
          CASE o_orderstatus WHEN 'O' THEN ['pending', 'confirmed'][o_orderkey % 2 + 1]
            WHEN 'P' THEN ['processing', 'ready'][o_orderkey % 2 + 1]
            ELSE ['cancelled', 'refunded', 'delivered', 'delivered'][o_orderkey % 4 + 1] END AS status,
          ['unpaid', 'partial', 'paid', 'refunded'][o_orderkey % 4 + 1] AS payment_status,
          (o_totalprice::DECIMAL(15,2) - (o_orderkey % 4 * 50) + (o_orderkey % 3 * 100))::DECIMAL(15,2) AS subtotal,
          (o_orderkey % 3 * 100)::DECIMAL(15,2) AS discount, (o_orderkey % 4 * 50)::DECIMAL(15,2) AS shipping_cost,
          o_totalprice::DECIMAL(15,2) AS total,
          CASE o_orderkey % 4 WHEN 2 THEN o_totalprice::DECIMAL(15,2) WHEN 1 THEN 100::DECIMAL(15,2) ELSE 0 END::DECIMAL(15,2)
            AS amount_paid,
          o_orderkey % 12 AS created_by, o_orderdate::DATE + 7 AS delivery_date, o_orderdate AS created_at FROM orders)""",
    "order_items_t": """
        SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS order_id,
          CASE WHEN NOT (l_linenumber = 7 AND l_suppkey % 2 = 0) THEN l_partkey END AS product_id,
          'Part ' || l_partkey AS product_name, 'SKU-' || l_partkey AS product_sku, l_quantity::INTEGER AS qty, 'unit' AS unit,
          ((90000 + l_partkey % 1000 * 10)::DECIMAL(12,0) * 0.01)::DECIMAL(15,2) AS unit_price,
          l_extendedprice::DECIMAL(15,2) AS subtotal, l_suppkey AS supplier_key FROM lineitem""",
    "stock_transactions_t": """
        SELECT id, product_id, type, qty,
          (CASE WHEN type = 'out' THEN qty + line ELSE line END)::INTEGER AS qty_before,
          (CASE type WHEN 'in' THEN qty + line WHEN 'out' THEN line ELSE qty END)::INTEGER AS qty_after,
          CASE type WHEN 'in' THEN 'purchase' WHEN 'out' THEN 'sale' ELSE 'adjustment' END AS reference_type,
          'ORD-' || okey AS reference_no, CASE WHEN type = 'in' THEN supplier_key END AS supplier_id,
          CASE WHEN type = 'out' THEN okey END AS order_id, unit_price, total_price, okey % 12 AS created_by, created_at,
          supplier_key
        FROM (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS product_id,
          CASE WHEN l_returnflag = 'R' THEN 'in' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'adjustment'
            ELSE 'out' END AS type,
          l_quantity::INTEGER AS qty, l_linenumber AS line, l_orderkey AS okey,
          ((90000 + l_partkey % 1000 * 10)::DECIMAL(12,0) * 0.01)::DECIMAL(15,2) AS unit_price,
          l_extendedprice::DECIMAL(15,2) AS total_price, l_shipdate AS created_at, l_suppkey AS supplier_key FROM lineitem)""",
    "order_changes_t": """
        SELECT o_orderkey * 4 + step AS id, o_orderkey AS order_id,
          CASE step WHEN 1 THEN ['confirmed', 'confirmed', 'processing', 'ready', 'cancelled'][o_orderkey % 5 + 1]
            WHEN 2 THEN ['processing', 'cancelled', 'ready', 'pending', 'confirmed', 'delivered'][o_orderkey % 6 + 1]
            ELSE ['delivered', 'confirmed', 'refunded', 'delivered'][o_orderkey % 4 + 1] END AS status,
          CASE step WHEN 1 THEN ['paid', 'partial', NULL][o_orderkey % 3 + 1] WHEN 2 THEN [NULL, 'paid'][o_orderkey % 2 + 1]
            ELSE ['paid', 'refunded', 'unpaid', NULL, 'paid'][o_orderkey % 5 + 1] END AS payment_status,
          o_orderkey % 12 AS changed_by, o_orderdate + to_days((step * step)::INTEGER) AS created_at
        FROM orders, (VALUES (1), (2), (3)) s(step)""",
    "activity_logs_t": """
        SELECT event_id AS id, user_id, 'user' || user_id AS username,
          ['superadmin', 'admin_gudang', 'admin_website', 'marketing'][user_id % 4 + 1] AS role,
          CASE event_type WHEN 'click' THEN 'UPDATE_CMS' WHEN 'error' THEN 'STOCK_OUT' WHEN 'purchase' THEN 'CREATE_ORDER'
            WHEN 'signup' THEN 'CREATE_USER' WHEN 'view' THEN 'CREATE' END AS action,
          CASE event_type WHEN 'click' THEN 'Products' WHEN 'error' THEN 'Stock' WHEN 'purchase' THEN 'Orders'
            WHEN 'signup' THEN 'Users' WHEN 'view' THEN 'Products' END AS module,
          props AS description, event_id AS record_id, '10.0.0.' || (user_id % 256) AS ip_address, ts AS created_at FROM events""",
    "product_views_t": """
        SELECT event_id AS id, user_id, event_id % (SELECT count(*) FROM part) AS product_id, ts AS created_at
        FROM events WHERE event_type = 'view'""",
    "favourite_toggles_t": """
        SELECT event_id AS id, user_id, event_id % 16 AS product_id, ts AS created_at
        FROM events WHERE event_type IN ('click', 'purchase')""",
    "sessions_t": """
        SELECT event_id AS id, user_id % 12 AS user_id, '10.0.0.' || (user_id % 256) AS ip_address,
          event_id % 3 <> 0 AS is_active, ts + INTERVAL 8 HOUR AS expires_at, ts AS created_at
        FROM events WHERE event_type = 'signup'""",
    "user_events_t": """
        SELECT event_id AS id, user_id % 12 AS user_id, ['toggle', 'reset', 'toggle', 'logout', 'login'][event_id % 5 + 1] AS action,
          ts AS created_at FROM events WHERE event_type = 'error'""",
    "notifications_t": """
        SELECT event_id AS id,
          CASE WHEN event_id % 6 <= 3 THEN ['superadmin', 'admin_gudang', 'admin_website', 'marketing'][event_id % 6 + 1] END
            AS target_role,
          CASE WHEN event_id % 6 IN (3, 4) THEN event_id % 10 END AS target_user,
          ['info', 'warning', 'success'][event_id % 3 + 1] AS type, 'Note ' || event_id AS title, event_id % 2 = 0 AS is_read,
          ts AS created_at FROM events WHERE event_type = 'purchase'""",
    "contacts_t": """
        SELECT conv_id * 1000 + turn AS id, 'Visitor ' || conv_id AS name,
          CASE WHEN conv_id % 4 <> 0 THEN 'Topic ' || conv_id END AS subject, text AS message, conv_id % 2 = 1 AS is_read,
          TIMESTAMP '2024-01-01' + to_hours((conv_id * 2 + turn)::BIGINT) AS created_at FROM conversations WHERE role = 'user'""",
    "testimonials_t": """
        SELECT l.doc_id AS id, 'reviewer ' || l.doc_id AS name, d.source AS role, (3 + 2 * l.quality)::INTEGER AS rating,
          d.text AS content, l.toxic = 0 AS is_active, (l.doc_id % 5)::INTEGER AS sort_order
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "setting_feed_t": f"SELECT event_id AS id, {KEY_LIST}[event_id % 36 + 1] AS key, props AS value, ts AS created_at FROM events",
    "settings_t": f"""
        SELECT id, key, value, CASE WHEN starts_with(key, 'stat') THEN 'number' ELSE 'text' END AS type,
          split_part(key, '_', 1) AS group_name
        FROM (SELECT {KEY_LIST}[event_id % 36 + 1] AS key, props AS value, min(event_id) OVER (PARTITION BY event_id % 36) AS id,
          row_number() OVER (PARTITION BY event_id % 36 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "services_t": """
        SELECT page_id AS id, 'Service ' || page_id AS name, 'service-' || page_id AS slug,
          'Lead time: ' || (page_id % 8) || ' weeks| Site: http://' || split_part(url, '/', 3) || ' ||Free advice' AS info,
          (page_id % 5)::INTEGER AS sort_order, page_id % 6 <> 0 AS is_active FROM pages""",
    "service_gallery_t": """
        SELECT doc_id AS id, doc_id % (SELECT count(*) FROM pages) AS service_id, 'gal-' || doc_id || '.jpg' AS filename,
          (doc_id % 4)::INTEGER AS sort_order FROM documents""",
}


def with_entities(sql: str, *recursive: str) -> str:
    """Put the entity definitions a query names (`..._t`) in front of it. `recursive` CTEs follow them."""
    text = sql + " ".join(recursive)
    used = [name for name in ENTITIES if re.search(rf"\b{name}\b", text)]
    parts = [f"{name} AS ({ENTITIES[name].strip()})" for name in used] + list(recursive)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + sql.strip()
