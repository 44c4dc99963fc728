"""Typed schemas of the operational tables. Table and column names are fixed values: they must match the shop's tables."""

from __future__ import annotations

from pyspark.sql import types as T

from stockroom import fixed_values as V

MONEY = T.DecimalType(15, 2)

_TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "byte": T.ByteType(), "bool": T.BooleanType(),
    "text": T.StringType(), "money": MONEY, "date": T.DateType(), "time": T.TimestampNTZType(),
}


def _table(spec: str) -> T.StructType:
    """`name:type` pairs, one table."""
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "admin_users": _table(
        "id:long username:text email:text password:text full_name:text phone:text role:text is_active:bool "
        "avatar:text last_login:time created_by:long created_at:time updated_at:time"),
    "login_sessions": _table(
        "id:long user_id:long token_hash:text ip_address:text user_agent:text is_active:bool "
        "expires_at:time created_at:time"),
    "activity_logs": _table(
        "id:long user_id:long username:text role:text action:text module:text description:text "
        "record_id:long record_type:text ip_address:text created_at:time"),
    "settings": _table("id:long key:text value:text type:text label:text group_name:text updated_at:time"),
    "categories": _table(
        "id:long name:text slug:text icon:text image:text color_from:text color_to:text description:text "
        "sort_order:int is_active:bool created_at:time updated_at:time"),
    "products": _table(
        "id:long category_id:long name:text slug:text sku:text short_desc:text description:text "
        "specification:text material:text dimensions:text price_label:text thumbnail:text meta_title:text "
        "meta_desc:text warehouse_stock:int unit:text cost_price:money sell_price:money publish_status:text "
        "is_featured:bool is_active:bool sort_order:int view_count:int created_by:long published_by:long "
        "published_at:time created_at:time updated_at:time"),
    "product_images": _table(
        "id:long product_id:long filename:text alt_text:text is_primary:bool sort_order:int created_at:time"),
    "product_tags": _table("id:long product_id:long tag:text"),
    "services": _table(
        "id:long name:text slug:text icon:text short_desc:text description:text info:text image:text "
        "color_from:text color_to:text is_active:bool sort_order:int created_at:time updated_at:time"),
    "service_gallery": _table("id:long service_id:long filename:text alt_text:text sort_order:int"),
    "testimonials": _table(
        "id:long name:text role:text avatar:text initial:text rating:byte content:text product_ref:text "
        "is_active:bool sort_order:int created_at:time updated_at:time"),
    "contacts": _table(
        "id:long name:text email:text phone:text subject:text message:text product_ref:text is_read:bool "
        "created_at:time"),
    "banners": _table(
        "id:long title:text subtitle:text image:text link_url:text link_text:text position:text "
        "is_active:bool sort_order:int start_date:date end_date:date created_at:time updated_at:time"),
    "suppliers": _table(
        "id:long code:text name:text contact_name:text phone:text email:text address:text city:text "
        "province:text notes:text is_active:bool created_by:long created_at:time updated_at:time"),
    "customers": _table(
        "id:long code:text name:text phone:text email:text address:text city:text province:text notes:text "
        "total_orders:int total_spend:money is_active:bool created_by:long created_at:time updated_at:time"),
    "orders": _table(
        "id:long order_number:text customer_id:long customer_name:text customer_phone:text "
        "customer_email:text customer_addr:text status:text payment_status:text payment_method:text "
        "subtotal:money discount:money shipping_cost:money total:money amount_paid:money notes:text "
        "delivery_date:date shipping_addr:text created_by:long confirmed_by:long created_at:time "
        "updated_at:time"),
    "order_items": _table(
        "id:long order_id:long product_id:long product_name:text product_sku:text qty:int unit:text "
        "unit_price:money subtotal:money notes:text"),
    "stock_transactions": _table(
        "id:long product_id:long type:text qty:int qty_before:int qty_after:int reference_type:text "
        "reference_id:long reference_no:text supplier_id:long order_id:long unit_price:money "
        "total_price:money notes:text created_by:long created_at:time"),
    "notifications": _table(
        "id:long target_role:text target_user:long type:text title:text message:text link:text is_read:bool "
        "created_by:long created_at:time"),
}

# child table -> [(foreign key, parent table, "cascade" | "null")]
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "login_sessions": [("user_id", "admin_users", "cascade")],
    "products": [("category_id", "categories", "null"), ("created_by", "admin_users", "null"),
                 ("published_by", "admin_users", "null")],
    "product_images": [("product_id", "products", "cascade")],
    "product_tags": [("product_id", "products", "cascade")],
    "service_gallery": [("service_id", "services", "cascade")],
    "suppliers": [("created_by", "admin_users", "null")],
    "customers": [("created_by", "admin_users", "null")],
    "orders": [("customer_id", "customers", "null"), ("created_by", "admin_users", "null"),
               ("confirmed_by", "admin_users", "null")],
    "order_items": [("order_id", "orders", "cascade"), ("product_id", "products", "null")],
    "stock_transactions": [("product_id", "products", "cascade"), ("supplier_id", "suppliers", "null"),
                           ("order_id", "orders", "null"), ("created_by", "admin_users", "null")],
    "notifications": [("target_user", "admin_users", "cascade"), ("created_by", "admin_users", "null")],
}

# table -> unique keys
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "admin_users": [["username"], ["email"]],
    "settings": [["key"]],
    "categories": [["slug"]],
    "products": [["slug"], ["sku"]],
    "product_tags": [["product_id", "tag"]],
    "services": [["slug"]],
    "suppliers": [["code"]],
    "customers": [["code"]],
    "orders": [["order_number"]],
}

# table -> columns that must have a value
REQUIRED: dict[str, list[str]] = {
    "admin_users": ["username", "email", "password"],
    "login_sessions": ["user_id", "token_hash"],
    "activity_logs": ["action"],
    "settings": ["key"],
    "categories": ["name", "slug"],
    "products": ["name", "slug"],
    "product_images": ["product_id", "filename"],
    "product_tags": ["product_id", "tag"],
    "services": ["name", "slug"],
    "service_gallery": ["service_id", "filename"],
    "testimonials": ["name", "content"],
    "contacts": ["name", "message"],
    "suppliers": ["name"],
    "customers": ["name"],
    "orders": ["order_number"],
    "order_items": ["order_id", "product_name"],
    "stock_transactions": ["product_id", "qty"],
    "notifications": ["title"],
}

# table -> column -> values it may have, besides none
ALLOWED: dict[str, dict[str, list[str]]] = {
    "admin_users": {"role": V.ROLES},
    "settings": {"type": V.SETTING_TYPES},
    "products": {"publish_status": V.PUBLISH_STATUSES},
    "orders": {"status": V.ORDER_STATUSES, "payment_status": V.PAYMENT_STATUSES},
    "stock_transactions": {"type": V.STOCK_TYPES, "reference_type": V.REFERENCE_TYPES},
}
