"""Fixed values.

Everything in this file must equal the business system's own constants for the results to be right:
status lists, role names, label texts, message formats, limits and the access matrix. They are stated
as plain text and nothing here is logic.
"""

# --- status, role and type lists ---------------------------------------------------------------
ORDER_STATUSES = ["pending", "confirmed", "processing", "ready", "delivered", "cancelled", "refunded"]
PAYMENT_STATUSES = ["unpaid", "partial", "paid", "refunded"]
PUBLISH_STATUSES = ["new", "draft", "review", "ready", "published", "hidden", "out_of_stock", "archived"]
ROLES = ["superadmin", "admin_gudang", "admin_website", "marketing"]
STOCK_TYPES = ["in", "out", "adjustment", "return"]
REFERENCE_TYPES = ["purchase", "sale", "return", "adjustment", "other"]
SETTING_TYPES = ["text", "textarea", "image", "json", "boolean", "number"]

# Order states in which the order's goods have left the free stock.
DEDUCTED_STATUSES = ["confirmed", "processing", "ready", "delivered"]
# Order states that may no longer be edited.
CLOSED_STATUSES = ["delivered", "cancelled", "refunded"]
# "Open" orders on the warehouse dashboard; the executive one counts only 'pending'.
OPEN_ORDER_STATUSES = ["pending", "confirmed", "processing"]
# Work queue of the website team, and the shorter list its KPI counts.
QUEUE_STATUSES = ["new", "draft", "review", "ready"]
NEW_KPI_STATUSES = ["new", "draft", "review"]

# --- stock thresholds --------------------------------------------------------------------------
LOW_STOCK = 3
WATCH_STOCK = 5
AMPLE_STOCK = 10

# --- paging and limits -------------------------------------------------------------------------
PAGE_LIMIT = 20
MAX_PAGE = 100
MAX_LOG_PAGE = 200
RECENTLY_VIEWED = 10
CUSTOMER_HISTORY = 50
REQUESTS_PER_15_MIN = 500
FAILED_LOGINS_PER_15_MIN = 10
SESSION_HOURS = 8

# --- field rules -------------------------------------------------------------------------------
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
MAX_USERNAME = 150
MIN_PASSWORD = 8
MAX_PASSWORD = 200
MAX_SETTING_KEY = 100
DEFAULT_PRICE_LABEL = "Hubungi Kami"
PRICE_LABEL_PREFIX = "Mulai "
ORDER_NUMBER_PREFIX = "ORD"

# --- settings that may be shown without login ----------------------------------------------------
PUBLIC_SETTINGS = [
    "site_name", "site_tagline", "site_desc", "site_logo",
    "whatsapp_number", "whatsapp_message", "phone", "email", "address", "maps_embed",
    "hero_label", "hero_title_1", "hero_title_accent", "hero_desc",
    "hero_btn_primary", "hero_btn_secondary", "hero_bg_image",
    "stat_projects", "stat_years", "stat_satisfaction", "stat_craftsmen",
    "about_title", "about_desc", "about_years", "about_image_main", "about_image_sec",
    "footer_desc", "jam_operasional", "marquee_items",
    "instagram_url", "facebook_url", "youtube_url",
]
INVOICE_SETTINGS = ["site_name", "phone", "email", "address", "site_logo", "whatsapp_number"]
REPORT_SETTINGS = ["site_name", "phone", "email", "address", "site_logo"]

# --- display labels ------------------------------------------------------------------------------
STATUS_LABELS = {
    "new": "Baru", "draft": "Draft", "review": "Review", "ready": "Ready", "published": "Published",
    "hidden": "Hidden", "out_of_stock": "Out of Stock", "archived": "Archived",
    "pending": "Pending", "confirmed": "Confirmed", "processing": "Processing",
    "delivered": "Delivered", "cancelled": "Cancelled", "refunded": "Refunded",
    "paid": "Paid", "unpaid": "Unpaid", "partial": "Partial",
    "superadmin": "Superadmin", "admin_gudang": "Admin Gudang",
    "admin_website": "Admin Website", "marketing": "Marketing",
    "in": "Masuk", "out": "Keluar", "adjustment": "Adjustment",
}
MONTHS_SHORT = ["Jan", "Feb", "Mar", "Apr", "Mei", "Jun", "Jul", "Agu", "Sep", "Okt", "Nov", "Des"]
BADGE_SOLD_OUT = "SOLD OUT"
BADGE_LIMITED = "STOK TERBATAS"

# --- reports -----------------------------------------------------------------------------------
# Figures each role sees on its start page.
ROLE_FIGURES = {
    "admin_gudang": ["total_products", "total_suppliers", "today_orders", "total_orders"],
    "marketing": ["total_products", "today_orders", "total_customers", "unread_contacts", "featured_products"],
    "other": ["total_products", "total_categories", "total_services", "featured_products", "unread_contacts",
              "total_testimonials"],
}
# Columns the stock report may be sorted by.
SORT_FIELDS = ["sku", "name", "warehouse_stock", "stock_value", "cost_price", "sell_price", "publish_status"]

# --- who is told --------------------------------------------------------------------------------
NOTE_ORDER_ROLES = ["marketing", "superadmin"]
NOTE_STOCK_ROLES = ["admin_gudang"]
NOTE_CONTACT_ROLES = ["admin_website", "superadmin"]
NOTE_PRODUCT_ROLES = ["admin_website"]

# --- notification texts --------------------------------------------------------------------------
NOTE_ORDER_TITLE = "Pesanan Baru Masuk"
NOTE_ORDER_TEXT = "Order {number} dari {customer} senilai {total}"
NOTE_PAID_TITLE = "Pembayaran Diterima"
NOTE_PAID_TEXT = "Pembayaran untuk order {number} telah LUNAS."
NOTE_STOCK_TITLE = "Stok Kritis!"
NOTE_STOCK_TEXT = 'Stok produk "{product}" tersisa {left} unit. Harap segera re-stock.'
NOTE_CONTACT_TITLE = "Pesan Baru dari Website"
NOTE_CONTACT_TEXT = 'Pesan dari {name}: "{subject}"'
NOTE_NO_SUBJECT = "Tanpa Subjek"
NOTE_PRODUCT_TITLE = "Produk Baru dari Gudang"
NOTE_PRODUCT_TEXT = 'Produk "{product}" siap untuk diproses di CMS Website.'
LINK_ORDERS = "/admin/panel.html#orders"
LINK_STOCK = "/admin/panel.html#stock"
LINK_CONTACTS = "/admin/panel.html#contacts"
LINK_NEW_PRODUCTS = "/admin/panel.html#products-new"

# --- access matrix -------------------------------------------------------------------------------
# Role groups; "any" means every signed-in role.
ROLE_GROUPS = {
    "superadmin": ["superadmin"],
    "warehouse": ["superadmin", "admin_gudang"],
    "website": ["superadmin", "admin_website"],
    "staff": ["superadmin", "admin_gudang", "admin_website", "marketing"],
    "sales": ["superadmin", "admin_gudang", "marketing"],
    "any": ["superadmin", "admin_gudang", "admin_website", "marketing"],
}

# method, path, role group, and the audit (module, action) it is logged under, if it is logged.
ENDPOINTS = [
    ("GET", "/dashboard", "any", None, None),
    ("GET", "/profile", "any", None, None),
    ("PUT", "/change-password", "any", None, None),
    ("GET", "/notifications", "any", None, None),
    ("PUT", "/notifications/read-all", "any", None, None),
    ("PUT", "/notifications/:id/read", "any", None, None),
    ("GET", "/control-center/stats", "superadmin", None, None),
    ("GET", "/users", "superadmin", None, None),
    ("GET", "/users/:id", "superadmin", None, None),
    ("POST", "/users", "superadmin", "Users", "CREATE_USER"),
    ("PUT", "/users/:id", "superadmin", "Users", "UPDATE_USER"),
    ("POST", "/users/:id/reset-password", "superadmin", "Users", "RESET_PASSWORD"),
    ("POST", "/users/:id/toggle-active", "superadmin", "Users", "ACTIVATE_USER"),
    ("POST", "/users/:id/toggle-active", "superadmin", "Users", "DEACTIVATE_USER"),
    ("DELETE", "/users/:id", "superadmin", "Users", "DELETE_USER"),
    ("POST", "/users/:id/force-logout", "superadmin", "Sessions", "FORCE_LOGOUT"),
    ("GET", "/activity-logs", "superadmin", None, None),
    ("GET", "/sessions", "superadmin", None, None),
    ("GET", "/settings", "website", None, None),
    ("PUT", "/settings", "website", None, None),
    ("POST", "/settings/image/:key", "website", None, None),
    ("PUT", "/settings/:key", "website", None, None),
    ("GET", "/categories", "any", None, None),
    ("POST", "/categories", "staff", None, None),
    ("PUT", "/categories/:id", "staff", None, None),
    ("DELETE", "/categories/:id", "staff", None, None),
    ("GET", "/products", "any", None, None),
    ("GET", "/products/new-from-warehouse", "website", None, None),
    ("GET", "/products/:id", "any", None, None),
    ("POST", "/products", "warehouse", "Products", "CREATE"),
    ("PUT", "/products/:id", "warehouse", "Products", "UPDATE"),
    ("PUT", "/products/:id/cms", "website", "Products", "UPDATE_CMS"),
    ("PUT", "/products/:id/publish", "website", "Products", "PUBLISH"),
    ("PUT", "/products/:id/unpublish", "website", "Products", "UNPUBLISH"),
    ("PUT", "/products/:id/status", "website", "Products", "STATUS_UPDATE"),
    ("DELETE", "/products/:id", "warehouse", "Products", "DELETE"),
    ("DELETE", "/products/:productId/images/:imageId", "website", None, None),
    ("PUT", "/products/:productId/images/:imageId/primary", "website", None, None),
    ("GET", "/services", "any", None, None),
    ("POST", "/services", "website", None, None),
    ("PUT", "/services/:id", "website", None, None),
    ("DELETE", "/services/:id", "website", None, None),
    ("GET", "/testimonials", "any", None, None),
    ("POST", "/testimonials", "website", None, None),
    ("PUT", "/testimonials/:id", "website", None, None),
    ("DELETE", "/testimonials/:id", "website", None, None),
    ("GET", "/contacts", "website", None, None),
    ("PUT", "/contacts/:id/read", "website", None, None),
    ("DELETE", "/contacts/:id", "website", None, None),
    ("GET", "/warehouse/dashboard", "warehouse", None, None),
    ("GET", "/stock/transactions", "warehouse", None, None),
    ("POST", "/stock/in", "warehouse", "Stock", "STOCK_IN"),
    ("POST", "/stock/out", "warehouse", "Stock", "STOCK_OUT"),
    ("POST", "/stock/adjustment", "warehouse", "Stock", "STOCK_ADJUSTMENT"),
    ("GET", "/stock/summary", "warehouse", None, None),
    ("GET", "/suppliers", "warehouse", None, None),
    ("POST", "/suppliers", "warehouse", "Suppliers", "CREATE"),
    ("PUT", "/suppliers/:id", "warehouse", "Suppliers", "UPDATE"),
    ("DELETE", "/suppliers/:id", "warehouse", "Suppliers", "DELETE"),
    ("GET", "/customers", "sales", None, None),
    ("GET", "/customers/:id", "sales", None, None),
    ("POST", "/customers", "sales", "Customers", "CREATE"),
    ("PUT", "/customers/:id", "sales", "Customers", "UPDATE"),
    ("DELETE", "/customers/:id", "warehouse", "Customers", "DELETE"),
    ("GET", "/orders/stats", "staff", None, None),
    ("GET", "/orders", "staff", None, None),
    ("GET", "/orders/:id", "staff", None, None),
    ("GET", "/orders/:id/invoice", "staff", None, None),
    ("POST", "/orders", "sales", "Orders", "CREATE_ORDER"),
    ("PUT", "/orders/:id/status", "sales", "Orders", "UPDATE_ORDER"),
    ("PUT", "/orders/:id", "sales", "Orders", "EDIT_ORDER"),
    ("DELETE", "/orders/:id", "warehouse", "Orders", "DELETE_ORDER"),
]
