"""Fixed output values. These strings must match the original queries
byte for byte (UTF-8), so they are listed here verbatim and in natural order.
"""

# Order status literals used by filters.
DELIVERED = "delivered"
CANCELED = "canceled"

# Table labels of the row-count overview, in output order.
ROW_COUNT_LABELS = [
    ("orders", "orders"),
    ("order_items", "order_items"),
    ("order_payments", "order_payments"),
    ("order_reviews", "order_reviews"),
    ("customers", "customers"),
    ("sellers", "sellers"),
    ("products", "products"),
    ("product_category_name_translation", "category_translation"),
]

# Data-quality scorecard.
CHECK_DUPLICATE_ORDERS = "Duplicate orders"
CHECK_ORPHAN_ITEMS = "Orphan order items"
CHECK_ZERO_PRICE = "Zero-price items"
PASS = "PASS"
FAIL = "FAIL"

# Weekday names indexed by 0 = Sunday ... 6 = Saturday.
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Quarter labels.
QUARTERS = ["Q1", "Q2", "Q3", "Q4"]

# Category fallback when neither translation nor raw name exists.
UNKNOWN_CATEGORY = "Unknown"

# Repeat-buyer segments.
SEG_ONE_TIME = "1_One-time"
SEG_TWO = "2_Two orders"
SEG_LOYAL = "3_Loyal (3+)"

# RFM segments, in rule order.
RFM_CHAMPIONS = "Champions"
RFM_LOYAL = "Loyal"
RFM_PROMISING = "Promising"
RFM_AT_RISK = "At Risk"
RFM_LOST = "Lost"

# Delivery status.
ON_TIME = "On Time"
LATE = "Late"

# Delivery speed buckets (whole days <= 7, <= 14, <= 21, else).
SPEED_FAST = "01: Fast (≤7 days)"
SPEED_NORMAL = "02: Normal (8-14 days)"
SPEED_SLOW = "03: Slow (15-21 days)"
SPEED_VERY_SLOW = "04: Very Slow (21+ days)"
