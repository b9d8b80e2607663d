"""DuckDB statements of the analyses in time (``souk.operators.activity``), over the test
tables and the views of ``souk.plans.oracle``."""

from __future__ import annotations

from souk.plans.oracle import DAY, with_views

STATEMENTS: dict[str, str] = {}

STATEMENTS["asof_event_order"] = f"""
WITH last AS (
  SELECT customer_id, order_purchase_timestamp AS ordered, max(order_id) AS order_id, arg_max(order_status, order_id) AS order_status
  FROM m_orders GROUP BY ALL)
SELECT event_id, user_id, event_type, order_id, order_status,
  CAST(trunc((epoch_us(ts) - epoch_us(ordered)) / {DAY}) AS BIGINT) AS days_since_order
FROM events ASOF LEFT JOIN last ON user_id = customer_id AND ts >= ordered"""

STATEMENTS["asof_last_touch"] = """
WITH clicks AS (SELECT user_id AS who, ts AS clicked, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL),
met AS (
  SELECT event_id, user_id, value, ts, clicked, click_id, epoch_us(ts) - epoch_us(clicked) AS age
  FROM (FROM events WHERE event_type = 'purchase') ASOF LEFT JOIN clicks ON user_id = who AND ts > clicked)
SELECT event_id, user_id, value, IF(age <= 3 * 86400000000, click_id, NULL) AS click_id,
  IF(age <= 3 * 86400000000, age // 1000000, NULL) AS seconds_after_click
FROM met"""

STATEMENTS["asof_price_moves"] = """
WITH bought AS (SELECT order_id, min(order_purchase_timestamp) AS ts FROM m_orders GROUP BY ALL),
sold AS (SELECT product_id, price, ts FROM m_order_items JOIN bought USING (order_id)),
dearest AS (SELECT product_id, ts AS at, max(price) AS before FROM sold GROUP BY ALL)
SELECT s.product_id, count(*) AS sales, count(before) AS with_earlier,
  count(*) FILTER (WHERE price > before) AS dearer, count(*) FILTER (WHERE price < before) AS cheaper
FROM sold s ASOF LEFT JOIN dearest d ON s.product_id = d.product_id AND s.ts > d.at
GROUP BY ALL"""

_UNDER_WAY = "(FROM m_orders WHERE order_status = 'delivered' AND order_delivered_customer_date > order_purchase_timestamp)"

STATEMENTS["interval_orders_during_delivery"] = f"""
SELECT p.order_id, count(*) AS under_way,
  count(*) FILTER (WHERE d.order_delivered_customer_date > d.order_estimated_delivery_date) AS came_late
FROM m_orders p JOIN {_UNDER_WAY} d
  ON d.customer_id = p.customer_id AND d.order_id <> p.order_id
  AND p.order_purchase_timestamp >= d.order_purchase_timestamp AND p.order_purchase_timestamp < d.order_delivered_customer_date
GROUP BY ALL"""

STATEMENTS["interval_purchases_after_error"] = """
SELECT e.event_id AS error_id, e.user_id, count(b.event_id) AS purchases,
  CAST(coalesce(sum(CAST(b.value AS DECIMAL(18,2))), 0) AS DOUBLE) AS paid
FROM events e LEFT JOIN events b
  ON b.event_type = 'purchase' AND b.user_id = e.user_id AND b.ts >= e.ts AND b.ts < e.ts + INTERVAL 24 HOURS
WHERE e.event_type = 'error' GROUP BY ALL"""

STATEMENTS["interval_overlapping_deliveries"] = f"""
SELECT a.customer_id, count(*) AS overlapping
FROM {_UNDER_WAY} a JOIN {_UNDER_WAY} b ON a.customer_id = b.customer_id AND a.order_id < b.order_id
  AND a.order_purchase_timestamp < b.order_delivered_customer_date AND b.order_purchase_timestamp < a.order_delivered_customer_date
GROUP BY ALL"""

STATEMENTS["rolling_state_activity"] = """
WITH sold AS (
  SELECT customer_state AS state, customer_unique_id AS who, CAST(order_purchase_timestamp AS DATE) AS day, paid
  FROM m_orders o JOIN m_customers USING (customer_id)
  JOIN (SELECT order_id, SUM(price + freight_value) AS paid FROM m_order_items GROUP BY ALL) USING (order_id)
  WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL),
days AS (SELECT DISTINCT state, day FROM sold)
SELECT d.state, strftime(d.day, '%Y-%m-%d') AS day, CAST(ROUND(SUM(paid), 2) AS DOUBLE) AS revenue, COUNT(DISTINCT who) AS active_customers
FROM days d JOIN sold s ON d.state IS NOT DISTINCT FROM s.state AND s.day BETWEEN d.day - 27 AND d.day
GROUP BY d.state, d.day"""

STATEMENTS["cube_sales"] = """
WITH named AS (
  SELECT product_id, COALESCE((SELECT product_category_name_english FROM m_category_translation t
    WHERE t.product_category_name = p.product_category_name), product_category_name, 'Unknown') AS category
  FROM m_products p)
SELECT category, customer_state AS state, strftime(order_purchase_timestamp, '%Y-%m') AS month, GROUPING(category, state, month) AS level,
  COUNT(DISTINCT order_id) AS orders, CAST(ROUND(SUM(price + freight_value), 2) AS DOUBLE) AS revenue
FROM m_orders JOIN m_order_items USING (order_id) JOIN named USING (product_id) JOIN m_customers USING (customer_id)
WHERE order_status = 'delivered' GROUP BY CUBE (category, state, month)"""

_SESSIONS = """seen AS (SELECT DISTINCT ON (event_id, ts) event_id, user_id, ts, value FROM events WHERE ts IS NOT NULL),
marked AS (
  SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS, true) AS opens FROM seen),
numbered AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM marked),
sessions AS (
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS events,
         CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
  FROM numbered GROUP BY user_id, session)"""
# What a stream gives out: what has ended an hour, the time events may be late, before the last event.
_FINAL = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"

STATEMENTS["session_events"] = f"WITH {_SESSIONS} SELECT * FROM sessions"

STATEMENTS["session_summary"] = f"""
WITH {_SESSIONS}
SELECT user_id, count(*) AS sessions, sum(events) / count(*) AS events_per_session,
  max((epoch_us(session_end) - epoch_us(session_start)) / 60000000.0::DOUBLE) AS longest_minutes
FROM sessions GROUP BY ALL"""

STATEMENTS["stream_sessions"] = f"WITH {_SESSIONS} SELECT * FROM sessions WHERE session_end <= {_FINAL}"

STATEMENTS["stream_event_windows"] = f"""
WITH seen AS (SELECT DISTINCT ON (event_id, ts) * FROM events WHERE ts IS NOT NULL),
dealt AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, value FROM seen)
SELECT window_start, window_start + INTERVAL 6 HOURS AS window_end, event_type, count(*) AS events,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
FROM dealt GROUP BY ALL HAVING window_start + INTERVAL 6 HOURS <= {_FINAL}"""

_NAMED = """named AS (
  SELECT product_id, COALESCE((SELECT product_category_name_english FROM m_category_translation t
    WHERE t.product_category_name = p.product_category_name), product_category_name, 'Unknown') AS category
  FROM m_products p)"""

STATEMENTS["theta_cheaper_rivals"] = f"""
WITH {_NAMED},
offered AS (SELECT product_id, category, min(price) AS price FROM m_order_items JOIN named USING (product_id) GROUP BY ALL)
SELECT a.product_id, a.category, CAST(a.price AS DOUBLE) AS price,
  count(*) FILTER (WHERE b.price < a.price) AS cheaper, count(*) FILTER (WHERE b.price > a.price) AS dearer
FROM offered a JOIN offered b ON a.category = b.category
GROUP BY a.product_id, a.category, a.price"""

STATEMENTS["theta_undercut_sellers"] = """
WITH sold AS (SELECT row_number() OVER () AS n, product_id, seller_id, price FROM m_order_items),
offers AS (
  SELECT a.n, a.seller_id, count(b.n) AS offers
  FROM sold a LEFT JOIN sold b ON a.product_id = b.product_id AND a.seller_id <> b.seller_id AND b.price < a.price
  GROUP BY ALL)
SELECT seller_id, count(*) AS items, count(*) FILTER (WHERE offers > 0) AS undercut, CAST(sum(offers) AS BIGINT) AS cheaper_offers
FROM offers GROUP BY ALL"""

_OPEN = """(SELECT order_id, order_estimated_delivery_date < TIMESTAMP '{0}' AS late FROM m_orders
  WHERE order_purchase_timestamp <= TIMESTAMP '{0}' AND coalesce(order_delivered_customer_date > TIMESTAMP '{0}', true))"""

STATEMENTS["recon_open_orders"] = f"""
SELECT coalesce(a.order_id, b.order_id) AS order_id,
  CASE WHEN a.order_id IS NULL THEN 'added' WHEN b.order_id IS NULL THEN 'removed'
       WHEN a.late IS DISTINCT FROM b.late THEN 'changed' ELSE 'same' END AS change,
  CAST(a.order_id IS NOT NULL AS BIGINT) AS rows_before, CAST(b.order_id IS NOT NULL AS BIGINT) AS rows_after
FROM {_OPEN.format("1998-01-01")} a FULL JOIN {_OPEN.format("1998-02-01")} b ON a.order_id = b.order_id"""

STATEMENTS["recon_order_amounts"] = """
WITH billed AS (SELECT order_id, sum(price + freight_value) AS billed FROM m_order_items GROUP BY ALL),
paid AS (SELECT order_id, sum(payment_value) AS paid FROM m_order_payments GROUP BY ALL)
SELECT order_id, CAST(billed AS DOUBLE) AS billed, CAST(paid AS DOUBLE) AS paid,
  CASE WHEN paid IS NULL THEN 'unpaid' WHEN billed IS NULL THEN 'no items'
       WHEN paid = billed THEN 'equal' WHEN paid > billed THEN 'overpaid' ELSE 'underpaid' END AS state
FROM billed FULL JOIN paid USING (order_id)"""

STATEMENTS["recon_log_orders"] = """
WITH log AS (SELECT user_id AS customer_id, dayofweek(ts) + 1 AS weekday FROM events WHERE event_type = 'purchase'),
placed AS (SELECT customer_id, dayofweek(order_purchase_timestamp) + 1 AS weekday FROM m_orders),
found AS (
  SELECT *, 'both' AS side FROM (SELECT * FROM log INTERSECT ALL SELECT * FROM placed)
  UNION ALL SELECT *, 'log' FROM (SELECT * FROM log EXCEPT ALL SELECT * FROM placed)
  UNION ALL SELECT *, 'orders' FROM (SELECT * FROM placed EXCEPT ALL SELECT * FROM log))
SELECT customer_id, CAST(weekday AS INTEGER) AS weekday, count(*) FILTER (WHERE side = 'both') AS in_both,
  count(*) FILTER (WHERE side = 'log') AS log_only, count(*) FILTER (WHERE side = 'orders') AS orders_only
FROM found GROUP BY ALL"""

_BUYERS = """bought AS (
  SELECT DISTINCT strftime(order_purchase_timestamp, '%Y-%m') AS month, customer_unique_id AS who
  FROM m_orders JOIN m_customers USING (customer_id)
  WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL AND order_id IN (SELECT order_id FROM m_order_items))"""

STATEMENTS["sketch_active_error"] = f"""
WITH {_BUYERS},
spread AS (
  SELECT who, unnest([month, month[:4] || '-Q' || (CAST(month[6:] AS INT) + 2) // 3, month[:4], 'all']) AS period FROM bought)
SELECT period, count(DISTINCT who) AS customers, true AS within FROM spread GROUP BY ALL"""

# Exact while no month has over 4,096 buyers.
STATEMENTS["sketch_retention"] = f"""
WITH {_BUYERS},
later AS (SELECT who, strftime(CAST(month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS month, true AS stayed FROM bought)
SELECT month, count(*) AS customers, count(stayed) AS retained, count(*) - count(stayed) AS lost
FROM bought LEFT JOIN later USING (month, who) GROUP BY ALL"""

STATEMENTS["json_order_facts"] = """
WITH billed AS (
  SELECT order_id, count(*) AS items, sum(price) AS total, max(price) AS dearest FROM m_order_items GROUP BY ALL),
judged AS (
  SELECT order_id, count(*) AS reviews, count(*) FILTER (WHERE review_score IN (1, 2)) AS low_reviews FROM m_order_reviews GROUP BY ALL)
SELECT order_id, coalesce(items, 0) AS items, CAST(coalesce(total, 0) AS DOUBLE) AS total, CAST(dearest AS DOUBLE) AS dearest,
  coalesce(reviews, 0) AS reviews, coalesce(low_reviews, 0) AS low_reviews
FROM billed FULL JOIN judged USING (order_id)"""

STATEMENTS["json_seller_items"] = """
SELECT seller_id, count(*) AS items, CAST(sum(price + freight_value) AS DOUBLE) AS revenue, count(DISTINCT order_id) AS orders
FROM m_order_items GROUP BY ALL"""

ORACLE_SQL: dict[str, str] = {key: with_views(sql) for key, sql in STATEMENTS.items()}
