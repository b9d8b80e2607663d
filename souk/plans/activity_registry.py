"""Name -> analysis beyond the original statements; each takes the marketplace tables and the
activity log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from souk.operators import activity, nested, rivals, sketches, versions
from souk.streaming import activity as streams

ANALYSES: dict[str, Callable[..., DataFrame]] = {
    "asof_event_order": activity.asof_event_order,
    "asof_last_touch": activity.asof_last_touch,
    "asof_price_moves": activity.asof_price_moves,
    "interval_orders_during_delivery": activity.interval_orders_during_delivery,
    "interval_purchases_after_error": activity.interval_purchases_after_error,
    "interval_overlapping_deliveries": activity.interval_overlapping_deliveries,
    "rolling_state_activity": activity.rolling_state_activity,
    "cube_sales": activity.cube_sales,
    "session_events": lambda t, events: streams.merged_sessions(events),
    "session_summary": lambda t, events: streams.session_summary(events),
    "theta_cheaper_rivals": lambda t, events: rivals.theta_cheaper_rivals(t),
    "theta_undercut_sellers": lambda t, events: rivals.theta_undercut_sellers(t),
    "recon_open_orders": lambda t, events: versions.recon_open_orders(t),
    "recon_order_amounts": lambda t, events: versions.recon_order_amounts(t),
    "recon_log_orders": versions.recon_log_orders,
    "sketch_active_error": lambda t, events: sketches.sketch_active_error(t),
    "sketch_retention": lambda t, events: sketches.sketch_retention(t),
    "json_order_facts": lambda t, events: nested.json_order_facts(t),
    "json_seller_items": lambda t, events: nested.json_seller_items(t),
}

# Estimates, which no statement gives; tests hold them against exact figures.
ESTIMATES: dict[str, Callable[..., DataFrame]] = {
    "sketch_active_customers": lambda t, events: sketches.sketch_active_customers(t),
    "sketch_order_value": lambda t, events: sketches.sketch_order_value(t),
}

# Streams over the activity log, which they read themselves: (spark, path of the log, its schema).
STREAMS: dict[str, Callable[..., DataFrame]] = {
    "stream_event_windows": streams.stream_event_windows,
    "stream_sessions": streams.stream_sessions,
}
