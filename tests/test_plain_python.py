"""The hand fixture's expected results, worked out row by row in plain Python.

Each function states what a result means: it walks over the fixture's rows with
dicts and sorted lists and returns the rows the operator must give. Elapsed days
are timedeltas, money is Decimal, rounding is half up.
"""

from collections import defaultdict
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest

import fixture
from souk.plans.oracle import AS_OF
from souk.plans.registry import run
from souk.schema import SCHEMAS

DATA = {name: [dict(zip(SCHEMAS[name].names, row)) for row in rows] for name, rows in fixture.rows().items()}
DAY = timedelta(days=1)


def half_up(x, places):
    """A Fraction, Decimal or int to ``places`` decimals; None stays."""
    if x is None:
        return None
    x = Fraction(x)
    scaled = Decimal(x.numerator * 10 ** (places + 3) // x.denominator) / 1000  # as exact as a half needs here
    return float(scaled.quantize(Decimal(1), ROUND_HALF_UP) / 10 ** places)


def mean(values):
    values = [v for v in values if v is not None]
    return Fraction(sum(map(Fraction, values)), len(values)) if values else None


def part(x, whole):
    return Fraction(100) * Fraction(x) / Fraction(whole) if whole else None


def elapsed(a, b):
    return None if a is None or b is None else Fraction((b - a) // timedelta(microseconds=1), DAY // timedelta(microseconds=1))


def took(o):
    return elapsed(o["order_purchase_timestamp"], o["order_delivered_customer_date"])


def delivered():
    return [o for o in DATA["orders"] if o["order_status"] == "delivered"]


def arrived():
    return [o for o in delivered() if o["order_delivered_customer_date"] is not None]


def items_of():
    out = defaultdict(list)
    for i in DATA["order_items"]:
        out[i["order_id"]].append(i)
    return out


def paid(items):
    known = [i["price"] + i["freight_value"] for i in items if None not in (i["price"], i["freight_value"])]
    return sum(known) if known else None


def known_sum(values):
    values = [v for v in values if v is not None]
    return sum(values) if values else None


def baskets():
    """Delivered order rows that have items, with their items."""
    items = items_of()
    return [(o, items[o["order_id"]]) for o in delivered() if o["order_id"] in items]


def places():
    return {c["customer_id"]: c for c in DATA["customers"]}


def category_names():
    english = {t["product_category_name"]: t["product_category_name_english"] for t in DATA["category_translation"]}
    return {p["product_id"]: english.get(p["product_category_name"], p["product_category_name"]) or "Unknown"
            for p in DATA["products"]}


def grouped(pairs):
    out = defaultdict(list)
    for key, value in pairs:
        out[key].append(value)
    return out


def people():
    """Per person: distinct orders, spend, purchase times over delivered rows with items."""
    where = places()
    rows = grouped((where[o["customer_id"]]["customer_unique_id"], (o, items)) for o, items in baskets() if o["customer_id"] in where)
    out = {}
    for who, mine in rows.items():
        times = [o["order_purchase_timestamp"] for o, _ in mine if o["order_purchase_timestamp"] is not None]
        out[who] = {"orders": len({o["order_id"] for o, _ in mine}), "spent": known_sum(paid(i) for _, i in mine),
                    "first": min(times, default=None), "last": max(times, default=None)}
    return out


def nulls(rows, column):
    return sum(r[column] is None for r in rows)


def dq_null_orders():
    rows = DATA["orders"]
    return [{"total_orders": len(rows), "null_order_id": nulls(rows, "order_id"), "null_customer_id": nulls(rows, "customer_id"),
             "null_status": nulls(rows, "order_status"), "null_purchase_date": nulls(rows, "order_purchase_timestamp"),
             "null_delivery_date": nulls(rows, "order_delivered_customer_date")}]


def dq_null_products():
    rows = DATA["products"]
    missing = nulls(rows, "product_category_name")
    return [{"total_products": len(rows), "null_category": missing, "null_weight": nulls(rows, "product_weight_g"),
             "null_length": nulls(rows, "product_length_cm"), "pct_missing_category": half_up(part(missing, len(rows)), 2)}]


def dq_duplicate_orders():
    times = grouped((o["order_id"], 1) for o in DATA["orders"])
    many = sorted((-len(v), k) for k, v in times.items() if len(v) > 1)
    return [{"order_id": k, "occurrences": -n} for n, k in many[:10]]


def dq_date_range():
    times = [o["order_purchase_timestamp"] for o in DATA["orders"]
             if o["order_status"] not in (None, "canceled") and o["order_purchase_timestamp"] is not None]
    return [{"first_order_date": str(min(times).date()), "last_order_date": str(max(times).date()),
             "active_days": len({t.date() for t in times}), "span_months": half_up(elapsed(min(times), max(times)) / 30, 1)}]


def dq_status_distribution():
    kinds = grouped((o["order_status"], 1) for o in DATA["orders"])
    return [{"order_status": k, "order_count": len(v), "pct": half_up(part(len(v), len(DATA["orders"])), 2)} for k, v in kinds.items()]


def dq_orphan_orders():
    return [{"orders_without_customer": sum(o["customer_id"] not in places() for o in DATA["orders"])}]


def dq_price_sanity():
    prices = [i["price"] for i in DATA["order_items"] if i["price"] is not None]
    return [{"min_price": float(min(prices)), "max_price": float(max(prices)), "avg_price": half_up(mean(prices), 2),
             "avg_freight": half_up(mean(i["freight_value"] for i in DATA["order_items"]), 2),
             "zero_or_neg_price": sum(p <= 0 for p in prices)}]


def snapshot(times):
    """``times(items)``: how often an order row counts."""
    rows = [(o, items, times(items)) for o, items in baskets()]
    goods = sum((known_sum(i["price"] for i in items) or 0) * k for _, items, k in rows)
    freight = sum((known_sum(i["freight_value"] for i in items) or 0) * k for _, items, k in rows)
    totals = [paid(items) for _, items, k in rows for _ in range(k)]
    return [{"total_orders": len({o["order_id"] for o, _, _ in rows}),
             "unique_customers": len({o["customer_id"] for o, _, _ in rows} - {None}),
             "active_sellers": len({i["seller_id"] for _, items, _ in rows for i in items}),
             "product_revenue": half_up(goods, 2), "freight_revenue": half_up(freight, 2),
             "total_revenue": half_up(known_sum(totals), 2), "average_order_value": half_up(mean(totals), 2),
             "freight_share_pct": half_up(part(freight, goods), 2)}]


def kpi_snapshot():
    return snapshot(len)


def kpi_snapshot_order_grain():
    return snapshot(lambda items: 1)


def kpi_monthly_trend():
    months = grouped((o["order_purchase_timestamp"] and o["order_purchase_timestamp"].strftime("%Y-%m"), (o, paid(items)))
                     for o, items in baskets())
    out, before = [], None
    for month in sorted(months, key=lambda m: (m is not None, m)):
        rows = months[month]
        total = known_sum(p for _, p in rows)
        out.append({"month": month, "total_orders": len({o["order_id"] for o, _ in rows}),
                    "total_customers": len({o["customer_id"] for o, _ in rows} - {None}), "revenue": half_up(total, 2),
                    "average_order_value": half_up(mean(p for _, p in rows), 2),
                    "mom_growth_pct": half_up(part(total - before, before), 2) if before else None})
        before = total
    return out


def kpi_quarterly():
    def quarter(t):
        return (str(t.year), f"Q{(t.month + 2) // 3}") if t else (None, "Q4")
    return [{"year": y, "quarter": q, "total_orders": len({o["order_id"] for o, _ in rows}),
             "revenue": half_up(known_sum(p for _, p in rows), 2), "average_order_value": half_up(mean(p for _, p in rows), 2)}
            for (y, q), rows in grouped((quarter(o["order_purchase_timestamp"]), (o, paid(i))) for o, i in baskets()).items()]


def kpi_orders_by_weekday():
    days = grouped((o["order_purchase_timestamp"] and o["order_purchase_timestamp"].strftime("%A"), o["order_id"]) for o in delivered())
    return [{"day_of_week": d, "total_orders": len(set(v))} for d, v in days.items()]


def kpi_orders_by_hour():
    hours = grouped((o["order_purchase_timestamp"] and o["order_purchase_timestamp"].hour, o["order_id"]) for o in delivered())
    return [{"hour_of_day": h, "total_orders": len(set(v))} for h, v in hours.items()]


def kpi_category_performance():
    names = category_names()
    sold = grouped((names[i["product_id"]], (o["order_id"], i["price"])) for o, items in baskets() for i in items if i["product_id"] in names)
    whole = sum(p for rows in sold.values() for _, p in rows if p is not None)
    return [{"category": c, "total_orders": len({k for k, _ in rows}), "product_revenue": half_up(known_sum(p for _, p in rows), 2),
             "average_item_price": half_up(mean(p for _, p in rows), 2),
             "revenue_share_pct": half_up(part(known_sum(p for _, p in rows) or 0, whole), 2)} for c, rows in sold.items()]


def kpi_state_performance():
    where = places()
    states = grouped((where[o["customer_id"]]["customer_state"], (o["order_id"], paid(i))) for o, i in baskets() if o["customer_id"] in where)
    whole = sum(p for rows in states.values() for _, p in rows if p is not None)
    return [{"customer_state": s, "total_orders": len({k for k, _ in rows}), "revenue": half_up(known_sum(p for _, p in rows), 2),
             "average_order_value": half_up(mean(p for _, p in rows), 2),
             "revenue_share_pct": half_up(part(known_sum(p for _, p in rows) or 0, whole), 2)} for s, rows in states.items()]


def cust_repeat_segments():
    names = ["1_One-time", "2_Two orders", "3_Loyal (3+)"]
    kinds = grouped((names[min(p["orders"], 3) - 1], p["spent"]) for p in people().values())
    return [{"segment": k, "customer_count": len(v), "pct_of_customers": half_up(part(len(v), len(people())), 1),
             "avg_lifetime_spend": half_up(mean(v), 2)} for k, v in kinds.items()]


def thirds(key):
    """The third in which each person stands, the first thirds taking what is left over."""
    order = sorted(people(), key=lambda who: (key(who) is not None, key(who), who))
    size, more = divmod(len(order), 3)
    ends = [size + (more > 0), 2 * size + min(more, 2)]
    return {who: 1 + (at >= ends[0]) + (at >= ends[1]) for at, who in enumerate(order)}


def cust_rfm_full():
    all_of = people()
    age = {who: (date.fromisoformat(AS_OF) - p["last"].date()).days if p["last"] else None for who, p in all_of.items()}
    old, often, much = thirds(age.get), thirds(lambda w: all_of[w]["orders"]), thirds(lambda w: all_of[w]["spent"])
    out = []
    for who, p in all_of.items():
        r, f, m = 4 - old[who], often[who], much[who]
        rules = [("Champions", r + f + m >= 8), ("Loyal", r + f + m >= 6), ("Promising", r >= 2 and f == 1),
                 ("At Risk", r == 1 and f >= 2), ("Lost", True)]
        out.append({"customer_unique_id": who, "recency_days": age[who], "frequency": p["orders"], "monetary": float(p["spent"]),
                    "r_score": r, "f_score": f, "m_score": m, "rfm_total": r + f + m,
                    "rfm_segment": next(name for name, holds in rules if holds)})
    return out


def dash_rfm_segments():
    kinds = grouped((r["rfm_segment"], 1) for r in cust_rfm_full())
    return [{"rfm_segment": k, "customer_count": len(v), "pct_of_customers": half_up(part(len(v), len(people())), 1)} for k, v in kinds.items()]


def cust_clv():
    all_of = people().values()
    return [{"avg_clv": half_up(mean(p["spent"] for p in all_of), 2), "avg_orders_per_customer": half_up(mean(p["orders"] for p in all_of), 2),
             "avg_order_value": half_up(mean(Fraction(p["spent"]) / p["orders"] for p in all_of), 2),
             "max_clv": float(max(p["spent"] for p in all_of)), "repeat_customers": sum(p["orders"] > 1 for p in all_of),
             "total_customers": len(all_of)}]


def cust_summary():
    return [{"customer_unique_id": who, "total_orders": p["orders"], "total_spent": float(p["spent"]),
             "first_order": p["first"] and str(p["first"].date()), "last_order": p["last"] and str(p["last"].date()),
             "active_days": (p["last"] - p["first"]) // DAY if p["first"] else None} for who, p in people().items()]


def delivery_overall():
    days = [took(o) for o in arrived()]
    promised = [elapsed(o["order_purchase_timestamp"], o["order_estimated_delivery_date"]) for o in arrived()]
    known = [d for d in days if d is not None]
    return [{"delivered_orders": len(days), "avg_delivery_days": half_up(mean(days), 1), "min_delivery_days": half_up(min(known), 1),
             "max_delivery_days": half_up(max(known), 1), "avg_estimated_days": half_up(mean(promised), 1)}]


def late(o):
    e = o["order_estimated_delivery_date"]
    return e is not None and o["order_delivered_customer_date"] > e


def delivery_by_state():
    where = places()
    states = grouped((where[o["customer_id"]]["customer_state"], o) for o in arrived() if o["customer_id"] in where)
    return [{"state": s, "total_orders": len({o["order_id"] for o in rows}), "avg_delivery_days": half_up(mean(map(took, rows)), 1),
             "late_orders": sum(map(late, rows)), "late_rate_pct": half_up(part(sum(map(late, rows)), len(rows)), 1)}
            for s, rows in states.items()]


def speed(o):
    """By whole days, rounded towards zero; an unknown time falls through to the last."""
    days = took(o)
    whole = None if days is None else int(days)
    for most, name in ((7, "01: Fast (≤7 days)"), (14, "02: Normal (8-14 days)"), (21, "03: Slow (15-21 days)")):
        if whole is not None and whole <= most:
            return name
    return "04: Very Slow (21+ days)"


def delivery_speed_vs_review():
    scores = grouped((r["order_id"], r["review_score"]) for r in DATA["order_reviews"])
    kinds = grouped((speed(o), s) for o in arrived() for s in scores[o["order_id"]])
    return [{"speed_bucket": k, "orders": len(v), "avg_review_score": half_up(mean(v), 2)} for k, v in kinds.items()]


def dash_delivery_distribution():
    kinds = grouped((speed(o), 1) for o in arrived())
    return [{"speed_bucket": k, "orders": len(v), "pct": half_up(part(len(v), len(arrived())), 1)} for k, v in kinds.items()]


def review_distribution():
    kinds = grouped((r["review_score"], 1) for r in DATA["order_reviews"])
    return [{"review_score": k, "reviews": len(v), "pct": half_up(part(len(v), len(DATA["order_reviews"])), 1)} for k, v in kinds.items()]


def review_satisfaction():
    scores = [r["review_score"] for r in DATA["order_reviews"]]
    good, bad = (sum(s is not None and holds(s) for s in scores) for holds in (lambda s: s >= 4, lambda s: s <= 2))
    return [{"total_reviews": len(scores), "avg_score": half_up(mean(scores), 2),
             "pct_positive": half_up(part(good, len(scores)), 1), "pct_negative": half_up(part(bad, len(scores)), 1)}]


def delivered_reviews():
    by_order = grouped((r["order_id"], r["review_score"]) for r in DATA["order_reviews"])
    return [(o, s) for o in delivered() for s in by_order[o["order_id"]]]


def review_by_category():
    names, items = category_names(), items_of()
    kinds = grouped((c, s) for o, s in delivered_reviews()
                    for c in {names[i["product_id"]] for i in items[o["order_id"]] if i["product_id"] in names})
    return [{"category": c, "review_count": len(v), "avg_score": half_up(mean(v), 2), "five_star": v.count(5), "one_star": v.count(1),
             "pct_one_star": half_up(part(v.count(1), len(v)), 1)} for c, v in kinds.items() if len(v) > 50]


def review_by_state():
    where = places()
    states = grouped((where[o["customer_id"]]["customer_state"], s) for o, s in delivered_reviews() if o["customer_id"] in where)
    return [{"state": k, "reviews": len(v), "avg_score": half_up(mean(v), 2),
             "pct_positive": half_up(part(sum(s is not None and s >= 4 for s in v), len(v)), 1)} for k, v in states.items()]


EXPECTED = [dq_null_orders, dq_null_products, dq_duplicate_orders, dq_date_range, dq_status_distribution, dq_orphan_orders,
            dq_price_sanity, kpi_snapshot, kpi_snapshot_order_grain, kpi_monthly_trend, kpi_quarterly, kpi_orders_by_weekday,
            kpi_orders_by_hour, kpi_category_performance, kpi_state_performance, cust_repeat_segments, cust_rfm_full,
            dash_rfm_segments, cust_clv, cust_summary, delivery_overall, delivery_by_state, delivery_speed_vs_review,
            dash_delivery_distribution, review_distribution, review_satisfaction, review_by_category, review_by_state]


@pytest.mark.parametrize("expected", EXPECTED, ids=lambda f: f.__name__)
def test_fixture_by_hand(tables, expected):
    rows = [r.asDict() for r in run(expected.__name__, tables, as_of=AS_OF).collect()]
    want = expected()
    order = lambda r: str(sorted((k, str(v)) for k, v in r.items()))
    assert sorted(rows, key=order) == sorted(want, key=order)
