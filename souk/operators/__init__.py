"""Analytic operators: each is ``Tables -> DataFrame`` (plus keyword parameters)."""

from souk.operators import customers, dashboards, delivery, kpis, quality, reviews

__all__ = ["customers", "dashboards", "delivery", "kpis", "quality", "reviews"]
