"""Every operator as a query over the given tables, named by its row in the operator inventory."""

from __future__ import annotations

from flowwarden.registry import alerts, basics, models, statistics, streams  # noqa: F401
from flowwarden.registry.base import QUERIES, SQL
from flowwarden.registry.models import flagship  # noqa: F401


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
