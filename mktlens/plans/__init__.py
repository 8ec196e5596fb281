"""Registered queries, and the SQL that each of them is checked against."""

from __future__ import annotations

from . import registry, research, flow, live, market, streams  # noqa: F401, I001


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)
