"""Registry of named queries with their SQL counterparts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, functions as F

from rekurve.plans.session import ship_package

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` gives the same rows."""

    def keep(fn):
        assert name not in QUERIES, name

        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def rd(c, digits: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def RD(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"
