"""Registered queries: name → (Spark function, DuckDB text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellselect.plans.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(t)`` where ``t`` reads tables and derived views of one folder."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from cellselect.plans.fixtures import Tables
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, views)
        return fn

    return add


def oracle(sql: str, views: str = "") -> str:
    names = views.split()
    if not names:
        return sql
    needed: list[str] = []

    def visit(name: str) -> None:
        deps, _ = VIEWS[name]
        for dep in deps.split():
            visit(dep)
        if name not in needed:
            needed.append(name)

    for n in names:
        visit(n)
    heads = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {heads},\n{body[5:]}"
    return f"WITH RECURSIVE {heads}\n{body}"
