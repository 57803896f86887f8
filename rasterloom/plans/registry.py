"""Queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Common table expressions for the signals of rasterloom.sources.signals.
EVENTS = """sig AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, round(value)::BIGINT AS v FROM events)"""
PLANES = """sig AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, greatest(-128, least(127, floor(embedding[p + 1]::DOUBLE * 128)))::BIGINT AS v FROM embeddings, range(64) t(p))"""
REAL_PLANES = """sig AS (SELECT vec_id, p // 8 AS y, p % 8 AS x, embedding[p + 1]::DOUBLE * 128 AS v FROM embeddings, range(64) t(p))"""
PIXELS = """sig AS (SELECT l_orderkey, l_linenumber, least(255, floor(l_quantity * 5))::BIGINT AS r, round(l_discount * 100)::BIGINT * 25 AS g,
    round(l_tax * 100)::BIGINT * 30 AS b FROM lineitem)"""
REGIONS = """regions AS (SELECT o_orderkey AS req_id, o_orderkey * 37 % 3840 AS x, (o_orderkey * 11 + o_custkey * 17) % 3840 AS y,
    1 + o_orderkey % 255 AS w, 1 + o_custkey % 254 AS h FROM orders)"""
FRAGMENTS = """fragments AS (SELECT l_suppkey AS k, l_orderkey * 10 AS s, l_orderkey * 10 + floor(l_quantity)::BIGINT AS e FROM lineitem)"""


def lift(source: str, line: str, at: str, stages: list[tuple[int, str]]) -> tuple[str, str]:
    """SQL of lifting stages over a relation with v: the expressions, and the name of the last."""
    out, name = [], source
    for k, (parity, change) in enumerate(stages):
        new = f"{source}_{at}{k}"
        out.append(
            f"{new} AS (SELECT * EXCLUDE (lo, hi) REPLACE (CASE WHEN {at} % 2 = {parity} AND lo IS NOT NULL THEN {change} ELSE v END AS v) FROM "
            f"(SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS lo, coalesce(lead(v) OVER w, lag(v) OVER w) AS hi FROM {name} "
            f"WINDOW w AS (PARTITION BY {line} ORDER BY {at})))"
        )
        name = new
    return ", ".join(out), name


FORWARD_53 = [(1, "v - ((lo + hi) >> 1)"), (0, "v + ((lo + hi + 2) >> 2)")]
INVERSE_53 = [(0, "v - ((lo + hi + 2) >> 2)"), (1, "v + ((lo + hi) >> 1)")]
