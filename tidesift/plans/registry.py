"""Registry of checkable queries: name -> (DataFrame function, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(fn, sql)
        return fn

    return register


def place(by: str | None = None, key: str = "uid", seed: int = 42) -> str:
    """SQL for the position in hash order, per class if ``by`` is given."""
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}|' || CAST({key} AS VARCHAR)), {key})"


def drawn_sql(source: str, size: str, name: str, key: str = "uid") -> str:
    """CTE ``name``: the first ``size`` rows of ``source`` in hash order."""
    return f"""
{name} AS (
  SELECT * EXCLUDE (_place) FROM (SELECT *, {place(key=key)} AS _place FROM {source})
  WHERE _place <= {size}
)"""


def split_sql(source: str, by: str, validation: str, test: str, name: str) -> str:
    """CTEs ending in ``name``: ``source`` with a stratified ``split`` column."""
    held = f"(CAST({validation} AS DECIMAL(9,4)) + CAST({test} AS DECIMAL(9,4)))"
    return f"""
{name}_n AS (SELECT {by} AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} GROUP BY ALL),
{name}_h AS (SELECT *, CAST(ceil(total * {held}) AS BIGINT) AS held FROM {name}_n),
{name}_t AS (
  SELECT *, CAST(n * (total - held) // total AS BIGINT) AS base_train,
         row_number() OVER (ORDER BY n * (total - held) % total DESC, CAST(c AS VARCHAR)) AS place_train
  FROM {name}_h),
{name}_u AS (
  SELECT *, base_train + CASE WHEN place_train <= total - held - sum(base_train) OVER () THEN 1 ELSE 0 END AS n_train
  FROM {name}_t),
{name}_v AS (
  SELECT *, n - n_train AS rest,
         held - CAST(ceil(held * CAST({test} AS DOUBLE) / CAST({held} AS DOUBLE) - 1e-9) AS BIGINT) AS want_val
  FROM {name}_u),
{name}_w AS (
  SELECT *, CAST(rest * want_val // greatest(held, 1) AS BIGINT) AS base_val,
         row_number() OVER (ORDER BY rest * want_val % greatest(held, 1) DESC, CAST(c AS VARCHAR)) AS place_val
  FROM {name}_v),
{name}_x AS (
  SELECT c, n_train,
         base_val + CASE WHEN place_val <= want_val - sum(base_val) OVER () THEN 1 ELSE 0 END AS n_val
  FROM {name}_w),
{name} AS (
  SELECT s.* EXCLUDE (_place),
         CASE WHEN _place <= n_train THEN 'train' WHEN _place <= n_train + n_val THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT *, {place(by)} AS _place FROM {source}) s
  JOIN {name}_x ON {by} IS NOT DISTINCT FROM c
)"""


def first_wins_sql(edges: str, name: str) -> str:
    """CTEs ending in ``name`` (uid): rows dropped by the sequential scan over
    ``edges`` (src, dst). Needs WITH RECURSIVE."""
    return f"""
{name}_nodes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY src) AS i, src, list(dst) AS later FROM {edges} GROUP BY src),
{name}_walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS dropped
  UNION ALL
  SELECT w.i + 1,
         CASE WHEN list_contains(w.dropped, n.src) THEN w.dropped ELSE list_concat(w.dropped, n.later) END
  FROM {name}_walk w JOIN {name}_nodes n ON n.i = w.i + 1),
{name} AS (
  SELECT DISTINCT unnest(dropped) AS uid FROM (SELECT dropped FROM {name}_walk ORDER BY i DESC LIMIT 1)
)"""
