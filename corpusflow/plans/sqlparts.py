"""Building blocks for the DuckDB oracle SQL (plain window SQL, no tricks)."""

from __future__ import annotations

from corpusflow.functions.hashing import sql_order, sql_uniform  # noqa: F401


def quota_cte(name: str, counts: str, label: str, count_col: str, frac_sql: str) -> str:
    """CTE ``name(label, quota)``: largest-remainder stratified quota."""
    return f"""{name}_a AS (
  SELECT {label}, {count_col} AS c, SUM({count_col}) OVER () AS n_all,
         CAST(CEIL(({frac_sql}) * SUM({count_col}) OVER ()) AS BIGINT) AS t FROM {counts}),
{name}_b AS (
  SELECT *, CAST(FLOOR(t * c / n_all) AS BIGINT) AS base, (t * c) % n_all AS rem FROM {name}_a),
{name} AS (
  SELECT {label}, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rem DESC, {label}) <= t - SUM(base) OVER ()
                              THEN 1 ELSE 0 END AS quota FROM {name}_b)"""
