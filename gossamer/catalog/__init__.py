"""Registered queries, named by inventory id, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame, and SQL over the same tables."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql.strip()
        return f

    return add


#: Common table expressions: the same relations as gossamer.sources.tables.
BASE = """
hops AS (SELECT l_partkey AS i, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS j, l_quantity AS q FROM lineitem),
A AS (SELECT i, j, sum(q) AS v FROM hops WHERE j IS NOT NULL GROUP BY i, j),
part_rows AS (SELECT p_partkey AS i FROM part),
x AS (SELECT p_partkey AS i, p_size::DOUBLE AS x FROM part),
cf AS (SELECT p_partkey AS i, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS cf FROM part),
fine AS (SELECT i FROM cf WHERE cf = -1),
coarse AS (SELECT i FROM cf WHERE cf = 1),
D AS (SELECT i, j, -v AS v FROM A WHERE i <> j
      UNION ALL SELECT r.i, r.i, 1.0 + coalesce(s, 0.0) FROM part_rows r LEFT JOIN (SELECT i, sum(v) AS s FROM A WHERE i <> j GROUP BY i) t USING (i)),
S AS (SELECT i, j FROM (SELECT *, max(CASE WHEN i <> j THEN abs(v) END) OVER (PARTITION BY i) AS m FROM A) WHERE i <> j AND abs(v) >= 0.5 * m),
SS AS (SELECT i, j FROM S UNION SELECT j, i FROM S),
ratios AS (SELECT f.i, CASE WHEN own > 0 THEN coalesce(off, 0.0) / own ELSE 0.0 END AS ratio FROM fine f LEFT JOIN
      (SELECT i, sum(CASE WHEN i <> j THEN abs(v) END) AS off, max(CASE WHEN i = j THEN abs(v) END) AS own FROM D
       WHERE i IN (SELECT i FROM fine) AND j IN (SELECT i FROM fine) GROUP BY i) t USING (i)),
Jinv AS (SELECT i, 1.0 / v AS d FROM D WHERE i = j)
"""


def with_base(body: str, more: str = "") -> str:
    return f"WITH {BASE.strip()}{', ' + more.strip() if more else ''}\n{body.strip()}"


def load() -> None:
    """Imports the modules that register queries."""
    from gossamer.catalog import algebra, graphs, inverses, sources, transfers  # noqa: F401
