"""Sources, sinks and generators (S)."""

import numpy as np
from pyspark.sql import functions as F

from gossamer.catalog import query
from gossamer.session import fresh
from gossamer.sources import binary
from gossamer.sources import generators as g
from gossamer.sources import tables as t


def _round(df, digits=9):
    return df.select("i", "j", F.round("v", digits).alias("v"))


@query("S1_load_matrix", "SELECT l_partkey AS i, l_suppkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def load_matrix(spark, sf_dir):
    return g.load_matrix(spark, f"{sf_dir}/lineitem.parquet", "l_partkey", "l_suppkey", "l_quantity")


@query("S2_advection_1d", "SELECT r AS i, r AS j, 1.0::DOUBLE AS v FROM range(1000) t(r) UNION ALL SELECT r, r - 1, -1.0::DOUBLE FROM range(1, 1000) t(r)")
def advection_1d(spark, sf_dir):
    return g.advection_1d(spark, 1000)


_GRID = "WITH n AS (SELECT r, r % 40 AS i, r // 40 AS j FROM range(1600) t(r))"


@query(
    "S3_advection_2d",
    _GRID + """, e AS (
    SELECT r AS i, r AS j, 1.0 AS v FROM n WHERE i = 0 OR j = 0
    UNION ALL SELECT r, r, 1.0 / 39 + 1.0 / 39 FROM n WHERE i > 0 AND j > 0
    UNION ALL SELECT r, r - 40, -1.0 / 39 FROM n WHERE i > 0 AND j > 0
    UNION ALL SELECT r, r - 1, -1.0 / 39 FROM n WHERE i > 0 AND j > 0)
    SELECT i, j, round(sum(v::DOUBLE), 9) AS v FROM e GROUP BY 1, 2""",
)
def advection_2d(spark, sf_dir):
    return _round(g.advection_diffusion_2d(spark, 40, 40))


@query(
    "S3_advection_diffusion_2d",
    _GRID + """, e AS (
    SELECT r AS i, r AS j, 1.0::DOUBLE AS v FROM n WHERE i IN (0, 39) OR j IN (0, 39)
    UNION ALL SELECT r, r, 3.0 / 39 + 4 * 0.5 FROM n WHERE i BETWEEN 1 AND 38 AND j BETWEEN 1 AND 38
    UNION ALL SELECT r, r - 40, -1.0 / 39 - 0.5 FROM n WHERE i BETWEEN 1 AND 38 AND j BETWEEN 1 AND 38
    UNION ALL SELECT r, r - 1, -2.0 / 39 - 0.5 FROM n WHERE i BETWEEN 1 AND 38 AND j BETWEEN 1 AND 38
    UNION ALL SELECT r, r + 40, -0.5 FROM n WHERE i BETWEEN 1 AND 38 AND j BETWEEN 1 AND 38
    UNION ALL SELECT r, r + 1, -0.5 FROM n WHERE i BETWEEN 1 AND 38 AND j BETWEEN 1 AND 38)
    SELECT i, j, round(sum(v), 9) AS v FROM e GROUP BY 1, 2""",
)
def advection_diffusion_2d(spark, sf_dir):
    return _round(g.advection_diffusion_2d(spark, 40, 40, u=2.0, v=1.0, alpha=0.5))


@query(
    "S3_advection_diffusion_3d",
    """WITH n AS (SELECT r, r % 12 AS i, r // 12 % 12 AS j, r // 144 AS k FROM range(1728) t(r)),
    b AS (SELECT *, i IN (0, 11) OR j IN (0, 11) OR k IN (0, 11) AS edge FROM n), e AS (
    SELECT r AS i, r AS j, 1.0::DOUBLE AS v FROM b WHERE edge
    UNION ALL SELECT r, r, 3.0 / 121 + 6 * 0.1 / 11 FROM b WHERE NOT edge
    UNION ALL SELECT r, r - s, -1.0 / 121 - 0.1 / 11 FROM b, (VALUES (1), (12), (144)) t(s) WHERE NOT edge
    UNION ALL SELECT r, r + s, -0.1 / 11 FROM b, (VALUES (1), (12), (144)) t(s) WHERE NOT edge)
    SELECT i, j, round(sum(v), 9) AS v FROM e GROUP BY 1, 2""",
)
def advection_diffusion_3d(spark, sf_dir):
    return _round(g.advection_diffusion_3d(spark, 12, alpha=0.1))


def _stencil(n, centre, west, east, south, north):
    parts = [f"SELECT r AS i, r AS j, ({centre})::DOUBLE AS v FROM n"]
    for value, step, cond in ((west, -1, "i > 0"), (east, 1, f"i < {n - 1}"), (south, -n, "j > 0"), (north, n, f"j < {n - 1}")):
        if value is not None:
            parts.append(f"SELECT r, r + ({step}), ({value})::DOUBLE FROM n WHERE {cond}")
    return f"WITH n AS (SELECT r, r % {n} AS i, r // {n} AS j FROM range({n * n}) t(r)), e AS (" + " UNION ALL ".join(parts) + ") SELECT i, j, round(v, 9) AS v FROM e"


@query("S4_laplacian_2d", _stencil(50, 4, -1, -1, -1, -1))
def laplacian_2d(spark, sf_dir):
    return g.laplacian_2d(spark, 50)


@query("S4_upwind_2d", _stencil(40, 82, -41, None, -41, None))
def upwind_2d(spark, sf_dir):
    return _round(g.upwind_2d(spark, 40))


@query("S4_upwind_diffusion_2d", _stencil(50, "4 * 1e-4 * 51 * 51 + 51", "-1e-4 * 51 * 51 - 51", *["-1e-4 * 51 * 51"] * 3))
def upwind_diffusion_2d(spark, sf_dir):
    return _round(g.upwind_diffusion_2d(spark, 50))


@query(
    "S5_upwind_graph",
    """WITH nodes AS (SELECT r AS id, (r % 30) / 29.0::DOUBLE AS x, (r // 30) / 29.0::DOUBLE AS y FROM range(900) t(r)),
    steps(di, dj) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1)),
    f AS (SELECT a.id AS i, b.id AS j, ((a.x - b.x) * 1.0 + (a.y - b.y) * 0.6) / sqrt(1.36) AS f, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2
          FROM nodes a, steps, nodes b WHERE a.id % 30 + di BETWEEN 0 AND 29 AND a.id // 30 + dj BETWEEN 0 AND 29 AND b.id = a.id + di + 30 * dj),
    w AS (SELECT i, j, f / sqrt(d2) AS w FROM f WHERE f > 0)
    SELECT i, j, round(-w, 9) AS v FROM w
    UNION ALL SELECT id, id, round(coalesce((SELECT sum(w) FROM w WHERE i = id), 1.0), 9) FROM nodes""",
)
def upwind_graph(spark, sf_dir):
    return _round(g.upwind_graph(*g.triangle_grid(spark, 30)))


@query(
    "S7_random_dominant",
    """WITH k AS (SELECT r, r // 9 AS i, ('0x' || substr(md5(r::VARCHAR || 'c'), 1, 8))::BIGINT % 500 AS j, ('0x' || substr(md5(r::VARCHAR || 'v'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM range(4500) t(r)),
    e AS (SELECT i, j, v FROM k UNION ALL SELECT i, i, 2.0 FROM k WHERE r % 9 = 0)
    SELECT i, j, round(sum(v), 9) AS v FROM e GROUP BY i, j""",
)
def random_dominant(spark, sf_dir):
    return _round(g.random_dominant(spark, 500))


@query("S8_store", "SELECT r AS i, r AS j, 1.0::DOUBLE AS v FROM range(1000) t(r) UNION ALL SELECT r, r - 1, -1.0::DOUBLE FROM range(1, 1000) t(r)")
def store(spark, sf_dir):
    path = fresh(spark, "stored-matrix")
    g.store(g.advection_1d(spark, 1000), path)
    return g.load_matrix(spark, path)


@query("S1_binary_matrix", "SELECT r AS i, r AS j, 1.0::DOUBLE AS v FROM range(1000) t(r) UNION ALL SELECT r, r - 1, -1.0::DOUBLE FROM range(1, 1000) t(r)")
def binary_matrix(spark, sf_dir):
    """A binary file, made here, is read in ranges of rows."""
    n = 1000
    i, j = np.concatenate((np.arange(n), np.arange(1, n))), np.concatenate((np.arange(n), np.arange(n - 1)))
    path = fresh(spark, "matrix")
    binary.write_bytes(path, binary.matrix_bytes(i, j, np.where(i == j, 1.0, -1.0), n, n))
    return binary.read_matrix(spark, path, rows=300)[0]
