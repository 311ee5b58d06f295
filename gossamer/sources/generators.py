"""Matrix generators on spark.range, a mesh reader, and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.functions.randoms import random_int, uniform
from gossamer.operators.algebra import assemble


def _entries(nodes: DataFrame, *entries: tuple[Column, Column, Column]) -> DataFrame:
    """One triple (row, column, value) for each entry whose value is not null; equal places are added up."""
    triples = F.array(*(F.struct(r.cast("long").alias("i"), c.cast("long").alias("j"), v.cast("double").alias("v")) for r, c, v in entries))
    return assemble(nodes.select(F.explode(triples).alias("t")).select("t.*").where("v is not null"))


def advection_1d(spark: SparkSession, n: int) -> DataFrame:
    """Upwind advection: (0, 0, 1), then (r, r - 1, -1) and (r, r, 1)."""
    r = F.col("id")
    return _entries(spark.range(n), (r, r, F.lit(1.0)), (r, r - 1, F.when(r > 0, -1.0)))


def advection_diffusion_2d(spark: SparkSession, m: int, n: int, u: float = 1.0, v: float = 1.0, alpha: float = 0.0) -> DataFrame:
    """Finite differences on an m x n grid of the unit square, node j m + i, advection from the lower left.

    Left and bottom rows are Dirichlet; top and right are upwind outflow without diffusion, else Dirichlet.
    """
    hx, hy = 1.0 / (m - 1), 1.0 / (n - 1)
    ahead, side = alpha * hy / hx, alpha * hx / hy  # diffusion along x and y
    i, j, r = F.pmod(F.col("id"), F.lit(m)), F.floor(F.col("id") / m), F.col("id")
    inflow = (i == 0) | (j == 0)
    edge = inflow | (i == m - 1) | (j == n - 1)
    one = inflow | edge if alpha else inflow
    flow = ~one
    both = flow & F.lit(alpha != 0)
    put = lambda cond, value: F.when(cond, F.lit(float(value)))
    return _entries(
        spark.range(m * n),
        (r, r, put(one, 1)),
        (r, r, put(flow, u * hy + v * hx)), (r, r - m, put(flow, -v * hx)), (r, r - 1, put(flow, -u * hy)),
        (r, r, put(both, 2 * (ahead + side))), (r, r - m, put(both, -side)), (r, r + m, put(both, -side)), (r, r - 1, put(both, -ahead)), (r, r + 1, put(both, -ahead)),
    )


def advection_diffusion_3d(spark: SparkSession, n: int, velocity: tuple[float, float, float] = (1.0, 1.0, 1.0), alpha: float = 0.0) -> DataFrame:
    """The seven-point analogue on n x n x n nodes of the unit cube."""
    h = 1.0 / (n - 1)
    r = F.col("id")
    i, j, k = F.pmod(r, F.lit(n)), F.pmod(F.floor(r / n), F.lit(n)), F.floor(r / (n * n))
    inflow = (i == 0) | (j == 0) | (k == 0)
    edge = inflow | (i == n - 1) | (j == n - 1) | (k == n - 1)
    one = edge if alpha else inflow
    flow, both = ~one, ~one & F.lit(alpha != 0)
    put = lambda cond, value: F.when(cond, F.lit(float(value)))
    steps = (1, n, n * n)
    entries = [(r, r, put(one, 1)), (r, r, put(flow, sum(velocity) * h * h)), (r, r, put(both, 6 * alpha * h))]
    entries += [(r, r - s, put(flow, -c * h * h)) for s, c in zip(steps, velocity)]
    entries += [(r, r + d * s, put(both, -alpha * h)) for s in steps for d in (-1, 1)]
    return _entries(spark.range(n**3), *entries)


def laplacian_2d(spark: SparkSession, n: int) -> DataFrame:
    """Centre 4, neighbours -1."""
    return stencil_2d(spark, n, 4.0, -1.0, -1.0, -1.0, -1.0)


def upwind_2d(spark: SparkSession, n: int) -> DataFrame:
    """Centre 2 / h, west and south -1 / h."""
    h = 1.0 / (n + 1)
    return stencil_2d(spark, n, 2 / h, -1 / h, None, -1 / h, None)


def upwind_diffusion_2d(spark: SparkSession, n: int, eps: float = 1e-4) -> DataFrame:
    """Diagonal 4 e / h^2 + 1 / h, west -e / h^2 - 1 / h, the other neighbours -e / h^2."""
    h = 1.0 / (n + 1)
    d = eps / h**2
    return stencil_2d(spark, n, 4 * d + 1 / h, -d - 1 / h, -d, -d, -d)


def stencil_2d(spark: SparkSession, n: int, centre: float, west: float | None, east: float | None, south: float | None, north: float | None) -> DataFrame:
    """A constant stencil on n x n nodes; neighbours outside are left out."""
    r = F.col("id")
    i, j = F.pmod(r, F.lit(n)), F.floor(r / n)
    put = lambda cond, value: F.when(cond, F.lit(value)) if value is not None else F.lit(None)
    return _entries(spark.range(n * n), (r, r, F.lit(centre)), (r, r - 1, put(i > 0, west)), (r, r + 1, put(i < n - 1, east)), (r, r - n, put(j > 0, south)), (r, r + n, put(j < n - 1, north)))


def random_dominant(spark: SparkSession, n: int, per_row: int = 9) -> DataFrame:
    """per_row random entries of [0, 1) at random columns (equal places added up) and 2 on the diagonal."""
    k = spark.range(n * per_row)
    row, salted = F.floor(F.col("id") / per_row), F.col("id")
    return _entries(k, (row, F.pmod(random_int(salted, "c"), F.lit(n)), uniform(salted, "v")), (row, row, F.when(F.pmod(salted, F.lit(per_row)) == 0, 2.0)))


def diagonal_matrix(spark: SparkSession, n: int, value: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(float(value)).alias("v"))


def read_msh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, x, y; triangles: a, b, c) of a gmsh 4.1 text file.

    The format is a sequence whose lines mean something by their place after section and block heads, so the (small) file is
    read in order on the driver; the graph built from it is not.
    """
    lines = iter([r.value for r in spark.read.text(path, wholetext=True).collect()][0].split("\n"))
    nodes, triangles = [], []
    for line in lines:
        head = line.strip()
        if head == "$MeshFormat" and not next(lines).startswith("4.1"):
            raise ValueError("format 4.1 is read")
        elif head == "$Nodes":
            for _ in range(int(next(lines).split()[0])):
                count = int(next(lines).split()[3])
                tags = [int(next(lines)) for _ in range(count)]
                nodes += [(t, *map(float, next(lines).split()[:2])) for t in tags]
        elif head == "$Elements":
            for _ in range(int(next(lines).split()[0])):
                _, _, kind, count = map(int, next(lines).split())
                rows = [list(map(int, next(lines).split())) for _ in range(count)]
                triangles += [tuple(r[1:4]) for r in rows if kind == 2]
    return spark.createDataFrame(nodes, "id long, x double, y double"), spark.createDataFrame(triangles, "a long, b long, c long")


def upwind_graph(nodes: DataFrame, triangles: DataFrame, velocity: tuple[float, float] = (1.0, 0.6)) -> DataFrame:
    """Upwind operator of a triangle mesh: off the diagonal -w for neighbours upstream, w the cosine between edge and flow; diagonal the sum of w, or 1."""
    size = (velocity[0] ** 2 + velocity[1] ** 2) ** 0.5
    if not size:
        raise ValueError("the velocity is zero")
    sides = F.explode(F.array(*(F.struct(F.col(p).alias("i"), F.col(q).alias("j")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "b"), ("a", "c")))))
    edges = triangles.select(sides.alias("e")).select("e.*").distinct()
    places = edges.join(nodes.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), "i").join(nodes.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")), "j")
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    flow = places.select("i", "j", (dx * velocity[0] / size + dy * velocity[1] / size).alias("f"), (dx * dx + dy * dy).alias("d2")).where("d2 >= 1e-14 and f > 0")
    w = flow.select("i", "j", (F.col("f") / F.sqrt("d2")).alias("w"))
    sums = nodes.select(F.col("id").alias("i")).join(w.groupBy("i").agg(F.sum("w").alias("s")), "i", "left")
    return w.select("i", "j", (-F.col("w")).alias("v")).unionByName(sums.select("i", F.col("i").alias("j"), F.coalesce("s", F.lit(1.0)).alias("v")))


def triangle_grid(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of the unit square cut in 2 (n - 1)^2 triangles."""
    i, j = F.pmod(F.col("id"), F.lit(n)), F.floor(F.col("id") / n)
    nodes = spark.range(n * n).select("id", (i / (n - 1)).alias("x"), (j / (n - 1)).alias("y"))
    cells = spark.range(n * n).where((i < n - 1) & (j < n - 1))
    r = F.col("id")
    halves = F.explode(F.array(F.struct(r.alias("a"), (r + 1).alias("b"), (r + n).alias("c")), F.struct((r + 1).alias("a"), (r + n + 1).alias("b"), (r + n).alias("c"))))
    return nodes, cells.select(halves.alias("t")).select("t.*")


def load_matrix(spark: SparkSession, path: str, i: str = "i", j: str = "j", v: str = "v") -> DataFrame:
    """A matrix from a Parquet table of triples."""
    return assemble(spark.read.parquet(path).select(F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j"), F.col(v).cast("double").alias("v")))


def store(df: DataFrame, path: str) -> None:
    """A matrix or vector as a Parquet table."""
    df.write.mode("overwrite").parquet(path)
