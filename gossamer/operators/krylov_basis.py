"""Krylov bases over distributed vectors; only small dense matrices reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.dense import least_squares, triangle
from gossamer.functions.randoms import gaussian
from gossamer.operators.algebra import norm2, spmv
from gossamer.operators.blocked import Stored
from gossamer.session import materialize, prepare

TINY = 1e-14
#: Triangles that are stacked in one step.
FAN = 32
#: Below this share of its square the norm of what is left of a vector is measured, not taken from the sums.
CANCELLED = 1e-10


def start_vector(rows: DataFrame, salt: str = "start") -> DataFrame:
    """A Gaussian right-hand side that depends on the ids alone."""
    return rows.select("i", gaussian(F.col("i"), salt).alias("x"))


def tsqr(columns: DataFrame, names: list[str]) -> np.ndarray:
    """R, with a positive diagonal, of the QR factorisation of the named columns.

    Each partition is reduced to a small triangle as its batches come; FAN neighbouring triangles are stacked and reduced at a time,
    in the order of the partitions, until one is left.
    """
    prepare(columns.sparkSession)
    n = len(names)

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        r = np.zeros((0, n))
        for batch in batches:
            r = triangle(np.vstack((r, batch.to_numpy(float))))
        if len(r):
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "r": [r.ravel().tolist()]})

    def stacked(group: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.vstack([np.array(x).reshape(n, n) for x in group.sort_values("part")["r"]]))
        return pd.DataFrame({"part": [int(group["part"].iloc[0]) // FAN], "r": [r.ravel().tolist()]})

    kinds = "part int, r array<double>"
    blocks, parts = columns.select(*names).mapInPandas(triangles, kinds), columns.rdd.getNumPartitions()
    while parts > 1:
        blocks, parts = blocks.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(stacked, kinds), -(-parts // FAN)
    got = blocks.collect()  # one triangle at most
    return triangle(np.array(got[0].r).reshape(n, n) if got else np.zeros((n, n)))


def wide(vectors: list[DataFrame]) -> DataFrame:
    """(i, x0, x1, ...) of vectors (i, x), in one shuffle; rows that a vector lacks are 0."""
    parts = [v.select("i", F.lit(k).alias("k"), "x") for k, v in enumerate(vectors)]
    return reduce(DataFrame.unionByName, parts).groupBy("i").agg(*(F.coalesce(F.sum(F.when(F.col("k") == k, F.col("x"))), F.lit(0.0)).alias(f"x{k}") for k in range(len(vectors))))


def powers(a: DataFrame | Stored, b: DataFrame, order: int) -> DataFrame:
    """(i, x0, ..., x_order): b, a b, ..., a^order b.  Each vector is written once."""
    vectors = [materialize(b.select("i", "x"), "power")]
    for _ in range(order):
        vectors.append(materialize(spmv(a, vectors[-1]), "power"))
    return materialize(wide(vectors), "powers")


class Basis:
    """Vectors (i, x) of a Krylov space, each written once, and their products with each other."""

    def __init__(self, first: DataFrame):
        self.vectors = [materialize(first.select("i", "x"), "basis")]
        self.gram = np.zeros((1, 1))

    def append(self, v: DataFrame) -> None:
        self.vectors.append(materialize(v.select("i", "x"), "basis"))
        n = len(self.vectors)
        self.gram = np.pad(self.gram, (0, n - len(self.gram)))

    def split(self, w: DataFrame) -> tuple[DataFrame, np.ndarray, float]:
        """(what is left of w without its parts along the basis, those parts, the norm of what is left).

        One reduction gives the products of w, and of the newest vector, with all others.  The parts solve the normal equations
        of the vectors as they are, so a basis that is not quite orthonormal does no harm.
        """
        n = len(self.vectors)
        newest = self.vectors[-1].withColumnRenamed("x", "y")
        beside = w.withColumnRenamed("x", "w").join(newest, "i", "full").select("i", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("y", F.lit(0.0)).alias("y"))
        every = reduce(DataFrame.unionByName, [v.select("i", "x", F.lit(k).alias("k")) for k, v in enumerate([*self.vectors, w])])
        got = {r.k: r for r in every.join(beside, "i").groupBy("k").agg(F.sum(F.col("x") * F.col("w")).alias("d"), F.sum(F.col("x") * F.col("y")).alias("g")).collect()}  # a row for each vector
        value = lambda k, c: float(got[k][c]) if k in got else 0.0
        self.gram[n - 1, :] = self.gram[:, n - 1] = [value(k, "g") for k in range(n)]
        d, square = np.array([value(k, "d") for k in range(n)]), value(n, "d")
        parts = least_squares(self.gram, d)  # also of a singular one
        left = square - 2 * parts @ d + parts @ self.gram @ parts
        rest = total([w, *self.vectors], [1.0, *(-parts)])
        if left <= CANCELLED * square:
            rest = materialize(rest, "left")
            return rest, parts, norm2(rest)
        return rest, parts, float(left) ** 0.5


def total(vectors: list[DataFrame], weights: list[float]) -> DataFrame:
    """The weighted sum of vectors, in one shuffle."""
    parts = [v.select("i", (F.lit(float(c)) * F.col("x")).alias("x")) for c, v in zip(weights, vectors)]
    return reduce(DataFrame.unionByName, parts).groupBy("i").agg(F.sum("x").alias("x"))


def arnoldi(a: DataFrame | Stored, b: DataFrame, steps: int) -> tuple[np.ndarray, float, Basis]:
    """(Hessenberg matrix of steps + 1 rows, norm of b, basis) by classical Gram-Schmidt with all products in one reduction.

    Fewer columns come back after a lucky breakdown.
    """
    beta = norm2(b)
    h = np.zeros((steps + 1, steps))
    if not beta:
        return h[:1, :0], beta, Basis(b)
    basis = Basis(b.select("i", (F.col("x") / beta).alias("x")))
    for k in range(steps):
        w = materialize(spmv(a, basis.vectors[-1]), "arnoldi")
        rest, h[: k + 1, k], norm = basis.split(w)
        h[k + 1, k] = norm
        if norm <= TINY * max(1.0, np.abs(h[: k + 1, k]).max()):
            return h[: k + 2, : k + 1], beta, basis
        if k + 1 < steps:
            basis.append(rest.select("i", (F.col("x") / norm).alias("x")))
    return h, beta, basis
