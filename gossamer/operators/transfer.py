"""Grid-transfer operators, constraints and the coarse matrix.  Original ids are kept on every level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer.functions.dense import pseudo_inverse
from gossamer.operators import algebra as al
from gossamer.operators.inverse import row_solve, whole_rows
from gossamer.session import materialize, prepare

#: Fixed value: Richardson iterations that smooth a near-nullspace vector.
SMOOTHING = 15


def negate(a: DataFrame) -> DataFrame:
    return a.select("i", "j", (-F.col("v")).alias("v"))


def one_point(afc: DataFrame) -> DataFrame:
    """W that injects each F row from its strongest C column."""
    return al.row_argmax(afc)


def ideal_w(inv_aff: DataFrame, afc: DataFrame, least: float = 0.0) -> DataFrame:
    return al.product(inv_aff, afc, scale=-1.0, least=least, drop_diagonal=1)


def ideal_z(acf: DataFrame, inv_aff: DataFrame, least: float = 0.0) -> DataFrame:
    """least: entries below that part of the row's largest are left out."""
    return al.product(acf, inv_aff, scale=-1.0, least=least, drop_diagonal=1)


def local_z(aff: DataFrame, acf: DataFrame, distance: int = 2, square: bool = True) -> DataFrame:
    """Z by one local solve for each C row, on the pattern of acf aff^(distance - 1); not square is the least-squares form."""
    pattern = acf.select("i", "j")
    for _ in range(distance - 1):
        pattern = al.union_pattern(al.spgemm_pattern(pattern, aff), pattern)
    return row_solve(aff, materialize(pattern, "pattern"), negate(acf), square)


def prolongator(w: DataFrame, coarse: DataFrame) -> DataFrame:
    """[W; I]."""
    return w.select("i", "j", "v").unionByName(al.identity(coarse))


def restrictor(z: DataFrame, coarse: DataFrame) -> DataFrame:
    """[Z I]."""
    return z.select("i", "j", "v").unionByName(al.identity(coarse))


def improve_w(w: DataFrame, aff: DataFrame, afc: DataFrame, d: DataFrame) -> DataFrame:
    """W - D (aff W + afc) on W's pattern; D is the diagonal (i, x) of the approximate inverse."""
    step = al.scale_rows(al.axpy(al.spgemm_restricted(aff, w, w), 1.0, al.restrict_to(afc, w)), d)
    return al.restrict_add(w, step, -1.0)


def improve_z(z: DataFrame, aff: DataFrame, acf: DataFrame, d: DataFrame) -> DataFrame:
    """Z - (Z aff + acf) D on Z's pattern."""
    step = al.scale_cols(al.axpy(al.spgemm_restricted(z, aff, z), 1.0, al.restrict_to(acf, z)), d)
    return al.restrict_add(z, step, -1.0)


def constrain(w: DataFrame, coarse_vectors: DataFrame, fine_vectors: DataFrame) -> DataFrame:
    """W changed least so that W B_c = b_f: each row w -= (w B_c - b_f) pinv(B_c' B_c) B_c' over its own columns.

    Vectors: (i, xs array); with one vector the formula is closed and stays in SQL.
    """
    prepare(w.sparkSession)
    one = coarse_vectors.select(F.size("xs").alias("n")).first()
    right = coarse_vectors.select(F.col("i").alias("j"), F.col("xs").alias("b"))
    joined = w.join(right, "j").join(fine_vectors.select("i", F.col("xs").alias("f")), "i")
    if one is not None and one.n == 1:
        sums = joined.groupBy("i").agg(F.sum(F.col("v") * F.col("b")[0]).alias("t"), F.sum(F.col("b")[0] * F.col("b")[0]).alias("s"), F.first(F.col("f")[0]).alias("g"))
        step = F.when(F.col("s") > 0, (F.col("t") - F.col("g")) / F.col("s")).otherwise(0.0)
        return joined.select("i", "j", "v", "b").join(sums.select("i", step.alias("c")), "i").select("i", "j", (F.col("v") - F.col("c") * F.col("b")[0]).alias("v"))

    names = ("i", "j", "v", "b", "f")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, j, v, b, f in whole_rows(batches, names):
            starts = np.flatnonzero(np.diff(i, prepend=i[0] - 1))
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(i))))
            b, f = np.stack(b), np.stack(f[starts])
            gram = np.add.reduceat(b[:, :, None] * b[:, None, :], starts)
            miss = np.add.reduceat(v[:, None] * b, starts) - f
            step = np.stack([pseudo_inverse(g).T @ m for g, m in zip(gram, miss)])
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(v - (b * step[own]).sum(axis=1))], names=["i", "j", "v"])

    return joined.select(*names).repartition("i").sortWithinPartitions("i").mapInArrow(run, "i long, j long, v double")


def constant_vector(rows: DataFrame) -> DataFrame:
    """The default near-nullspace."""
    return rows.select("i", F.array(F.lit(1.0)).alias("xs"))


def smooth_vector(a: DataFrame, x: DataFrame, transposed: bool = False, iterations: int = SMOOTHING) -> DataFrame:
    """Self-scaled Richardson on a x = 0 (or a' x = 0): x += s r with r = -a x and s = (r, a r) / (a r, a r)."""
    m = al.transpose(a) if transposed else a
    for _ in range(iterations):
        r = materialize(al.combine(al.fill(al.spmv(m, x), x), alpha=-1.0), "residual")
        ar = al.fill(al.spmv(m, r), r).withColumnRenamed("x", "y")
        got = r.join(ar, "i").agg(F.sum(F.col("x") * F.col("y")).alias("top"), F.sum(F.col("y") * F.col("y")).alias("low")).first()
        if not got.low:
            break
        x = materialize(al.combine(x, (got.top / got.low, r)), "vector")
    return x


def moved_columns(a: DataFrame, p: DataFrame) -> DataFrame:
    """a p for a p of at most one entry a row; places may be repeated."""
    return a.join(p.select(F.col("i").alias("j"), F.col("j").alias("c"), F.col("v").alias("w")), "j").select("i", F.col("c").alias("j"), (F.col("v") * F.col("w")).alias("v"))


def coarse_matrix(a: DataFrame, r: DataFrame, p: DataFrame, symmetric: bool = False, a_drop: float = 1e-4, lump: bool = False, pattern: DataFrame | None = None) -> DataFrame:
    """r (a p), or p' a p, without entries below a_drop times the row's largest; or on a stored pattern.

    Where p has at most one entry a row, each entry of a gives at most one of a p, whose repeated places the second product adds up: it is a
    join, and is not written.
    """
    most = p.groupBy("i").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    left, ap = al.transpose(p) if symmetric else r, moved_columns(a, p) if most <= 1 else materialize(al.spgemm(a, p), "ap")
    if pattern is not None:
        return al.restrict(materialize(al.spgemm(left, ap), "coarse"), pattern, lump)
    return al.remove_small(al.spgemm(left, ap), a_drop, relative=1, lump=lump) if lump else al.product(left, ap, least=a_drop)
