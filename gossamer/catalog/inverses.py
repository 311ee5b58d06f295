"""Approximate inverses (I)."""

import numpy as np
from pyspark.sql import functions as F

from gossamer.catalog import query, with_base
from gossamer.catalog.algebra import rounded
from gossamer.catalog.chains import Chain
from gossamer.functions.dense import pseudo_inverse
from gossamer.operators import algebra as al
from gossamer.operators import inverse as inv
from gossamer.operators.krylov_basis import start_vector
from gossamer.plans.model import InverseOptions, InverseType
from gossamer.session import materialize, prepare
from gossamer.sources import generators as g
from gossamer.sources import tables as t


def dominant(spark, sf_dir):
    return materialize(t.dominant(prepare(spark), sf_dir), "dominant"), materialize(t.part_rows(spark, sf_dir), "rows")


def scaled(spark, sf_dir):
    """(D^-1 d, rows): row-scaled, so its powers stay small."""
    a, rows = dominant(spark, sf_dir)
    d = al.diagonal(a, rows).select("i", (1 / F.col("x")).alias("x"))
    return materialize(al.scale_rows(a, d), "scaled"), rows


#: The row-scaled matrix, T = I less it, and a polynomial's coefficients.
_T = "B AS (SELECT D.i, D.j, v * d AS v FROM D JOIN Jinv ON Jinv.i = D.i)"
COEFFICIENTS = (2.0, -1.5, 0.5, -0.25)


def _grid(spark):
    """A small advection-diffusion matrix, whose Krylov loops are short."""
    prepare(spark)
    return materialize(g.upwind_diffusion_2d(spark, 10, 0.01), "grid"), al.index_set(spark, 100)


def _fitted(order):
    """The Krylov polynomial of the row-scaled matrix from the products of its vectors: (chain, matrix, rows, results of `fitted`)."""
    c = Chain()
    a, rows = c.add("SELECT D.i, D.j, v * d AS v FROM D JOIN Jinv ON Jinv.i = D.i"), c.add("SELECT i FROM part_rows")
    return c, a, rows, *c.fitted(a, c.start_vector(rows), rows, order)


def _coefficient_sql(order):
    c, _, _, row, *_ = _fitted(order)
    return c.sql(c.table(row, order + 1, 6))


def _root_sql(order):
    c, _, _, row, *_ = _fitted(order)
    return c.sql(c.roots(row, order + 1, 6))


def _residual_sql(order, kinds):
    c, *_, miss = _fitted(order)
    return c.sql(" UNION ALL ".join(f"SELECT '{kind}' AS kind, (SELECT round(sqrt(sum(x * x)), 6) FROM {miss}) AS residual" for kind in kinds))


def _polynomial_sql(order):
    c, a, rows, _, row, _ = _fitted(order)
    terms, n = [], c.add("SELECT i, x FROM x")
    for k in range(order + 1):
        terms.append((f"(SELECT c_{k} FROM {row})", n))
        n = c.combine(("1.0", n), ("-1.0", c.spmv(a, n, rows)))
    return c.sql(f"SELECT i, round(x, 6) AS x FROM {c.combine(*terms)}")


def _coefficients(kind, order):
    def run(spark, sf_dir):
        a, rows = scaled(spark, sf_dir)
        return rounded(inv.ApproxInverse.build(a, rows, InverseOptions(kind, order, matrix_free=True)).coefficient_table(), 6)

    return run


query("I1_power_coefficients", _coefficient_sql(3))(_coefficients(InverseType.POWER, 3))
query("I2_arnoldi_coefficients", _coefficient_sql(3))(_coefficients(InverseType.ARNOLDI, 3))
query("I3_newton_roots", _root_sql(3))(_coefficients(InverseType.NEWTON, 3))
query("I4_newton_no_extra", _root_sql(3))(_coefficients(InverseType.NEWTON_NO_EXTRA, 3))


@query(
    "I5_neumann",
    with_base(
        """SELECT m.i, m.j, round(sum(m.v) * any_value(Jinv.d), 9) AS v FROM (
        SELECT i, i AS j, 1.0 AS v FROM part_rows UNION ALL SELECT i, j, v FROM N UNION ALL
        SELECT p.i, p.j, coalesce(q.v, 0.0) FROM pat p LEFT JOIN (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM N a JOIN N b ON b.i = a.j GROUP BY 1, 2) q ON q.i = p.i AND q.j = p.j) m
        JOIN Jinv ON Jinv.i = m.j GROUP BY m.i, m.j""",
        _T + ", N AS (SELECT i, j, sum(v) AS v FROM (SELECT i, i AS j, 1.0 AS v FROM part_rows UNION ALL SELECT i, j, -v FROM B) GROUP BY i, j), pat AS (SELECT i, j FROM N UNION SELECT i, i FROM part_rows)",
    ),
)
def i5(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)
    return rounded(inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.NEUMANN, 2, 1)).matrix, 9)


def _sai_sql(square):
    c = Chain()
    a, pattern = c.add("SELECT i, j, v FROM D"), c.add("SELECT i, j FROM D")
    one = c.add("SELECT i, i AS j, 1.0::DOUBLE AS v FROM part_rows")
    z = c.local_exact(a, pattern, one, 40) if square else c.local_least(a, pattern, one, 40)
    return c.sql(f"SELECT i, j, round(v, 9) AS v FROM {z}")


@query("I6_sai", _sai_sql(False))
def i6(spark, sf_dir):
    return rounded(inv.sai(*dominant(spark, sf_dir), 1), 9)


@query("I7_isai", _sai_sql(True))
def i7(spark, sf_dir):
    return rounded(inv.sai(*dominant(spark, sf_dir), 1, square=True), 9)


@query("I8_jacobi", with_base("SELECT i, i AS j, round(d, 9) AS v FROM Jinv"))
def i8(spark, sf_dir):
    return rounded(inv.jacobi(*dominant(spark, sf_dir), weighted=False), 9)


@query("I8_weighted_jacobi", with_base("SELECT i, i AS j, round(0.75 / (SELECT max(s) FROM (SELECT sum(abs(v) * sqrt(a.d) * sqrt(b.d)) AS s FROM D JOIN Jinv a ON a.i = D.i JOIN Jinv b ON b.i = D.j GROUP BY D.i)) * d, 9) AS v FROM Jinv"))
def i8_weighted(spark, sf_dir):
    return rounded(inv.jacobi(*dominant(spark, sf_dir)), 9)


_APPLY = "y1 AS (SELECT r.i, coalesce(s, 0.0) AS x FROM part_rows r LEFT JOIN (SELECT B.i, sum(v * x) AS s FROM B JOIN x ON x.i = B.j GROUP BY B.i) t ON t.i = r.i), y2 AS (SELECT r.i, coalesce(s, 0.0) AS x FROM part_rows r LEFT JOIN (SELECT B.i, sum(v * x) AS s FROM B JOIN y1 ON y1.i = B.j GROUP BY B.i) t ON t.i = r.i), y3 AS (SELECT r.i, coalesce(s, 0.0) AS x FROM part_rows r LEFT JOIN (SELECT B.i, sum(v * x) AS s FROM B JOIN y2 ON y2.i = B.j GROUP BY B.i) t ON t.i = r.i)"


@query("I9_apply_monomial", with_base("SELECT x.i, round(2.0 * x.x - 1.5 * y1.x + 0.5 * y2.x - 0.25 * y3.x, 6) AS x FROM x JOIN y1 ON y1.i = x.i JOIN y2 ON y2.i = x.i JOIN y3 ON y3.i = x.i", f"{_T}, {_APPLY}"))
def i9(spark, sf_dir):
    a, _ = scaled(spark, sf_dir)
    return rounded(inv.apply_monomial(a, np.array(COEFFICIENTS), t.part_sizes(spark, sf_dir)))


#: T2 = B B on B's pattern, then T3 = T2 B on it again: truncated at every step.
_FIXED = "pat AS MATERIALIZED (SELECT i, j FROM B UNION SELECT i, i FROM part_rows), T2 AS MATERIALIZED (SELECT p.i, p.j, coalesce(v, 0.0) AS v FROM pat p LEFT JOIN (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM B a JOIN B b ON b.i = a.j GROUP BY 1, 2) q ON q.i = p.i AND q.j = p.j), T3 AS (SELECT p.i, p.j, coalesce(v, 0.0) AS v FROM pat p LEFT JOIN (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM T2 a JOIN B b ON b.i = a.j GROUP BY 1, 2) q ON q.i = p.i AND q.j = p.j)"


@query("I10_assembled_fixed", with_base("SELECT i, j, round(sum(v), 9) AS v FROM (SELECT i, i AS j, 2.0 AS v FROM part_rows UNION ALL SELECT i, j, -1.5 * v FROM B UNION ALL SELECT i, j, 0.5 * v FROM T2 UNION ALL SELECT i, j, -0.25 * v FROM T3) GROUP BY i, j", f"{_T}, {_FIXED}"))
def i10(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    return rounded(inv.assemble_monomial(a, rows, np.array(COEFFICIENTS), 1), 9)


@query("I10_assembled_full", with_base("SELECT i, j, round(sum(v), 9) AS v FROM (SELECT i, i AS j, 2.0 AS v FROM part_rows UNION ALL SELECT i, j, -1.5 * v FROM B UNION ALL SELECT a.i, b.j, 0.5 * a.v * b.v FROM B a JOIN B b ON b.i = a.j) GROUP BY i, j", _T))
def i10_full(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    return rounded(inv.assemble_monomial(a, rows, np.array(COEFFICIENTS[:3]), 2), 9)


@query("I11_first_order", with_base("SELECT i, j, round(sum(v), 9) AS v FROM (SELECT i, i AS j, 2.0 AS v FROM part_rows UNION ALL SELECT i, j, -1.5 * v FROM B) GROUP BY i, j", _T))
def i11(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    return rounded(inv.assemble_monomial(a, rows, np.array(COEFFICIENTS[:2]), 1), 9)


@query("I11_diagonal_sparsity", with_base("SELECT i, i AS j, round(2.0 - 1.5 * b + 0.5 * b * b - 0.25 * b * b * b, 9) AS v FROM (SELECT i, v AS b FROM B WHERE i = j)", _T))
def i11_diagonal(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    return rounded(inv.assemble_monomial(a, rows, np.array(COEFFICIENTS), 0), 9)


#: Roots 1.5 and 0.8 +- 0.3i.
ROOTS = np.array([1.5, 0.8 + 0.3j, 0.8 - 0.3j])


@query("I12_apply_newton", with_base("SELECT x.i, round(x.x / 1.5 + (1.6 * (x.x - y1.x / 1.5) - (y1.x - y2.x / 1.5)) / 0.73, 6) AS x FROM x JOIN y1 ON y1.i = x.i JOIN y2 ON y2.i = x.i", f"{_T}, {_APPLY}"))
def i12(spark, sf_dir):
    a, _ = scaled(spark, sf_dir)
    return rounded(inv.apply_newton(a, ROOTS, t.part_sizes(spark, sf_dir)))


@query("I13_newton_residual", with_base("SELECT x.i, round((x.x - y1.x / 1.5) - (1.6 * (y1.x - y2.x / 1.5) - (y2.x - y3.x / 1.5)) / 0.73, 6) AS x FROM x JOIN y1 ON y1.i = x.i JOIN y2 ON y2.i = x.i JOIN y3 ON y3.i = x.i", f"{_T}, {_APPLY}"))
def i13(spark, sf_dir):
    a, _ = scaled(spark, sf_dir)
    return rounded(inv.apply_newton(a, ROOTS, t.part_sizes(spark, sf_dir), residual=True))


@query("I14_assembled_newton", with_base("SELECT i, j, round(sum(v), 9) AS v FROM (SELECT i, i AS j, 1 / 1.5::DOUBLE + 1 / 2.5::DOUBLE AS v FROM part_rows UNION ALL SELECT i, j, -v / 3.75::DOUBLE FROM B) GROUP BY i, j", _T))
def i14(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    return rounded(inv.assemble_newton(a, rows, np.array([1.5, 2.5]), 1), 9)


@query("I14_assembled_newton_pair", with_base("SELECT i, j, round(sum(v), 9) AS v FROM (SELECT i, i AS j, 1.6 / 0.73::DOUBLE AS v FROM part_rows UNION ALL SELECT i, j, -v / 0.73::DOUBLE FROM B) GROUP BY i, j", _T))
def i14_pair(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    return rounded(inv.assemble_newton(a, rows, ROOTS[1:], 1), 9)


@query("I15_diagonal_scaling", with_base("SELECT m.i, m.j, round(sum(m.v) * any_value(Jinv.d), 9) AS v FROM (SELECT i, i AS j, 2.0 AS v FROM part_rows UNION ALL SELECT i, j, -1.5 * v FROM B) m JOIN Jinv ON Jinv.i = m.j GROUP BY m.i, m.j", _T))
def i15(spark, sf_dir):
    a, rows = dominant(spark, sf_dir)
    built = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.ARNOLDI, 1, 1, diag_scale_polys=True), coefficients=np.array(COEFFICIENTS[:2]))
    return rounded(built.matrix, 9)


@query("I16_matvecs", "SELECT 'monomial' AS kind, 3 AS n UNION ALL SELECT 'newton', 2 UNION ALL SELECT 'zero coefficients', 1")
def i16(spark, sf_dir):
    a, rows = _grid(spark)
    free = InverseOptions(InverseType.ARNOLDI, 3, matrix_free=True)
    build = lambda o, c: inv.ApproxInverse.build(a, rows, o, np.array(c)).matvecs()
    found = [("monomial", build(free, COEFFICIENTS)), ("newton", build(InverseOptions(InverseType.NEWTON, 2, matrix_free=True), ROOTS)), ("zero coefficients", build(free, [1.0, 2.0, 0.0, 0.0]))]
    return spark.createDataFrame(found, "kind string, n int")


@query("I17_clamped_order", "SELECT 2 AS poly_order, 2 AS sparsity_order")
def i17(spark, sf_dir):
    a = g.advection_1d(prepare(spark), 3)
    o = inv.ApproxInverse.build(a, al.index_set(spark, 3), InverseOptions(InverseType.NEUMANN, 9, 7)).options
    return spark.createDataFrame([(o.poly_order, o.sparsity_order)], "poly_order int, sparsity_order int")


@query("I19_pseudo_inverse", "SELECT * FROM (VALUES (0, 0, 0.25::DOUBLE), (0, 1, 0.25), (1, 0, 0.25), (1, 1, 0.25)) m(i, j, v)")
def i19(spark, sf_dir):
    p = pseudo_inverse(np.ones((2, 2)))
    return spark.createDataFrame([(i, j, round(float(p[i, j]), 9)) for i in range(2) for j in range(2)], "i int, j int, v double")


@query("I20_reused_coefficients", _coefficient_sql(2))
def i20(spark, sf_dir):
    a, rows = scaled(spark, sf_dir)
    first = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.ARNOLDI, 2, 1, matrix_free=True))  # its coefficients alone are used
    again = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.ARNOLDI, 2, 1), first.coefficients)
    return rounded(again.coefficient_table(), 6)


@query("I2_arnoldi_residual", _residual_sql(3, ("POWER", "ARNOLDI", "NEWTON_NO_EXTRA")))
def arnoldi_residual(spark, sf_dir):
    """Residual norm of each polynomial basis on a random right-hand side; all are the same polynomial."""
    a, rows = scaled(spark, sf_dir)
    b = start_vector(rows)
    found = []
    for kind in (InverseType.POWER, InverseType.ARNOLDI, InverseType.NEWTON_NO_EXTRA):
        m = inv.ApproxInverse.build(a, rows, InverseOptions(kind, 3, matrix_free=True))
        found.append((kind.name, round(al.norm2(al.combine(b, (-1.0, al.spmv(a, m.apply(b))))), 6)))
    return spark.createDataFrame(found, "kind string, residual double")
