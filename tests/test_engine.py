"""Dense NumPy oracles and invariants for the operators that SQL cannot express."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gossamer.functions.dense import modified_leja, pseudo_inverse, triangle
from gossamer.operators import algebra as al
from gossamer.operators import inverse as inv
from gossamer.operators import luby
from gossamer.operators import splitting as sp
from gossamer.operators import transfer as tr
from gossamer.operators.ordered import first_of_all
from gossamer.operators.krylov_basis import arnoldi, powers, start_vector, tsqr, wide
from gossamer.operators.strength import strength
from gossamer.plans import krylov
from gossamer.plans.model import InverseOptions, InverseType, Options, SparseMatrix, SparseVector, SplittingType, ZType
from gossamer.plans.multigrid import Hierarchy, fingerprint
from gossamer.sources import generators as g


def dense(df, n, m=None):
    a = np.zeros((n, m or n))
    for r in df.collect():
        a[r.i, r.j] += r.v
    return a


def vector(df, n):
    x = np.full(n, np.nan)
    for r in df.collect():
        x[r.i] = r.x
    return x


@pytest.fixture(scope="module")
def grid(spark):
    """(matrix, rows, dense) of a 6 x 6 advection-diffusion grid."""
    from gossamer.session import materialize, prepare

    prepare(spark)
    a = materialize(g.upwind_diffusion_2d(spark, 6, 0.05), "grid")
    return a, al.index_set(spark, 36), dense(a, 36)


# --- model and algebra


def test_wrapper_operators(spark):
    a = SparseMatrix.from_triples(spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (-1, 0, 9.0), (1, 0, 4.0)], "i long, j long, v double"), 3, 3)
    assert a.nnz == 2
    x = SparseVector(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, x double"), 3)
    assert vector((a @ x).df, 3).tolist() == [3, 4, 0]  # the empty row is there
    assert dense((a @ a).df, 3)[1, 0] == 12 and dense((a - a.T).df, 3)[0, 1] == -4
    with pytest.raises(ValueError):
        a @ SparseMatrix(a.df, 2, 3)
    with pytest.raises(ValueError):
        al.remove_small(a.df, 1.0, lump=True, drop_diagonal=1)


def test_explicit_zeros_and_empty(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    rows = al.index_set(spark, 3)
    assert al.spgemm(empty, empty).count() == 0 and al.with_diagonal(empty, rows).count() == 3
    assert al.dominance(empty, rows).where("ratio = 0").count() == 3
    assert al.renumber(empty.select("i")).count() == 0
    assert strength(empty, 0.5).count() == 0
    zeros = spark.createDataFrame([(0, 1, 0.0), (0, 0, 1.0)], "i long, j long, v double")
    assert al.restrict(zeros, zeros).count() == 2


def test_renumbering_counts_over_partitions(spark):
    rows = spark.range(0, 3000, 3).withColumnRenamed("id", "i").repartition(7)
    assert {r.i: r.k for r in al.renumber(rows).collect()} == {i: k for k, i in enumerate(range(0, 3000, 3))}


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 8), st.integers(1, 5), st.integers(0, 1000))
def test_triangle_is_unique(n, m, seed):
    a = np.random.default_rng(seed).normal(size=(n + m, m))
    r = triangle(a)
    assert np.allclose(r.T @ r, a.T @ a) and (np.diag(r) >= 0).all()
    assert np.allclose(triangle(np.vstack((triangle(a[: n // 2]), a[n // 2 :]))), r)


def test_tsqr_and_pseudo_inverse(spark):
    a = np.random.default_rng(0).normal(size=(500, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in a], "a double, b double, c double").repartition(5)
    assert np.allclose(tsqr(df, ["a", "b", "c"]), triangle(a))
    singular = np.array([[1.0, 2.0], [2.0, 4.0]])
    assert np.allclose(singular @ pseudo_inverse(singular) @ singular, singular)


def test_generators(spark):
    a = dense(g.advection_diffusion_2d(spark, 5, 4), 20)
    assert np.allclose(a.sum(axis=1)[[6, 7, 8, 9, 13, 19]], 0) and a[0, 0] == 1  # outflow rows keep the upwind stencil
    b = dense(g.advection_diffusion_2d(spark, 5, 5, alpha=1.0), 25)
    assert b[24, 24] == 1 and b[12].sum() == pytest.approx(0) and (b[12] != 0).sum() == 5
    c = dense(g.advection_diffusion_3d(spark, 4, alpha=0.5), 64)
    assert (c[21] != 0).sum() == 7 and c[21].sum() == pytest.approx(0)
    d = dense(g.random_dominant(spark, 25), 25)
    assert (np.diag(d) >= 2).all()
    assert np.array_equal(dense(g.diagonal_matrix(spark, 4, 3.0), 4), 3 * np.eye(4))


def test_mesh_reader(spark, tmp_path):
    nodes = "0 0 0|1 0 0|0 1 0|1 1 0".split("|")
    text = "$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 4 1 4\n2 1 0 4\n1\n2\n3\n4\n" + "\n".join(nodes) + "\n$EndNodes\n$Elements\n2 3 1 3\n1 1 1 1\n1 1 2\n2 1 2 2\n2 1 2 3\n3 2 4 3\n$EndElements\n"
    (tmp_path / "m.msh").write_text(text)
    points, triangles = g.read_msh(spark, str(tmp_path / "m.msh"))
    assert points.count() == 4 and triangles.count() == 2
    a = {(r.i, r.j): r.v for r in g.upwind_graph(points, triangles).collect()}
    assert a[1, 1] == 1.0 and a[4, 4] == pytest.approx(-sum(v for (i, j), v in a.items() if i == 4 and j != 4))


# --- splittings


def is_partition(cf, n):
    rows = cf.collect()
    return sorted(r.i for r in rows) == list(range(n)) and {r.cf for r in rows} <= {1, -1}


@pytest.mark.parametrize("kind", list(SplittingType))
def test_splittings_partition_the_rows(spark, grid, kind):
    a, rows, full = grid
    options = {"cr_inverse": InverseOptions(InverseType.JACOBI)} if kind == SplittingType.CR else {}
    cf = sp.compute_cf_splitting(a, rows, strong_threshold=0.6, splitting=kind, **options)
    assert is_partition(cf, 36)
    fine = sorted(r.i for r in sp.fine_set(cf).collect())
    assert 0 < len(fine) < 36
    if kind == SplittingType.DIAG_DOM:
        block = np.abs(full[np.ix_(fine, fine)])
        assert ((block.sum(axis=1) - np.diag(block)) / np.diag(block)).max() < 0.6


def test_independent_set_is_independent_and_maximal(grid):
    a, rows, _ = grid
    s = strength(a, 0.5)
    cf = {r.i: r.cf for r in luby.pmisr(s, rows).collect()}
    edges = [(r.i, r.j) for r in s.collect()]
    assert not [e for e in edges if cf[e[0]] == cf[e[1]] == -1]
    around = {}
    for i, j in edges:
        around.setdefault(i, []).append(j)
    assert all(cf[i] == -1 or any(cf[j] == -1 for j in around[i]) for i in cf)
    with pytest.raises(ValueError):
        luby.pmisr(s, rows, max_steps=0)


def test_isolated_nodes(spark):
    rows, none = al.index_set(spark, 3), spark.createDataFrame([], "i long, j long")
    for pmis in (False, True):
        assert {r.cf for r in luby.pmisr(none, rows, pmis=pmis).collect()} == {-1}
        assert {r.cf for r in luby.pmisr(none, rows, pmis=pmis, zero_measure_c_point=True).collect()} == {1}


def test_splitting_does_not_depend_on_partitions(spark, grid):
    a, rows, _ = grid
    first = {r.i: r.cf for r in sp.compute_cf_splitting(a, rows).collect()}
    again = {r.i: r.cf for r in sp.compute_cf_splitting(a.repartition(5, "j"), rows.repartition(3)).collect()}
    assert first == again


def aggregation_by_hand(around, n, fixed={}):
    """Plain sequential aggregation: cover, enlarge, remnants."""
    cf, root = [fixed.get(i, 0) for i in range(n)], [None] * n
    for i in range(n):
        if not around[i]:
            cf[i] = cf[i] or -1
        elif cf[i] == 0 and all(cf[j] == 0 for j in around[i]):
            cf[i], root[i] = 1, i
            for j in around[i]:
                cf[j], root[j] = -1, i
    first = list(root)
    for i in range(n):
        if cf[i] == 0:
            for j in around[i]:
                if first[j] is not None:
                    cf[i], root[i] = -1, first[j]
                    break
    for i in range(n):
        if cf[i] == 0:
            cf[i], root[i] = 1, i
            for j in around[i]:
                if cf[j] == 0:
                    cf[j], root[j] = -1, i
    return cf, root


def test_aggregation(spark, grid):
    a, _, _ = grid
    n = 40  # four isolated rows
    s = strength(a, 0.5)
    around = [[] for _ in range(n)]
    for r in sorted((r.i, r.j) for r in s.collect()):
        around[r[0]].append(r[1])
    cf, root = aggregation_by_hand(around, n)
    got = {r.i: (r.cf, r.aggregate) for r in sp.aggregate(s, al.index_set(spark, n)).collect()}
    assert got == {i: (cf[i], root[i]) for i in range(n)}


@pytest.mark.parametrize("seed", [0, 1])
def test_aggregation_with_a_boundary(spark, seed):
    """Random symmetric patterns, blocks of ids, and markers that are fixed beforehand."""
    rng, n = np.random.default_rng(seed), 60
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (70, 2)) if a != b}
    edges |= {(b, a) for a, b in edges}
    pattern, rows = spark.createDataFrame(sorted(edges), "i long, j long"), al.index_set(spark, n)
    around = [sorted(j for i, j in edges if i == k) for k in range(n)]
    cf, root = aggregation_by_hand(around, n)
    assert {r.i: (r.cf, r.aggregate) for r in sp.aggregate(pattern, rows).collect()} == {i: (cf[i], root[i]) for i in range(n)}
    size = 20
    inner = [[j for j in around[i] if j // size == i // size] for i in range(n)]
    cf, root = aggregation_by_hand(inner, n)
    assert {r.i: (r.cf, r.aggregate) for r in sp.local_aggregate(pattern, rows, size).collect()} == {i: (cf[i], root[i]) for i in range(n)}
    pmis = {r.i: r.cf for r in luby.pmisr(pattern, rows, pmis=True).collect()}
    fixed = {i: pmis[i] for i in range(n) if len(inner[i]) < len(around[i])}
    cf, root = aggregation_by_hand(inner, n, fixed)
    assert fixed and {r.i: (r.cf, r.aggregate) for r in sp.local_aggregate(pattern, rows, size, pmis_boundary=True).collect()} == {i: (cf[i], root[i]) for i in range(n)}


def test_dominant_submatrix(grid):
    a, rows, full = grid
    sub, fine = sp.diag_dom_submatrix(a, rows, 0.5)
    keep = sorted(r.i for r in fine.collect())
    assert np.array_equal(dense(sub, 36)[np.ix_(keep, keep)], full[np.ix_(keep, keep)])
    assert al.dominance(a, fine).agg(F.max("ratio")).first()[0] < 0.5
    with pytest.raises(ValueError):
        sp.diag_dom_submatrix(a, rows, 1.5)


def test_ddc_options(grid):
    a, rows, _ = grid
    cf = rows.select("i", F.lit(-1).alias("cf"))
    assert sp.ddc(a, cf, 0) is cf
    assert sp.coarse_set(sp.ddc(a, cf, 1.0)).count() == al.dominance(a, rows).where("ratio > 0").count()
    assert sp.coarse_set(sp.ddc(a, cf, -0.5)).count() == al.dominance(a, rows).where("ratio >= 0.5").count()


# --- inverses


def truncated(t, a, pattern):
    return (t @ a) * pattern


def test_arnoldi_basis(grid):
    a, rows, full = grid
    h, beta, basis = arnoldi(a, start_vector(rows), 3)
    v = np.array([[r[f"x{k}"] for k in range(3)] for r in wide(basis.vectors).orderBy("i").collect()])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-10) and np.allclose(v.T @ full @ v, h[:3], atol=1e-8)
    k = powers(a, start_vector(rows), 2).orderBy("i").collect()
    assert np.allclose([r.x2 for r in k], full @ full @ np.array([r.x0 for r in k]))


def test_three_bases_are_one_polynomial(grid):
    a, rows, full = grid
    b = start_vector(rows)
    x = vector(b, 36)
    k = np.stack([np.linalg.matrix_power(full, p) @ x for p in range(1, 5)], axis=1)
    best = np.linalg.norm(x - k @ np.linalg.lstsq(k, x, rcond=None)[0])
    for kind in (InverseType.POWER, InverseType.ARNOLDI, InverseType.NEWTON, InverseType.NEWTON_NO_EXTRA):
        m = inv.ApproxInverse.build(a, rows, InverseOptions(kind, 3, matrix_free=True))
        miss = np.linalg.norm(x - full @ vector(m.apply(b), 36))
        assert miss == pytest.approx(best, abs=1e-8)
        whole = inv.ApproxInverse.build(a, rows, InverseOptions(kind, 3, 3), m.coefficients)  # coefficients used again
        assert np.allclose(vector(whole.apply(b), 36), vector(m.apply(b), 36))


def test_lucky_breakdown_on_a_constant_diagonal(spark):
    rows, a = al.index_set(spark, 10), g.diagonal_matrix(spark, 10, 4.0)
    for kind in (InverseType.POWER, InverseType.ARNOLDI, InverseType.NEWTON):
        m = inv.ApproxInverse.build(a, rows, InverseOptions(kind, 4, matrix_free=True))
        assert np.allclose(vector(m.apply(start_vector(rows)), 10), vector(start_vector(rows), 10) / 4)


def test_fixed_sparsity_truncates_at_every_step(grid):
    a, rows, full = grid
    c = [1.0, 0.5, 0.25, 0.125]
    small = full / np.abs(full).sum()
    scaled = a.withColumn("v", F.col("v") / float(np.abs(full).sum()))
    pattern = (full != 0).astype(float)
    t2 = truncated(small, small, pattern)
    t3 = truncated(t2, small, pattern)
    got = dense(inv.assemble_monomial(scaled, rows, np.array(c), 1), 36)
    assert np.allclose(got, c[0] * np.eye(36) + c[1] * small + c[2] * t2 + c[3] * t3, atol=1e-14)
    wide = (np.linalg.matrix_power(np.abs(full), 2) != 0).astype(float)
    got = dense(inv.assemble_monomial(scaled, rows, np.array(c), 2), 36)
    p2 = small @ small
    assert np.allclose(got, c[0] * np.eye(36) + c[1] * small + c[2] * p2 + c[3] * truncated(p2, small, wide), atol=1e-14)


def test_sparse_inverses(grid):
    a, rows, full = grid
    for square in (True, False):
        got = dense(inv.sai(a, rows, 1, square), 36)
        for i in range(36):
            j = np.flatnonzero(full[i])
            cols = j if square else np.flatnonzero(np.abs(full[j]).sum(axis=0))
            e = (cols == i).astype(float)
            expected = np.linalg.lstsq(full[np.ix_(j, cols)].T, e, rcond=None)[0]
            assert np.allclose(got[i, j], expected)
    with pytest.raises(ValueError):
        inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.SAI, matrix_free=True))


def test_neumann_and_jacobi(spark, grid):
    a, rows, full = grid
    d = np.diag(1 / np.diag(full))
    n = np.eye(36) - d @ full
    m = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.NEUMANN, 3, 3))
    assert np.allclose(dense(m.matrix, 36), (np.eye(36) + n + n @ n + n @ n @ n) @ d)
    free = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.NEUMANN, 3, matrix_free=True))
    b = start_vector(rows)
    assert np.allclose(vector(free.apply(b), 36), vector(m.apply(b), 36))
    s = np.sqrt(np.abs(d))
    w = 3 / (4 * np.abs(s @ full @ s).sum(axis=1).max())
    assert np.allclose(dense(inv.jacobi(a, rows), 36), w * d)
    with pytest.raises(ZeroDivisionError):
        inv.jacobi(spark.createDataFrame([(0, 1, 1.0)], "i long, j long, v double"), al.index_set(spark, 2))


def test_leja_order_and_extra_roots():
    roots = modified_leja(np.array([1, 2, 3 + 1j, 3 - 1j, 10], complex))
    assert roots[0] == 10 and abs(list(roots).index(3 + 1j) - list(roots).index(3 - 1j)) == 1
    assert len(inv.extra_roots(np.array([1.0, 1.1, 1.2], complex))) == 0
    assert len(inv.extra_roots(np.array([1e-6, 1e-5, 1e6], complex))) >= 1


# --- transfer


def test_local_restriction(grid):
    a, rows, full = grid
    cf = {r.i: r.cf for r in sp.compute_cf_splitting(a, rows).collect()}
    f, c = [i for i in cf if cf[i] == -1], [i for i in cf if cf[i] == 1]
    fine, coarse = rows.where(F.col("i").isin(f)), rows.where(F.col("i").isin(c))
    aff, acf = al.submatrix(a, fine, fine), al.submatrix(a, coarse, fine)
    for distance in (1, 2):
        got = dense(tr.local_z(aff, acf, distance), 36)
        for i in c:
            j = np.array(sorted(k for k in f if full[i, k] != 0))
            if distance == 2 and len(j):
                j = np.array(sorted(set(j) | {k for k in f if np.abs(full[np.ix_(j, [k])]).sum() > 0}))
            if len(j):
                assert np.allclose(got[i, j], np.linalg.solve(full[np.ix_(j, j)].T, -full[i, j]))


def test_constraints_reproduce_vectors(spark):
    rng = np.random.default_rng(1)
    w = spark.createDataFrame([(i, 10 + (i * 3 + k) % 8, float(rng.normal())) for i in range(6) for k in range(4)], "i long, j long, v double")
    for n in (1, 2):
        bc, bf = rng.normal(size=(18, n)), rng.normal(size=(6, n))
        coarse = spark.createDataFrame([(10 + k, bc[k].tolist()) for k in range(8)], "i long, xs array<double>")
        fine = spark.createDataFrame([(k, bf[k].tolist()) for k in range(6)], "i long, xs array<double>")
        got = dense(tr.constrain(w, coarse, fine), 6, 18)
        assert np.allclose(got[:, 10:18] @ bc[:8], bf)


def test_ideal_operators_give_the_schur_complement(grid):
    a, rows, full = grid
    cf = {r.i: r.cf for r in sp.compute_cf_splitting(a, rows).collect()}
    f, c = sorted(i for i in cf if cf[i] == -1), sorted(i for i in cf if cf[i] == 1)
    fine, coarse = rows.where(F.col("i").isin(f)), rows.where(F.col("i").isin(c))
    exact = np.linalg.inv(full[np.ix_(f, f)])
    m = rows.sparkSession.createDataFrame([(f[p], f[q], float(exact[p, q])) for p in range(len(f)) for q in range(len(f))], "i long, j long, v double")
    r = tr.restrictor(tr.ideal_z(al.submatrix(a, coarse, fine), m), coarse)
    p = tr.prolongator(tr.one_point(al.submatrix(a, fine, coarse)), coarse)
    got = dense(tr.coarse_matrix(a, r, p, a_drop=0.0), 36)[np.ix_(c, c)]
    assert np.allclose(got, full[np.ix_(c, c)] - full[np.ix_(c, f)] @ exact @ full[np.ix_(f, c)])


# --- multigrid and solvers


def test_multigrid_solves_within_the_cap(spark):
    """An 8 x 8 advection grid with fc smoothing, otherwise default options: at most 3 iterations to 1e-10."""
    n = 8
    a, rows = g.advection_diffusion_2d(spark, n, n), al.index_set(spark, n * n)
    h = Hierarchy.build(a, rows, Options(smooth_type="fc"))
    s = krylov.gmres(a, rows.select("i", F.lit(1.0).alias("x")), h.apply, rtol=1e-10, max_it=3)
    assert s.converged and s.iterations <= 3
    assert np.allclose(vector(s.x, n * n), np.linalg.solve(dense(a, n * n), np.ones(n * n)), atol=1e-8)
    assert h.complexities()["grid"] < 3.0 and h.complexities()["reuse_storage"] == 0
    stats = [tuple(r) for r in h.stats_df().orderBy("level").collect()]
    assert stats[0][1] == n * n and all(x[1] > y[1] for x, y in zip(stats, stats[1:]))


def test_constrained_and_improved_hierarchy_converges(spark):
    a, rows = g.upwind_diffusion_2d(spark, 6, 0.1), al.index_set(spark, 36)
    o = Options(max_levels=2, inverse_type=InverseType.JACOBI, z_type=ZType.LAIR, constrain_w=True, constrain_z=True, improve_w_its=1, improve_z_its=1, one_point_classical_prolong=False, smooth_type="fcf", coarsest_inverse_type=InverseType.NEUMANN, coarsest_poly_order=10, coarsest_inverse_sparsity_order=10)
    h = Hierarchy.build(a, rows, o)
    s = krylov.gmres(a, rows.select("i", F.lit(1.0).alias("x")), h.apply, rtol=1e-5, max_it=12)
    assert s.converged and s.history().count() == s.iterations + 1


def test_reuse_and_freeze(spark):
    a, rows = g.upwind_diffusion_2d(spark, 5, 0.1), al.index_set(spark, 25)
    o = Options(max_levels=2, inverse_type=InverseType.NEUMANN, poly_order=2, coarsest_inverse_type=InverseType.JACOBI, reuse_sparsity=True)
    h = Hierarchy.build(a, rows, o)
    twice = h.rebuild(a.withColumn("v", F.col("v") * 2), rows)
    assert twice.levels[0].cf is h.levels[0].cf and fingerprint(twice.levels[1].a) == fingerprint(h.levels[1].a)
    assert h.rebuild(a, rows, o.with_(r_drop=0.5)).levels[0].cf is not h.levels[0].cf  # other options start anew
    h.frozen = True
    assert h.rebuild(a, rows) is h
    with pytest.raises(ValueError):
        Options(smooth_type="fx").groups()


def test_incomplete_factors_of_a_tridiagonal_matrix_are_exact(spark):
    a = spark.createDataFrame([(i, j, 4.0 if i == j else -1.0 - 0.1 * i) for i in range(8) for j in range(8) if abs(i - j) <= 1], "i long, j long, v double")
    lower, upper = krylov.incomplete_factors(a, al.index_set(spark, 8), 16)
    assert np.allclose(dense(lower, 8) @ dense(upper, 8), dense(a, 8))


def test_one_exact_cycle_solves(spark):
    """With exact inverses and nothing dropped the cycle is a direct solver."""
    a, rows = g.advection_1d(spark, 12), al.index_set(spark, 12)
    o = Options(max_levels=2, r_drop=0.0, a_drop=0.0, inverse_type=InverseType.NEUMANN, poly_order=11, inverse_sparsity_order=11, coarse_eq_limit=1, coarsest_inverse_type=InverseType.NEUMANN, coarsest_poly_order=11, coarsest_inverse_sparsity_order=11)
    b = start_vector(rows)
    x = vector(Hierarchy.build(a, rows, o).apply(b), 12)
    assert np.allclose(dense(a, 12) @ x, vector(b, 12))


def test_graph_partition_keeps_sizes_and_cuts_less(spark):
    """Scattered ids on a grid: parts stay nearly as large, and fewer edges run between them."""
    from gossamer.operators import partition as pt

    n = 24
    a = g.laplacian_2d(spark, n).selectExpr("(i * 253) % 576 as i", "(j * 253) % 576 as j", "v")
    rows = al.index_set(spark, n * n)
    before, after = pt.partition_graph(a, rows, 4, rounds=0), pt.partition_graph(a, rows, 4, rounds=5)
    sizes = sorted(r["count"] for r in after.groupBy("part").count().collect())
    assert len(sizes) == 4 and sizes[0] > 100 and sum(sizes) == n * n
    assert pt.edge_cut(a, after) < 0.8 * pt.edge_cut(a, before)
    spread = pt.repartition(a, after, 4).select("i", F.spark_partition_id().alias("p")).distinct().join(after, "i").groupBy("part").agg(F.count_distinct("p").alias("n")).collect()
    assert all(r.n == 1 for r in spread)


def test_active_parts():
    from gossamer.operators.partition import active_parts

    assert active_parts(8, 10_000, None) == 8 and active_parts(8, 10_000, 3.0) == 8 and active_parts(8, 10_000, 1.5) == 4
    assert active_parts(8, 60, None) == 1 and active_parts(1, 5, None) == 1 and active_parts(8, 390, None) == 2


@pytest.mark.parametrize("wide", [False, True])
def test_binary_files(spark, tmp_path, wide):
    from gossamer.sources import binary

    rng = np.random.default_rng(0)
    cells = sorted({(int(i), int(j)) for i, j in rng.integers(0, 50, (300, 2)) if i % 7})  # some rows are empty
    i, j, v = np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), rng.normal(size=len(cells))
    data = binary.matrix_bytes(i, j, v, 50, 50, wide)
    (tmp_path / "m").write_bytes(data + binary.vector_bytes(np.arange(50) / 2, wide))
    (tmp_path / "m.info").write_text("-matload_block_size 5\n")
    df, n, m = binary.read_matrix(spark, str(tmp_path / "m"), wide, rows=7)
    assert (n, m) == (50, 50) and sorted((r.i, r.j, r.v) for r in df.collect()) == sorted(zip(i.tolist(), j.tolist(), v.tolist()))
    assert sorted((r.i, r.x) for r in binary.read_vector(spark, str(tmp_path / "m"), wide, rows=9, at=len(data)).collect()) == [(k, k / 2) for k in range(50)]
    assert binary.block_size(str(tmp_path / "m")) == 5 and binary.block_size(str(tmp_path / "none")) == 1
    with pytest.raises(ValueError):
        binary.read_vector(spark, str(tmp_path / "m"), wide)


def test_logs_are_read_back():
    from gossamer.plans.log import facts

    text = """
~~~~~~~~~~~~ Level           1
 Global rows         64 Global F-points         40 Global C-points         24
 ~~~~~~~~~~~~ Coarse grid           2
 Global rows         24
 Grid complexity            :    1.375
 Reuse storage complexity   :    0.0
 proc agglom time :   0.25
 Total cumulative setup time :   1.5
   0 KSP Residual norm 8.000000000000e+00
   1 KSP Residual norm 1.5e-11 """
    assert facts(text) == [("rows", 1, 64.0), ("fine", 1, 40.0), ("coarse", 1, 24.0), ("rows", 2, 24.0), ("grid complexity", None, 1.375), ("reuse storage complexity", None, 0.0), ("proc agglom time", None, 0.25), ("setup time", None, 1.5), ("residual", 0, 8.0), ("residual", 1, 1.5e-11)]


def test_restricted_products_stay_in_their_tasks(spark):
    """One way for rows of any width: products are looked up where they are made; rows of many entries are divided."""
    a = g.upwind_diffusion_2d(spark, 8)
    hub = spark.range(64).selectExpr("0L as i", "id as j", "1.0D as v")
    a = al.axpy(a, 1.0, hub)
    pattern = a.select("i", "j").union(al.identity(al.index_set(spark, 70)).select("i", "j")).distinct()
    whole = {(r.i, r.j): r.v for r in al.spgemm(a, a).collect()}
    expected = {(r.i, r.j): whole.get((r.i, r.j), 0.0) for r in pattern.collect()}
    for entries in (200_000, 20, 1):
        got = [(r.i, r.j, r.v) for r in al.spgemm_restricted(a, a, pattern, entries).collect()]
        assert len(got) == len(expected) and all(abs(v - expected[i, j]) < 1e-9 for i, j, v in got)
    plan = al.spgemm_restricted(a, a, pattern)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("FlatMapCoGroups")]
    assert " Join " not in top and "collect_list" not in plan and "array_contains" not in plan  # what is summed up are places of the pattern
    assert al.spgemm_restricted(a, a, pattern.limit(0)).collect() == [] and al.spgemm_restricted(a.limit(0), a, pattern.limit(3)).count() == 3


def test_groups_of_products_hold_neighbours(spark):
    """A group's rows are neighbours, so copies of a matrix are multiplied apart, and each row of the other factor goes to few groups."""
    one = [(r.i, r.j, r.v) for r in g.upwind_diffusion_2d(spark, 10).collect()]
    a = spark.createDataFrame([(i + 100 * c, j + 100 * c, v) for c in range(12) for i, j, v in one], "i long, j long, v double").repartition(4)
    numbered, groups, divided = al.row_groups(a, 400)
    moved = numbered(a).select("g", "j").distinct().count()
    assert groups > 10 and not divided and moved < 2 * 1200
    whole = {(r.i, r.j): r.v for r in al.product(a, a, scale=2.0, plus=al.identity(al.index_set(spark, 1201)), group_entries=400).collect()}
    by_hand = {(k, k): 1.0 for k in range(1201)}
    for i, k, v in one:
        for k2, j, w in one:
            if k2 == k:
                for c in range(12):
                    by_hand[i + 100 * c, j + 100 * c] = by_hand.get((i + 100 * c, j + 100 * c), 0.0) + 2 * v * w
    assert whole.keys() == by_hand.keys() and all(abs(whole[k] - v) < 1e-9 for k, v in by_hand.items())
    expected = {(i, j) for (i, j), v in whole.items() if i < 100 and (i == j or abs(v) >= 0.2 * max(abs(w) for (r, _), w in whole.items() if r == i))}
    for entries in (200, 3):  # also of divided rows
        block, unit = a.where("i < 100"), al.identity(al.index_set(spark, 100))
        assert {(r.i, r.j) for r in al.product(block, block, scale=2.0, plus=unit, least=0.2, group_entries=entries).collect()} == expected


def test_rows_of_many_shapes_are_solved_in_a_few_stacks(monkeypatch):
    """Least squares of rows with equal numbers of unknowns share a stack, whatever their numbers of equations; also a deficient one."""
    rng, stacks, rows, expected = np.random.default_rng(3), [], [], {}
    monkeypatch.setattr(inv, "solve_stack", lambda *a, f=inv.solve_stack: stacks.append(len(a[0])) or f(*a))
    for i in range(50):
        a = rng.normal(size=(4, 6 + i))
        if i == 7:
            a[1] = 2 * a[0]
        columns = np.arange(6 + i)
        expected[i] = np.linalg.lstsq(a.T, (columns == 1) * 1.0, rcond=None)[0]
        rows += [(i, r, j, a[r, j], 0) for r in range(4) for j in columns] + [(i, r, r, 0.0, 1) for r in range(4)] + [(i, 1, 1, 1.0, 2)]
    i, j, z = inv.solve_rows(*(np.array(c) for c in zip(*rows)), False)
    assert stacks == [50] and np.allclose(z, np.concatenate([expected[k] for k in range(50)]), atol=1e-10)
    assert i.tolist() == np.repeat(range(50), 4).tolist() and j.tolist() == [0, 1, 2, 3] * 50


def chosen_by_hand(reach):
    taken, chosen = set(), []
    for i in sorted(reach):
        if not taken & set(reach[i]):
            chosen.append(i)
            taken |= set(reach[i])
    return chosen


@pytest.mark.parametrize("width, kind", [(3, "long"), (11, "string"), (1000, "long")])
def test_ordered_pass(spark, width, kind):
    """Random places, chains, and lines of a grid, which share too many places for tables."""
    rng = np.random.default_rng(width)
    chain = {i: [i, i + 1, i + 2] for i in range(150)}
    far = {i: sorted({int(x) for x in rng.integers(0, 60, 3)}) for i in range(0, 40, 2)}
    grid = {i: [i, *(i + d for d in (1, -1, 9, -9))] for i in range(54)}
    jumps = {i: [i // 40, 100 + i % 3] if i % 7 == 0 else [1000 + i, 1001 + i] for i in range(120)}
    for reach in (chain, far, grid, jumps):
        df = spark.createDataFrame([(i, k) for i, places in reach.items() for k in places], "i long, k long").selectExpr("i", f"cast(k as {kind}) as k")
        assert sorted(r.i for r in first_of_all(df, width).collect()) == chosen_by_hand(reach)
    assert first_of_all(spark.createDataFrame([], f"i long, k {kind}"), width).collect() == []


def test_aggregation_of_a_long_path_takes_few_rounds(spark):
    n, counted = 100_000, []
    pattern = spark.range(n - 1).selectExpr("explode(array(struct(id as i, id + 1 as j), struct(id + 1 as i, id as j))) as e").select("e.*")
    got = {r.i: (r.cf, r.aggregate) for r in sp.aggregate(pattern, al.index_set(spark, n), width=256, counted=counted).collect()}
    cf, root = aggregation_by_hand([[j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)], n)
    assert got == {i: (cf[i], root[i]) for i in range(n)}
    assert len(counted) <= 2 * (2 + 2 * 2)  # a pass, two steps up and down over the tables of 391 blocks, and a pass; then the remnants


def test_frontier_shrinks(spark, monkeypatch):
    """Each round of an independent set reads fewer edges."""
    a = g.laplacian_2d(spark, 20)
    pattern, kept = a.where("i <> j").select("i", "j"), []
    between = luby._between
    monkeypatch.setattr(luby, "_between", lambda edges, active: kept.append(between(edges, active)) or kept[-1])
    luby.pmisr(pattern, al.index_set(spark, 400)).count()
    sizes = [e.count() for e in kept]
    assert sizes[0] == pattern.count() and sizes[-1] == 0 and all(x > y or not x for x, y in zip(sizes, sizes[1:]))


def test_independent_set_on_sum(spark):
    """Directed edges, in both directions or one, give what their union gives."""
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 50, (90, 2)) if a != b} | {(1, 2), (2, 1)}
    a = spark.createDataFrame([(i, j, 1.0) for i, j in edges], "i long, j long, v double")
    both = spark.createDataFrame(sorted(edges | {(j, i) for i, j in edges}), "i long, j long")
    measures = spark.range(50).selectExpr("id as i", "case when id % 9 = 0 then null else cast((id * 37) % 11 as double) end as m")
    state = measures.selectExpr("i", "coalesce(m, double('infinity')) as m", "m is null as assigned", "case when m is null then 1 else 0 end as cf")
    expected = {(r.i, 1 if r.cf == 0 else r.cf) for r in luby.rounds(both, state).collect()}
    assert {(r.i, r.cf) for r in luby.pmisr_on_sum(a, measures).collect()} == expected


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_tsqr_as_a_tree(spark, parts):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(parts)
    assert np.allclose(tsqr(df, ["a", "b", "c"]), triangle(x))
    assert np.allclose(tsqr(df.limit(0), ["a", "b", "c"]), 0)


def test_constraints_of_several_vectors(spark):
    """Every row meets all its vectors, changed least: batches of whole rows against one row at a time."""
    rng = np.random.default_rng(5)
    w = {(i, j): float(rng.normal()) for i in range(25) for j in rng.choice(12, 1 + i % 5, replace=False).tolist()}
    bc, bf = rng.normal(size=(12, 2)), rng.normal(size=(25, 2))
    vectors = lambda b: spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(b)], "i long, xs array<double>")
    got = {(r.i, r.j): r.v for r in tr.constrain(spark.createDataFrame([(i, j, v) for (i, j), v in w.items()], "i long, j long, v double"), vectors(bc), vectors(bf)).collect()}
    for i in range(25):
        columns = [j for r, j in w if r == i]
        b, v = bc[columns], np.array([w[i, j] for j in columns])
        expected = v - b @ (np.linalg.pinv(b.T @ b) @ (v @ b - bf[i]))
        assert np.allclose([got[i, j] for j in columns], expected)


def test_blocked_products_do_not_move_the_matrix(spark):
    """Only the vector and the values that blocks need are exchanged; a grid in order needs few from outside."""
    from gossamer.operators.blocked import Blocked, Stored

    a, rng = g.upwind_diffusion_2d(spark, 20), np.random.default_rng(6)
    x = spark.createDataFrame([(i, float(rng.normal())) for i in range(400) if i % 5], "i long, x double")  # values are missing
    expected = {r.i: r.x for r in al.spmv(a, x).collect()}
    blocked = Blocked(a, 10)
    got = {r.i: r.x for r in al.spmv(blocked, x).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-12 for i in got)
    assert blocked.halo().count() == 2 * 9 * 20  # a line before and one after each block of two lines
    plan = al.spmv(blocked, x)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    scan = next(k for k, line in enumerate(lines) if "blocks_" in line)
    assert "Bucketed: true" in lines[scan] and "Exchange" not in "".join(lines[scan - 3 : scan])
    stored = Stored(a)
    for _ in range(3):
        assert {r.i for r in al.spmv(stored, x).collect()} == expected.keys()
    assert stored.blocked is not None and al.spmv(Blocked(a.limit(0)), x).collect() == []


def test_solves_with_incomplete_factors(spark):
    """Exact triangular solves against NumPy, and as a preconditioner of a grid's matrix."""
    a, rows = g.upwind_diffusion_2d(spark, 6), al.index_set(spark, 36)
    lower, upper = krylov.incomplete_factors(a, rows, 8)
    lo, up = dense(lower, 36), dense(upper, 36)
    b = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(36)], "i long, x double")
    rhs = np.array([1.0 + i % 5 for i in range(36)])
    assert np.allclose(vector(krylov.triangular_solve(lower, rows, b), 36), np.linalg.solve(lo, rhs))
    assert np.allclose(vector(krylov.factor_solver(lower, upper, rows)(b), 36), np.linalg.solve(up, np.linalg.solve(lo, rhs)))
    near = krylov.factor_solver(lower, upper, rows, InverseOptions(InverseType.JACOBI))(b)
    assert np.allclose(vector(near, 36), rhs / np.diag(up))
    solved = krylov.gmres(a, b, krylov.factor_solver(lower, upper, rows, InverseOptions(InverseType.NEUMANN, 10, matrix_free=True)), rtol=1e-8, max_it=20, restart=4)
    assert solved.converged and np.allclose(dense(a, 36) @ vector(solved.x, 36), rhs, atol=1e-6)


def test_stages_of_a_log(spark, tmp_path):
    from gossamer.plans.log import parse_stages

    (tmp_path / "a.log").write_text("KSPSolve 1 1.0 0.5 1.0\n--- Event Stage 0: Main Stage\n\nMatMult 3 1.0 9.9 1.0\r\nKSPSolve              12 1.0 1.25e-01 1.0 2.0\n--- Event Stage 1: Second solve \nPCSetUp 1 1.0 2.0 1.0\nKSPSolve 3 1.0 n/a 1.0\n")
    (tmp_path / "b.log").write_text("nothing\n--- Event Stage 4: alone")
    got = sorted(map(tuple, parse_stages(spark, str(tmp_path)).collect()), key=str)
    assert got == [("a.log", "Main Stage", 12, 0.125), ("a.log", "Second solve", 3, None), ("a.log", None, 1, 0.5)]


def test_neumann_polynomials_write_no_matrix(spark, grid, monkeypatch):
    """Applied by products with the matrix itself: setup writes the diagonal alone, and the polynomial is that of the scaled matrix."""
    a, rows, d = grid
    written, save = [], inv.materialize
    monkeypatch.setattr(inv, "materialize", lambda df, tag: written.append(df.columns) or save(df, tag))
    m = inv.ApproxInverse.build(a, rows, InverseOptions(InverseType.NEUMANN, 4, matrix_free=True))
    assert written == [["i", "x"]]
    x = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(36)], "i long, x double")
    n, rhs = np.eye(36) - d / np.diag(d)[:, None], np.array([1.0 + i % 5 for i in range(36)])
    expected = sum(np.linalg.matrix_power(n, k) @ (rhs / np.diag(d)) for k in range(5))
    assert np.allclose(vector(m.apply(x), 36), expected) and m.matvecs() == 4
    assert m.stored.blocked is not None and all("j" not in columns for columns in written)


def test_blocks_are_large_where_there_are_enough(spark, monkeypatch):
    """A block of few entries needs nearly all values; blocks are as many as cores, or of the given size beyond that."""
    from gossamer.operators import blocked

    a, cores = g.upwind_diffusion_2d(spark, 20), spark.sparkContext.defaultParallelism
    monkeypatch.setattr(blocked, "SMALL_ENTRIES", 10)
    assert blocked.Blocked(a).blocks == cores
    monkeypatch.setattr(blocked, "BLOCK_ENTRIES", 100)
    assert blocked.Blocked(a).blocks == -(-a.count() // 100)


def test_iterations_from_zero_start_without_a_product(spark, grid, monkeypatch):
    a, rows, d = grid
    b = spark.createDataFrame([(i, float(1 + i % 5)) for i in range(36)], "i long, x double")
    rhs, m, products = np.array([1.0 + i % 5 for i in range(36)]), inv.jacobi(a, rows, weighted=False), []
    plain = al.spmv
    monkeypatch.setattr(krylov.al, "spmv", lambda a, x: products.append(type(a).__name__) or plain(a, x))
    got = krylov.richardson(a, b, lambda r: plain(m, r), max_it=1)
    assert products.count("Stored") == 1 and np.isclose(got.residuals[1], np.linalg.norm(rhs - d @ (rhs / np.diag(d))))


def test_time_steps_share_one_stored_system(spark, grid, monkeypatch):
    """Steps and their preconditioner take products with the same blocks."""
    from gossamer.operators import blocked

    a, rows, d = grid
    made, build = [], blocked.Blocked
    monkeypatch.setattr(blocked, "Blocked", lambda m: made.append(1) or build(m))

    def solver(system):
        m = inv.ApproxInverse.build(system.a, rows, InverseOptions(InverseType.NEUMANN, 2, matrix_free=True), stored=system)
        return lambda b: krylov.richardson(system, b, m.apply, max_it=2)

    got = krylov.backward_euler(a, rows, rows.select("i", F.lit(1.0).alias("x")), 1e-4, 2, solver)
    expected = np.linalg.solve(np.linalg.matrix_power(np.eye(36) + 1e-4 * d, 2), np.ones(36))
    assert np.allclose(vector(got, 36), expected, atol=1e-6) and len(made) == 1


def test_distance_two_is_made_once(spark, grid, monkeypatch):
    """Repeated places go in one exchange, and the degrees and rounds read a written pattern."""
    a, rows, d = grid
    s = strength(a, 0.25, symmetrize=False, square=True)
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    off = np.abs(d) * (1 - np.eye(36))
    one = ((off >= 0.25 * off.max(axis=1, keepdims=True)) & (d != 0) & ~np.eye(36, dtype=bool)).astype(int)
    assert {(r.i, r.j) for r in s.collect()} == {(i, j) for i, j in zip(*np.nonzero(one + one.T @ one)) if i != j}
    written, save = [], sp.materialize
    monkeypatch.setattr(sp, "materialize", lambda df, tag: written.append(tag) or save(df, tag))
    sp.compute_cf_splitting(a, rows, strong_threshold=0.25, splitting=SplittingType.PMIS_DIST2)
    assert "strong" in written


def test_exact_solves_decide_ties_as_their_equations_do():
    """z_2 is exactly a hundredth of z_1; whether it reaches 0.01 z_1 follows the equations' quotients, whatever the order of the unknowns."""
    rng = np.random.default_rng(0)
    n = 2000
    q, off, d = rng.integers(1, 51, n) * 1.0, rng.integers(3, 13, n) * 1.0, rng.integers(300, 1200, n) * 1.0
    wanted = q / d * off / (100 * off) >= 0.01 * (q / d)
    for one, two in ((0, 1), (1, 0)):
        dense, rhs = np.zeros((n, 2, 2)), np.zeros((n, 2))
        dense[:, one, one], dense[:, two, two], dense[:, two, one], rhs[:, one] = d, 100 * off, -off, q
        z = inv.solve_stack(dense, rhs, True)
        assert np.array_equal(z[:, two] >= 0.01 * z[:, one], wanted)
    dense = np.array([[[1.0, 2.0], [3.0, 1.0]]])  # not dominant: left as solved
    assert np.allclose(inv.solve_stack(dense, np.array([[5.0, 5.0]]), True), [[1.0, 2.0]])


def test_assembled_polynomials_need_no_pattern_of_their_own(spark, grid, monkeypatch):
    """The last truncated product takes its places from the terms before it, for rows in pieces too; I - a moves the diagonal alone."""
    a, rows, full = grid
    n, c = len(full), np.array([0.5, -2.0, 3.0])
    mask = (full != 0) | np.eye(n, dtype=bool)
    wanted = np.where(mask, 0.5 * np.eye(n) - 2 * full + 3 * full @ full, 0)
    written = []
    monkeypatch.setattr(inv, "materialize", lambda df, tag: written.append(tag) or df)
    got = inv.assemble_monomial(a, rows, c, 1)
    assert "pattern" not in written
    assert np.allclose(dense(got, n), wanted) and got.count() == mask.sum()
    plus = a.select("i", "j", (-2.0 * F.col("v")).alias("v")).unionByName(al.identity(rows, 0.5))
    pieces = al.product(a, a, scale=3.0, plus=plus, on_plus=True, group_entries=2)
    assert np.allclose(dense(pieces, n), wanted) and pieces.count() == mask.sum()
    lacking = a.where("not (i = j and i < 3)")
    bare = full.copy()
    bare[range(3), range(3)] = 0
    minus = al.identity_minus(lacking, rows)
    assert np.allclose(dense(minus, n), np.eye(n) - bare)
    assert minus.where("i <> j")._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    assert al.pattern_with_diagonal(lacking, rows).count() == mask.sum()


def test_relaxation_sweeps_move_vectors_alone(spark, grid, monkeypatch):
    """Every product of a pass is with the stored matrix, and gives the rate of the plain sweeps."""
    from gossamer.operators.blocked import Stored

    a, rows, full = grid
    n, used, times = len(full), [], al.spmv
    monkeypatch.setattr(al, "spmv", lambda m, x: used.append(isinstance(m, Stored)) or times(m, x))
    monkeypatch.setattr(sp, "CR_SWEEPS", 2)
    _, rate, _ = sp.cr_pass(a, rows.selectExpr("i", "-1 as cf"), 5.0, InverseOptions(InverseType.JACOBI))
    assert used == [True, True]
    e = start = np.array([r.x for r in rows.select("i", sp.uniform(F.col("i"), "cr").alias("x")).orderBy("i").collect()])
    for _ in range(2):
        e = e - full @ e / np.diagonal(full)
    assert np.isclose(rate, np.sqrt(np.linalg.norm(e) / np.linalg.norm(start)))


def test_markers_of_a_boundary_are_taken_in_one_join(spark, grid, monkeypatch):
    """However many rounds the independent set takes, the boundary is joined and sorted once, and the strong pattern is made once."""
    a, rows, _ = grid
    plans, save = {}, sp.materialize
    monkeypatch.setattr(sp, "materialize", lambda df, tag: plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()) and save(df, tag))
    found = sp.compute_cf_splitting(a, rows, strong_threshold=0.25, splitting=SplittingType.PMIS_AGG, block_rows=6)
    assert found.count() == rows.count() and "strong" in plans
    assert plans["boundary"].count("LeftSemi") == 1


def test_restricted_products_of_scattered_rows_move_the_entries_that_count(spark):
    """Where rows of b go to many groups, a group gets their entries in columns of its places alone; the product is the same, for rows in pieces too."""
    rng = np.random.default_rng(5)
    n = 240
    for heavy in (False, True):
        full = np.zeros((n, n))
        for i in range(n):
            full[i, rng.choice(n, 12, replace=False)] = rng.integers(1, 9, 12)
        if heavy:  # a row in pieces
            full[7, :100] = 3.0
        a, pattern = spark.createDataFrame([(int(i), int(j), float(full[i, j])) for i, j in zip(*np.nonzero(full))], "i long, j long, v double"), full != 0
        numbered, groups, divided = al.row_groups(a, 60)
        assert divided == heavy
        left, places = numbered(a), numbered(a.select("i", "j"), True).select("g", "j")
        rows = a.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
        some = [(r.g, r.k, r.c) for r in al._rows_for_groups(left, rows, [places], groups).collect()]
        of, held = {(r.g, r.j) for r in left.collect()}, {(r.g, r.j) for r in places.collect()}
        wanted = {(g, int(k), int(c)) for g, k in of for c in np.flatnonzero(full[k]) if (g, c) in held}
        assert len(some) == len(wanted) and set(some) == wanted
        assert len(some) < 0.6 * al._rows_for_groups(left, rows, [], groups).count()
        summed = al.product(a, a, scale=2.0, plus=a, on_plus=True, group_entries=60)
        assert np.allclose(dense(summed, n), np.where(pattern, 2 * full @ full + full, 0)) and summed.count() == pattern.sum()


def test_products_move_rows_as_lists(spark, monkeypatch):
    """What goes to a group is a list for each row that it names (and range of columns), not an entry at a time; the product is the same."""
    rng = np.random.default_rng(6)
    n = 60
    full = np.where(rng.random((n, n)) < 0.3, rng.integers(1, 9, (n, n)), 0).astype(float)
    a = spark.createDataFrame([(int(i), int(j), float(full[i, j])) for i, j in zip(*np.nonzero(full))], "i long, j long, v double")
    numbered, _, _ = al.row_groups(a, 100)
    left, rows = numbered(a), a.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    named = {(r.g, r.j) for r in left.collect()}
    moved = al.packed_rows(left, rows).collect()
    assert len(moved) == len(named) == len({(r.g, r.i) for r in moved}) and all(len(r.js) == len(r.vs) == np.count_nonzero(full[r.i]) for r in moved)
    monkeypatch.setattr(al, "PACKED", 4)  # lists of 16 columns
    assert max(len(r.js) for r in al.packed_rows(left, rows).collect()) <= 16
    got = al.product(a, a, scale=2.0, plus=al.identity(al.index_set(spark, n + 1)), group_entries=100)
    assert np.allclose(dense(got, n + 1)[:n, :n], 2 * full @ full + np.eye(n)) and got.groupBy("i", "j").count().where("count > 1").isEmpty()


def test_coarse_matrices_write_no_product_with_one_entry_a_row(grid, monkeypatch):
    """A prolongator of one entry a row moves columns, whose repeated places are added up; another is multiplied."""
    a, rows, full = grid
    spark, written, save = rows.sparkSession, [], tr.materialize
    monkeypatch.setattr(tr, "materialize", lambda df, tag: written.append(tag) or save(df, tag))
    one = spark.createDataFrame([(i, i // 3 * 3, 1.0 + i % 2) for i in range(36)], "i long, j long, v double")
    two = one.unionByName(spark.createDataFrame([(5, 30, 2.0)], "i long, j long, v double"))
    for p, tags in ((one, []), (two, ["ap"])):
        written.clear()
        got, wanted = tr.coarse_matrix(a, al.transpose(p), p, a_drop=0.0), dense(p, 36).T @ full @ dense(p, 36)
        assert written == tags and np.allclose(dense(got, 36), wanted) and got.groupBy("i", "j").count().where("count > 1").isEmpty()


def test_strong_pattern_is_made_once(grid, monkeypatch):
    """The degrees and the rounds read a written pattern."""
    a, rows, _ = grid
    written, save = [], sp.materialize
    monkeypatch.setattr(sp, "materialize", lambda df, tag: written.append(tag) or save(df, tag))
    assert sp.compute_cf_splitting(a, rows).count() == 36 and written.count("strong") == 1
