"""Queries over the whole-table matrix against dense brute force; before, they ran on fixed grids whatever the folder."""

import numpy as np
import pytest

from gossamer.catalog import transfers
from gossamer.operators import splitting as sp
from gossamer.operators.krylov_basis import start_vector
from gossamer.session import prepare
from gossamer.sources import tables as t



@pytest.fixture(scope="module")
def table(spark, sf_dir):
    """(ids, dense matrix, part sizes, start vector)."""
    prepare(spark)
    d = t.dominant(spark, sf_dir).toPandas()
    sizes = t.part_sizes(spark, sf_dir).toPandas().sort_values("i")
    ids = sizes["i"].to_numpy()
    a = np.zeros((len(ids), len(ids)))
    np.add.at(a, (np.searchsorted(ids, d["i"]), np.searchsorted(ids, d["j"])), d["v"].to_numpy(float))
    start = start_vector(t.part_rows(spark, sf_dir)).toPandas().sort_values("i")["x"].to_numpy(float)
    return ids, a, sizes["x"].to_numpy(float), start


def matrix(frame, ids):
    m = np.zeros((len(ids), len(ids)))
    m[np.searchsorted(ids, frame["i"]), np.searchsorted(ids, frame["j"])] = frame["v"].to_numpy(float)
    return m


def fitted(a, b, order):
    """Coefficients of q with the least norm of b - a q(a) b."""
    k = [b]
    for _ in range(order + 1):
        k.append(a @ k[-1])
    return np.linalg.lstsq(np.stack(k[1:], axis=1), b, rcond=None)[0]


@pytest.mark.parametrize("name, order", [("I1_power_coefficients", 3), ("I2_arnoldi_coefficients", 3), ("I20_reused_coefficients", 2)])
def test_coefficients(answer, table, name, order):
    _, a, _, b = table
    got = answer(name).sort_values("k")["re"].to_numpy()
    assert np.allclose(got, fitted(a / a.diagonal()[:, None], b, order), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("name", ["I3_newton_roots", "I4_newton_no_extra"])
def test_roots_are_those_of_the_residual_polynomial(answer, table, name):
    _, a, _, b = table
    got = answer(name)
    c = fitted(a / a.diagonal()[:, None], b, 3)
    expected = np.roots([*(-c[::-1]), 1.0])
    assert np.allclose(np.sort_complex(got["re"].to_numpy() + 1j * got["im"].to_numpy()), np.sort_complex(expected), rtol=1e-5)


def test_residual_of_three_bases(answer, table):
    _, a, _, b = table
    s = a / a.diagonal()[:, None]
    q = sum(c * np.linalg.matrix_power(s, k) @ b for k, c in enumerate(fitted(s, b, 3)))
    assert np.allclose(answer("I2_arnoldi_residual")["residual"], np.linalg.norm(b - s @ q), atol=2e-6)


@pytest.mark.parametrize("name, square", [("I6_sai", False), ("I7_isai", True)])
def test_sparse_inverses(answer, table, name, square):
    ids, a, _, _ = table
    expected = np.zeros_like(a)
    for i in range(len(ids)):
        j = np.flatnonzero((a[i] != 0) | (np.arange(len(ids)) == i))
        columns = j if square else np.arange(len(ids))
        expected[i, j] = np.linalg.lstsq(a[np.ix_(j, columns)].T, (columns == i).astype(float), rcond=None)[0]
    assert np.allclose(matrix(answer(name), ids), expected, atol=2e-9)


@pytest.mark.parametrize("name, square", [("R2_local_restriction", True), ("R3_local_restriction_least_squares", False)])
def test_local_restriction(answer, spark, sf_dir, table, name, square):
    ids, a, _, _ = table
    cf = sp.compute_cf_splitting(t.dominant(spark, sf_dir), t.part_rows(spark, sf_dir)).toPandas().sort_values("i")["cf"].to_numpy()
    fine, coarse = np.flatnonzero(cf == -1), np.flatnonzero(cf == 1)
    aff, acf = a[np.ix_(fine, fine)], a[np.ix_(coarse, fine)]
    pattern = (acf != 0) | ((acf != 0).astype(int) @ (aff != 0).astype(int) > 0)
    expected = np.zeros_like(a)
    for k, i in enumerate(coarse):
        j = np.flatnonzero(pattern[k])
        if len(j):
            columns = j if square else np.arange(len(fine))
            expected[i, fine[j]] = np.linalg.lstsq(aff[np.ix_(j, columns)].T, -acf[k, columns], rcond=None)[0]
    assert np.allclose(matrix(answer(name), ids), expected, atol=2e-9)


def test_incomplete_factors(answer, table):
    ids, a, _, _ = table
    n, there = len(ids), (a != 0) | np.eye(len(ids), dtype=bool)
    low, up = np.tril(a, -1) / a.diagonal(), np.triu(a)
    for _ in range(3):
        rest = np.array([[a[i, j] - low[i, : min(i, j)] @ up[: min(i, j), j] for j in range(n)] for i in range(n)]) * there
        low, up = np.tril(rest, -1) / up.diagonal(), np.triu(rest)
    got = answer("K4_incomplete_factors")
    assert np.allclose(matrix(got[got["factor"] == "L"], ids), low + np.eye(n), atol=1e-6)
    assert np.allclose(matrix(got[got["factor"] == "U"], ids), up, atol=1e-5)


def test_coarse_solve_and_time_steps(answer, table):
    ids, a, x, b = table
    s = a / a.diagonal()[:, None]
    y = sum(c * np.linalg.matrix_power(s, k) @ x for k, c in enumerate(fitted(s, b, 4)))
    assert np.allclose(answer("M11_coarse_solve").sort_values("i")["x"], y, rtol=1e-5, atol=1e-5)
    for _ in range(2):
        x = np.linalg.solve(np.eye(len(ids)) + transfers._DT * a, x)
    assert np.allclose(answer("K5_time_steps").sort_values("i")["x"], x, atol=1e-4)


def test_hierarchy_starts_from_the_whole_table(answer, table):
    ids, a, _, _ = table
    got = answer("M5_single_level")
    assert got[["n_rows", "nnz"]].values.tolist() == [[len(ids), np.count_nonzero(a)]]
