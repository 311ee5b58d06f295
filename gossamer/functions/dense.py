"""Small dense kernels, in NumPy on the driver or within one row's group."""

from __future__ import annotations

import numpy as np


def pseudo_inverse(a: np.ndarray, drop: float = 1e-13) -> np.ndarray:
    """By singular values; those below `drop` are left out."""
    u, s, vt = np.linalg.svd(np.atleast_2d(a), full_matrices=False)
    keep = s > drop
    return (vt[keep].T / s[keep]) @ u[:, keep].T


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank-revealing least squares."""
    return np.linalg.lstsq(a, b, rcond=None)[0]


def triangle(a: np.ndarray) -> np.ndarray:
    """R of a QR factorisation with a positive diagonal, square in the columns."""
    n = a.shape[1]
    r = np.linalg.qr(np.vstack((a, np.zeros((max(0, n - len(a)), n)))), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def modified_leja(roots: np.ndarray) -> np.ndarray:
    """Greedy ordering by the largest product of distances to those chosen, starting from the largest modulus; conjugates stay adjacent, the positive imaginary part first."""
    left = [complex(z) for z in roots]
    out: list[complex] = []
    scores: list[float] = [0.0] * len(left)

    def take(k: int) -> None:
        z = left.pop(k)
        scores.pop(k)
        out.append(z)
        for m, w in enumerate(left):
            gap = abs(w - z)
            scores[m] += np.log(gap) if gap > 0 else -np.inf

    while left:
        values = [abs(z) for z in left] if not out else scores
        best = max(values)
        near = [k for k, v in enumerate(values) if v == best or (np.isfinite(best) and abs(v - best) <= 1e-12 * max(1.0, abs(best)))]
        k = max(near, key=lambda n: (left[n].imag > 0, left[n].real, left[n].imag))
        z = left[k]
        take(k)
        if abs(z.imag) > 0:
            mate = min(range(len(left)), key=lambda n: abs(left[n] - z.conjugate()), default=None)
            if mate is not None and abs(left[mate] - z.conjugate()) <= 1e-8 * abs(z):
                take(mate)
    return np.array(out, complex)
