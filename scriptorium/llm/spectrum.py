"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The pivots of the LDL' factorisation of ``A - s I`` have the signs of the eigenvalues of
``A - s I`` (Sylvester), so a factorisation counts the eigenvalues above ``s``. Bisection on
these counts isolates each leading eigenvalue, Rayleigh quotient iteration started inside
the isolating interval converges to its pair cubically, and two more counts certify that
the pair found has the number asked for. Eigenvalues closer than rounding form a cluster:
inverse iteration in the orthogonal complement of what was found gives a basis for it.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
_GROWTH = (1 + 17 ** 0.5) / 8  # the pivot bound of Bunch and Kaufman


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` are greater than ``shift``."""
    m = a - shift * np.eye(len(a))
    n, k, above = len(m), 0, 0
    while k < n:
        size, swap = 1, k
        diagonal = abs(m[k, k])
        if k + 1 < n:
            below = np.abs(m[k + 1:, k])
            r = k + 1 + int(np.argmax(below))
            largest = below[r - k - 1]
            if diagonal < _GROWTH * largest:
                row = np.abs(m[k:, r])
                row[r - k] = 0
                other = row.max()
                if diagonal * other < _GROWTH * largest ** 2:
                    swap = r
                    size = 1 if abs(m[r, r]) >= _GROWTH * other else 2
        at = k + size - 1
        if swap != at:
            m[[at, swap]] = m[[swap, at]]
            m[:, [at, swap]] = m[:, [swap, at]]
        block, rest = m[k:k + size, k:k + size], m[k + size:, k:k + size]
        if size == 2:  # such a block is indefinite: one eigenvalue on each side
            above += 1
            m[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
        elif block[0, 0] != 0:
            above += bool(block[0, 0] > 0)
            m[k + 1:, k + 1:] -= np.outer(rest[:, 0] / block[0, 0], rest[:, 0])
        k += size
    return above


def _unit(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``found``, of length one."""
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
        v = v / np.linalg.norm(v)
    return v


def _solved(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    """A multiple of ``(a - shift I)^-1 v``; a singular matrix is shifted by ``nudge``."""
    eye = np.eye(len(a))
    for s in (shift, shift + nudge, shift - 3 * nudge):
        try:
            out = np.linalg.solve(a - s * eye, v)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(out)
        if np.isfinite(size) and size > 0:
            return out / size
    return v


def _rayleigh(a, low, high, v, found, scale):
    """The eigenpair whose value lies in ``(low, high]``, or None if it converged elsewhere."""
    shift = (low + high) / 2
    for _ in range(2):
        v = _unit(_solved(a, shift, v, EPS * scale), found)
    best = (np.inf, shift, v)
    for _ in range(30):
        rho = float(v @ a @ v)
        off = float(np.linalg.norm(a @ v - rho * v))
        if off < best[0]:
            best = (off, rho, v)
        elif off > 0.5 * best[0] and best[0] < 1e-8 * scale:
            break  # no further gain: rounding is reached
        v = _unit(_solved(a, rho, v, EPS * scale), found)
    slack = 8 * EPS * scale
    return best[1:] if low - slack <= best[1] <= high + slack else None


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, falling, and their unit eigenvectors (as rows).

    Raises ArithmeticError when the counts do not confirm the numbering.
    """
    a = (np.asarray(a, dtype=np.float64) + np.asarray(a, dtype=np.float64).T) / 2
    n = len(a)
    k = min(k, n)
    if k == 0:
        return np.zeros(0), np.zeros((0, n))
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    bottom, top = float((np.diag(a) - radius).min()), float((np.diag(a) + radius).max())
    scale = max(abs(bottom), abs(top))
    if scale == 0:
        return np.zeros(k), np.eye(n)[:k]
    tol = 32 * EPS * scale
    bottom, top = bottom - tol, top + tol
    counts = {bottom: n, top: 0}

    def count(s):
        if s not in counts:
            counts[s] = count_above(a, s)
        return counts[s]

    def interval(j):
        """The narrowest counted interval that holds eigenvalue number ``j``."""
        return (max(s for s, c in counts.items() if c >= j), min(s for s, c in counts.items() if c < j))

    rng = np.random.default_rng(0)
    values, found = [], []
    while len(values) < k:
        j = len(values) + 1
        low, high = interval(j)
        pair = None
        while pair is None:
            if high - low <= tol:  # a cluster, or as narrow as rounding allows
                v = _unit(rng.standard_normal(n), found)
                for _ in range(4):
                    v = _unit(_solved(a, high, v, EPS * scale), found)
                pair = (float(v @ a @ v), v)
            elif counts[low] == j and counts[high] == j - 1:
                pair = _rayleigh(a, low, high, _unit(rng.standard_normal(n), found), found, scale)
            if pair is None:
                count((low + high) / 2)
                low, high = interval(j)
        values.append(pair[0])
        found.append(pair[1])
    slack = 64 * n * EPS * scale
    for j, value in enumerate(values, 1):
        if count(value - slack) < j or count(value + slack) >= j:
            raise ArithmeticError(f"eigenvalue {j} is not confirmed by the counts")
    return np.array(values), np.array(found)
