"""Singular values and right singular vectors of a small triangle, by way of a bidiagonal matrix.

Householder reflections from both sides make the triangle bidiagonal, the differential quotient-difference algorithm
with shifts (dqds) finds the squares of its singular values, and twisted factorisations find their vectors.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector v and the entry that x becomes: (I - 2vv')x = (entry, 0, ...)."""
    norm = float(np.linalg.norm(x))
    if norm == 0.0:
        return np.zeros_like(x), 0.0
    entry = -norm if x[0] >= 0 else norm
    v = x.copy()
    v[0] -= entry
    return v / np.linalg.norm(v), entry


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor V of r = U B V'."""
    b = np.array(r, np.float64)
    d = b.shape[0]
    v_all = np.eye(d)
    for k in range(d):
        v, entry = _reflector(b[k:, k])
        b[k:, k:] -= 2.0 * np.outer(v, v @ b[k:, k:])
        b[k, k], b[k + 1 :, k] = entry, 0.0
        if k < d - 2:
            v, entry = _reflector(b[k, k + 1 :])
            b[k:, k + 1 :] -= 2.0 * np.outer(b[k:, k + 1 :] @ v, v)
            v_all[:, k + 1 :] -= 2.0 * np.outer(v_all[:, k + 1 :] @ v, v)
            b[k, k + 1], b[k, k + 2 :] = entry, 0.0
    return np.diag(b).copy(), np.diag(b, 1).copy(), v_all


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds transform; None where the shift was larger than the smallest eigenvalue."""
    d = q[0] - shift
    qs, es = [], []
    for i in range(len(e)):
        if d < 0.0:
            return None
        top = d + e[i]
        if top == 0.0:  # the block comes apart here
            qs.append(0.0)
            es.append(0.0)
            d = q[i + 1] - shift
            continue
        ratio = q[i + 1] / top
        qs.append(top)
        es.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0.0:
        return None
    return [*qs, d], es


def _lower_bound(q: list[float], e: list[float]) -> float:
    """A bound below the smallest eigenvalue: one over the trace of the inverse, from one transform without a shift."""
    d, total = q[0], 0.0
    for i in range(len(e)):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        d *= q[i + 1] / (d + e[i])
    return 0.0 if d <= 0.0 else 1.0 / (total + 1.0 / d)


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, each to high relative accuracy (dqds)."""
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while blocks:
        q, e, gone = blocks.pop()
        rounds = 0
        while q:
            n = len(q)
            if n == 1 or e[-1] <= (10 * EPS) ** 2 * (gone + q[-1]):
                found.append(gone + q.pop())
                if e:
                    e.pop()
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS**2 * (gone + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], gone))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # small ones at the end converge faster; the mirrored array has the same values
                q.reverse()
                e.reverse()
            rounds += 1
            if rounds > 100 * len(diagonal) + 100:
                raise ArithmeticError("dqds did not converge")
            shift = _lower_bound(q, e) * (1 - 8 * EPS)
            swept = _sweep(q, e, shift)
            while swept is None:
                shift = 0.0 if shift <= EPS * gone else shift / 2
                swept = _sweep(q, e, shift)
            q, e = swept
            gone += shift
    return np.array(sorted(found, reverse=True))


def _twisted(square: np.ndarray, ratio: np.ndarray, value: float, tiny: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors of B'B - value from both ends: multipliers downward and upward, and the twists' pivots."""
    d = len(square)
    down, up = np.zeros(max(d - 1, 0)), np.zeros(max(d - 1, 0))
    s, p = np.empty(d), np.empty(d)
    s[0] = -value
    for i in range(d - 1):
        pivot = square[i] + s[i]
        pivot = pivot if abs(pivot) > tiny else tiny
        down[i] = square[i] * ratio[i] / pivot
        s[i + 1] = down[i] * ratio[i] * s[i] - value
    p[d - 1] = square[d - 1] - value
    for i in range(d - 2, -1, -1):
        pivot = square[i] * ratio[i] ** 2 + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else tiny
        t = square[i] / pivot
        up[i] = ratio[i] * t
        p[i] = p[i + 1] * t - value
    return down, up, s + p + value


def _vector(down: np.ndarray, up: np.ndarray, k: int) -> np.ndarray:
    d = len(down) + 1
    z = np.zeros(d)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, d - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def _gram(diagonal: np.ndarray, upper: np.ndarray, z: np.ndarray) -> np.ndarray:
    """B'Bz for the bidiagonal B."""
    y = diagonal * z
    y[:-1] += upper * z[1:]
    out = diagonal * y
    out[1:] += upper * y[:-1]
    return out


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit columns z with B'B z = value z for the leading ``values``, orthogonal to each other.

    ``diagonal`` and ``upper`` are one block without negligible entries above the diagonal, so no value repeats. A
    vector comes from the twist with the smallest pivot. Where values lie close together it is made orthogonal to
    those before it, and further twists are tried until the residual is small.
    """
    d = len(diagonal)
    norm = float(max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))) or 1.0
    diagonal, upper, values = diagonal / norm, upper / norm, values / norm**2
    safe = np.where(np.abs(diagonal) > EPS, diagonal, EPS)
    square, ratio = safe**2, (upper / safe[:-1] if d > 1 else upper)
    out = np.zeros((d, len(values)))
    for j, value in enumerate(values):
        down, up, pivots = _twisted(square, ratio, float(value), EPS**2)
        best, least = None, np.inf
        for k in np.argsort(np.abs(pivots), kind="stable"):
            z = _vector(down, up, int(k))
            for _ in range(2):
                z = z - out[:, :j] @ (out[:, :j].T @ z)
                left = float(np.linalg.norm(z))
                z = z / left if left > 0.0 else z * np.nan
            if not np.isfinite(z).all():
                continue
            residual = float(np.linalg.norm(_gram(diagonal, upper, z) - value * z))
            if residual < least:
                best, least = z, residual
            if least <= 8 * d * EPS:
                break
        if best is None:
            raise ArithmeticError("no direction left for an eigenvalue")
        out[:, j] = best
    return out


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values of ``r``, falling, and their right singular vectors as columns.

    The bidiagonal matrix is taken apart where an entry above its diagonal is negligible; equal singular values
    then lie in different blocks, and their vectors are orthogonal by their places.
    """
    diagonal, upper, v = bidiagonal(r)
    d = len(diagonal)
    norm = max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0))
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= 2 * EPS * norm) + 1).tolist(), d]
    blocks = [(a, b, squared_singular_values(diagonal[a:b], upper[a : b - 1])) for a, b in zip(cuts, cuts[1:], strict=False)]
    order = sorted(((-x, n, i) for n, (_, _, xs) in enumerate(blocks) for i, x in enumerate(xs)))[:k]
    values, z = np.array([-x for x, _, _ in order]), np.zeros((d, len(order)))
    for n, (a, b, xs) in enumerate(blocks):
        mine = [j for j, (_, block, _) in enumerate(order) if block == n]  # falling, as in the block
        if mine:
            z[a:b, mine] = right_vectors(diagonal[a:b], upper[a : b - 1], xs[: len(mine)])
    return values, v @ z
