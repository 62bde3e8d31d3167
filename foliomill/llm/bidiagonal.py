"""Singular values and right singular vectors of a small square matrix, by qd.

Householder reflections make the matrix bidiagonal; dqds, shifted by guaranteed lower bounds, finds
the squared singular values; twisted factorisations of the bidiagonal form give the vectors. A matrix
of some thousand columns is small: this runs in one task, on the triangle that is left of a table.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
TOLERANCE = (16 * EPS) ** 2  # of squares
TRACE = 1e-30
CLOSE = 1e-12  # vectors this far from orthogonal are computed again together


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(v, beta): I - beta v v' maps x onto its first axis."""
    v = x.copy()
    size = np.linalg.norm(x)
    if size == 0:
        return v, 0.0
    v[0] += size if v[0] >= 0 else -size
    return v, 2.0 / float(v @ v)


def bidiagonalised(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, v) with a = u b v' for some orthogonal u."""
    a, d = a.astype(np.float64).copy(), a.shape[1]
    right = np.eye(d)
    for k in range(d):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, beta = _reflector(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= beta * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transform and its d; None if the shift is beyond the least value."""
    d, ds, new_q, new_e = q[0] - shift, [], [], []
    for i in range(len(e)):
        ds.append(d)
        total = d + e[i]
        if d < 0 or total <= 0:
            return None
        ratio = q[i + 1] / total
        new_q.append(total)
        new_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    return new_q + [d], new_e, ds + [d]


def _disc(q: list[float], e: list[float]) -> float:
    """The least end of Gershgorin's discs, less what rounding may add to it."""
    sides = [0.0, *(math.sqrt(x * y) for x, y in zip(q, e)), 0.0]
    middles = [q[0], *(x + y for x, y in zip(q[1:], e))]
    return min(m - a - b - 8 * EPS * m for m, a, b in zip(middles, sides, sides[1:]))


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, in falling order, of the bidiagonal matrix with squares q > 0 and e.

    A sweep without shift gives the diagonal of the inverse: one over its trace is a lower bound of the
    least value, and so is the least of Gershgorin's discs; the greater is the shift of the next sweep.
    Where an off-diagonal square is negligible the matrix falls apart.
    """
    found, open_parts = [], [(list(map(float, q)), list(map(float, e)), 0.0)]
    sweeps, most = 0, 400 + 100 * len(q)
    while open_parts:
        q, e, shifted = open_parts.pop()
        while q:
            if len(q) == 1:
                found.append(q[0] + shifted)
                break
            if e[-1] <= TOLERANCE * (shifted + q[-1]) or e[-1] <= TOLERANCE * q[-2]:
                found.append(q[-1] + shifted)
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i, x in enumerate(e) if x <= TOLERANCE * max(q[i], shifted)), None)
            if cut is not None:
                open_parts.append((q[:cut + 1], e[:cut], shifted))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            plain = _sweep(q, e, 0.0)
            bound = 0.0 if min(plain[2]) <= 0 else (1 - 4 * EPS * len(q)) / sum(1 / x for x in plain[2])
            bound = max(bound, _disc(*plain[:2]))
            moved = _sweep(plain[0], plain[1], bound) if bound > 0 else None
            if moved is None:
                q, e = plain[0], plain[1]
            else:
                q, e, shifted = moved[0], moved[1], shifted + bound
            sweeps += 1
            if sweeps > most:
                raise ArithmeticError("dqds did not converge")
    return np.sort(np.array(found))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of the bidiagonal (a, b) for squared singular values, a column each.

    b'b - value is factorised from the top and from the bottom; where the two meet with the smallest
    pivot, the vector is one and follows from both factors by products alone.
    """
    n, m = len(a), len(values)
    q, e, off = a * a, b * b, a[:-1] * b
    tiny = np.finfo(np.float64).tiny * 2.0**100
    guard = lambda x: np.where(np.abs(x) < tiny, tiny, x)
    s, top = np.empty((n, m)), np.empty((n, m))
    p, bottom = np.empty((n, m)), np.empty((n, m))
    s[0] = -values
    for i in range(n - 1):
        top[i] = guard(q[i] + s[i])
        s[i + 1] = e[i] * s[i] / top[i] - values
    p[n - 1] = q[n - 1] - values
    for i in range(n - 2, -1, -1):
        bottom[i + 1] = guard(e[i] + p[i + 1])
        p[i] = q[i] * p[i + 1] / bottom[i + 1] - values
    pivot = s + p + values
    at = np.argmin(np.abs(np.where(np.isfinite(pivot), pivot, np.inf)), axis=0)
    z = np.zeros((n, m))
    z[at, np.arange(m)] = 1.0
    for i in range(n - 2, -1, -1):
        up = i < at
        z[i] = np.where(up, -off[i] / guard(np.where(up, top[i], 1.0)) * z[i + 1], z[i])
    for i in range(n - 1):
        down = i >= at
        z[i + 1] = np.where(down, -off[i] / guard(np.where(down, bottom[i + 1], 1.0)) * z[i], z[i + 1])
    return z / np.linalg.norm(z, axis=0)


def _together(a: np.ndarray, b: np.ndarray, values: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Vectors of values too close to tell apart: inverse iteration of the whole group, then a small rotation."""
    close = np.abs(z.T @ z - np.eye(z.shape[1])) > CLOSE
    if not close.any():
        return z
    z, n = z.copy(), len(a)
    full = np.diag(a) + np.diag(b, 1)
    t = full.T @ full
    reach = np.arange(len(values))  # first vector of each one's group: groups are runs, as values are in order
    for i in range(1, len(values)):
        reach[i] = min([reach[j] for j in np.flatnonzero(close[i, :i])] + [i])
    first = np.minimum.accumulate(reach[::-1])[::-1]
    starts = [i for i in range(len(values)) if first[i] == i and (i == 0 or not (first[i:] < i).any())]
    for start, end in zip(starts, starts[1:] + [len(values)]):
        if end - start < 2:
            continue
        shift = values[start:end].mean() + 8 * EPS * values[0]
        basis = np.linalg.qr(np.random.default_rng(start).standard_normal((n, end - start)))[0]
        for _ in range(3):
            basis = np.linalg.qr(np.linalg.solve(t - shift * np.eye(n), basis))[0]
        others = np.delete(z, np.s_[start:end], axis=1)
        basis = np.linalg.qr(basis - others @ (others.T @ basis))[0]
        turn = np.linalg.eigh(basis.T @ t @ basis)[1][:, ::-1]
        z[:, start:end] = basis @ turn
    return z


def right_vectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values in falling order, right singular vectors as columns).

    Values that rounding cannot tell from zero are zero and have no vector.
    """
    d = matrix.shape[1]
    scale = float(np.abs(matrix).max()) if matrix.size else 0.0
    if scale == 0:
        return np.zeros(d), np.zeros((d, 0))
    a, b, right = bidiagonalised(matrix / scale)
    a = np.where(np.abs(a) < TRACE, TRACE, a)  # far below what rounding leaves of a zero
    b = np.where(np.abs(b) <= EPS * (np.abs(a[:-1]) + np.abs(a[1:])), 0.0, b)
    cuts = [0, *(np.flatnonzero(b == 0) + 1), d]
    values, vectors = [], []
    least = (8 * d * EPS * np.sqrt((a * a).max() + (b * b).max() if d > 1 else a[0] ** 2)) ** 2
    for start, end in zip(cuts, cuts[1:]):
        part_a, part_b = a[start:end], b[start:end - 1]
        found = dqds(part_a**2, part_b**2)
        kept = found[found > least]
        z = np.zeros((d, len(kept)))
        z[start:end] = _together(part_a, part_b, kept, twisted(part_a, part_b, kept))
        values.append(np.where(found > least, found, 0.0))
        vectors.append(z)
    values, vectors = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-values, kind="stable")
    above = np.argsort(-values[values > 0], kind="stable")
    return values[order] * scale**2, right @ vectors[:, above]
