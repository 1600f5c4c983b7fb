"""Singular values and right singular vectors of a small triangular matrix.

Householder steps make the matrix bidiagonal, dqds finds the squares of its singular values with
high relative accuracy, and twisted factorisations of the shifted matrix give the vectors. Work is cubic in
the number of columns, which is the number of entries of an embedding, never of rows.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(np.float64).eps)
_NEGLIGIBLE = (10 * _EPS) ** 2
#: Neighbouring squares closer than this, relatively, get vectors that are made orthogonal to each other.
_CLOSE = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector u and a number such that x - 2 u (u x) is (number, 0, 0, ...)."""
    scale = float(np.abs(x).max())
    if not scale or not np.any(x[1:]):
        return np.zeros_like(x), float(x[0])
    u = x / scale
    length = float(np.sqrt(u @ u))
    head = -length if u[0] >= 0 else length
    u[0] -= head
    return u / np.sqrt(u @ u), head * scale


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, upper diagonal and right factor ``p`` with matrix = q @ bidiagonal @ p.T, of a square matrix."""
    a = matrix.astype(np.float64).copy()
    d = len(a)
    right, diagonal, upper = np.eye(d), np.zeros(d), np.zeros(max(d - 1, 0))
    for i in range(d):
        u, diagonal[i] = _reflector(a[i:, i])
        a[i:, i + 1 :] -= 2 * np.outer(u, u @ a[i:, i + 1 :])
        if i + 1 < d:
            v, upper[i] = _reflector(a[i, i + 1 :])
            a[i + 1 :, i + 1 :] -= 2 * np.outer(a[i + 1 :, i + 1 :] @ v, v)
            right[:, i + 1 :] -= 2 * np.outer(right[:, i + 1 :] @ v, v)
    return diagonal, upper, right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One step of differential quotients and differences with a shift; None if the shift was too large."""
    new_q, new_e = [], []
    d = q[0] - shift
    for i, x in enumerate(e):
        if d < 0:
            return None
        total = d + x
        ratio = q[i + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(x * ratio)
        d = d * ratio - shift if total else q[i + 1] - shift
    if d < 0:
        return None
    return new_q + [d], new_e


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squares of the singular values of an upper bidiagonal matrix, falling, by dqds with deflation."""
    found: list[float] = []
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        if not q:
            continue
        if q[0] * 1.5 < q[-1]:
            q, e = q[::-1], e[::-1]
        while len(q) > 1:
            if e[-1] <= _NEGLIGIBLE * (moved + q[-1]):
                found.append(q.pop() + moved)
                e.pop()
                continue
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= _NEGLIGIBLE * _EPS * min(q[i] + moved, q[i + 1] + moved)), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            # The lesser eigenvalue of the last two rows is no less than the least of all.
            a, b, c = q[-2] + (e[-3 + 1] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (a - b) / 2
            least = b - c / (half + np.copysign(np.sqrt(half * half + c), half)) if half or c else b
            shift, step = max(0.0, min(float(least), q[-1])), None
            for _ in range(6):
                step = _transform(q, e, shift)
                if step is not None or not shift:
                    break
                shift *= 0.5
            if step is None:
                shift, step = 0.0, _transform(q, e, 0.0)
            q, e = step
            moved += shift
        found += [x + moved for x in q]
    return np.sort(np.array(found))[::-1]


def _twisted(d: np.ndarray, low: np.ndarray, square: float, tiny: float):
    """Factors of L D L' - square: L+ and D+ from the top, U- from the bottom, and the remainders of each twist."""
    n = len(d)
    plus, minus, top, s, p = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0)), np.zeros(n), np.zeros(n), np.zeros(n)
    s[0] = -square
    for i in range(n - 1):
        top[i] = s[i] + d[i]
        pivot = top[i] if abs(top[i]) > tiny else -tiny
        plus[i] = d[i] * low[i] / pivot
        s[i + 1] = plus[i] * low[i] * s[i] - square
    top[-1] = s[-1] + d[-1]
    p[-1] = d[-1] - square
    for i in range(n - 2, -1, -1):
        pivot = d[i] * low[i] * low[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        ratio = d[i] / pivot
        minus[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - square
    return plus, top, minus, s + p + square


def _solved(plus: np.ndarray, top: np.ndarray, right: np.ndarray, tiny: float) -> np.ndarray:
    """A solution of L+ D+ L+' z = right, of unit length."""
    z = right.copy()
    for i in range(1, len(z)):
        z[i] -= plus[i - 1] * z[i - 1]
    z /= np.where(np.abs(top) > tiny, top, -tiny)
    z /= np.abs(z).max()
    for i in range(len(z) - 2, -1, -1):
        z[i] -= plus[i] * z[i + 1]
    return z / np.linalg.norm(z)


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, squares: np.ndarray, most: int) -> np.ndarray:
    """Unit right singular vectors, as columns, of the ``most`` largest squared singular values."""
    n = len(diagonal)
    largest = float(max(np.abs(diagonal).max(initial=0.0), np.abs(upper).max(initial=0.0)))
    least = largest * 1e-140
    diagonal = np.where(np.abs(diagonal) > least, diagonal, least)
    d, low = diagonal**2, upper / diagonal[:-1]
    tiny = max(largest * largest * 1e-200, 1e-300)
    vectors = np.zeros((n, most))
    start = 0
    with np.errstate(all="ignore"):
        for j in range(most):
            if j and squares[j - 1] - squares[j] > _CLOSE * squares[j - 1]:
                start = j
            plus, top, minus, rest = _twisted(d, low, float(squares[j]), tiny)
            k = int(np.nanargmin(np.abs(rest)))
            z = np.zeros(n)
            z[k] = 1.0
            for i in range(k - 1, -1, -1):
                z[i] = -plus[i] * z[i + 1]
            for i in range(k, n - 1):
                z[i + 1] = -minus[i] * z[i]
            z /= np.linalg.norm(z)
            before = vectors[:, start:j]
            if before.shape[1]:
                z = _made_orthogonal(z, before, plus, top, tiny, j)
            vectors[:, j] = z
    return vectors


def _made_orthogonal(z: np.ndarray, before: np.ndarray, plus: np.ndarray, top: np.ndarray, tiny: float, seed: int) -> np.ndarray:
    """``z`` without its share of close earlier vectors; where nothing is left, inverse iteration from another start."""
    rng = np.random.RandomState(seed)
    for _ in range(8):
        rest = z - before @ (before.T @ z)
        rest -= before @ (before.T @ rest)
        size = np.linalg.norm(rest)
        if np.isfinite(size) and size > 0.1:
            return rest / size
        begin = rng.standard_normal(len(z))
        for _ in range(3):
            begin -= before @ (before.T @ begin)
            z = _solved(plus, top, begin / np.linalg.norm(begin), tiny)
            begin = z if np.all(np.isfinite(z)) else rng.standard_normal(len(z))
    return rest / size


def principal(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """All squared singular values of a square matrix, falling, and unit right vectors of the ``most`` largest that are not zero.

    The largest entry of each vector is positive. Squares below the rounding of the largest count as zero.
    """
    diagonal, upper, right = bidiagonal(matrix)
    squares = squared_singular_values(diagonal, upper)
    rank = int((np.sqrt(squares) > 16 * len(squares) * _EPS * np.sqrt(squares.max(initial=0.0))).sum())
    vectors = right @ right_vectors(diagonal, upper, squares, min(most, rank)) if rank else np.zeros((len(matrix), 0))
    for column in vectors.T:
        column *= np.sign(column[np.argmax(np.abs(column))]) / np.linalg.norm(column)
    return squares, vectors
