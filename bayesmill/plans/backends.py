"""Cross-product representations behind one small interface, used inside tasks.

For coefficients t the state is the unexplained right-hand side g - G t, of
which a coordinate update reads one entry and changes the entries that its
column reaches.

    diag            G's diagonal
    reset(t)        rebuild the state
    rhs(j)          entry j of g - G t
    move(j, d)      account for t[j] += d
    part(idx)       the matrix of some predictors
    quadratic(t)    t' G t
    quadratics(...) the same of groups of predictors
    product(t)      G t
    residual(t)     sum of squares (y2 - 2 t'g + t'G t, with any offset)
"""

from __future__ import annotations

import numpy as np


class Dense:
    """A full symmetric matrix."""

    streaming = False  # whether a sweep keeps only the entries ahead of it, so that the state is rebuilt after each

    def __init__(self, gram: np.ndarray, g: np.ndarray, y2: float):
        self.gram, self.g, self.y2 = np.asfortranarray(gram, float), np.asarray(g, float), float(y2)
        self.diag = np.diag(self.gram).copy()

    def reset(self, t):
        self.q = self.g - self.product(t)

    def rhs(self, j):
        return self.q[j]

    def move(self, j, d):
        self.q -= self.gram[:, j] * d

    def product(self, t):
        return self.gram @ t

    def quadratic(self, t):
        return float(t @ self.product(t))

    def residual(self, t):
        return self.y2 - 2 * float(t @ self.g) + self.quadratic(t)

    def quadratics(self, t, groups, n):
        """t_b' G t_b of each of ``n`` groups of predictors."""
        return [self.quadratic(np.where(groups == b, t, 0.0)) for b in range(n)]

    def part(self, idx):
        """The matrix of some predictors."""
        out, unit = np.empty((len(idx), len(idx))), np.zeros(len(self.diag))
        for a, j in enumerate(idx):
            unit[j] = 1
            out[:, a] = self.product(unit)[idx]
            unit[j] = 0
        return out


class Columns:
    """A square matrix by columns: ``rows`` and ``values`` of column j are those from ``at[j]`` to ``at[j + 1]``."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, p: int):
        by = np.argsort(cols, kind="stable")
        self.rows, self.values, self.p = np.asarray(rows, np.int64)[by], np.asarray(values, float)[by], p
        self.cols = np.asarray(cols, np.int64)[by]
        self.at = np.searchsorted(self.cols, np.arange(p + 1))

    def column(self, j):
        return self.rows[self.at[j] : self.at[j + 1]], self.values[self.at[j] : self.at[j + 1]]

    def product(self, t):
        return np.bincount(self.rows, self.values * t[self.cols], self.p)


class Blocks(Dense):
    """Diagonal blocks, each kept dense, sparse (all its non-zeros) or as its lower triangle; predictors are in the order of the blocks.

    An update in a block kept as one triangle reaches only the places after it,
    so a sweep goes through such a block in its order, and the state is rebuilt
    after the sweep.
    """

    def __init__(self, blocks: list[np.ndarray], g: np.ndarray, y2: float, how: list[str] | None = None):
        self.how = how or ["dense"] * len(blocks)
        self.at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
        self.of = np.repeat(np.arange(len(blocks)), np.diff(self.at))
        self.g, self.y2 = np.asarray(g, float), float(y2)
        self.diag = np.concatenate([np.diag(b) for b in blocks]) if blocks else np.empty(0)
        self.blocks, self.streaming = [], "lower" in self.how
        for b, kind in zip(blocks, self.how, strict=True):
            if kind == "dense":
                self.blocks.append(np.asfortranarray(b, float))
            else:
                i, j = np.nonzero(b if kind == "sparse" else np.tril(b, -1))
                self.blocks.append(Columns(i, j, np.asarray(b)[i, j], len(b)))

    def move(self, j, d):
        b = self.of[j]
        a, z = self.at[b], self.at[b + 1]
        if self.how[b] == "dense":
            self.q[a:z] -= self.blocks[b][:, j - a] * d
        else:
            r, v = self.blocks[b].column(j - a)
            self.q[a + r] -= v * d
            if self.how[b] == "lower":
                self.q[j] -= self.diag[j] * d

    def product(self, t):
        out = np.empty(len(t))
        for m, kind, a, z in zip(self.blocks, self.how, self.at[:-1], self.at[1:], strict=True):
            x = t[a:z]
            out[a:z] = m @ x if kind == "dense" else m.product(x)
            if kind == "lower":
                out[a:z] += np.bincount(m.cols, m.values * x[m.rows], z - a) + self.diag[a:z] * x
        return out

    def part(self, idx):
        """The matrix of some predictors, block by block."""
        out, idx = np.zeros((len(idx), len(idx))), np.asarray(idx, np.int64)
        for b in np.unique(self.of[idx]).tolist():
            here = np.flatnonzero(self.of[idx] == b)
            unit = np.zeros(self.at[b + 1] - self.at[b])
            local, m = idx[here] - self.at[b], self.blocks[b]
            if self.how[b] == "dense":
                out[np.ix_(here, here)] = m[np.ix_(local, local)]
                continue
            for k, j in zip(here.tolist(), local.tolist(), strict=True):
                unit[:] = 0
                r, v = m.column(j)
                unit[r] = v
                if self.how[b] == "lower":
                    unit[j] = self.diag[idx[k]]
                out[here, k] = unit[local]
            if self.how[b] == "lower":
                mine = out[np.ix_(here, here)]
                out[np.ix_(here, here)] = np.where(mine != 0, mine, mine.T)
        return out


class Sparse(Dense):
    """Columns of a sparse symmetric matrix less a rank-one centre c c', which stays implicit.

    ``cols`` are (rows, values) pairs.
    """

    def __init__(self, cols: list[tuple[np.ndarray, np.ndarray]], g: np.ndarray, y2: float, centre: np.ndarray | None = None):
        self.cols, self.g, self.y2 = [(np.asarray(r, np.int64), np.asarray(v, float)) for r, v in cols], np.asarray(g, float), float(y2)
        p = len(cols)
        self.centre = np.zeros(p) if centre is None else np.asarray(centre, float)
        raw = np.array([v[r == j].sum() for j, (r, v) in enumerate(self.cols)])
        self.diag = raw - self.centre**2

    def reset(self, t):
        self.q = self.g - self._raw(t)
        self.ct = float(self.centre @ t)

    def rhs(self, j):
        return self.q[j] + self.centre[j] * self.ct

    def move(self, j, d):
        r, v = self.cols[j]
        self.q[r] -= v * d
        self.ct += self.centre[j] * d

    def _raw(self, t):
        out = np.zeros(len(self.cols))
        for j in np.flatnonzero(t):
            r, v = self.cols[j]
            out[r] += v * t[j]
        return out

    def product(self, t):
        return self._raw(t) - self.centre * float(self.centre @ t)


class Correlation(Dense):
    """diag(s) ((1 - shrink) R + shrink I) diag(s), R in blocks of strictly lower columns with a unit diagonal."""

    def __init__(self, blocks: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]], s: np.ndarray, g: np.ndarray, y2: float, shrink: float = 0.0):
        self.s, self.g, self.y2, self.keep = np.asarray(s, float), np.asarray(g, float), float(y2), 1.0 - shrink
        self.diag = self.s**2
        rows, cols, vals, at = [], [], [], 0
        for size, lower in blocks:
            n = [len(r) for r, _ in lower]
            rows.append(np.concatenate([np.empty(0, np.int64), *(r for r, _ in lower)]).astype(np.int64) + at)
            cols.append(np.repeat(np.arange(at, at + size), n))
            vals += [v for _, v in lower]
            at += size
        i, j, v = (np.concatenate([np.empty(0), *x]) for x in (rows, cols, vals))
        i, j = i.astype(np.int64), j.astype(np.int64)
        # both triangles, sorted by column once
        self.cells = Columns(np.concatenate([j, i]), np.concatenate([i, j]), np.concatenate([v, v]), at)

    def move(self, j, d):
        r, v = self.cells.column(j)
        self.q[r] -= self.s[r] * v * (self.keep * self.s[j] * d)
        self.q[j] -= self.diag[j] * d

    def product(self, t):
        u = self.s * t
        return self.s * (self.keep * self.cells.product(u) + u)

    def quadratics(self, t, groups, n):
        """All groups in one pass over the correlations, whatever their number."""
        if getattr(self, "_groups", None) is not groups:
            c = self.cells
            inside = np.flatnonzero(groups[c.rows] == groups[c.cols])
            self._groups, self._inside = groups, (c.rows[inside], c.cols[inside], c.values[inside], groups[c.rows[inside]])
        i, j, v, of = self._inside
        u = self.s * t
        return (self.keep * np.bincount(of, v * u[i] * u[j], n) + np.bincount(groups, u * u, n)).tolist()


class LowRank(Dense):
    """G_b = Q_b' Q_b in blocks, each with a residual w_b - Q_b t_b of its own; ``offset`` is what no Q explains."""

    def __init__(self, factors: list[np.ndarray], targets: list[np.ndarray], offset: float = 0.0):
        self.factors = [np.asfortranarray(f, float) for f in factors]
        self.targets, self.offset = [np.asarray(w, float) for w in targets], float(offset)
        self.at = np.concatenate([[0], np.cumsum([f.shape[1] for f in factors])])
        self.of = np.repeat(np.arange(len(factors)), np.diff(self.at))
        self.diag = np.concatenate([(f**2).sum(axis=0) for f in self.factors])
        self.g = np.concatenate([f.T @ w for f, w in zip(self.factors, self.targets, strict=True)])
        self.y2 = self.offset + sum(float(w @ w) for w in self.targets)

    def _each(self, t):
        return [f @ t[a:z] for f, a, z in zip(self.factors, self.at[:-1], self.at[1:], strict=True)]

    def reset(self, t):
        self.res = [w - x for w, x in zip(self.targets, self._each(t), strict=True)]

    def rhs(self, j):
        b = self.of[j]
        return float(self.factors[b][:, j - self.at[b]] @ self.res[b])

    def move(self, j, d):
        b = self.of[j]
        self.res[b] -= self.factors[b][:, j - self.at[b]] * d

    def product(self, t):
        return np.concatenate([f.T @ x for f, x in zip(self.factors, self._each(t), strict=True)])

    def quadratic(self, t):
        return sum(float(x @ x) for x in self._each(t))

    def residual(self, t):
        return self.offset + sum(float(((w - x) ** 2).sum()) for w, x in zip(self.targets, self._each(t), strict=True))


def guard(value: float, scale: float, what: str) -> float:
    """A sum of squares: small negative values are rounding and become 0, others mean that the statistics disagree."""
    limit = 1e-8 * max(1.0, scale)
    if not np.isfinite(value) or value < -limit:
        raise ValueError(f"{what} is {value}: the cross-products do not belong together")
    return max(value, 0.0)
