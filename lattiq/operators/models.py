"""Regression kernels (bounded NumPy arrays) and distribution functions."""

from __future__ import annotations

import math

import numpy as np

from lattiq.operators.panel import folds
from lattiq.operators.tensor import khatri_rao


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    return np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)


def fixed_effects_ridge(entity, win, x, y, alphas, n_win: int, least: int = 25) -> dict:
    """Ridge after taking off entity means of the training windows; the penalty by inner expanding folds."""

    def demean(train):
        known = np.unique(entity[train])
        means = {e: y[train & (entity == e)].mean() for e in known}
        return np.array([means.get(e, y[train].mean()) for e in entity])

    best, pick = math.inf, 100.0
    for a in alphas:
        errors = []
        for end, upto in folds(n_win):
            train, val = win < end, (win >= end) & (win < upto)
            if train.sum() < least or val.sum() < least:
                continue
            m = demean(train)
            errors.append(np.mean((y[val] - m[val] - x[val] @ ridge(x[train], (y - m)[train], a)) ** 2))
        if errors and np.mean(errors) < best:
            best, pick = float(np.mean(errors)), a
    every = np.ones(len(y), bool)
    m = demean(every)
    return {"alpha": pick, "beta": ridge(x, y - m, pick), "means": m}


def cp_regression(x: np.ndarray, y: np.ndarray, rank: int, penalty: float, steps: int = 150, tol: float = 1e-6, seed: int = 42, start: list[np.ndarray] | None = None):
    """Y ~ <X, W> with W = sum of rank-one tensors over the modes of X, then those of Y.

    Each factor in turn is a ridge solution with the others held. Returns factors and objectives."""
    rng = np.random.default_rng(seed)
    n_in = x.ndim - 1
    factors = [f.copy() for f in start] if start else [rng.normal(size=(d, rank)) * 0.5 for d in (*x.shape[1:], *y.shape[1:])]
    flat_y = y.reshape(len(y), -1)
    objectives: list[float] = []

    def sides():
        return x.reshape(len(x), -1) @ khatri_rao(factors[:n_in]), khatri_rao(factors[n_in:])

    for _ in range(steps):
        for k, f in enumerate(factors):
            if k < n_in:
                other = khatri_rao([g for j, g in enumerate(factors[:n_in]) if j != k]) if n_in > 1 else np.ones((1, rank))
                z = np.moveaxis(x, k + 1, 1).reshape(len(x), f.shape[0], -1) @ other  # (t, d, r)
                out = khatri_rao(factors[n_in:])
                gram = np.einsum("tdr,tes,rs->dres", z, z, out.T @ out).reshape(f.size, f.size)
                right = np.einsum("tdr,to,or->dr", z, flat_y, out).ravel()
            else:
                s, _ = sides()
                rest = [g for j, g in enumerate(factors[n_in:]) if j != k - n_in]
                other = khatri_rao(rest) if rest else np.ones((1, rank))
                yk = np.moveaxis(y, k - n_in + 1, 1).reshape(len(y), f.shape[0], -1)
                gram = np.kron(np.eye(f.shape[0]), (s.T @ s) * (other.T @ other))
                right = np.einsum("tdo,tr,or->dr", yk, s, other).ravel()
            factors[k] = np.linalg.solve(gram + penalty * np.eye(f.size), right).reshape(f.shape)
        s, out = sides()
        objectives.append(float(np.sum((flat_y - s @ out.T) ** 2) + penalty * sum(np.sum(f**2) for f in factors)))
        if len(objectives) > 1 and abs(objectives[-2] - objectives[-1]) <= tol * max(objectives[-2], 1e-12):
            break
    return factors, objectives


class StructuredCp:
    """``cp_regression`` of windows (entities, features, lags) on targets (entities, features), from sums over entities.

    The entities' factors are linear in the entities' own cells, since a ridge solution lies in the span of its
    data: the factor of the inputs is x P and that of the targets y Q, where x are an entity's cells (features x periods), y its
    training targets (features x windows), and P and Q are bounded. What a sweep needs of all entities are the products of
    cells, ``gxx`` and ``gyy``, so one pass over the panel serves all sweeps; the factor of the inputs' entities is solved by
    its dual, a system of training windows x rank. ``starts`` are the places of all windows' first inputs, of which
    the first ``train`` train; ``weight`` multiplies a window's inputs.
    """

    def __init__(self, gxx: np.ndarray, gyy: np.ndarray, shape: tuple[int, int], starts: np.ndarray, weight: np.ndarray, lags: int, train: int, rank: int, penalty: float, steps: int = 150, tol: float = 1e-6, seed: int = 42):
        (n_f, n_p), rng = shape, np.random.default_rng(seed)
        self.starts, self.weight, self.lags, self.train = starts, weight, lags, train
        b, c, e = (rng.normal(size=(d, rank)) * 0.5 for d in (n_f, lags, n_f))
        q = rng.normal(size=(n_f * train, rank)) * 0.5
        self.first = (b, c, q, e)
        t0, w0, one = starts[:train], weight[:train], np.eye(rank)
        cells = gxx.reshape(n_f, n_p, n_f, n_p)
        yy, self.objectives = np.trace(gyy), []
        gq = (gyy @ q).reshape(n_f, train, rank)
        dd = q.T @ gyy @ q
        for _ in range(steps):
            h = dd * (e.T @ e)
            g = np.einsum("ftr,fr->tr", gq, e)
            # the inputs' entities, by their dual
            m = np.einsum("fr,fpgq,gr->rpq", b, cells, b, optimize=True)
            k = np.zeros((rank, train, train))
            for i in range(lags):
                for j in range(lags):
                    k += c[i, :, None, None] * c[j, :, None, None] * m[:, t0 + i][:, :, t0 + j]
            k *= w0[:, None] * w0
            system = (h[:, None, :, None] * k.transpose(1, 0, 2)[None]).reshape(rank * train, rank * train)
            dual = np.linalg.solve(system + penalty * np.eye(rank * train), g.T.ravel()).reshape(rank, train).T
            spread = np.zeros((n_p, rank))
            for i in range(lags):
                spread[t0 + i] += w0[:, None] * dual * c[i]
            p = (b[:, None] * spread).reshape(n_f * n_p, rank)
            v = (gxx @ p).reshape(n_f, n_p, rank)
            # features and lags of the inputs
            lagged = np.stack([v[:, t0 + i] for i in range(lags)], 2) * w0[:, None, None]  # features, windows, lags, rank
            u = np.einsum("ftlr,lr->tfr", lagged, c)
            b = np.linalg.solve(np.einsum("tfr,tgs,rs->frgs", u, u, h, optimize=True).reshape(b.size, b.size) + penalty * np.eye(b.size), np.einsum("tfr,tr->fr", u, g).ravel()).reshape(b.shape)
            u = np.einsum("ftlr,fr->tlr", lagged, b)
            c = np.linalg.solve(np.einsum("tfr,tgs,rs->frgs", u, u, h, optimize=True).reshape(c.size, c.size) + penalty * np.eye(c.size), np.einsum("tfr,tr->fr", u, g).ravel()).reshape(c.shape)
            s = np.einsum("tlr,lr->tr", u, c)
            # entities and features of the targets
            ss = s.T @ s
            q = np.linalg.solve(ss * (e.T @ e) + penalty * one, (e[:, None] * s).reshape(n_f * train, rank).T).T
            gq, dd = (gyy @ q).reshape(n_f, train, rank), q.T @ gyy @ q
            e = np.linalg.solve(ss * dd + penalty * one, np.einsum("ftr,tr->rf", gq, s)).T
            fit = yy - 2 * np.einsum("ftr,fr,tr->", gq, e, s) + np.sum(ss * dd * (e.T @ e))
            norms = np.sum(p * v.reshape(p.shape)) + np.trace(dd) + sum(np.sum(x**2) for x in (b, c, e))
            self.objectives.append(float(fit + penalty * norms))
            if len(self.objectives) > 1 and abs(self.objectives[-2] - self.objectives[-1]) <= tol * max(self.objectives[-2], 1e-12):
                break
        self.b, self.c, self.e, self.p, self.q = b, c, e, p, q
        lagged = np.stack([v[:, starts + i] for i in range(lags)], 2) * weight[:, None, None]
        self.scores = np.einsum("ftlr,fr,lr->tr", lagged, b, c)  # of all windows

    def predict(self, y: np.ndarray) -> np.ndarray:
        """(entities, features, windows) from the entities' training targets (entities, features x windows), missing as zero."""
        return np.einsum("nr,fr,tr->nft", y @ self.q, self.e, self.scores, optimize=True)


class DualRidge:
    """Ridge with intercept from all inputs of a window to all targets, by products between windows.

    ``kx`` has them for the inputs of all windows, ``ky`` for the training targets; the first ``train`` windows train. The
    penalty has the least leave-one-out error. Coefficients, which would be as many as inputs times targets, are never
    made: a prediction is ``shares`` (windows x training windows) times a target's training values."""

    def __init__(self, kx: np.ndarray, ky: np.ndarray, train: int, alphas):
        centre = np.eye(train) - 1 / train
        inner = centre @ kx[:train, :train] @ centre
        value, vector = np.linalg.eigh(inner)
        value = np.maximum(value, 0)
        yc = centre @ ky @ centre

        def left(a: float) -> np.ndarray:
            """From training targets to their leave-one-out errors."""
            fit = (vector * (value / (value + a))) @ vector.T
            return (centre - fit) / np.maximum(1 - np.diag(fit) - 1 / train, 1e-12)[:, None]

        self.alpha = min(alphas, key=lambda a: float(np.sum(left(a) * (left(a) @ yc))))
        across = (kx[:, :train] - kx[:train, :train].mean(0)) @ centre
        self.shares = across @ (vector / (value + self.alpha)) @ vector.T @ centre + 1 / train


def cp_predict(x: np.ndarray, factors: list[np.ndarray], out_shape) -> np.ndarray:
    n_in = x.ndim - 1
    return ((x.reshape(len(x), -1) @ khatri_rao(factors[:n_in])) @ khatri_rao(factors[n_in:]).T).reshape(len(x), *out_shape)


def cp_regression_sums(xx: np.ndarray, xy: np.ndarray, yy: float, x_shape, rank: int, penalty: float, steps: int = 150, tol: float = 1e-6, seed: int = 42):
    """cp_regression for a matrix target, from X'X, X'Y and the sum of squares of Y alone: the same factors and objectives."""
    rng = np.random.default_rng(seed)
    n_in, n_out = len(x_shape), xy.shape[1]
    factors = [rng.normal(size=(d, rank)) * 0.5 for d in (*x_shape, n_out)]
    objectives: list[float] = []
    for _ in range(steps):
        for k, f in enumerate(factors):
            if k < n_in:
                # basis[:, d, r] maps entry (d, r) of the factor to the flat weights of term r
                basis = np.zeros((int(np.prod(x_shape)), f.shape[0], rank))
                for d in range(f.shape[0]):
                    unit = np.zeros_like(f)
                    unit[d] = 1
                    basis[:, d] = khatri_rao([unit if j == k else g for j, g in enumerate(factors[:n_in])])
                out = factors[n_in]
                gram = np.einsum("idr,ij,jes,rs->dres", basis, xx, basis, out.T @ out, optimize=True).reshape(f.size, f.size)
                right = np.einsum("idr,io,or->dr", basis, xy, out, optimize=True).ravel()
            else:
                w = khatri_rao(factors[:n_in])
                gram = np.kron(np.eye(n_out), w.T @ xx @ w)
                right = (xy.T @ w).ravel()
            factors[k] = np.linalg.solve(gram + penalty * np.eye(f.size), right).reshape(f.shape)
        w = khatri_rao(factors[:n_in]) @ factors[n_in].T
        objectives.append(float(yy - 2 * np.sum(w * xy) + np.sum(w * (xx @ w)) + penalty * sum(np.sum(f**2) for f in factors)))
        if len(objectives) > 1 and abs(objectives[-2] - objectives[-1]) <= tol * max(objectives[-2], 1e-12):
            break
    return factors, objectives


def affinity_propagation(x: np.ndarray, damping: float = 0.5, steps: int = 200, stable: int = 15) -> np.ndarray:
    """Labels by message passing; preference: the median similarity."""
    n = len(x)
    s = -((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]) if n > 1 else 0)
    r, a, rows, last, same = np.zeros((n, n)), np.zeros((n, n)), np.arange(n), None, 0
    for _ in range(steps):
        both = a + s
        top = both.argmax(1)
        first = both[rows, top]
        both[rows, top] = -np.inf
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - both.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[rows, rows] = r[rows, rows]
        col = p.sum(0)
        new = np.minimum(col[None, :] - p, 0)
        new[rows, rows] = col - r[rows, rows]
        a = damping * a + (1 - damping) * new
        chosen = (a + r).diagonal() > 0
        same = same + 1 if last is not None and (chosen == last).all() else 0
        last = chosen
        if same >= stable and chosen.any():
            break
    heads = np.flatnonzero(last)
    if not len(heads):
        return np.zeros(n, int)
    label = s[:, heads].argmax(1)
    label[heads] = np.arange(len(heads))
    return label


def adjusted_mutual_information(a, b) -> float:
    """Of two labelings; places where either label is missing (None or NaN) are left out."""
    known = [x is not None and x == x and y is not None and y == y for x, y in zip(a, b)]
    a, b = (np.array([x for x, k in zip(v, known) if k]) for v in (a, b))
    if not len(a):
        return float("nan")
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    table = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(table, (a, b), 1)
    return table_information(table)


def table_information(table: np.ndarray) -> float:
    """Adjusted mutual information from the counts of pairs of labels."""
    n = int(table.sum())
    ra, cb = table.sum(1), table.sum(0)
    entropy = lambda c: -sum(x / n * math.log(x / n) for x in c if x)
    mi = sum(table[i, j] / n * math.log(n * table[i, j] / (ra[i] * cb[j])) for i, j in zip(*np.nonzero(table)))
    lf = [math.lgamma(k + 1) for k in range(n + 1)]
    expected = 0.0
    for x in map(int, ra):
        for y in map(int, cb):
            for k in range(max(1, x + y - n), min(x, y) + 1):
                p = lf[x] + lf[y] + lf[n - x] + lf[n - y] - lf[n] - lf[k] - lf[x - k] - lf[y - k] - lf[n - x - y + k]
                expected += k / n * math.log(n * k / (x * y)) * math.exp(p)
    below = (entropy(ra) + entropy(cb)) / 2 - expected
    return 1.0 if abs(below) < 1e-12 else float((mi - expected) / below)


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def wilcoxon_p(w: float, n: int, ties: float = 0.0) -> float:
    """Two-sided p-value of the smaller rank sum; ``ties`` is the sum of t ** 3 - t over groups of t equal ranks."""
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)  # in how many ways ranks 1 to n add up to each sum
        for k in range(1, n + 1):
            for total in range(len(ways) - 1, k - 1, -1):
                ways[total] += ways[total - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    return normal_p((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation, by the t distribution."""
    if abs(rho) >= 1:
        return 0.0
    return student_p(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)

    def fraction(x, a, b):
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        h = d
        for m in range(1, 300):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / ((1 + top * d) or 1e-30), (1 + top / c) or 1e-30
                h *= c * d
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def student_p(t: float, df: float) -> float:
    """Two-sided p-value."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def fisher_p(f: float, above: float, below: float) -> float:
    """Upper p-value of an F statistic with these degrees of freedom."""
    return incomplete_beta(below / (below + above * f), below / 2, above / 2) if f > 0 else 1.0
