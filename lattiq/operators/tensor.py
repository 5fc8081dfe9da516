"""Tensor algebra. Tensors are coordinates in Spark; the kernels work on bounded NumPy arrays.

The Gramian of a mode whose size is bounded is a grouped sum over pairs of its indices in a cell's fibre; its
eigenvectors are the mode's factor, found on the driver, and the entity mode is reached by sums alone, so
no matrix grows with the entities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators import cells
from lattiq.operators.folders import kept


def gramian(long: DataFrame, mode: str) -> DataFrame:
    """(i, j, g): sums over all other indices of the products of values at indices i <= j of a bounded mode, features or
    periods, for the pairs that some entity has together; one matrix of the mode's size from each task."""
    a = cells.axes(long)
    shape = (len(a.features), a.periods)
    names = list(a.features) if mode == "feature" else [a.first + k for k in range(a.periods)]
    n = len(names)

    def add(batch, total):
        for _, v in cells.dense(batch, a.size):
            v = v.reshape(len(v), *shape)
            x = (v.transpose(0, 2, 1) if mode == "feature" else v).reshape(-1, n)
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total.reshape(2, n, n)[...] += [x.T @ x, seen.T @ seen]

    g, together = cells.summed(cells.by_entity(long, a), add, 2 * n * n).reshape(2, n, n)
    rows = [(names[i], names[j], float(g[i, j])) for i in range(n) for j in range(i, n) if together[i, j]]
    kind = "string" if mode == "feature" else "int"
    return long.sparkSession.createDataFrame(rows, f"i {kind}, j {kind}, g double")


def entity_gramian(long: DataFrame) -> tuple[list, list, np.ndarray]:
    """Features, periods and G over pairs of cells (feature, period): products summed over all entities, missing as zero.

    G holds all that the factors of the two bounded modes depend on; the entities stay in Spark.
    """
    a = cells.axes(long)
    return list(a.features), list(range(a.first, a.first + a.periods)), cells.cell_gramian(cells.by_entity(long, a), a)


def _starts(g: np.ndarray, shape, ranks) -> list[np.ndarray]:
    """Leading eigenvectors of the Gramians of the features and periods, signs fixed by the largest entry."""
    g = g.reshape(*shape, *shape)
    return [_leading(m, r) for m, r in zip((np.einsum("fpgp->fg", g), np.einsum("fpfq->pq", g)), ranks)]


def _leading(g: np.ndarray, rank: int) -> np.ndarray:
    vector = np.linalg.eigh(g)[1][:, ::-1][:, :rank]
    return vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])


def cp_rank1_gramian(g: np.ndarray, shape, steps: int = 500, tol: float = 1e-6):
    """Weight, feature and period factor of ``cp`` of rank one, and errors, from ``entity_gramian``."""
    b, c = (u[:, 0] for u in _starts(g, shape, (1, 1)))
    norm, weight, errors = np.trace(g) or 1.0, 0.0, []
    for _ in range(steps):
        cell = np.kron(b, c)
        v = (g @ cell).reshape(shape) / (np.sqrt(max(cell @ g @ cell, 0.0)) or 1.0)
        b = v @ c
        b = b / (np.linalg.norm(b) or 1.0)
        c = b @ v
        weight = float(np.linalg.norm(c))
        c = c / (weight or 1.0)
        errors.append(float(np.sqrt(max(norm - weight**2, 0.0) / norm)))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol:
            break
    return weight, b, c, errors


def tucker_gramian(g: np.ndarray, shape, ranks, steps: int = 500, tol: float = 1e-6):
    """Feature and period factor of ``tucker`` of ranks (entity, feature, period), and errors, from ``entity_gramian``."""
    b, c = _starts(g, shape, ranks[1:])
    norm, errors = np.trace(g) or 1.0, []
    for _ in range(steps):
        _, z, b, c = _tucker_step(g, shape, ranks, b, c)
        core = mode_product(mode_product(z, b.T, 1), c.T, 2)
        errors.append(float(np.sqrt(max(norm - np.sum(core**2), 0.0) / norm)))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol:
            break
    return b, c, errors


def _tucker_step(g: np.ndarray, shape, ranks, b: np.ndarray, c: np.ndarray):
    """The entity factor as columns that cells are multiplied by, the tensor with that mode reduced, the next b and c."""
    q = np.kron(b, c)
    value, vector = np.linalg.eigh(q.T @ g @ q)
    keep = np.argsort(-value)[: ranks[0]]
    keep = keep[value[keep] > 1e-12 * (np.trace(g) or 1.0)]
    a = (q @ vector[:, keep]) / np.sqrt(value[keep])
    z = (a.T @ g).reshape(len(keep), *shape)
    return a, z, *_bounded_factors(z, c, ranks)


def _bounded_factors(z: np.ndarray, c: np.ndarray, ranks) -> tuple[np.ndarray, np.ndarray]:
    """The next feature and period factors, from the tensor with its entity mode reduced."""
    b = np.linalg.svd(unfold(mode_product(z, c.T, 2), 1), full_matrices=False)[0][:, : ranks[1]]
    return b, np.linalg.svd(unfold(mode_product(z, b.T, 1), 2), full_matrices=False)[0][:, : ranks[2]]


#: Cells (features x periods) up to which their Gramian is gathered: one pass instead of one or two for each step.
GRAM_CELLS = 2048


def mode_starts(rows: DataFrame, a: cells.Axes, ranks) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvectors of the feature and period Gramians, and the squared norm, from one pass."""
    n_f, n_p = len(a.features), a.periods

    def add(batch, total):
        for _, x in cells.dense(batch, a.size):
            x = np.nan_to_num(x).reshape(-1, n_f, n_p)
            total[: n_f * n_f].reshape(n_f, n_f)[...] += np.einsum("nfp,ngp->fg", x, x, optimize=True)
            total[n_f * n_f :].reshape(n_p, n_p)[...] += np.einsum("nfp,nfq->pq", x, x, optimize=True)

    sums = cells.summed(rows, add, n_f * n_f + n_p * n_p)
    both = sums[: n_f * n_f].reshape(n_f, n_f), sums[n_f * n_f :].reshape(n_p, n_p)
    return *(_leading(g, r) for g, r in zip(both, ranks)), float(np.trace(both[0])) or 1.0


def _projected(rows: DataFrame, a: cells.Axes, q: np.ndarray, gram: bool) -> np.ndarray:
    """Over all entities' cells x, with y = x q: the sum of y'y if ``gram``, else of y'x."""
    k, size = q.shape[1], a.size

    def add(batch, total):
        for _, x in cells.dense(batch, size):
            x = np.nan_to_num(x)
            y = x @ q
            total.reshape(k, -1)[...] += y.T @ (y if gram else x)

    return cells.summed(rows, add, k * (k if gram else size)).reshape(k, -1)


def tucker_contracted(rows: DataFrame, a: cells.Axes, ranks, steps: int = 500, tol: float = 1e-6):
    """``tucker_gramian`` without the Gramian of cells: a step takes two passes, whose sums are as large as the projected cells
    squared, and as the cells times the entity rank."""
    shape = (len(a.features), a.periods)
    b, c, norm = mode_starts(rows, a, ranks[1:])
    errors = []
    for _ in range(steps):
        q = np.kron(b, c)
        value, vector = np.linalg.eigh(_projected(rows, a, q, True))
        keep = np.argsort(-value)[: ranks[0]]
        keep = keep[value[keep] > 1e-12 * norm]
        z = _projected(rows, a, (q @ vector[:, keep]) / np.sqrt(value[keep]), False).reshape(len(keep), *shape)
        b, c = _bounded_factors(z, c, ranks)
        core = mode_product(mode_product(z, b.T, 1), c.T, 2)
        errors.append(float(np.sqrt(max(norm - np.sum(core**2), 0.0) / norm)))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol:
            break
    return b, c, errors


def cp_rank1_contracted(rows: DataFrame, a: cells.Axes, steps: int = 500, tol: float = 1e-6):
    """``cp_rank1_gramian`` without the Gramian of cells: a step takes one pass, whose sum is as large as the cells."""
    shape = (len(a.features), a.periods)
    b, c, norm = mode_starts(rows, a, (1, 1))
    b, c, weight, errors = b[:, 0], c[:, 0], 0.0, []
    for _ in range(steps):
        cell = np.kron(b, c)
        v = _projected(rows, a, cell[:, None], False)[0]
        v = v.reshape(shape) / (np.sqrt(max(v @ cell, 0.0)) or 1.0)
        b = v @ c
        b = b / (np.linalg.norm(b) or 1.0)
        c = b @ v
        weight = float(np.linalg.norm(c))
        c = c / (weight or 1.0)
        errors.append(float(np.sqrt(max(norm - weight**2, 0.0) / norm)))
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol:
            break
    return weight, b, c, errors


def tucker_factors(long: DataFrame, ranks, gram_cells: int = GRAM_CELLS):
    """(axes, feature factor, period factor, errors) of the Tucker model of a panel; ``ranks`` of entities, features, periods
    are cut to the sizes of the bounded modes."""
    a = cells.axes(long)
    shape = (len(a.features), a.periods)
    ranks = (ranks[0], min(shape[0], ranks[1]), min(shape[1], ranks[2]))
    rows = cells.by_entity(long, a)
    if a.size <= gram_cells:
        return a, *tucker_gramian(cells.cell_gramian(rows, a), shape, ranks)
    rows = rows.persist()
    try:
        return a, *tucker_contracted(rows, a, ranks)
    finally:
        rows.unpersist()


def cp_rank1(long: DataFrame, gram_cells: int = GRAM_CELLS):
    """(axes, weight, feature factor, period factor, errors) of the rank-one model of a panel."""
    a = cells.axes(long)
    rows = cells.by_entity(long, a)
    if a.size <= gram_cells:
        return a, *cp_rank1_gramian(cells.cell_gramian(rows, a), (len(a.features), a.periods))
    rows = rows.persist()
    try:
        return a, *cp_rank1_contracted(rows, a)
    finally:
        rows.unpersist()


class MaskedTucker:
    """A sweep of ``tucker`` over a tensor that is known by its ``entity_gramian`` alone.

    ``sweep`` gives the next state and the matrix that turns an entity's cells into their reconstruction."""

    def __init__(self, shape, ranks):
        self.shape, self.ranks = shape, ranks

    def start(self, g: np.ndarray, seed: int):
        """Random orthonormal factors of the window's seed."""
        rng = np.random.default_rng(seed)
        return [np.linalg.qr(rng.normal(size=(n, r)))[0] for n, r in zip(self.shape, self.ranks[1:])]

    def sweep(self, g: np.ndarray, state):
        a, z, b, c = _tucker_step(g, self.shape, self.ranks, *state)
        return (b, c), a @ z.reshape(len(z), len(g)) @ np.kron(b @ b.T, c @ c.T)


class MaskedCP:
    """A sweep of ``cp``, as ``MaskedTucker`` is one of ``tucker``."""

    def __init__(self, shape, rank):
        self.shape, self.rank = shape, rank

    def start(self, g: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        return [np.concatenate([u, rng.normal(size=(len(u), self.rank - u.shape[1]))], 1) for u in _starts(g, self.shape, (self.rank, self.rank))]

    def sweep(self, g: np.ndarray, state):
        b, c = state
        ridge = 1e-12 * np.eye(self.rank)
        a = np.linalg.solve((b.T @ b) * (c.T @ c) + ridge, khatri_rao([b, c]).T).T
        aa, xa = a.T @ g @ a, (g @ a).reshape(*self.shape, self.rank)
        b = np.linalg.solve(aa * (c.T @ c) + ridge, np.einsum("flr,lr->rf", xa, c)).T
        c = np.linalg.solve(aa * (b.T @ b) + ridge, np.einsum("flr,fr->rl", xa, b)).T
        return (b, c), a @ khatri_rao([b, c]).T


#: Bytes of Gramians that one pass over the rows sums at once.
PASS_BYTES = 64 << 20


def _arrays(batch: pa.RecordBatch, name: str, size: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)


def _lists(x: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel(), kind))


def impute(rows: DataFrame, model, steps: int, tol: float, seed: int = 42, fill: bool = False) -> DataFrame:
    """(win, entity, x, observed, error, failed): masked factorisations, one for each whole window.

    ``rows`` has a row for each window and entity, x being its cells in the order of the model's shape, NULL where
    missing. A pass sums each open window's Gramian of refilled cells; the driver makes of it the next matrix from cells
    to reconstruction; the next pass applies it to the rows, whose reconstructions are kept from pass to pass. A window
    ends when its error over observed cells changes by less than ``tol``; one that can't be solved gets zeros for what
    is missing, and error 1. The reconstruction takes the place of all cells, with ``fill`` of the missing ones only.
    """
    size = int(np.prod(model.shape))
    todo = sorted(r["win"] for r in rows.select("win").distinct().collect())
    share = max(1, PASS_BYTES // (8 * size * size))
    parts = [_imputed(rows, todo[k : k + share], model, size, steps, tol, seed, fill) for k in range(0, len(todo), share)] or [_imputed(rows, [], model, size, steps, tol, seed, fill)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _imputed(rows: DataFrame, wins: list[int], model, size: int, steps: int, tol: float, seed: int, fill: bool) -> DataFrame:
    state = kept(rows.where(F.col("win").isin(wins)).select(F.col("win").cast("int").alias("win"), F.col("entity").cast("long").alias("entity"), "x", F.transform("x", lambda v: F.lit(0.0)).alias("full")))
    errors, states, norms, done, first = {w: [] for w in wins}, {}, {}, {}, True
    while len(done) < len(wins):
        active = [w for w in wins if w not in done]
        sums = cells.summed(state.where(F.col("win").isin(active)), _window_sums({w: k for k, w in enumerate(active)}, size), len(active) * (size * size + 2)).reshape(len(active), -1)
        maps = {}
        for win, s in zip(active, sums):
            g = s[:-2].reshape(size, size)
            if first:
                scale = np.sqrt(np.trace(g) / s[-1]) + 1e-8 if s[-1] else 1.0
                norms[win] = (np.sqrt(np.trace(g)) or 1.0, scale)
            else:
                errors[win].append(float(np.sqrt(s[-2]) / norms[win][0]))
            e = errors[win]
            if len(e) == steps or len(e) > 1 and abs(e[-2] - e[-1]) < tol:
                done[win] = (e[-1], False)
                continue
            try:
                g = g / norms[win][1] ** 2
                states[win], maps[win] = model.sweep(g, states[win] if win in states else model.start(g, seed + win))
            except np.linalg.LinAlgError:
                maps[win] = None
                done[win] = (1.0, True)
        first = False
        if maps:
            before, state = state, kept(state.mapInArrow(_mapped(maps, size), state.schema))
            state.count()
            before.unpersist()
    ends = {w: done[w] for w in wins}

    def out(batches):
        for b in batches:
            if not len(b):
                continue
            x, full, win = _arrays(b, "x", size), _arrays(b, "full", size), b.column("win").to_pylist()
            seen = ~np.isnan(x)
            value = np.where(seen & (fill or np.array([ends[w][1] for w in win])[:, None]), x, full)
            yield pa.RecordBatch.from_arrays([b.column("win"), b.column("entity"), _lists(value, pa.float64()), _lists(seen, pa.bool_()), pa.array([ends[w][0] for w in win], pa.float64()), pa.array([ends[w][1] for w in win], pa.bool_())], names=["win", "entity", "x", "observed", "error", "failed"])

    return state.mapInArrow(out, "win int, entity long, x array<double>, observed array<boolean>, error double, failed boolean")


def _window_sums(place: dict[int, int], size: int):
    """Adds up, by window: the Gramian of refilled cells, the squares of what observed ones differ by, their number."""

    def add(batch, total):
        x, full, wins = _arrays(batch, "x", size), _arrays(batch, "full", size), np.asarray(batch.column("win"))
        out = total.reshape(len(place), -1)
        for win in np.unique(wins).tolist():
            mine = wins == win
            t, f = x[mine], full[mine]
            seen = ~np.isnan(t)
            r = np.where(seen, t, f)
            out[place[win], :-2] += (r.T @ r).ravel()
            out[place[win], -2:] += [np.sum((t - f)[seen] ** 2), seen.sum()]

    return add


def _mapped(maps: dict, size: int):
    """Puts each window's refilled cells through its map; without one (None) the reconstruction is zero."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            x, full, wins = _arrays(b, "x", size), _arrays(b, "full", size).copy(), np.asarray(b.column("win"))
            for win in np.unique(wins).tolist():
                if win in maps:
                    mine = wins == win
                    refilled = np.where(np.isnan(x[mine]), full[mine], x[mine])
                    full[mine] = refilled @ maps[win] if maps[win] is not None else 0.0
            yield pa.RecordBatch.from_arrays([b.column("win"), b.column("entity"), b.column("x"), _lists(full, pa.float64())], names=["win", "entity", "x", "full"])

    return run


def unfold(t: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(t, mode, 0).reshape(t.shape[mode], -1)


def mode_product(t: np.ndarray, m: np.ndarray, mode: int) -> np.ndarray:
    return np.moveaxis(np.tensordot(m, t, (1, mode)), 0, mode)


def khatri_rao(ms: list[np.ndarray]) -> np.ndarray:
    out = ms[0]
    for m in ms[1:]:
        out = (out[:, None, :] * m[None, :, :]).reshape(-1, out.shape[1])
    return out


def tucker(t: np.ndarray, ranks, steps: int = 500, tol: float = 1e-6, mask: np.ndarray | None = None, start: list | None = None):
    """Higher-order orthogonal iteration; missing cells are refilled from each reconstruction. ``start`` gives the first
    factors of all modes but the first one.
    Returns core, factors, and the relative error over observed cells by iteration."""
    mask = np.ones(t.shape, bool) if mask is None else mask
    x = np.where(mask, t, 0.0)
    norm = np.linalg.norm(x[mask]) or 1.0
    factors = [np.linalg.svd(unfold(x, k), full_matrices=False)[0][:, :r] for k, r in enumerate(ranks)]
    factors = factors[:1] + list(start) if start else factors
    errors: list[float] = []
    for _ in range(steps):
        for k in range(t.ndim):
            y = x
            for j in range(t.ndim):
                if j != k:
                    y = mode_product(y, factors[j].T, j)
            factors[k] = np.linalg.svd(unfold(y, k), full_matrices=False)[0][:, : ranks[k]]
        core = x
        for k, f in enumerate(factors):
            core = mode_product(core, f.T, k)
        full = rebuild_tucker(core, factors)
        errors.append(float(np.linalg.norm((t - full)[mask]) / norm))
        x = np.where(mask, t, full)
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol:
            break
    return core, factors, errors


def rebuild_tucker(core: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for k, f in enumerate(factors):
        core = mode_product(core, f, k)
    return core


def cp(t: np.ndarray, rank: int, steps: int = 500, tol: float = 1e-6, mask: np.ndarray | None = None, seed: int = 42):
    """Alternating least squares, missing cells refilled; returns weights, factors, errors."""
    mask = np.ones(t.shape, bool) if mask is None else mask
    x = np.where(mask, t, 0.0)
    norm = np.linalg.norm(x[mask]) or 1.0
    rng = np.random.default_rng(seed)
    factors = []
    for k in range(t.ndim):
        u = np.linalg.svd(unfold(x, k), full_matrices=False)[0][:, :rank]
        factors.append(np.concatenate([u, rng.normal(size=(t.shape[k], rank - u.shape[1]))], 1))
    errors: list[float] = []
    for _ in range(steps):
        for k in range(t.ndim):
            rest = [factors[j] for j in range(t.ndim) if j != k]
            gram = np.prod([f.T @ f for f in rest], 0) + 1e-12 * np.eye(rank)
            factors[k] = np.linalg.solve(gram, (unfold(x, k) @ khatri_rao(rest)).T).T
        full = rebuild_cp(np.ones(rank), factors)
        errors.append(float(np.linalg.norm((t - full)[mask]) / norm))
        x = np.where(mask, t, full)
        if len(errors) > 1 and abs(errors[-2] - errors[-1]) < tol:
            break
    weights = np.ones(rank)
    for k, f in enumerate(factors):
        size = np.linalg.norm(f, axis=0)
        weights, factors[k] = weights * size, f / np.where(size > 0, size, 1)
    return weights, factors, errors


def rebuild_cp(weights: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    return (khatri_rao(factors) @ weights).reshape([len(f) for f in factors])


def relative_error(t: np.ndarray, full: np.ndarray, mask: np.ndarray | None = None) -> float:
    """NaN for a zero tensor."""
    mask = np.ones(t.shape, bool) if mask is None else mask
    norm = np.linalg.norm(t[mask])
    return float(np.linalg.norm((t - full)[mask]) / norm) if norm else float("nan")
