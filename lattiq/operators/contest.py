"""Structured tensor regression against fixed-effects ridge, on a whole panel.

Both forecast a cell from the windows before it, after taking off the mean of its entity and feature in the training
windows (of its feature, where it was never seen there). One pass over the entities adds up what both models need (see
``cells.summed``); the driver solves them, in sizes of features, lags and windows; and tasks apply the
solved models, entity by entity, which gives a table of predictions. Scores are aggregates of that table.

Cuts are (a, b): windows before a train, those from a to b are scored. Three cuts are the expanding folds of the
development windows, the last one holds out the windows after these. Ridge finds its penalty by inner folds of each cut's
training windows, with means of the inner training windows alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators import models, panel
from lattiq.operators.cells import Axes, axes, by_entity, cell_gramian, dense, summed

ALPHAS = [10.0**k for k in range(-2, 5)]
HELD_OUT = 3


@dataclass
class Panel:
    """A panel's rows by entity (kept in memory and on disk), its axes, and sums by cell: count, values, squares."""

    rows: DataFrame
    axes: Axes
    cells: np.ndarray
    entities: int

    def drop(self) -> None:
        self.rows.unpersist()


def load(long: DataFrame) -> Panel:
    a = axes(long)
    rows = by_entity(long, a).persist()

    def add(batch, total):
        for _, v in dense(batch, a.size):
            total[-1] += len(v)
            total[:-1].reshape(3, a.size)[...] += [(~np.isnan(v)).sum(0), np.nansum(v, 0), np.nansum(v * v, 0)]

    sums = summed(rows, add, 3 * a.size + 1)
    return Panel(rows, a, sums[:-1].reshape(3, len(a.features), a.periods), int(sums[-1]))


def pooled_least(cells: int) -> int:
    """How many cells a score or a scale needs: a twentieth of the possible ones, within bounds."""
    return max(100, min(5000, int(0.05 * cells)))


def feature_least(cells: float) -> int:
    """The same for one feature, from a twentieth of its mean number of seen cells."""
    return max(10, min(200, int(0.05 * cells)))


@dataclass
class Design:
    """Windows of a panel: where inputs start, what multiplies them, how many lags."""

    starts: np.ndarray
    weight: np.ndarray
    lags: int

    def inputs(self, v: np.ndarray) -> np.ndarray:
        """(entities, windows, lags x features) of cells (entities, features, periods), missing as zero, oldest lag first."""
        x = np.nan_to_num(v)
        return np.concatenate([(x[:, :, self.starts + i] * self.weight).transpose(0, 2, 1) for i in range(self.lags)], 2)

    def targets(self, v: np.ndarray) -> np.ndarray:
        """(entities, features, windows), NaN where missing."""
        return v[:, :, self.starts + self.lags]


def design(p: Panel, mode: str, lags: int) -> Design:
    """``levels`` takes inputs as they are, ``surprise`` divides a window's by the RMS of its seen ones; targets stay."""
    starts = p.axes.windows(lags)
    weight = np.ones(len(starts))
    if mode == "surprise":
        n, squares = (sum(x.sum(0)[starts + i] for i in range(lags)) for x in (p.cells[0], p.cells[2]))
        weight = 1 / (np.where(n > 0, np.sqrt(squares / np.maximum(n, 1)), 1.0) + 1e-8)
    return Design(starts, weight, lags)


def train_means(y: np.ndarray, a: int, fallback: np.ndarray) -> np.ndarray:
    """(entities, features): means of the windows before a."""
    seen = ~np.isnan(y[:, :, :a])
    n = seen.sum(2)
    return np.where(n > 0, np.where(seen, y[:, :, :a], 0).sum(2) / np.maximum(n, 1), fallback)


def fallbacks(p: Panel, d: Design, cuts: list) -> np.ndarray:
    """(cuts, features): means of the features' training cells."""
    n, y = (x[:, d.starts + d.lags] for x in p.cells[:2])
    return np.array([y[:, :a].sum(1) / (n[:, :a].sum(1) + 1e-8) for a, _ in cuts])


class Sums:
    """By cut, side (0 trains, 1 is scored) and feature: ``n``, ``rr``, ``xr``, ``xx`` of inputs and centred targets; for
    the first ``crossed`` cuts also ``gyy``, the products of training targets over features and windows."""

    def __init__(self, p: Panel, d: Design, cuts: list[tuple[int, int]], crossed: int):
        k, width = len(p.axes.features), len(p.axes.features) * d.lags
        means = fallbacks(p, d, cuts)
        edges = sorted({0, *(x for cut in cuts for x in cut)})
        spans = list(zip(edges, edges[1:]))
        shapes = {"n": (len(cuts), 2, k), "rr": (len(cuts), 2, k), "xr": (len(cuts), 2, k, width), "parts": (len(spans), k, width, width)}
        shapes |= {f"gyy{i}": (k * cuts[i][0],) * 2 for i in range(crossed)}
        ends = np.cumsum([int(np.prod(s)) for s in shapes.values()])

        def views(total):
            return {name: part.reshape(shape) for (name, shape), part in zip(shapes.items(), np.split(total, ends[:-1]))}

        size = p.axes.size

        def add(batch, total):
            out = views(total)
            for _, v in dense(batch, size):
                v = v.reshape(len(v), k, -1)
                x, y = d.inputs(v), d.targets(v)
                seen = ~np.isnan(y)
                for i, (a, b) in enumerate(spans):
                    for j in range(k):
                        rows = x[:, a:b][seen[:, j, a:b]]
                        out["parts"][i, j] += rows.T @ rows
                for i, (a, b) in enumerate(cuts):
                    r = np.where(seen, y - train_means(y, a, means[i])[:, :, None], 0)
                    for side, at in enumerate((slice(0, a), slice(a, b))):
                        out["n"][i, side] += seen[:, :, at].sum((0, 2))
                        out["rr"][i, side] += (r[:, :, at] ** 2).sum((0, 2))
                        out["xr"][i, side] += np.einsum("nft,ntp->fp", r[:, :, at], x[:, at], optimize=True)
                    if i < crossed:
                        t = r[:, :, :a].reshape(len(r), -1)
                        out[f"gyy{i}"] += t.T @ t

        out = views(summed(p.rows, add, int(ends[-1])))
        self.n, self.rr, self.xr = out["n"], out["rr"], out["xr"]
        self.gyy = [out[f"gyy{i}"] for i in range(crossed)]
        self.xx = np.zeros((len(cuts), 2, k, width, width))
        for i, (a, b) in enumerate(cuts):
            for (low, high), part in zip(spans, out["parts"]):
                if high <= a:
                    self.xx[i, 0] += part
                elif low >= a and high <= b:
                    self.xx[i, 1] += part

    def solve(self, cut: int, j: int, alpha: float) -> np.ndarray:
        return np.linalg.solve(self.xx[cut, 0, j] + alpha * np.eye(self.xx.shape[-1]), self.xr[cut, 0, j])

    def error(self, cut: int, j: int, beta: np.ndarray) -> float:
        """The mean square over a cut's scored cells."""
        return float((self.rr[cut, 1, j] - 2 * beta @ self.xr[cut, 1, j] + beta @ self.xx[cut, 1, j] @ beta) / self.n[cut, 1, j])


def ridge(s: Sums, cut: int, inner: list[int], need: int) -> tuple[list[float | None], np.ndarray]:
    """Penalties and coefficients by feature: the penalty of least mean error over inner folds that have enough cells on
    either side, the first of equal ones, 100 without such a fold; a feature with too few cells keeps to the means."""
    k = s.n.shape[2]
    alphas, beta = [], np.zeros((k, s.xx.shape[-1]))
    for j in range(k):
        if s.n[cut, 0, j] < need:
            alphas.append(None)
            continue
        best, alpha = np.inf, 100.0
        for a in ALPHAS:
            errors = [s.error(i, j, s.solve(i, j, a)) for i in inner if s.n[i, 0, j] >= need and s.n[i, 1, j] >= need]
            if errors and np.mean(errors) < best:
                best, alpha = float(np.mean(errors)), a
        alphas.append(alpha)
        beta[j] = s.solve(cut, j, alpha)
    return alphas, beta


@dataclass
class Fitted:
    """Solved models of a configuration; by cut: penalties, coefficients, tensor regression (None: too few cells), and
    what its targets were divided and its predictions are multiplied by."""

    mode: str
    design: Design
    cuts: list[tuple[int, int]]
    means: np.ndarray
    alphas: list
    betas: list[np.ndarray]
    tensors: list
    scales: list[tuple[float, float]]


def fit(p: Panel, gxx: np.ndarray, mode: str, lags: int, rank: int, penalty: float, least: int | None = None, scaled: bool = True) -> Fitted:
    """Both models on every cut. ``least`` overrides the thresholds for one feature and for the scale."""
    d = design(p, mode, lags)
    k, n = len(p.axes.features), len(d.starts)
    n_dev = int(0.8 * n)
    cuts = [c for c in panel.folds(n_dev) if c[0] > 0 and c[1] > c[0]] + [(n_dev, n)]
    every = list(cuts)
    inner = []
    for a, _ in cuts:
        mine = [c for c in panel.folds(a) if c[0] > 0 and c[1] > c[0]]
        inner.append([len(every) + i for i in range(len(mine))])
        every += mine
    s = Sums(p, d, every, len(cuts))
    out = Fitted(mode, d, cuts, fallbacks(p, d, cuts), [], [], [], [])
    for i, (a, _) in enumerate(cuts):
        seen = s.n[i, 0].sum()
        alphas, beta = ridge(s, i, inner[i], feature_least(seen / k) if least is None else least)
        out.alphas.append(alphas)
        out.betas.append(beta)
        if scaled and seen <= (pooled_least(p.entities * a * k) if least is None else least):
            out.tensors.append(None)
            out.scales.append((1.0, 1.0))
            continue
        scale = float(np.sqrt(s.rr[i, 0].sum() / max(seen, 1))) if scaled else 1.0
        by = scale + 1e-8 if scaled else 1.0
        out.tensors.append(models.StructuredCp(gxx, s.gyy[i] / by**2, (k, p.axes.periods), d.starts, d.weight, lags, a, rank, penalty))
        out.scales.append((by, scale))
    return out


def predictions(rows: DataFrame, a: Axes, f: Fitted) -> DataFrame:
    """(cut, entity, feature, win, y, ridge, cp) of every seen cell of the scored windows; ``cp`` is NULL where it wasn't
    fitted. The solved models go to the tasks: features x windows x rank numbers."""
    k, names = len(a.features), np.array([str(x) for x in a.features], object)

    def run(batches):
        for batch in batches:
            for at, v in dense(batch, a.size):
                v = v.reshape(len(v), k, -1)
                x, y = f.design.inputs(v), f.design.targets(v)
                for i, (start, end) in enumerate(f.cuts):
                    m = train_means(y, start, f.means[i])
                    ridged = m[:, :, None] + np.einsum("ntp,fp->nft", x[:, start:end], f.betas[i], optimize=True)
                    e, j, t = np.nonzero(~np.isnan(y[:, :, start:end]))
                    cp = pa.nulls(len(e), pa.float64())
                    if f.tensors[i] is not None:
                        by, scale = f.scales[i]
                        rest = np.nan_to_num(y[:, :, :start] - m[:, :, None]).reshape(len(v), -1) / by
                        cp = pa.array((m[:, :, None] + scale * f.tensors[i].predict(rest)[:, :, start:end])[e, j, t])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(e), i if end <= f.cuts[-1][0] else HELD_OUT, np.int32)), batch.column("entity").take(pa.array(at[e])), pa.array(names[j], pa.string()), pa.array((t + start).astype(np.int32)), pa.array(y[:, :, start:end][e, j, t]), pa.array(ridged[e, j, t]), cp],
                        names=["cut", "entity", "feature", "win", "y", "ridge", "cp"],
                    )

    kind = rows.schema["entity"].dataType.simpleString()
    return rows.mapInArrow(run, f"cut int, entity {kind}, feature string, win int, y double, ridge double, cp double")


def r2(p: str):
    """Of a column of predictions, over the seen cells of a group that it has; NULL without spread."""
    y, seen = F.col("y"), F.col(p).isNotNull()
    spread = F.count(F.when(seen, y)) * F.var_pop(F.when(seen, y))
    return F.when(spread > 1e-8, 1 - F.sum((y - F.col(p)) ** 2) / spread)


def moments(p: str) -> list:
    """Of a column of predictions, over the seen cells of a group that it has: their number, mean, variance, squared errors."""
    y, seen = F.col("y"), F.col(p).isNotNull()
    mine = F.when(seen, y)
    return [F.count(mine).alias(f"{p}_n"), F.avg(mine).alias(f"{p}_mean"), F.var_pop(mine).alias(f"{p}_var"), F.sum((y - F.col(p)) ** 2).alias(f"{p}_sse")]


def joint(groups: list) -> dict:
    """n, and each model's ``r2``, of groups of cells together, from their ``moments``."""
    out = {"n": sum(r["n"] for r in groups)}
    for p in ("ridge", "cp"):
        known = [r for r in groups if r[f"{p}_n"]]
        n = sum(r[f"{p}_n"] for r in known)
        mean = sum(r[f"{p}_n"] * r[f"{p}_mean"] for r in known) / n if n else 0.0
        spread = sum(r[f"{p}_n"] * (r[f"{p}_var"] + (r[f"{p}_mean"] - mean) ** 2) for r in known)
        out[p] = 1 - sum(r[f"{p}_sse"] for r in known) / spread if spread > 1e-8 else None
    return out


def scores(table: DataFrame, f: Fitted, p: Panel, least: int | None = None) -> tuple[list[dict], dict]:
    """Scores by feature, and pooled ones, from a table of predictions: means over the folds (of pooled ones, each
    bounded by -1), and of the held-out windows. A score needs its threshold's number of cells; a fold without a tensor
    regression counts for neither model."""
    got = table.groupBy("cut", "feature").agg(F.count("*").alias("n"), *[m for model in ("ridge", "cp") for m in moments(model)])
    k = len(p.axes.features)
    found = got.collect()  # cuts x features; the table is made once, its groups are put together here
    by = {(r["cut"], r["feature"]): joint([r]) for r in found}
    pooled = {cut: joint([r for r in found if r["cut"] == cut]) for cut in {r["cut"] for r in found}}
    folds = [i for i in range(len(f.cuts) - 1) if f.tensors[i] is not None]

    def mean(values):
        known = [v for v in values if v is not None]
        return float(np.mean(known)) if known else None

    def enough(r, need, name):
        return None if r is None or r["n"] < need else r[name]

    def need(cut):
        return (feature_least(pooled[cut]["n"] / k) if cut in pooled else 1) if least is None else least

    def need_all(cut):
        a, b = f.cuts[-1 if cut == HELD_OUT else cut]
        return pooled_least(p.entities * (b - a) * k) if least is None else least

    rows = []
    for name in map(str, p.axes.features):
        row = {"feature": name}
        for model in ("ridge", "cp"):
            row[f"{model}_cv_r2"] = mean(enough(by.get((i, name)), need(i), model) for i in folds)
            row[f"{model}_test_r2"] = enough(by.get((HELD_OUT, name)), need(HELD_OUT), model)
        row["delta"] = None if row["cp_test_r2"] is None or row["ridge_test_r2"] is None else row["cp_test_r2"] - row["ridge_test_r2"]
        rows.append(row)
    total = {}
    for model in ("ridge", "cp"):
        each = [enough(pooled.get(i), need_all(i), model) for i in folds]
        total[f"{model}_cv_mean"] = mean(None if v is None else max(v, -1.0) for v in each)
        total[f"{model}_test_r2"] = enough(pooled.get(HELD_OUT), need_all(HELD_OUT), model)
    total["delta"] = None if None in (total["cp_test_r2"], total["ridge_test_r2"]) else total["cp_test_r2"] - total["ridge_test_r2"]
    return rows, total


def compared(long: DataFrame, configurations: dict, least: int | None = None) -> tuple[list[dict], list[dict]]:
    """Scores by feature and pooled, for each configuration {(mode, lags): (rank, penalty)}."""
    p = load(long)
    try:
        gxx, features, totals = cell_gramian(p.rows, p.axes), [], []
        for (mode, lags), (rank, penalty) in configurations.items():
            f = fit(p, gxx, mode, lags, rank, penalty, least)
            rows, total = scores(predictions(p.rows, p.axes, f), f, p, least)
            features += [{"mode": mode, "lookback": lags} | r for r in rows]
            totals.append({"mode": mode, "lookback": lags} | total)
    finally:
        p.drop()
    return features, totals


def wide_ridge(long: DataFrame, lags: int, alphas) -> tuple[float, float | None]:
    """(penalty, held-out R2) of one ridge from all inputs of a window to all its targets, missing as zero, by products
    between windows; scored on seen cells of the last fifth of the windows."""
    p = load(long)
    try:
        d, k, size = design(p, "levels", lags), len(p.axes.features), p.axes.size
        n = len(d.starts)
        train = int(0.8 * n)

        def add(batch, total):
            x_sum, y_sum = total[: n * n].reshape(n, n), total[n * n :].reshape(train, train)
            for _, v in dense(batch, size):
                v = v.reshape(len(v), k, -1)
                x, y = d.inputs(v).transpose(1, 0, 2).reshape(n, -1), np.nan_to_num(d.targets(v)[:, :, :train]).reshape(-1, train)
                x_sum += x @ x.T
                y_sum += y.T @ y

        sums = summed(p.rows, add, n * n + train * train)
        model = models.DualRidge(sums[: n * n].reshape(n, n), sums[n * n :].reshape(train, train), train, alphas)

        def score(batch, total):
            for _, v in dense(batch, size):
                y = d.targets(v.reshape(len(v), k, -1)).reshape(-1, n)
                fit = np.nan_to_num(y[:, :train]) @ model.shares[train:].T
                t = y[:, train:]
                seen = ~np.isnan(t)
                total += [seen.sum(), np.nansum(t), np.nansum(t * t), np.sum((t - fit)[seen] ** 2)]

        count, total, squares, sse = summed(p.rows, score, 4)
    finally:
        p.drop()
    spread = squares - total**2 / count if count else 0.0
    return model.alpha, float(1 - sse / spread) if spread > 1e-8 else None
