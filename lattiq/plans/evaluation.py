"""The final evaluation: fixed-effects ridge against tensor regression, decompositions with errors, subset search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import contest, models, panel, tensor
from lattiq.operators.cells import Axes, axes, by_entity, cell_gramian, dense
from lattiq.plans.queries import LOG, P3, grid, p1, p3, query, scaled1
from lattiq.sources import panels

#: Rank and penalty of the tensor regression, by input mode and lookback.
CONFIGURATIONS = {("levels", 2): (8, 98.1655), ("levels", 4): (5, 67.3035), ("surprise", 2): (43, 52.4373), ("surprise", 4): (49, 85.3185)}


def logged(s, d) -> DataFrame:
    """The third panel with log-modulus values."""
    return p3(s, d).withColumn("value", scalar.log_modulus(F.col("value")))


@query("fe_ridge_cv")
def fe_ridge_cv(s, d, lags: int = 2):
    """Fixed-effects ridge of every feature on all features and lags: penalty and coefficients of the development windows,
    and scores of the folds and of the held-out windows."""
    p = contest.load(logged(s, d))
    try:
        f = contest.fit(p, cell_gramian(p.rows, p.axes), "levels", lags, 1, 1.0)
        rows, _ = contest.scores(contest.predictions(p.rows, p.axes, f), f, p)
    finally:
        p.drop()
    out = [(r["feature"], a, b.tolist(), r["ridge_cv_r2"], r["ridge_test_r2"]) for r, a, b in zip(rows, f.alphas[-1], f.betas[-1])]
    return s.createDataFrame(out, "feature string, alpha double, beta array<double>, cv_r2 double, test_r2 double")


@query("comparison_predictions")
def comparison_predictions(s, d, mode: str = "levels", lags: int = 2):
    """(cut, entity, feature, win, y, ridge, cp): forecasts of both models, fitted on the whole panel, for every seen cell of
    the folds' scored windows and of the held-out ones (cut 3)."""
    p = contest.load(logged(s, d))
    try:
        f = contest.fit(p, cell_gramian(p.rows, p.axes), mode, lags, *CONFIGURATIONS[mode, lags])
    finally:
        p.drop()
    return contest.predictions(p.rows, p.axes, f)


SCORES = "ridge_cv_r2 double, cp_cv_r2 double, ridge_test_r2 double, cp_test_r2 double, delta double"


def _persistence(long: DataFrame, lookbacks) -> dict[int, dict[str, float]]:
    """By lookback and feature: AR(1) persistence of the targets of the development windows."""
    ends = long.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).first()
    seen = sorted(r[0] for r in long.where("value IS NOT NULL").select("period").distinct().collect())
    out = {}
    for lags in lookbacks:
        targets = [p for p in seen if ends["lo"] + lags <= p < ends["hi"]]
        dev = targets[: int(0.8 * len(targets))]
        out[lags] = {r["feature"]: r["rho"] for r in panel.ar1(long.where(F.col("period").between(dev[0], dev[-1]))).collect()} if dev else {}
    return out


def compared(s, d, configurations=None) -> tuple[list[dict], list[dict]]:
    """Scores by configuration and feature, with persistence, and pooled ones by configuration."""
    configurations = configurations or CONFIGURATIONS
    long = logged(s, d).persist()  # read by the models and, for each lookback, by the persistence
    try:
        rows, totals = contest.compared(long, configurations)
        rho = _persistence(long, {lags for _, lags in configurations})
    finally:
        long.unpersist()
    return [r | {"ar1_rho": rho[r["lookback"]].get(r["feature"])} for r in rows], totals


BY_FEATURE = f"mode string, lookback int, feature string, {SCORES}, ar1_rho double"
POOLED = "mode string, lookback int, ridge_cv_mean double, cp_cv_mean double, ridge_test_r2 double, cp_test_r2 double, delta double"


def table_of(s, rows: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return s.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


@query("cp_vs_ridge")
def cp_vs_ridge(s, d):
    """By configuration and feature: scores of both models on the whole panel, the gain, and the feature's persistence."""
    return table_of(s, compared(s, d)[0], BY_FEATURE)


@query("comparison_summary")
def comparison_summary(s, d):
    """By configuration: pooled scores of both models over folds and held-out windows."""
    return table_of(s, compared(s, d)[1], POOLED)


@query("cp_structured")
def cp_structured(s, d):
    """(feature, cv_r2, test_r2) of the structured tensor regression of the whole panel, levels and two lags."""
    rows = contest.compared(logged(s, d), {("levels", 2): CONFIGURATIONS["levels", 2]})[0]
    return table_of(s, [{"feature": r["feature"], "cv_r2": r["cp_cv_r2"], "test_r2": r["cp_test_r2"]} for r in rows], "feature string, cv_r2 double, test_r2 double")


def significance(rows: DataFrame, first: str = "cp_test_r2", second: str = "ridge_test_r2", least: int = 5) -> DataFrame:
    """(mode, lookback, n, mean_delta, rho, rho_p, rho_adjusted, w, w_p, w_adjusted) of scores by feature.

    Within a configuration: rank correlation of persistence and gain, signed ranks of the pairs of scores, each
    from ``least`` pairs on. P-values are adjusted over the configurations. All ranks are within configurations, and
    there are as many of these as rows in the result.
    """
    by = ["mode", "lookback"]
    known = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn("d", F.col(first) - F.col(second))
    ranked = panel.ranked(panel.ranked(known.where("ar1_rho IS NOT NULL"), by, "ar1_rho"), by, "d")
    rho = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("rank_ar1_rho", "rank_d").alias("rho")).withColumn("rho", F.when(F.col("n") >= least, F.nanvl("rho", F.lit(None))))
    signed = panel.ranked(known.where("d <> 0").withColumn("m", F.abs("d")), by, "m")
    sums = signed.groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("rank_m")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("rank_m")).otherwise(0.0)).alias("down"), F.count("*").alias("pairs"), F.sum(F.col("ties_m") * F.col("ties_m") - 1).alias("ties"))
    every = known.groupBy(*by).agg(F.count("*").alias("compared"), F.avg("d").alias("mean_delta"))
    t = every.join(rho, by, "left").join(sums.withColumn("w", F.least("up", "down")), by, "left")
    t = t.withColumn("w", F.when(F.col("compared") >= least, F.col("w")))

    def with_p(batches):
        for b in batches:
            b["rho_p"] = [None if not r == r or r is None else models.spearman_p(float(r), int(n)) for r, n in zip(b["rho"], b["n"])]
            b["w_p"] = [None if not w == w or w is None else models.wilcoxon_p(float(w), int(n), float(ties)) for w, n, ties in zip(b["w"], b["pairs"], b["ties"])]
            yield b

    columns = "mode string, lookback int, n long, mean_delta double, rho double, w double, pairs long, ties double"
    t = t.select("mode", "lookback", "n", "mean_delta", "rho", "w", "pairs", F.col("ties").cast("double").alias("ties")).mapInPandas(with_p, columns + ", rho_p double, w_p double")
    t = panel.step_up(panel.step_up(t, "rho_p", "rho_adjusted"), "w_p", "w_adjusted")
    return t.select("mode", "lookback", "n", "mean_delta", "rho", "rho_p", "rho_adjusted", "w", "w_p", "w_adjusted")


@query("comparison_tests")
def comparison_tests(s, d):
    """By configuration: how the gain goes with persistence, and whether the models' scores differ."""
    return significance(cp_vs_ridge(s, d))


LAGS = (2, 3, 4, 5, 6)
LOGGED = f"WITH {P3}, {grid('p3')}, logged AS (SELECT entity, feature, period, {LOG.format('value')} AS value FROM dense)"
FORECASTS_SQL = LOGGED + f""", base AS (SELECT entity, feature, period, value AS y, {', '.join(f'coalesce(lag(value, {k}) OVER w, 0) AS l{k}' for k in range(1, 7))} FROM logged WINDOW w AS (PARTITION BY entity, feature ORDER BY period)),
f AS (SELECT feature, L, y, l1 AS a, ({' + '.join(f'CASE WHEN L >= {k} THEN l{k} ELSE 0 END' for k in range(1, 7))}) / L AS b FROM base, (VALUES {', '.join(f'({k})' for k in LAGS)}) v(L)
  WHERE y IS NOT NULL AND period - (SELECT min(period) FROM p3) >= L AND period < (SELECT max(period) FROM p3)),
r AS (SELECT L, feature, round((sum((y - a) * (y - a)) - sum((y - b) * (y - b))) / (count(y) * var_pop(y)), 9) AS d FROM f GROUP BY 1, 2),
t AS (SELECT DISTINCT L, period FROM (SELECT DISTINCT period FROM logged WHERE value IS NOT NULL), (VALUES {', '.join(f'({k})' for k in LAGS)}) v(L) WHERE period - (SELECT min(period) FROM p3) >= L AND period < (SELECT max(period) FROM p3)),
cut AS (SELECT L, max(period) AS hi, min(period) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY L ORDER BY period) AS i, count(*) OVER (PARTITION BY L) AS n FROM t) WHERE i <= floor(0.8 * n) GROUP BY 1),
pairs AS (SELECT L, entity, feature, value AS y, lag(value) OVER (PARTITION BY L, entity, feature ORDER BY period) AS x FROM logged JOIN cut ON period BETWEEN lo AND hi WHERE value IS NOT NULL),
ar AS (SELECT L, feature, round(avg(greatest(-1, least(1, c))), 9) AS rho FROM (SELECT L, entity, feature, covar_samp(y, x) / var_samp(x) AS c FROM pairs WHERE x IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 7 AND var_samp(x) >= 1e-12) GROUP BY 1, 2),
k AS (SELECT L, feature, d, rank() OVER (PARTITION BY L ORDER BY rho) + (count(*) OVER (PARTITION BY L, rho) - 1) / 2 AS ra, rank() OVER (PARTITION BY L ORDER BY d) + (count(*) OVER (PARTITION BY L, d) - 1) / 2 AS rd,
  rank() OVER (PARTITION BY L ORDER BY abs(d)) + (count(*) OVER (PARTITION BY L, abs(d)) - 1) / 2 AS rm FROM r JOIN ar USING (L, feature)),
s AS (SELECT L, count(*) AS n, avg(d) AS mean_delta, corr(ra, rd) AS rho, least(sum(CASE WHEN d > 0 THEN rm ELSE 0 END), sum(CASE WHEN d < 0 THEN rm ELSE 0 END)) AS w FROM k GROUP BY 1),
p AS (SELECT *, CASE w WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 10 WHEN 4 THEN 14 WHEN 5 THEN 20 WHEN 6 THEN 26 ELSE 32 END / 32.0 AS w_p FROM s),
q AS (SELECT *, w_p * count(*) OVER () / (rank() OVER (ORDER BY w_p) + count(*) OVER (PARTITION BY w_p) - 1) AS q FROM p)"""


def forecast_scores(s, d) -> DataFrame:
    """(mode, lookback, feature, persistence, mean, ar1_rho): scores of two plain forecasts, by lookback and feature."""
    dense = panel.densify(logged(s, d))
    w = Window.partitionBy("entity", "feature").orderBy("period")
    ends = dense.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    lagged = dense.withColumn("x", F.array(*[F.coalesce(F.lag("value", k).over(w), F.lit(0.0)) for k in range(1, max(LAGS) + 1)])).join(F.broadcast(ends), F.lit(True))
    each = lagged.where("value IS NOT NULL AND period < hi").select("feature", F.col("value").alias("y"), "x", (F.col("period") - F.col("lo")).alias("at"), F.explode(F.array(*map(F.lit, LAGS))).alias("lookback")).where("at >= lookback")
    total = F.aggregate(F.slice("x", F.lit(1), F.col("lookback")), F.lit(0.0), lambda acc, v: acc + v)
    rows = each.select("lookback", "feature", "y", F.col("x")[0].alias("a"), (total / F.col("lookback")).alias("b"))
    gain = lambda p: 1 - F.sum((F.col("y") - F.col(p)) ** 2) / (F.count("y") * F.var_pop("y"))
    out = rows.groupBy("lookback", "feature").agg(gain("a").alias("persistence"), gain("b").alias("mean"))
    rho = [(k, f, v) for k, of in _persistence(logged(s, d), LAGS).items() for f, v in of.items()]
    return out.join(F.broadcast(s.createDataFrame(rho, "lookback int, feature string, ar1_rho double")), ["lookback", "feature"]).select(F.lit("levels").alias("mode"), "lookback", "feature", "persistence", F.round(F.col("mean") - F.col("persistence"), 9).alias("gain"), F.round("ar1_rho", 9).alias("ar1_rho"))


def _forecast_tests(s, d) -> DataFrame:
    rows = forecast_scores(s, d).withColumn("none", F.lit(0.0))
    return significance(rows, "gain", "none")


@query("forecast_tests", FORECASTS_SQL + " SELECT CAST(L AS INTEGER) AS lookback, n, round(mean_delta, 6) AS mean_delta, round(rho, 6) AS rho, round(w, 1) AS w, round(CAST(w_p AS DOUBLE), 6) AS w_p FROM p")
def forecast_tests(s, d):
    """By lookback: the gain of the window's mean over persistence, its rank correlation with the feature's persistence,
    and the exact test of signed ranks (five features)."""
    return _forecast_tests(s, d).select("lookback", "n", *[F.round(c, 6).alias(c) for c in ("mean_delta", "rho")], F.round("w", 1).alias("w"), F.round("w_p", 6).alias("w_p"))


@query("bh_adjust", FORECASTS_SQL + " SELECT CAST(L AS INTEGER) AS lookback, round(CAST(least(1, min(q) OVER (ORDER BY w_p DESC)) AS DOUBLE), 6) AS adjusted FROM q")
def bh_adjust(s, d):
    """Step-up adjustment of the tests' p-values over the lookbacks."""
    return _forecast_tests(s, d).select("lookback", F.round("w_adjusted", 6).alias("adjusted"))


def multi_output_ridge(x: np.ndarray, y: np.ndarray, alphas) -> tuple[float, np.ndarray, np.ndarray]:
    """(penalty, coefficients, intercept) of all outputs at once; the penalty by leave-one-out errors. The primal form of
    ``models.DualRidge``, for its test."""
    mx, my = x.mean(0), y.mean(0)
    u, sv, vt = np.linalg.svd(x - mx, full_matrices=False)
    z = u.T @ (y - my)

    def error(a):
        shrink = sv**2 / (sv**2 + a)
        rest = (y - my) - u @ (shrink[:, None] * z)
        own = (u**2 @ shrink) + 1 / len(x)  # the intercept takes one of its own
        return float(np.mean((rest / np.maximum(1 - own, 1e-12)[:, None]) ** 2))

    alpha = min(alphas, key=error)
    beta = vt.T @ ((sv / (sv**2 + alpha))[:, None] * z)
    return alpha, beta, my - mx @ beta


@query("ridge_multi_output")
def ridge_multi_output(s, d):
    """(alpha, r2): one ridge with intercept from all inputs of a window to all its targets, of the whole panel."""
    alpha, r2 = contest.wide_ridge(logged(s, d), 2, [0.1, 1.0, 10.0, 100.0])
    return s.createDataFrame([(alpha, r2)], "alpha double, r2 double")


# ------------------------------------------------------------ decompositions with core, errors and reconstruction


def reduced(long: DataFrame) -> tuple[list, list, np.ndarray, np.ndarray]:
    """Features, periods, G, and a tensor (r, features, periods) that has the same inner products between cells as the
    whole one: the entity mode in an orthonormal basis of at most features x periods directions."""
    features, periods, g = tensor.entity_gramian(long)
    value, vector = np.linalg.eigh(g)
    keep = np.argsort(-value)[: max(1, int((value > 1e-12 * max(value.max(), 1e-300)).sum()))]
    z = np.sqrt(np.maximum(value[keep], 0))[:, None] * vector[:, keep].T
    return features, periods, g, z.reshape(-1, len(features), len(periods))


RANKS = (4, 2, 3)


@query("tucker_core")
def tucker_core(s, d):
    """(i, j, k, value, error, steps): the core of the Tucker model of ranks RANKS, its relative error and its steps."""
    _, _, _, z = reduced(scaled1(s, d))
    core, _, errors = tensor.tucker(z, [min(r, n) for r, n in zip(RANKS, z.shape)])
    rows = [(*map(int, at), float(core[at]), errors[-1], len(errors)) for at in np.ndindex(core.shape)]
    return s.createDataFrame(rows, "i int, j int, k int, value double, error double, steps int")


@query("tucker_reconstruction")
def tucker_reconstruction(s, d):
    """(entity, feature, period, value): the model's value of every cell, entity by entity from small matrices."""
    long = scaled1(s, d)
    features, periods, g, z = reduced(long)
    _, (_, b, c), _ = tensor.tucker(z, [min(r, n) for r, n in zip(RANKS, z.shape)])
    q = np.kron(b, c)
    value, vector = np.linalg.eigh(q.T @ g @ q)
    lead = q @ vector[:, np.argsort(-value)[: RANKS[0]]]
    a = Axes(tuple(features), periods[0] if periods else 0, len(periods), ())
    size, names = a.size, np.repeat(np.array([str(f) for f in features], object), len(periods))
    times = np.tile(np.array(periods, np.int32), len(features))

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("entity"))
            for at, x in dense(batch, size):
                full = np.nan_to_num(x) @ lead @ lead.T
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], size)), pa.array(np.tile(names, len(x)), pa.string()), pa.array(np.tile(times, len(x))), pa.array(full.ravel())], names=["entity", "feature", "period", "value"])

    return by_entity(long, a).mapInArrow(run, "entity long, feature string, period int, value double")


@query("cp_reconstruction")
def cp_reconstruction(s, d, rank: int = 2):
    """(entity, feature, period, value, model): every cell and its value in the CP model of the whole panel, entity by entity: the
    entity's loadings are the least squares of its cells on the products of the other two factors."""
    long = scaled1(s, d)
    a = axes(long)
    _, _, _, z = reduced(long)
    _, (_, b, c), _ = tensor.cp(z, rank)
    k = tensor.khatri_rao([b, c])
    back = np.linalg.solve((b.T @ b) * (c.T @ c) + 1e-12 * np.eye(rank), k.T)
    names, size = np.array([str(f) for f in a.features], object), a.size

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("entity"))
            for at, x in dense(batch, size):
                model = np.nan_to_num(x) @ k @ back
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[at], size)), pa.array(np.tile(np.repeat(names, a.periods), len(x)), pa.string()), pa.array(np.tile(np.arange(a.periods) + a.first, len(x) * len(names)).astype(np.int32)), pa.array(x.ravel(), from_pandas=True), pa.array(model.ravel())],
                    names=["entity", "feature", "period", "value", "model"],
                )

    return by_entity(long, a).mapInArrow(run, "entity long, feature string, period int, value double, model double")


@query("cp_index")
def cp_index(s, d, ranks=(1, 2, 3)):
    """(rank, period, index, error): the time factor of CP models; beyond rank one the absolute mean over its components."""
    _, periods, _, z = reduced(scaled1(s, d))
    out = []
    for rank in ranks:
        _, factors, errors = tensor.cp(z, rank)
        index = factors[2][:, 0] if rank == 1 else np.abs(factors[2].mean(1))
        out += [(rank, int(p), float(v), errors[-1]) for p, v in zip(periods, index)]
    return s.createDataFrame(out, "rank int, period int, index double, error double")


# ------------------------------------------------------------ subset search

BASE = ["qty_avg", "price_avg", "discount_avg", "qty_sd", "price_sd", "discount_sd"]
REST = ["qty_min", "price_min", "discount_min", "qty_max", "price_max", "discount_max", "balance_avg", "balance_sd"]


@query("subset_search")
def subset_search(s, d, trials: int = 300_000, sampled: int = 6, level: float = 0.25, tolerance: int = 2):
    """(trial, picked, clusters, ami, hit): the base columns and ``sampled`` others, clustered and scored against the regions.

    A trial's columns are drawn by a hash of trial and column. Trials that draw the same columns share one clustering, so
    all trials are run. A hit has a score above ``level`` and a number of clusters near that of one of four taxonomies:
    regions, nations, market segments, part types.
    """
    p = p1(s, d).join(panels.read(s, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("k")), "entity")
    stats = p.groupBy("k").pivot("feature", ["qty", "price", "discount"]).agg(F.avg("value").alias("avg"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    money = panels.read(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("balance_avg"), F.stddev_pop("c_acctbal").alias("balance_sd"))
    regions = panels.read(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))
    t = stats.join(money, "k").join(regions, "k").toPandas().sort_values("k").fillna(0)  # a row to a nation
    x = t[BASE + REST].to_numpy(float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    y = t["region"].to_numpy()
    sizes = [panels.read(s, d, name).agg(F.count_distinct(c)).first()[0] for name, c in (("nation", "n_regionkey"), ("nation", "n_nationkey"), ("customer", "c_mktsegment"), ("part", "p_type"))]
    order = F.array_sort(F.array(*[F.struct(F.xxhash64("id", F.lit(k)).alias("u"), F.lit(k).alias("k")) for k in range(len(REST))]))
    drawn = s.range(trials).select(F.col("id").alias("trial"), F.array_sort(F.transform(F.slice(order, 1, sampled), lambda e: e["k"])).alias("picked"))

    def run(batches):
        for b in batches:
            rows = []
            for picked in b["picked"]:
                label = models.affinity_propagation(x[:, [*range(len(BASE)), *(len(BASE) + k for k in picked)]])
                rows.append((list(picked), int(label.max()) + 1, models.adjusted_mutual_information(label, y)))
            yield pd.DataFrame(rows, columns=["picked", "clusters", "ami"])

    scored = drawn.select("picked").distinct().mapInPandas(run, "picked array<int>, clusters int, ami double")
    near = F.array_min(F.transform(F.array(*map(F.lit, sizes)), lambda k: F.abs(F.col("clusters") - k)))
    hit = (F.col("ami") > level) & (near <= tolerance)
    return drawn.join(scored, "picked").select("trial", "picked", "clusters", "ami", hit.alias("hit"))
