"""The final evaluation on a whole panel, against NumPy on the rows themselves and against SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lattiq.operators import cells, contest, models, panel, tensor
from lattiq.plans import evaluation, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long(spark):
    return evaluation.logged(spark, SF).persist()


@pytest.fixture(scope="module")
def arrays(long):
    """Entities, features, cells (entities, features, periods) with NaN."""
    t = long.toPandas()
    (names, e), (features, f) = (np.unique(t[c].to_numpy(), return_inverse=True) for c in ("entity", "feature"))
    p = (t["period"] - t["period"].min()).to_numpy()
    v = np.full((len(names), len(features), p.max() + 1), np.nan)
    v[e, f, p] = t["value"]
    return names, [str(x) for x in features], v


def split(v, lags, mode):
    """x (windows, entities, features, lags), y (windows, entities, features), as the definitions say."""
    seen = ~np.isnan(v).all((0, 1))
    starts = [t for t in range(v.shape[2] - lags - 1) if seen[t + lags]]
    x = np.stack([v[:, :, t : t + lags] for t in starts])
    if mode == "surprise":
        x = x / np.array([np.sqrt(np.nanmean(w**2)) + 1e-8 if (~np.isnan(w)).any() else 1.0 for w in x])[:, None, None, None]
    return np.nan_to_num(x), np.stack([v[:, :, t + lags] for t in starts])


def centred(y, a):
    n, m = (~np.isnan(y[:a])).sum(0), ~np.isnan(y[:a])
    by_feature = np.nansum(y[:a], (0, 1)) / (n.sum(0) + 1e-8)
    mean = np.where(n > 0, np.nansum(y[:a], 0) / np.maximum(n, 1), by_feature)
    return mean, np.where(m, y[:a] - mean, 0)


def r2(y, p):
    k = ~np.isnan(y)
    return 1 - ((y[k] - p[k]) ** 2).sum() / ((y[k] - y[k].mean()) ** 2).sum()


def plain_ridge(x, y, end, upto, least):
    """Predictions and penalties of the fixed-effects ridge, by rows."""
    flat = x.transpose(0, 1, 3, 2).reshape(*x.shape[:2], -1)
    mean, _ = centred(y, end)
    out, alphas = np.zeros((upto - end, *y.shape[1:])), []
    for j in range(y.shape[2]):
        rows = [(e, t) for t in range(end) for e in range(y.shape[1]) if not np.isnan(y[t, e, j])]
        e, t = (np.array([r[i] for r in rows], int) for i in (0, 1))
        if len(rows) < least:
            alphas.append(None)
            out[:, :, j] = mean[:, j]
            continue
        got = models.fixed_effects_ridge(e, t, flat[t, e], y[t, e, j], contest.ALPHAS, end, least)
        alphas.append(got["alpha"])
        out[:, :, j] = flat[end:upto] @ got["beta"] + mean[:, j]
    return out, alphas


@pytest.mark.parametrize("mode, lags", [("levels", 2), ("surprise", 3)])
def test_both_models_of_the_whole_panel_equal_those_of_its_rows(long, arrays, mode, lags):
    names, features, v = arrays
    x, y = split(v, lags, mode)
    p = contest.load(long)
    f = contest.fit(p, cells.cell_gramian(p.rows, p.axes), mode, lags, 3, 0.5, least=8)
    table = contest.predictions(p.rows, p.axes, f).toPandas()
    assert len(f.cuts) == 4 and f.cuts[-1] == (int(0.8 * len(x)), len(x)) and p.entities == len(names)
    for i, (end, upto) in enumerate(f.cuts):
        rest = centred(y, end)[1]
        mean, scale = centred(y, end)[0], np.sqrt((rest[~np.isnan(y[:end])] ** 2).mean())
        model = f.tensors[i]
        b, c, q, e = model.first
        targets = (rest / (scale + 1e-8)).transpose(1, 2, 0).reshape(len(names), -1)
        factors, objectives = models.cp_regression(x[:end], rest / (scale + 1e-8), 3, 0.5, 150, 1e-6, start=[np.zeros((len(names), 3)), b, c, targets @ q, e])
        assert model.objectives == pytest.approx(objectives, rel=1e-8)
        cp = mean + scale * models.cp_predict(x[end:upto], factors, y.shape[1:])
        ridge, alphas = plain_ridge(x, y, end, upto, 8)
        assert f.alphas[i] == alphas
        mine = table[table["cut"] == (3 if i == 3 else i)]
        at = mine["win"].to_numpy() - end, np.searchsorted(names, mine["entity"]), np.array([features.index(n) for n in mine["feature"]])
        assert len(mine) == (~np.isnan(y[end:upto])).sum() and mine["y"].to_numpy() == pytest.approx(y[end:upto][at])
        assert mine["cp"].to_numpy() == pytest.approx(cp[at], abs=1e-6) and mine["ridge"].to_numpy() == pytest.approx(ridge[at], abs=1e-6)
    p.drop()


def test_scores_of_predictions_by_sql(spark, long):
    p = contest.load(long)
    f = contest.fit(p, cells.cell_gramian(p.rows, p.axes), "levels", 2, 2, 5.0, least=5)
    table = contest.predictions(p.rows, p.axes, f)
    rows, total = contest.scores(table, f, p, least=5)
    t = table.toPandas()  # noqa: F841  read by the SQL
    one = "CASE WHEN count(*) >= 5 THEN 1 - sum((y - {0}) * (y - {0})) / (count(y) * var_pop(y)) END"
    each = duckdb.sql(f"SELECT cut, feature, {one.format('ridge')} AS ridge, {one.format('cp')} AS cp FROM t GROUP BY 1, 2")  # noqa: F841
    want = duckdb.sql("SELECT feature, avg(ridge) FILTER (cut < 3), avg(cp) FILTER (cut < 3), max(ridge) FILTER (cut = 3), max(cp) FILTER (cut = 3), max(cp - ridge) FILTER (cut = 3) FROM each GROUP BY 1 ORDER BY 1").fetchall()
    got = [tuple(r[k] for k in ("feature", "ridge_cv_r2", "cp_cv_r2", "ridge_test_r2", "cp_test_r2", "delta")) for r in rows]
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:], abs=1e-9)
    pooled = duckdb.sql(f"SELECT {one.format('cp')} FROM t WHERE cut = 3").fetchall()[0][0]
    assert total["cp_test_r2"] == pytest.approx(pooled, abs=1e-9)
    few, total = contest.scores(table, f, p)  # the thresholds: hundreds of cells pooled, ten of a feature
    assert total["cp_test_r2"] is None or t[t["cut"] == 3].shape[0] >= 100
    p.drop()


def test_a_fold_with_few_cells_has_no_tensor_regression(long):
    p = contest.load(long)
    f = contest.fit(p, cells.cell_gramian(p.rows, p.axes), "levels", 2, 2, 5.0, least=10**6)
    assert f.tensors == [None] * 4 and all(a is None for cut in f.alphas for a in cut)
    table = contest.predictions(p.rows, p.axes, f)
    assert table.where("cp IS NOT NULL").count() == 0 and table.where("ridge IS NULL").count() == 0
    p.drop()


def test_wide_ridge_equals_its_primal_form(long, arrays):
    x, y = split(arrays[2], 2, "levels")
    n, flat = int(0.8 * len(x)), lambda t: t.reshape(len(t), -1)
    alpha, beta, start = evaluation.multi_output_ridge(flat(x[:n]), np.nan_to_num(flat(y[:n])), [0.1, 1.0, 10.0, 100.0])
    got = contest.wide_ridge(long, 2, [0.1, 1.0, 10.0, 100.0])
    assert got[0] == alpha and got[1] == pytest.approx(r2(flat(y[n:]), flat(x[n:]) @ beta + start), abs=1e-9)


def test_significance(spark):
    rng = np.random.default_rng(1)
    rows = [(m, lag, f"f{k}", float(a), float(b), float(r)) for m in ("levels", "surprise") for lag in (2, 4) for k, (a, b, r) in enumerate(np.round(rng.normal(size=(8, 3)), 1))]
    rows += [("levels", 6, "f0", 1.0, 0.5, 0.1), ("levels", 2, "g", None, 0.5, 0.1)]
    t = spark.createDataFrame(rows, "mode string, lookback int, feature string, cp_test_r2 double, ridge_test_r2 double, ar1_rho double")
    got = {(r["mode"], r.lookback): r for r in evaluation.significance(t).collect()}
    assert got["levels", 6].rho is None and got["levels", 6].w is None and got["levels", 6].w_adjusted is None and got["levels", 6].mean_delta == 0.5

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    ps = {}
    for key in got:
        mine = np.array([r[3:] for r in rows if (r[0], r[1]) == key and r[3] is not None])
        if len(mine) < 5:
            continue
        d = mine[:, 0] - mine[:, 1]
        assert got[key].rho == pytest.approx(np.corrcoef(ranks(mine[:, 2]), ranks(d))[0, 1])
        k = ranks(np.abs(d[d != 0]))
        assert got[key].w == pytest.approx(min(k[d[d != 0] > 0].sum(), k[d[d != 0] < 0].sum()))
        ps[key] = got[key].w_p
    order = sorted(ps, key=ps.get)
    for i, key in enumerate(order):
        assert got[key].w_adjusted == pytest.approx(min(1, min(ps[o] * len(order) / (j + 1) for j, o in enumerate(order) if j >= i)))


def test_sums_over_entities(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(37, 4, 30))
    v[rng.random(v.shape) < 0.3] = np.nan
    rows = [(int(e), f"f{f}", int(p) + 100, float(v[e, f, p])) for e, f, p in zip(*np.nonzero(~np.isnan(v)))]
    df = spark.createDataFrame(rows, "entity long, feature string, period int, value double").repartition(5)
    a = cells.axes(df)
    flat = np.nan_to_num(v).reshape(37, -1)
    assert a.features == ("f0", "f1", "f2", "f3") and a.size == 120
    assert cells.cell_gramian(cells.by_entity(df, a), a) == pytest.approx(flat.T @ flat)
    assert cells.summed(cells.by_entity(df.limit(0), a), lambda b, t: None, 10).tolist() == [0.0] * 10


def test_ranks_within_groups_and_step_up(spark):
    t = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.04,), (None,)], "p double")
    got = [r.q for r in panel.step_up(t, "p", "q").where("p IS NOT NULL").orderBy("p").collect()]
    assert got == pytest.approx([0.04, 0.04, 0.04, 0.04]) and panel.step_up(t, "p", "q").where("p IS NULL").first().q is None
    assert models.spearman_p(0.6, 5) == pytest.approx(0.28476, abs=1e-5)


def test_imputation_can_fill_only(spark):
    rng = np.random.default_rng(2)
    x = np.einsum("i,j,k->ijk", rng.normal(size=20), rng.normal(size=3), rng.normal(size=2)) + 0.01 * rng.normal(size=(20, 3, 2))
    gone = rng.random(x.shape) < 0.2
    rows = [(0, i, [None if g else float(v) for v, g in zip(x[i].ravel(), gone[i].ravel())]) for i in range(20)]
    df = spark.createDataFrame(rows, "win int, entity long, x array<double>")
    for fill in (False, True):
        got = np.array([r.x for r in tensor.impute(df, tensor.MaskedCP((3, 2), 1), 50, 1e-6, fill=fill).orderBy("entity").collect()]).reshape(x.shape)
        assert np.abs(got - x)[gone].max() < 0.2
        assert (got[~gone] == x[~gone]).all() == fill


def test_queries_of_the_final_evaluation(spark):
    rows = queries.QUERIES["cp_vs_ridge"](spark, SF).collect()
    assert len(rows) == 4 * 5 and {(r["mode"], r.lookback) for r in rows} == set(evaluation.CONFIGURATIONS)
    assert queries.QUERIES["comparison_summary"](spark, SF).count() == 4


def test_kernels_hold_small_blocks_of_a_batch():
    """A full Arrow batch of entities is worked through in dense arrays of 1 MB, as kernels hold several of them at once."""
    n, size = 10_000, 84
    batch = pa.RecordBatch.from_arrays([pa.array([[i % size] for i in range(n)], pa.list_(pa.int32())), pa.array([[float(i)] for i in range(n)])], names=["pos", "value"])
    parts = list(cells.dense(batch, size))
    assert max(x.nbytes for _, x in parts) <= 1 << 20
    assert np.concatenate([at for at, _ in parts]).tolist() == list(range(n)) and sum(np.nansum(x) for _, x in parts) == n * (n - 1) / 2


def test_scores_make_the_predictions_once(spark, long):
    """One pass over the forecasts gives the scores by feature and the pooled ones."""
    p = contest.load(long)
    try:
        f = contest.fit(p, cells.cell_gramian(p.rows, p.axes), "levels", 2, 2, 5.0, least=5)
        table, passes = contest.predictions(p.rows, p.axes, f), spark.sparkContext.accumulator(0)

        def counted(batches, held=table.columns):
            passes.add(1)
            yield from batches

        once = table.coalesce(1).mapInArrow(counted, table.schema)
        _, total = contest.scores(once, f, p, least=5)
        want = {r["cut"]: r for r in table.groupBy("cut").agg(contest.r2("ridge").alias("ridge"), contest.r2("cp").alias("cp")).collect()}
    finally:
        p.drop()
    assert passes.value == 1
    assert total["ridge_test_r2"] == pytest.approx(want[contest.HELD_OUT]["ridge"], abs=1e-9)
    assert total["cp_test_r2"] == pytest.approx(want[contest.HELD_OUT]["cp"], abs=1e-9)
