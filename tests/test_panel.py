import glob
import os

import numpy as np
import pytest

from lattiq.functions import scalar
from lattiq.operators import models, panel, tensor
from lattiq.plans import cleaning, evaluation, files, queries, results  # noqa: F401
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def column(spark, f, values, kind):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_scalars(spark):
    assert column(spark, scalar.to_numeric, [" 12.5% ", " 1,234.5% ", "abc", None], "string") == pytest.approx([0.125, 12.345, None, None])
    assert column(spark, scalar.log_modulus, [-9.0, 0.0, 0.5, 99.0], "double") == pytest.approx([-2.302585, 0, 0.405465, 4.605170], abs=1e-6)
    assert column(spark, lambda x: scalar.clip(x, -5, 5), [-7.0, None, 6.0], "double") == [-5, None, 5]
    assert column(spark, scalar.adaptive_threshold, [1000, 18816, 200000], "int") == [100, 940, 5000]


def test_panel_operators(spark):
    rows = [(1, "f", 0, 1.0), (1, "f", 3, 4.0), (2, "f", 1, 2.0)]
    dense = panel.densify(spark.createDataFrame(rows, "entity long, feature string, period int, value double"))
    assert dense.count() == 8
    filled = {(r.entity, r.period): r.value for r in panel.forward_fill(dense).collect()}
    assert [filled[2, p] for p in range(4)] == [None, 2, 2, 2]
    z = panel.zscore(spark.createDataFrame([(1, v) for v in (1.0, 2.0, 4.0)], "g int, value double"), ["g"])
    assert sorted(r.value for r in z.collect()) == pytest.approx([-1.069045, -0.267261, 1.336306], abs=1e-6)
    flat = panel.zscore(spark.createDataFrame([(1, 5.0), (1, 5.0), (1, None)], "g int, value double"), ["g"])
    assert {r.value for r in flat.collect()} == {0.0, None}
    assert panel.folds(61) == [(16, 31), (31, 46), (46, 61)] and panel.folds(60) == [(15, 30), (30, 45), (45, 60)]
    r = panel.r2(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 2.0), (4.0, 5.0), (None, 1.0)], "y double, p double"), []).first()
    assert (r.n, round(r.r2, 9)) == (4, 0.6)


def test_tensors():
    rng = np.random.default_rng(42)
    a, b, c = rng.normal(size=12), rng.normal(size=5), rng.normal(size=9)
    t = np.einsum("i,j,k->ijk", a, b, c)
    w, f, _ = tensor.cp(t, 1)
    assert tensor.relative_error(t, tensor.rebuild_cp(w, f)) < 1e-6
    core, factors, errors = tensor.tucker(rng.normal(size=(6, 5, 4)), (6, 5, 4))
    assert errors[-1] < 1e-9 and all(np.allclose(x.T @ x, np.eye(x.shape[1])) for x in factors)
    low = np.einsum("ir,jr,kr->ijk", *(rng.normal(size=(n, 2)) for n in (10, 8, 6)))
    mask = rng.random(low.shape) > 0.3
    errs = []
    for steps in (3, 300):
        w, f, _ = tensor.cp(np.where(mask, low, 0), 2, steps, 1e-12, mask)
        errs.append(tensor.relative_error(low, tensor.rebuild_cp(w, f), ~mask))
    assert errs[1] < errs[0]


def test_models():
    assert models.ridge(np.array([[1.0], [2], [3]]), np.array([2.0, 4, 7]), 1)[0] == pytest.approx(2.066667, abs=1e-6)
    rng = np.random.default_rng(42)
    x, ws = rng.normal(size=(200, 6, 3, 2)), [rng.normal(size=(d, 2)) for d in (6, 3, 2, 6, 3)]
    y = models.cp_predict(x, ws, (6, 3))
    f, obj = models.cp_regression(x, y, 2, 1e-3, 80)
    p = models.cp_predict(x, f, (6, 3))
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.99
    assert all(b <= a * (1 + 1e-9) for a, b in zip(obj, obj[1:]))
    label = [0, 0, 1, 1, 2, 2]
    assert models.adjusted_mutual_information(label, [5, 5, 3, 3, 9, 9]) == pytest.approx(1)
    blobs = np.concatenate([rng.normal(size=(20, 2)), rng.normal(size=(20, 2)) + 10])
    assert models.adjusted_mutual_information(models.affinity_propagation(blobs), [0] * 20 + [1] * 20) > 0
    assert models.student_p(2.0, 10) == pytest.approx(0.07339, abs=1e-4)


def differences(spark, sf, names):
    """The queries whose rows differ from those of their SQL; several run at a time."""
    from concurrent.futures import ThreadPoolExecutor

    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    text = lambda v: None if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)

    def differs(name):
        want, got = con.cursor().sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, sf)
        order = sorted(got.columns)
        mine = sorted(str([text(r[c]) for c in order]) for r in got.collect())
        theirs = sorted(str([text(r[want.columns.index(c)]) for c in order]) for r in want.fetchall()) if order == sorted(want.columns) else None
        return mine != theirs

    with ThreadPoolExecutor(6) as pool:
        return [name for name, bad in zip(names, pool.map(differs, names)) if bad]


def test_queries_against_sql(spark):
    assert differences(spark, SF, sorted(queries.ORACLE_SQL)) == []


def test_filters_keep_some_and_drop_some(spark):
    sf = "/root/testdata/sf0.01"
    for name, table in (("late_start_filter", queries.p2), ("aligned_start", queries.p3), ("incomplete_dropped", queries.p1), ("missing_rate_filter", queries.p2)):
        assert 0 < queries.QUERIES[name](spark, sf).count() < table(spark, sf).count()
    assert 0 < queries.QUERIES["anti_join"](spark, sf).count() < 1500


def test_decompositions_are_of_the_whole_tensor(spark):
    rows = queries.scaled1(spark, SF).toPandas()
    (names, e), (_, f), (_, p) = (np.unique(rows[c].to_numpy(), return_inverse=True) for c in ("entity", "feature", "period"))
    t = np.zeros((e.max() + 1, f.max() + 1, p.max() + 1))
    t[e, f, p] = rows["value"]
    core, factors, errors = tensor.tucker(t, evaluation.RANKS)
    got = queries.QUERIES["tucker_core"](spark, SF).collect()
    assert got[0].error == pytest.approx(errors[-1], abs=1e-4)
    assert np.sqrt(sum(r.value**2 for r in got)) == pytest.approx(np.linalg.norm(core), rel=1e-3)
    full = np.zeros(t.shape)
    for r in queries.QUERIES["tucker_reconstruction"](spark, SF).collect():
        full[list(names).index(r.entity), sorted(set(rows["feature"])).index(r.feature), sorted(set(rows["period"])).index(r.period)] = r.value
    assert tensor.relative_error(t, full) == pytest.approx(errors[-1], abs=1e-3)


def test_multi_output_ridge():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(40, 5)), rng.normal(size=(5, 3))
    y = x @ w + 4 + 0.1 * rng.normal(size=(40, 3))
    alpha, beta, start = evaluation.multi_output_ridge(x, y, [0.1, 1.0, 10.0, 100.0])

    def left_out(a):
        errors = []
        for i in range(40):
            keep = np.arange(40) != i
            u, v = x[keep], y[keep]
            b = models.ridge(u - u.mean(0), v - v.mean(0), a)
            errors.append((y[i] - v.mean(0) - (x[i] - u.mean(0)) @ b) ** 2)
        return np.mean(errors)

    assert alpha == min([0.1, 1.0, 10.0, 100.0], key=left_out) and np.allclose(beta, w, atol=0.1) and np.allclose(start, 4, atol=0.1)


def test_subset_search_runs_all_trials(spark):
    rows = evaluation.subset_search(spark, SF, trials=40).collect()
    assert {r.trial for r in rows} == set(range(40)) and all(len(set(r.picked)) == 6 for r in rows)
    types = spark.read.parquet(f"{SF}/part.parquet").select("p_type").distinct().count()
    assert all(r.hit == (r.ami > 0.25 and min(abs(r.clusters - k) for k in (5, 25, types)) <= 2) for r in rows)


def test_sinks_caches_and_guards(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, 1.5, "1995-02-28"), ("a", 4, None, "bad"), ("b", 2, 2.5, None)], "mode string, lookback int, v double, day string")
    results.write_csv(rows, f"{tmp_path}/csv")
    back = results.read_csv(spark, f"{tmp_path}/csv", "mode string, lookback int, v double, day date").collect()
    assert sorted(str(r.day) for r in back) == ["1995-02-28", "None", "None"] and sum(r.v or 0 for r in back) == 4
    assert results.load_windows(spark, f"{tmp_path}/cache", "a", 2) is None
    results.write_windows(rows, f"{tmp_path}/cache")
    assert results.load_windows(spark, f"{tmp_path}/cache", "a", 2).first().v == 1.5 and results.load_windows(spark, f"{tmp_path}/cache", "b", 4) is None
    assert results.variant("x", "ratios", True) == "x/ratios_mean" and results.variant("x", "ratios", False) == "x/ratios_median"
    assert results.non_empty(rows, "rows") is rows and results.complete(rows.where("v > 0"), "v", "v").count() == 2
    for bad in (lambda: results.non_empty(rows.limit(0), "rows"), lambda: results.complete(rows, "v", "v")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="(?i)parse|timestamp"):
        rows.select(scalar.strict_date(F.col("day"))).collect()
    trials = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.7), (3, "a", 0.7)], "trial int, mode string, score double")
    results.append_trials(trials, f"{tmp_path}/store")
    results.append_trials(trials.withColumn("trial", F.col("trial") + 10), f"{tmp_path}/store")
    store = spark.read.parquet(f"{tmp_path}/store")
    assert store.count() == 6 and results.open_trials(spark.range(15).withColumnRenamed("id", "trial"), store).count() == 9
    assert [r.trial for r in results.top_trials(trials, ["mode"], 2).orderBy("place").collect()] == [2, 3]
    assert results.top_trials(trials, ["mode"], 1, ascending=True).first().trial == 1
    with pytest.raises(ValueError):
        results.top_trials(trials, ["mode"], 4)
    assert results.archive_trials(spark, f"{tmp_path}/store", "1") and results.archive_trials(spark, f"{tmp_path}/store", "2") is None
    cases = [([0.1, None, -0.5], True), ([0.1, 0.2, None], False), ([0.3, None, None], True), ([-0.2, 0.0, 0.4], False), ([-0.3, -0.2, 0.4], True)]
    got = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, s array<double>").select("i", results.pruned(F.col("s")).alias("cut")).collect()
    assert [r.cut for r in sorted(got)] == [x for _, x in cases]


def test_p_values_and_missing_labels():
    assert models.wilcoxon_p(0, 5) == pytest.approx(2 / 32) and models.wilcoxon_p(3, 6) == pytest.approx(2 * 5 / 64)
    assert models.wilcoxon_p(100.0, 60) == pytest.approx(models.normal_p((100 - 915) / np.sqrt(60 * 61 * 121 / 24)))
    assert models.adjusted_mutual_information([0, 0, 1, 1, 5, 6], [3, 3, 4, 4, None, float("nan")]) == pytest.approx(1)


def test_iterative_queries_run(spark):
    for name in ("tucker_index", "cp_rank1_index", "masked_tucker_impute", "cp_regression", "affinity_clusters"):
        assert queries.QUERIES[name](spark, SF).count() > 0


def flat_panel(spark):
    """The windows as NumPy arrays (x, y, seen, dev)."""
    w = queries.holdout(queries.windows3(spark, SF)).toPandas()
    names, f = np.unique(w["feature"].astype(str), return_inverse=True)
    _, r = np.unique(w["win"].to_numpy().astype(np.int64) * (1 << 40) + w["entity"].to_numpy(), return_inverse=True)
    x, y, dev = np.zeros((r.max() + 1, len(names), 2)), np.full((r.max() + 1, len(names)), np.nan), np.zeros(r.max() + 1, bool)
    x[r, f] = np.nan_to_num(np.array([list(v) for v in w["x"]], float))
    y[r, f], dev[r] = w["y"], w["dev"]
    return x, np.nan_to_num(y), ~np.isnan(y), dev


@pytest.mark.parametrize("name", ["cp_regression", "ridge_cp_ensemble"])
def test_cp_regression_is_of_the_whole_panel(spark, name):
    x, y, m, dev = flat_panel(spark)
    u, v, k, x, y, m = x[~dev], y[~dev], m[~dev], x[dev], y[dev], m[dev]
    mean = (y * m).sum(0) / (m.sum(0) + 1e-8)
    flat, part = lambda t: t.reshape(len(t), -1), name == "ridge_cp_ensemble"
    beta = models.ridge(flat(x), np.where(m, y - mean, 0), 100.0) * part
    rest = np.where(m, y - mean - flat(x) @ beta, 0)
    scale = np.sqrt((rest[m] ** 2).mean())
    factors, steps = models.cp_regression(x, rest / (scale + 1e-8), 3, 10.0, 150, 1e-6)
    p = mean + flat(u) @ beta + (0.5 if part else 1) * scale * models.cp_predict(u, factors, v.shape[1:])
    got = queries.QUERIES[name](spark, SF).collect()
    assert len(got) == 1 and got[0].steps == len(steps)
    assert got[0].r2 == pytest.approx(1 - ((v - p)[k] ** 2).sum() / ((v[k] - v[k].mean()) ** 2).sum(), abs=1e-6)


def test_indices_are_of_the_whole_decomposition(spark):
    rows = queries.scaled1(spark, SF).toPandas()
    (_, e), (_, f), (periods, p) = (np.unique(rows[c].to_numpy(), return_inverse=True) for c in ("entity", "feature", "period"))
    t = np.zeros((e.max() + 1, f.max() + 1, p.max() + 1))
    t[e, f, p] = rows["value"]
    w, factors, errors = tensor.cp(t, 1)
    got = {r.period: r["index"] for r in queries.QUERIES["cp_rank1_index"](spark, SF).collect()}
    assert [got[x] for x in periods] == pytest.approx(np.abs(w[0] * factors[2][:, 0]), abs=1e-6)
    n = t.shape[1]
    _, factors, errors = tensor.tucker(t, (min(len(t), 12), n, t.shape[2]))
    got = {r.period: r["index"] for r in queries.QUERIES["tucker_index"](spark, SF).collect()}
    assert [got[x] for x in periods] == pytest.approx(np.abs(factors[2]).mean(1), abs=1e-6)


def whole_windows(spark, got):
    """(win, cells with NaN, imputed cells, error) of every window, as NumPy arrays."""
    w = queries.windows3(spark, SF).toPandas()
    got = got.toPandas()
    assert not got["failed"].any()
    for win, rows in w.groupby("win"):
        out = got[got["win"] == win]
        (es, e), (fs, f) = (np.unique(rows[c].to_numpy().astype(str), return_inverse=True) for c in ("entity", "feature"))
        t, full = np.full((len(es), len(fs), 2), np.nan), np.full((len(es), len(fs), 2), np.nan)
        t[e, f] = np.array([list(x) for x in rows["x"]], float)
        at = np.searchsorted(es, out["entity"].to_numpy().astype(str)), np.searchsorted(fs, out["feature"].to_numpy().astype(str)), 2 - out["lag"]
        full[at] = out["x"]
        assert len(out) == t.size and (~np.isnan(t[at]) == out["observed"]).all()
        yield win, t, full, out["error"].iloc[0]


@pytest.mark.parametrize("name", ["masked_tucker_impute", "masked_cp_impute"])
def test_imputation_is_of_whole_windows(spark, name):
    n = 0
    for win, t, full, error in whole_windows(spark, queries.QUERIES[name](spark, SF)):
        mask = ~np.isnan(t)
        scale = np.sqrt(np.mean(t[mask] ** 2)) + 1e-8 if mask.any() else 1.0
        x = np.where(mask, t, 0) / scale
        if name == "masked_tucker_impute":
            core, factors, errors = tensor.tucker(x, (2, 2, 2), 30, 1e-3, mask, tensor.MaskedTucker(x.shape[1:], (2, 2, 2)).start(None, 42 + win))
            want = tensor.rebuild_tucker(core, factors)
        else:
            w, factors, errors = tensor.cp(x, 2, 20, 1e-3, mask, 42 + win)
            want = tensor.rebuild_cp(w, factors)
        assert full == pytest.approx(want * scale, rel=1e-4, abs=1e-4) and error == pytest.approx(errors[-1], abs=1e-5)
        n += 1
    assert n > 10


def test_imputation_edges(spark):
    rows = [(0, 1, [None, None, None, None]), (0, 2, [None, None, None, None]), (1, 1, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "win int, entity long, x array<double>")
    for model in (tensor.MaskedTucker((2, 2), [2, 2, 2]), tensor.MaskedCP((2, 2), 2)):
        got = {(r.win, r.entity): r for r in tensor.impute(df, model, 5, 1e-3).collect()}
        assert got[0, 1].x == [0.0] * 4 and got[0, 1].observed == [False] * 4 and got[0, 2].error in (0.0, 1.0)
        assert got[1, 1].x == pytest.approx([1, 2, 3, 4], abs=1e-3) and got[1, 1].error < 1e-3
        assert tensor.impute(df.where("win > 5"), model, 5, 1e-3).count() == 0


def test_reconstruction_makes_no_python_object_of_a_cell(spark):
    """Cells pass as arrays, in blocks, not as rows of a frame of all a batch's entities."""
    plan = queries.QUERIES["tucker_reconstruction"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_feature_difference_joins_no_rows(spark, tmp_path):
    rows = [("a", 1.0), ("a", None), ("b", 2e12), ("b", 1.0), ("click", 1.0), (None, 5.0), ("n", None)]
    spark.createDataFrame(rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["feature_difference"](spark, str(tmp_path))
    assert {r[0] for r in got.collect()} == {"a", "n", None}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
