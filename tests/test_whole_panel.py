"""Clusters, decompositions, ridges and statistics of whole panels against NumPy."""

import numpy as np
import pytest

from lattiq.operators import affinity, cells, models, panel, tensor
from lattiq.plans import evaluation, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n, seed", [(25, 0), (60, 1), (1, 3)])
def test_affinity_propagation_as_rows(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) + rng.integers(0, 3, (n, 1)) * 4
    df = spark.createDataFrame([(10 * i, [float(v) for v in x[i]]) for i in range(n)], "id long, x array<double>")
    got = [r.cluster for r in affinity.clusters(df).orderBy("id").collect()]
    assert got == models.affinity_propagation(x).tolist()


def test_the_median_of_many_similarities(spark, monkeypatch):
    monkeypatch.setattr(affinity, "FEW", 10)
    monkeypatch.setattr(affinity, "BINS", 16)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(40, 2)), 1)  # with ties
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(40)], "id long, x array<double>")
    assert [r.cluster for r in affinity.clusters(df).orderBy("id").collect()] == models.affinity_propagation(x).tolist()


def test_clusters_of_all_suppliers(spark):
    t = queries._profiles(spark, SF).orderBy("id").collect()
    want = models.affinity_propagation(np.array([r.x for r in t]))
    assert [r.cluster for r in queries.QUERIES["affinity_clusters"](spark, SF).orderBy("id").collect()] == want.tolist()
    score = queries.QUERIES["ami_score"](spark, SF).first()
    assert score.clusters == len(set(want)) and score.ami == pytest.approx(models.adjusted_mutual_information(want, [r.region for r in t]))
    best = queries.QUERIES["best_match"](spark, SF).first()
    assert best.clusters == score.clusters and best.gap == abs(best.groups - best.clusters)


def coordinates(spark, t):
    rows = [(i, f"f{j:02}", k, float(t[i, j, k])) for i, j, k in np.ndindex(t.shape)]
    return spark.createDataFrame(rows, "entity long, feature string, period int, value double")


def test_decompositions_with_and_without_the_gramian_of_cells(spark):
    rng = np.random.default_rng(3)
    t = np.einsum("ir,jr,kr->ijk", *(rng.normal(size=(n, 4)) for n in (15, 5, 9))) + 0.1 * rng.normal(size=(15, 5, 9))
    long = coordinates(spark, t)
    _, factors, errors = tensor.tucker(t, (3, 2, 4))
    for limit in (tensor.GRAM_CELLS, 0):
        _, b, c, e = tensor.tucker_factors(long, (3, 2, 4), limit)
        assert e[-1] == pytest.approx(errors[-1], abs=1e-6) and np.abs(b.T @ factors[1]) == pytest.approx(np.eye(2), abs=1e-2) and c.shape == (9, 4)
        w, own, e1 = tensor.cp(t, 1)
        _, weight, _, c, e = tensor.cp_rank1(long, limit)
        assert weight == pytest.approx(w[0], rel=1e-4) and np.abs(c) == pytest.approx(np.abs(own[2][:, 0]), abs=1e-3) and e[-1] == pytest.approx(e1[-1], abs=1e-6)


def test_many_cells_are_never_gathered_in_square(spark, monkeypatch):
    """40 features x 120 periods: no sum is larger than cells x entity rank, or than the projected cells in square."""
    rng = np.random.default_rng(4)
    t = np.einsum("ir,jr,kr->ijk", *(rng.normal(size=(n, 2)) for n in (12, 40, 120)))
    sizes, summed = [], cells.summed
    monkeypatch.setattr(cells, "summed", lambda rows, add, size: sizes.append(size) or summed(rows, add, size))
    _, b, c, errors = tensor.tucker_factors(coordinates(spark, t), (3, 3, 4))
    _, _, _, _, one = tensor.cp_rank1(coordinates(spark, t))
    assert errors[-1] < 1e-5 and one[-1] == pytest.approx(tensor.cp(t, 1)[2][-1], abs=1e-5)
    assert max(sizes) <= 40**2 + 120**2 and len(sizes) > 4


def design(spark):
    """(x rows x 10, y rows x 5, dev): the logged third panel's windows, lags within a feature, the oldest first."""
    w = queries.holdout(queries.windows3(spark, SF)).toPandas()
    names, f = np.unique(w["feature"].astype(str), return_inverse=True)
    _, r = np.unique(w["win"].to_numpy().astype(np.int64) * (1 << 40) + w["entity"].to_numpy(), return_inverse=True)
    x, y, dev = np.zeros((r.max() + 1, len(names), 2)), np.full((r.max() + 1, len(names)), np.nan), np.zeros(r.max() + 1, bool)
    x[r, f] = np.nan_to_num(np.array([list(v) for v in w["x"]], float))
    y[r, f], dev[r] = w["y"], w["dev"]
    return names, x.reshape(len(x), -1), y, dev


def test_ridge_by_leave_one_out_errors(spark):
    names, x, y, dev = design(spark)
    got = {r.feature: r for r in queries.QUERIES["ridge_loo_by_feature"](spark, SF).collect()}
    for j, name in enumerate(names):
        k = dev & ~np.isnan(y[:, j])
        u, t = x[k], y[k, j]

        def left_out(a, u=u, t=t):
            return sum((t[i] - u[i] @ models.ridge(np.delete(u, i, 0), np.delete(t, i), a)) ** 2 for i in range(len(t)))

        best = min((0.1, 1.0, 10.0, 100.0, 1000.0), key=left_out)
        assert got[name].alpha == best and got[name].n == len(t) and got[name].beta == pytest.approx(models.ridge(u, t, best), abs=1e-6)


def test_ridge_of_each_feature(spark):
    names, x, y, dev = design(spark)
    got = {r.feature: r for r in queries.QUERIES["ridge_by_feature"](spark, SF).collect()}
    for j, name in enumerate(names):
        k, v = dev & ~np.isnan(y[:, j]), ~dev & ~np.isnan(y[:, j])
        mean = y[k, j].sum() / (k.sum() + 1e-8)
        beta = models.ridge(x[k], y[k, j] - mean, 10.0)
        if k.sum() < 25:
            assert got[name].beta is None
            continue
        assert got[name].beta == pytest.approx(beta, abs=1e-6)
        t = y[v, j]
        assert got[name].r2 == pytest.approx(1 - ((t - mean - x[v] @ beta) ** 2).sum() / ((t - t.mean()) ** 2).sum(), abs=1e-6)
    assert queries.ridge_by_feature(spark, SF, least=10**6).where("beta IS NULL AND r2 IS NULL").count() == len(names)


def test_cp_reconstruction(spark):
    rows = queries.QUERIES["cp_reconstruction"](spark, SF).toPandas()
    (_, e), (_, f), (_, p) = (np.unique(rows[c].to_numpy(), return_inverse=True) for c in ("entity", "feature", "period"))
    t, model = np.zeros((2, e.max() + 1, f.max() + 1, p.max() + 1))
    t[e, f, p], model[e, f, p] = np.nan_to_num(rows["value"]), rows["model"]
    _, _, errors = tensor.cp(t, 2)
    assert tensor.relative_error(t, model) == pytest.approx(errors[-1], abs=2e-3)


def test_random_pairings(spark):
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, 3, 400), rng.integers(0, 4, 400)
    by_i, by_j = np.bincount(i), np.bincount(j)
    tables = np.array([queries._pairing(np.random.default_rng(k), by_i, by_j) for k in range(300)])
    assert (tables.sum(2) == by_i).all() and (tables.sum(1) == by_j).all()
    shuffled = []
    for _ in range(300):
        t = np.zeros((3, 4))
        np.add.at(t, (i, rng.permutation(j)), 1)
        shuffled.append(t)
    assert tables.mean(0) == pytest.approx(np.mean(shuffled, 0), abs=2) and tables.std(0) == pytest.approx(np.std(shuffled, 0), rel=0.25)
    got = {r.statistic: r for r in queries.QUERIES["independence_null"](spark, SF).collect()}
    assert got["l1"].value == pytest.approx(queries.QUERIES["l1_independence"](spark, SF).first().l1, abs=1e-6)
    assert got["kl"].value == pytest.approx(queries.QUERIES["loglik_independence"](spark, SF).first().kl, abs=1e-6)
    assert 0 < got["l1"].quantile < got["l1"].value and got["l1"].share == 0


def test_rows_are_numbered_by_ranges(spark):
    rng = np.random.default_rng(1)
    values = [float(v) for v in rng.integers(0, 50, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    got = panel.numbered(df, "v").orderBy("nth").collect()
    assert [r.nth for r in got] == list(range(500)) and [r.v for r in got] == sorted(values)
    before = {r.v: (r.n, r.before) for r in panel.places(df, "v").collect()}
    assert before == {v: (values.count(v), sum(x < v for x in values)) for v in set(values)}


def test_imputed_modes_differ_by_the_scale_of_the_window(spark):
    t = queries.QUERIES["imputed_modes"](spark, SF)
    rms = {r.win: r.rms for r in queries.QUERIES["window_rms"](spark, SF).collect()}
    wide = t.groupBy("win", "entity", "feature", "lag").pivot("mode", ["levels", "surprise"]).max("x").collect()
    assert len(wide) == t.count() / 2 and all(r.levels == pytest.approx(r.surprise * rms[r.win], abs=1e-4) for r in wide)
    assert evaluation.RANKS == (4, 2, 3)


def test_granger_tests(spark):
    t = queries.windows3(spark, SF).toPandas()
    value = {(r.entity, r.feature, r.win): (list(r.x), r.y) for r in t.itertuples()}
    names = sorted(t["feature"].unique())
    for r in queries.QUERIES["granger_tests"](spark, SF).collect():
        rows = []
        for (e, f, w), (own, y) in value.items():
            if f == r.effect:
                other = value[e, r.cause, w][0]
                rows.append([1.0, *own, *other, y])
        rows = np.array(rows, float)
        rows = rows[~np.isnan(rows).any(1)]
        left = [((rows[:, -1] - rows[:, :m] @ np.linalg.lstsq(rows[:, :m], rows[:, -1], rcond=None)[0]) ** 2).sum() for m in (3, 5)]
        assert r.n == len(rows) and r.cause in names
        if r.n > 6:
            assert r.f == pytest.approx((left[0] - left[1]) / 2 / (left[1] / (r.n - 5)), rel=1e-5) and 0 <= r.p <= 1
    assert models.fisher_p(4.0, 2, 20) == pytest.approx(0.03457, abs=1e-4) and models.fisher_p(9.0, 1, 10) == pytest.approx(models.student_p(3.0, 10))


def test_p_values_of_the_registered_queries(spark):
    t = queries._pairs(spark, SF).toPandas()

    def ranks(x):
        return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])

    rho = np.corrcoef(ranks(t["a"].to_numpy()), ranks(t["b"].to_numpy()))[0, 1]
    got = queries.QUERIES["spearman_p"](spark, SF).first()
    assert got.n == len(t) and got.rho == pytest.approx(rho, abs=1e-6) and got.p == pytest.approx(models.spearman_p(rho, len(t)), rel=1e-3)
    d = (t["a"] / 100000 - t["b"]).to_numpy()
    d = d[d != 0]
    r = ranks(np.abs(d))
    w, sizes = min(r[d > 0].sum(), r[d < 0].sum()), np.unique(np.abs(d), return_counts=True)[1]
    got = queries.QUERIES["wilcoxon_p"](spark, SF).first()
    assert got.w == pytest.approx(w, abs=0.1) and got.p == pytest.approx(models.wilcoxon_p(w, len(d), float((sizes**3 - sizes).sum())), rel=1e-3, abs=1e-12)


def test_time_indices_of_several_ranks(spark):
    rows = queries.scaled1(spark, SF).toPandas()
    (_, e), (_, f), (periods, p) = (np.unique(rows[c].to_numpy(), return_inverse=True) for c in ("entity", "feature", "period"))
    t = np.zeros((e.max() + 1, f.max() + 1, p.max() + 1))
    t[e, f, p] = rows["value"]
    got = queries.QUERIES["cp_index"](spark, SF).collect()
    for rank in (1, 2, 3):
        mine = {r.period: r for r in got if r["rank"] == rank}
        assert mine[int(periods[0])].error == pytest.approx(tensor.cp(t, rank)[2][-1], abs=5e-3) and len(mine) == len(periods)
    _, factors, _ = tensor.cp(t, 1)
    one = np.array([next(r["index"] for r in got if r["rank"] == 1 and r.period == x) for x in periods])
    assert np.abs(one) == pytest.approx(np.abs(factors[2][:, 0]), abs=1e-3)


def test_random_trials_have_the_sizes_of_their_lookback(spark):
    rows = queries.QUERIES["random_trials"](spark, SF).collect()
    grid = {r.lookback: (r.windows, r.seen) for r in queries.QUERIES["parameter_grid"](spark, SF).collect()}
    assert len(rows) == 200 and all(grid[r.lookback] == (r.windows, r.seen) and 5 <= r["rank"] <= 50 for r in rows)


@pytest.mark.parametrize("copies", [1, 2])
def test_affinity_rows_keep_few_messages_and_no_old_rounds(spark, monkeypatch, copies):
    """Rows are far smaller than all pairs, and each round's are freed."""
    rng = np.random.default_rng(2)
    x = np.tile(rng.normal(size=(240 // copies, 2)) + rng.integers(0, 6, (240 // copies, 1)) * 4, (copies, 1))
    real, most, open_ = affinity.held, [], set()

    def counted(df):
        got, free = real(df)
        most.append(got.selectExpr("sum(size(k))").first()[0])
        open_.add(id(free))
        assert len(open_) <= 2
        return got, lambda: (free(), open_.discard(id(free)))

    monkeypatch.setattr(affinity, "held", counted)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    got = [r.cluster for r in affinity.clusters(df, rounds=40).orderBy("id").collect()]
    assert got == models.affinity_propagation(x, steps=40).tolist() and max(most) < 240 * 240 / 4 and not open_


@pytest.mark.parametrize("counts", [(40,), (3, 1, 1, 2), (1, 1, 1, 1, 5)])
def test_equal_points_are_one_row(spark, monkeypatch, counts):
    """Copies in any number and order cost no rows, and get what single points get; in long doubles, as rounding tells copies apart."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(len(counts) * 10 if len(counts) > 1 else 1, 2)) + rng.integers(0, 4, (1, 2))
    x = np.repeat(base, np.resize(counts, len(base)), axis=0)
    x = x[rng.permutation(len(x))]
    real, most = affinity.held, []

    def counted(df):
        got, free = real(df)
        most.append(got.count())
        return got, free

    monkeypatch.setattr(affinity, "held", counted)
    df = spark.createDataFrame([(7 * i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>")
    got = [r.cluster for r in affinity.clusters(df, rounds=30).orderBy("id").collect()]
    assert got == models.affinity_propagation(x.astype(np.longdouble), steps=30).tolist() and max(most) == len(base)


def test_equal_panels_have_equal_profiles(spark, tmp_path):
    """To the last bit, however the rows lie."""
    for name, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")):
        t = spark.read.parquet(f"{SF}/{name}.parquet")
        copies = [t.withColumn(key, (t[key] + 1000 * i).cast(t.schema[key].dataType)).repartition(3 + i) for i in range(3)]
        copies[0].union(copies[1]).union(copies[2]).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    rows = queries._profiles(spark, str(tmp_path)).collect()
    assert len(rows) == 3 * len({tuple(r.x) for r in rows})
