"""A search that runs: trials of the structured tensor regression, kept in a store and resumed.

Trials are drawn by number, so a space is the same whenever it is asked for. Those that the store lacks are solved in tasks from
the panel's sums (see ``contest``), scored together in one pass over the panel, and written as a batch whose name is
its trials', so that writing it again after a kill replaces it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import contest, folders, models, panel
from lattiq.operators.cells import cell_gramian, dense, summed
from lattiq.plans import results
from lattiq.plans.queries import p1, query

#: Bytes of solved models that go over the panel together.
BATCH_BYTES = 32 << 20


def space(s: SparkSession, trials: int, ranks: tuple[int, int] = (5, 50), penalties: tuple[float, float] = (1e-4, 100.0)) -> DataFrame:
    """(trial, lookback, scaled, rank, penalty): category, flag, integer and log-uniform draws by hashes of the number."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / (1 << 30)
    low, high = (float(np.log10(x)) for x in penalties)
    rank = (ranks[0] + F.floor(u(3) * (ranks[1] - ranks[0] + 1))).cast("int")
    return s.range(0, trials, 1, 4).select(F.col("id").alias("trial"), F.when(u(1) < 0.5, 2).otherwise(4).alias("lookback"), (u(2) < 0.5).alias("scaled"), rank.alias("rank"), F.pow(F.lit(10.0), low + u(4) * (high - low)).alias("penalty"))


SOLVED = "trial long, fold int, rank int, e binary, s binary, q binary"


def _solve(s: SparkSession, trials: list, sums: dict, gxx: np.ndarray, shape: tuple[int, int], least: dict) -> DataFrame:
    """Models of all trials and folds that have enough cells, solved in tasks; the sums go along as a broadcast, whose size is that
    of features x periods squared."""
    rows = [(t.trial, i, t.lookback, t.scaled, t.rank, t.penalty) for t in trials for i in range(len(sums[t.lookback][1]))]
    sent = s.sparkContext.broadcast((gxx, {lag: (d, cuts, x.gyy, x.rr, x.n) for lag, (d, cuts, x) in sums.items()}))

    def run(batches):
        g, of = sent.value
        for b in batches:
            out = []
            for r in b.itertuples():
                d, cuts, gyy, rr, n = of[r.lookback]
                seen, scale = n[r.fold, 0].sum(), 1.0
                if r.scaled:
                    scale = float(np.sqrt(rr[r.fold, 0].sum() / max(seen, 1)))
                    if seen <= least[r.lookback][r.fold] or scale < 1e-4:
                        continue
                by = scale + 1e-8 if r.scaled else 1.0
                m = models.StructuredCp(g, gyy[r.fold] / by**2, shape, d.starts, d.weight, d.lags, cuts[r.fold][0], r.rank, r.penalty)
                out.append((r.trial, r.fold, r.rank, (m.e * scale / by).tobytes(), m.scores.tobytes(), m.q.tobytes()))
            yield pd.DataFrame(out, columns=["trial", "fold", "rank", "e", "s", "q"])

    df = s.createDataFrame(rows, "trial long, fold int, lookback int, scaled boolean, rank int, penalty double")
    return df.repartition(max(1, min(len(rows), 4 * s.sparkContext.defaultParallelism)), "trial", "fold").mapInPandas(run, SOLVED)


def _scores(p: contest.Panel, sums: dict, trials: list, solved: list) -> dict:
    """{(trial, fold): R2} from one pass over the panel."""
    k, size, lag_of = len(p.axes.features), p.axes.size, {t.trial: t.lookback for t in trials}
    parts = []
    for r in solved:
        d, cuts, _ = sums[lag_of[r["trial"]]]
        parts.append((d, cuts, r["fold"], contest.fallbacks(p, d, cuts)[r["fold"]], *(np.frombuffer(r[x], np.float64).reshape(-1, r["rank"]) for x in ("e", "s", "q"))))

    def add(batch, total):
        out = total.reshape(len(parts), 4)
        for _, v in dense(batch, size):
            v, known = v.reshape(len(v), k, -1), {}
            for i, (d, cuts, fold, fallback, e, s, q) in enumerate(parts):
                a, b = cuts[fold]
                if (d.lags, fold) not in known:
                    y = d.targets(v)
                    m = contest.train_means(y, a, fallback)
                    known[d.lags, fold] = m, y[:, :, a:b], np.nan_to_num(y[:, :, :a] - m[:, :, None]).reshape(len(v), -1)
                m, y, rest = known[d.lags, fold]
                fit = m[:, :, None] + np.einsum("nr,fr,tr->nft", rest @ q, e, s[a:b], optimize=True)
                seen = ~np.isnan(y)
                out[i] += [seen.sum(), np.nansum(y), np.nansum(y * y), np.sum((y - fit)[seen] ** 2)]

    got, out = summed(p.rows, add, 4 * len(parts)).reshape(-1, 4), {}
    for r, (n, total, squares, sse) in zip(solved, got):
        d, cuts, _ = sums[lag_of[r["trial"]]]
        a, b = cuts[r["fold"]]
        spread = squares - total**2 / n if n else 0.0
        out[r["trial"], r["fold"]] = float(1 - sse / spread) if n >= contest.pooled_least(p.entities * (b - a) * k) and spread > 1e-8 else None
    return out


STORE = "trial long, lookback int, scaled boolean, rank int, penalty double, scores array<double>"


def search(s: SparkSession, long: DataFrame, trials: DataFrame, store: str, batch: int = 16) -> int:
    """Runs the trials that the store lacks, batch by batch; how many these were. A search that ends early is resumed by
    calling it again."""
    if folders.exists(s, store):
        trials = results.open_trials(trials, s.read.parquet(store))
    todo = sorted(trials.collect())  # a row for each trial of the space
    if not todo:
        return 0
    p = contest.load(long)
    try:
        gxx, k, sums, least = cell_gramian(p.rows, p.axes), len(p.axes.features), {}, {}
        for lag in sorted({t.lookback for t in todo}):
            d = contest.design(p, "levels", lag)
            cuts = [c for c in panel.folds(int(0.8 * len(d.starts))) if c[0] > 0 and c[1] > c[0]]
            sums[lag] = d, cuts, contest.Sums(p, d, cuts, len(cuts))
            least[lag] = [contest.pooled_least(p.entities * a * k) for a, _ in cuts]
        shape = (k, p.axes.periods)
        for i in range(0, len(todo), batch):
            part = todo[i : i + batch]
            solved, got, size = _solve(s, part, sums, gxx, shape, least), {}, 0
            held = []
            for r in solved.toLocalIterator():
                held.append(r)
                size += sum(len(r[x]) for x in ("e", "s", "q"))
                if size > BATCH_BYTES:
                    got |= _scores(p, sums, part, held)
                    held, size = [], 0
            if held:
                got |= _scores(p, sums, part, held)
            rows = [(*t, [got.get((t.trial, f)) for f in range(len(sums[t.lookback][1]))]) for t in part]
            name = hashlib.sha256(",".join(str(t.trial) for t in part).encode()).hexdigest()[:16]
            results.append_trials(s.createDataFrame(rows, STORE).coalesce(1), store, name)
    finally:
        p.drop()
    return len(todo)


def judged(store: DataFrame) -> DataFrame:
    """The store with ``state`` (complete or pruned) and ``score``: the mean of the valid folds' scores, each bounded by -1."""
    valid = F.filter("scores", lambda x: x.isNotNull() & ~F.isnan(x))
    bounded = F.transform(valid, lambda x: F.greatest(x, F.lit(-1.0)))
    mean = F.aggregate(bounded, F.lit(0.0), lambda acc, x: acc + x) / F.when(F.size(valid) > 0, F.size(valid))
    cut = results.pruned(F.col("scores"))
    return store.withColumn("state", F.when(cut, "pruned").otherwise("complete")).withColumn("score", F.when(~cut, scalar.finite(mean)))


def _panel(s, d) -> DataFrame:
    """The first panel with log-modulus values; its levels differ by feature and entity, so there is something to forecast."""
    return p1(s, d).withColumn("value", scalar.log_modulus(F.col("value")))


def _store(s, d, trials: int = 24) -> DataFrame:
    """The store of a search that ran in two goes."""
    path, every = folders.new(s, "study"), space(s, trials, (2, 12))
    long = _panel(s, d)
    search(s, long, every.where(F.col("trial") < trials // 3), path)
    search(s, long, every, path)
    return s.read.schema(STORE + ", batch string").parquet(path).drop("batch")


@query("search_trials")
def search_trials(s, d):
    """Every trial of a search: parameters, fold scores, state and score."""
    return judged(_store(s, d))


@query("search_ensemble")
def search_ensemble(s, d, k: int = 3):
    """The best trials of each lookback that were not pruned, fewer where fewer are left, refitted on the development windows; their
    mean forecast, scored on the held-out windows: (lookback, members, r2, best_r2)."""
    table = judged(_store(s, d)).where("score IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("lookback").orderBy(F.desc("score"), "trial"))
    best = sorted(table.withColumn("place", place).where(F.col("place") <= k).collect(), key=lambda r: (r["lookback"], r["place"]))
    p = contest.load(_panel(s, d))
    out = []
    try:
        gxx = cell_gramian(p.rows, p.axes)
        for lag in sorted({r["lookback"] for r in best}):
            fits = [contest.fit(p, gxx, "levels", lag, r["rank"], r["penalty"], None if r["scaled"] else 0, r["scaled"]) for r in best if r["lookback"] == lag]
            fits = [f for f in fits if f.tensors[-1] is not None]  # a member that can't be fitted is left out
            if not fits:
                continue
            each = [contest.predictions(p.rows, p.axes, f).where(F.col("cut") == contest.HELD_OUT).select("entity", "feature", "win", "y", F.lit(i).alias("member"), "cp") for i, f in enumerate(fits)]
            every = each[0]
            for e in each[1:]:
                every = every.unionByName(e)
            mean = every.groupBy("entity", "feature", "win").agg(F.first("y").alias("y"), F.avg("cp").alias("p"), F.max(F.when(F.col("member") == 0, F.col("cp"))).alias("first"))
            r = mean.agg(contest.r2("p").alias("r2"), contest.r2("first").alias("best")).first()
            out.append((lag, len(fits), r["r2"], r["best"]))
    finally:
        p.drop()
    return s.createDataFrame(out, "lookback int, members int, r2 double, best_r2 double")
