"""Queries that write what the programs write, and read it back: window cache, reports, id lists, typed CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.operators import folders, panel
from lattiq.plans import evaluation, results
from lattiq.plans.queries import LOG, P3, grid, p3, query, series3
from lattiq.sources import panels

PARTS = [(m, k) for m in ("levels", "surprise") for k in (2, 4)]


def window_part(series: DataFrame, mode: str, lookback: int) -> DataFrame:
    """(mode, lookback, entity, feature, win, x, y): windows of one kind; ``surprise`` divides inputs by their window's RMS."""
    w = panel.lookback(series, lookback)
    if mode == "surprise":
        rms = panel.window_rms(series, lookback)  # a row to a period; windows without a value have none, and nothing to divide
        w = w.join(F.broadcast(rms), "win", "left").withColumn("x", F.array(*[F.get("x", F.lit(k)) / F.col("rms") for k in range(lookback)]))
    return w.select(F.lit(mode).alias("mode"), F.lit(lookback).alias("lookback"), "entity", "feature", F.col("win").cast("int").alias("win"), "x", "y")


def held_series(s, d):
    """The series that all parts are made of, worked out once, and a function that frees them; read in as many tasks as windows need."""
    series, free = folders.held(series3(s, d))
    return series.repartition(panel.tasks(s), "entity"), free


def build_cache(s, d, path: str, parts=PARTS, series: DataFrame | None = None) -> list[tuple[str, int]]:
    """Builds the parts that the cache lacks, all from one pass over the panel, or from its ``series``; which these were."""
    there = results.cached_parts(s, path)
    missing, free = [p for p in parts if p not in there], None
    if missing and series is None:
        series, free = held_series(s, d)
    try:
        for mode, lookback in missing:
            results.write_windows(window_part(series, mode, lookback), path)
    finally:
        if free is not None:
            free()
    return missing


CACHE_SQL = f"""WITH {P3}, {grid('p3')}, logged AS (SELECT entity, feature, period, {LOG.format('value')} AS value FROM dense),
l AS (SELECT *, {', '.join(f'lag(value, {k}) OVER w AS l{k}' for k in range(1, 5))}, period - (SELECT min(period) FROM p3) AS place FROM logged WINDOW w AS (PARTITION BY entity, feature ORDER BY period)),
w AS (SELECT entity, feature, place - k AS win, k, value AS y, l1, l2, CASE WHEN k > 2 THEN l3 END AS l3, CASE WHEN k > 2 THEN l4 END AS l4 FROM l, (VALUES (2), (4)) v(k)
  WHERE place >= k AND period < (SELECT max(period) FROM p3) QUALIFY count(value) OVER (PARTITION BY place, k) > 0),
r AS (SELECT k, win, coalesce(sqrt(avg(x * x)), 1.0) + 1e-8 AS rms FROM (SELECT k, win, unnest([l1, l2, l3, l4]) AS x FROM w) GROUP BY 1, 2),
m AS (SELECT w.*, mode, CASE mode WHEN 'levels' THEN 1 ELSE rms END AS s FROM w JOIN r USING (k, win), (VALUES ('levels'), ('surprise')) v(mode))
SELECT mode, CAST(k AS INTEGER) AS lookback, entity, feature, CAST(win AS INTEGER) AS win, round(l4 / s, 6) AS lag4, round(l3 / s, 6) AS lag3, round(l2 / s, 6) AS lag2, round(l1 / s, 6) AS lag1, round(y, 6) AS y FROM m"""


@query("window_cache", CACHE_SQL)
def window_cache(s, d):
    """The cache of windows, built in two goes, of which the second builds what the first left out, and read back."""
    path = folders.new(s, "windows")
    series, free = held_series(s, d)
    try:
        build_cache(s, d, path, PARTS[:1], series)
        build_cache(s, d, path, series=series)
    finally:
        free()
    out = None
    for mode, lookback in PARTS:
        part = results.non_empty(results.load_windows(s, path, mode, lookback), f"windows of {mode}, {lookback}")
        lag = lambda k: F.round(F.get("x", F.lit(lookback - k)), 6)  # noqa: B023, E731  NULL beyond the lookback
        part = part.select("mode", "lookback", "entity", "feature", "win", *[lag(k).alias(f"lag{k}") for k in (4, 3, 2, 1)], F.round("y", 6).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ reports


def sparsity_reports(s, d) -> dict[str, DataFrame]:
    """The four density tables: overall, by entity, by feature, by period; from counts, without the grid."""
    long = p3(s, d)
    axes = F.broadcast(long.agg(F.count_distinct("entity").alias("entities"), F.count_distinct("feature").alias("features"), F.min("period").alias("lo"), F.max("period").alias("hi")))
    axes_row = axes.withColumn("periods", F.col("hi") - F.col("lo") + 1)
    sizes = {"entity": F.col("features") * F.col("periods"), "feature": F.col("entities") * F.col("periods"), "period": F.col("entities") * F.col("features")}
    out = {}
    for key, size in sizes.items():
        seen = long.groupBy(key).agg(F.count("value").alias("seen")).join(F.broadcast(axes_row), F.lit(True))
        out[key] = seen.select(F.col(key).cast("string").alias("key"), "seen", size.cast("long").alias("cells"), F.round(F.col("seen") / (size + 1e-12), 6).alias("density"))
    empty = axes_row.select(F.explode(F.sequence("lo", "hi")).alias("period"), (F.col("entities") * F.col("features")).cast("long").alias("cells"))
    gone = empty.join(long.select("period").distinct(), "period", "left_anti").select(F.col("period").cast("string").alias("key"), F.lit(0).cast("long").alias("seen"), "cells", F.lit(0.0).alias("density"))
    out["period"] = out["period"].unionByName(gone)
    every = F.col("entities") * F.col("features") * F.col("periods")
    whole = long.agg(F.count("value").alias("seen")).join(F.broadcast(axes_row), F.lit(True))
    out["overall"] = whole.select(F.lit("all").alias("key"), "seen", every.cast("long").alias("cells"), F.round(F.col("seen") / (every + 1e-12), 6).alias("density"))
    return out


def write_sparsity(s, d, folder: str) -> list[str]:
    """The four density tables as CSV files; their names."""
    names = []
    for kind, table in sparsity_reports(s, d).items():
        results.write_csv(table, f"{folder}/sparsity_{kind}")
        names.append(f"sparsity_{kind}")
    return names


@query("sparsity_files", f"""WITH {P3}, {grid('p3')} SELECT CASE WHEN entity IS NOT NULL THEN 'entity' WHEN feature IS NOT NULL THEN 'feature' WHEN period IS NOT NULL THEN 'period' ELSE 'overall' END AS kind,
coalesce(CAST(entity AS VARCHAR), feature, CAST(period AS VARCHAR), 'all') AS key, count(value) AS seen, count(*) AS cells, round(count(value) / (count(*) + 1e-12), 6) AS density
FROM dense GROUP BY GROUPING SETS ((entity), (feature), (period), ())""")
def sparsity_files(s, d):
    """The density files, written and read back with their types."""
    folder, out = folders.new(s, "reports"), None
    for name in write_sparsity(s, d, folder):
        part = results.read_csv(s, f"{folder}/{name}", "key string, seen long, cells long, density double").select(F.lit(name.partition("_")[2]).alias("kind"), "key", "seen", "cells", "density")
        out = part if out is None else out.unionByName(part)
    return results.complete(out, "density files", "density")


def write_comparison(s, d, folder: str, configurations=None) -> dict[str, str]:
    """The four tables of the final evaluation as CSV files: {name: schema}."""
    rows, totals = evaluation.compared(s, d, configurations)
    by_feature = evaluation.table_of(s, rows, evaluation.BY_FEATURE)
    tests = evaluation.significance(by_feature)
    tables = {"results": evaluation.table_of(s, totals, evaluation.POOLED), "per_feature": by_feature, "persistence": by_feature.select("mode", "lookback", "feature", "ar1_rho", "delta"), "stats": tests}
    for name, t in tables.items():
        results.write_csv(t.coalesce(1), f"{folder}/{name}")  # as many rows as configurations and features
    return {name: ", ".join(f"{c} {k}" for c, k in t.dtypes) for name, t in tables.items()}


@query("comparison_files")
def comparison_files(s, d):
    """(file, line): the files of the final evaluation, read back as text without their headers."""
    folder, out = folders.new(s, "comparison"), None
    for name, schema in write_comparison(s, d, folder).items():
        t = results.read_csv(s, f"{folder}/{name}", schema)
        part = t.select(F.lit(name).alias("file"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in t.columns]).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out


@query("id_list", "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def id_list(s, d):
    """The ids of a segment's customers with orders as a text file, a line each, read back."""
    path = folders.new(s, "ids")
    chosen = panels.read(s, d, "customer").where("c_mktsegment = 'BUILDING'").join(panels.read(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    results.write_ids(chosen, "c_custkey", path)
    return s.read.text(path).select(F.col("value").alias("id"))


@query("csv_scan", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS day, o_totalprice AS price FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'""")
def csv_scan(s, d):
    """Typed CSV with dates, some of them no dates, read and filtered: these become NULL and stay."""
    path, o = folders.new(s, "csv"), panels.read(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    results.write_csv(o.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'").select("o_orderkey", text.alias("day"), F.col("o_totalprice").alias("price")), path)
    return results.read_csv(s, path, "o_orderkey long, day date, price double")


@query("file_variants", """SELECT v AS variant, c_nationkey AS nation, round(CASE v WHEN 'mean' THEN avg(c_acctbal) ELSE median(c_acctbal) END, 6) AS balance FROM customer, (VALUES ('mean'), ('median')) t(v) GROUP BY 1, 2""")
def file_variants(s, d):
    """Two files of one table, of means and of medians, and what a flag reads."""
    folder, c = folders.new(s, "variants"), panels.read(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation"))
    for flag, balance in ((True, F.avg("c_acctbal")), (False, F.median("c_acctbal"))):
        results.write_csv(c.agg(F.round(balance, 6).alias("balance")), results.variant(folder, "balance", flag))
    read = lambda flag: results.read_csv(s, results.variant(folder, "balance", flag), "nation int, balance double")
    return read(True).select(F.lit("mean").alias("variant"), "nation", "balance").unionByName(read(False).select(F.lit("median").alias("variant"), "nation", "balance"))


# ------------------------------------------------------------ a configured range of periods


@query("configured_grid", f"""WITH {P3}, a AS (SELECT min(period) - 2 AS lo, max(period) + 3 AS hi FROM p3)
SELECT e.entity, f.feature, CAST(p.period AS INTEGER) AS period, round(v.value, 6) AS value FROM (SELECT DISTINCT entity FROM p3) e CROSS JOIN (SELECT DISTINCT feature FROM p3) f
CROSS JOIN (SELECT unnest(range((SELECT lo FROM a), (SELECT hi + 1 FROM a))) AS period) p LEFT JOIN p3 v ON v.entity = e.entity AND v.feature = f.feature AND v.period = p.period""")
def configured_grid(s, d):
    """The grid over a range of periods that is given, not found: here two days more before and three behind."""
    long = p3(s, d)
    ends = long.agg((F.min("period") - 2).alias("lo"), (F.max("period") + 3).alias("hi")).first()
    return panel.densify(long, (ends["lo"], ends["hi"])).select("entity", "feature", "period", F.round("value", 6).alias("value"))

