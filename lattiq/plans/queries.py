"""Named queries over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import affinity, contest, models, panel, tensor
from lattiq.operators.cells import dense, summed
from lattiq.operators.folders import kept
from lattiq.sources import panels

QUERIES = {}
ORACLE_SQL = {}
SIX = 6

#: The panels as SQL.
P1 = """p1w AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS INTEGER) AS period, sum(l_quantity) AS qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS price, CAST(sum(CAST(l_discount AS DECIMAL(18, 2))) AS DOUBLE) / count(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
p1 AS (SELECT entity, f AS feature, period, value FROM p1w UNPIVOT (value FOR f IN (qty, price, discount)))"""
P2 = """p2w AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INTEGER) AS period,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS orders FROM orders GROUP BY 1, 2),
p2 AS (SELECT entity, f AS feature, period, value FROM p2w UNPIVOT (value FOR f IN (total, orders)))"""
P3 = """p3 AS (SELECT user_id AS entity, event_type AS feature, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS period, sum(value) AS value
  FROM events GROUP BY 1, 2, 3)"""


def grid(p: str) -> str:
    return f"""dense AS (SELECT e.entity, f.feature, p.period, v.value FROM (SELECT DISTINCT entity FROM {p}) e CROSS JOIN (SELECT DISTINCT feature FROM {p}) f
  CROSS JOIN (SELECT CAST(unnest(range((SELECT min(period) FROM {p}), (SELECT max(period) + 1 FROM {p}))) AS INTEGER) AS period) p
  LEFT JOIN {p} v ON v.entity = e.entity AND v.feature = f.feature AND v.period = p.period)"""


LOG = "sign({0}) * ln(1 + abs({0}))"
#: Two-lag windows of the logged third panel; the last period is never a target, empty windows are dropped.
WINDOWS = f"""WITH {P3}, {grid('p3')}, logged AS (SELECT entity, feature, period, {LOG.format('value')} AS value FROM dense),
lagged AS (SELECT *, lag(value, 2) OVER w AS x1, lag(value, 1) OVER w AS x2, period - (SELECT min(period) FROM p3) - 2 AS win FROM logged
  WINDOW w AS (PARTITION BY entity, feature ORDER BY period)),
windows AS (SELECT entity, feature, CAST(win AS INTEGER) AS win, x1, x2, value AS y FROM lagged WHERE win >= 0 AND period < (SELECT max(period) FROM p3)
  QUALIFY count(value) OVER (PARTITION BY win) > 0)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def r6(name: str):
    return F.round(F.col(name), SIX).alias(name)


def p1(s, d):
    return panels.unpivot(panels.suppliers(s, d), ["qty", "price", "discount"])


def p2(s, d):
    return panels.unpivot(panels.customers(s, d).withColumn("orders", F.col("orders").cast("double")), ["total", "orders"])


def p3(s, d):
    return panels.users(s, d)


def series3(s, d) -> DataFrame:
    """The logged third panel, an array of values for each entity x feature."""
    return panel.series(p3(s, d).withColumn("value", scalar.log_modulus(F.col("value"))))


def windows3(s, d, lags: int = 2) -> DataFrame:
    return panel.lookback(series3(s, d), lags)


# ------------------------------------------------------------ scalars, scans, filters


@query("to_numeric_percent", """SELECT p_partkey, round(TRY_CAST(replace(regexp_replace(trim(t), '%+$', ''), ',', '') AS DOUBLE) / CASE WHEN trim(t) LIKE '%\\%' ESCAPE '\\' THEN 100 ELSE 1 END, 6) AS value
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' ' || p_size || '.5% ' WHEN 1 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.5' WHEN 2 THEN p_brand END AS t FROM part)""")
def to_numeric_percent(s, d):
    n = F.col("p_size").cast("string")
    t = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), n, F.lit(".5% "))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("1,"), F.lpad(n, 3, "0"), F.lit(".5"))).when(F.col("p_size") % 4 == 2, F.col("p_brand"))
    return panels.read(s, d, "part").select("p_partkey", F.round(scalar.to_numeric(t), SIX).alias("value"))


@query("log_modulus", f"SELECT c_custkey, round({LOG.format('c_acctbal')}, 6) AS value FROM customer")
def log_modulus(s, d):
    return panels.read(s, d, "customer").select("c_custkey", F.round(scalar.log_modulus(F.col("c_acctbal")), SIX).alias("value"))


@query("date_range_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
def date_range_filter(s, d):
    return panels.read(s, d, "orders").where("o_orderdate BETWEEN TIMESTAMP_NTZ '1995-01-01' AND TIMESTAMP_NTZ '1995-03-31'").select("o_orderkey", "o_totalprice")


@query("isin_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def isin_filter(s, d):
    return panels.read(s, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("snap_quarter", "SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q FROM orders")
def snap_quarter(s, d):
    return panels.read(s, d, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("q")).distinct()


@query("column_profile", "SELECT count(*) AS n, count(c_acctbal) AS seen, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer")
def column_profile(s, d):
    x = F.col("c_acctbal")
    return panels.read(s, d, "customer").agg(F.count("*").alias("n"), F.count(x).alias("seen"), F.round(F.avg(x), SIX).alias("mean"), F.round(F.stddev_samp(x), SIX).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))


@query("coverage_filter", f"WITH {P3} SELECT entity FROM p3 GROUP BY 1 HAVING count(DISTINCT feature) = (SELECT count(DISTINCT feature) FROM p3)")
def coverage_filter(s, d):
    rows = p3(s, d)
    n = rows.agg(F.count_distinct("feature").alias("all"))
    per = rows.groupBy("entity").agg(F.count_distinct("feature").alias("n"))
    return per.join(F.broadcast(n), F.col("n") == F.col("all"), "left_semi").select("entity")


@query("late_start_filter", f"WITH {P2}, lo AS (SELECT min(period) AS lo FROM p2) SELECT entity, feature, period, round(value, 2) AS value FROM p2, lo WHERE entity NOT IN (SELECT entity FROM p2, lo GROUP BY entity, lo HAVING min(period) > lo + 1)")
def late_start_filter(s, d):
    """The rows of entities whose first row is not later than the second period of the panel."""
    rows = p2(s, d)
    lo = F.broadcast(rows.agg(F.min("period").alias("lo")))
    late = panel.starts(rows).join(lo, F.col("first_period") > F.col("lo") + 1, "left_semi").select("entity")
    return rows.join(late, "entity", "left_anti").select("entity", "feature", "period", F.round("value", 2).alias("value"))


@query("common_start", f"WITH {P1} SELECT max(m) AS start FROM (SELECT min(period) AS m FROM p1 GROUP BY entity)")
def common_start(s, d):
    return panel.starts(p1(s, d)).agg(F.max("first_period").alias("start"))


@query("aligned_start", f"WITH {P3} SELECT entity, feature, period, round(value, 6) AS value FROM p3 WHERE period >= (SELECT max(m) FROM (SELECT min(period) AS m FROM p3 GROUP BY entity))")
def aligned_start(s, d):
    """The panel from the latest first period of all its entities on."""
    rows = p3(s, d)
    start = panel.starts(rows).agg(F.max("first_period").alias("start"))
    return rows.join(F.broadcast(start), F.col("period") >= F.col("start"), "left_semi").select("entity", "feature", "period", r6("value"))


@query("incomplete_dropped", f"""WITH {P1}, {grid('p1')}, bad AS (SELECT DISTINCT entity FROM dense WHERE value IS NULL OR (feature = 'qty' AND value < 200))
SELECT entity, feature, period, value FROM dense WHERE entity NOT IN (SELECT entity FROM bad)""")
def incomplete_dropped(s, d):
    """The grid without entities that miss any cell; a quantity below 200 counts as missing here, so that some do."""
    kept = p1(s, d).withColumn("value", F.when((F.col("feature") != "qty") | (F.col("value") >= 200), F.col("value")))
    dense = panel.densify(kept)
    gaps = dense.where("value IS NULL").select("entity").distinct()
    return dense.join(gaps, "entity", "left_anti").select("entity", "feature", "period", "value")


@query("complete_rows", f"WITH {P2} SELECT entity, period FROM p2 GROUP BY 1, 2 HAVING count(*) = 2 AND sum(CASE WHEN feature = 'total' THEN value END) > 200000")
def complete_rows(s, d):
    return panels.customers(s, d).na.drop("any").where("total > 200000").select("entity", "period")


# ------------------------------------------------------------ joins


@query("semi_join_taxonomy", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def semi_join_taxonomy(s, d):
    asia = panels.read(s, d, "nation").join(panels.read(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return panels.read(s, d, "customer").join(asia, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(s, d):
    urgent = panels.read(s, d, "orders").where("o_orderpriority = '1-URGENT'")
    return panels.read(s, d, "customer").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("label_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def label_lookup(s, d):
    return panels.read(s, d, "supplier").join(panels.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("entity_index", f"WITH {P1} SELECT entity, CAST(row_number() OVER (ORDER BY CAST(entity AS VARCHAR)) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT entity FROM p1)")
def entity_index(s, d):
    """Keys numbered in the order of their names, by ranges."""
    keys = kept(p1(s, d).select("entity").distinct()).withColumn("name", F.col("entity").cast("string"))
    return panel.numbered(keys, "name").select("entity", F.col("nth").cast("int").alias("idx"))


@query("nunique_taxonomy", "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def nunique_taxonomy(s, d):
    both = panels.read(s, d, "customer").join(panels.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(panels.read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("nations"), F.count_distinct("c_custkey").alias("customers"))


# ------------------------------------------------------------ grid, windows, scaling


@query("densify_grid", f"WITH {P3}, {grid('p3')} SELECT entity, feature, period, round(value, 6) AS value FROM dense")
def densify_grid(s, d):
    return panel.densify(p3(s, d)).select("entity", "feature", "period", r6("value"))


@query("ffill_panel", f"WITH {P2}, {grid('p2')} SELECT entity, feature, period, round(last_value(value IGNORE NULLS) OVER (PARTITION BY entity, feature ORDER BY period ROWS UNBOUNDED PRECEDING), 6) AS value FROM dense")
def ffill_panel(s, d):
    return panel.forward_fill(panel.densify(p2(s, d))).select("entity", "feature", "period", r6("value"))


@query("zscore_by_entity", f"""WITH {P1} SELECT entity, feature, period, round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) ELSE 0 * value END, 6) + 0 AS z
FROM p1 WINDOW w AS (PARTITION BY entity, feature)""")
def zscore_by_entity(s, d):
    return panel.zscore(p1(s, d), ["entity", "feature"]).select("entity", "feature", "period", (F.round("value", SIX) + 0.0).alias("z"))


@query("zscore_by_period_samp", f"""WITH {P3} SELECT entity, feature, period, round(greatest(-5, least(5, coalesce((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8), 0))), 6) + 0 AS z FROM p3 WINDOW w AS (PARTITION BY feature, period)""")
def zscore_by_period_samp(s, d):
    z = panel.zscore(p3(s, d), ["feature", "period"], sample=True)
    return z.select("entity", "feature", "period", (F.round(F.coalesce(scalar.clip(F.col("value"), -5, 5), F.lit(0.0)), SIX) + 0.0).alias("z"))


@query("rms_scale_by_period", f"WITH {P3} SELECT entity, feature, period, round(value / (sqrt(avg(value * value) OVER (PARTITION BY feature, period)) + 1e-8), 6) AS value FROM p3")
def rms_scale_by_period(s, d):
    return panel.rms_scale(p3(s, d), ["feature", "period"]).select("entity", "feature", "period", r6("value"))


@query("clip_fill", f"WITH {P2}, {grid('p2')} SELECT entity, feature, period, round(CASE WHEN value IS NULL THEN 0 ELSE greatest(-5, least(5, ln(1 + value) - 8)) END, 6) AS value FROM dense")
def clip_fill(s, d):
    x = scalar.clip(F.log1p("value") - 8, -5, 5)
    return panel.densify(p2(s, d)).select("entity", "feature", "period", F.round(F.coalesce(x, F.lit(0.0)), SIX).alias("value"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(s, d):
    return panel.keep_last(panels.read(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("dedup_keep_last", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def dedup_keep_last(s, d):
    e = panels.read(s, d, "events").withColumn("day", F.col("ts").cast("date"))
    return panel.keep_last(e, ["user_id", "event_type", "day"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("lookback_windows", WINDOWS + " SELECT entity, feature, win, round(x1, 6) AS x1, round(x2, 6) AS x2, round(y, 6) AS y FROM windows")
def lookback_windows(s, d):
    x = F.col("x")
    return windows3(s, d).select("entity", "feature", F.col("win").cast("int").alias("win"), F.round(x[0], SIX).alias("x1"), F.round(x[1], SIX).alias("x2"), r6("y"))


@query("window_rms", WINDOWS + ", cells AS (SELECT win, x1 AS x FROM windows UNION ALL SELECT win, x2 FROM windows) SELECT win, round(coalesce(sqrt(avg(x * x)), 1.0) + 1e-8, 6) AS rms FROM cells GROUP BY 1")
def window_rms(s, d):
    cells = windows3(s, d).select(F.col("win").cast("int").alias("win"), F.explode("x").alias("x"))
    return cells.groupBy("win").agg(F.round(F.coalesce(F.sqrt(F.avg(F.col("x") * F.col("x"))), F.lit(1.0)) + 1e-8, SIX).alias("rms"))


FOLDS_SQL = """ , n AS (SELECT CAST(floor(0.8 * count(DISTINCT win)) AS INTEGER) AS n FROM windows),
f AS (SELECT i, n - (3 - i) * (n // 4) AS a, n - (2 - i) * (n // 4) AS b FROM n, (VALUES (0), (1), (2)) v(i))
SELECT CAST(i AS INTEGER) AS fold, CASE WHEN win < a THEN 'train' ELSE 'val' END AS part, count(*) AS cells, count(y) AS seen FROM windows JOIN f ON win < b GROUP BY 1, 2"""


@query("cv_folds", WINDOWS + FOLDS_SQL)
def cv_folds(s, d):
    w = windows3(s, d)
    n = w.agg(F.floor(F.count_distinct("win") * 0.8).cast("int").alias("n"))
    f = n.select("n", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
    test = F.floor(F.col("n") / 4)
    f = f.select("fold", (F.col("n") - (3 - F.col("fold")) * test).alias("a"), (F.col("n") - (2 - F.col("fold")) * test).alias("b"))
    parts = w.join(F.broadcast(f), F.col("win") < F.col("b")).withColumn("part", F.when(F.col("win") < F.col("a"), "train").otherwise("val"))
    return parts.groupBy("fold", "part").agg(F.count("*").alias("cells"), F.count("y").alias("seen"))


HOLD = " , h AS (SELECT floor(0.8 * count(DISTINCT win)) AS n FROM windows) "


def holdout(w: DataFrame) -> DataFrame:
    """Windows with the flag ``dev`` for the first four fifths."""
    n = w.agg(F.floor(F.count_distinct("win") * 0.8).alias("n"))
    return w.join(F.broadcast(n), F.lit(True)).withColumn("dev", F.col("win") < F.col("n")).drop("n")


@query("holdout_split", WINDOWS + HOLD + "SELECT win < n AS dev, count(DISTINCT win) AS windows, count(y) AS seen FROM windows, h GROUP BY 1")
def holdout_split(s, d):
    return holdout(windows3(s, d)).groupBy("dev").agg(F.count_distinct("win").alias("windows"), F.count("y").alias("seen"))


# ------------------------------------------------------------ missingness, density, means


@query("panel_density", f"WITH {P2}, {grid('p2')} SELECT count(*) AS cells, count(value) AS seen, round(count(value) / (count(*) + 1e-12), 6) AS density FROM dense")
def panel_density(s, d):
    return panel.densify(p2(s, d)).agg(F.count("*").alias("cells"), F.count("value").alias("seen"), F.round(F.count("value") / (F.count("*") + 1e-12), SIX).alias("density"))


@query("density_grouping_sets", f"""WITH {P3}, {grid('p3')} SELECT entity, feature, period, count(*) AS cells, count(value) AS seen, round(count(value) / (count(*) + 1e-12), 6) AS density
FROM dense GROUP BY GROUPING SETS ((entity), (feature), (period), ())""")
def density_grouping_sets(s, d):
    dense = panel.densify(p3(s, d))
    sets = dense.groupingSets([["entity"], ["feature"], ["period"], []], "entity", "feature", "period")
    return sets.agg(F.count("*").alias("cells"), F.count("value").alias("seen"), F.round(F.count("value") / (F.count("*") + 1e-12), SIX).alias("density"))


for _key in ("feature", "entity"):
    query(f"missing_by_{_key}", f"WITH {P3}, {grid('p3')} SELECT {_key}, count(*) - count(value) AS missing, round((count(*) - count(value)) / count(*), 6) AS rate FROM dense GROUP BY 1")(
        lambda s, d, k=_key: panel.missing_share(p3(s, d), k == "entity").select(k, "missing", r6("rate"))
    )


@query("missing_report", f"""WITH {P2}, {grid('p2')} SELECT entity, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0 END), 6) AS overall,
round(avg(CASE WHEN feature = 'total' THEN CASE WHEN value IS NULL THEN 1.0 ELSE 0 END END), 6) AS total,
round(avg(CASE WHEN feature = 'orders' THEN CASE WHEN value IS NULL THEN 1.0 ELSE 0 END END), 6) AS orders FROM dense GROUP BY 1""")
def missing_report(s, d):
    gap = F.col("value").isNull().cast("double")
    return panel.densify(p2(s, d)).groupBy("entity").agg(F.round(F.avg(gap), SIX).alias("overall"), *[F.round(F.avg(F.when(F.col("feature") == f, gap)), SIX).alias(f) for f in ("total", "orders")])


@query("worst_entities_topk", f"WITH {P3}, {grid('p3')} SELECT entity, count(*) - count(value) AS missing FROM dense GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def worst_entities_topk(s, d):
    return panel.missing_share(p3(s, d), True).orderBy(F.desc("missing"), "entity").limit(5).select("entity", "missing")


@query("masked_feature_mean", WINDOWS + " SELECT feature, round(sum(y) / (count(y) + 1e-8), 6) AS mean FROM windows GROUP BY 1")
def masked_feature_mean(s, d):
    return windows3(s, d).groupBy("feature").agg(F.round(F.sum("y") / (F.count("y") + 1e-8), SIX).alias("mean"))


@query("firm_feature_means", WINDOWS + HOLD + """, f AS (SELECT feature, sum(y) FILTER (win < n) / (count(y) FILTER (win < n) + 1e-8) AS fallback FROM windows, h GROUP BY 1)
SELECT entity, feature, round(coalesce(avg(y) FILTER (win < n), any_value(fallback)), 6) AS mean FROM windows JOIN f USING (feature), h GROUP BY entity, feature""")
def firm_feature_means(s, d):
    """Means of the development windows; a cell never seen there falls back to the mean of its feature's seen cells."""
    return train_means(holdout(windows3(s, d))).select("entity", "feature", F.round("mean", SIX).alias("mean"))


def train_means(w: DataFrame) -> DataFrame:
    """(entity, feature, mean) of the development cells of windows with ``dev``; sums first, so no group is held."""
    y = F.when(F.col("dev"), F.col("y"))
    sums = w.groupBy("entity", "feature").agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    by_feature = sums.groupBy("feature").agg((F.sum("s") / (F.sum("n") + 1e-8)).alias("fallback"))
    return sums.join(F.broadcast(by_feature), "feature").select("entity", "feature", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.col("fallback")).alias("mean"))


@query("group_feature_means", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS balance, count(*) AS n FROM customer GROUP BY 1")
def group_feature_means(s, d):
    return panels.read(s, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), SIX).alias("balance"), F.count("*").alias("n"))


@query("standard_scaler", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z FROM customer")
def standard_scaler(s, d):
    c = panels.read(s, d, "customer")
    m = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("sd"))
    return c.join(F.broadcast(m), F.lit(True)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("sd"), SIX).alias("z"))


# ------------------------------------------------------------ tensors


@query("tensor_coo", f"WITH {P1} SELECT entity, feature, period, value FROM p1")
def tensor_coo(s, d):
    """Observed cells, unrounded: sums are exact, and a mean is one division of exact numbers."""
    return p1(s, d).select("entity", "feature", "period", "value")


@query("slice_norms", f"WITH {P1} SELECT period, round(sqrt(sum(value * value)), 4) AS norm FROM p1 GROUP BY 1")
def slice_norms(s, d):
    return p1(s, d).groupBy("period").agg(F.round(F.sqrt(F.sum(F.col("value") ** 2)), 4).alias("norm"))


for _mode, _rest in (("feature", "entity, period"), ("period", "entity, feature")):
    query(f"mode_gramian_{_mode}", f"WITH {P3} SELECT a.{_mode} AS i, b.{_mode} AS j, round(sum(a.value * b.value), 4) AS g FROM p3 a JOIN p3 b USING ({_rest}) WHERE a.{_mode} <= b.{_mode} GROUP BY 1, 2")(
        lambda s, d, m=_mode: tensor.gramian(p3(s, d), m).select("i", "j", F.round("g", 4).alias("g"))
    )


@query("slice_extremes", f"WITH {P1}, n AS (SELECT period, sum(value * value) AS v FROM p1 GROUP BY 1) SELECT arg_min(period, v) AS low, arg_max(period, v) AS high FROM n")
def slice_extremes(s, d):
    n = p1(s, d).groupBy("period").agg(F.sum(F.col("value") ** 2).alias("v"))
    return n.agg(F.min_by("period", "v").alias("low"), F.max_by("period", "v").alias("high"))


def scaled1(s, d):
    return panel.zscore(p1(s, d), ["entity", "feature"])


@query("tucker_index")
def tucker_index(s, d):
    """(period, index): mean absolute loading of the time factors, by orthogonal iteration; at most 12 entity and 12 feature
    factors and 49 time factors."""
    a, _, u, _ = tensor.tucker_factors(scaled1(s, d), (12, 12, 49))
    return s.createDataFrame([(a.first + k, float(v)) for k, v in enumerate(np.abs(u).mean(1))], "period int, index double")


@query("cp_rank1_index")
def cp_rank1_index(s, d):
    """(period, signed, index): rank-one factorisation, iterated until the fit stands still."""
    a, weight, _, c, _ = tensor.cp_rank1(scaled1(s, d))
    return s.createDataFrame([(a.first + k, float(weight * v), float(abs(weight * v))) for k, v in enumerate(c)], "period int, signed double, index double")


def _impute(s, d, model, steps: int) -> DataFrame:
    """Masked factorisation of each whole window of all entities, its cells in long form."""
    lags = 2
    w = windows3(s, d, lags)
    names = sorted(r["feature"] for r in w.select("feature").distinct().collect())
    cells = F.array_sort(F.collect_list(F.struct("feature", "x")))
    rows = w.groupBy("win", "entity").agg(cells.alias("cells")).select("win", "entity", F.flatten(F.transform("cells", lambda c: c["x"])).alias("x"))
    out = tensor.impute(rows, model((len(names), lags)), steps, 1e-3)
    cells = out.select("win", "entity", "error", "failed", F.posexplode(F.arrays_zip("x", "observed")).alias("at", "c"))
    feature = F.array(*map(F.lit, names))[F.floor(F.col("at") / lags).cast("int")]
    return cells.select("win", "entity", feature.alias("feature"), (lags - F.col("at") % lags).alias("lag"), "c.x", "c.observed", "error", "failed")


@query("masked_tucker_impute")
def masked_tucker_impute(s, d):
    return _impute(s, d, lambda shape: tensor.MaskedTucker(shape, [2, *(min(2, n) for n in shape)]), 30)


@query("masked_cp_impute")
def masked_cp_impute(s, d):
    return _impute(s, d, lambda shape: tensor.MaskedCP(shape, 2), 20)


@query("imputed_modes")
def imputed_modes(s, d):
    """(mode, win, entity, feature, lag, x, error): imputed inputs in both modes, over their window's RMS of seen cells or in its
    scale; the error over seen cells, relative to their norm, is that of the reconstruction."""
    out = masked_tucker_impute(s, d)
    seen = windows3(s, d).select("win", F.explode("x").alias("v")).groupBy("win").agg((F.coalesce(F.sqrt(F.avg(F.col("v") * F.col("v"))), F.lit(1.0)) + 1e-8).alias("rms"))
    out = out.join(F.broadcast(seen), "win")  # a row to a period
    modes = F.explode(F.array(F.struct(F.lit("levels").alias("mode"), F.col("x").alias("v")), F.struct(F.lit("surprise").alias("mode"), (F.col("x") / F.col("rms")).alias("v"))))
    return out.select("win", "entity", "feature", "lag", "error", modes.alias("m")).select("m.mode", "win", "entity", "feature", "lag", F.col("m.v").alias("x"), "error")


# ------------------------------------------------------------ forecasts and scores

R2 = "CASE WHEN count(*) FILTER (y IS NOT NULL) >= 1 THEN 1 - sum((y - p) * (y - p)) / nullif(count(y) * var_pop(y), 0) END"


@query("naive_persistence_r2", WINDOWS + f" SELECT count(y) AS n, round({R2}, 6) AS r2 FROM (SELECT y, coalesce(x2, 0) AS p FROM windows WHERE y IS NOT NULL)")
def naive_persistence_r2(s, d):
    w = windows3(s, d).withColumn("p", F.coalesce(F.col("x")[1], F.lit(0.0)))
    return panel.r2(w, []).select("n", r6("r2"))


@query("window_mean_r2", WINDOWS + f" SELECT count(y) AS n, round({R2}, 6) AS r2 FROM (SELECT y, (coalesce(x1, 0) + coalesce(x2, 0)) / 2 AS p FROM windows WHERE y IS NOT NULL)")
def window_mean_r2(s, d):
    w = windows3(s, d).withColumn("p", (F.coalesce(F.col("x")[0], F.lit(0.0)) + F.coalesce(F.col("x")[1], F.lit(0.0))) / 2)
    return panel.r2(w, []).select("n", r6("r2"))


@query("per_feature_r2", WINDOWS + f" SELECT feature, count(y) AS n, round({R2}, 6) AS r2 FROM (SELECT feature, y, coalesce(x2, 0) AS p FROM windows WHERE y IS NOT NULL) GROUP BY 1")
def per_feature_r2(s, d):
    w = windows3(s, d).withColumn("p", F.coalesce(F.col("x")[1], F.lit(0.0)))
    return panel.r2(w, ["feature"]).select("feature", "n", r6("r2"))


@query("delta_r2", WINDOWS + f""", two AS (SELECT feature, y, coalesce(x2, 0) AS a, (coalesce(x1, 0) + coalesce(x2, 0)) / 2 AS b FROM windows WHERE y IS NOT NULL)
SELECT feature, round({R2.replace(' p)', ' b)')} - {R2.replace(' p)', ' a)')}, 6) AS delta FROM two GROUP BY 1""")
def delta_r2(s, d):
    x1, x2 = (F.coalesce(F.col("x")[k], F.lit(0.0)) for k in (0, 1))
    w = windows3(s, d).withColumn("a", x2).withColumn("b", (x1 + x2) / 2)
    a, b = panel.r2(w, ["feature"], p="a"), panel.r2(w, ["feature"], p="b").select("feature", F.col("r2").alias("other"))
    return a.join(b, "feature").select("feature", F.round(F.col("other") - F.col("r2"), SIX).alias("delta"))


@query("ar1_persistence", f"""WITH {P2}, seen AS (SELECT entity, feature, value AS y, lag(value) OVER (PARTITION BY entity, feature ORDER BY period) AS x FROM p2
  WHERE period < (SELECT min(period) + floor(0.8 * (max(period) - min(period) + 1)) FROM p2)),
rho AS (SELECT entity, feature, greatest(-1, least(1, covar_samp(y, x) / var_samp(x))) AS r FROM seen WHERE x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 7 AND var_samp(x) >= 1e-12)
SELECT feature, count(*) AS n, round(avg(r), 6) AS rho FROM rho GROUP BY 1""")
def ar1_persistence(s, d):
    """Persistence of the development periods, the first four fifths: a gap is skipped, so the lag is the last seen value."""
    rows = p2(s, d)
    end = rows.agg((F.min("period") + F.floor(0.8 * (F.max("period") - F.min("period") + 1))).alias("end"))
    x = F.lag("value").over(Window.partitionBy("entity", "feature").orderBy("period"))
    seen = rows.join(F.broadcast(end), F.col("period") < F.col("end"), "left_semi").withColumn("x", x).where("x IS NOT NULL")
    rho = seen.groupBy("entity", "feature").agg(F.count("*").alias("n"), F.covar_samp("value", "x").alias("c"), F.var_samp("x").alias("v")).where("n >= 7 AND v >= 1e-12")
    return rho.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg(scalar.clip(F.col("c") / F.col("v"), -1, 1)), SIX).alias("rho"))


@query("ridge_one_regressor", WINDOWS + " SELECT feature, round(sum(x2 * y) / (sum(x2 * x2) + 1), 6) AS beta FROM windows WHERE y IS NOT NULL AND x2 IS NOT NULL GROUP BY 1")
def ridge_one_regressor(s, d):
    w = windows3(s, d).select("feature", "y", F.col("x")[1].alias("x")).where("y IS NOT NULL AND x IS NOT NULL")
    return w.groupBy("feature").agg(F.round(F.sum(F.col("x") * F.col("y")) / (F.sum(F.col("x") ** 2) + 1), SIX).alias("beta"))


@query("ridge_loo_by_feature")
def ridge_loo_by_feature(s, d, alphas=(0.1, 1.0, 10.0, 100.0, 1000.0), lags: int = 2):
    """(feature, n, alpha, beta): the penalty by leave-one-out errors of the development windows, over all features and lags (lags
    within a feature, the oldest first).

    A first pass sums each feature's products; with their inverses a second one adds up the squares of every
    row's leave-one-out errors, for all penalties at once."""
    p = contest.load(p3(s, d).withColumn("value", scalar.log_modulus(F.col("value"))))
    try:
        w = contest.design(p, "levels", lags)
        n_dev, k, cells = int(0.8 * len(w.starts)), len(p.axes.features), p.axes.size
        (m,) = _moments(p, w, [(0, n_dev)])
        order = np.arange(k * lags).reshape(lags, k).T.ravel()
        inverse = np.stack([[np.linalg.inv(m["xx"][j] + a * np.eye(k * lags)) for a in alphas] for j in range(k)])
        beta = np.einsum("japq,jq->jap", inverse, m["xy"])

        def add(batch, total):
            out = total.reshape(k, len(alphas))
            for _, v in dense(batch, cells):
                v = v.reshape(len(v), k, -1)
                x, y = w.inputs(v)[:, :n_dev, order].reshape(-1, k * lags), w.targets(v)[:, :, :n_dev].transpose(0, 2, 1).reshape(-1, k)
                for j in range(k):
                    seen = ~np.isnan(y[:, j])
                    u, t = x[seen], y[seen, j]
                    for i in range(len(alphas)):
                        own = np.einsum("np,pq,nq->n", u, inverse[j, i], u, optimize=True)
                        out[j, i] += np.sum(((t - u @ beta[j, i]) / np.maximum(1 - own, 1e-12)) ** 2)

        errors = summed(p.rows, add, k * len(alphas)).reshape(k, -1)
    finally:
        p.drop()
    best = errors.argmin(1)
    return s.createDataFrame([(str(f), int(m["n"][j]), float(alphas[best[j]]), beta[j, best[j]].tolist()) for j, f in enumerate(p.axes.features)], "feature string, n long, alpha double, beta array<double>")


@query("ridge_by_feature")
def ridge_by_feature(s, d, alpha: float = 10.0, least: int = 25, lags: int = 2):
    """(feature, n, beta, r2): ridge of each feature on all features and lags without intercept, targets less their mean, fitted
    on the development windows, scored on the later ones; a feature with fewer than ``least`` cells has no model."""
    p = contest.load(p3(s, d).withColumn("value", scalar.log_modulus(F.col("value"))))
    try:
        w = contest.design(p, "levels", lags)
        n_dev = int(0.8 * len(w.starts))
        dev, after = _moments(p, w, [(0, n_dev), (n_dev, len(w.starts))])
    finally:
        p.drop()
    mean, out = dev["y"] / (dev["n"] + 1e-8), []
    for j, f in enumerate(p.axes.features):
        if dev["n"][j] < least:
            out.append((str(f), int(dev["n"][j]), None, None))
            continue
        beta = np.linalg.solve(dev["xx"][j] + alpha * np.eye(len(dev["xx"][j])), dev["xy"][j] - mean[j] * dev["x"][j])
        n = after["n"][j]
        spread = after["yy"][j] - after["y"][j] ** 2 / n if n else 0.0
        left = after["yy"][j] - 2 * mean[j] * after["y"][j] + mean[j] ** 2 * n - 2 * beta @ (after["xy"][j] - mean[j] * after["x"][j]) + beta @ after["xx"][j] @ beta
        out.append((str(f), int(dev["n"][j]), beta.tolist(), float(1 - left / spread) if spread > 1e-8 else None))
    return s.createDataFrame(out, "feature string, n long, beta array<double>, r2 double")


def _moments(p: contest.Panel, d: contest.Design, parts: list[tuple[int, int]]) -> list[dict]:
    """For each part (a, b) of the windows, sums over all its rows (window, entity) of X = (features, lags), missing as zero,
    and Y = (features): X'X, and by target, over its seen cells, n, the sums of y, y^2, X, X y and X'X."""
    k = len(p.axes.features)
    size = k * d.lags
    order = np.arange(size).reshape(d.lags, k).T.ravel()  # from lags x features to features x lags
    wide, cells = size * size + k * (3 + 2 * size + size * size), p.axes.size

    def add(batch, total):
        for _, v in dense(batch, cells):
            v = v.reshape(len(v), k, -1)
            inputs, targets = d.inputs(v)[:, :, order], d.targets(v).transpose(0, 2, 1)
            for out, (a, b) in zip(total.reshape(len(parts), wide), parts):
                x, y = inputs[:, a:b].reshape(-1, size), targets[:, a:b].reshape(-1, k)
                m = ~np.isnan(y)
                y = np.where(m, y, 0)
                seen = [np.concatenate([[m[:, j].sum(), y[:, j].sum(), (y[:, j] ** 2).sum()], x.T @ m[:, j], x.T @ y[:, j], (x[m[:, j]].T @ x[m[:, j]]).ravel()]) for j in range(k)]
                out += np.concatenate([(x.T @ x).ravel(), *seen])

    out = []
    for total in summed(p.rows, add, len(parts) * wide).reshape(len(parts), wide):
        by = total[size * size :].reshape(k, -1)
        out.append({"all": total[: size * size].reshape(size, size), "n": by[:, 0], "y": by[:, 1], "yy": by[:, 2], "x": by[:, 3 : 3 + size], "xy": by[:, 3 + size : 3 + 2 * size], "xx": by[:, 3 + 2 * size :].reshape(-1, size, size)})
    return out


def _left(t: dict, mean: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By target, over its seen cells: X'(y - mean - X beta) as columns, and the sum of squares of the rest."""
    right = t["xy"] - mean[:, None] * t["x"]
    gram = np.einsum("jab,bj->ja", t["xx"], beta)
    squares = t["yy"] - 2 * mean * t["y"] + mean**2 * t["n"] - 2 * np.einsum("ja,aj->j", right, beta) + np.einsum("ja,aj->j", gram, beta)
    return (right - gram).T, squares


def _cp_scores(s, d, ensemble: bool) -> DataFrame:
    """(r2, steps): one model of the whole panel, solved on the driver from sums over all rows."""
    p = contest.load(p3(s, d).withColumn("value", scalar.log_modulus(F.col("value"))))
    try:
        d2 = contest.design(p, "levels", 2)
        n_dev = int(0.8 * len(d2.starts))
        dev, after = _moments(p, d2, [(0, n_dev), (n_dev, len(d2.starts))])
    finally:
        p.drop()
    names = p.axes.features
    size = 2 * len(names)
    mean, beta = dev["y"] / (dev["n"] + 1e-8), np.zeros((size, len(names)))
    if ensemble:
        beta = np.linalg.solve(dev["all"] + 100.0 * np.eye(size), _left(dev, mean, beta)[0])
    right, squares = _left(dev, mean, beta)
    scale = np.sqrt(max(squares.sum(), 0.0) / dev["n"].sum()) if dev["n"].sum() else 1.0
    by = scale + 1e-8
    factors, objectives = models.cp_regression_sums(dev["all"], right / by, float(squares.sum()) / by**2, (len(names), 2), 3, 10.0)
    beta = beta + (0.5 if ensemble else 1.0) * scale * tensor.khatri_rao(factors[:2]) @ factors[2].T
    n = after["n"].sum()
    spread = after["yy"].sum() - after["y"].sum() ** 2 / n if n else 0.0
    r2 = float(1 - _left(after, mean, beta)[1].sum() / spread) if spread > 1e-8 else None
    return s.createDataFrame([(r2, len(objectives))], "r2 double, steps int")


query("cp_regression")(lambda s, d: _cp_scores(s, d, False))
query("ridge_cp_ensemble")(lambda s, d: _cp_scores(s, d, True))

# ------------------------------------------------------------ statistics

PAIRS = "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS a, CAST(count(*) AS DOUBLE) AS b FROM orders GROUP BY 1)"


def _pairs(s, d):
    return panels.read(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("a"), F.count("*").cast("double").alias("b"))


@query("ols_band", PAIRS + """, m AS (SELECT count(*) AS n, regr_slope(a, b) AS slope, regr_intercept(a, b) AS icept, avg(b) AS mean, var_pop(b) * count(*) AS sxx,
  sqrt((1 - regr_r2(a, b)) * var_pop(a) * count(*) / (count(*) - 2)) AS se FROM t)
SELECT b, round(icept + slope * b, 4) AS fit, round(1.959964 * se * sqrt(1 / n + (b - mean) * (b - mean) / sxx), 4) AS half FROM (SELECT DISTINCT b FROM t), m""")
def ols_band(s, d):
    t = _pairs(s, d)
    m = t.agg(F.count("*").alias("n"), F.regr_slope("a", "b").alias("slope"), F.regr_intercept("a", "b").alias("icept"), F.avg("b").alias("mean"), (F.var_pop("b") * F.count("*")).alias("sxx"), F.sqrt((1 - F.regr_r2("a", "b")) * F.var_pop("a") * F.count("*") / (F.count("*") - 2)).alias("se"))
    b = F.col("b")
    half = 1.959964 * F.col("se") * F.sqrt(1 / F.col("n") + (b - F.col("mean")) ** 2 / F.col("sxx"))
    return t.select("b").distinct().join(F.broadcast(m), F.lit(True)).select("b", F.round(F.col("icept") + F.col("slope") * b, 4).alias("fit"), F.round(half, 4).alias("half"))


def average_rank(t: DataFrame, x: str) -> DataFrame:
    """Average ranks of a column: places of its distinct values, by ranges, joined back."""
    return t.join(panel.places(t, x).select(x, (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{x}")), x)


@query("spearman_rho", PAIRS + ", r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM t) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r")
def spearman_rho(s, d):
    t = average_rank(average_rank(kept(_pairs(s, d)), "a"), "b")  # read for the ranges, the places and the join
    return t.agg(F.count("*").alias("n"), F.round(F.corr("rank_a", "rank_b"), SIX).alias("rho"))


@query("spearman_p")
def spearman_p(s, d):
    r = spearman_rho(s, d).first()
    t = r["rho"] * np.sqrt((r["n"] - 2) / max(1e-12, 1 - r["rho"] ** 2))
    return s.createDataFrame([(r["n"], r["rho"], float(models.student_p(float(t), r["n"] - 2)))], "n long, rho double, p double")


WILCOXON = PAIRS + """, z AS (SELECT a / 100000 - b AS d FROM t WHERE a / 100000 - b <> 0),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r FROM z) SELECT count(*) AS n, round(sum(CASE WHEN d > 0 THEN r ELSE 0 END), 1) AS w_plus, round(sum(CASE WHEN d < 0 THEN r ELSE 0 END), 1) AS w_minus FROM r"""


@query("wilcoxon_w", WILCOXON)
def wilcoxon_w(s, d):
    z = _pairs(s, d).select((F.col("a") / 100000 - F.col("b")).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = average_rank(kept(z), "m")
    part = lambda c: F.round(F.sum(F.when(c, F.col("rank_m")).otherwise(0.0)), 1)
    return r.agg(F.count("*").alias("n"), part(F.col("d") > 0).alias("w_plus"), part(F.col("d") < 0).alias("w_minus"))


@query("wilcoxon_p")
def wilcoxon_p(s, d):
    """Two-sided: exact for at most 50 differences without ties, else by the normal form with its correction for ties."""
    r = wilcoxon_w(s, d).first()
    n, w = r["n"], min(r["w_plus"], r["w_minus"])
    z = _pairs(s, d).select(F.abs(F.col("a") / 100000 - F.col("b")).alias("m")).where("m <> 0").groupBy("m").agg(F.count("*").alias("t"))
    ties = z.where("t > 1").agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0] or 0.0
    return s.createDataFrame([(n, float(w), models.wilcoxon_p(float(w), n, float(ties)))], "n long, w double, p double")


SERIES = f"WITH {P3}, a AS (SELECT period, sum(value) AS v FROM p3 WHERE feature = (SELECT min(feature) FROM p3) GROUP BY 1), b AS (SELECT period, sum(value) AS v FROM p3 WHERE feature = (SELECT max(feature) FROM p3) GROUP BY 1)"


@query("cross_correlation", SERIES + " SELECT CAST(k AS INTEGER) AS lag, round(corr(a.v, b.v), 6) AS r FROM a JOIN (SELECT unnest(range(-10, 11)) AS k) ON true JOIN b ON b.period = a.period + k GROUP BY 1")
def cross_correlation(s, d):
    rows = p3(s, d)
    ends = rows.agg(F.min("feature").alias("lo"), F.max("feature").alias("hi"))
    total = rows.join(F.broadcast(ends), F.lit(True)).groupBy("period").agg(F.sum(F.when(F.col("feature") == F.col("lo"), F.col("value"))).alias("a"), F.sum(F.when(F.col("feature") == F.col("hi"), F.col("value"))).alias("b"))
    shifted = total.where("a IS NOT NULL").select("a", "period", F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("lag")).withColumn("period", F.col("period") + F.col("lag"))
    return shifted.join(total.where("b IS NOT NULL").select("period", "b"), "period").groupBy("lag").agg(F.round(F.corr("a", "b"), SIX).alias("r"))


BINS = PAIRS + """, e AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM t),
c AS (SELECT least(5, CAST(floor(6 * (a - la) / (ha - la)) AS INTEGER)) AS i, least(5, CAST(floor(6 * (b - lb) / (hb - lb)) AS INTEGER)) AS j FROM t, e),
n AS (SELECT i, j, count(*) / (SELECT count(*) FROM c) AS p FROM c GROUP BY 1, 2), pi AS (SELECT i, sum(p) AS p FROM n GROUP BY 1), pj AS (SELECT j, sum(p) AS p FROM n GROUP BY 1)"""


def _bins(s, d) -> DataFrame:
    """(p, pi, pj) for every pair of bins that both occur, empty cells included; at most 6 x 6 rows."""
    t = _pairs(s, d)
    e = t.agg(F.min("a").alias("la"), F.max("a").alias("ha"), F.min("b").alias("lb"), F.max("b").alias("hb"))
    bin_of = lambda x, lo, hi: F.least(F.lit(5), F.floor(6 * (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).cast("int"))
    n = t.join(F.broadcast(e), F.lit(True)).groupBy(bin_of("a", "la", "ha").alias("i"), bin_of("b", "lb", "hb").alias("j")).count()
    total = n.agg(F.sum("count").alias("all"))
    n = n.join(F.broadcast(total), F.lit(True)).select("i", "j", (F.col("count") / F.col("all")).alias("p"))
    pi, pj = n.groupBy("i").agg(F.sum("p").alias("pi")), n.groupBy("j").agg(F.sum("p").alias("pj"))
    cells = pi.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5)))).join(pj, "j")
    return cells.join(n, ["i", "j"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))


@query("l1_independence", BINS + " SELECT round(sum(abs(coalesce(n.p, 0) - pi.p * pj.p)), 6) AS l1 FROM pi CROSS JOIN pj LEFT JOIN n ON n.i = pi.i AND n.j = pj.j")
def l1_independence(s, d):
    return _bins(s, d).agg(F.round(F.sum(F.abs(F.col("p") - F.col("pi") * F.col("pj"))), SIX).alias("l1"))


@query("loglik_independence", BINS + " SELECT round(sum(n.p * ln(n.p / (pi.p * pj.p))), 6) AS kl FROM n JOIN pi ON n.i = pi.i JOIN pj ON n.j = pj.j")
def loglik_independence(s, d):
    return _bins(s, d).where("p > 0").agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pi") * F.col("pj")))), SIX).alias("kl"))


@query("independence_null")
def independence_null(s, d, draws: int = 200, level: float = 0.95):
    """(statistic, value, quantile, share): both statistics, their quantile over random pairings, and the share of pairings
    that reach them.

    One pass counts the pairs of bins. A random pairing of all rows has the same bins on either side, so its table is a draw
    from the multivariate hypergeometric distribution with these margins, and no row has to be shuffled; tasks draw the
    tables, each by the seed of its number."""
    t = _pairs(s, d)
    e = t.agg(F.min("a").alias("la"), F.max("a").alias("ha"), F.min("b").alias("lb"), F.max("b").alias("hb"))
    bin_of = lambda x, lo, hi: F.least(F.lit(5), F.floor(6 * (F.col(x) - F.col(lo)) / (F.col(hi) - F.col(lo))).cast("int"))
    rows = t.join(F.broadcast(e), F.lit(True)).select("k", bin_of("a", "la", "ha").alias("i"), bin_of("b", "lb", "hb").alias("j"))
    found = np.zeros((6, 6))
    for r in rows.groupBy("i", "j").count().collect():  # bins x bins
        found[r["i"], r["j"]] = r["count"]
    n, by_i, by_j = int(found.sum()), found.sum(1), found.sum(0)

    def statistics(p):
        p = p / n
        free = np.outer(p.sum(1), p.sum(0))
        return float(np.abs(p - free).sum()), float(np.sum(p[p > 0] * np.log(p[p > 0] / free[p > 0])))

    def drawn(batches):
        for b in batches:
            out = [(int(x), *statistics(_pairing(np.random.default_rng([42, int(x)]), by_i, by_j))) for x in b["id"]]
            yield pd.DataFrame(out, columns=["draw", "l1", "kl"])

    null = s.range(0, draws, 1, 8).mapInPandas(drawn, "draw long, l1 double, kl double").toPandas()  # a row to a draw
    values = dict(zip(("l1", "kl"), statistics(found)))
    out = [(k, v, float(np.quantile(null[k], level)), float((null[k] >= v).mean())) for k, v in values.items()]
    return s.createDataFrame(out, "statistic string, value double, quantile double, share double")


def _pairing(rng: np.random.Generator, by_i: np.ndarray, by_j: np.ndarray) -> np.ndarray:
    """The table of bins of a random pairing with these margins: rows are dealt one bin after the other, without replacement,
    which is the distribution that shuffling all rows gives."""
    left, out = by_j.astype(np.int64).copy(), np.zeros((len(by_i), len(by_j)))
    for i, m in enumerate(by_i.astype(np.int64)):
        got = rng.multivariate_hypergeometric(left, int(m), method="marginals")
        out[i] = got
        left -= got
    return out


MI = """WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM c), a AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), b AS (SELECT b, sum(n) AS n FROM c GROUP BY 1)"""


@query("contingency", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2")
def contingency(s, d):
    return panels.read(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("mutual_information", MI + " SELECT round(sum(c.n / t * ln(c.n * t / (a.n * b.n))), 6) AS mi FROM c, t, a, b WHERE c.a = a.a AND c.b = b.b")
def mutual_information(s, d):
    c = contingency(s, d)
    a, b = c.groupBy("c_mktsegment").agg(F.sum("n").alias("na")), c.groupBy("c_nationkey").agg(F.sum("n").alias("nb"))
    t = F.broadcast(c.agg(F.sum("n").alias("t")))
    return c.join(a, "c_mktsegment").join(b, "c_nationkey").join(t, F.lit(True)).agg(F.round(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))), SIX).alias("mi"))


# ------------------------------------------------------------ clustering and search

NATIONS = "v AS (SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS x, stddev_pop(c_acctbal) / 1000 AS y FROM customer GROUP BY 1)"


def _nations(s, d):
    x = F.col("c_acctbal")
    return panels.read(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.avg(x) / 1000).alias("x"), (F.stddev_pop(x) / 1000).alias("y"))


@query("similarity_matrix", f"WITH {NATIONS} SELECT a.k AS i, b.k AS j, round(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS sim FROM v a JOIN v b ON a.k < b.k")
def similarity_matrix(s, d):
    """Over group means: one row to a nation, so the pairs are bounded by the taxonomy."""
    v = _nations(s, d)
    b = v.select(F.col("k").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return v.join(b, F.col("k") < F.col("j")).select(F.col("k").alias("i"), "j", F.round(-((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2), SIX).alias("sim"))


def _places(s, d) -> DataFrame:
    """(entity, region) of suppliers."""
    return panels.read(s, d, "supplier").join(panels.read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("entity"), F.col("n_regionkey").alias("region"))


def _profiles(s, d) -> DataFrame:
    """(id, x, region): suppliers with the scaled means and spreads of their panel's features, and their region."""
    # added up in the order of the periods, so that equal panels have equal profiles to the last bit
    v = p1(s, d).groupBy("entity", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("period", "value"))), lambda c: c["value"]).alias("v"))
    m = v.withColumn("m", F.aggregate("v", F.lit(0.0), lambda t, x: t + x) / F.size("v"))
    stats = m.select("entity", "feature", "m", F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + (x - F.col("m")) * (x - F.col("m"))) / F.size("v")).alias("sd"))
    cells = stats.select("entity", "feature", F.explode(F.array(F.struct(F.lit("m").alias("kind"), F.col("m").alias("v")), F.struct(F.lit("sd").alias("kind"), F.col("sd").alias("v")))).alias("c")).select("entity", "feature", "c.*")
    scale = F.broadcast(cells.groupBy("feature", "kind").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("spread")))  # two rows to a feature
    z = cells.join(scale, ["feature", "kind"]).withColumn("z", F.when(F.col("spread") > 0, (F.col("v") - F.col("mean")) / F.col("spread")).otherwise(0.0))
    x = z.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "kind", "z"))), lambda c: c["z"]).alias("x"))
    return x.join(_places(s, d), "entity", "left").select(F.col("entity").cast("long").alias("id"), "x", "region")


@query("affinity_clusters")
def affinity_clusters(s, d):
    """(id, cluster) of all suppliers, by their profiles."""
    return affinity.clusters(_profiles(s, d).select("id", "x"))


@query("ami_score")
def ami_score(s, d):
    """(clusters, ami): how the suppliers' clusters go with their regions."""
    places = _places(s, d).select(F.col("entity").cast("long").alias("id"), "region")
    t = affinity_clusters(s, d).where("id IS NOT NULL").join(places, "id", "left").persist()
    try:
        found = t.agg(F.count_distinct("cluster")).first()[0]
        table = t.where("region IS NOT NULL").groupBy("cluster", "region").count().collect()  # clusters x regions
    finally:
        t.unpersist()
    rows, columns = ({v: k for k, v in enumerate(sorted({r[c] for r in table}))} for c in ("cluster", "region"))
    counts = np.zeros((len(rows), len(columns)))
    for r in table:
        counts[rows[r["cluster"]], columns[r["region"]]] = r["count"]
    return s.createDataFrame([(found, models.table_information(counts))], "clusters long, ami double")


@query("best_match")
def best_match(s, d):
    """The taxonomy level whose number of groups is the nearest to the number of the suppliers' clusters."""
    clusters = affinity_clusters(s, d).agg(F.count_distinct("cluster")).first()[0]
    n = lambda t, c, name: panels.read(s, d, t).agg(F.count_distinct(c).alias("groups")).select(F.lit(name).alias("level"), "groups")
    t = n("nation", "n_regionkey", "region").unionByName(n("nation", "n_nationkey", "nation")).unionByName(n("customer", "c_mktsegment", "segment")).unionByName(n("part", "p_type", "type"))
    return t.withColumn("clusters", F.lit(clusters)).withColumn("gap", F.abs(F.col("groups") - clusters)).orderBy("gap", "level").limit(1)


@query("ensemble_mean", WINDOWS + ", m AS (SELECT entity, feature, win, x2 AS p FROM windows UNION ALL SELECT entity, feature, win, (x1 + x2) / 2 FROM windows) SELECT entity, feature, win, round(avg(p), 6) AS p FROM m GROUP BY 1, 2, 3")
def ensemble_mean(s, d):
    w = windows3(s, d).select("entity", "feature", F.col("win").cast("int").alias("win"), "x")
    both = w.withColumn("p", F.col("x")[1]).unionByName(w.withColumn("p", (F.col("x")[0] + F.col("x")[1]) / 2))
    return both.groupBy("entity", "feature", "win").agg(F.round(F.avg("p"), SIX).alias("p"))


#: The windows and seen targets that a lookback of 2 or 4 leaves.
SIZES = f"""WITH {P3}, w AS (SELECT DISTINCT k, period FROM p3, (VALUES (2), (4)) v(k) WHERE period - (SELECT min(period) FROM p3) >= k AND period < (SELECT max(period) FROM p3)),
sizes AS (SELECT CAST(k AS INTEGER) AS lookback, count(DISTINCT w.period) AS windows, count(*) AS seen FROM w JOIN p3 USING (period) GROUP BY 1)"""


def _sizes(s, d) -> DataFrame:
    """(lookback, windows, seen): what each lookback leaves of the third panel."""
    long = p3(s, d)
    ends = long.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    rows = long.join(F.broadcast(ends), F.col("period") < F.col("hi")).select("period", "lo", F.explode(F.array(F.lit(2), F.lit(4))).alias("lookback")).where("period - lo >= lookback")
    return rows.groupBy("lookback").agg(F.count_distinct("period").alias("windows"), F.count("*").alias("seen"))


@query("parameter_grid", SIZES + " SELECT CAST(rank AS INTEGER) AS rank, CAST(penalty AS INTEGER) AS penalty, lookback, windows, seen FROM (VALUES (5), (10), (15)) a(rank), (VALUES (1), (10), (50), (100)) b(penalty), sizes")
def parameter_grid(s, d):
    """Every combination of rank, penalty and lookback, with the windows and seen targets that it has."""
    out = _sizes(s, d)
    for name, values in {"rank": [5, 10, 15], "penalty": [1, 10, 50, 100]}.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.select("rank", "penalty", "lookback", "windows", "seen")


@query("random_trials")
def random_trials(s, d, trials: int = 200):
    """Seeded random search: category, integer and log-uniform draws by trial number, with the windows and seen targets that
    each trial has."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 << 30)) / (1 << 30)
    drawn = s.range(0, trials, 1, 4).select(F.col("id").alias("trial"), F.when(u(1) < 0.5, 2).otherwise(4).alias("lookback"), (5 + F.floor(u(2) * 46)).cast("int").alias("rank"), F.pow(F.lit(10.0), u(3) * 6 - 4).alias("penalty"))
    return drawn.join(F.broadcast(_sizes(s, d)), "lookback")  # a row to a lookback


@query("granger_tests")
def granger_tests(s, d, lags: int = 2):
    """(cause, effect, n, f, p): whether a feature's last values tell more of another one than that one's own do.

    Over all entities and windows in which both and their lags are seen: the regression of the effect on its own lags, and on
    those of both, each with an intercept; one pass adds up the products of all pairs."""
    p = contest.load(p3(s, d).withColumn("value", scalar.log_modulus(F.col("value"))))
    try:
        w = contest.design(p, "levels", lags)
        k, size, width = len(p.axes.features), p.axes.size, 2 * lags + 2

        def add(batch, total):
            out = total.reshape(k, k, width, width)
            for _, v in dense(batch, size):
                v = v.reshape(len(v), k, -1)
                past = np.stack([v[:, :, w.starts + i] for i in range(lags)], 3).transpose(1, 0, 2, 3)  # features, entities, windows, lags
                now = w.targets(v).transpose(1, 0, 2)
                for i, j in np.ndindex(k, k):
                    if i != j:
                        rows = np.concatenate([np.ones((*now[j].shape, 1)), past[j], past[i], now[j][..., None]], 2).reshape(-1, width)
                        rows = rows[~np.isnan(rows).any(1)]
                        out[i, j] += rows.T @ rows

        sums = summed(p.rows, add, k * k * width * width).reshape(k, k, width, width)
    finally:
        p.drop()
    out = []
    for i, j in np.ndindex(k, k):
        if i == j:
            continue
        m, n = sums[i, j], int(sums[i, j, 0, 0])

        def left(size, m=m):
            """The sum of squares that the first columns leave."""
            return float(m[-1, -1] - m[-1, :size] @ np.linalg.lstsq(m[:size, :size], m[:size, -1], rcond=None)[0])

        below = n - width + 1
        f = (left(lags + 1) - left(width - 1)) / lags / (left(width - 1) / below) if below > 0 and left(width - 1) > 1e-12 else None
        out.append((str(p.axes.features[i]), str(p.axes.features[j]), n, f, None if f is None else models.fisher_p(f, lags, below)))
    return s.createDataFrame(out, "cause string, effect string, n long, f double, p double")


@query("feature_difference", "SELECT DISTINCT event_type AS feature FROM events EXCEPT SELECT DISTINCT event_type FROM events WHERE value > 1e12 OR event_type LIKE 'c%'")
def feature_difference(s, d):
    """The features that no row takes out; one pass with a flag by feature, as a difference would join all rows with all."""
    e = panels.read(s, d, "events").select(F.col("event_type").alias("feature"), "value")
    out = F.coalesce(F.expr("value > 1e12 OR feature LIKE 'c%'"), F.lit(False))
    return e.groupBy("feature").agg(F.max(out).alias("out")).where("NOT out").select("feature")
