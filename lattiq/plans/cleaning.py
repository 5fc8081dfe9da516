"""Named queries for cleaning, reports, folds and trials, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import scalar
from lattiq.operators import panel
from lattiq.plans import results
from lattiq.plans.queries import HOLD, P1, P2, P3, SIX, WINDOWS, entity_index, grid, holdout, p1, p2, p3, query, r6, train_means, windows3
from lattiq.sources import panels

# ------------------------------------------------------------ filters on what is missing


@query("missing_limit_entities", f"""WITH {P3}, {grid('p3')}, f AS (SELECT entity, feature, 1 - count(value) / count(*) AS rate FROM dense GROUP BY 1, 2)
SELECT entity, round(avg(rate), 6) AS overall, round(max(rate), 6) AS worst FROM f GROUP BY 1 HAVING avg(rate) <= 0.65 AND max(rate) <= 0.8""")
def missing_limit_entities(s, d, overall: float = 0.65, each: float = 0.8):
    """Entities that miss at most a share of all their cells, and of each feature's; from counts, without the grid."""
    long = p3(s, d)
    axes = long.agg(F.count_distinct("feature").alias("n_f"), (F.max("period") - F.min("period") + 1).alias("n_p"))
    seen = long.groupBy("entity", "feature").agg(F.count("value").alias("n"))
    per = seen.groupBy("entity").agg(F.sum("n").alias("all"), F.min("n").alias("least"), F.count("*").alias("kinds")).join(F.broadcast(axes), F.lit(True))
    least = F.when(F.col("kinds") < F.col("n_f"), 0).otherwise(F.col("least"))
    rates = per.select("entity", (1 - F.col("all") / (F.col("n_f") * F.col("n_p"))).alias("overall"), (1 - least / F.col("n_p")).alias("worst"))
    return rates.where((F.col("overall") <= overall) & (F.col("worst") <= each)).select("entity", r6("overall"), r6("worst"))


@query("missing_rate_filter", f"""WITH {P2}, {grid('p2')}, keep AS (SELECT entity FROM dense GROUP BY 1 HAVING 1 - count(value) / count(*) < 0.7)
SELECT entity, feature, period, round(value, 2) AS value FROM p2 WHERE entity IN (SELECT entity FROM keep)""")
def missing_rate_filter(s, d, rate: float = 0.7):
    """The cells of entities that miss less than ``rate`` of theirs."""
    long = p2(s, d)
    keep = panel.missing_share(long, True).where(F.col("rate") < rate).select("entity")
    return long.join(keep, "entity", "left_semi").select("entity", "feature", "period", F.round("value", 2).alias("value"))


@query("drop_columns", "SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer")
def drop_columns(s, d):
    return panels.read(s, d, "customer").drop("c_name", "c_mktsegment")


@query("drop_null_subset", WINDOWS + " SELECT entity, feature, win, round(x2, 6) AS x2, round(y, 6) AS y FROM windows WHERE x2 IS NOT NULL AND y IS NOT NULL")
def drop_null_subset(s, d):
    w = windows3(s, d).select("entity", "feature", F.col("win").cast("int").alias("win"), F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"), "y")
    return w.na.drop(subset=["x2", "y"]).select("entity", "feature", "win", r6("x2"), r6("y"))


@query("rows_with_target", WINDOWS + " SELECT entity, win, count(y) AS seen FROM windows GROUP BY 1, 2 HAVING count(y) >= 1")
def rows_with_target(s, d):
    return windows3(s, d).groupBy("entity", F.col("win").cast("int").alias("win")).agg(F.count("y").alias("seen")).where("seen >= 1")


@query("parse_dates", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day FROM orders")
def parse_dates(s, d):
    """Dates from text; what is none becomes NULL (``scalar.strict_date`` raises instead)."""
    o = panels.read(s, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("n/a "), F.col("o_orderkey").cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", scalar.lenient_date(text).alias("day"))


@query("flag_coercion", "SELECT c_custkey, lower(trim(t)) NOT IN ('false', '0', 'no', 'none', '') AS flag FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' False' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0' WHEN 3 THEN '1 ' WHEN 4 THEN '' ELSE c_mktsegment END AS t FROM customer)")
def flag_coercion(s, d):
    k = F.col("c_custkey") % 6
    t = F.when(k == 0, " False").when(k == 1, "TRUE").when(k == 2, "0").when(k == 3, "1 ").when(k == 4, "").otherwise(F.col("c_mktsegment"))
    return panels.read(s, d, "customer").select("c_custkey", scalar.flag(t).alias("flag"))


@query("feature_names", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_brand END, 'feat_' || p_partkey) AS name FROM part")
def feature_names(s, d):
    given = F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))
    return panels.read(s, d, "part").select("p_partkey", scalar.name_or_number(given, F.col("p_partkey")).alias("name"))


@query("sorted_rows", "SELECT n_regionkey, n_name, n_nationkey FROM nation ORDER BY 1, 2 DESC")
def sorted_rows(s, d):
    return panels.read(s, d, "nation").select("n_regionkey", "n_name", "n_nationkey").orderBy("n_regionkey", F.desc("n_name"))


@query("observation_mask", f"WITH {P3}, {grid('p3')} SELECT entity, feature, period, value IS NOT NULL AS observed FROM dense")
def observation_mask(s, d):
    return panel.densify(p3(s, d)).select("entity", "feature", "period", F.col("value").isNotNull().alias("observed"))


@query("indexed_cells", f"WITH {P1}, i AS (SELECT entity, CAST(row_number() OVER (ORDER BY CAST(entity AS VARCHAR)) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT entity FROM p1)) SELECT idx, feature, period, value FROM p1 JOIN i USING (entity)")
def indexed_cells(s, d):
    return p1(s, d).join(entity_index(s, d), "entity").select("idx", "feature", "period", "value")


# ------------------------------------------------------------ density reports

SUMMARY = ", ".join(f"round(avg(x) FILTER (k = '{k}'), 6) AS {k}_mean, round(median(x) FILTER (k = '{k}'), 6) AS {k}_median, round(min(x) FILTER (k = '{k}'), 6) AS {k}_min, round(max(x) FILTER (k = '{k}'), 6) AS {k}_max, count(*) FILTER (k = '{k}' AND x = 0) AS {k}_empty" for k in ("entity", "feature", "period"))


@query("sparsity_summary", f"""WITH {P3}, {grid('p3')}, x AS (SELECT CASE WHEN entity IS NOT NULL THEN 'entity' WHEN feature IS NOT NULL THEN 'feature' WHEN period IS NOT NULL THEN 'period' ELSE 'all' END AS k,
  count(value) / (count(*) + 1e-12) AS x, count(value) AS seen, count(*) AS cells FROM dense GROUP BY GROUPING SETS ((entity), (feature), (period), ()))
SELECT max(seen) FILTER (k = 'all') AS seen, max(cells) FILTER (k = 'all') AS cells, round(max(x) FILTER (k = 'all'), 6) AS density, {SUMMARY} FROM x""")
def sparsity_summary(s, d):
    """One row: density of the grid, and mean, median, extremes and empty ones by entity, feature and period.

    Counts come from the cells, not from the grid; a median is found among the distinct counts, which are bounded by
    the cells that one key can have."""
    long = p3(s, d)
    axes = long.agg(F.count_distinct("entity").alias("entity"), F.count_distinct("feature").alias("feature"), (F.max("period") - F.min("period") + 1).alias("period"), F.count("value").alias("seen"))
    out = axes.select("seen", (F.col("entity") * F.col("feature") * F.col("period")).alias("cells"))
    out = out.select("seen", "cells", F.round(F.col("seen") / (F.col("cells") + 1e-12), SIX).alias("density"))
    for k, others in (("entity", ("feature", "period")), ("feature", ("entity", "period")), ("period", ("entity", "feature"))):
        counts = long.groupBy(k).agg(F.count("value").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))
        own = axes.select(F.col(k).alias("total"), (F.col(others[0]) * F.col(others[1])).alias("each"))
        table = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct("n", "keys"))).alias("t"), F.sum("keys").alias("present")).join(F.broadcast(own), F.lit(True))
        empty = F.col("total") - F.col("present")
        table = table.withColumn("t", F.when(empty > 0, F.concat(F.array(F.struct(F.lit(0).cast("long").alias("n"), empty.cast("long").alias("keys"))), "t")).otherwise(F.col("t")))

        def at(place):
            """The count at a place (from 0) of all keys in order."""
            step = F.aggregate("t", F.struct(F.lit(0).cast("long").alias("before"), F.lit(-1).cast("long").alias("n")), lambda acc, x: F.struct((acc["before"] + x["keys"]).alias("before"), F.when((acc["n"] < 0) & (acc["before"] + x["keys"] > place), x["n"]).otherwise(acc["n"]).alias("n")))
            return step["n"]

        share = lambda x: F.round(x / (F.col("each") + 1e-12), SIX)
        total = F.aggregate("t", F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * x["keys"])
        middle = (at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2
        row = table.select(share(total / F.col("total")).alias(f"{k}_mean"), share(middle).alias(f"{k}_median"), share(F.col("t")[0]["n"]).alias(f"{k}_min"), share(F.element_at("t", -1)["n"]).alias(f"{k}_max"), F.greatest(empty, F.lit(0)).cast("long").alias(f"{k}_empty"))
        out = out.join(F.broadcast(row), F.lit(True))
    return out


@query("density_summary", f"""WITH {P3}, {grid('p3')}, e AS (SELECT entity, count(value) / count(*) AS x FROM dense GROUP BY 1)
SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS mid, round(min(x), 6) AS low, round(max(x), 6) AS high, count(*) FILTER (x = 0) AS empty FROM e""")
def density_summary(s, d):
    """The entities' part of the summary."""
    names = {"mean": "mean", "median": "mid", "min": "low", "max": "high", "empty": "empty"}
    return sparsity_summary(s, d).select(*[F.col(f"entity_{k}").alias(v) for k, v in names.items()])


@query("top_bottom_features", f"""WITH {P3}, n AS (SELECT feature, count(value) AS n FROM p3 GROUP BY 1),
r AS (SELECT feature, n, row_number() OVER (ORDER BY n DESC, feature) AS top, row_number() OVER (ORDER BY n, feature) AS bottom FROM n)
SELECT 'top' AS side, feature, n FROM r WHERE top <= 3 UNION ALL SELECT 'bottom', feature, n FROM r WHERE bottom <= 3""")
def top_bottom_features(s, d, k: int = 3):
    n = p3(s, d).groupBy("feature").agg(F.count("value").alias("n"))
    side = lambda name, *order: n.orderBy(*order).limit(k).select(F.lit(name).alias("side"), "feature", "n")
    return side("top", F.desc("n"), "feature").unionByName(side("bottom", "n", "feature"))


@query("top_bottom_periods", f"""WITH {P1}, n AS (SELECT period, sqrt(sum(value * value)) AS norm FROM p1 GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY norm DESC, period) AS top, row_number() OVER (ORDER BY norm, period) AS bottom FROM n)
SELECT 'top' AS side, period, round(norm, 3) AS norm FROM r WHERE top <= 5 UNION ALL SELECT 'bottom', period, round(norm, 3) FROM r WHERE bottom <= 5""")
def top_bottom_periods(s, d, k: int = 5):
    n = p1(s, d).groupBy("period").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("norm"))
    side = lambda name, *order: n.orderBy(*order).limit(k).select(F.lit(name).alias("side"), "period", F.round("norm", 3).alias("norm"))
    return side("top", F.desc("norm"), "period").unionByName(side("bottom", "norm", "period"))


# ------------------------------------------------------------ means, thresholds, scaling


@query("firm_means", WINDOWS + HOLD + """, g AS (SELECT avg(y) AS g FROM windows, h WHERE win < n)
SELECT entity, round(CASE WHEN count(y) FILTER (win < n) > 0 THEN sum(y) FILTER (win < n) / (count(y) FILTER (win < n) + 1e-12) ELSE any_value(g) END, 6) AS mean FROM windows, h, g GROUP BY 1""")
def firm_means(s, d):
    """Means of an entity's development cells; one never seen there gets the mean of all."""
    w = holdout(windows3(s, d))
    y = F.when(F.col("dev"), F.col("y"))
    sums = w.groupBy("entity").agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    every = sums.agg((F.sum("s") / F.sum("n")).alias("g"))
    return sums.join(F.broadcast(every), F.lit(True)).select("entity", F.round(F.when(F.col("n") > 0, F.col("s") / (F.col("n") + 1e-12)).otherwise(F.col("g")), SIX).alias("mean"))


@query("coordinate_means", WINDOWS + " SELECT feature, CAST(l AS INTEGER) AS lag, round(avg(coalesce(CASE l WHEN 2 THEN x1 ELSE x2 END, 0)), 6) AS mean FROM windows, (VALUES (1), (2)) v(l) GROUP BY 1, 2")
def coordinate_means(s, d):
    """Plain means of the inputs at each coordinate (feature, lag), missing as zero."""
    cells = windows3(s, d).select("feature", F.posexplode("x").alias("at", "v"))
    return cells.groupBy("feature", (2 - F.col("at")).alias("lag")).agg(F.round(F.avg(F.coalesce("v", F.lit(0.0))), SIX).alias("mean"))


@query("residual_rms", WINDOWS + HOLD + """, m AS (SELECT feature, sum(y) / (count(y) + 1e-8) AS m FROM windows, h WHERE win < n GROUP BY 1)
SELECT feature, count(y) AS n, round(CASE WHEN count(y) >= 100 THEN sqrt(avg((y - m) * (y - m))) + 1e-8 END, 6) AS rms FROM windows JOIN m USING (feature), h WHERE win < n GROUP BY 1""")
def residual_rms(s, d, least: int = 100):
    """RMS of the development cells after taking off their feature's mean; NULL with fewer than ``least`` of them."""
    sums = holdout(windows3(s, d)).where("dev").groupBy("feature").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("v"))
    m = F.col("mean") * F.col("n") / (F.col("n") + 1e-8)
    rms = F.sqrt(F.col("v") + (F.col("mean") - m) ** 2) + 1e-8
    return sums.select("feature", "n", F.round(F.when(F.col("n") >= least, rms), SIX).alias("rms"))


@query("adaptive_thresholds", f"""WITH {P3}, {grid('p3')}, a AS (SELECT count(DISTINCT entity) AS e, count(DISTINCT period) AS t, count(*) AS cells FROM dense)
SELECT feature, CAST(greatest(100, least(5000, CAST(trunc(0.05 * any_value(cells)) AS INTEGER))) AS INTEGER) AS pooled,
  CAST(greatest(10, least(200, CAST(trunc(round(0.05 * any_value(e) * any_value(t) * (count(value) / count(*)), 9)) AS INTEGER))) AS INTEGER) AS own FROM dense, a GROUP BY 1""")
def adaptive_thresholds(s, d):
    """The least numbers of cells for a pooled score and for each feature's own one."""
    long = p3(s, d)
    axes = long.agg(F.count_distinct("entity").alias("e"), F.count_distinct("feature").alias("f"), (F.max("period") - F.min("period") + 1).alias("t"))
    n = long.groupBy("feature").agg(F.count("value").alias("n")).join(F.broadcast(axes), F.lit(True))
    grid_size, density = F.col("e") * F.col("t"), F.col("n") / (F.col("e") * F.col("t"))
    return n.select("feature", scalar.adaptive_threshold(grid_size * F.col("f")).alias("pooled"), scalar.feature_threshold(F.col("e"), F.col("t"), density).alias("own"))


@query("surprise_windows", WINDOWS + """, c AS (SELECT win, x1 AS x FROM windows UNION ALL SELECT win, x2 FROM windows), r AS (SELECT win, coalesce(sqrt(avg(x * x)), 1.0) + 1e-8 AS rms FROM c GROUP BY 1)
SELECT entity, feature, win, round(x1 / rms, 6) AS x1, round(x2 / rms, 6) AS x2, round(y, 6) AS y FROM windows JOIN r USING (win)""")
def surprise_windows(s, d):
    """Inputs over the window's RMS of seen cells; the target keeps its scale. (The other mode keeps the inputs' scale.)"""
    w = windows3(s, d)
    cells = w.select("win", F.explode("x").alias("v"))
    rms = cells.groupBy("win").agg((F.coalesce(F.sqrt(F.avg(F.col("v") * F.col("v"))), F.lit(1.0)) + 1e-8).alias("rms"))
    w = w.join(F.broadcast(rms), "win")  # a row to a period
    return w.select("entity", "feature", F.col("win").cast("int").alias("win"), *[F.round(F.col("x")[k] / F.col("rms"), SIX).alias(f"x{k + 1}") for k in (0, 1)], r6("y"))


@query("ridge_design", WINDOWS + """, f AS (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT feature FROM windows))
SELECT entity, win, CAST((2 - l) * k + i AS INTEGER) AS col, round(coalesce(CASE l WHEN 2 THEN x1 ELSE x2 END, 0), 6) AS x FROM windows JOIN f USING (feature), (VALUES (1), (2)) v(l)""")
def ridge_design(s, d):
    """The design of a ridge over all features and lags as coordinates: columns run over features within a lag, the
    oldest lag first."""
    w = windows3(s, d)
    names = F.broadcast(w.agg(F.array_sort(F.collect_set("feature")).alias("names")))  # the list of features
    cells = w.join(names, F.lit(True)).select("entity", F.col("win").cast("int").alias("win"), (F.array_position("names", F.col("feature")) - 1).alias("i"), F.size("names").alias("k"), F.posexplode("x").alias("at", "v"))
    return cells.select("entity", "win", (F.col("at") * F.col("k") + F.col("i")).cast("int").alias("col"), F.round(F.coalesce("v", F.lit(0.0)), SIX).alias("x"))


@query("validation_centred", WINDOWS + HOLD + """, f AS (SELECT feature, sum(y) FILTER (win < n) / (count(y) FILTER (win < n) + 1e-8) AS fallback FROM windows, h GROUP BY 1),
m AS (SELECT entity, feature, coalesce(avg(y) FILTER (win < n), any_value(fallback)) AS mean FROM windows JOIN f USING (feature), h GROUP BY 1, 2)
SELECT entity, feature, win, round(y - mean, 6) AS y FROM windows JOIN m USING (entity, feature), h WHERE win >= n""")
def validation_centred(s, d):
    """Held-out targets less the means that the development windows gave."""
    w = holdout(windows3(s, d))
    means = train_means(w)
    return w.where("not dev").join(means, ["entity", "feature"]).select("entity", "feature", F.col("win").cast("int").alias("win"), F.round(F.col("y") - F.col("mean"), SIX).alias("y"))


@query("train_valid_split", WINDOWS + """ , h AS (SELECT floor(0.7 * floor(0.8 * count(DISTINCT win))) AS a, floor(0.8 * count(DISTINCT win)) AS b FROM windows)
SELECT CASE WHEN win < a THEN 'train' WHEN win < b THEN 'valid' ELSE 'test' END AS part, count(DISTINCT win) AS windows, count(y) AS seen FROM windows, h GROUP BY 1""")
def train_valid_split(s, d):
    """Seven tenths of the development windows train, the rest of them validate."""
    w = windows3(s, d)
    n = w.agg(F.floor(F.count_distinct("win") * 0.8).alias("b")).withColumn("a", F.floor(F.col("b") * 0.7))
    part = F.when(F.col("win") < F.col("a"), "train").when(F.col("win") < F.col("b"), "valid").otherwise("test")
    return w.join(F.broadcast(n), F.lit(True)).groupBy(part.alias("part")).agg(F.count_distinct("win").alias("windows"), F.count("y").alias("seen"))


# ------------------------------------------------------------ scores


@query("relative_error", WINDOWS + " SELECT round(sqrt(sum((y - p) * (y - p))) / (sqrt(sum(y * y)) + 1e-8), 6) AS error FROM (SELECT y, coalesce(x2, 0) AS p FROM windows WHERE y IS NOT NULL)")
def relative_error(s, d):
    """Error of persistence over seen cells, relative to their norm."""
    w = windows3(s, d).where("observed").select("y", F.coalesce(F.col("x")[1], F.lit(0.0)).alias("p"))
    return w.agg(F.round(F.sqrt(F.sum((F.col("y") - F.col("p")) ** 2)) / (F.sqrt(F.sum(F.col("y") ** 2)) + 1e-8), SIX).alias("error"))


@query("r2_variants", WINDOWS + """, s AS (SELECT entity, count(*) AS n, sum((y - p) * (y - p)) AS sse, count(y) * var_pop(y) AS sst FROM (SELECT entity, y, coalesce(x2, 0) AS p FROM windows WHERE y IS NOT NULL) GROUP BY 1)
SELECT entity, n, round(CASE WHEN n >= 40 AND sst > 1e-8 THEN 1 - sse / sst END, 6) AS masked, round(CASE WHEN sst < 1e-4 THEN -1 ELSE 1 - sse / sst END, 6) AS floored,
  round(CASE WHEN sst > 0 THEN greatest(-1, 1 - sse / sst) END, 6) AS bounded FROM s""")
def r2_variants(s, d, least: int = 40):
    """By entity: NULL below ``least`` cells; -1 without spread; bounded by -1 and NULL without spread."""
    w = windows3(s, d).where("observed").select("entity", "y", F.coalesce(F.col("x")[1], F.lit(0.0)).alias("p"))
    t = w.groupBy("entity").agg(F.count("*").alias("n"), F.sum((F.col("y") - F.col("p")) ** 2).alias("sse"), (F.count("y") * F.var_pop("y")).alias("sst"))
    score = 1 - F.col("sse") / F.when(F.col("sst") > 0, F.col("sst"))
    masked = F.when((F.col("n") >= least) & (F.col("sst") > 1e-8), score)
    return t.select("entity", "n", F.round(masked, SIX).alias("masked"), F.round(F.when(F.col("sst") < 1e-4, -1.0).otherwise(score), SIX).alias("floored"), F.round(scalar.floor_at(score, -1.0), SIX).alias("bounded"))


TWO = WINDOWS + """, two AS (SELECT feature, y, coalesce(x2, 0) AS a, (coalesce(x1, 0) + coalesce(x2, 0)) / 2 AS b FROM windows WHERE y IS NOT NULL),
r AS (SELECT feature, (sum((y - a) * (y - a)) - sum((y - b) * (y - b))) / (count(y) * var_pop(y)) AS delta FROM two GROUP BY 1)"""


@query("mean_delta", TWO + " SELECT count(*) AS features, round(avg(delta), 6) AS delta FROM r")
def mean_delta(s, d):
    """The mean over features of the gain in R2 of the window mean over persistence; one pass over the windows."""
    x1, x2 = (F.coalesce(F.col("x")[k], F.lit(0.0)) for k in (0, 1))
    w = windows3(s, d).where("observed").select("feature", "y", x2.alias("a"), ((x1 + x2) / 2).alias("b"))
    gain = F.sum((F.col("y") - F.col("a")) ** 2) - F.sum((F.col("y") - F.col("b")) ** 2)
    r = w.groupBy("feature").agg((gain / (F.count("y") * F.var_pop("y"))).alias("delta"))
    return r.agg(F.count("*").alias("features"), F.round(F.avg("delta"), SIX).alias("delta"))


# ------------------------------------------------------------ a search and its trials

PENALTIES = (0.1, 1.0, 10.0, 100.0, 1000.0)
SEARCH = WINDOWS + f""", n AS (SELECT CAST(floor(0.8 * count(DISTINCT win)) AS INTEGER) AS n FROM windows),
f AS (SELECT i, n - (3 - i) * (n // 4) AS a, n - (2 - i) * (n // 4) AS b FROM n, (VALUES (0), (1), (2)) v(i)),
c AS (SELECT win, l, coalesce(CASE l WHEN 1 THEN x2 ELSE x1 END, 0) AS x, y FROM windows, (VALUES (1), (2)) v(l) WHERE y IS NOT NULL),
sums AS (SELECT i, l, sum(x * y) FILTER (win < a) AS txy, sum(x * x) FILTER (win < a) AS txx, count(*) FILTER (win >= a) AS m, sum(x * y) FILTER (win >= a) AS xy,
  sum(x * x) FILTER (win >= a) AS xx, sum(y * y) FILTER (win >= a) AS yy, sum(y) FILTER (win >= a) AS y FROM c JOIN f ON win < b GROUP BY 1, 2),
p AS (SELECT row_number() OVER () - 1 AS k, p FROM (VALUES {', '.join(f'({x})' for x in PENALTIES)}) v(p)),
scores AS (SELECT CAST((l - 1) * {len(PENALTIES)} + k AS INTEGER) AS trial, CAST(l AS INTEGER) AS lag, CAST(p AS DOUBLE) AS penalty, CAST(i AS INTEGER) AS fold, txy / (txx + p) AS beta,
  1 - (yy - 2 * (txy / (txx + p)) * xy + (txy / (txx + p)) * (txy / (txx + p)) * xx) / (yy - y * y / m) AS r2 FROM sums, p)"""


def search_scores(s, d) -> DataFrame:
    """(trial, lag, penalty, fold, r2): a ridge of one lag without intercept, scored on each fold.

    A fold's training and validation rows enter by their sums alone; the trials are worked out from these."""
    w = windows3(s, d)
    n = w.agg(F.floor(F.count_distinct("win") * 0.8).cast("int").alias("n"))
    f = n.select("n", F.explode(F.array(*map(F.lit, range(3)))).alias("fold"), F.floor(F.col("n") / 4).alias("test"))
    f = f.select("fold", (F.col("n") - (3 - F.col("fold")) * F.col("test")).alias("a"), (F.col("n") - (2 - F.col("fold")) * F.col("test")).alias("b"))
    lag = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(F.col("x")[2 - k], F.lit(0.0)).alias("v")) for k in (1, 2)]))
    cells = w.where("observed").select("win", "y", lag.alias("c")).select("win", "y", "c.lag", "c.v").join(F.broadcast(f), F.col("win") < F.col("b"))
    y, v, train = F.col("y"), F.col("v"), F.col("win") < F.col("a")
    part = lambda x, side: F.sum(F.when(side, x))
    sums = cells.groupBy("fold", "lag").agg(part(v * y, train).alias("txy"), part(v * v, train).alias("txx"), part(F.lit(1), ~train).alias("m"), part(v * y, ~train).alias("xy"), part(v * v, ~train).alias("xx"), part(y * y, ~train).alias("yy"), part(y, ~train).alias("sy"))
    trials = sums.select("*", F.posexplode(F.array(*map(F.lit, PENALTIES))).alias("k", "penalty"))
    beta = F.col("txy") / (F.col("txx") + F.col("penalty"))
    r2 = 1 - (F.col("yy") - 2 * beta * F.col("xy") + beta * beta * F.col("xx")) / (F.col("yy") - F.col("sy") ** 2 / F.col("m"))
    return trials.select(((F.col("lag") - 1) * len(PENALTIES) + F.col("k")).cast("int").alias("trial"), "lag", "penalty", "fold", r2.alias("r2"))


def trial_table(s, d) -> DataFrame:
    """A row for each trial, with its fold scores as an array in the order of the folds."""
    scores = F.transform(F.array_sort(F.collect_list(F.struct("fold", "r2"))), lambda x: x["r2"])
    return search_scores(s, d).groupBy("trial", "lag", "penalty").agg(scores.alias("scores"))


@query("trial_fold_scores", SEARCH + " SELECT trial, lag, penalty, round(max(r2) FILTER (fold = 0), 6) AS fold0, round(max(r2) FILTER (fold = 1), 6) AS fold1, round(max(r2) FILTER (fold = 2), 6) AS fold2 FROM scores GROUP BY 1, 2, 3")
def trial_fold_scores(s, d):
    return trial_table(s, d).select("trial", "lag", "penalty", *[F.round(F.col("scores")[k], SIX).alias(f"fold{k}") for k in range(3)])


@query("fold_mean", SEARCH + " SELECT trial, round(avg(greatest(r2, -1)), 6) AS score, count(r2) AS folds FROM scores GROUP BY 1")
def fold_mean(s, d):
    """The mean of a trial's valid fold scores, each bounded by -1."""
    return search_scores(s, d).groupBy("trial").agg(F.round(F.avg(scalar.floor_at(F.col("r2"), -1.0)), SIX).alias("score"), F.count("r2").alias("folds"))


@query("grid_champion", SEARCH + ", m AS (SELECT trial, any_value(lag) AS lag, any_value(penalty) AS penalty, round(avg(r2), 6) AS score FROM scores GROUP BY 1) SELECT * FROM m QUALIFY row_number() OVER (ORDER BY score DESC, trial) = 1")
def grid_champion(s, d):
    """The trial of the best mean score, the first of equal ones."""
    m = search_scores(s, d).groupBy("trial").agg(F.first("lag").alias("lag"), F.first("penalty").alias("penalty"), F.round(F.avg("r2"), SIX).alias("score"))
    return m.orderBy(F.desc("score"), "trial").limit(1)


@query("pruned_trials", SEARCH + " SELECT trial, round(median(r2), 6) AS middle, count(r2) < 2 OR median(r2) < 0.02 AS cut FROM scores GROUP BY 1")
def pruned_trials(s, d):
    t = trial_table(s, d)
    ordered = F.array_sort("scores")
    return t.select("trial", F.round(ordered[1], SIX).alias("middle"), results.pruned(F.col("scores"), floor=0.02).alias("cut"))


@query("open_trials", SEARCH + " SELECT DISTINCT trial, lag, penalty FROM scores WHERE trial NOT IN (SELECT trial FROM scores WHERE r2 IS NOT NULL AND lag = 1 AND penalty < 50)")
def open_trials(s, d):
    """What a search has still to run when a store holds the trials of the first lag and small penalties."""
    space = search_scores(s, d).select("trial", "lag", "penalty").distinct()
    return results.open_trials(space, space.where("lag = 1 AND penalty < 50"))


RANKED = SEARCH + ", m AS (SELECT trial, any_value(lag) AS lag, round(avg(r2), 6) AS score FROM scores GROUP BY 1)"


def ranked_trials(s, d) -> DataFrame:
    """(trial, lag, score): the trials of the search, by the mean of their folds."""
    return search_scores(s, d).groupBy("trial").agg(F.first("lag").alias("lag"), F.round(F.avg("r2"), SIX).alias("score"))


@query("best_trial", RANKED + " SELECT lag, trial, score FROM m QUALIFY row_number() OVER (PARTITION BY lag ORDER BY score DESC, trial) = 1")
def best_trial(s, d):
    """The best trial of each lag, the first of equal ones."""
    return panel.keep_last(ranked_trials(s, d), ["lag"], [F.desc("score"), F.asc("trial")]).select("lag", "trial", "score")


@query("topk_trials", RANKED + " SELECT lag, trial, CAST(row_number() OVER (PARTITION BY lag ORDER BY score DESC, trial) AS INTEGER) AS place FROM m QUALIFY place <= 3")
def topk_trials(s, d):
    """The three best trials of each lag; an error if one had fewer."""
    return results.top_trials(ranked_trials(s, d), ["lag"], 3).select("lag", "trial", "place")


@query("trials_by_rank", RANKED + " SELECT lag, trial, CAST(row_number() OVER (PARTITION BY lag ORDER BY score, trial) AS INTEGER) AS place FROM m QUALIFY place <= 3")
def trials_by_rank(s, d):
    """The three trials of the least score of each lag; an error if one had fewer."""
    return results.top_trials(ranked_trials(s, d), ["lag"], 3, ascending=True).select("lag", "trial", "place")
