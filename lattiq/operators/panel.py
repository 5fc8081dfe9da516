"""Densifying, filling, scaling, coverage and missingness of panels.

Statistics that are joined back to cells are window aggregates over the cell's own key, so each costs one
shuffle by that key; distinct entities, periods and features make the dense grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators.folders import kept


def densify(long: DataFrame, between: tuple[int, int] | None = None) -> DataFrame:
    """Every entity x feature x period in the range of periods (found, or given as ``between``), with NULL where no cell is.

    The sequence of periods and the list of features are single rows, so the grid is exploded from the
    entities and needs no product of tables.
    """
    axes = long.agg(F.min("period").alias("lo"), F.max("period").alias("hi"), F.array_sort(F.collect_set("feature")).alias("features"))
    if between is not None:
        axes = axes.withColumns({"lo": F.lit(between[0]), "hi": F.lit(between[1])})
    grid = long.select("entity").distinct().join(F.broadcast(axes), F.lit(True))
    grid = grid.select("entity", F.explode("features").alias("feature"), "lo", "hi")
    grid = grid.select("entity", "feature", F.explode(F.sequence("lo", "hi")).alias("period"))
    return grid.join(long, ["entity", "feature", "period"], "left")


def forward_fill(dense: DataFrame, value: str = "value") -> DataFrame:
    w = Window.partitionBy("entity", "feature").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return dense.withColumn(value, F.last(value, ignorenulls=True).over(w))


def zscore(df: DataFrame, by: list[str], value: str = "value", sample: bool = False) -> DataFrame:
    """Population z-scores, 0 where nothing varies; with ``sample`` the n - 1 form with 1e-8 added."""
    w = Window.partitionBy(*by)
    x, mean = F.col(value), F.avg(value).over(w)
    if sample:
        return df.withColumn(value, (x - mean) / (F.stddev_samp(value).over(w) + 1e-8))
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(value, F.when(sd > 0, (x - mean) / F.when(sd > 0, sd)).otherwise(x * 0))


def rms(x: Column, w) -> Column:
    return F.sqrt(F.avg(x * x).over(w)) + 1e-8


def rms_scale(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) / rms(F.col(value), Window.partitionBy(*by)))


def keep_last(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by an order that has a tiebreak."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def starts(long: DataFrame) -> DataFrame:
    return long.groupBy("entity").agg(F.min("period").alias("first_period"))


def missing_share(long: DataFrame, entities: bool) -> DataFrame:
    """Missing cells of the dense grid by entity or feature, from counts alone: the grid isn't made."""
    axes = long.agg(F.count_distinct("entity").alias("n_e"), F.count_distinct("feature").alias("n_f"), (F.max("period") - F.min("period") + 1).alias("n_p"))
    key = "entity" if entities else "feature"
    cells = (F.col("n_f") if entities else F.col("n_e")) * F.col("n_p")
    seen = long.groupBy(key).agg(F.count("value").alias("seen"))
    return seen.join(F.broadcast(axes), F.lit(True)).select(key, (cells - F.col("seen")).alias("missing"), ((cells - F.col("seen")) / cells).alias("rate"))


def tasks(spark) -> int:
    """Into how many parts rows are dealt that become many where they are: three to a core. Adaptive execution goes by the sizes of the
    shuffle, which are small, and would leave one task to make all windows."""
    return 3 * spark.sparkContext.defaultParallelism


def series(long: DataFrame) -> DataFrame:
    """(entity, feature, values, first, seen): for each entity x feature an array of the values from the first to the last period of
    the panel, NULL where no cell is; with the first period and the sorted periods that have a value. A cell is there once at most.

    Entities are dealt out once and the gaps between an entity's cells filled where they lie, so the dense grid is neither shuffled
    nor joined. Periods and features are bounded.
    """
    known = F.col("value").isNotNull() & F.col("entity").isNotNull() & F.col("feature").isNotNull() & F.col("period").isNotNull()
    axes = long.agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.array_sort(F.collect_set("feature")).alias("features"),
        F.array_sort(F.collect_set(F.when(known, F.col("period")))).alias("seen"),
    )
    cells = F.sort_array(F.collect_list(F.when(known, F.struct("feature", "period", "value"))))
    rows = long.repartition(tasks(long.sparkSession), "entity").groupBy("entity").agg(cells.alias("cells")).join(F.broadcast(axes), F.lit(True))
    rows = rows.select("entity", "first", "last", "seen", "cells", F.explode("features").alias("feature"))
    rows = rows.withColumn("cells", F.filter("cells", lambda c: c["feature"] == F.col("feature")))
    gap = lambda start, stop: F.array_repeat(F.lit(None).cast("double"), stop - start)
    head = gap(F.col("first"), F.coalesce(F.get("cells", F.lit(0))["period"], F.col("last") + 1))
    rest = F.transform("cells", lambda c, i: F.concat(F.array(c["value"]), gap(c["period"] + 1, F.coalesce(F.get("cells", i + 1)["period"], F.col("last") + 1))))
    return rows.select("entity", "feature", F.concat(head, F.flatten(rest)).alias("values"), "first", "seen")


def lookback(rows: DataFrame, lags: int, drop_last: bool = True) -> DataFrame:
    """(entity, feature, win, x, y, observed) from ``series``: x are the values of ``lags`` periods, y that after them.

    ``win`` counts from the first period. Windows whose target is missing for every cell are dropped. With ``drop_last`` the
    last period is never a target.
    """
    at = lambda p: p - F.col("first")
    targets = F.filter("seen", lambda p: (at(p) >= lags) & (at(p) < F.size("values") - int(drop_last)))
    out = rows.select("entity", "feature", "values", "first", F.explode(targets).alias("period"))
    out = out.select("entity", "feature", (at(F.col("period")) - lags).alias("win"), "values")  # by columns and not by a function of each target, so that Spark compiles it
    y = F.get("values", F.col("win") + lags)
    return out.select("entity", "feature", "win", F.slice("values", F.col("win") + 1, lags).alias("x"), y.alias("y"), y.isNotNull().alias("observed"))


def window_rms(rows: DataFrame, lags: int) -> DataFrame:
    """(win, rms) of the inputs of the windows of ``series``, from sums by period; a window without any value has no row."""
    sums = rows.select(F.posexplode("values").alias("at", "v")).where("v IS NOT NULL").groupBy("at").agg(F.sum(F.col("v") * F.col("v")).alias("s"), F.count("v").alias("n"))
    sums = sums.select("s", "n", F.explode(F.sequence(F.col("at") - lags + 1, "at")).alias("win"))
    return sums.groupBy("win").agg((F.sqrt(F.sum("s") / F.sum("n")) + 1e-8).alias("rms"))


def folds(n: int, k: int = 3) -> list[tuple[int, int]]:
    """(end of training, end of validation) of k expanding folds over n windows."""
    test = n // (k + 1)
    return [(n - (k - i) * test, n - (k - i - 1) * test) for i in range(k)]


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``nth``, the place of each row from 0 on in an order. Rows are dealt by range and sorted where they are; only the
    ranges' counts are added up in one task."""
    at = kept(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(before), part == F.col("_part")).withColumn("nth", inside + F.col("_before")).drop("_at", "_part", "_before")


def places(df: DataFrame, value: str) -> DataFrame:
    """(value, n, before): the distinct values of a column, how many rows hold each, and how many rows hold a smaller one."""
    rows = numbered(df.where(F.col(value).isNotNull()).select(value), value)
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min("nth").alias("before"))


def r2(df: DataFrame, by: list[str], y: str = "y", p: str = "p", least: int = 1) -> DataFrame:
    """Masked R2: NULL with fewer than ``least`` observations or no spread of y."""
    seen = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    out = seen.groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col(y) - F.col(p)) ** 2).alias("sse"), F.var_pop(y).alias("v"))
    spread = F.col("n") * F.col("v")
    return out.select(*by, "n", F.when((F.col("n") >= least) & (spread > 1e-8), 1 - F.col("sse") / F.when(spread > 1e-8, spread)).alias("r2"))


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Average ranks within groups as ``rank_<value>``, and how many rows share each as ``ties_<value>``."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn(f"ties_{value}", ties).withColumn(f"rank_{value}", F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.col(f"ties_{value}") - 1) / 2)


def step_up(tests: DataFrame, p: str, name: str) -> DataFrame:
    """Benjamini-Hochberg adjustment of the p-values of a small table of tests, as column ``name``; NULL stays NULL."""
    known = Window.partitionBy(F.col(p).isNull())
    q = F.col(p) * F.count("*").over(known) / F.row_number().over(known.orderBy(p))
    least = F.min("_q").over(known.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0))
    return tests.withColumn("_q", q).withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_q")


def ar1(long: DataFrame, least: int = 8, spread: float = 1e-12) -> DataFrame:
    """(feature, n, rho): mean over entities of the slope of a value on the entity's last seen one, within [-1, 1]; of
    entities with ``least`` values and some spread. A gap is skipped."""
    x = F.lag("value").over(Window.partitionBy("entity", "feature").orderBy("period"))
    pairs = long.where("value IS NOT NULL").withColumn("x", x).where("x IS NOT NULL")
    each = pairs.groupBy("entity", "feature").agg(F.count("*").alias("n"), F.covar_samp("value", "x").alias("c"), F.var_samp("x").alias("v")).where((F.col("n") >= least - 1) & (F.col("v") >= spread))
    return each.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / F.col("v")))).alias("rho"))
