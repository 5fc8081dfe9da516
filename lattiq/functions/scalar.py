"""Scalar functions. NULL is the only missing value; NaN is turned into it at ingest."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_numeric(text: Column) -> Column:
    """Number from text with blanks, thousands separators and a per-cent sign; NULL if it is none."""
    t = F.trim(text)
    number = F.regexp_replace(F.regexp_replace(t, "%+$", ""), ",", "").try_cast("double")
    return F.when(t.endswith("%"), number / 100).otherwise(number)


def log_modulus(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds that keep NULL, which greatest and least would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def quarter(ts: Column) -> Column:
    """Quarters since year 0: consecutive integers."""
    return (F.year(ts) * 4 + F.quarter(ts) - 1).cast("int")


def day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def adaptive_threshold(size: Column, share: float = 0.05, floor: int = 100, cap: int = 5000) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(cap), F.floor(size * share).cast("int"))).cast("int")


def flag(text: Column) -> Column:
    """A stored flag as boolean."""
    return ~F.lower(F.trim(text.cast("string"))).isin("false", "0", "no", "none", "")


def feature_threshold(entities: Column, periods: Column, density: Column, share: float = 0.05, floor: int = 10, cap: int = 200) -> Column:
    """The least number of cells for a score of one feature."""
    size = F.floor(F.round(entities * periods * density * share, 9)).cast("int")
    return F.greatest(F.lit(floor), F.least(F.lit(cap), size)).cast("int")


def floor_at(x: Column, low: float) -> Column:
    """``x``, or ``low`` if it is below; NULL stays."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def lenient_date(text: Column, form: str = "yyyy-MM-dd") -> Column:
    """A date, NULL where the text is none."""
    return F.try_to_timestamp(text, F.lit(form)).cast("date")


def strict_date(text: Column, form: str = "yyyy-MM-dd") -> Column:
    """A date; text that is none is an error when the query runs."""
    return F.to_timestamp(text, form).cast("date")


def name_or_number(name: Column, i: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("feat_"), i.cast("string")))
