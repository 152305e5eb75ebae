"""Column expressions shared by the operators (all JVM-side built-ins, no UDFs)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import FLAG_COLUMNS

MS_PER_HOUR = 3_600_000
MS_PER_DAY = 86_400_000


def safe_div(num: Column, den: Column) -> Column:
    """ANSI-safe division: null (not an error) when the denominator is 0 or null."""
    return F.try_divide(num, den)


def money(x: Column, scale: int = 2) -> Column:
    """Round a money amount HALF_UP to ``scale`` decimals, as a double.

    The double is first pinned to 6 decimals so last-bit summation noise (which depends on
    partition order) can never flip a cent between runs or engines.
    """
    return F.round(x.try_cast("decimal(38,6)"), scale).cast("double")


def dec(value: Decimal | float | int) -> Column:
    """Exact decimal literal (``0.05`` stays 0.05, as in SQL)."""
    return F.lit(Decimal(str(value)))


def exact_cost(count: Column, unit: Decimal, scale: int = 2) -> Column:
    """round(count * unit, scale) in exact decimal arithmetic, returned as double."""
    return F.round(count.cast("decimal(20,0)") * dec(unit), scale).cast("double")


def utc_hour(ms: Column) -> Column:
    """Hour of day (0-23, UTC) of an epoch-millisecond column; null stays null.

    Same as hour(timestamp_millis(ms)) under a UTC session, but independent of the
    session time zone.
    """
    return F.floor(F.pmod(ms, F.lit(MS_PER_DAY)) / F.lit(MS_PER_HOUR)).cast("int")


def any_flag_true(prefix: str = "") -> Column:
    """Any device flag is true (a null flag is not true)."""
    cond = None
    for f in FLAG_COLUMNS:
        c = F.col(prefix + f) == F.lit(True)
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False))


def has_null_value() -> Column:
    """1 if distance or any flag is null, else 0."""
    cond = F.col("distance_to_frequent_location").isNull()
    for f in FLAG_COLUMNS:
        cond = cond | F.col(f).isNull()
    return F.when(cond, 1).otherwise(0)


def is_low_risk(policy) -> Column:
    """Low-risk mask over a frame that has ``has_null_value``; null compares as false."""
    pred = ((F.col("transaction_value") < policy.low_max_value)
            & (F.col("distance_to_frequent_location") < policy.low_max_distance)
            & (F.col("device_age_days") > policy.low_min_device_age)
            & (F.col("has_null_value") == 0))
    return F.coalesce(pred, F.lit(False))


def rounded(x: Column, decimals: int) -> Column:
    """An inexact double to a fixed number of decimals (2 from a million on, none from 1e8 on, where a
    double has few left), so that last-bit noise of a sum's order disappears.  Never -0.0."""
    return (F.when(F.abs(x) < F.lit(1e6), F.round(x, decimals))
            .when(F.abs(x) < F.lit(1e8), F.round(x, 2)).otherwise(F.round(x, 0)) + F.lit(0.0))


def ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
