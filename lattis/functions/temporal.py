"""Time features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNITS = {"s": 1, "ms": 1e3, "us": 1e6, "ns": 1e9}


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) / 1e6")


def add_hour_and_day_night(df: DataFrame, time_column: str, unit: str = "s", night_start: int = 20, night_end: int = 6) -> DataFrame:
    """hour and is_night; hours night_start and night_end are both night. Numbers count ``unit`` since 1970."""
    numeric = dict(df.dtypes)[time_column] in ("bigint", "int", "double", "float")
    hour = F.floor(F.pmod(F.col(time_column) / _UNITS[unit], F.lit(86400)) / 3600).cast("int") if numeric else F.hour(F.col(time_column))
    return df.withColumn("hour", hour).withColumn("is_night", (F.col("hour") >= night_start) | (F.col("hour") <= night_end))


def filter_by_hour(df: DataFrame, time_column: str, start_hour: int = 7, end_hour: int = 19) -> DataFrame:
    return df.withColumn("hour", F.hour(time_column)).where((F.col("hour") >= start_hour) & (F.col("hour") < end_hour))


def hour_bins(hour: Column, edges=(0, 6, 12, 18, 24), labels=None) -> Column:
    """Left-closed bins; null outside."""
    out = F.lit(None).cast("string")
    for k, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        out = F.when((hour >= a) & (hour < b), F.lit(labels[k] if labels else f"[{a}, {b})")).otherwise(out)
    return out


def time_windows(df: DataFrame, time_column: str, window: str = "1 hour", overlap: str = "0 seconds") -> DataFrame:
    """Tumbling windows from the earliest time; one may start at the latest time. overlap pads both sides."""
    lim = df.agg(F.min(time_column).alias("lo"), F.max(time_column).alias("hi")).where("lo is not null")
    w = lim.select(F.explode(F.expr(f"sequence(lo, hi, interval {window})")).alias("start"))
    return w.select(F.expr(f"start - interval {overlap}").alias("window_start"), F.expr(f"start + interval {window} + interval {overlap}").alias("window_end"))
