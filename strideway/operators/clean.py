"""Rows and days of a recording: duplicates, trimming, exclusion, wear."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions.scalar import seconds_of
from strideway.operators.grid import KEYS, infer_period

XYZ = ["x", "y", "z"]


def null_for_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN to NULL, so that aggregates leave missing values out."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def first_of_duplicates(df: DataFrame, order: str, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """Of rows with one time the first by `order`."""
    w = Window.partitionBy(*keys, time).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _bound(text: str, end: bool) -> Column:
    """The first moment of a time given to a day, hour, minute or second, or the first after it."""
    text = text.strip().replace("T", " ")
    parts = [("YEAR", r"\d{4}"), ("MONTH", r"\d{4}-\d{2}"), ("DAY", r"\d{4}-\d{2}-\d{2}"), ("HOUR", r"\S+ \d{2}"), ("MINUTE", r"\S+ \d{2}:\d{2}"), ("SECOND", r"\S+ \d{2}:\d{2}:\d{2}")]
    unit = next((u for u, p in parts if re.fullmatch(p, text)), None)
    fill = text + {"YEAR": "-01-01", "MONTH": "-01", "HOUR": ":00"}.get(unit or "", "")
    at = F.lit(fill).cast("timestamp_ntz")
    if not end:
        return at
    return at + F.expr(f"INTERVAL 1 {unit}") if unit else at + F.expr("INTERVAL 0.000001 SECOND")


def trim(df: DataFrame, start: str | None = None, end: str | None = None, time: str = "time") -> DataFrame:
    """Rows from start to end, both inclusive; an end given as a date holds the whole day."""
    if start is not None:
        df = df.filter(F.col(time) >= _bound(start, False))
    if end is not None:
        df = df.filter(F.col(time) < _bound(end, True))
    return df


def drop_first_last_days(df: DataFrame, which: str = "both", keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """Without each recording's first day, last day or both; any other choice keeps all."""
    if which not in ("first", "last", "both"):
        return df
    # A row for each recording is joined back: no window over all samples.
    ends = df.groupBy(*keys).agg(F.min(F.to_date(time)).alias("_first"), F.max(F.to_date(time)).alias("_last"))
    keep = F.lit(True)
    if which != "last":
        keep = keep & (F.to_date(time) != F.col("_first"))
    if which != "first":
        keep = keep & (F.to_date(time) != F.col("_last"))
    return df.join(ends, keys).filter(keep).drop("_first", "_last")


def worn(columns: list[str]) -> Column:
    """No value missing."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def blank_days_below(df: DataFrame, min_wear: str, columns: list[str], period: DataFrame | None = None, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """Values of days with less than min_wear (like '12H') of wear become NULL; a day with just as much stays."""
    period = infer_period(df, keys, time) if period is None else period
    days = df.groupBy(*keys, F.to_date(time).alias("_day")).agg(F.count(F.when(worn(columns), 1)).alias("_ok"))
    short = days.join(period, keys).filter(F.col("_ok") * F.col("dt") < seconds_of(min_wear)).select(*keys, "_day", F.lit(True).alias("_short"))
    out = df.withColumn("_day", F.to_date(time)).join(short, [*keys, "_day"], "left")
    return out.withColumns({c: F.when(F.col("_short").isNull(), F.col(c)) for c in columns}).drop("_day", "_short")


def wear_stats(df: DataFrame, columns: list[str], period: DataFrame | None = None, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """One row for each recording: its ends, the ends of what was worn, days of wear and non-wear, and whether every hour of the day is covered.

    Non-wear counts rows with any value missing; the ends of wear look for any value present."""
    period = infer_period(df, keys, time) if period is None else period
    some = F.lit(False)
    for c in columns:
        some = some | F.col(c).isNotNull()
    by_hour = df.groupBy(*keys, F.hour(time).alias("hour")).agg(
        F.count("*").alias("n"), F.count(F.when(worn(columns), 1)).alias("ok"), F.min(time).alias("t0"), F.max(time).alias("t1"), F.min(F.when(some, F.col(time))).alias("w0"), F.max(F.when(some, F.col(time))).alias("w1")
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    total = by_hour.groupBy(*keys).agg(
        text(F.min("t0")).alias("StartTime"), text(F.max("t1")).alias("EndTime"), text(F.min("w0")).alias("WearStartTime"), text(F.max("w1")).alias("WearEndTime"),
        F.sum("ok").alias("_ok"), F.sum("n").alias("_n"), ((F.count("*") == 24) & (F.min(F.col("ok") / F.col("n")) >= 0.01)).cast("int").alias("Covers24hOK"),
    )
    days = lambda c: F.col(c) * F.col("dt") / 86400
    out = total.withColumn("_non", F.col("_n") - F.col("_ok")).join(period, keys, "left")
    return out.select(*keys, "StartTime", "EndTime", "WearStartTime", "WearEndTime", days("_ok").alias("WearTime(days)"), days("_non").alias("NonwearTime(days)"), "Covers24hOK")


def daily_wear(df: DataFrame, columns: list[str], period: DataFrame | None = None, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, Date, WearTime(hours)) of days that have rows."""
    period = infer_period(df, keys, time) if period is None else period
    days = df.groupBy(*keys, F.to_date(time).alias("Date")).agg(F.count(F.when(worn(columns), 1)).alias("_ok"))
    return days.join(period, keys, "left").select(*keys, "Date", F.bround(F.col("_ok") * F.col("dt") / 3600, 2).alias("WearTime(hours)"))


def nothing_worn(df: DataFrame, columns: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Keys of recordings without a single complete row, which only get wear statistics."""
    return df.groupBy(*keys).agg(F.max(worn(columns)).alias("any")).filter("NOT any").select(*keys)
