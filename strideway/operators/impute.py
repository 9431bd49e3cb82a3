"""Filling missing values from the same time on like days, step by step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.operators.grid import KEYS, infer_period, whole_days


def _cascade(df: DataFrame, values: list[str], groups: list[list[Column]], keys: list[str], average: Callable[[str], Column]) -> DataFrame:
    """Each step fills what is missing with the group's average of what the steps before left or filled."""
    for by in groups:
        w = Window.partitionBy(*keys, *by)
        df = df.withColumns({v: F.coalesce(F.col(v), average(v).over(w)) for v in values})
    return df


def impute_missing(df: DataFrame, values: list[str], extrapolate: bool = True, skip_full_missing_days: bool = True, period: DataFrame | None = None, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, time, values) filled by day of the week, then within weekdays or weekends, then over all days, in steps of five minutes of the day.

    With extrapolate, first and last day become whole days. Days without any value before that stay empty."""
    rows = df.select(*keys, time, *values)
    if skip_full_missing_days:
        some = F.lit(False)
        for v in values:
            some = some | F.col(v).isNotNull()
        empty = rows.groupBy(*keys, F.to_date(time).alias("_day")).agg(F.max(some).alias("_any")).filter("NOT _any").select(*keys, "_day", F.lit(True).alias("_empty"))
    if extrapolate:
        rows = whole_days(rows, values, infer_period(df, keys, time) if period is None else period, keys, time)
    slot = [F.hour(time), F.floor(F.minute(time) / 5)]
    rows = _cascade(rows, values, [[F.weekday(time), *slot], [F.weekday(time) >= 5, *slot], slot], keys, F.avg)
    if skip_full_missing_days:
        rows = rows.withColumn("_day", F.to_date(time)).join(empty, [*keys, "_day"], "left")
        rows = rows.withColumns({v: F.when(F.col("_empty").isNull(), F.col(v)) for v in values}).drop("_day", "_empty")
    return rows


def impute_days(df: DataFrame, values: list[str], method: str = "mean", keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """Daily values filled by day of the week, then within weekdays or weekends, then over all days."""
    if method not in ("mean", "median"):
        raise ValueError(f"unknown method: {method}")
    average = F.avg if method == "mean" else F.median
    return _cascade(df, values, [[F.weekday(time)], [F.weekday(time) >= 5], []], keys, average)
