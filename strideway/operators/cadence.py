"""Cadence: peaks and percentiles of steps a minute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions.scalar import whole
from strideway.operators.grid import KEYS, bin_of, day_type, resample
from strideway.operators.impute import impute_days
from strideway.operators.steps import with_dt

MEASURES = {"peak1": "CadencePeak1(steps/min)", "peak30": "CadencePeak30(steps/min)", "p95": "Cadence95th(steps/min)"}


def daily_cadence(epochs: DataFrame, dt: DataFrame | float, steptol: int = 3, min_walk_per_day: int = 5, grain: str = "minute", keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, peak1, peak30, p95) of each day: the mean of the 1 and 30 best minutes, ties at the last place included, and the 95th percentile, among minutes of walking; NULL with fewer than min_walk_per_day of them."""
    minutely = resample(epochs, grain, keys, Steps=F.sum("Steps")).withColumn("Steps", F.coalesce("Steps", F.lit(0.0)))
    rows = with_dt(minutely, dt, keys).withColumn("day", bin_of("day"))
    busy = rows.filter(F.col("Steps") >= F.lit(steptol) * 60 / F.col("dt"))
    rank = F.rank().over(Window.partitionBy(*keys, "day").orderBy(F.col("Steps").desc()))
    enough = F.count("*") >= min_walk_per_day
    found = busy.withColumn("r", rank).groupBy(*keys, F.col("day").alias("time")).agg(
        *[F.when(enough, F.avg(F.when(F.col("r") <= n, F.col("Steps")))).alias(f"peak{n}") for n in (1, 30)], F.when(enough, F.percentile("Steps", 0.95)).alias("p95")
    )
    ends = minutely.groupBy(*keys).agg(F.min(bin_of("day")).alias("a"), F.max(bin_of("day")).alias("b"))
    days = ends.select(*keys, F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("time"))
    return days.join(found, [*keys, "time"], "left")


def cadence_summary(daily: DataFrame, adjust: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """(keys, daytype, peak1, peak30, p95): medians over days; adjusted, over a representative week of medians."""
    if not adjust:
        rows = daily.select(*keys, *MEASURES, F.explode(day_type("time")).alias("daytype"))
    else:
        filled = impute_days(daily, list(MEASURES), "median", keys)
        week = filled.groupBy(*keys, F.weekday("time").alias("weekday")).agg(*[F.median(m).alias(m) for m in MEASURES])
        kind = F.array(F.lit("overall"), F.when(F.col("weekday") >= 5, "weekend").otherwise("weekday"))
        rows = week.select(*keys, *MEASURES, F.explode(kind).alias("daytype"))
    return rows.groupBy(*keys, "daytype").agg(*[whole(F.median(m)).alias(m) for m in MEASURES])


def shown(daily: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Daily cadence in whole steps a minute under the names of reports."""
    return daily.select(*keys, "time", *[whole(F.col(m)).alias(name) for m, name in MEASURES.items()])
