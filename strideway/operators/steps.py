"""Steps and walking: by minute, hour and day, summaries, times of day by which a share was walked.

`epochs` are (recording, time, Steps): steps of short windows on a regular grid, NULL where not
worn. dt is their length in seconds: a number, or (recording, dt) as infer_period() gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.functions.scalar import clock, whole
from strideway.operators.grid import KEYS, bin_of, day_type, micros, resample
from strideway.operators.impute import impute_days, impute_missing
from strideway.session import written

#: Minutes of wear that an adjusted bin needs more than.
ENOUGH = {"minute": 0.5, "hour": 50, "day": 21 * 60}
SHARES = (5, 25, 50, 75, 95)


def with_dt(df: DataFrame, dt: DataFrame | float, keys: list[str] = KEYS) -> DataFrame:
    return df.join(dt, keys, "left") if isinstance(dt, DataFrame) else df.withColumn("dt", F.lit(float(dt)))


def period_of(df: DataFrame, dt: DataFrame | float, keys: list[str] = KEYS) -> DataFrame:
    return dt if isinstance(dt, DataFrame) else df.select(*keys).distinct().withColumn("dt", F.lit(float(dt)))


def walking(epochs: DataFrame, steptol: int = 3, out: str = "Walk") -> DataFrame:
    """1 where an epoch has at least steptol steps, 0 where fewer, NULL where missing."""
    return epochs.withColumn(out, (F.col("Steps") >= steptol).cast("double"))


def without_short(epochs: DataFrame, steptol: int = 3) -> DataFrame:
    """Epochs with fewer than steptol steps have none."""
    return epochs.withColumn("Steps", F.when(F.col("Steps") < steptol, 0.0).otherwise(F.col("Steps")))


def gated(total: Column, value: str, min_wear: float | None) -> Column:
    """total, or NULL unless more than min_wear minutes have a value."""
    return total if min_wear is None else F.when(F.count(value) * F.first("dt") / 60 > min_wear, total)


def by_grain(epochs: DataFrame, grain: str, dt: DataFrame | float, min_wear: float | None = None, value: str = "Steps", keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, value): sums by minute, hour or day; bins without a value are NULL, never 0."""
    return resample(with_dt(epochs, dt, keys), grain, keys, **{value: gated(F.sum(value), value, min_wear)})


def walk_minutes(epochs: DataFrame, grain: str, dt: DataFrame | float, steptol: int = 3, min_wear: float | None = None, keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, Walk): minutes of walking."""
    rows = with_dt(walking(epochs, steptol), dt, keys)
    return resample(rows, grain, keys, Walk=gated(F.sum("Walk"), "Walk", min_wear) * F.first("dt") / 60)


def adjusted(epochs: DataFrame, value: str, dt: DataFrame | float, keys: list[str] = KEYS) -> DataFrame:
    epochs = written(epochs.select(*keys, "time", value), "epochs")  # used for periods, empty days and the grid
    return impute_missing(epochs, [value], period=period_of(epochs, dt, keys), keys=keys)


def over_days(daily: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, daytype, total, avg, med, min, max) of daily values, over all days, weekends and weekdays."""
    rows = daily.select(*keys, value, F.explode(day_type("time")).alias("daytype"))
    return rows.groupBy(*keys, "daytype").agg(F.sum(value).alias("total"), F.avg(value).alias("avg"), F.median(value).alias("med"), F.min(value).alias("min"), F.max(value).alias("max"))


def representative_week(daily: DataFrame, value: str, method: str = "mean", keys: list[str] = KEYS) -> DataFrame:
    """(keys, weekday, value): missing days filled, then one value for each day of the week."""
    filled = impute_days(daily, [value], method, keys)
    agg = F.avg(value) if method == "mean" else F.median(value)
    return filled.groupBy(*keys, F.weekday("time").alias("weekday")).agg(agg.alias(value))


def over_week(daily: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """Like over_days() with averages over the representative week; totals are of the days as they are, without filled ones."""
    daily = written(daily, "daily")  # a row a day, used twice
    week = representative_week(daily, value, keys=keys)
    kind = F.array(F.lit("overall"), F.when(F.col("weekday") >= 5, "weekend").otherwise("weekday"))
    stats = week.select(*keys, value, F.explode(kind).alias("daytype")).groupBy(*keys, "daytype").agg(F.avg(value).alias("avg"), F.median(value).alias("med"), F.min(value).alias("min"), F.max(value).alias("max"))
    return over_days(daily, value, keys).select(*keys, "daytype", "total").join(stats, [*keys, "daytype"])


def rounded(summary: DataFrame) -> DataFrame:
    """Step statistics as whole numbers, half to even."""
    return summary.withColumns({c: whole(F.col(c)) for c in ("total", "avg", "med", "min", "max")})


def hour_profile(hourly: DataFrame, value: str, keys: list[str] = KEYS) -> DataFrame:
    """(keys, daytype, hour, value): mean by hour of the day; all 24 hours of each of the three kinds of day."""
    rows = hourly.select(*keys, value, F.explode(day_type("time")).alias("daytype"), F.hour("time").alias("hour"))
    means = rows.groupBy(*keys, "daytype", "hour").agg(F.avg(value).alias(value))
    kinds = F.explode(F.array(F.lit("overall"), F.lit("weekend"), F.lit("weekday"))).alias("daytype")
    every = hourly.select(*keys).distinct().select(*keys, kinds).select(*keys, "daytype", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return every.join(means, [*keys, "daytype", "hour"], "left")


def share_times(epochs: DataFrame, dt: DataFrame | float, min_wear: float | None = None, shares: tuple[int, ...] = SHARES, keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, p05_at ...): seconds after midnight by which a share of the day's steps was walked; NULL without steps, or unless the day has enough wear."""
    day = Window.partitionBy(*keys, "_day")
    sofar = day.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    rows = with_dt(epochs, dt, keys).withColumn("_day", bin_of("day"))
    rows = rows.withColumn("_share", F.when(F.col("Steps").isNotNull(), F.round(F.try_divide(F.sum("Steps").over(sofar), F.sum("Steps").over(day)), 9)))
    after = (micros("time") - micros("_day")) / 1e6
    found = rows.groupBy(*keys, F.col("_day").alias("time")).agg(*[gated(F.min(F.when(F.col("_share") >= p / 100, after)), "Steps", min_wear).alias(f"p{p:02}_at") for p in shares])
    days = found.groupBy(*keys).agg(F.min("time").alias("a"), F.max("time").alias("b")).select(*keys, F.explode(F.expr("sequence(a, b, INTERVAL 1 DAY)")).alias("time"))
    return days.join(found, [*keys, "time"], "left")


def mean_share_times(times: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, Steps5thAt ...): the mean time of day as HH:MM:SS."""
    names = [c for c in times.columns if c.endswith("_at")]
    return times.groupBy(*keys).agg(*[clock(F.avg(c)).alias(f"Steps{int(c[1:3])}thAt") for c in names])


def summarize_steps(epochs: DataFrame, dt: DataFrame | float, steptol: int = 3, adjust: bool = False, enough: dict[str, float] = ENOUGH, keys: list[str] = KEYS) -> dict[str, DataFrame]:
    """minutely, hourly, daily (time, Steps, Walk, Steps5thAt ...), steps and walk by kind of day, hour profiles, mean share times."""
    walk = walking(epochs, steptol)
    if adjust:
        walk = written(adjusted(walk, "Walk", dt, keys), "walk")
        epochs = written(adjusted(epochs, "Steps", dt, keys), "steps")
    limit = enough if adjust else dict.fromkeys(enough)
    over = over_week if adjust else over_days
    minutes = lambda grain: resample(with_dt(walk, dt, keys), grain, keys, Walk=gated(F.sum("Walk"), "Walk", limit[grain]) * F.first("dt") / 60)
    hourly, daily = (by_grain(epochs, g, dt, limit[g], keys=keys) for g in ("hour", "day"))
    hourly_walk, daily_walk = minutes("hour"), minutes("day")
    times = share_times(epochs, dt, limit["day"], keys=keys)
    shown = times.select(*keys, "time", *[clock(F.col(f"p{p:02}_at")).alias(f"Steps{p}thAt") for p in SHARES])
    return {
        "minutely": by_grain(epochs, "minute", dt, limit["minute"], keys=keys).withColumn("Steps", whole(F.col("Steps"))),
        "hourly": hourly.withColumn("Steps", whole(F.col("Steps"))),
        "daily": daily_walk.join(daily.withColumn("Steps", whole(F.col("Steps"))), [*keys, "time"], "full").join(shown, [*keys, "time"], "full"),
        "steps": rounded(over(daily, "Steps", keys)),
        "walk": over(daily_walk, "Walk", keys),
        "hour_steps": hour_profile(hourly, "Steps", keys).withColumn("Steps", whole(F.col("Steps"))),
        "hour_walk": hour_profile(hourly_walk, "Walk", keys),
        "share_times": mean_share_times(times, keys),
    }


def plot_data(epochs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, day, time, Steps, missing): what a plot of each day's steps by minute shows."""
    rows = resample(epochs, "minute", keys, Steps=F.sum("Steps"))
    return rows.select(*keys, F.to_date("time").alias("day"), "time", "Steps", F.col("Steps").isNull().alias("missing"))
