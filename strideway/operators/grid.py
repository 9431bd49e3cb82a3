"""Time grids: sampling period, bins with empty ones kept, windows, nearest alignment.

Every function takes a DataFrame keyed by `recording` (or other keys) with a TIMESTAMP_NTZ column
`time`; a cohort is one plan. Missing values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["recording"]
STEP = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def micros(t: Column | str) -> Column:
    """Microseconds since 1970 of a zoneless time; the session's zone is UTC."""
    return F.unix_micros((F.col(t) if isinstance(t, str) else t).cast("timestamp"))


def at_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def bin_of(grain: str, time: str = "time") -> Column:
    return F.date_trunc(grain, F.col(time)).cast("timestamp_ntz")


def day_type(time: str) -> Column:
    """Whose averages a row counts for: all, and one of weekend and weekday (Monday is 0)."""
    return F.array(F.lit("overall"), F.when(F.weekday(time) >= 5, "weekend").otherwise("weekday"))


def field_of(rows: Column, name: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda row: row[name])


def infer_period(df: DataFrame, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, dt): seconds between samples, the mean of the gaps that lie within their quartiles."""
    gaps = df.select(*keys, ((micros(time) - F.lag(micros(time)).over(Window.partitionBy(*keys).orderBy(time))) / 1e6).alias("gap")).filter("gap IS NOT NULL")
    quartiles = gaps.groupBy(*keys).agg(F.percentile("gap", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    near = gaps.join(quartiles, keys).filter((F.col("gap") >= F.col("q")[0]) & (F.col("gap") <= F.col("q")[1]))
    return near.groupBy(*keys).agg(F.avg("gap").alias("dt"))


def sample_rate(df: DataFrame, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, dt, rate): rate in whole samples a second."""
    return infer_period(df, keys, time).withColumn("rate", F.bround(1 / F.col("dt")).cast("int"))


def spine(bins: DataFrame, grain: str, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, time): every bin from a recording's first to its last."""
    ends = bins.groupBy(*keys).agg(F.min(bin_of(grain, time)).alias("first"), F.max(bin_of(grain, time)).alias("last"))
    return ends.select(*keys, F.explode(F.expr(f"sequence(first, last, {STEP[grain]})")).alias(time))


def resample(df: DataFrame, grain: str, keys: list[str] = KEYS, time: str = "time", **aggs: Column) -> DataFrame:
    """Aggregates by midnight-anchored bin, empty bins included (their aggregates are NULL).

    Each bin fills the gap to the next one itself, so df is read once and nothing is joined."""
    found = df.groupBy(*keys, bin_of(grain, time).alias("_bin")).agg(*[c.alias(k) for k, c in aggs.items()])
    following = F.lead("_bin").over(Window.partitionBy(*keys).orderBy("_bin"))
    filled = found.withColumn("_next", following).withColumn(time, F.explode(F.expr(f"sequence(_bin, coalesce(_next - {STEP[grain]}, _bin), {STEP[grain]})")))
    return filled.select(*keys, time, *[F.when(F.col(time) == F.col("_bin"), F.col(k)).alias(k) for k in aggs])


def with_first(df: DataFrame, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """df with _from, the microseconds of its key's first row: a row for each key is joined back, so raw samples of a recording needn't meet in one task."""
    return df.join(df.groupBy(*keys).agg(F.min(micros(time)).alias("_from")), keys)


def windows_from_start(df: DataFrame, seconds: float, values: list[str], keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, window_start, n, values as arrays in time order): windows anchored at a recording's first sample, empty ones included."""
    us = int(seconds * 1e6)
    placed = with_first(df, keys, time).withColumn("_w", F.floor((micros(time) - F.col("_from")) / us))
    rows = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), *values)))
    found = placed.groupBy(*keys, "_from", "_w").agg(F.count("*").alias("n"), rows.alias("_rows"))
    every = found.groupBy(*keys, "_from").agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("_w"))).alias("_w"))
    out = every.join(found, [*keys, "_from", "_w"], "left").withColumn("window_start", at_micros(F.col("_from") + F.col("_w") * us))
    return out.select(*keys, "window_start", F.coalesce("n", F.lit(0)).alias("n"), *[field_of(F.col("_rows"), v).alias(v) for v in values])


def map_windows(df: DataFrame, seconds: float, fn, schema: str, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """A function of one's own for each window anchored at a recording's first sample: it gets the window's rows as a pandas frame in time order and returns one that fits the schema."""
    us = int(seconds * 1e6)
    placed = with_first(df, keys, time).withColumn("window_start", at_micros(F.col("_from") + F.floor((micros(time) - F.col("_from")) / us) * us)).drop("_from")
    return placed.groupBy(*keys, "window_start").applyInPandas(lambda part: fn(part.sort_values(time, ignore_index=True)), schema)


def ordered_distinct(df: DataFrame, value: str, position: str) -> DataFrame:
    """(value, position) of the first appearance of every value; ordered by position they are distinct values in order."""
    return df.groupBy(value).agg(F.min(position).alias(position))


def fixed_length(values: Column, length: int) -> Column:
    """An array of just `length` values: cut if longer, continued from its own start if more than half, else NULL."""
    n = F.size(values)
    return F.when(n >= length, F.slice(values, 1, length)).when(n * 2 > length, F.slice(F.concat(values, values), 1, length))


def windows_by_count(df: DataFrame, size: int, overlap: int, values: list[str], keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """(keys, window, n, values): windows of `size` rows, each `size - overlap` rows after the last; short ones at the end are left out."""
    step = size - overlap
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    low = F.greatest(F.lit(0), F.floor((F.col("_i") - size) / step) + 1)
    spread = placed.withColumn("window", F.explode(F.sequence(low.cast("long"), F.floor(F.col("_i") / step).cast("long"))))
    rows = F.sort_array(F.collect_list(F.struct("_i", F.col(time).alias("t"), *values)))
    got = spread.groupBy(*keys, "window").agg(F.count("*").alias("n"), rows.alias("_rows")).filter(F.col("n") == size)
    return got.select(*keys, "window", "n", F.col("_rows")[0]["t"].alias("first"), F.col("_rows")[size - 1]["t"].alias("last"), *[field_of(F.col("_rows"), v).alias(v) for v in values])


def asof_nearest(grid: DataFrame, seen: DataFrame, values: list[str], tolerance: Column | float, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """grid with values of the nearest row of seen within tolerance seconds; of two just as near the later.

    One shuffle of the union instead of a range join: the nearest row before and after come from
    windows over both, in time order."""
    a = seen.select(*keys, time, F.struct(micros(time).alias("us"), *values).alias("_seen"), F.lit(0).alias("_grid"))
    b = grid.select(*keys, time, F.lit(None).cast(a.schema["_seen"].dataType).alias("_seen"), F.lit(1).alias("_grid"), *[c for c in grid.columns if c not in {*keys, time}])
    both = a.unionByName(b, allowMissingColumns=True)
    # Both windows run from their start: a frame that ends at the last row is computed anew for every row.
    w, back_w = Window.partitionBy(*keys).orderBy(time, "_grid"), Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("_grid").desc())
    both = both.withColumn("_before", F.last("_seen", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_after", F.last("_seen", True).over(back_w.rowsBetween(Window.unboundedPreceding, 0))).filter("_grid = 1")
    back, ahead = micros(time) - F.col("_before.us"), F.col("_after.us") - micros(time)
    limit = (tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))) * 1e6
    take_after = F.col("_after").isNotNull() & (F.col("_before").isNull() | (ahead <= back))
    gap = F.when(take_after, ahead).otherwise(back)
    pick = lambda v: F.when(gap <= limit, F.when(take_after, F.col(f"_after.{v}")).otherwise(F.col(f"_before.{v}"))).alias(v)
    return both.select(*[c for c in grid.columns if c not in values], *[pick(v) for v in values])


def whole_days(df: DataFrame, values: list[str], dt: DataFrame, keys: list[str] = KEYS, time: str = "time") -> DataFrame:
    """df on a regular grid from midnight before its first to midnight after its last row. A grid point takes the nearest row within a minute and one step. dt: (keys, dt)."""
    ends = df.groupBy(*keys).agg(F.min(micros(time)).alias("lo"), F.max(micros(time)).alias("hi")).join(dt, keys)
    day = 86_400_000_000
    lo = F.floor(F.col("lo") / day) * day
    hi = F.ceil(F.col("hi") / day) * day
    n = F.ceil((hi - lo) / (F.col("dt") * 1e6))
    # A recording of one row at midnight has no grid.
    points = ends.filter(hi > lo).select(*keys, "dt", lo.alias("lo"), F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("i"))
    grid = points.select(*keys, at_micros(F.col("lo") + F.round(F.col("i") * F.col("dt") * 1e6)).alias(time), "dt")
    return asof_nearest(grid, df, values, F.least(F.lit(60.0), F.col("dt")), keys, time).drop("dt")
