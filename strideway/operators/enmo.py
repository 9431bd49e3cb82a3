"""ENMO: Euclidean norm minus one, cut at zero, in mg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideway.operators.clean import XYZ, worn
from strideway.operators.grid import KEYS, day_type, resample
from strideway.operators.impute import impute_missing
from strideway.operators.steps import ENOUGH, hour_profile, over_week, period_of
from strideway.session import written

NAME = "ENMO(mg)"


def enmo(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """NULL where an axis is: greatest() would take 0 for it."""
    norm = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y) + F.col(z) * F.col(z))
    return F.when(worn([x, y, z]), F.greatest(norm - 1, F.lit(0.0)) * 1000)


def by_minute(samples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, enmo): minute means, which hours and days average in turn."""
    return resample(samples.select(*keys, "time", enmo(*XYZ).alias("enmo")), "minute", keys, enmo=F.avg("enmo"))


def summarize_enmo(samples: DataFrame, adjust: bool = False, enough: dict[str, float] = ENOUGH, keys: list[str] = KEYS) -> dict[str, DataFrame]:
    """minutely, hourly, daily (time, enmo), averages by kind of day, hour profile. Wear counts minutes with a value."""
    minutes = by_minute(samples, keys)
    if adjust:
        minutes = written(minutes, "enmo-minutes")
        minutes = written(impute_missing(minutes, ["enmo"], period=period_of(minutes, 60.0, keys), keys=keys), "enmo-imputed")
    found = {}
    for name, grain in (("minutely", "minute"), ("hourly", "hour"), ("daily", "day")):
        mean = F.avg("enmo")
        found[name] = resample(minutes, grain, keys, enmo=F.when(F.count("enmo") > enough[grain], mean) if adjust else mean)
    if adjust:
        averages = over_week(found["daily"], "enmo", keys).select(*keys, "daytype", "avg")
    else:
        averages = found["daily"].select(*keys, "enmo", F.explode(day_type("time")).alias("daytype")).groupBy(*keys, "daytype").agg(F.avg("enmo").alias("avg"))
    return found | {"averages": averages, "hours": hour_profile(found["hourly"], "enmo", keys)}
