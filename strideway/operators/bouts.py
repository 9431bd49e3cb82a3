"""Walking bouts: a scan over each recording's epochs, then plain aggregates.

A bout starts with an epoch of walking. Any other epoch, missing ones too, is idle; the bout ends
when more than max_idle idle epochs follow each other or walking falls below min_walk of it. Idle
epochs at its end don't belong to it. As where a bout starts depends on where the last one ended,
window frames can't tell; the scan is a Python loop over one recording's flags.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.operators.enmo import enmo
from strideway.operators.grid import KEYS, asof_nearest, at_micros, micros, with_first
from strideway.operators.steps import walking, with_dt


def scan(flags: Iterable[float | None], min_walk: float = 0.8, max_idle: int = 3) -> list[tuple[int, int]]:
    """(start, length) of every bout in a sequence of 1, 0 and missing."""
    out, start, ones, last = [], None, 0, 0
    i = -1
    for i, flag in enumerate(flags):
        if flag == 1:
            if start is None:
                start, ones = i, 0
            ones, last = ones + 1, i
        elif start is not None and (i - last > max_idle or ones / (i - start + 1) < min_walk):
            out.append((start, last - start + 1))
            start = None
    if start is not None:
        out.append((start, last - start + 1))
    return out


def labelled(epochs: DataFrame, steptol: int = 3, min_walk: float = 0.8, max_idle: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, Steps, bout): epochs that belong to a bout, with its number from 1."""
    rows = walking(epochs, steptol).select(*keys, "time", "Steps", "Walk")

    def mark(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("time", ignore_index=True)
        found = scan(part["Walk"].tolist(), min_walk, max_idle)
        bout = pd.Series(0, index=part.index)
        for k, (start, n) in enumerate(found, 1):
            bout.iloc[start : start + n] = k
        return part.assign(bout=bout).loc[bout > 0, [*keys, "time", "Steps", "bout"]]

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(mark, f"{kinds}, time timestamp_ntz, Steps double, bout int")


def bouts(epochs: DataFrame, dt: DataFrame | float, samples: DataFrame | None = None, steptol: int = 3, min_walk: float = 0.8, max_idle: int = 3, keys: list[str] = KEYS) -> DataFrame:
    """One row for each bout: times, minutes, steps, cadence and its spread, and ENMO if there are samples (x, y, z)."""
    own = with_dt(labelled(epochs, steptol, min_walk, max_idle, keys), dt, keys)
    if samples is not None:
        own = own.join(epoch_enmo(samples, epochs, dt, keys), [*keys, "time"], "left")
    else:
        own = own.withColumn("enmo", F.lit(None).cast("double"))
    rate = F.col("Steps") * 60 / F.col("dt")
    found = own.withColumn("rate", rate).groupBy(*keys, "bout").agg(
        F.min("time").alias("t0"), F.max("time").alias("t1"), (F.count("*") * F.first("dt") / 60).alias("Duration(mins)"), F.coalesce(F.sum("Steps"), F.lit(0.0)).alias("Steps"),
        F.when(F.count("rate") > 1, F.stddev_samp("rate")).alias("CadenceSD(steps/min)"), *[F.percentile("rate", p).alias(f"Cadence{int(p * 100)}th(steps/min)") for p in (0.25, 0.5, 0.75)],
        F.avg("enmo").alias("ENMO(mg)"), F.median("enmo").alias("ENMOMed(mg)"),
    )
    since = (micros("t0") - F.lag(micros("t1")).over(Window.partitionBy(*keys).orderBy("bout"))) / 6e7
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select(
        *keys, "bout", text("t0").alias("StartTime"), text("t1").alias("EndTime"), "Duration(mins)", since.alias("TimeSinceLast(mins)"), "Steps", (F.col("Steps") / F.col("Duration(mins)")).alias("Cadence(steps/min)"),
        "CadenceSD(steps/min)", *[f"Cadence{p}th(steps/min)" for p in (25, 50, 75)], "ENMO(mg)", "ENMOMed(mg)",
    )


def epoch_enmo(samples: DataFrame, epochs: DataFrame, dt: DataFrame | float, keys: list[str] = KEYS) -> DataFrame:
    """(keys, time, enmo): mean ENMO of bins of dt, at the nearest bin to each epoch."""
    rows = with_dt(samples.select(*keys, "time", enmo().alias("enmo")), dt, keys)
    us = F.round(F.col("dt") * 1e6).cast("long")
    # Bins start at midnight of each recording's first day.
    binned = with_first(rows, keys).withColumn("t0", F.floor(F.col("_from") / 86_400_000_000) * 86_400_000_000).withColumn("time", at_micros(F.col("t0") + F.floor((micros("time") - F.col("t0")) / us) * us))
    means = binned.groupBy(*keys, "time").agg(F.avg("enmo").alias("enmo"))
    return asof_nearest(with_dt(epochs.select(*keys, "time"), dt, keys), means, ["enmo"], F.col("dt"), keys).select(*keys, "time", "enmo")
