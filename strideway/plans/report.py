"""Reports: the summary of a recording as one wide row, and its tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.operators import cadence as C
from strideway.operators import clean, steps
from strideway.operators import enmo as E
from strideway.operators.bouts import bouts
from strideway.operators.grid import KEYS
from strideway.session import written

SUFFIX = {"overall": "", "weekend": "_Weekend", "weekday": "_Weekday"}
STATS = {"total": "Total{0}", "avg": "{0}DayAvg", "med": "{0}DayMed", "min": "{0}DayMin", "max": "{0}DayMax"}


def _suffix():
    return F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])[F.col("daytype")]


def _long(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(recording, metric, value) of wide rows by kind of day; columns: column -> name of the metric."""
    cells = F.array(*[F.struct(F.concat(F.lit(name), _suffix()).alias("metric"), F.col(c).cast("string").alias("value")) for c, name in columns.items()])
    return df.select("recording", F.explode(cells).alias("c")).select("recording", "c.*")


def step_metrics(summary: DataFrame, adjust: bool) -> DataFrame:
    a = "Adjusted" if adjust else ""
    return _long(steps.rounded(summary), {c: f"{n.format('Steps')}{a}" for c, n in STATS.items()})


def walk_metrics(summary: DataFrame, adjust: bool) -> DataFrame:
    a = "Adjusted" if adjust else ""
    return _long(summary, {c: f"{n.format('Walking')}{a}(mins)" for c, n in STATS.items()})


def hour_metrics(profile: DataFrame, value: str, name: str) -> DataFrame:
    metric = F.concat(F.lit(f"{name}_Hour"), F.lpad(F.col("hour").cast("string"), 2, "0"), _suffix())
    return profile.select("recording", metric.alias("metric"), F.col(value).cast("string").alias("value"))


def pivoted(metrics: DataFrame) -> DataFrame:
    """One row for each recording, one column for each metric. Names are few and known once collected; what one kind of day has, the other has too."""
    names = {r[0] for r in metrics.select("metric").distinct().collect()}
    ends = tuple(s for s in SUFFIX.values() if s)
    names = sorted(names | {n.removesuffix(e) + s for n in names for e in ends if n.endswith(e) for s in ends})
    return metrics.groupBy("recording").pivot("metric", names).agg(F.first("value"))


def full_join(frames: list[DataFrame], keys: list[str] = [*KEYS, "time"]) -> DataFrame:  # noqa: B006
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def tables(epochs: DataFrame, samples: DataFrame, dt: DataFrame | float, steptol: int = 3, min_walk_per_day: int = 5, enough: dict[str, float] = steps.ENOUGH, min_walk: float = 0.8, max_idle: int = 3) -> dict[str, DataFrame]:
    """Every table of a report by the name of its file, and Info, for any number of recordings.

    Epochs and each table are written down once, as several others are made of them."""
    epochs = written(epochs, "epochs")
    out: dict[str, DataFrame] = {}
    metrics: list[DataFrame] = []
    cadence = written(C.daily_cadence(epochs, dt, steptol, min_walk_per_day), "cadence")
    for adjust in (False, True):
        a = "Adjusted" if adjust else ""
        s = {k: written(v, k) for k, v in steps.summarize_steps(epochs, dt, steptol, adjust, enough).items()}
        e = {k: written(v, f"enmo-{k}") for k, v in E.summarize_enmo(samples, adjust, enough).items()}
        name = lambda df: df.withColumnRenamed("enmo", E.NAME)
        for grain in ("minutely", "hourly"):
            out[f"{grain.capitalize()}{a}"] = full_join([s[grain], name(e[grain])]).withColumnsRenamed({"recording": "Filename", "time": "Time"})
        daily = [s["daily"].withColumnRenamed("Walk", "Walk(mins)"), C.shown(cadence), name(e["daily"])]
        if not adjust:
            daily.append(clean.daily_wear(samples, clean.XYZ).withColumn("time", F.col("Date").cast("timestamp_ntz")).drop("Date"))
        out[f"Daily{a}"] = full_join(daily).withColumnsRenamed({"recording": "Filename", "time": "Date"})
        shares = s["share_times"].select("recording", F.explode(F.map_from_arrays(F.array(*[F.lit(f"{c[:-2]}At{a}") for c in s["share_times"].columns if c != "recording"]), F.array(*[c for c in s["share_times"].columns if c != "recording"]))).alias("metric", "value"))
        metrics += [
            step_metrics(s["steps"], adjust), walk_metrics(s["walk"], adjust), shares,
            hour_metrics(s["hour_steps"], "Steps", f"Steps{a}"), hour_metrics(s["hour_walk"], "Walk", f"Walking{a}(mins)"), hour_metrics(e["hours"], "enmo", f"ENMO{a}(mg)"),
            _long(e["averages"], {"avg": f"ENMO{a}(mg)"}), _long(C.cadence_summary(cadence, adjust), {m: n.replace("(", f"{a}(") for m, n in C.MEASURES.items()}),
        ]
    wide = pivoted(reduce(DataFrame.unionByName, metrics))
    # A recording that was never worn has its wear statistics alone.
    out["Info"] = clean.wear_stats(samples, clean.XYZ).join(wide, "recording", "left").withColumnRenamed("recording", "Filename")
    out["Bouts"] = bouts(epochs, dt, samples, steptol, min_walk, max_idle).drop("bout").withColumnRenamed("recording", "Filename")
    out["Steps"] = epochs.select("recording", "time", "Steps")
    return out
