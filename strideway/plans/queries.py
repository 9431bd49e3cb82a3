"""Queries over the driver's tables, one for each operator of the library.

The tables hold no acceleration; a recording is an event type, an epoch one hour of it, its steps
the sum of values. Times go out as text and fractions rounded, so that engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions.features import NAMES, features_of, step_peaks
from strideway.functions.scalar import whole
from strideway.operators import bouts as B
from strideway.operators import cadence as C
from strideway.operators import clean, evaluation, grid, hmm, impute, steps
from strideway.operators import enmo as E
from strideway.plans.report import full_join, pivoted, step_metrics
from strideway.plans.training import decoded, encoded, examples, resized, training_windows
from strideway.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HOUR, STEPTOL = 3600.0, 100


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def text(c: Column | str = "time") -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, time, x, y, z): three made-up axes for every event, missing for some users."""
    e = read(spark, sf, "events")
    worn = F.col("user_id") % 17 != 0
    return e.select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), F.when(worn, F.col("value") / 40).alias("x"), F.when(worn, (F.col("user_id") % 10) / 20).alias("y"), F.when(worn, F.lit(1.0)).alias("z"))


def epochs(spark: SparkSession, sf: str) -> DataFrame:
    """(recording, time, Steps) by hour, NULL in hours without events."""
    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), "value")
    return grid.resample(e, "hour", Steps=F.round(F.sum("value"), 2))


def minutes(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), "value")
    return grid.resample(e, "minute", Steps=F.round(F.sum("value"), 2))


def shown(df: DataFrame, *values: str, digits: int = 4) -> DataFrame:
    return df.select("recording", text().alias("time"), *[r(v, digits).alias(v.lower()) for v in values])


@query
def epochs_hourly_spine(spark, sf):
    return shown(epochs(spark, sf), "Steps")


@query
def steps_daily(spark, sf):
    return shown(steps.by_grain(epochs(spark, sf), "day", HOUR), "Steps").withColumn("steps", whole(F.col("steps")))


@query
def steps_hourly(spark, sf):
    return shown(steps.by_grain(epochs(spark, sf), "hour", HOUR), "Steps")


@query
def steps_minutely(spark, sf):
    return shown(steps.by_grain(minutes(spark, sf), "minute", 60.0), "Steps")


@query
def steps_daily_adjusted_gate(spark, sf):
    return shown(steps.by_grain(epochs(spark, sf), "day", HOUR, steps.ENOUGH["day"]), "Steps")


@query
def steps_summary(spark, sf):
    out = steps.over_days(steps.by_grain(epochs(spark, sf), "day", HOUR), "Steps")
    return out.select("recording", "daytype", *[r(c, 6).alias(f"{c}_steps") for c in ("total", "avg", "med", "min", "max")])


@query
def steps_summary_adjusted(spark, sf):
    full = steps.adjusted(epochs(spark, sf), "Steps", HOUR)
    out = steps.over_week(steps.by_grain(full, "day", HOUR, steps.ENOUGH["day"]), "Steps")
    return out.select("recording", "daytype", *[r(c, 6).alias(f"{c}_steps") for c in ("total", "avg", "med", "min", "max")])


@query
def walking_daily(spark, sf):
    return shown(steps.walk_minutes(epochs(spark, sf), "day", HOUR, STEPTOL), "Walk")


@query
def walking_summary(spark, sf):
    out = steps.over_days(steps.walk_minutes(epochs(spark, sf), "day", HOUR, STEPTOL), "Walk")
    return out.select("recording", "daytype", *[r(c, 6).alias(f"{c}_walk") for c in ("total", "avg", "med", "min", "max")])


@query
def short_epochs_zeroed(spark, sf):
    return shown(steps.without_short(epochs(spark, sf), STEPTOL), "Steps")


@query
def hour_profile(spark, sf):
    return steps.hour_profile(epochs(spark, sf), "Steps").select("recording", "daytype", "hour", r("Steps", 6).alias("steps"))


@query
def percentile_times_daily(spark, sf):
    out = steps.share_times(epochs(spark, sf), HOUR)
    return out.select("recording", text().alias("time"), *[F.col(c).cast("long").alias(c) for c in out.columns if c.endswith("_at")])


@query
def percentile_times_mean(spark, sf):
    out = steps.mean_share_times(steps.share_times(epochs(spark, sf), HOUR, steps.ENOUGH["day"]))
    return out.select("recording", *[F.col(c).alias(c.lower()) for c in out.columns if c != "recording"])


@query
def cadence_daily(spark, sf):
    out = C.daily_cadence(minutes(spark, sf), 60.0)
    return out.select("recording", text().alias("time"), *[r(c).alias(c) for c in C.MEASURES])


@query
def cadence_summary(spark, sf):
    return C.cadence_summary(C.daily_cadence(minutes(spark, sf), 60.0)).select("recording", "daytype", *C.MEASURES)


@query
def cadence_summary_adjusted(spark, sf):
    return C.cadence_summary(C.daily_cadence(minutes(spark, sf), 60.0), True).select("recording", "daytype", *C.MEASURES)


@query
def bouts_summary(spark, sf):
    b = B.bouts(epochs(spark, sf), HOUR, None, STEPTOL, 0.8, 3)
    names = {"StartTime": "start_time", "EndTime": "end_time", "Duration(mins)": "duration", "TimeSinceLast(mins)": "since_last", "Steps": "steps", "Cadence(steps/min)": "cadence", "CadenceSD(steps/min)": "cadence_sd", "Cadence25th(steps/min)": "cadence_25", "Cadence50th(steps/min)": "cadence_50", "Cadence75th(steps/min)": "cadence_75"}
    return b.select("recording", "bout", *[F.col(f"`{k}`").alias(v) if "time" in v else r(F.col(f"`{k}`"), 8).alias(v) for k, v in names.items()])


@query
def bouts_enmo(spark, sf):
    b = B.bouts(epochs(spark, sf), HOUR, samples(spark, sf), STEPTOL)
    return b.select("recording", "bout", "StartTime", "EndTime", r(F.col("`ENMO(mg)`")).alias("enmo"), r(F.col("`ENMOMed(mg)`")).alias("enmo_med"))


@query
def impute_missing_cascade(spark, sf):
    return shown(steps.adjusted(epochs(spark, sf), "Steps", HOUR), "Steps")


@query
def impute_missing_inside(spark, sf):
    out = impute.impute_missing(epochs(spark, sf), ["Steps"], extrapolate=False, skip_full_missing_days=False)
    return shown(out, "Steps")


def gated_days(spark, sf):
    return steps.by_grain(epochs(spark, sf), "day", HOUR, 22 * 60)


@query
def impute_days_mean(spark, sf):
    return shown(impute.impute_days(gated_days(spark, sf), ["Steps"]), "Steps")


@query
def impute_days_median(spark, sf):
    return shown(impute.impute_days(gated_days(spark, sf), ["Steps"], "median"), "Steps")


@query
def representative_week(spark, sf):
    return steps.representative_week(gated_days(spark, sf), "Steps").select("recording", "weekday", r("Steps").alias("steps"))


@query
def infer_freq(spark, sf):
    e = read(spark, sf, "events").select("user_id", F.col("ts").alias("time"))
    return grid.infer_period(e, ["user_id"]).select("user_id", r("dt", 3).alias("dt"))


@query
def sample_rate(spark, sf):
    e = read(spark, sf, "events").select("user_id", (F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("t"))
    fast = e.select("user_id", grid.at_micros(grid.micros("t") / 1_000_000).alias("time"))  # a million times faster
    return grid.sample_rate(fast, ["user_id"]).select("user_id", "rate")


@query
def wear_stats(spark, sf):
    out = clean.wear_stats(samples(spark, sf), clean.XYZ, steps.period_of(samples(spark, sf), 60.0))
    names = {"StartTime": "start_time", "EndTime": "end_time", "WearStartTime": "wear_start", "WearEndTime": "wear_end", "Covers24hOK": "covers24h"}
    return out.select("recording", *[F.col(k).alias(v) for k, v in names.items()], r(F.col("`WearTime(days)`"), 6).alias("wear_days"), r(F.col("`NonwearTime(days)`"), 6).alias("nonwear_days"))


@query
def wear_daily(spark, sf):
    out = clean.daily_wear(samples(spark, sf), clean.XYZ, steps.period_of(samples(spark, sf), 60.0))
    return out.select("recording", F.col("Date").cast("string").alias("date"), F.col("`WearTime(hours)`").alias("wear_hours"))


@query
def nothing_worn(spark, sf):
    s = read(spark, sf, "events").select(F.col("user_id").alias("recording"), F.when(F.col("user_id") % 17 != 0, F.col("value")).alias("x"))
    return clean.nothing_worn(s, ["x"])


@query
def flag_wear_below_days(spark, sf):
    return shown(clean.blank_days_below(epochs(spark, sf), "22H", ["Steps"], steps.period_of(epochs(spark, sf), HOUR)), "Steps")


@query
def drop_first_last_days(spark, sf):
    return shown(clean.drop_first_last_days(epochs(spark, sf)), "Steps")


@query
def time_trim(spark, sf):
    return shown(clean.trim(epochs(spark, sf), "2024-01-03 05", "2024-01-10"), "Steps")


@query
def dedup_keep_first(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("time"), "event_id", "value")
    return clean.first_of_duplicates(e, "event_id").select("recording", text().alias("time"), "event_id", "value")


@query
def windows_origin_start(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), "value")
    out = grid.windows_from_start(e, 7200, ["value"])
    return out.select("recording", text("window_start").alias("window_start"), "n", r(F.aggregate("value", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query
def window_length_policy(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, F.lit(1) + (F.col("vec_id") % 64).cast("int")).alias("v"))
    out = e.select("vec_id", F.size("v").alias("n"), grid.fixed_length(F.col("v"), 40).alias("w"))
    total = F.aggregate("w", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return out.select("vec_id", "n", F.size("w").cast("int").alias("length"), r(F.col("w")[39].cast("double"), 6).alias("last"), r(total, 4).alias("total")).withColumn("length", F.when(F.col("last").isNotNull(), F.col("length")))


@query
def windows_by_count(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), "value")
    out = grid.windows_by_count(e, 50, 20, ["value"])
    return out.select("recording", "window", text("first").alias("first"), text("last").alias("last"), r(F.aggregate("value", F.lit(0.0), lambda a, v: a + v), 2).alias("total"))


@query
def windows_training(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("pid"), F.col("ts").alias("time"), *[F.lit(1.0).alias(a) for a in "xyz"], (F.col("user_id") % 7 == 0).cast("int").alias("annotation"))
    out = training_windows(e, 7200, 4, steptol=2)
    return out.select("pid", text("window_start").alias("window_start"), "n", "steps", "walk")


@query
def asof_nearest_tolerance(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), "event_id")
    points = grid.spine(e, "hour").select("recording", "time")
    return grid.asof_nearest(points, e, ["event_id"], 600.0).select("recording", text().alias("time"), "event_id")


@query
def grain_outer_join(spark, sf):
    days = steps.by_grain(epochs(spark, sf), "day", HOUR).filter(F.dayofmonth("time") > 3)
    wear = clean.daily_wear(samples(spark, sf), clean.XYZ, steps.period_of(samples(spark, sf), 60.0)).withColumn("time", F.col("Date").cast("timestamp_ntz")).filter(F.dayofmonth("time") < 20)
    return full_join([days, wear]).select("recording", text().alias("time"), r("Steps").alias("steps"), F.col("`WearTime(hours)`").alias("wear_hours"))


@query
def enmo_vector(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 25).alias("x"), F.col("l_discount").alias("y"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("z"))
    return li.select("l_orderkey", "l_linenumber", r(E.enmo(), 3).alias("enmo"))


@query
def enmo_daily(spark, sf):
    return shown(E.summarize_enmo(samples(spark, sf))["daily"], "enmo")


@query
def enmo_hour_profile(spark, sf):
    return E.summarize_enmo(samples(spark, sf))["hours"].select("recording", "daytype", "hour", r("enmo").alias("enmo"))


@query
def enmo_averages(spark, sf):
    return E.summarize_enmo(samples(spark, sf))["averages"].select("recording", "daytype", r("avg").alias("avg_enmo"))


@query
def enmo_adjusted_daily(spark, sf):
    return shown(E.summarize_enmo(samples(spark, sf), True, {"minute": 0.5, "hour": 50, "day": 600})["daily"], "enmo", digits=3)


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query
def features_all(spark, sf):
    x = vectors(spark, sf).select("vec_id", F.transform("v", lambda a: a * 4).alias("x"), F.transform("v", lambda a: a * 0).alias("y"), F.transform("v", lambda a: a * 0 + 1).alias("z"))
    out = x.select("vec_id", features_of(F.col("x"), F.col("y"), F.col("z"), 15).alias("f"))
    return out.select("vec_id", *[r(f"f.{n}").alias(n) for n in NAMES])


@query
def steps_from_windows(spark, sf):
    x = vectors(spark, sf).select("vec_id", F.transform("v", lambda a: a * 4).alias("x"), F.transform("v", lambda a: a * 0).alias("y"), F.transform("v", lambda a: a * 0 + 1).alias("z"))
    out = x.select("vec_id", step_peaks(F.col("x"), F.col("y"), F.col("z"), 15, 0.5, 0.2).alias("times"))
    return out.select("vec_id", F.size("times").alias("steps"), F.transform("times", lambda t: F.round(t, 4)).alias("times"))


@query
def windows_resized(spark, sf):
    out = resized(vectors(spark, sf), "v", 20)
    return out.select("vec_id", F.size("v").alias("n"), r(F.col("v")[0]).alias("first"), r(F.col("v")[7]).alias("eighth"), r(F.col("v")[19]).alias("last"))


@query
def hmm_transition(spark, sf):
    out = hmm.transition(read(spark, sf, "conversations"), "role", "turn", ["conv_id"])
    return out.select(F.col("from").alias("from_label"), F.col("to").alias("to_label"), r("p", 6).alias("p"))


@query
def hmm_emission(spark, sf):
    out = hmm.emission(read(spark, sf, "labels"), "quality", "toxic")
    return out.select("label", "predicted", r("p", 6).alias("p"))


@query
def hmm_prior(spark, sf):
    return hmm.prior(read(spark, sf, "labels"), "quality", False).select("label", r("p", 6).alias("p"))


@query
def group_lengths(spark, sf):
    d = read(spark, sf, "documents")
    return hmm.group_lengths(d, "source", "doc_id").select("source", "n", F.col("first").alias("first_doc"))


@query
def viterbi_smooth(spark, sf):
    lab = read(spark, sf, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"), (F.col("doc_id") % 7).cast("int").alias("g"))
    import numpy as np

    s = hmm.Smoother([0, 1], np.array([0.5, 0.5]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([[0.9, 0.1], [0.2, 0.8]]))
    return s.predict(lab, "toxic", "doc_id", ["g"]).select("doc_id", "g", "toxic", "smoothed")


def scored(spark, sf):
    return read(spark, sf, "labels").select("doc_id", F.col("quality").cast("int").alias("t"), F.when(F.col("doc_id") % 3 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("int").alias("p"), (F.col("doc_id") % 5).cast("int").alias("fold"), (F.col("doc_id") * 37 % 101 / 100.0 + F.col("quality") * 0.2).alias("score"))


@query
def sample_weight(spark, sf):
    return evaluation.sample_weight(scored(spark, sf), "t", 2.0).select("doc_id", "t", r("weight", 6).alias("weight"))


@query
def weighted_metrics(spark, sf):
    out = evaluation.classification(evaluation.sample_weight(scored(spark, sf), "t", 1.0), "t", "p", F.col("weight"), ["fold"])
    return out.select("fold", *[r(c, 6).alias(c) for c in out.columns if c != "fold"])


def counted(spark, sf):
    return scored(spark, sf).select("doc_id", "fold", (F.col("doc_id") % 4 * F.col("t")).cast("double").alias("t"), (F.col("doc_id") % 3).cast("double").alias("p"), (1 + F.col("doc_id") % 2).cast("double").alias("w"))


@query
def regression_metrics(spark, sf):
    out = evaluation.regression(counted(spark, sf), "t", "p", F.col("w"), ["fold"])
    return out.select("fold", *[r(c, 6).alias(c) for c in out.columns if c != "fold"])


@query
def fold_summary(spark, sf):
    m = evaluation.classification(scored(spark, sf), "t", "p", None, ["fold"])
    out = evaluation.over_folds(m, ["accuracy", "f1", "precision", "recall", "balanced_accuracy"])
    return out.select("metric", *[r(c, 6).alias(c.lower()) for c in out.columns if c != "metric"])


@query
def class_report(spark, sf):
    out = evaluation.class_report(scored(spark, sf), "t", "p")
    return out.select("class", *[r(c, 6).alias(c) for c in out.columns if c != "class"])


@query
def calibrate_threshold(spark, sf):
    out = evaluation.calibrate(scored(spark, sf), "score", "t", None, 0.62, 0.8)
    return out.select("goal", *[r(c, 6).alias(c) for c in out.columns if c != "goal"])


@query
def groupkfold(spark, sf):
    return evaluation.ordered_folds(read(spark, sf, "documents"), "source", "doc_id", 6).select("source", "fold")


@query
def class_weights(spark, sf):
    return evaluation.class_weights(scored(spark, sf), "t").select(r("notwalk", 6).alias("notwalk"), "walk")


@query
def plot_data(spark, sf):
    out = steps.plot_data(minutes(spark, sf))
    return out.select("recording", F.col("day").cast("string").alias("day"), text().alias("time"), r("Steps").alias("steps"), "missing")


@query
def info_pivot(spark, sf):
    out = pivoted(step_metrics(steps.over_days(steps.by_grain(epochs(spark, sf), "day", HOUR), "Steps"), False))
    return out.select("recording", *[F.col(c).alias(c.lower()) for c in sorted(out.columns) if c != "recording"])


@query
def labels_encoded(spark, sf):
    """Roles as positions among the labels in order, and back."""
    c = read(spark, sf, "conversations")
    labels = hmm.labels_of(c, "role")
    at = encoded(F.col("role"), labels)
    return c.select("conv_id", "turn", "role", at.alias("code"), decoded(at, labels).alias("again"))


@query
def ordered_distinct(spark, sf):
    return grid.ordered_distinct(read(spark, sf, "documents"), "source", "doc_id")


@query
def example_windows(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_type").alias("pid"), F.col("ts").alias("time"), *[F.lit(1.0).alias(a) for a in "xyz"], (F.col("user_id") % 7 == 0).cast("int").alias("annotation"))
    return examples(training_windows(e, 7200, 4, steptol=2)).select("pid", text("window_start").alias("window_start"), "n", "walk")


@query
def windows_mapped(spark, sf):
    """A function of one's own over each window: its rows and the spread of its values."""
    import pandas as pd

    def spread(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"recording": part["recording"][:1], "window_start": part["window_start"][:1], "n": [len(part)], "spread": [part["value"].max() - part["value"].min()]})

    e = read(spark, sf, "events").select(F.col("event_type").alias("recording"), F.col("ts").alias("time"), "value")
    out = grid.map_windows(e, 86400, spread, "recording string, window_start timestamp_ntz, n long, spread double")
    return out.select("recording", text("window_start").alias("window_start"), "n", r("spread", 2).alias("spread"))
