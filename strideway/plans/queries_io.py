"""Queries over sources, sinks and reports: tables are written by the library, read back by it, and compared.

Files go to the folder that driver and executors share. Recordings have no names of their own in
them, as these are paths; times go out as text."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions.scalar import path_parts, spark_pattern
from strideway.operators import clean, evaluation, steps
from strideway.operators.grid import windows_from_start
from strideway.plans import report
from strideway.plans.model import NetworkDetector, StepModel, ThresholdDetector, complete
from strideway.plans.queries import HOUR, STEPTOL, epochs, query, r, read, samples, scored, text
from strideway.plans.training import kept, read_training_windows, training_windows, write_training
from strideway.session import shared_top
from strideway.sources import devices, readers, sinks

#: Fixed values of these queries.
FORMAT = "%d/%m/%Y %H:%M:%S"
FIRST = 1704067200


def folder(spark: SparkSession) -> str:
    return f"{shared_top(spark)}/files-{uuid.uuid4().hex}"


def numbered(spark, sf) -> DataFrame:
    """One sample a second, one for each event."""
    e = read(spark, sf, "events")
    at = F.timestamp_seconds(F.lit(FIRST) + F.col("event_id")).cast("timestamp_ntz")
    return e.select("event_id", text(at).alias("when"), F.col("value").alias("a"), (F.col("user_id") % 10).cast("double").alias("b"), F.lit(1.0).alias("c"))


def seen(df: DataFrame) -> DataFrame:
    return df.select(text().alias("time"), *[r(a) for a in "xyz"]).withColumnsRenamed({f"round({a}, 4)": a for a in "xyz"})


@query
def csv_recordings(spark, sf):
    """Columns by name, from gzipped files."""
    path = f"{folder(spark)}/rec.csv.gz"
    sinks.write_csv(numbered(spark, sf), path)
    return seen(readers.read_recording(spark, path, readers.CsvOptions(usecols="when,a,b,c")))


@query
def csv_by_position(spark, sf):
    """Columns by position, axes in another order."""
    path = f"{folder(spark)}/rec.csv.gz"
    sinks.write_csv(numbered(spark, sf), path)
    return seen(readers.read_recording(spark, path, readers.CsvOptions(txyz_idxs="1,3,2,4")))


@query
def csv_row_range(spark, sf):
    """Rows 10 to 500 of a file, the last one included."""
    path = f"{folder(spark)}/rec.csv.gz"
    sinks.write_csv(numbered(spark, sf).repartitionByRange(1, "event_id").sortWithinPartitions("event_id"), path)
    return seen(readers.read_recording(spark, path, readers.CsvOptions(usecols="when,a,b,c", start_row=10, end_row=500)))


@query
def csv_time_format(spark, sf):
    path = f"{folder(spark)}/rec.csv.gz"
    sinks.write_csv(numbered(spark, sf).withColumn("when", F.date_format(F.col("when").cast("timestamp_ntz"), spark_pattern(FORMAT))), path)
    return seen(readers.read_recording(spark, path, readers.CsvOptions(usecols="when,a,b,c", time_format=FORMAT)))


@query
def csv_duplicate_times(spark, sf):
    """Of rows of one time the first one of the file stays; the recording is trimmed."""
    path = f"{folder(spark)}/rec.csv.gz"
    rows = numbered(spark, sf).withColumn("when", text(F.timestamp_seconds(F.lit(FIRST) + F.floor(F.col("event_id") / 3) * 60).cast("timestamp_ntz")))
    sinks.write_csv(rows.repartitionByRange(1, "event_id").sortWithinPartitions("event_id"), path)
    return seen(readers.read_recording(spark, path, readers.CsvOptions(usecols="when,a,b,c"), "2024-01-01 01", "2024-01-01 20"))


@query
def parquet_recordings(spark, sf):
    path = f"{folder(spark)}/rec.parquet"
    numbered(spark, sf).select(F.col("when").cast("timestamp_ntz").alias("time"), F.col("a").alias("x"), F.when(F.col("b") > 0, F.col("b")).otherwise(F.lit(float("nan"))).alias("y"), F.col("c").alias("z")).write.parquet(path)
    return seen(readers.read_recording(spark, path))


@query
def device_recordings(spark, sf):
    """Binary files by a parser of one's own, several at once."""
    top = folder(spark)
    kinds = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("low")).collect()  # a row for each kind
    for k in kinds:
        sinks.put(spark, f"{top}/{k.event_type}.bin", b"".join(struct.pack("<qfff", (FIRST + i) * 1_000_000, k.n, k.low, i) for i in range(3)))
    found = devices.read_device(spark, f"{top}/*.bin", lambda content: struct.iter_unpack("<qfff", content))
    return found.select(path_parts(F.col("recording"))["name"].alias("recording"), text().alias("time"), "x", "y", "z", "row")


@query
def training_csv(spark, sf):
    """Labelled files of three people, who are told by their folders."""
    top = folder(spark)
    e = read(spark, sf, "events").select(F.col("ts").alias("timestamp"), F.col("value").alias("x"), F.lit(0.5).alias("y"), F.lit(1.0).alias("z"), (F.col("user_id") % 3).alias("annotation"), "event_id")
    for k in range(3):
        sinks.write_csv(e.filter(F.col("event_id") % 3 == k).drop("event_id"), f"{top}/P0{k}")
    return readers.read_training(spark, f"{top}/P*").select("pid", text().alias("time"), r("x").alias("x"), "y", "z", "annotation")


@query
def training_written(spark, sf):
    """Training windows, written and read again."""
    path = folder(spark)
    e = read(spark, sf, "events").select(F.col("event_type").alias("pid"), F.col("ts").alias("time"), *[F.lit(1.0).alias(a) for a in "xyz"], (F.col("user_id") % 7 == 0).cast("int").alias("annotation"))
    write_training(training_windows(e, 7200, 4, steptol=2), path)
    return read_training_windows(spark, path).select("pid", text("window_start").alias("window_start"), F.size("x").alias("length"), F.aggregate("z", F.lit(0.0), lambda a, b: a + b).alias("z"), "steps", "walk")


@query
def training_kept(spark, sf):
    """Windows of 8 samples that last some three hours and lack nothing."""
    w = windows_from_start(samples(spark, sf).withColumn("at", F.col("time")), 10_800, ["at", "x", "y", "z"])
    w = w.filter("n > 0").withColumns({"first": F.col("at")[0], "last": F.element_at("at", -1)}).withColumn("n", F.least("n", F.lit(8)))
    out = kept(w, 8, 10_400)
    return out.select("recording", text("window_start").alias("window_start"), "n", text("last").alias("last"))


@query
def infos_read(spark, sf):
    """A summary for each recording as JSON, read again as one table: columns of any, NULL where a recording has none."""
    top = folder(spark)
    e = read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max("user_id").alias("high"))
    for k in e.collect():  # a row for each recording
        info = {"Filename": k.event_type, "TotalSteps": k.n, "Sum": k.total} | ({"High": k.high} if k.n % 2 else {})
        sinks.write_info(info, f"{top}/{k.event_type}/{k.event_type}-Info.json", spark)
    out = readers.read_infos(spark, top)
    high = F.col("High").cast("long") if "High" in out.columns else F.lit(None).cast("long")
    return out.select(F.col("Filename").alias("filename"), F.col("TotalSteps").alias("total_steps"), F.col("Sum").alias("sum"), high.alias("high"))


@query
def results_collated(spark, sf):
    """Daily results of each recording, columns in different orders, collated into one table."""
    top = folder(spark)
    days = steps.by_grain(epochs(spark, sf), "day", HOUR).select(F.col("recording").alias("Filename"), text().alias("Date"), r("Steps").alias("Steps"))
    names = sorted(x[0] for x in days.select("Filename").distinct().collect())  # names only
    for i, n in enumerate(names):
        own = days.filter(F.col("Filename") == n)
        sinks.write_one(own if i % 2 else own.select("Steps", "Filename", "Date").withColumn("Extra", F.lit(i)), f"{top}/in/{n}/{n}-Daily.csv.gz")
    done = sinks.collate(spark, f"{top}/in", f"{top}/out", ["daily", "hourly"])
    out = spark.read.option("header", True).csv(done["Daily"])
    return out.select(F.col("Filename").alias("filename"), F.col("Date").alias("date"), F.col("Steps").cast("double").alias("steps"), F.col("Extra").cast("int").alias("extra"), F.lit(",".join(sorted(done))).alias("kinds"))


@query
def results_united(spark, sf):
    """Result files of one kind whose headers differ, united by name."""
    top = folder(spark)
    sinks.write_one(read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("key")), f"{top}/a/n-Hourly.csv.gz")
    sinks.write_one(read(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("key"), F.col("r_name").alias("name"), F.lit("region").alias("kind")), f"{top}/r-Hourly.csv.gz")
    return readers.read_results(spark, top, "Hourly").select("name", F.col("key").cast("int").alias("key"), "kind")


@query
def files_found(spark, sf):
    """Files with an extension in any case, packed or not."""
    top = folder(spark)
    for i, name in enumerate(sorted(x[0] for x in read(spark, sf, "events").select("event_type").distinct().collect())):
        sinks.put(spark, f"{top}/d{i % 2}/{name}{('.cwa', '.CWA.gz', '.cwa.zip', '.txt')[i % 4]}", b"x")
    found = [p.rsplit("/", 1)[1] for p in readers.find(spark, top, ".cwa")]
    return spark.createDataFrame([(p,) for p in found], "name string")


@query
def file_digests(spark, sf):
    top = folder(spark)
    for x in read(spark, sf, "region").collect():
        sinks.put(spark, f"{top}/{x.r_regionkey}.txt", x.r_name.encode())
    return readers.digests(spark, top).select(path_parts(F.col("path"))["name"].alias("name"), "md5")


@query
def path_split(spark, sf):
    """Folder, name and first suffix of a path made for each document."""
    ends = F.array(*[F.lit(x) for x in (".csv.gz", ".cwa", "", ".b.csv")])
    path = F.concat(F.lit("/data/"), F.coalesce("source", F.lit("none")), F.lit("/d"), F.col("doc_id"), F.element_at(ends, (F.col("doc_id") % 4 + 1).cast("int")))
    return read(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in path_parts(path).items()])


@query
def commands_listed(spark, sf):
    """The command of each recording, written and read as text."""
    path = folder(spark)
    names = [f"/in/a.b/{x[0]}.cwa.gz" for x in read(spark, sf, "events").select("event_type").distinct().collect()]
    sinks.put(spark, f"{path}/commands.txt", "".join(f"{c}\n" for c in sinks.commands(names, "/in", "/out", "-q")).encode())
    return spark.read.text(path).select(F.col("value").alias("command"))


@query
def metrics_shown(spark, sf):
    """Names of metrics that a summary for the eye keeps."""
    m = report.step_metrics(steps.over_days(steps.by_grain(epochs(spark, sf), "day", HOUR), "Steps"), False)
    m = m.unionByName(report.hour_metrics(steps.hour_profile(epochs(spark, sf), "Steps"), "Steps", "Steps"))
    names = [x[0] for x in m.select("metric").distinct().collect()]  # some hundred
    return spark.createDataFrame([(x,) for x in sinks.shown(names)], "metric string")


@query
def steps_written(spark, sf):
    """Steps as gzipped CSV, read again."""
    path = f"{folder(spark)}/Steps.csv.gz"
    sinks.write_csv(epochs(spark, sf).select("recording", text().alias("time"), "Steps"), path)
    return spark.read.option("header", True).csv(path).select("recording", "time", F.col("Steps").cast("double").alias("steps"))


@query
def step_times(spark, sf):
    """The time of every step of windows that tell theirs as seconds from their start."""
    e = epochs(spark, sf).withColumn("times", F.when(F.col("Steps") >= STEPTOL, F.array(F.lit(0.25), F.lit(1.5), F.lit(59.0))))
    path = f"{folder(spark)}/StepTimes.csv.gz"
    sinks.write_csv(StepModel.step_times(e).select("recording", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSS").alias("time")), path)
    return spark.read.option("header", True).csv(path).select("recording", "time")


@query
def windows_judged(spark, sf):
    """Windows that lack nothing are judged, others have NULL."""
    w = windows_from_start(samples(spark, sf), 21_600, ["x", "y", "z"])
    judged = ThresholdDetector(0.35).predict(w.filter(complete()))
    return w.join(judged, ["recording", "window_start"], "left").select("recording", text("window_start").alias("window_start"), "n", F.col("Walk").cast("int").alias("walk"))


@query
def network_windows(spark, sf):
    """A stand-in for a network, loaded once in each task, over windows as (axes, time)."""

    def load():
        return lambda w: __import__("numpy").stack([w[:, 0].mean(-1), w[:, 1].max(-1) + w[:, 2, 0]], 1)

    e = read(spark, sf, "embeddings").select(F.col("vec_id").alias("recording"), F.lit(0).alias("window_start"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    w = e.withColumns({"y": F.transform("x", lambda v: v / 2), "z": F.transform("x", lambda v: v - 0.25)})
    net = NetworkDetector(load, batch_size=7)
    found = net.logits(w).select("recording", r(F.col("logits")[0], 6).alias("l0"), r(F.col("logits")[1], 6).alias("l1"))
    return found.join(net.predict(w).select("recording", F.col("Walk").alias("walk")), "recording").withColumnRenamed("recording", "vec_id")


@query
def group_split(spark, sf):
    """A fifth of the groups, rounded up, held out."""
    d = read(spark, sf, "conversations").withColumn("g", F.col("conv_id") % 13)
    train, test = evaluation.held_out(d, "g", 0.2, 123)
    mark = lambda df, name: df.groupBy("g").agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return mark(train, "train").unionByName(mark(test, "test"))


@query
def cross_predicted(spark, sf):
    """Each row's prediction is the mean score of the other folds."""
    rows = scored(spark, sf).drop("fold").withColumn("g", F.col("doc_id") % 10)
    folds = evaluation.ordered_folds(rows, "g", "doc_id", 4)

    def fit(train):
        mean = train.agg(F.avg("score")).first()[0]
        return lambda test: test.withColumn("predicted", F.lit(mean))

    return evaluation.cross_predict(rows, folds, "g", fit).select("doc_id", "fold", r("predicted", 6).alias("predicted"))


_KEPT: dict[tuple[str, str], dict[str, DataFrame]] = {}


def _tables(spark, sf) -> dict[str, DataFrame]:
    """All tables of a report; made once for several queries of a session."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _KEPT:
        _KEPT[at] = report.tables(epochs(spark, sf), samples(spark, sf), HOUR, STEPTOL)
    return _KEPT[at]


def _grain(df: DataFrame, time: str) -> DataFrame:
    return df.select(F.col("Filename").alias("filename"), text(time).alias("time"), F.col("Steps").alias("steps"), r(F.col("`ENMO(mg)`")).alias("enmo"))


@query
def report_hourly(spark, sf):
    return _grain(_tables(spark, sf)["Hourly"], "Time")


@query
def report_minutely(spark, sf):
    return _grain(_tables(spark, sf)["Minutely"], "Time")


@query
def report_daily(spark, sf):
    df = _tables(spark, sf)["Daily"]
    return _grain(df.withColumnRenamed("Date", "d"), "d").join(df.select(F.col("Filename").alias("filename"), text("Date").alias("time"), F.col("`Walk(mins)`").alias("walk")), ["filename", "time"])


@query
def report_info(spark, sf):
    info = _tables(spark, sf)["Info"]
    names = [f"{n}{s}" for n in ("TotalSteps", "StepsDayAvg", "StepsDayMed", "StepsDayMin", "StepsDayMax") for s in report.SUFFIX.values()]
    return info.select(F.col("Filename").alias("recording"), *[F.col(n).alias(n.lower()) for n in names])


@query
def report_bouts(spark, sf):
    b = _tables(spark, sf)["Bouts"]
    return b.select(F.col("Filename").alias("filename"), F.col("StartTime").alias("start_time"), F.col("EndTime").alias("end_time"), r(F.col("`Duration(mins)`"), 8).alias("duration"), r("Steps", 8).alias("steps"), r(F.col("`ENMO(mg)`")).alias("enmo"))


@query
def report_unworn(spark, sf):
    """A recording that was never worn keeps its wear statistics and has no steps."""
    s = samples(spark, sf)
    none = F.col("recording") == "click"
    s = s.withColumns({a: F.when(~none, F.col(a)) for a in "xyz"})
    e = epochs(spark, sf).withColumn("Steps", F.when(~none, F.col("Steps")))
    wear = clean.wear_stats(s, clean.XYZ).select("recording", F.col("WearStartTime").isNotNull().alias("worn"))
    total = steps.over_days(steps.by_grain(e, "day", HOUR), "Steps").filter("daytype = 'overall'").select("recording", r("total", 2).alias("total"))
    return wear.join(total, "recording", "left")
