"""Operators against small pandas versions, and sources, sinks, model and streams end to end."""

import datetime as dt
import gzip
import lzma
import shlex
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideway import cli
from strideway.functions.scalar import md5_of
from strideway.operators import clean, evaluation, grid, hmm, impute, prepare, steps
from strideway.plans.model import ForestDetector, NetworkDetector, StepModel, ThresholdDetector
from strideway.plans.report import tables
from strideway.plans.training import augmented
from strideway.sources import readers, sinks
from strideway.streaming import minutes as S

START = dt.datetime(2024, 1, 15)


def frame(spark, times, values, name="Steps", recording="r"):
    return spark.createDataFrame([(recording, t, None if pd.isna(v) else float(v)) for t, v in zip(times, values)], f"recording string, time timestamp_ntz, {name} double")


def walk_signal(n, rate=25, hz=2.0):
    t = np.arange(n) / rate
    return 0.3 * np.sin(2 * np.pi * hz * t), 0 * t, 1 + 0.5 * np.sin(2 * np.pi * hz * t)


def recording(spark, name="r", minutes=6, rate=25, walking=(2, 4)):
    n = minutes * 60 * rate
    x, y, z = walk_signal(n, rate)
    still = np.ones(n, bool)
    still[walking[0] * 60 * rate : walking[1] * 60 * rate] = False
    x, z = np.where(still, 0.0, x), np.where(still, 1.0, z)
    times = [START + dt.timedelta(microseconds=i * 1_000_000 // rate) for i in range(n)]
    return spark.createDataFrame(pd.DataFrame({"recording": name, "time": times, "x": x, "y": y, "z": z}), "recording string, time timestamp_ntz, x double, y double, z double")


def test_impute_missing_like_pandas(spark):
    rng = np.random.default_rng(1)
    index = pd.date_range(START + dt.timedelta(hours=5), periods=9 * 24 * 6, freq="10min")
    v = pd.Series(rng.normal(size=len(index)), index)
    v[rng.random(len(v)) < 0.3] = np.nan
    v[v.index.date == dt.date(2024, 1, 18)] = np.nan
    v[v.index.hour == 13] = np.nan
    full = v.reindex(pd.date_range("2024-01-15", "2024-01-25", freq="10min", inclusive="left"), method="nearest", tolerance="1min", limit=1)
    empty = v.isna().groupby(v.index.date).all()
    slot = full.index.hour * 12 + full.index.minute // 5
    for by in (full.index.weekday, full.index.weekday >= 5, np.zeros(len(full))):
        full = full.fillna(full.groupby([by, slot]).transform("mean"))
    full[np.isin(full.index.date, empty[empty].index)] = np.nan
    full = full[full.index < pd.Timestamp(v.index[-1]).ceil("D")]
    got = impute.impute_missing(frame(spark, v.index.to_pydatetime(), v.to_numpy()), ["Steps"]).toPandas().set_index("time")["Steps"].sort_index()
    assert len(got) == len(full) and np.allclose(got.to_numpy(float), full.to_numpy(float), equal_nan=True)


def test_asof_like_reindex(spark):
    rng = np.random.default_rng(2)
    at = START + pd.to_timedelta(np.sort(rng.choice(3000, 200, replace=False)), unit="s")
    seen = pd.Series(np.arange(200.0), pd.DatetimeIndex(at))
    points = pd.date_range(START, periods=420, freq="7s")
    want = seen.reindex(points, method="nearest", tolerance="10s")
    grid_df = frame(spark, points.to_pydatetime(), np.zeros(len(points)), "_").select("recording", "time")
    got = grid.asof_nearest(grid_df, frame(spark, seen.index.to_pydatetime(), seen.to_numpy(), "v"), ["v"], 10.0).toPandas().set_index("time")["v"].sort_index()
    assert np.allclose(got.to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_impute_days(spark):
    days = [START + dt.timedelta(days=i) for i in range(7)]
    v = [100, None, 120, 110, None, 90, 100]
    got = {r.time.day: r.v for r in impute.impute_days(frame(spark, days, v, "v"), ["v"]).collect()}
    assert got[16] == pytest.approx((100 + 120 + 110) / 3) and got[19] == got[16]
    none = impute.impute_days(frame(spark, days, [None] * 7, "v"), ["v"], "median").collect()
    assert all(r.v is None for r in none)
    with pytest.raises(ValueError):
        impute.impute_days(frame(spark, days, v, "v"), ["v"], "mode")


def test_trim_takes_whole_days_and_exact_ends(spark):
    times = [START + dt.timedelta(hours=i) for i in range(72)]
    df = frame(spark, times, range(72))
    assert clean.trim(df, "2024-01-16", "2024-01-16").count() == 24
    assert clean.trim(df, "2024-01-16 05:00:00", "2024-01-16 07:00:00").count() == 3
    assert clean.trim(df, None, "2024-01-15 03").count() == 4
    assert clean.drop_first_last_days(df, "first").count() == 48 and clean.drop_first_last_days(df, "none").count() == 72
    kept = clean.blank_days_below(df.withColumn("Steps", F.when(F.hour("time") < 12, F.col("Steps"))), "12H", ["Steps"])
    assert kept.filter("Steps is not null").count() == 36  # just enough is enough


def test_hmm_parameters(spark):
    y = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 1, 1, 0, 0, 1])], "t int, y int")
    assert {(r["from"], r["to"]): r.p for r in hmm.transition(y, "y", "t").collect()} == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.5, (1, 1): 0.5}
    long = [int(x) for x in np.random.default_rng(4).integers(0, 3, 500)]
    long[100] = None
    pairs = [(a, b) for a, b in zip(long, long[1:]) if b is not None and a is not None]
    said = {(r["from"], r["to"]): r.p for r in hmm.transition(spark.createDataFrame(list(enumerate(long)), "t int, y int"), "y", "t").collect()}
    assert said == {(a, b): pytest.approx(pairs.count((a, b)) / sum(x == a for x, _ in pairs)) for a in range(3) for b in range(3)}
    with pytest.raises(ValueError):
        hmm.transition(spark.range(hmm.MOST_LABELS + 1), "id", "id")
    p = spark.createDataFrame([(0, 0.9, 0.1), (0, 0.8, 0.2), (1, 0.1, 0.9), (1, 0.2, 0.8)], "y int, a double, b double")
    assert {r.label: (round(r.p0, 9), round(r.p1, 9)) for r in hmm.emission(p, "y", ["a", "b"]).collect()} == {0: (0.85, 0.15), 1: (0.15, 0.85)}
    q = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 1]], "y int")
    assert {r.label: r.p for r in hmm.prior(q, "y", False).collect()} == {0: 0.6, 1: 0.4}
    g = spark.createDataFrame([(i, v) for i, v in enumerate("CCAAAB")], "i int, g string")
    assert [r.n for r in hmm.group_lengths(g, "g", "i").orderBy("first").collect()] == [2, 3, 1]


def test_smoother_repairs_single_slips(spark):
    truth = [0] * 30 + [1] * 30 + [0] * 30
    said = list(truth)
    for i in (10, 40, 70):
        said[i] = 1 - said[i]
    df = spark.createDataFrame([(g, i, t, p) for g in "ab" for i, (t, p) in enumerate(zip(truth, said))], "g string, i int, t int, p int")
    s = hmm.Smoother().fit(df, "p", "t", "i", ["g"])
    assert s.predict(df, "p", "i", ["g"]).filter("smoothed <> t").count() == 0
    with pytest.raises(NotImplementedError):
        s.predict_proba(df, "p", "i", ["g"])
    s.n_components, s.n_trials = 2, 1
    got = s.predict_proba(df, "p", "i", ["g"]).first()
    assert sum(got.probability) == pytest.approx(1)


def test_sample_weights(spark):
    y = spark.createDataFrame([(v,) for v in [0, 0, 0, 1, 1]], "y int")
    assert [round(r.weight, 9) for r in evaluation.sample_weight(y, "y", 1.0).orderBy("y").collect()] == [round(2 / 3, 9)] * 3 + [1, 1]
    assert all(r.weight == 1 for r in evaluation.sample_weight(y, "y").collect())
    train, test = evaluation.held_out(spark.range(1000).withColumn("g", F.col("id") % 50), "g")
    assert train.count() + test.count() == 1000 and train.join(test, "g").isEmpty()


def test_prepare(spark):
    base = recording(spark, minutes=4, walking=(0, 2))
    off = prepare.nonwear_blanked(base, patience_minutes=1)
    assert off.filter("x is null").count() == 2 * 60 * 25 and off.count() == base.count()
    assert prepare.calibrated(base).filter("abs(z - 1) < 1e-9 and x = 0").count() >= 2 * 60 * 25  # too few positions: unchanged
    even = prepare.evenly(base.filter("minute(time) <> 1"), 10)
    assert even.count() == (4 * 60 * 25 - 1) * 10 // 25 + 1 and even.filter("x is null").count() > 500
    late = base.filter(F.col("time") > F.lit("2024-01-15 00:00:20").cast("timestamp_ntz"))
    assert prepare.from_first_minute(late).agg(F.min("time")).first()[0] == START + dt.timedelta(minutes=1)


def test_counter_end_to_end(spark):
    two = recording(spark, "a").unionByName(recording(spark, "b", walking=(1, 2)))
    c = StepModel(ThresholdDetector(), window_sec=10, sample_rate=25, steptol=4, distance=0.3, prominence=0.25)
    out = c.predict_samples(two).persist()
    total = {r.recording: r.s for r in out.groupBy("recording").agg(F.sum("Steps").alias("s")).collect()}
    assert total["a"] == pytest.approx(240, abs=14) and total["b"] == pytest.approx(120, abs=8)
    times = c.step_times(out).filter("recording = 'a'").agg(F.min("time"), F.max("time")).first()
    assert START + dt.timedelta(minutes=2) <= times[0] < times[1] <= START + dt.timedelta(minutes=4)
    t = tables(out.select("recording", "time", "Steps"), two, 10.0, 4, 1)
    info = {r.Filename: r for r in t["Info"].collect()}
    assert int(info["a"]["TotalSteps"]) == total["a"] and "ENMOAdjusted(mg)_Weekend" in info["a"].asDict() and "CadencePeak1Adjusted(steps/min)" in info["a"].asDict() and "Steps_Hour00" in info["a"].asDict()
    bouts = t["Bouts"].collect()
    assert len(bouts) == 2 and {r["Duration(mins)"] for r in bouts} == {2.0, 1.0}
    assert set(t) >= {"Daily", "DailyAdjusted", "Hourly", "HourlyAdjusted", "Minutely", "MinutelyAdjusted", "Steps"}
    assert t["Daily"].columns[0] == "Filename" and t["Minutely"].filter("Filename = 'a'").count() == 6
    with pytest.raises(RuntimeError):
        StepModel().predict(c.windows(two))


def test_training_saving_and_network(spark, tmp_path):
    rows = []
    rng = np.random.default_rng(4)
    for g in range(4):
        for k in range(12):
            x, y, z = walk_signal(125) if k % 2 else (np.zeros(125), np.zeros(125), np.ones(125))
            noise = lambda: rng.normal(0, 0.01, 125)
            rows.append((f"P{g:02}", START + dt.timedelta(seconds=5 * k), (x + noise()).tolist(), (y + noise()).tolist(), (z + noise()).tolist(), 10 if k % 2 else 0))
    w = spark.createDataFrame(rows, "recording string, window_start timestamp_ntz, x array<double>, y array<double>, z array<double>, steps int")
    c = StepModel(ForestDetector(25, n_trees=10, cv=2), 5, 25, 3).fit(w)
    accuracy = next(s for s in c.scores["walk_detector"] if s["metric"] == "accuracy")
    assert accuracy["mean"] > 0.9 and next(s for s in c.scores["step_counter"] if s["metric"] == "mae")["mean"] < 2
    c.save(str(tmp_path / "m"))
    again = StepModel.load(str(tmp_path / "m"))
    a, b = (m.predict(w).orderBy("recording", "time").select("Steps").collect() for m in (c, again))
    assert a == b and sum(r.Steps for r in a) > 150

    def load():
        return lambda x: np.stack([0 * x[:, 2].std(1), x[:, 2].std(1) - 0.1], 1)

    net = NetworkDetector(load)
    assert {r.Walk for r in net.predict(w).collect()} == {0, 1}
    turned = augmented(w, 3)
    assert turned.columns == w.columns and turned.collect() == augmented(w, 3).collect()


def test_csv_sources(spark, tmp_path):
    lines = ["a,time,x,y,z"] + [f"q,2024-01-15 00:00:{i:02}.5,{i},{i / 2},1" for i in range(20)] + ["q,2024-01-15 00:00:19.5,99,9,1"]
    body = "\n".join(lines) + "\n"
    plain = tmp_path / "r.csv"
    plain.write_text(body)
    (tmp_path / "r2.csv.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "r3.csv.xz").write_bytes(lzma.compress(body.encode()))
    with zipfile.ZipFile(tmp_path / "r4.csv.zip", "w") as z:
        z.writestr("r4.csv", body)
    for name in ("r.csv", "r2.csv.gz", "r3.csv.xz", "r4.csv.zip"):
        df = readers.read_recording(spark, str(tmp_path / name))
        assert df.count() == 20 and df.filter("x = 99").isEmpty() and dict(df.dtypes)["time"] == "timestamp_ntz"
    o = readers.CsvOptions
    assert [r.x for r in readers.read_csv(spark, str(plain), o(start_row=3, end_row=5)).orderBy("time").collect()] == [3, 4, 5]
    assert readers.read_csv(spark, str(plain), o(txyz_idxs="1,4,3,2")).first().x == 1
    assert readers.read_csv(spark, str(plain), o(time_format="%Y-%m-%d %H:%M:%S.%f")).count() == 21
    for bad in ("1,2,3", "a,b,c,d", "-1,1,2,3", "1,2,3,9"):
        with pytest.raises(ValueError):
            readers.read_csv(spark, str(plain), o(txyz_idxs=bad))
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(plain), o(start_row=5, end_row=3))
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(plain), o(usecols="time,x,y,w"))
    with pytest.raises(ValueError):
        readers.read_recording(spark, str(tmp_path / "r.txt"))
    with pytest.raises(NotImplementedError):
        readers.read_recording(spark, str(tmp_path / "r.cwa"))
    (tmp_path / "d.cwa").write_bytes(b"\x01\x02\x03")
    from strideway.sources import devices

    got = devices.read_device(spark, str(tmp_path / "d.cwa"), lambda content: ((i * 1_000_000, float(v), 0.0, 1.0) for i, v in enumerate(content)))
    assert sorted(r.x for r in got.collect()) == [1, 2, 3]


def test_collation_and_commands(spark, tmp_path):
    for name, cols, row in (("a", "Filename,Date,Steps", "a,2024-01-15,5"), ("b", "Date,Filename,Steps,ENMO", "2024-01-15,b,6,1.5")):
        d = tmp_path / "in" / name
        d.mkdir(parents=True)
        (d / f"{name}-Daily.csv.gz").write_bytes(gzip.compress(f"{cols}\n{row}\n".encode()))
        sinks.write_info({"Filename": name, "TotalSteps": 5, "Nothing": None, "Args": {"k": 1}}, str(d / f"{name}-Info.json"))
    done = sinks.collate(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert set(done) == {"Info", "Daily"}
    daily = spark.read.option("header", True).csv(done["Daily"])
    assert {(r.Filename, r.Steps) for r in daily.collect()} == {("a", "5"), ("b", "6")}
    assert spark.read.option("header", True).csv(done["Info"]).count() == 2
    (tmp_path / "in" / "x.CWA.gz").write_bytes(b"x")
    found = readers.find(spark, str(tmp_path / "in"), "cwa")
    assert len(found) == 1
    # Commands are what the parser takes, whatever characters a path has.
    for path, folder in (("/in/g/s.cwa", "/out/g/s"), ("/in/g.1/it's a.b.csv.gz", "/out/g.1/it's a.b")):
        [line] = sinks.commands([path], "/in/", "/out/", "-q")
        args = cli.parser().parse_args(shlex.split(line)[1:])
        assert (args.what, args.paths, args.outdir, args.quiet) == ("process", [path], folder, True)


def test_streams(spark, tmp_path):
    times = [dt.datetime(2024, 1, 15) + dt.timedelta(seconds=10 * i) for i in range(60)]
    flags = [5.0 if 6 <= i < 20 else 0.0 for i in range(60)]
    df = spark.createDataFrame([("r", t, s) for t, s in zip(times, flags)], "recording string, time timestamp, Steps double")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    for plan, name in ((S.minute_steps(stream, "1 minute"), "m"), (S.ended_bouts(stream), "b")):
        q = plan.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c{name}")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("m").agg(F.sum("Steps")).first()[0] == 70
    assert [(r.windows, r.start) for r in spark.table("b").collect()] == [(14, times[6])]


def test_command_line(spark, tmp_path):
    rows = recording(spark, "one").select("time", "x", "y", "z").toPandas()
    for name in ("one", "two"):
        rows.to_csv(tmp_path / f"{name}.csv", index=False)
    rows.assign(x=None, y=None, z=None).to_csv(tmp_path / "none.csv", index=False)
    cli.process(spark, cli.parser().parse_args(["process", *(str(tmp_path / f"{n}.csv") for n in ("one", "none", "two")), "-o", str(tmp_path / "o"), "-q"]))
    for name in ("one", "two"):
        made = {p.name for p in (tmp_path / "o" / name).iterdir()}
        assert {f"{name}-{x}" for x in ("Info.json", "Daily.csv.gz", "MinutelyAdjusted.csv.gz", "Bouts.csv.gz", "Steps.csv.gz", "StepTimes.csv.gz")} <= made
    same = [gzip.open(tmp_path / "o" / n / f"{n}-Steps.csv.gz", "rt").read() for n in ("one", "two")]
    assert same[0] == same[1] and len(same[0].splitlines()) > 10
    assert [p.name for p in (tmp_path / "o" / "none").iterdir()] == ["none-Info.json"]


def test_a_model_of_another_digest_is_refused(tmp_path):
    StepModel(distance=0.3, prominence=0.25).save(str(tmp_path))
    digest = md5_of(str(tmp_path / "model.json"))
    assert StepModel.load(str(tmp_path), digest).distance == 0.3
    with pytest.raises(ValueError):
        StepModel.load(str(tmp_path), digest[::-1])


def test_steps_without_short(spark):
    df = frame(spark, [START, START + dt.timedelta(hours=1)], [2, None])
    assert [r.Steps for r in steps.without_short(df).orderBy("time").collect()] == [0.0, None]


def test_early_stopping():
    from strideway.plans.training import EarlyStopping

    kept = []
    stop = EarlyStopping(2, keep=kept.append)
    assert [stop(x, i) for i, x in enumerate([3, 2, 2.5, 1, 1.5, 1.2])] == [False, False, False, False, False, True]
    assert kept == [0, 1, 3] and stop.best == 1
