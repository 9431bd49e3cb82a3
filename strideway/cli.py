"""Command line: process recordings, collate results, list commands.

python -m strideway.cli process FILE... -o DIR    one recording or a cohort, by one plan
python -m strideway.cli collate DIR -o DIR
python -m strideway.cli commands DIR -d DIR
"""

from __future__ import annotations

import argparse
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.functions.scalar import resolve_path
from strideway.operators import clean, prepare
from strideway.operators.grid import infer_period
from strideway.plans.model import StepModel
from strideway.plans.report import tables
from strideway.session import build, written
from strideway.sources import readers, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strideway")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("process", help="steps and summaries of recordings")
    a.add_argument("paths", nargs="+")
    a.add_argument("-o", "--outdir", default="outputs/")
    a.add_argument("-m", "--model", help="folder of a trained model; a threshold detector otherwise")
    a.add_argument("--model-md5", help="digest that the model's model.json must have")
    a.add_argument("-t", "--model-type", choices=["rf", "ssl"], default="rf")
    a.add_argument("-d", "--pytorch-device", default="cpu", help="for networks only")
    a.add_argument("--force-download", action="store_true")
    a.add_argument("-r", "--sample-rate", type=float)
    a.add_argument("--csv-txyz", default="time,x,y,z")
    a.add_argument("--csv-txyz-idxs")
    a.add_argument("--csv-start-row", type=int)
    a.add_argument("--csv-end-row", type=int)
    a.add_argument("--csv-time-format")
    a.add_argument("-w", "--exclude-wear-below")
    a.add_argument("-e", "--exclude-first-last", choices=["first", "last", "both"])
    a.add_argument("--min-wear-per-day", type=float, default=21 * 60)
    a.add_argument("--min-wear-per-hour", type=float, default=50)
    a.add_argument("--min-wear-per-minute", type=float, default=0.5)
    a.add_argument("--min-walk-per-day", type=int, default=5)
    a.add_argument("--bouts-min-walk", type=float, default=0.8)
    a.add_argument("--bouts-max-idle", type=int, default=3)
    a.add_argument("--start")
    a.add_argument("--end")
    a.add_argument("--calibration-stdtol-min", type=float, default=0.013)
    a.add_argument("--start-first-complete-minute", action="store_true")
    a.add_argument("-q", "--quiet", action="store_true")
    c = sub.add_parser("collate", help="results of many recordings in one table of each kind")
    c.add_argument("results")
    c.add_argument("-o", "--output", default="collated-outputs/")
    c.add_argument("-i", "--include", nargs="+", default=["daily", "hourly", "minutely", "bouts"])
    g = sub.add_parser("commands", help="a command for each recording under a folder")
    g.add_argument("input_dir")
    g.add_argument("-d", "--output_dir", required=True)
    g.add_argument("-f", "--cmdsfile", default="list-of-commands.txt")
    g.add_argument("-a", "--fext", default="cwa")
    g.add_argument("-x", "--cmdopts", default="")
    return p


def counter_of(args, rate: int) -> StepModel:
    if args.model:
        return StepModel.load(args.model, args.model_md5)
    return StepModel(window_sec=10, sample_rate=rate, steptol=4, distance=0.3, prominence=0.25)


def process(spark, args) -> None:
    """Every table of every recording, all by one plan (one for each sample rate, if they differ); a recording without worn time has its wear statistics alone."""
    if args.force_download or args.model_type == "ssl":
        raise SystemExit("models aren't downloaded and the pretrained network isn't part of this package: give a folder by --model")
    options = readers.CsvOptions(args.csv_txyz, args.csv_txyz_idxs, args.csv_start_row, args.csv_end_row, args.csv_time_format)
    prep = lambda df: prepare.prepared(df, args.sample_rate, args.start_first_complete_minute, args.calibration_stdtol_min)
    every = [readers.read_recording(spark, p, options, args.start, args.end, prep).withColumn("recording", F.lit(p)) for p in args.paths]
    samples = reduce(DataFrame.unionByName, every)
    if args.exclude_wear_below:
        samples = clean.blank_days_below(samples, args.exclude_wear_below, clean.XYZ)
    if args.exclude_first_last:
        samples = clean.drop_first_last_days(samples, args.exclude_first_last)
    samples = written(samples, "samples")
    base = {p: f"{args.outdir.rstrip('/')}/{resolve_path(p)[1]}/{resolve_path(p)[1]}" for p in args.paths}
    # A row for each recording.
    wear = {r.recording: r.asDict() for r in clean.wear_stats(samples, clean.XYZ).collect()}
    worn = {r[0] for r in samples.filter(clean.worn(clean.XYZ)).select("recording").distinct().collect()}
    for p in args.paths:
        if p not in worn:
            info = {k: v for k, v in wear.get(p, {}).items() if k != "recording"} | {"Filename": p}
            sinks.write_info(info, f"{base[p]}-Info.json", spark)
            print(sinks.console(info))
    by_rate: dict[int, list[str]] = {}
    for r in infer_period(samples.filter(F.col("recording").isin(list(worn)))).collect() if worn else []:
        by_rate.setdefault(0 if args.model else round(1 / r.dt), []).append(r.recording)
    for rate, names in sorted(by_rate.items()):
        _report(spark, args, samples.filter(F.col("recording").isin(names)), counter_of(args, rate), names, base)


def _report(spark, args, samples, counter: StepModel, names: list[str], base: dict[str, str]) -> None:
    predicted = written(counter.predict_samples(samples), "predicted")
    enough = {"minute": args.min_wear_per_minute, "hour": args.min_wear_per_hour, "day": args.min_wear_per_day}
    out = tables(predicted.select("recording", "time", "Steps"), samples, counter.window_sec, counter.steptol, args.min_walk_per_day, enough, args.bouts_min_walk, args.bouts_max_idle)
    out = {k: written(df.withColumnRenamed("Filename", "recording"), k) for k, df in out.items()}
    out["StepTimes"] = written(counter.step_times(predicted), "StepTimes")
    for path in names:
        own = {k: df.filter(F.col("recording") == path) for k, df in out.items()}
        info = {k: v for k, v in own.pop("Info").first().asDict().items() if k != "recording"} | {"Filename": path}
        sinks.write_info(info, f"{base[path]}-Info.json", spark)
        for kind, df in own.items():
            order = next((c for c in ("Time", "Date", "time", "StartTime") if c in df.columns), None)
            plain = df.drop("recording") if kind in ("Steps", "StepTimes") else df.withColumnRenamed("recording", "Filename")
            sinks.write_one(plain.orderBy(order) if order else plain, f"{base[path]}-{kind}.csv.gz")
        if not args.quiet:
            print(sinks.console(info))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build()
    if args.what == "process":
        process(spark, args)
    elif args.what == "collate":
        sinks.collate(spark, args.results, args.output, args.include)
    else:
        paths = [p.removeprefix("file:") for p in readers.find(spark, args.input_dir, args.fext)]
        Path(args.cmdsfile).write_text("".join(f"{c}\n" for c in sinks.commands(paths, args.input_dir, args.output_dir, args.cmdopts)))


if __name__ == "__main__":
    main()
