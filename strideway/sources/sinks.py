"""Writers: steps, summaries and collations. Cohorts are written as one dataset; one recording as single files."""

from __future__ import annotations

import csv
import gzip
import json
import math
import os
import shlex
import tempfile
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideway.sources.readers import KINDS, kind_of, read_infos, read_results

#: Parts of the names of metrics that a summary for the eye leaves out.
DETAIL = ("_Weekend", "_Weekday", *(f"_Hour{h:02}" for h in range(24)))


def write_csv(df: DataFrame, path: str) -> None:
    """A dataset of gzipped CSV files with a header, as many as there are partitions."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def put(spark: SparkSession | None, path: str, data: bytes) -> None:
    """Write a file: by Hadoop where path names a store, else as a local file."""
    if "://" not in path or path.startswith("file://"):
        local = Path(path.removeprefix("file://"))
        local.parent.mkdir(parents=True, exist_ok=True)
        local.write_bytes(data)
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def write_one(df: DataFrame, path: str) -> None:
    """One gzipped CSV file of the rows of one recording, which stream through the driver in order."""
    with tempfile.TemporaryFile() as raw:
        with gzip.open(raw, "wt", newline="") as f:
            out = csv.writer(f)
            out.writerow(df.columns)
            for row in df.toLocalIterator():
                out.writerow(["" if v is None else v for v in row])
        raw.seek(0)
        put(df.sparkSession, path, raw.read())


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return v
    if hasattr(v, "item"):
        return v.item()
    if isinstance(v, T.Row):
        return {k: _plain(x) for k, x in v.asDict().items()}
    return v


def write_info(info: dict, path: str, spark: SparkSession | None = None) -> None:
    """A summary as JSON; what is missing is NaN."""
    put(spark, path, json.dumps({k: math.nan if v is None else _plain(v) for k, v in info.items()}, indent=4, default=str).encode())


def shown(metrics: list[str]) -> list[str]:
    """Names of metrics without those by kind of day and by hour."""
    return [m for m in metrics if not any(part in m for part in DETAIL)]


def console(info: dict) -> str:
    """The summary without its parts by kind of day and by hour."""
    return json.dumps({k: _plain(info[k]) for k in shown(list(info))}, indent=4, default=str)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that CSV can hold them."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def collate(spark, results: str, out: str, included: list[str] = ["daily", "hourly", "minutely", "bouts"]) -> dict[str, str]:  # noqa: B006
    """Info and each included kind of results of many recordings, each as one dataset; kinds without files write nothing. Returns what was written."""
    wanted = [x.lower() for x in included]
    # One listing, by Spark; only which kinds there are comes back.
    ending = F.regexp_extract("path", r"-([A-Za-z]+)\.(json|csv\.gz)$", 1)
    there = {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(results).select(ending.alias("kind")).distinct().collect()}
    written = {"Info": f"{out}/Info.csv.gz"}
    if "Info" in there:
        write_csv(flat(read_infos(spark, results)), written["Info"])
    else:
        put(spark, written["Info"], gzip.compress(b"\n"))
    for kind in KINDS:
        if kind in there and kind.lower().removesuffix("adjusted") in wanted:
            written[kind] = f"{out}/{kind}.csv.gz"
            write_csv(read_results(spark, results, kind), written[kind])
    return written


def commands(paths: list[str], input_dir: str, output_dir: str, options: str = "") -> list[str]:
    """One command for each recording, its results in a folder of the recording's name at the same place under output_dir. A cohort needs none: it is one plan."""
    out = []
    for p in paths:
        inside = PurePosixPath(os.path.relpath(p, input_dir))
        for ending in reversed(kind_of(p)):
            if ending and inside.name.lower().endswith(ending):
                inside = inside.with_name(inside.name[: -len(ending)])
        words = ["strideway", "process", p, "--outdir", str(PurePosixPath(output_dir) / inside)]
        out.append(" ".join([shlex.join(words), options]).strip())
    return out
