"""Readers: recordings from CSV, Parquet and devices; result files; discovery.

A reading is (recording, time, x, y, z) with TIMESTAMP_NTZ times and NULL for missing values. Any
number of files is one DataFrame; `recording` is the file's path unless told otherwise.
"""

from __future__ import annotations

import bz2
import csv
import gzip
import io
import lzma
import re
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.functions.scalar import spark_pattern
from strideway.operators.clean import XYZ, first_of_duplicates, null_for_nan, trim

PACKED = (".gz", ".xz", ".lzma", ".bz2", ".zip")
DEVICES = (".cwa", ".gt3x", ".bin")
#: Formats that Spark's own CSV reader opens.
NATIVE = ("", ".gz", ".bz2")
#: Parts of messages that callers look for.
FOUR, ORDER = "4 comma-separated integers", "must be >= csv_start_row"
#: Result files by kind; the first suffix that fits wins.
KINDS = ("Daily", "DailyAdjusted", "Hourly", "HourlyAdjusted", "Minutely", "MinutelyAdjusted", "Bouts")


def kind_of(path: str) -> tuple[str, str]:
    """(suffix that tells the format, suffix of compression or nothing), in lower case."""
    p = PurePosixPath(path)
    last = p.suffix.lower()
    return (PurePosixPath(p.stem).suffix.lower(), last) if last in PACKED else (last, "")


@dataclass
class CsvOptions:
    """How to read recordings from CSV. usecols: names of time, x, y, z; txyz_idxs: their positions, which win; rows count from 0 without the header, the last one included; time_format is strptime's."""

    usecols: str = "time,x,y,z"
    txyz_idxs: str | None = None
    start_row: int | None = None
    end_row: int | None = None
    time_format: str | None = None

    def check(self) -> None:
        if None not in (self.start_row, self.end_row) and self.start_row > self.end_row:
            raise ValueError(f"no rows from {self.start_row} to {self.end_row}: csv_end_row {ORDER}")

    def columns(self, header: list[str]) -> list[str]:
        if self.txyz_idxs is not None:
            places = self.txyz_idxs.split(",")
            if len(places) != 4 or not all(re.fullmatch(r"\s*[+-]?\d+\s*", x) for x in places):
                raise ValueError(f"time, x, y and z are told by {FOUR}, not by {self.txyz_idxs!r}")
            if beyond := [x for x in map(int, places) if not 0 <= x < len(header)]:
                raise ValueError(f"no columns at {beyond}: the {len(header)} columns count from 0")
            return [header[int(x)] for x in places]
        names = self.usecols.split(",")
        if missing := [n for n in names if n not in header]:
            raise ValueError(f"columns {missing} aren't among {header}")
        return names


def _unpacked(content: bytes, suffix: str) -> bytes:
    if suffix == ".zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if len(names) != 1:
                raise ValueError(f"a zip archive of one file is wanted, this has {len(names)}")
            return z.read(names[0])
    return {".xz": lzma.decompress, ".lzma": lzma.decompress, ".gz": gzip.decompress, ".bz2": bz2.decompress}[suffix](content)


def _packed_lines(spark: SparkSession, path: str, suffix: str) -> tuple[list[str], DataFrame]:
    """(header, (recording, row, values)) of files that Spark's reader can't open; each is read by one task."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = csv.reader(io.StringIO(_unpacked(content, suffix).decode("utf-8-sig")))
                for start in range(0, 1 << 62, 20_000):
                    some = [r for _, r in zip(range(20_000), rows, strict=False)]
                    if not some:
                        break
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(range(start - 1, start - 1 + len(some)), pa.int64()), pa.array(some, pa.list_(pa.string()))], ["recording", "row", "values"])

    df = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "recording string, row long, values array<string>")
    header = df.filter("row = -1").select("values").first()
    if header is None:
        raise ValueError(f"no columns in {path}")
    return header[0], df.filter("row >= 0")


def parsed_time(c: Column, time_format: str | None) -> Column:
    """A time without a zone; text that doesn't fit raises when read."""
    return c.cast("timestamp_ntz") if time_format is None else F.to_timestamp_ntz(c, F.lit(spark_pattern(time_format)))


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:  # noqa: B008
    """(recording, time, x, y, z, row) of CSV files with a header; only the four columns are parsed."""
    options.check()
    suffix = kind_of(path)[1]
    if suffix in NATIVE:
        raw = spark.read.option("header", True).csv(path)
        header = raw.columns
        if not header:
            raise ValueError(f"no columns in {path}")
        t, *axes = options.columns(header)
        rows = raw.select(F.input_file_name().alias("recording"), F.col(f"`{t}`").alias("t"), *[F.col(f"`{a}`").alias(n) for a, n in zip(axes, XYZ, strict=True)], F.monotonically_increasing_id().alias("row"))
        if options.start_row is not None or options.end_row is not None:
            # Spark doesn't number the rows of a file: parts of a file are in order, so a rank over them is its row number.
            from pyspark.sql import Window

            rows = rows.withColumn("row", (F.row_number().over(Window.partitionBy("recording").orderBy("row")) - 1).cast("long"))
    else:
        header, lines = _packed_lines(spark, path, suffix)
        names = options.columns(header)
        at = {n: header.index(n) for n in names}
        rows = lines.select("recording", F.col("values")[at[names[0]]].alias("t"), *[F.col("values")[at[a]].alias(n) for a, n in zip(names[1:], XYZ, strict=True)], "row")
    if options.start_row is not None:
        rows = rows.filter(F.col("row") >= options.start_row)
    if options.end_row is not None:
        rows = rows.filter(F.col("row") <= options.end_row)
    out = rows.select("recording", parsed_time(F.col("t"), options.time_format).alias("time"), *[F.nullif(F.trim(a), F.lit("")).cast("float").cast("double").alias(a) for a in XYZ], "row")
    return null_for_nan(out, XYZ)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Recordings as Parquet: time, x, y, z and, if there is one, recording. Takes the place of pickles, which aren't opened: unpickling runs code."""
    df = spark.read.parquet(path)
    name = F.col("recording") if "recording" in df.columns else F.input_file_name()
    out = df.select(name.alias("recording"), F.col("time").cast("timestamp_ntz").alias("time"), *[F.col(a).cast("double").alias(a) for a in XYZ], F.monotonically_increasing_id().alias("row"))
    return null_for_nan(out, XYZ)


def read_recording(spark: SparkSession, path: str, csv_options: CsvOptions = CsvOptions(), start_time: str | None = None, end_time: str | None = None, prepare=None) -> DataFrame:  # noqa: B008
    """(recording, time, x, y, z), one row for each time, by the file's format. prepare: what to do before trimming, such as calibration."""
    kind, _ = kind_of(path)
    if kind == ".csv":
        df = read_csv(spark, path, csv_options)
    elif kind in (".parquet", ".pq"):
        df = read_parquet(spark, path)
    elif kind in DEVICES:
        if csv_options != CsvOptions():
            warnings.warn("CSV options only apply to CSV files", stacklevel=2)
        from strideway.sources.devices import read_device

        df = read_device(spark, path)
    else:
        raise ValueError(f"Unknown file format: {kind}")
    df = first_of_duplicates(df, "row").drop("row")
    return trim(prepare(df) if prepare else df, start_time, end_time)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """(pid, time, x, y, z, annotation) of labelled CSV files timestamp,x,y,z,annotation; pid is P and two digits in the path."""
    schema = "timestamp timestamp_ntz, x float, y float, z float, annotation short"
    df = spark.read.option("header", True).schema(schema).csv(path)
    return null_for_nan(df.select(F.regexp_extract(F.input_file_name(), r"(P\d{2})", 1).alias("pid"), F.col("timestamp").alias("time"), *[F.col(a).cast("double").alias(a) for a in XYZ], F.col("annotation").cast("int").alias("annotation")), XYZ)


def read_infos(spark: SparkSession, folder: str) -> DataFrame:
    """All summaries *-Info.json under a folder: columns of any file, NULL where a file has none; a damaged file raises."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*-Info.json").option("multiLine", True).option("mode", "FAILFAST").option("allowNonNumericNumbers", True).json(folder)


def read_results(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """All result files of a kind under a folder, columns matched by name whatever their order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*-{kind}.csv.gz").load(folder).select("path", "content")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = [gzip.GzipFile(fileobj=io.BytesIO(c)).readline().decode("utf-8-sig").strip() for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.string())], ["path", "header"])

    by_header: dict[str, list[str]] = {}
    for r in files.mapInArrow(headers, "path string, header string").sort("path").collect():  # names only
        by_header.setdefault(r.header, []).append(r.path)
    out = None
    for files in by_header.values():
        df = spark.read.option("header", True).csv(files)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "Filename string")


def find(spark: SparkSession, folder: str, extension: str) -> list[str]:
    """Files under a folder with an extension in any case, packed or not, in order. Their names come to the driver, nothing else."""
    ends = "|".join(s.replace(".", r"\.") for s in ("", ".gz", ".zip", ".bz2", ".xz"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return sorted(r[0] for r in files.filter(F.lower("path").rlike(f"(?s){extension.lower().replace('.', chr(92) + '.')}({ends})$")).collect())


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, md5) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.md5("content").alias("md5"))


def load_checked(path: str, md5: str | None, loader):
    """loader(path) if the file has the digest that is asked for."""
    from strideway.functions.scalar import md5_of

    if md5 is not None and md5_of(path) != md5:
        raise ValueError(f"{path} isn't the file that is expected")
    return loader(path)
