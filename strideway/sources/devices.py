"""Device files: a parser for each format is registered by name.

The formats' parsers are not part of this package. A parser is a function from the bytes of a file
to an iterator of (microseconds since 1970, x, y, z); it runs on the executor that reads the file.
Files are read by Spark, from whatever store they are in, any number of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Parser = Callable[[bytes], Iterator[tuple[int, float, float, float]]]
_PARSERS: dict[str, Parser] = {}


def register(extension: str, parser: Parser) -> None:
    _PARSERS[extension.lower()] = parser


def read_device(spark: SparkSession, path: str | list[str], parser: Parser | None = None) -> DataFrame:
    """(recording, time, x, y, z, row) of device files, by paths or patterns; raises NotImplementedError where no parser is registered."""
    from strideway.sources.readers import kind_of

    paths = [path] if isinstance(path, str) else path
    kind = kind_of(paths[0])[0]
    parse = parser or _PARSERS.get(kind)
    if parse is None:
        raise NotImplementedError(f"no parser registered for {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, row = iter(parse(content)), 0
                while some := list(islice(found, 20_000)):
                    us, *axes = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(some)), pa.array(us, pa.int64()).cast(pa.timestamp("us")), *(pa.array(a, pa.float64()) for a in axes), pa.array(np.arange(row, row + len(some)))],
                        ["recording", "time", "x", "y", "z", "row"],
                    )
                    row += len(some)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "recording string, time timestamp_ntz, x double, y double, z double, row long")
