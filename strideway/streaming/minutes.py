"""Streams of samples or steps: minute sums and means with late data, and bouts as they end.

An extension: imputation and statistics over whole recordings stay with the batch plans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strideway.operators.enmo import enmo

STATE = "start timestamp, last timestamp, ones int, n int, idle int"
OUT = "recording string, start timestamp, last timestamp, windows int"


def minute_steps(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(recording, minute, Steps) of (recording, time, Steps) with a timestamp; each minute once the watermark has passed it."""
    m = stream.withWatermark("time", late).groupBy("recording", F.window("time", "1 minute")).agg(F.sum("Steps").alias("Steps"))
    return m.select("recording", F.col("window.start").alias("minute"), "Steps")


def minute_enmo(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(recording, minute, enmo) of (recording, time, x, y, z)."""
    m = stream.withColumn("enmo", enmo()).withWatermark("time", late).groupBy("recording", F.window("time", "1 minute")).agg(F.avg("enmo").alias("enmo"))
    return m.select("recording", F.col("window.start").alias("minute"), "enmo")


def ended_bouts(stream: DataFrame, steptol: int = 3, min_walk: float = 0.8, max_idle: int = 3) -> DataFrame:
    """(recording, start, last, windows) of bouts as they end; stream: (recording, time, Steps) in order within a recording."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, ones, n, idle = state.get if state.exists else (None, None, 0, 0, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values("time")
        for t, s in zip(rows["time"], rows["Steps"], strict=True):
            if pd.notna(s) and s >= steptol:
                start = t if start is None else start
                ones, n, idle, last = ones + 1, n + 1, 0, t
            elif start is not None:
                n, idle = n + 1, idle + 1
                if idle > max_idle or ones / n < min_walk:
                    out.append((key[0], start, last, n - idle))
                    start, last, ones, n, idle = None, None, 0, 0, 0
        state.update((start, last, ones, n, idle))
        yield pd.DataFrame(out, columns=["recording", "start", "last", "windows"])

    return stream.groupBy("recording").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
