"""From raw samples to clean ones: gravity calibration, non-wear, even sampling.

After published methods (stationary periods fitted to the unit sphere; long stationary periods
taken as non-wear) with every parameter named; no claim to agree with any other program bit by bit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.operators.clean import XYZ
from strideway.operators.grid import KEYS, asof_nearest, at_micros, micros


def still_periods(samples: DataFrame, seconds: int = 10, tolerance: float = 0.013, keys: list[str] = KEYS) -> DataFrame:
    """(keys, w, x, y, z, still): means of windows of some seconds, and whether every axis varies less than the tolerance (g)."""
    w = F.floor(micros("time") / (seconds * 1_000_000))
    means = samples.groupBy(*keys, w.alias("w")).agg(*[F.avg(a).alias(a) for a in XYZ], *[F.stddev_pop(a).alias(f"sd_{a}") for a in XYZ])
    return means.withColumn("still", F.coalesce(F.greatest(*[f"sd_{a}" for a in XYZ]) < tolerance, F.lit(False))).drop(*[f"sd_{a}" for a in XYZ])


def sphere_fit(points: np.ndarray, rounds: int = 1000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(scale, offset, error before, error after) by which points come nearest to the unit sphere: least squares against their projections, weighted by nearness, in turns."""
    scale, offset = np.ones(3), np.zeros(3)
    error = lambda p: float(np.abs(np.linalg.norm(p, axis=1) - 1).mean())
    first = was = error(points)
    best = (scale, offset, was)
    for _ in range(rounds):
        moved = points * scale + offset
        norm = np.linalg.norm(moved, axis=1)
        aim = moved / np.maximum(norm, 1e-9)[:, None]
        weight = np.sqrt(np.minimum(1 / np.maximum(np.abs(norm - 1), 1e-9), 100))
        for axis in range(3):
            a = np.stack([points[:, axis], np.ones(len(points))], 1) * weight[:, None]
            scale[axis], offset[axis] = np.linalg.lstsq(a, aim[:, axis] * weight, rcond=None)[0]
        now = error(points * scale + offset)
        if now < best[2]:
            best = (scale.copy(), offset.copy(), now)
        if abs(was - now) < tol * was:
            break
        was = now
    return best[0], best[1], first, best[2]


def calibration(samples: DataFrame, seconds: int = 10, tolerance: float = 0.013, spread: float = 0.3, keys: list[str] = KEYS) -> DataFrame:
    """(keys, scale, offset, error_before, error_after, ok): not ok, and nothing changed, unless still periods reach `spread` g on both sides of every axis."""
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    still = still_periods(samples, seconds, tolerance, keys).filter("still").select(*keys, *XYZ)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        p = part[XYZ].to_numpy(float)
        own = part.iloc[:1][keys].reset_index(drop=True)
        fair = bool(((p.min(0) < -spread) & (p.max(0) > spread)).all())
        scale, offset, before, after = sphere_fit(p) if fair else (np.ones(3), np.zeros(3), float("nan"), float("nan"))
        fair = fair and after < before
        if not fair:
            scale, offset = np.ones(3), np.zeros(3)
        return own.assign(scale=[scale.tolist()], offset=[offset.tolist()], error_before=before, error_after=after, ok=fair)

    return still.groupBy(*keys).applyInPandas(fit, f"{kinds}, scale array<double>, offset array<double>, error_before double, error_after double, ok boolean")


def calibrated(samples: DataFrame, found: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Samples scaled and shifted axis by axis; found: what calibration() gives."""
    found = calibration(samples, keys=keys) if found is None else found
    joined = samples.join(found.select(*keys, "scale", "offset"), keys, "left")
    return joined.withColumns({a: F.coalesce(F.col(a) * F.col("scale")[i] + F.col("offset")[i], F.col(a)) for i, a in enumerate(XYZ)}).drop("scale", "offset")


def nonwear_blanked(samples: DataFrame, patience_minutes: float = 90, seconds: int = 10, tolerance: float = 0.013, keys: list[str] = KEYS) -> DataFrame:
    """Samples in still periods of at least patience_minutes become NULL."""
    still = still_periods(samples, seconds, tolerance, keys).filter("still").select(*keys, "w")
    run = still.withColumn("run", F.col("w") - F.row_number().over(Window.partitionBy(*keys).orderBy("w")))
    long = run.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "run"))).filter(F.col("n") * seconds >= patience_minutes * 60).select(*keys, "w", F.lit(True).alias("_off"))
    out = samples.withColumn("w", F.floor(micros("time") / (seconds * 1_000_000))).join(long, [*keys, "w"], "left")
    return out.withColumns({a: F.when(F.col("_off").isNull(), F.col(a)) for a in XYZ}).drop("w", "_off")


def evenly(samples: DataFrame, hz: float, tolerance: float = 1.0, keys: list[str] = KEYS) -> DataFrame:
    """Samples at a fixed rate from a recording's first to its last: the nearest within tolerance seconds."""
    ends = samples.groupBy(*keys).agg(F.min(micros("time")).alias("a"), F.max(micros("time")).alias("b"))
    n = F.floor((F.col("b") - F.col("a")) * hz / 1e6)
    grid = ends.select(*keys, "a", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("i")).select(*keys, at_micros(F.col("a") + F.round(F.col("i") * 1e6 / hz)).alias("time"))
    return asof_nearest(grid, samples, XYZ, tolerance, keys)


def from_first_minute(samples: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Samples from a recording's first complete minute on; a start within a second of a minute counts as one."""
    first = samples.groupBy(*keys).agg(F.min(micros("time")).alias("_a"))
    begin = F.ceil((F.col("_a") - 1_000_000) / 60_000_000) * 60_000_000
    return samples.join(first, keys).filter(micros("time") >= begin).drop("_a")


def prepared(samples: DataFrame, hz: float | None = None, first_minute: bool = False, tolerance: float = 0.013, keys: list[str] = KEYS) -> DataFrame:
    """Calibrated, non-wear blanked and, with hz, at an even rate."""
    if first_minute:
        samples = from_first_minute(samples, keys)
    samples = calibrated(samples, calibration(samples, tolerance=tolerance, keys=keys), keys)
    samples = nonwear_blanked(samples, tolerance=tolerance, keys=keys)
    return evenly(samples, hz, keys=keys) if hz else samples
