"""The 32 features of a window of acceleration, as numpy and as Arrow-batched columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideway.functions import dsp

#: Names of the features, in order.
NAMES = (
    "avg std skew kurt min q25 med q75 max acf_1st_max acf_1st_max_loc acf_1st_min acf_1st_min_loc acf_zeros pentropy power "
    "f1 f2 f3 p1 p2 p3 fft0 fft1 fft2 fft3 fft4 fft5 npeaks peaks_avg_promin peaks_min_promin peaks_max_promin"
).split()
MIN_SECONDS = 2
SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES])


def moments(v: np.ndarray) -> dict[str, float]:
    mean, std = v.mean(), v.std()
    z = (v - mean) / std if std > 0.01 else None
    return {"avg": mean, "std": std, "skew": 0.0 if z is None else (z**3).mean(), "kurt": 0.0 if z is None else (z**4).mean() - 3}


def quantiles(v: np.ndarray) -> dict[str, float]:
    return dict(zip(("min", "q25", "med", "q75", "max"), np.quantile(v, (0, 0.25, 0.5, 0.75, 1)), strict=True))


def autocorrelations(v: np.ndarray, rate: int) -> dict[str, float]:
    u = dsp.autocorrelation(v, 2 * rate)
    out = {}
    for name, w in (("max", u), ("min", -u)):
        at, _ = dsp.find_peaks(w, prominence=0.1)
        out |= {f"acf_1st_{name}": u[at[0]] if len(at) else 0.0, f"acf_1st_{name}_loc": at[0] / rate if len(at) else 0.0}
    return out | {"acf_zeros": float(np.diff(np.signbit(u)).sum())}


def spectrum(v: np.ndarray, rate: int) -> dict[str, float]:
    freqs, power = dsp.periodogram(v, rate)
    power = power / (len(v) / rate)
    some = power[power > 0]
    share = some / some.sum() if len(some) else some
    at = dsp.local_maxima(power)
    best = at[np.argsort(power[at])[::-1][:3]]
    pick = lambda x: [*x[best], 0.0, 0.0, 0.0][:3]
    return {"pentropy": float(-(share * np.log(share)).sum()), "power": power.sum()} | dict(zip(("f1", "f2", "f3", "p1", "p2", "p3"), [*pick(freqs), *pick(power)], strict=True))


def bands(v: np.ndarray, rate: int, n: int = 5) -> dict[str, float]:
    power = dsp.welch_median(v, rate)
    return {f"fft{i}": power[i] for i in range(n + 1)}


def peaks(v: np.ndarray, rate: int, smooth: np.ndarray | None = None) -> dict[str, float]:
    """smooth: v low-passed at 5 Hz, if that is done already."""
    at, stand = dsp.find_peaks(dsp.butterfilt(v, 5, rate) if smooth is None else smooth, distance=0.2 * rate, prominence=0.25)
    some = stand if len(stand) else np.zeros(1)
    return {"npeaks": len(at) / (len(v) / rate), "peaks_avg_promin": some.mean(), "peaks_min_promin": some.min(), "peaks_max_promin": some.max()}


def extract_many(windows: list[np.ndarray | None], rate: int = 100) -> list[dict[str, float]]:
    """Features of windows of shape (n, 3); none if one is missing, lacks a value, or is two seconds or shorter. Windows of a length are filtered together."""
    out: list[dict[str, float]] = [{} for _ in windows]
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        if w is not None and len(w) > MIN_SECONDS * rate and not np.isnan(w).any():
            by_length.setdefault(len(w), []).append(i)
    for at in by_length.values():
        v = np.clip(dsp.median5(np.linalg.norm(np.stack([windows[i] for i in at]), axis=-1)) - 1, -2, 2)
        for i, own, smooth in zip(at, v, dsp.butterfilt(v, 5, rate, axis=-1), strict=True):
            out[i] = moments(own) | quantiles(own) | autocorrelations(own, rate) | spectrum(own, rate) | bands(own, rate) | peaks(own, rate, smooth)
    return out


def extract(xyz: np.ndarray, rate: int = 100) -> dict[str, float]:
    return extract_many([xyz], rate)[0]


def stacked(x: pd.Series, y: pd.Series, z: pd.Series) -> list[np.ndarray | None]:
    """Windows of shape (n, 3) from columns of arrays; None where an array is missing."""
    return [None if a is None or b is None or c is None else np.stack([np.asarray(i, float) for i in (a, b, c)], axis=1) for a, b, c in zip(x, y, z, strict=True)]


def features_of(x: Column, y: Column, z: Column, rate: int) -> Column:
    """A struct of the features of three array columns; NULL fields where there are none."""

    @F.pandas_udf(SCHEMA)
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(extract_many(stacked(a, b, c), rate), columns=NAMES).astype(float)

    return run(x, y, z)


def per_window(kernel: Callable[[np.ndarray], dict[str, float]], names: list[str], v: Column) -> Column:
    """A struct of what a kernel above gives for each array of a column; NULL fields for a missing array or one with a missing value."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(part: pd.Series) -> pd.DataFrame:
        arrays = [None if a is None else np.asarray(a, float) for a in part]
        return pd.DataFrame([{} if a is None or not len(a) or np.isnan(a).any() else kernel(a) for a in arrays], columns=names).astype(float)

    return run(v)


def step_peaks(x: Column, y: Column, z: Column, rate: int, distance: float = 0.5, prominence: float = 0.5, lowpass: float = 5) -> Column:
    """Seconds into the window of every step; NULL where a value is missing. Filters before the call keep windows away that need no steps."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        windows = stacked(a, b, c)
        out: list = [None] * len(windows)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(windows):
            if w is not None and len(w) and not np.isnan(w).any():
                by_length.setdefault(len(w), []).append(i)
        for at in by_length.values():  # windows of a length are filtered together
            for i, v in zip(at, dsp.magnitude(np.stack([windows[i] for i in at]), rate, lowpass), strict=True):
                out[i] = (dsp.find_peaks(v, distance * rate, prominence)[0] / rate).tolist()
        return pd.Series(out, dtype=object)

    return run(x, y, z)
