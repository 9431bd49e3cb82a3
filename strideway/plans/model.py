"""Step counting: windows, a walk detector, smoothing, and peaks where someone walks."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideway.functions import dsp
from strideway.functions.features import NAMES, features_of, stacked, step_peaks
from strideway.operators import evaluation
from strideway.operators.clean import XYZ
from strideway.operators.grid import at_micros, fixed_length, micros, windows_from_start
from strideway.operators.hmm import Smoother
from strideway.sources.readers import load_checked

WINDOW = ["recording", "window_start"]


def complete(columns: list[str] = XYZ):
    """No array missing and no value of any missing."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v))
    return ok


@dataclass
class ForestDetector:
    """Random forest over features, a threshold, and smoothing of each recording's windows.

    Rows of the rarer class weigh more instead of being drawn again for every tree."""

    sample_rate: int = 100
    n_trees: int = 1000
    pnr: float = 1.0
    cv: int = 5
    seed: int = 41
    thresh: float = 0.5
    forest: PipelineModel | Any = None
    smoother: Smoother = field(default_factory=Smoother)

    def _featured(self, windows: DataFrame) -> DataFrame:
        f = windows.withColumn("_f", features_of(F.col("x"), F.col("y"), F.col("z"), self.sample_rate))
        # Windows too short for features have none and aren't judged.
        return f.filter(F.col("_f.avg").isNotNull()).withColumn("features", array_to_vector(F.array(*[F.coalesce(F.nanvl(F.col(f"_f.{n}"), F.lit(0.0)), F.lit(0.0)) for n in NAMES]))).drop("_f")

    def _train(self, rows: DataFrame, label: str):
        return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=self.n_trees, seed=self.seed, maxDepth=12).fit(rows)

    def fit(self, windows: DataFrame, label: str, group: str = "recording") -> DataFrame:
        """Learn from labelled windows; returns (window, label, fold, score, predicted) as cross-validation predicts them."""
        rows = evaluation.sample_weight(self._featured(windows), label, self.pnr).withColumn(label, F.col(label).cast("double")).persist()
        folds = evaluation.ordered_folds(rows, group, "window_start", self.cv)

        def trained(part: DataFrame):
            model = self._train(part, label)
            return lambda test: model.transform(test).select(group, "window_start", label, "weight", "fold", vector_to_array("probability")[1].alias("score"))

        out = evaluation.cross_predict(rows, folds, group, trained)
        cv = out.persist()
        best = evaluation.calibrate(cv, "score", label, F.col("weight")).filter("goal = 'balanced_accuracy'").first()
        self.thresh = float(best.thresh) if best else 0.5
        cv = cv.withColumn("predicted", (F.col("score") > self.thresh).cast("int")).withColumn("truth", F.col(label).cast("int"))
        self.smoother = Smoother().fit(cv, "predicted", "truth", "window_start", [group])
        self.forest = self._train(rows, label)
        return self.smoother.predict(cv.select(group, "window_start", "truth", "predicted", "weight", "fold", "score"), "predicted", "window_start", [group])

    def predict(self, windows: DataFrame) -> DataFrame:
        """(recording, window_start, Walk) of complete windows."""
        if self.forest is None:
            raise RuntimeError("the detector isn't trained")
        scored = self.forest.transform(self._featured(windows)).select(*WINDOW, (vector_to_array("probability")[1] > self.thresh).cast("int").alias("raw"))
        return self.smoother.predict(scored, "raw", "window_start", ["recording"], "Walk").select(*WINDOW, "Walk")


@dataclass
class NetworkDetector:
    """A place for a neural network: load() gives, once in each worker, a function from windows (n, 3, time) to logits (n, 2). The pretrained network itself isn't part of this package."""

    load: Callable[[], Callable[[np.ndarray], np.ndarray]]
    sample_rate: int = 30
    batch_size: int = 512
    smoother: Smoother = field(default_factory=Smoother)

    def logits(self, windows: DataFrame) -> DataFrame:
        load, size = self.load, self.batch_size

        # An iterator of batches, so that the network is loaded once for each task.
        @F.pandas_udf("array<double>")
        def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            net = load()
            for x, y, z in parts:
                w = np.stack(stacked(x, y, z)).transpose(0, 2, 1)
                got = np.concatenate([net(w[i : i + size]) for i in range(0, len(w), size)])
                yield pd.Series(got.astype(float).tolist())

        return windows.withColumn("logits", run("x", "y", "z"))

    def predict(self, windows: DataFrame) -> DataFrame:
        raw = self.logits(windows).select(*WINDOW, (F.col("logits")[1] > F.col("logits")[0]).cast("int").alias("raw"))
        if self.smoother.transmat is None:
            return raw.withColumnRenamed("raw", "Walk")
        return self.smoother.predict(raw, "raw", "window_start", ["recording"], "Walk").select(*WINDOW, "Walk")


@dataclass
class ThresholdDetector:
    """Walks are windows whose magnitude varies: a detector that needs no training."""

    least: float = 0.1

    def predict(self, windows: DataFrame) -> DataFrame:
        norm = F.zip_with(F.zip_with("x", "y", lambda a, b: a * a + b * b), F.transform("z", lambda c: c * c), lambda a, c: F.sqrt(a + c))
        v = windows.select(*WINDOW, norm.alias("v"))
        mean = F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v")
        square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b) / F.size("v")
        return v.select(*WINDOW, (F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) >= self.least).cast("int").alias("Walk"))


def nelder_mead(f: Callable[[np.ndarray], float], start: list[float], bounds: list[tuple[float, float]], most: int = 80, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Least of f within bounds by a simplex that is cut back to them."""
    low, high = np.array(bounds, float).T
    cut = lambda x: np.clip(x, low, high)
    x0 = cut(np.array(start, float))
    points = [x0]
    for i in range(len(x0)):
        p = x0.copy()
        p[i] *= 1.05
        points.append(cut(p))
    values = [f(p) for p in points]
    used = len(values)
    while used < most:
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if np.abs(np.array(points[1:]) - points[0]).max() < tol and abs(values[-1] - values[0]) < tol:
            break
        centre = np.mean(points[:-1], axis=0)
        tries = lambda k: cut(centre + k * (centre - points[-1]))
        p = tries(1.0)
        v = f(p)
        used += 1
        if v < values[0]:
            q = tries(2.0)
            w = f(q)
            used += 1
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            q = tries(0.5 if v < values[-1] else -0.5)
            w = f(q)
            used += 1
            if w >= min(v, values[-1]):
                points = [points[0], *[points[0] + (x - points[0]) / 2 for x in points[1:]]]
                values = [values[0], *[f(x) for x in points[1:]]]
                used += len(points) - 1
                continue
            p, v = q, w
        points[-1], values[-1] = p, v
    best = int(np.argmin(values))
    return points[best], values[best]


@dataclass
class StepModel:
    """Counts steps in fixed windows. Steps of windows with fewer than steptol are 0, though their times stay."""

    detector: Any = field(default_factory=ThresholdDetector)
    window_sec: float = 5
    sample_rate: int = 100
    steptol: int = 3
    pnr: float = 1.0
    lowpass_hz: float = 5
    distance: float | None = None
    prominence: float | None = None
    scores: dict[str, list[dict]] = field(default_factory=dict)

    @property
    def window_len(self) -> int:
        return math.ceil(self.window_sec * self.sample_rate)

    def windows(self, samples: DataFrame) -> DataFrame:
        """(recording, window_start, x, y, z) of just window_len samples, or NULL arrays."""
        w = windows_from_start(samples, self.window_sec, XYZ)
        return w.select(*WINDOW, *[fixed_length(F.col(a), self.window_len).alias(a) for a in XYZ])

    def predict(self, windows: DataFrame) -> DataFrame:
        """(recording, time, Steps, Walk, times): NULL where a window isn't complete."""
        if self.distance is None or self.prominence is None:
            raise RuntimeError("the counter isn't trained: call fit() or give distance and prominence")
        good = windows.filter(complete())
        walk = self.detector.predict(good)
        # Only windows of walking reach the kernel.
        busy = good.join(walk.filter("Walk = 1"), WINDOW, "left_semi")
        peaks = busy.select(*WINDOW, step_peaks(F.col("x"), F.col("y"), F.col("z"), self.sample_rate, self.distance, self.prominence, self.lowpass_hz).alias("times"))
        out = windows.select(*WINDOW).join(walk, WINDOW, "left").join(peaks, WINDOW, "left")
        n = F.coalesce(F.size("times"), F.lit(0)).cast("double")
        steps = F.when(F.col("Walk").isNotNull(), F.when(F.col("times").isNull() | (n < self.steptol), 0.0).otherwise(n))
        return out.select("recording", F.col("window_start").alias("time"), steps.alias("Steps"), F.col("Walk").cast("double").alias("Walk"), "times")

    def predict_samples(self, samples: DataFrame) -> DataFrame:
        return self.predict(self.windows(samples))

    @staticmethod
    def step_times(predicted: DataFrame) -> DataFrame:
        """(recording, time) of every step."""
        return predicted.select("recording", micros("time").alias("us"), F.explode("times").alias("s")).select("recording", at_micros(F.col("us") + F.round(F.col("s") * 1e6)).alias("time"))

    def fit(self, windows: DataFrame, steps: str = "steps") -> StepModel:
        """Train detector and peak search on windows (recording, window_start, x, y, z, steps)."""
        rows = windows.filter(complete()).withColumn("w_true", (F.col(steps) >= self.steptol).cast("int")).withColumn("y_true", F.when(F.col(steps) >= self.steptol, F.col(steps)).otherwise(0).cast("double"))
        cv = self.detector.fit(rows, "w_true") if hasattr(self.detector, "fit") else None
        found = cv.select(*WINDOW, F.col("smoothed").alias("Walk"), "fold") if cv is not None else self.detector.predict(rows).withColumn("fold", F.lit(0))
        weighed = evaluation.sample_weight(rows, "w_true", self.pnr).join(found, WINDOW)
        rate, lowpass = self.sample_rate, self.lowpass_hz

        @F.pandas_udf("array<double>")
        def magnitude(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
            return pd.Series(list(dsp.magnitude(np.stack(stacked(x, y, z)), rate, lowpass)))

        # The trace is made once; every trial of the search counts peaks in it.
        traces = weighed.filter("Walk = 1").select(*WINDOW, magnitude("x", "y", "z").alias("v"), "y_true", "weight").persist()

        def counted(v, distance: float, prominence: float):
            @F.pandas_udf("double")
            def run(part: pd.Series) -> pd.Series:
                return pd.Series([float(len(dsp.find_peaks(np.asarray(t), distance * rate, prominence)[0])) for t in part])

            return run(v)

        def loss(p: np.ndarray) -> float:
            got = evaluation.regression(traces.withColumn("y", counted(F.col("v"), float(p[0]), float(p[1]))), "y_true", "y", F.col("weight")).first()
            return float(got.mae) if got and got.mae is not None else 0.0

        best, _ = nelder_mead(loss, [0.5, 0.5], [(0.2, 2.0), (0.15, 1.0)])
        self.distance, self.prominence = float(best[0]), float(best[1])
        told = traces.select(*WINDOW, counted(F.col("v"), self.distance, self.prominence).alias("y_pred"))
        judged = weighed.select(*WINDOW, "w_true", F.col("Walk").alias("w_pred"), "fold", "y_true", "weight").join(told, WINDOW, "left").withColumn("y_pred", F.coalesce("y_pred", F.lit(0.0)))
        w = F.col("weight")
        by_kind = {
            "walk_detector": evaluation.over_folds(evaluation.classification(judged, "w_true", "w_pred", w, ["fold"]), ["accuracy", "f1", "precision", "recall", "balanced_accuracy"]),
            "step_counter": evaluation.over_folds(evaluation.regression(judged, "y_true", "y_pred", w, ["fold"]), ["mae", "rmse", "mape"]),
            "step_counter_walk": evaluation.over_folds(evaluation.regression(judged.filter("w_true = 1"), "y_true", "y_pred", w, ["fold"]), ["mae", "rmse", "mape"]),
        }
        self.scores = {k: [r.asDict() for r in v.collect()] for k, v in by_kind.items()}
        traces.unpersist()
        return self

    def save(self, folder: str) -> None:
        """Parameters as JSON, the forest beside them; nothing is pickled."""
        Path(folder).mkdir(parents=True, exist_ok=True)
        d = self.detector
        par = {k: getattr(self, k) for k in ("window_sec", "sample_rate", "steptol", "pnr", "lowpass_hz", "distance", "prominence", "scores")}
        if isinstance(d, ForestDetector):
            s = d.smoother
            par["forest"] = {"sample_rate": d.sample_rate, "thresh": d.thresh, "labels": s.labels, **{k: np.asarray(getattr(s, k)).tolist() for k in ("startprob", "emissionprob", "transmat")}}
            d.forest.write().overwrite().save(f"{folder}/forest")
        elif isinstance(d, ThresholdDetector):
            par["least"] = d.least
        Path(folder, "model.json").write_text(json.dumps(par, indent=1))

    @staticmethod
    def load(folder: str, md5: str | None = None) -> StepModel:
        """md5: of model.json; another file raises ValueError."""
        from pyspark.ml.classification import RandomForestClassificationModel

        par = load_checked(f"{folder}/model.json", md5, lambda path: json.loads(Path(path).read_text()))
        forest, least = par.pop("forest", None), par.pop("least", None)
        out = StepModel(**par)
        if forest:
            s = Smoother(forest["labels"], *[np.asarray(forest[k]) for k in ("startprob", "emissionprob", "transmat")])
            out.detector = ForestDetector(forest["sample_rate"], thresh=forest["thresh"], smoother=s, forest=RandomForestClassificationModel.load(f"{folder}/forest"))
        elif least is not None:
            out.detector = ThresholdDetector(least)
        return out
