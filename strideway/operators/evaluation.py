"""Scores of models: weights, metrics by fold, thresholds, ordered folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.session import written

QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def sample_weight(df: DataFrame, label: str, pnr: float | None = None) -> DataFrame:
    """df with a weight: 1, but rows labelled 0 weigh (number of ones) / (pnr x number of zeros)."""
    if pnr is None:
        return df.withColumn("weight", F.lit(1.0))
    totals = df.agg(F.sum((F.col(label) == 1).cast("int")).alias("_ones"), F.sum((F.col(label) == 0).cast("int")).alias("_zeros"))
    zero = F.try_divide(F.col("_ones").cast("double"), F.lit(float(pnr)) * F.col("_zeros"))
    return df.crossJoin(F.broadcast(totals)).withColumn("weight", F.when(F.col(label) == 0, zero).otherwise(1.0)).drop("_ones", "_zeros")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(df: DataFrame, true: str, predicted: str, weight: Column | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, accuracy, f1, precision, recall, balanced_accuracy), weighted; a ratio without a denominator is 0."""
    w = F.lit(1.0) if weight is None else weight
    cell = lambda t, p: F.sum(F.when((F.col(true) == t) & (F.col(predicted) == p), w).otherwise(0.0))
    c = df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    sides = [F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)]
    present = sum((F.when(s.isNotNull(), 1).otherwise(0) for s in sides), F.lit(0))
    balanced = _share(sum((F.coalesce(s, F.lit(0.0)) for s in sides), F.lit(0.0)), present)
    return c.select(*by, _share(tp + tn, tp + fp + fn + tn).alias("accuracy"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"), _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), balanced.alias("balanced_accuracy"))


def regression(df: DataFrame, true: str, predicted: str, weight: Column | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, mae, rmse, mape), weighted; mape adds one to both sides where the truth is 0."""
    w = F.lit(1.0) if weight is None else weight
    error = F.abs(F.col(true) - F.col(predicted))
    part = error / F.abs(F.when(F.col(true) == 0, 1.0).otherwise(F.col(true)))
    return df.groupBy(*by).agg(F.try_divide(F.sum(w * error), F.sum(w)).alias("mae"), F.sqrt(F.try_divide(F.sum(w * error * error), F.sum(w))).alias("rmse"), F.try_divide(F.sum(w * part), F.sum(w)).alias("mape"))


def over_folds(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, min, Q1, med, Q3, max, mean, std) of scores by fold; std is of the population."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")).select("s.*")
    q = F.percentile("v", F.array(*[F.lit(x) for x in QUARTILES]))
    found = long.groupBy("metric").agg(q.alias("q"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return found.select("metric", *[F.col("q")[i].alias(n) for i, n in enumerate(("min", "Q1", "med", "Q3", "max"))], "mean", "std")


def class_report(df: DataFrame, true: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """(class, precision, recall, f1, support), weighted."""
    w = (F.lit(1.0) if weight is None else weight).alias("w")
    rows = df.select(F.col(true).alias("t"), F.col(predicted).alias("p"), w).groupBy("t", "p").agg(F.sum("w").alias("w"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit("t").alias("side")), F.struct(F.col("p").alias("class"), F.lit("p").alias("side")))).alias("x")
    got = rows.select("t", "p", "w", sides).groupBy("x.class").agg(
        F.sum(F.when((F.col("x.side") == "t") & (F.col("t") == F.col("p")), F.col("w")).otherwise(0.0)).alias("hit"),
        F.sum(F.when(F.col("x.side") == "t", F.col("w")).otherwise(0.0)).alias("support"),
        F.sum(F.when(F.col("x.side") == "p", F.col("w")).otherwise(0.0)).alias("said"),
    )
    return got.select("class", _share(F.col("hit"), F.col("said")).alias("precision"), _share(F.col("hit"), F.col("support")).alias("recall"), _share(2 * F.col("hit"), F.col("said") + F.col("support")).alias("f1"), "support")


def curve(df: DataFrame, score: str, true: str, weight: Column | None = None) -> DataFrame:
    """(thresh, tp, fp, pos, neg, precision, recall, f1, tpr, fpr, balanced_accuracy) for each score, if all rows with it or more are called positive.

    Rows of one score are summed, scores dealt out by range; running sums are of a range, plus what the ranges above have in all."""
    w = F.lit(1.0) if weight is None else weight
    by = df.groupBy(F.col(score).alias("thresh")).agg(F.sum(F.when(F.col(true) == 1, w).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(true) == 0, w).otherwise(0.0)).alias("b"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written down, as a range's number must not change any more.
    ranged = written(by.repartitionByRange(n, F.col("thresh").desc()).withColumn("_range", F.spark_partition_id()), "scores")
    above = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    sums = ranged.groupBy("_range").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))  # a row for each of n ranges
    told = sums.select("_range", *[F.coalesce(F.sum(f"_{x}").over(above), F.lit(0.0)).alias(f"{x}0") for x in "ab"], F.sum("_a").over(every).alias("pos"), F.sum("_b").over(every).alias("neg"))
    down = Window.partitionBy("_range").orderBy(F.col("thresh").desc())
    run = ranged.join(F.broadcast(told), "_range").select("thresh", (F.col("a0") + F.sum("a").over(down)).alias("tp"), (F.col("b0") + F.sum("b").over(down)).alias("fp"), "pos", "neg")
    tp, fp = F.col("tp"), F.col("fp")
    precision, recall, fpr = _share(tp, tp + fp), _share(tp, F.col("pos")), _share(fp, F.col("neg"))
    f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return run.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), recall.alias("tpr"), fpr.alias("fpr"), ((recall + 1 - fpr) / 2).alias("balanced_accuracy"))


def calibrate(df: DataFrame, score: str, true: str, weight: Column | None = None, precision_tol: float = 0.9, recall_tol: float = 0.9) -> DataFrame:
    """One row for each goal (balanced_accuracy, f1, precision, recall): the threshold that is best, of equals the first one tried.

    Thresholds are tried from the highest for balanced accuracy, else from the lowest; precision and recall take the first above their tolerance, or the first of all."""
    low = -F.col("thresh")
    tried = {
        "balanced_accuracy": (F.round("balanced_accuracy", 12), F.col("thresh")),
        "f1": (F.round("f1", 12), low),
        "precision": ((F.col("precision") > precision_tol).cast("int"), low),
        "recall": ((F.col("recall") > recall_tol).cast("int"), low),
    }
    row = F.struct("thresh", "precision", "recall", "f1", "tpr", "fpr", "balanced_accuracy")
    best = curve(df, score, true, weight).agg(*[F.max_by(row, F.struct(v.alias("v"), o.alias("o"))).alias(goal) for goal, (v, o) in tried.items()])
    return best.select(F.explode(F.array(*[F.struct(F.lit(g).alias("goal"), F.col(g).alias("x")) for g in tried])).alias("g")).select("g.goal", "g.x.*")


def ordered_folds(df: DataFrame, group: str, position: str, n: int = 5) -> DataFrame:
    """(group, fold): groups in order of first appearance, cut into n runs, the first ones longer by one; n of -1 leaves one group out at a time."""
    groups = df.groupBy(group).agg(F.min(position).alias("_first"))
    placed = groups.withColumn("_i", F.row_number().over(Window.orderBy("_first")) - 1).withColumn("_k", F.count("*").over(Window.partitionBy()))
    if n == -1:
        return placed.select(group, F.col("_i").alias("fold"))
    size, rest = F.expr(f"_k div {n}"), F.expr(f"_k % {n}")
    long = rest * (size + 1)
    late = rest + F.floor(F.try_divide(F.col("_i") - long, size))
    return placed.select(group, F.when(F.col("_i") < long, F.floor(F.col("_i") / (size + 1))).otherwise(late).cast("int").alias("fold"))


def held_out(df: DataFrame, group: str, share: float = 0.2, seed: int = 41) -> tuple[DataFrame, DataFrame]:
    """(train, test): a seeded share of the groups, rounded up, is held out, whole groups at a time; a group without a name is trained on."""
    groups = df.select(F.col(group).alias("_group")).filter(F.col(group).isNotNull()).distinct()
    few = groups.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_group").cast("string"))), "_group").limit(math.ceil(round(groups.count() * share, 9)))
    few = written(few, "held-out")
    same = df[group] == few["_group"]
    return df.join(few, same, "left_anti"), df.join(few, same, "left_semi")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(notwalk, walk): weights of the two classes in training, nine times the ratio of walk to other windows, and one."""
    n = lambda v: F.sum((F.col(label) == v).cast("int"))
    return df.agg(F.try_divide(n(1) * 9.0, n(0)).alias("notwalk"), F.lit(1.0).alias("walk"))


def cross_predict(df: DataFrame, folds: DataFrame, group: str, fit) -> DataFrame:
    """Rows as models predict them that have not seen their group: fit(train) gives a function from rows to predicted rows. folds: (group, fold)."""
    rows = df.join(folds, group)  # folds grow with the groups: whether they are sent is Spark's choice
    out = None
    for k in sorted(r.fold for r in folds.select("fold").distinct().collect()):  # a model for each fold
        part = fit(rows.filter(F.col("fold") != k))(rows.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out
