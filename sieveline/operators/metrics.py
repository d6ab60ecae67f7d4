"""Measures of predictions, all from one grouped count; 0 where a ratio is undefined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def counts(y: Column, p: Column) -> list[Column]:
    """tp, fp, fn, tn of 0/1 columns."""
    return [F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fpr, accuracy, youden_j and mcc to a table with tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r, fpr = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(fp, fp + tn)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    got = {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "fpr": fpr, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "youden_j": r - fpr, "mcc": ratio(tp * tn - fp * fn, root)}
    return df.withColumns({k: F.round(v, 6) for k, v in got.items()})


def binary(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """(by..., tp, fp, fn, tn and all rates) of rows in which both labels are known."""
    known = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return rates(known.groupBy(*by).agg(*counts(F.col(y), F.col(p))))


def confusion(df: DataFrame, y: str, p: str, labels: DataFrame) -> DataFrame:
    """(y_true, y_pred, n) for each pair of ``labels`` (one column ``label``, few rows), with zeros."""
    pairs = labels.select(F.col("label").alias("y_true")).join(F.broadcast(labels.select(F.col("label").alias("y_pred"))))
    n = df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).count()
    return pairs.join(n, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("count", F.lit(0)).alias("n"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each class that occurs as either."""
    n = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(y).alias("y"), F.col(p).alias("p")).count()
    sides = n.select(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0).alias("hit"), F.col("count").alias("gold"), F.lit(0).cast("long").alias("found"))
    sides = sides.unionByName(n.select(F.col("p").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("gold"), F.col("count").alias("found")))
    s = sides.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("gold").alias("support"), F.sum("found").alias("found"))
    pr, rc = ratio(F.col("hit"), F.col("found")), ratio(F.col("hit"), F.col("support"))
    return s.select("label", F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(ratio(2 * pr * rc, pr + rc), 6).alias("f1"), "support")


def averaged(classes: DataFrame) -> DataFrame:
    """(average, precision, recall, f1): macro and weighted means of ``per_class``."""
    macro = classes.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("macro").alias("average"), "*")
    weighted = classes.agg(*[F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 6).alias(c) for c in ("precision", "recall", "f1")]).select(F.lit("weighted").alias("average"), "*")
    return macro.unionByName(weighted)


def quantile_stats(df: DataFrame, value: str, above: float, *by: str) -> DataFrame:
    """(by..., n, mean, median, p90, max, min, frac_above) with linear interpolation."""
    v = F.col(value)
    q = lambda x: F.round(F.percentile(v, F.lit(x)), 6)
    return df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), q(0.5).alias("median"), q(0.9).alias("p90"), F.round(F.max(v), 6).alias("max"), F.round(F.min(v), 6).alias("min"), F.round(F.avg((v > above).cast("double")), 6).alias("frac_above"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(bin, low, high, n) with the last bin closed and empty bins kept; values outside the edges count nowhere."""
    v, last = F.col(value), len(edges) - 2
    bin_ = F.coalesce(*[F.when((v >= lo) & ((v < hi) if i < last else (v <= hi)), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))])
    n = df.groupBy(bin_.alias("bin")).count().where("bin IS NOT NULL")
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    return bins.join(n, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("n"))
