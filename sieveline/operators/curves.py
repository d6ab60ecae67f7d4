"""Threshold and budget curves.

Scores are first counted per distinct value; running sums then go over these counts with ``prefix_sums``-like windows
of at most as many rows as there are distinct rounded scores. Ranks over single rows use a range partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import prefix_sums
from .metrics import counts, rates, ratio


def _grid(df: DataFrame, thresholds: list[float]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double"))


def _by_score(df: DataFrame, score: str, digits: int, *aggs) -> DataFrame:
    """Counts per score rounded to ``digits``: at most 10**digits + 1 rows, whatever the table."""
    return df.where(F.col(score).isNotNull()).groupBy(F.round(F.col(score), digits).alias("s")).agg(*aggs)


def escalation(df: DataFrame, confidence: str, correct: str, steps: int = 20) -> DataFrame:
    """(threshold, escalation_rate, auto_count, auto_accuracy): rows below a threshold go to a person; the accuracy is
    that of the others, NULL if there are none. Thresholds are inclusive. Null confidences are left out."""
    per = _by_score(df, confidence, 9, F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("long")).alias("ok"))
    grid = per.join(_grid(df, [i / steps for i in range(steps + 1)]), F.lit(True))
    auto = F.col("s") >= F.col("threshold")
    g = grid.groupBy("threshold").agg(F.sum("n").alias("all"), F.sum(F.when(auto, F.col("n")).otherwise(0)).alias("auto_count"), F.sum(F.when(auto, F.col("ok")).otherwise(0)).alias("ok"))
    return g.select("threshold", F.round(ratio(F.col("all") - F.col("auto_count"), F.col("all")), 6).alias("escalation_rate"), "auto_count", F.round(F.try_divide(F.col("ok").cast("double"), F.col("auto_count").cast("double")), 6).alias("auto_accuracy"))


def coverage(df: DataFrame, confidence: str, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """(threshold, coverage, grey_zone_share, tp.. and rates) of the rows at or above each confidence."""
    per = df.where(F.col(confidence).isNotNull()).groupBy(F.round(F.col(confidence), 9).alias("s"), F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    grid = per.join(_grid(df, thresholds), F.lit(True))
    on = F.col("s") >= F.col("threshold")
    part = lambda a, b: F.sum(F.when(on & (F.col("y") == a) & (F.col("p") == b), F.col("n")).otherwise(0))
    g = grid.groupBy("threshold").agg(F.sum("n").alias("all"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("kept"), part(1, 1).alias("tp"), part(0, 1).alias("fp"), part(1, 0).alias("fn"), part(0, 0).alias("tn"))
    c = ratio(F.col("kept"), F.col("all"))
    return rates(g.withColumn("coverage", F.round(c, 6)).withColumn("grey_zone_share", F.round(1 - c, 6)).drop("all", "kept"))


def sla(df: DataFrame, record: str, confidence: str, y: str, p: str, budgets: list[float]) -> DataFrame:
    """(budget, n_escalated, caught, total, catch_rate): the ``ceil(budget * n)`` least confident go to a person, who
    catches all; the others are caught if predicted. Ties go by record id; null confidences come first."""
    rows = df.select(F.col(record).alias("r"), F.coalesce(F.col(confidence), F.lit(-1.0)).alias("c"), F.col(y).alias("y"), F.col(p).alias("p")).where("y IS NOT NULL").withColumn("one", F.lit(1)).withColumn("g", F.lit(0))
    ranked = prefix_sums(rows, ["g"], ["c", "r"], "one", "rank")
    total = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))
    grid = F.broadcast(df.sparkSession.createDataFrame([(float(b),) for b in budgets], "budget double").join(total)).withColumn("n_escalated", F.ceil(F.round(F.col("budget") * F.col("n"), 9)))
    hit = (F.col("y") == 1) & ((F.col("rank") < F.col("n_escalated")) | (F.col("p") == 1))
    return ranked.join(grid, F.lit(True)).groupBy("budget", "n_escalated", "total").agg(F.count_if(hit).alias("caught")).withColumn("catch_rate", F.round(ratio(F.col("caught"), F.col("total")), 6))


def budget_top(df: DataFrame, record: str, score: str, y: str, budgets: list[float]) -> DataFrame:
    """(budget, k, tp.. and rates) of calling the first ``floor(budget * n)`` by falling score positive; ties by record."""
    rows = df.select(F.col(record).alias("r"), (-F.col(score)).alias("s"), F.col(y).alias("y")).where("y IS NOT NULL AND s IS NOT NULL").withColumn("one", F.lit(1)).withColumn("g", F.lit(0))
    ranked = prefix_sums(rows, ["g"], ["s", "r"], "one", "rank")
    n = ranked.agg(F.count(F.lit(1)).alias("n"))
    grid = F.broadcast(df.sparkSession.createDataFrame([(float(b),) for b in budgets], "budget double").join(n)).withColumn("k", F.floor(F.round(F.col("budget") * F.col("n"), 9)))
    marked = ranked.join(grid, F.lit(True)).withColumn("p", (F.col("rank") < F.col("k")).cast("int"))
    return rates(marked.groupBy("budget", "k").agg(*counts(F.col("y"), F.col("p"))))


def running(df: DataFrame, score: str, y: str, digits: int = 6) -> DataFrame:
    """(s, tp, fp, pos, neg): positives and negatives at or above each distinct rounded score."""
    per = _by_score(df.where(F.col(y).isNotNull()), score, digits, F.sum(F.col(y).cast("long")).alias("np"), F.sum((1 - F.col(y)).cast("long")).alias("nn"))
    w = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy()
    return per.select("s", F.sum("np").over(w).alias("tp"), F.sum("nn").over(w).alias("fp"), F.sum("np").over(total).alias("pos"), F.sum("nn").over(total).alias("neg"))


def recall_at_fpr(df: DataFrame, score: str, y: str, targets: list[float], digits: int = 6) -> DataFrame:
    """(target_fpr, recall, threshold): the best recall of any threshold with at most that rate of false alarms; ties of
    a score stand or fall together; recall 0 and threshold NULL if even the highest score has too many."""
    grid = running(df, score, y, digits).join(F.broadcast(df.sparkSession.createDataFrame([(float(t),) for t in targets], "target_fpr double")), F.lit(True))
    ok = ratio(F.col("fp"), F.col("neg")) <= F.col("target_fpr")
    return grid.groupBy("target_fpr").agg(F.round(F.coalesce(F.max(F.when(ok, ratio(F.col("tp"), F.col("pos")))), F.lit(0.0)), 6).alias("recall"), F.min(F.when(ok, F.col("s"))).alias("threshold"))


def best_f1(df: DataFrame, score: str, y: str, digits: int = 6) -> DataFrame:
    """(threshold, f1): the threshold among the rounded scores with the highest F1, the lowest on ties."""
    r = running(df, score, y, digits)
    p, rc = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("pos"))
    r = r.select(F.col("s").alias("threshold"), F.round(ratio(2 * p * rc, p + rc), 6).alias("f1"))
    return r.orderBy(F.desc("f1"), "threshold").limit(1)


def length_rank(df: DataFrame, record: str, value: str) -> DataFrame:
    """(record, value, rank): rank / n from 0, ties by record."""
    rows = df.select(F.col(record).alias("r"), F.col(value).alias("v")).withColumn("one", F.lit(1)).withColumn("g", F.lit(0))
    ranked = prefix_sums(rows, ["g"], ["v", "r"], "one", "before")
    n = F.broadcast(ranked.agg(F.count(F.lit(1)).alias("n")))
    return ranked.join(n, F.lit(True)).select(F.col("r").alias(record), F.col("v").alias(value), (F.col("before") / F.col("n")).alias("rank"))


def strata(df: DataFrame, value: str, parts: int = 20) -> DataFrame:
    """Adds ``stratum``: bins between quantiles, closed on the right, equal edges dropped."""
    edges = df.agg(F.percentile(F.col(value).cast("double"), F.array(*[F.lit(i / parts) for i in range(parts + 1)])).alias("e")).withColumn("e", F.array_distinct("e"))
    below = F.size(F.filter("e", lambda x: x < F.col(value))).cast("int")
    return df.join(F.broadcast(edges), F.lit(True)).withColumn("stratum", F.greatest(below - 1, F.lit(0))).drop("e")


def stratified_lift(df: DataFrame, value: str, y: str, p: str, parts: int = 20) -> DataFrame:
    """(observed, expected, lift): positives among flagged rows against those expected at the rate of unflagged rows of
    the same stratum; strata without either kind are left out."""
    g = strata(df.where(F.col(y).isNotNull()), value, parts).groupBy("stratum").agg(
        F.sum(F.when(F.col(p) == 1, F.col(y)).otherwise(0)).alias("obs"), F.sum(F.when(F.col(p) == 0, F.col(y)).otherwise(0)).alias("rest"), F.count_if(F.col(p) == 1).alias("a"), F.count_if(F.col(p) == 0).alias("b"))
    g = g.where("a > 0 AND b > 0").agg(F.sum("obs").alias("observed"), F.sum(F.col("a") * F.col("rest") / F.col("b")).alias("e"))
    return g.select("observed", F.round("e", 6).alias("expected"), F.round(ratio(F.col("observed"), F.col("e")), 6).alias("lift"))
