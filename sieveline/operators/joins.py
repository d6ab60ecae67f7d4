"""Joins and reconciliations by key: overlays, conflict elimination, leakage by hash, agreement of sources, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import prefix_sums
from .metrics import counts


def stratified_sample(df: DataFrame, record: str, stratum: str, n: int, seed: int = 42) -> DataFrame:
    """About ``n`` rows with each stratum's share, at least one of each: ``max(1, round(size * n / all))`` rows per
    stratum, the first by a hash of seed and record. A null stratum is a stratum; repeated records count as rows.

    A hash range that surely holds the first rows is cut out before ranks are taken, and ranks come from range
    partitions, so a stratum of any size, and a sample of any size, spreads over tasks.
    """
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("unmatched"))
    rows = df.withColumn("_s", s).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(record).cast("string"))))
    sizes = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_size"))
    total = F.broadcast(sizes.agg(F.sum("_size").alias("_all")))
    take = F.greatest(F.lit(1), F.bround(F.col("_size") * n / F.col("_all")).cast("long"))
    sizes = sizes.join(total, F.lit(True)).select("_s", "_size", take.alias("_take"))
    # Eight times the share and 64 rows more hold the first rows except with negligible probability.
    reach = F.least(F.lit(1.0), (F.col("_take") * 8 + 64) / F.col("_size"))
    first = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / float(1 << 32)
    near = rows.join(sizes, "_s").where(first <= reach).withColumn("_one", F.lit(1)).withColumn("_row", F.monotonically_increasing_id())
    ranked = prefix_sums(near, ["_s"], ["_h", "_row"], "_one", "_rank")
    return ranked.where(F.col("_rank") < F.col("_take")).select(*df.columns)


def overlay(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` taken from ``patch`` where it has the key; keys only in ``patch`` are not added."""
    p = patch.select(key, F.struct(*columns).alias("_p"))
    new = {c: F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)) for c in columns}
    return base.join(p, key, "left").withColumns(new).withColumn("patched", F.col("_p").isNotNull()).drop("_p")


def unambiguous(df: DataFrame, key: Column, payload: Column) -> DataFrame:
    """(key, payload) of keys with a single payload; keys with different ones are dropped."""
    return df.select(key.alias("key"), payload.alias("payload")).where("key IS NOT NULL").groupBy("key").agg(F.min("payload").alias("payload"), F.max("payload").alias("_max"), F.count_if(F.col("payload").isNull()).alias("_null")).where("payload = _max AND _null = 0").drop("_max", "_null")


def leakage(pool: DataFrame, probe: DataFrame, record: str, key: Column) -> DataFrame:
    """(record, leaked): whether a probe row's key also occurs in the pool; the pool is reduced to distinct keys first."""
    seen = pool.select(key.alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    return probe.select(record, key.alias("_k")).join(seen, "_k", "left").select(record, F.coalesce("_hit", F.lit(False)).alias("leaked"))


def reconcile(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """(key, outcome, label) of two label sources with possibly repeated keys: internal_conflict, both_agree,
    both_disagree, a_only, b_only or unlabelled."""
    def one(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(key).agg(F.min(label).alias(f"{n}_lo"), F.max(label).alias(f"{n}_hi"))

    both = one(a, "a").join(one(b, "b"), key, "full")
    conflict = (F.col("a_lo") != F.col("a_hi")) | (F.col("b_lo") != F.col("b_hi"))
    outcome = (F.when(conflict, "internal_conflict").when(F.col("a_lo").isNull() & F.col("b_lo").isNull(), "unlabelled").when(F.col("a_lo").isNull(), "b_only")
               .when(F.col("b_lo").isNull(), "a_only").when(F.col("a_lo") == F.col("b_lo"), "both_agree").otherwise("both_disagree"))
    value = F.when(outcome.isin("both_agree", "a_only", "b_only"), F.coalesce("a_lo", "b_lo"))
    return both.select(key, outcome.alias("outcome"), value.alias("label"))


def agreement(df: DataFrame, by: str, a: str, b: str, least: float = 0.95) -> DataFrame:
    """(by, n, agree, inverted, accepted) of two 0/1 columns, as they are and with one turned round: a source whose labels
    are swapped shows in ``inverted``."""
    g = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("agree"), F.round(F.avg((F.col(a) == 1 - F.col(b)).cast("double")), 6).alias("inverted"))
    return g.withColumn("accepted", F.greatest("agree", "inverted") >= least)


def duplicate_groups(df: DataFrame, key: Column, label: str) -> DataFrame:
    """(groups, rows, conflicting): groups of equal keys with more than one row, and those with different labels."""
    g = df.select(key.alias("k"), F.col(label).alias("l")).where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("l").alias("lo"), F.max("l").alias("hi")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicting"))


def crosstab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """One row per value of ``a``, one column per value of ``b``, with counts and zeros."""
    return df.groupBy(a).agg(*[F.count_if(F.col(b) == v).alias(v) for v in values])


def vote(samples: DataFrame, record: str, verdict: str, order: str, positive: str, k: int) -> DataFrame:
    """(record, verdict, confidence, votes, n, first): positive with at least ``k`` such samples; the confidence is the
    share of the winning side; ``first`` is the order of the first sample that agrees."""
    pos = F.col(verdict) == positive
    g = samples.groupBy(record).agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("votes"), F.min(F.when(pos, F.col(order))).alias("first_pos"), F.min(F.when(~F.coalesce(pos, F.lit(False)), F.col(order))).alias("first_neg"))
    won = F.col("votes") >= k
    return g.select(record, won.alias("positive"), F.round(F.when(won, F.col("votes") / F.col("n")).otherwise(1 - F.col("votes") / F.col("n")), 6).alias("confidence"), "votes", "n", F.coalesce(F.when(won, F.col("first_pos")).otherwise(F.col("first_neg")), "first_pos", "first_neg").alias("first"))


def layers(df: DataFrame, flags: list[str], y: str) -> DataFrame:
    """(combination, tp, fp, fn, tn) of unions, intersections and differences of 0/1 flag columns, in one pass."""
    f = {n: F.coalesce(F.col(n), F.lit(0)) == 1 for n in flags}
    combos: dict[str, Column] = dict(f)
    for i, a in enumerate(flags):
        for b in flags[i + 1 :]:
            combos[f"{a}|{b}"], combos[f"{a}&{b}"] = f[a] | f[b], f[a] & f[b]
            combos[f"{a}-{b}"], combos[f"{b}-{a}"] = f[a] & ~f[b], f[b] & ~f[a]
    long = df.where(F.col(y).isNotNull()).select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("combination"), c.cast("int").alias("p")) for n, c in combos.items()])).alias("x"))
    return long.select("y", "x.*").groupBy("combination").agg(*counts(F.col("y"), F.col("p")))
