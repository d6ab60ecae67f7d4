"""Mixing sources to target weights.

Records get hash-random keys, are range-sorted within each source, and distributed prefix sums of their token counts
say where each source reaches its budget; small sources are repeated in whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import materialize, prefix_sums
from .tokens import TOKENIZER, counted

MAX_SOURCES = 100_000
PASSES = 5
SLACK = 0.001


def source_key(c: Column) -> Column:
    """A source's name without case, outer blanks and kind of separator."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), r"[-_ ]+", "_"), F.lit(""))


def plan_sources(supply: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> list[tuple[str, float, int, int, int, int, str]]:
    """(source, target share, supply, budget, whole epochs, tokens of the last epoch, note) of each target.

    Without ``total`` it is the largest with which all sources that have tokens reach their share.
    """
    can = {s: supply.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    limits = [can[s] / share for s, (share, _) in targets.items() if share > 0 and can[s] > 0]
    if total is None:
        total = min(limits, default=0.0)
    out = []
    for s, (share, repeats) in sorted(targets.items()):
        have = supply.get(s, 0)
        want = share * total
        budget = int(min(want, can[s]) + 1e-6)
        full = min(budget // have, max(0, repeats)) if have else 0
        note = "no tokens" if not can[s] else "capped" if want > can[s] + 1 else "met"
        out.append((s, share, have, budget, int(full), int(budget - full * have), note))
    return out


def mix(df: DataFrame, record: str, source: str, text: str, targets: DataFrame, total: float | None = None, seed: int = 7, path: str = TOKENIZER, fill: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: (record, source, n_tokens, repeats), one row per record in use. shares: (source,
    target_share, max_repeats, supply_tokens, budget_tokens, tokens, actual_share, note), one row per target.

    Sources are compared by ``source_key``. Records of no or another source are not used; a target without documents
    reaches nothing. Targets of one source add up, with the larger number of repeats; null shares count as 0 and
    null repeats as 1. Null and empty texts have no tokens and are never chosen. Repeated rows are records of their
    own. A source never exceeds its budget; where the record at the cut leaves a gap above SLACK of the budget, later
    records that fit in it follow in further passes. Empty tables give empty results. Other columns are ignored. The
    targets are collected: at most MAX_SOURCES rows. With ``fill`` the total is that many times the tokens of all
    sources that may be used, whatever the table's size: a source that cannot serve its share is used up to its repeats
    and noted as capped.
    """
    spark = df.sparkSession
    want = targets.select(source_key(F.col("source")).alias("s"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("r"))
    want = want.where("s IS NOT NULL").groupBy("s").agg(F.sum("share").alias("share"), F.max("r").alias("r")).limit(MAX_SOURCES + 1).collect()
    if len(want) > MAX_SOURCES:
        raise ValueError("too many target sources")
    goals = {r["s"]: (r["share"], r["r"]) for r in want}
    rows = df.select(F.col(record).alias("rec"), source_key(F.col(source)).alias("src"), F.col(text).alias("txt"))
    names = spark.createDataFrame([(s,) for s in goals], "src string")
    tokens = counted(rows.join(F.broadcast(names), "src", "left_semi").select("rec", "src", "txt"), ["rec", "src"], "txt", path).where("n_tokens > 0")
    supply = {r["k1"]: r["t"] for r in tokens.groupBy("k1").agg(F.sum("n_tokens").alias("t")).collect()}
    if fill is not None:
        total = fill * sum(t for s, t in supply.items() if min(goals[s]) > 0)
    plan = plan_sources(supply, goals, total)
    full = spark.createDataFrame([(p[0], p[4]) for p in plan], "src string, full long")
    rest = tokens.select("item", F.col("k0").alias("rec"), F.col("k1").alias("src"), "n_tokens", F.xxhash64(F.col("k0").cast("string"), F.lit(seed)).alias("h"))
    gaps, budget = {p[0]: p[5] for p in plan}, {p[0]: max(1, p[3]) for p in plan}
    once = None  # records taken one more time than the whole epochs
    for _ in range(PASSES):
        open_ = [(s, g) for s, g in gaps.items() if g > (0 if once is None else SLACK * budget[s])]
        if not open_:
            break
        room = spark.createDataFrame(open_, "src string, gap long")
        fit = rest.join(F.broadcast(room), "src").where(F.col("n_tokens") <= F.col("gap"))
        if once is not None:
            fit = fit.join(once.select("item"), "item", "left_anti")
        ordered = prefix_sums(fit, ["src"], ["h", "item"], "n_tokens", "before")
        got = materialize(ordered.where(F.col("before") + F.col("n_tokens") <= F.col("gap")).select("item", "src", "n_tokens"), "cut")
        took = {r["src"]: r["t"] for r in got.groupBy("src").agg(F.sum("n_tokens").alias("t")).collect()}
        once = got if once is None else once.unionByName(got)
        gaps = {s: gaps[s] - took.get(s, 0) for s, _ in open_ if took.get(s, 0)}
    used = rest.join(F.broadcast(full), "src")
    if once is not None:
        used = used.join(once.select("item", F.lit(1).alias("more")), "item", "left").withColumn("full", F.col("full") + F.coalesce("more", F.lit(0)))
    chosen = materialize(used.where("full > 0").select(F.col("rec").alias(record), F.col("src").alias("source"), "n_tokens", F.col("full").cast("int").alias("repeats")), "mix")
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    base = spark.createDataFrame([(p[0], float(p[1]), goals[p[0]][1], p[2], p[3], p[6]) for p in plan], "source string, target_share double, max_repeats int, supply_tokens long, budget_tokens long, note string")
    shares = base.join(F.broadcast(reached), "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    everything = reached.agg(F.sum("tokens").alias("all_tokens"))
    shares = shares.join(F.broadcast(everything), F.lit(True), "left").withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("all_tokens")), F.lit(0.0)))
    short = (F.col("note") == "met") & (F.col("tokens") < F.col("budget_tokens") * 0.98)
    shares = shares.withColumn("note", F.when(short, F.lit("records too large")).otherwise(F.col("note")))
    return chosen, shares.select("source", "target_share", "max_repeats", "supply_tokens", "budget_tokens", "tokens", "actual_share", "note")
