"""Signature triage of C and C++ code, candidate weaknesses, and checks of a proposed patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.code import STUB, signature_of, windowed_counts
from ..functions.text import count_matches

#: Patterns counted natively, weights, cap and limits of the levels.
UNSAFE_CALL = r"\b(?:strcpy|strcat|sprintf|vsprintf|gets)\s*\("
SIZE_ARITHMETIC = r"\b(?:malloc|calloc|realloc|kmalloc|kzalloc|vmalloc|alloca|g_malloc)\s*\([^;]*?[*+][^;]*?\)"
WEIGHTS = {"unsafe_func": 3, "memcpy_unchecked": 3, "format_string": 4, "unchecked_alloc": 2, "double_free": 5, "use_after_free": 5, "size_int_overflow": 2}
CAP, LOW, MEDIUM = 3, 3, 8
#: Weaknesses that each category hints at, and the cluster most often confused.
HINTS = {"unsafe_func": ["120", "119"], "memcpy_unchecked": ["787", "125", "119"], "format_string": ["134"], "unchecked_alloc": ["476"], "double_free": ["415"], "use_after_free": ["416"], "size_int_overflow": ["190"]}
CLUSTER = ["119", "787", "125", "120", "20"]
BUFFER = ["unsafe_func", "memcpy_unchecked", "size_int_overflow"]


def native_counts(code: Column) -> dict[str, Column]:
    return {"unsafe_func": count_matches(code, UNSAFE_CALL), "size_int_overflow": count_matches(code, SIZE_ARITHMETIC)}


def level(score: Column) -> Column:
    return F.when(score == 0, "none").when(score <= LOW, "low").when(score <= MEDIUM, "medium").otherwise("high")


def scored(df: DataFrame, code: str, windows: bool = True) -> DataFrame:
    """Adds n_<category>, risk_score, risk_level and categories. A null code counts as empty. Without ``windows``
    only the categories that need no look around their place are counted, and nothing leaves the JVM."""
    text = F.coalesce(F.col(code), F.lit(""))
    counts = native_counts(text)
    if windows:
        df = df.withColumn("_w", windowed_counts(text))
        counts |= {c: F.col(f"_w.{c}").cast("long") for c in WEIGHTS if c not in counts}
    order = [c for c in WEIGHTS if c in counts]
    df = df.withColumns({f"n_{c}": counts[c] for c in order})
    score = sum((F.least(F.col(f"n_{c}"), F.lit(CAP)) * WEIGHTS[c] for c in order), F.lit(0)).cast("long")
    hit = F.array_compact(F.array(*[F.when(F.col(f"n_{c}") > 0, F.lit(c)) for c in order]))
    df = df.withColumn("risk_score", score).withColumn("risk_level", level(F.col("risk_score"))).withColumn("categories", hit)
    return df.drop("_w") if windows else df


def summary(df: DataFrame) -> DataFrame:
    """(risk_level, fragments, mean_score, median_score) of a scored table."""
    return df.groupBy("risk_level").agg(F.count(F.lit(1)).alias("fragments"), F.round(F.avg("risk_score"), 6).alias("mean_score"), F.median("risk_score").cast("double").alias("median_score"))


def candidate_cwes(categories: Column, scanner: Column | None = None) -> Column:
    """Candidate weakness numbers in a fixed order: by category, the buffer cluster where it applies, the scanner's."""
    lists = [F.when(F.array_contains(categories, c), F.array(*map(F.lit, HINTS[c]))).otherwise(F.array().cast("array<string>")) for c in WEIGHTS]
    buffer = F.arrays_overlap(categories, F.array(*map(F.lit, BUFFER))) | (F.size(categories) == 0)
    lists.append(F.when(buffer, F.array(*map(F.lit, CLUSTER))).otherwise(F.array().cast("array<string>")))
    if scanner is not None:
        lists.append(F.transform(F.coalesce(scanner, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "^CWE-", "")))
    return F.array_distinct(F.concat(*lists))


def top_rules(df: DataFrame, key: str, cwes: str, rules: DataFrame, k: int = 5) -> DataFrame:
    """(key, rule, rank): rules that share a weakness with ``cwes``, those with the fewest linked weaknesses first.

    ``rules``: (rule, ord, cwes array). An equi-join on exploded weaknesses, so neither side is crossed.
    """
    mine = df.select(key, F.explode(F.array_distinct(cwes)).alias("cwe"))
    theirs = rules.select("rule", "ord", F.size("cwes").alias("n"), F.explode(F.array_distinct("cwes")).alias("cwe"))
    hits = mine.join(theirs, "cwe").select(key, "rule", "ord", "n").distinct()
    best = hits.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "ord", "rule"))), 1, k).alias("best"))
    return best.select(key, F.posexplode("best").alias("rank", "r")).select(key, F.col("r.rule").alias("rule"), (F.col("rank") + 1).alias("rank"))


def patch_checks(df: DataFrame, original: str, patched: str) -> DataFrame:
    """Adds signature_status, functionality_status, pattern_status and passed for a patch of ``original``.

    A blank or null patch fails with unknown, missing, unknown.
    """
    o, p = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(patched), F.lit(""))
    keep = df.columns
    blank = F.trim(F.regexp_replace(p, r"\s+", " ")) == ""
    df = df.withColumn("_so", signature_of(o)).withColumn("_sp", signature_of(p)).withColumn("_wo", windowed_counts(o)).withColumn("_wp", windowed_counts(p))
    unknown = F.col("_so.name").isNull() | F.col("_sp.name").isNull()
    equal = (F.col("_so.name") == F.col("_sp.name")) & (F.col("_so.n_params") == F.col("_sp.n_params"))
    sig = F.when(blank | unknown, "unknown").when(equal, "preserved").otherwise("changed")
    lo, lp = F.length(F.regexp_replace(o, r"\s+", "")), F.length(F.regexp_replace(p, r"\s+", ""))
    func = F.when(blank | (lp < 10), "missing").when(F.rlike(p, F.lit(f"(?i){STUB.pattern}")) | ((lo > 0) & (lp / lo < 0.3)), "suspect").otherwise("present")
    before, after = native_counts(o), native_counts(p)
    before |= {c: F.col(f"_wo.{c}") for c in WEIGHTS if c not in before}
    after |= {c: F.col(f"_wp.{c}") for c in WEIGHTS if c not in after}
    had = sum(((before[c] > 0).cast("int") for c in WEIGHTS), F.lit(0))
    kept = sum((((before[c] > 0) & (after[c] >= before[c])).cast("int") for c in WEIGHTS), F.lit(0))
    pattern = F.when(blank, "unknown").when(had == 0, "not_applicable").when(kept > 0, "still_present").otherwise("gone")
    df = df.select(*keep, sig.alias("signature_status"), func.alias("functionality_status"), pattern.alias("pattern_status"))
    good = F.col("signature_status").isin("preserved", "unknown") & (F.col("functionality_status") == "present") & F.col("pattern_status").isin("gone", "not_applicable")
    return df.withColumn("passed", good)
