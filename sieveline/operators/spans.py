"""Span algebra on arrays of struct<start, end, label, text>, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,text:string>"
SPANS = f"array<{SPAN}>"


def empty() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str, label: str) -> Column:
    """Spans of a pattern's matches: the gaps between matches and the matches' lengths give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    steps = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), empty().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["hit"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), F.lit(label).alias("label"), x["hit"].alias("text")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, step)["out"]).otherwise(empty())


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def claim(candidates: Column) -> Column:
    """Greedy claiming in the array's order: a span is kept if it overlaps none kept before; the result is by start."""
    kept = F.aggregate(candidates, empty(), lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(kept)


def merge_by_priority(first: Column, second: Column) -> Column:
    """Spans of ``first``, and those of ``second`` that overlap none of them or of their own earlier ones."""
    return claim(F.concat(F.array_sort(first), F.array_sort(second)))


def leftmost_longest(spans: Column) -> Column:
    """Overlaps removed from the left; of those that start together the longest stays."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x.alias("span"))))
    kept = F.aggregate(order, F.struct(F.lit(-1).alias("last"), empty().alias("out")), lambda acc, x: F.when(x["start"] < acc["last"], acc).otherwise(F.struct(x["span"]["end"].alias("last"), F.concat(acc["out"], F.array(x["span"])).alias("out"))))
    return kept["out"]


def labels(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"])))


def replaced(text: Column, spans: Column, by: str = "[{}]") -> Column:
    """The text with each span replaced by its label in ``by``; spans must be sorted and apart. Built from the gaps, so no offset moves."""
    pre, post = by.split("{}")
    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda acc, x: F.struct(x["end"].alias("at"), F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(pre), F.upper(x["label"]), F.lit(post)).alias("out")))
    return F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text)))


def leftovers(text: Column, spans: Column, least: int = 4) -> Column:
    """Spans whose own text of at least ``least`` characters still occurs in ``text``."""
    return F.filter(spans, lambda x: (F.length(x["text"]) >= least) & F.contains(text, x["text"]))


def exact_matches(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(label, gold, found, hits): one-to-one matches of equal (key, start, end, label), each copy used once.

    Both sides are counted per distinct span first, so nothing is numbered or paired.
    """
    spans = [key, "span_start", "span_end", "label"]
    g, f = gold.groupBy(*spans).agg(F.count(F.lit(1)).alias("g")), found.groupBy(*spans).agg(F.count(F.lit(1)).alias("f"))
    both = g.join(f, spans, "full").select("label", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("f", F.lit(0)).alias("f"))
    return both.groupBy("label").agg(F.sum("g").alias("gold"), F.sum("f").alias("found"), F.sum(F.least("g", "f")).alias("hits"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to (label, gold, found, hits); 0 where undefined."""
    p = F.coalesce(F.try_divide(F.col("hits"), F.col("found")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("hits"), F.col("gold")), F.lit(0.0))
    return counts.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6))


def overlap_matches(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, gold, found, hits): greedy one-to-one matches of overlapping spans of a key, labels ignored: found spans by
    start, each takes the first free gold span it overlaps. Only spans of one key meet, in one row's arrays."""
    def arrays(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").cast("int").alias("start"), F.col("span_end").cast("int").alias("end")))).alias(name))

    both = arrays(gold, "g").join(arrays(found, "f"), key, "full")
    none = F.array().cast("array<struct<start:int,end:int>>")
    both = both.withColumn("g", F.coalesce("g", none)).withColumn("f", F.coalesce("f", none))

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc["free"], lambda y: overlaps(x, y)), True)
        left = F.when(at > 0, F.filter(acc["free"], lambda y, i: i != at - 1)).otherwise(acc["free"])
        return F.struct(left.alias("free"), (acc["hits"] + (at > 0).cast("int")).alias("hits"))

    hits = F.aggregate("f", F.struct(F.col("g").alias("free"), F.lit(0).alias("hits")), step)["hits"]
    return both.select(key, F.size("g").cast("long").alias("gold"), F.size("f").cast("long").alias("found"), hits.cast("long").alias("hits"))


def number_occurrences(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``occurrence``, from 1, among rows of one key."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
