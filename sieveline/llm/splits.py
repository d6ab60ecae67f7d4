"""Splits that keep related records together.

Distributed union-find: every partition reduces its links to a local spanning forest, forests are merged
hierarchically; then groups go, largest first, to the split furthest below its target.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import frames, lookup_join, materialize, prefix_sums

#: Names that stand for no entity.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nan", "none", "null", "unknown", "unspecified", "tbd", "todo", "missing", "undefined"]


def project_key(name: Column) -> Column:
    """A project name without case, blanks, separators and path or repository decorations; NULL for placeholders."""
    low = F.lower(F.regexp_replace(name, r"(?U)\s+", ""))
    path = F.regexp_replace(F.regexp_replace(low, r"[/\\]+$", ""), r"\.git$", "")
    last = F.regexp_extract(path, r"([^/\\:]*)$", 1)
    key = F.regexp_replace(last, r"[-_.,;'\"()\[\]]+", "")
    return F.when(name.isNull() | low.isin(PLACEHOLDERS) | (key == ""), F.lit(None).cast("string")).otherwise(key)


def _local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over one partition's links; yields (node, root) with the smallest node of a tree as root."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"], pdf["b"]):
            ra, rb = find(a), find(b)
            if ra != rb:
                lo, hi = (ra, rb) if ra < rb else (rb, ra)
                parent[hi] = lo
                parent.setdefault(lo, lo)
    nodes = list(parent)
    for i in range(0, len(nodes), 100_000):
        part = [x for x in nodes[i : i + 100_000] if find(x) != x]
        yield from frames({"a": part, "b": [find(x) for x in part]})


def _forest(links: DataFrame) -> DataFrame:
    return links.mapInPandas(_local_forest, "a string, b string")


def _star_rounds(forest: DataFrame) -> DataFrame:
    """Exact finish for forests too large for one task: alternating large-star and small-star until nothing changes."""
    edges = forest
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = materialize(small.unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "star")
        # Stars only: no node is both a centre and a leaf.
        if nxt.join(nxt.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and nxt.groupBy("a").count().where("count > 1").isEmpty():
            return nxt
        edges = nxt


def connected_components(links: DataFrame, task_links: int = 2_000_000) -> DataFrame:
    """(node, component) for every node of ``links`` (a STRING, b STRING); the component is its smallest node.

    Nulls and self links are ignored; repeated links and an empty table are fine. Local forests are merged in rounds;
    one merging task never gets more than about ``task_links`` links. A forest that no longer shrinks and still
    exceeds that is finished by star contraction, which needs no single task, with the same result.
    """
    links = links.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a <> b")
    forest = materialize(_forest(links), "forest")
    n = forest.count()
    while n > task_links:
        nxt = materialize(_forest(forest.repartition(max(2, math.ceil(n / task_links)))), "forest")
        m = nxt.count()
        forest, n, before = nxt, m, n
        if m > 0.7 * before:
            break
    stars = _forest(forest.coalesce(1)) if n <= task_links else _star_rounds(forest)
    stars = materialize(stars, "components")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def allot(sizes: list[tuple[int, int]], targets: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """Greedy over a histogram of group sizes [(size, how many)]: largest first, each group to the split furthest
    below its target. Groups of one size are alike, so a class is placed in bulk, with the same result as one by one.

    Returns (size, split, first rank, last rank + 1). Ties go to the split named first.
    """
    total, weight = sum(s * c for s, c in sizes), sum(targets.values())
    names = list(targets)
    gap = [total * targets[n] / weight for n in names]
    out = []
    for s, c in sorted(sizes, reverse=True):
        took, left = [0] * len(names), c
        active = list(range(len(names)))
        while left > 4 * len(names) and active:
            level = (sum(gap[j] for j in active) - left * s) / len(active)
            low = [j for j in active if gap[j] < level]
            if low:
                active = [j for j in active if j not in low]
                continue
            for j in active:
                k = max(0, math.floor((gap[j] - level) / s) - 2)
                took[j] += k
                gap[j] -= k * s
                left -= k
            break
        heap = [(-gap[j], j) for j in range(len(names))]
        heapq.heapify(heap)
        for _ in range(left):
            g, j = heapq.heappop(heap)
            took[j] += 1
            heapq.heappush(heap, (g + s, j))
        gap = [-g for g, j in sorted(heap, key=lambda x: x[1])]
        rank = 0
        for j, k in enumerate(took):
            if k:
                out.append((s, names[j], rank, rank + k))
                rank += k
    return out


def group_names(df: DataFrame, group: str, aliases: DataFrame | None) -> DataFrame:
    """(name_key, component, n): each distinct normalised name of ``df`` with its component and its number of rows."""
    names = df.select(project_key(F.col(group)).alias("name_key")).where("name_key IS NOT NULL").groupBy("name_key").agg(F.count(F.lit(1)).alias("n"))
    if aliases is None:
        return names.select("name_key", F.col("name_key").alias("component"), "n")
    links = aliases.select(project_key(F.col(aliases.columns[0])).alias("a"), project_key(F.col(aliases.columns[1])).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    comp = connected_components(links).withColumnRenamed("node", "name_key")
    return lookup_join(names, comp, "name_key").select("name_key", F.coalesce("component", "name_key").alias("component"), "n")


def group_splits(df: DataFrame, record: str, group: str, aliases: DataFrame | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """(record, group_key, new_split) with all records of one entity in one split.

    ``df``: one row per record; ``group``: the entity's name as recorded; ``aliases``: (alias, name), in several
    steps if need be. A record without a usable name (null, blank, placeholder) is a group of its own. Rows with a
    null record id count and are kept. Rows that repeat an id all appear, those of no entity in one split. An empty table gives an empty result. Other
    columns are ignored, whatever their names. Groups are placed largest first; the histogram of sizes that goes to
    the driver has at most sqrt(2 * records) entries, whatever the number of groups.
    """
    targets = targets or {"train": 0.8, "validation": 0.1, "test": 0.1}
    spark = df.sparkSession
    rows = df.select(F.col(record).alias("record"), F.col(group).alias("grp"))
    names = materialize(group_names(rows, "grp", aliases), "names")
    rows = rows.withColumn("name_key", project_key(F.col("grp"))).drop("grp")
    comps = names.groupBy("component").agg(F.sum("n").cast("long").alias("size"))
    # Records of no entity are alike: they only need a count here and a rank below.
    alone = rows.where("name_key IS NULL").select("record")
    units = comps.select(F.concat(F.lit("g:"), "component").alias("unit"), "size")
    hist = units.groupBy("size").count().collect()
    n_alone = alone.count()
    by_size = {r["size"]: r["count"] for r in hist}
    plan = allot([*[(s, c) for s, c in by_size.items() if s != 1], *([(1, by_size.get(1, 0) + n_alone)] if by_size.get(1, 0) + n_alone else [])], targets)
    slots = spark.createDataFrame(plan, "size long, new_split string, lo long, hi long") if plan else spark.createDataFrame([], "size long, new_split string, lo long, hi long")
    ranked = prefix_sums(units.withColumn("h", F.xxhash64("unit")).withColumn("one", F.lit(1)), ["size"], ["h", "unit"], "one", "rank")
    # At most one slot per size and split, so at most 3 * sqrt(2 * records) rows.
    split_of = ranked.join(F.broadcast(slots), "size").where("rank >= lo AND rank < hi").select(F.substring("unit", 3, 1 << 30).alias("component"), "new_split")
    placed = names.join(split_of, "component").select("name_key", F.col("component").alias("group_key"), "new_split", "n")
    grouped = lookup_join(rows.where("name_key IS NOT NULL"), placed, "name_key", "inner", F.col("record"), "n").select("record", "group_key", "new_split")
    first = by_size.get(1, 0)
    single = alone.groupBy("record").agg(F.count(F.lit(1)).alias("copies")).withColumn("h", F.xxhash64("record")).withColumn("g", F.lit(0))
    single = prefix_sums(single, ["g"], ["h", "record"], "copies", "rank")
    single = single.withColumn("rank", F.col("rank") + first).join(F.broadcast(slots.where("size = 1")), F.expr("rank >= lo AND rank < hi"))
    single = single.select("record", F.lit(None).cast("string").alias("group_key"), "new_split", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("k")).drop("k")
    return grouped.unionByName(single).withColumnRenamed("record", record)


def split_leaks(df: DataFrame, record: str, group: str, split: str, aliases: DataFrame | None = None, train: str = "train", held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """Records of the ``held_out`` splits whose entity also has records in ``train``, by the components of ``group_names``."""
    rows = df.select(F.col(record).alias("record"), F.col(group).alias("grp"), F.lower(F.trim(F.col(split))).alias("side"))
    keyed = rows.withColumn("name_key", project_key(F.col("grp"))).where("name_key IS NOT NULL").select("record", "name_key", "side")
    names = group_names(rows, "grp", aliases)
    seen = keyed.groupBy("name_key").agg(F.max(F.col("side") == train).alias("t"), F.sum(F.col("side").isin(*held_out).cast("long")).alias("n_held"))
    both = materialize(names.drop("n").join(seen, "name_key"), "names")
    leaky = both.groupBy("component").agg(F.max("t").alias("t")).where("t").select("component")
    leaky = both.where("n_held > 0").join(leaky, "component").select("name_key", "n_held")
    return lookup_join(keyed.where(F.col("side").isin(*held_out)), leaky, "name_key", "inner", F.col("record"), "n_held").select(F.col("record").alias(record))
