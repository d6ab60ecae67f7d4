"""Building blocks that keep plans safe at large scale.

* ``materialize`` cuts lineage with a parquet table in the cluster's shared folder.
* ``lookup_join`` joins a large table to a table of one row per key; it broadcasts only
  after counting the small side, and salts hot keys otherwise.
* ``prefix_sums`` computes running sums over a global order without a one-task window.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What may be broadcast: both are counted before.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
HOT_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the checkpoint folder the context was given. Only a
    local session without either, as in tests, gets a temporary one; on a cluster that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = given.get() if given.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="sieveline-")
        spark.sparkContext.setCheckpointDir(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written to and read again from the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"sieveline-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that no later plan reads."""
    for t in tables:
        path = getattr(t, "_sieveline_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes of values; reads no more than ``rows + 1`` rows."""
    def width(c: str, kind: str) -> Column:
        col = F.col(f"`{c}`")
        if kind in ("string", "binary"):
            return F.octet_length(col)
        return F.octet_length(F.to_json(F.struct(col))) if kind.startswith(("array", "map", "struct")) else F.lit(8)

    widths = [F.coalesce(width(c, kind), F.lit(8)).cast("long") for c, kind in df.dtypes]
    n, used = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(widths[1:], widths[0])), F.lit(0))).first()
    return n <= rows and used <= size


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salt_from: Column | None = None,
                weight: str | None = None, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Joins ``big`` to ``small``, which has one row per ``key``.

    The small side is broadcast only if it has at most ``broadcast_rows`` rows and BROADCAST_BYTES bytes (counted).
    Otherwise both sides shuffle; if ``weight`` names a column of ``small`` with the number of big rows per key, keys
    above ``hot_rows`` are split over ``ceil(weight / hot_rows)`` salts (there are at most ``rows / hot_rows`` such keys,
    so their list is bounded by design and broadcast), and ``salt_from`` spreads the big rows of a hot key.
    """
    if fits_broadcast(small, broadcast_rows):
        return big.join(F.broadcast(small), key, how)
    if weight is None or salt_from is None:
        return big.join(small, key, how)
    split = F.ceil(F.col(weight) / F.lit(hot_rows)).cast("int")
    hot = small.where(F.col(weight) > hot_rows).select(key, split.alias("_salts"))
    big = big.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_from), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_salts")
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(split, F.lit(1)) - 1)))
    return big.join(small, [key, "_salt"], how).drop("_salt")


def skew_join(left: DataFrame, right: DataFrame, key: str, spread_left: Column, spread_right: Column, hot_rows: int = HOT_ROWS, most: int | None = None, maybe: str | None = None) -> DataFrame:
    """Inner join of many rows to many on ``key``. A key with more than ``hot_rows`` rows on a side is split over several
    tasks: that side's rows by a hash of its ``spread``, the other side's rows repeated for each part.

    ``most``: a number of rows that no key exceeds on either side, if the caller knows one; up to ``hot_rows`` it saves
    counting. ``maybe``: a boolean column of both, left out of the result, without which no row has a key that is hot; only
    such rows are counted. Otherwise both tables are read twice, so give materialized ones. At most ``rows / hot_rows`` keys are hot, so their list is
    broadcast; without any the join is an ordinary one. Null keys match nothing.
    """
    counted = [left, right]
    if maybe:
        counted, left, right = [t.where(maybe) for t in counted], left.drop(maybe), right.drop(maybe)
    if most is not None and most <= hot_rows:
        return left.join(right, key)

    def heavy(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).count().where((F.col("count") > hot_rows) & F.col(key).isNotNull()).select(key, F.ceil(F.col("count") / F.lit(hot_rows)).cast("int").alias(name))

    hot = heavy(counted[0], "_l").join(heavy(counted[1], "_r"), key, "full")
    hot = left.sparkSession.createDataFrame(hot.collect(), hot.schema)
    if hot.isEmpty():
        return left.join(right, key)

    def parted(df: DataFrame, own: str, other: str, spread: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64(spread), F.coalesce(own, F.lit(1)).cast("long")).cast("int")
        out = df.join(F.broadcast(hot), key, "left").withColumn("_own", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
        return out.withColumnRenamed("_own", f"_part{own}").withColumnRenamed("_other", f"_part{other}").drop("_l", "_r")

    return parted(left, "_l", "_r", spread_left).join(parted(right, "_r", "_l", spread_right), [key, "_part_l", "_part_r"]).drop("_part_l", "_part_r")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str = "before", parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come earlier in ``order``.

    Rows are range-partitioned by (group, order), so one group of any size spreads over many partitions; sums per
    partition are small, their own running sums give each partition's offset, and only rows of one partition are
    ever ordered together. ``order`` must be unique within a group. Null groups are groups of their own.
    """
    spark = df.sparkSession
    keys = [F.col(c) for c in [*group, *order]]
    ranged = materialize(df.repartitionByRange(parts or n_parts(spark), *keys).withColumn("_pid", F.spark_partition_id()), "ranged")
    cols = [F.col(c) for c in group]
    sums = ranged.groupBy(*cols, "_pid").agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[c.alias(f"_g{i}") for i, c in enumerate(cols)], F.col("_pid").alias("_p"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_off"))
    cond = F.col("_pid") == F.col("_p")
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy("_pid", *cols).orderBy(*[F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(own), F.lit(0)))
    joined = local.join(offsets, cond, "inner")
    return joined.withColumn(out, (F.col("_local") + F.col("_off")).cast("long")).select(*df.columns, out)


def frames(columns: dict[str, list], rows: int = 50_000):
    """Frames of bounded size with plain object columns: Arrow then gets one chunk per column."""
    n = len(next(iter(columns.values())))
    for i in range(0, n, rows):
        yield pd.DataFrame({c: pd.Series(list(v[i : i + rows]), dtype="object") for c, v in columns.items()})


def most_used(counts: DataFrame, key: str, uses: str, n: int) -> dict:
    """The keys used most, as {key: uses}: at most ``n`` of them, cut at a number of uses and not by rank.

    The cut comes from a histogram of at most 600 buckets, so no task and not the driver ever holds more than ``n`` keys.
    """
    counts = materialize(counts, "counts")
    bucket = F.floor(F.log2(F.col(uses)) * 8).cast("int")
    histogram = counts.groupBy(bucket.alias("b")).count().collect()
    cut, total = None, 0
    for r in sorted(histogram, key=lambda r: -r["b"]):
        total += r["count"]
        if total > n:
            break
        cut = r["b"]
    out = {} if cut is None else {r[key]: r[uses] for r in counts.where(bucket >= cut).select(key, uses).collect()}
    release(counts)
    return out


def bounded_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """About ``n`` rows at most, chosen by a hash of ``keys``: all of a small table, the same ones of the same table."""
    total = df.count()
    if total <= n:
        return df
    share = n / total
    return df.where(F.pmod(F.xxhash64(*keys, F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * n)
