"""Filling fixed-capacity containers with items.

Best-two-fit: a container is filled greedily with the largest items that fit; then its smallest item gives way to two
unpacked ones if these fill the larger gap more tightly. Items are packed in blocks of bounded size, all blocks at
once; what a block leaves in loosely filled containers is packed again together with that of other blocks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import frames, materialize
from .tokens import TOKENIZER, counted

BLOCK_ITEMS = 20_000
LOOSE = 0.97
MAX_KINDS = 1_000


class _Pool:
    """Unpacked items by length; a bit set of the lengths present finds the largest that fits."""

    def __init__(self, lengths: list[int]):
        self.by: dict[int, list[int]] = {}
        self.mask = 0
        for i, n in enumerate(lengths):
            self.put(n, i)

    def put(self, n: int, i: int) -> None:
        got = self.by.setdefault(n, [])
        if not got:
            self.mask |= 1 << n
        got.append(i)

    def pop(self, n: int) -> int:
        got = self.by[n]
        i = got.pop()
        if not got:
            self.mask &= ~(1 << n)
        return i

    def fit(self, gap: int) -> int:
        """The largest length of at most ``gap``; 0 if there is none."""
        return max(0, (self.mask & ((1 << (gap + 1)) - 1)).bit_length() - 1)

    def fit_two(self, gap: int, above: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum in (above, gap]."""
        best, found, x = above, None, self.fit(gap - 1)
        while x and 2 * x > best:
            y = self.fit(min(x, gap - x))
            if y == x and len(self.by[x]) < 2:
                y = self.fit(x - 1)
            if y and x + y > best:
                best, found = x + y, (x, y)
                if best == gap:
                    break
            x = self.fit(x - 1)
        return found


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``lengths`` (each from 1 to ``capacity``) by container."""
    pool, out = _Pool(lengths), []
    while pool.mask:
        own: list[tuple[int, int]] = []
        gap = capacity
        while n := pool.fit(gap):
            own.append((n, pool.pop(n)))
            gap -= n
        while gap and len(own) > 1 and pool.mask:
            n, i = own[-1]
            pair = pool.fit_two(gap + n, n)
            if not pair:
                break
            own.pop()
            own += [(m, pool.pop(m)) for m in pair]
            own.sort(reverse=True)
            gap += n - sum(pair)
            pool.put(n, i)
        out.append([i for _, i in own])
    return out


def _pack(kinds: list[tuple[str, int]], round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"])
        block = pdf["block"].iloc[0]
        out: list[tuple] = []
        for kind, capacity in kinds:
            own = pdf[pdf["container_kind"] == kind] if round_no else pdf
            items, pieces, lengths, starts = [], [], [], []
            free: list[tuple[int, int, int]] = []
            bins = 0
            for item, piece, n, start in zip(own["item"], own["piece"], own["length"], own["start"]):
                if n == 0:
                    free.append((item, piece, start))
                    continue
                while n > capacity:  # only a text that alone exceeds the container is cut
                    out.append((kind, f"{round_no}-{block}-{bins}", item, piece, start, capacity, 1.0))
                    bins, piece, start, n = bins + 1, piece + 1, start + capacity, n - capacity
                items.append(item)
                pieces.append(piece)
                lengths.append(int(n))
                starts.append(start)
            for at in best_two_fit(lengths, capacity):
                fill = sum(lengths[i] for i in at) / capacity
                out += [(kind, f"{round_no}-{block}-{bins}", items[i], pieces[i], starts[i], lengths[i], fill) for i in at]
                bins += 1
            if free:  # empty texts take no room
                out += [(kind, f"{round_no}-{block}-{max(0, bins - 1)}", item, piece, start, 0, 1.0 if bins else 0.0) for item, piece, start in free]
        names = ["container_kind", "container_id", "item", "piece", "start", "length", "fill"]
        got = list(frames({c: [r[i] for r in out] for i, c in enumerate(names)}, max(1, len(out))))
        return got[0] if got else pd.DataFrame({c: pd.Series([], dtype="object") for c in names})

    return run


SCHEMA = "container_kind string, container_id string, item long, piece long, start long, length long, fill double"


def pack(df: DataFrame, record: str, text: str, capacities: DataFrame, kind: str = "container_kind", capacity: str = "capacity_tokens", path: str = TOKENIZER, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(container_kind, container_id, record, piece, start_token, n_tokens): every text in one container of each kind.

    A text is cut only if it alone exceeds the container: into full containers and a rest that is packed like others.
    Null and empty texts have no tokens and are put beside others. Repeated rows are items of their own. Kinds
    without a name or a positive capacity are left out; kinds of one name must agree. Empty tables give an empty
    result. Other columns are ignored. The table of kinds is collected and may have MAX_KINDS rows at most.
    """
    got = capacities.select(F.col(kind).cast("string").alias("k"), F.col(capacity).cast("int").alias("c")).where("k IS NOT NULL AND c > 0").distinct().orderBy("k").limit(MAX_KINDS + 1).collect()
    if len(got) > MAX_KINDS or len({r["k"] for r in got}) < len(got):
        raise ValueError("too many kinds of containers, or one kind with two capacities")
    kinds = [(r["k"], r["c"]) for r in got]
    tokens = counted(df, [record], text, path)
    spark = df.sparkSession
    if not kinds:
        return spark.createDataFrame([], f"container_kind string, container_id string, {record} {dict(df.dtypes)[record]}, piece long, start_token long, n_tokens long")
    n = tokens.count()
    blocks = max(1, math.ceil(n / block_items))
    items = tokens.select("item", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.col("n_tokens").alias("length"), F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"))
    packed = materialize(items.repartition(blocks, "block").groupBy("block").applyInPandas(_pack(kinds, 0), SCHEMA), "packed")
    done = []
    for round_no in (1, 2, 3):
        if blocks == 1:
            break
        loose = packed.where(F.col("fill") < LOOSE)
        m = loose.count()
        if not m:
            break
        done.append(packed.where(F.col("fill") >= LOOSE))
        blocks = max(1, math.ceil(m / len(kinds) / block_items))
        again = loose.select("container_kind", "item", "piece", "start", "length", F.pmod(F.xxhash64("item", F.lit(round_no)), F.lit(blocks)).alias("block"))
        packed = materialize(again.repartition(blocks, "block").groupBy("block").applyInPandas(_pack(kinds, round_no), SCHEMA), "packed")
    for x in done:
        packed = packed.unionByName(x)
    out = packed.join(tokens.select("item", F.col("k0").alias(record)), "item")
    return out.select("container_kind", "container_id", record, "piece", F.col("start").alias("start_token"), F.col("length").alias("n_tokens"))


def fill_report(packed: DataFrame, capacities: DataFrame, kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """(container_kind, capacity_tokens, containers, pieces, tokens, filled): ``filled`` is the share of all room that is used."""
    caps = capacities.select(F.col(kind).cast("string").alias("container_kind"), F.col(capacity).cast("int").alias("capacity_tokens")).distinct()
    bins = packed.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    sums = bins.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    return sums.join(caps, "container_kind").select("container_kind", "capacity_tokens", "containers", "pieces", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
