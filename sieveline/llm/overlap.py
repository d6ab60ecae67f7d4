"""Same or near-same records across splits.

Word n-grams of the held-out records are hashed and partitioned by hash; training records are scanned against them
for hits; each held-out record that is hit gets its containment per training record, and an exact check decides.

Which n-grams are looked up: two records that have at least ``similarity`` of the longer one's n-grams in common share
one among the first ``n - ceil(similarity * n) + 1`` of each in any common order, so only those are needed, and no
pair is lost. The order puts rare n-grams first, which keeps the hits few; it comes from counts over all records, by
bucket of n-grams. Those that the other side lacks come before all others and need no lookup.

A hit's bags, counts of n-grams by bucket, tell whether its records can be alike at all; only then are texts compared.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import HOT_ROWS, fits_broadcast, frames, lookup_join, materialize, release, skew_join

COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*", re.S)
RUN = re.compile(r"\w+")
#: Buckets of n-grams, as powers of two: of all at most, and parts of them. Buckets of a record's bag.
MOST_BITS, PART_BITS, BAG = 26, 8, 128


def words(text: str) -> list[str]:
    return RUN.findall(text.lower())


def code_runs(code: str) -> list[str]:
    """Runs of letters, digits and underscores in lower case, without comments."""
    return RUN.findall(COMMENT.sub(" ", code).lower())


def ngrams(text: str, tokens: Callable[[str], list[str]], n: int) -> list[str]:
    t = tokens(text)
    if n == 1:
        return t
    return [" ".join(t[i : i + n]) for i in range(len(t) - n + 1)] or ([" ".join(t)] if t else [])


def _key(count: Counter) -> bytes:
    """The class of exact copies: records with the same n-grams, as often."""
    return hashlib.md5("\n".join(f"{g}\0{c}" for g, c in sorted(count.items())).encode("utf-8", "surrogatepass")).digest()


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _level(uses: np.ndarray) -> np.ndarray:
    """0, 1, and from 2 on one more than the logarithm, rounded up; at most 15."""
    return np.where(uses > 0, np.minimum(1 + np.ceil(np.log2(np.maximum(uses, 1))), 15), 0).astype(np.uint8)


def _counts(tokens: Callable, n: int, bits: int) -> Callable:
    """Uses per bucket of n-grams in held-out and in training records, a row for each part of the buckets."""
    mask, low = (1 << bits) - 1, max(bits - PART_BITS, 0)

    def packed(held: Counter, trained: Counter) -> Iterator[pd.DataFrame]:
        grams = np.array(sorted({g & mask for c in (held, trained) for g in c}), np.int64)
        uses = np.zeros((2, len(grams)), np.int64)
        for row, count in zip(uses, (held, trained)):
            np.add.at(row, np.searchsorted(grams, np.fromiter((g & mask for g in count), np.int64, len(count))), np.fromiter(count.values(), np.int64, len(count)))
        parts, starts = np.unique(grams >> low, return_index=True)
        cut = [(grams[i:j], uses[:, i:j]) for i, j in zip(starts, [*starts[1:], len(grams)])]
        yield from frames({"part": [int(k) for k in parts], "at": [(g & ((1 << low) - 1)).astype(np.int32).tobytes() for g, _ in cut], "uses": [np.minimum(u, (1 << 31) - 1).astype(np.int32).tobytes() for _, u in cut]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for pdf in batches:
            own: dict[bool, Counter] = {True: Counter(), False: Counter()}
            for text, held in zip(pdf["text"], pdf["held"]):
                own[bool(held)].update(ngrams(text, tokens, n))
            for side, c in own.items():
                for g, k in c.items():
                    count[side][_hash(g)] += k
            if len(count[True]) + len(count[False]) > 1_000_000:
                yield from packed(count[True], count[False])
                count = {True: Counter(), False: Counter()}
        yield from packed(count[True], count[False])

    return run


def _levels(bits: int) -> Callable:
    """The levels of one part of the buckets: held-out in the upper four bits, training in the lower."""
    width = 1 << max(bits - PART_BITS, 0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uses = np.zeros((2, width), np.int64)
        for at, u in zip(pdf["at"], pdf["uses"]):
            uses[:, np.frombuffer(at, np.int32)] += np.frombuffer(u, np.int32).reshape(2, -1)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "levels": [(_level(uses[0]) << 4 | _level(uses[1])).tobytes()]})

    return run


def gram_levels(rows: DataFrame, tokens: Callable, n: int, records: int) -> np.ndarray:
    """Upper bounds, by bucket of hashed n-grams, of the uses in held-out and in training records, as ``_level`` has them.
    The more ``records``, the more buckets.

    At most 2 ** MOST_BITS bytes reach the driver, whatever the table.
    """
    bits = min(max(math.ceil(math.log2(records + 1)) + 6, 12), MOST_BITS)
    low = max(bits - PART_BITS, 0)
    counts = rows.select("text", "held").mapInPandas(_counts(tokens, n, bits), "part int, at binary, uses binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in counts.groupBy("part").applyInPandas(_levels(bits), "part int, levels binary").collect():
        out[r["part"] << low : (r["part"] + 1) << low] = np.frombuffer(r["levels"], np.uint8)
    return out


def _lookups(tokens: Callable, n: int, similarity: float, levels) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, mask, seen = levels.value, len(levels.value) - 1, set()
        for pdf in batches:
            keys, sizes, tops, hot, bags = [], [], [], [], []
            for text, held in zip(pdf["text"], pdf["held"]):
                count = Counter(ngrams(text, tokens, n))
                size, key = sum(count.values()), _key(count)
                hashes, uses = np.fromiter((_hash(g) for g in count), np.int64, len(count)), np.fromiter(count.values(), np.int64, len(count))
                top, most = [], 0
                if (key, bool(held)) not in seen:  # of copies in one task, the first looks up for all
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add((key, bool(held)))
                    e, t = (both := level[hashes & mask].astype(np.int64)) >> 4, both & 15
                    rank = np.where((e > 0) & (t > 0), e + t, 0)
                    need = size - math.ceil(similarity * size - 1e-9) + 1
                    for i in np.lexsort((hashes, rank)).tolist():
                        if need <= 0:
                            break
                        # The i-th use of an n-gram is a key of its own. What the other side never has finds nothing.
                        c, h = int(uses[i]), int(hashes[i])
                        if rank[i]:
                            top += [(h + k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(min(c, need))]
                            most = max(most, int(e[i]), int(t[i]))
                        need -= c
                keys.append(key)
                sizes.append(size)
                tops.append(top)
                hot.append(most == 15)
                bags.append(np.minimum(np.bincount((hashes >> 40) & (BAG - 1), uses, BAG), 255).astype(np.uint8).tobytes())
            yield from frames({"record": list(pdf["record"]), "held": list(pdf["held"]), "key": keys, "size": sizes, "grams": tops, "hot": hot, "bag": bags})

    return run


def _possible(similarity: float) -> Callable:
    """Drops candidates whose bags differ more than those of records that are alike can; none that is alike is lost.

    Sums by bucket, and cut to 255, differ by no more than the n-grams do, and records that differ by d n-grams of x + y
    have (x + y - d) / 2 in common.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                e, t = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, BAG).astype(np.int16) for c in ("bag_e", "bag_t"))
                x, y = pdf["size_e"].to_numpy(np.int64), pdf["size_t"].to_numpy(np.int64)
                ok = (x + y - np.abs(e - t).sum(axis=1)) / 2 >= similarity * np.maximum(x, y) - 1e-6
                yield pdf.loc[ok, ["class_e", "class_t"]]

    return run


def _contain(tokens: Callable, n: int, similarity: float) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, kept = [], {}
            for a, b, ka, kb in zip(pdf["text_e"], pdf["text_t"], pdf["key_e"], pdf["key_t"]):
                pair = []
                for text in (a, b):
                    if text not in kept:
                        if len(kept) > 2000:
                            kept.clear()
                        count = Counter(ngrams(text, tokens, n))
                        kept[text] = count, _key(count)
                    pair.append(kept[text])
                (x, kx), (y, ky) = pair
                if kx != bytes(ka) or ky != bytes(kb):  # another text under the same id
                    out.append((-1, 1, 1))
                    continue
                if len(x) > len(y):
                    small, large = y, x
                else:
                    small, large = x, y
                common = sum(min(c, large[g]) for g, c in small.items() if g in large)
                out.append((common, sum(x.values()), sum(y.values())))
            pdf = pdf[["key_e", "key_t"]].copy()
            pdf["containment"] = [c / e if e else 1.0 for c, e, _ in out]
            pdf["alike"] = [c / max(e, t) if max(e, t) else 1.0 for c, e, t in out]
            yield pdf[pdf["alike"] >= similarity - 1e-9]

    return run


def _texts(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """``reps`` with the texts of their records. Only texts of records in some candidate pair are shuffled, and about one in
    30 of the others where many are sought."""
    if fits_broadcast(reps):
        return rows.join(F.broadcast(reps), "record")
    bits = min(max(math.ceil(math.log2(reps.count())) + 5, 12), MOST_BITS + 3)
    at = F.pmod(F.xxhash64("record"), F.lit(1 << bits))

    def set_bits(part: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << (bits - PART_BITS), np.uint8)
        flags[part["at"].to_numpy() & ((1 << (bits - PART_BITS)) - 1)] = 1
        return pd.DataFrame({"part": [int(part["at"].iloc[0]) >> (bits - PART_BITS)], "flags": [np.packbits(flags).tobytes()]})

    flags = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (bits - PART_BITS - 3)
    for r in reps.select(at.alias("at")).groupBy(F.shiftright("at", bits - PART_BITS).alias("p")).applyInPandas(set_bits, "part int, flags binary").collect():
        flags[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["flags"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(flags)

    @F.pandas_udf("boolean")
    def sought(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value
        for x in batches:
            i = x.to_numpy()
            yield pd.Series((f[i >> 3] >> (7 - (i & 7)) & 1).astype(bool))

    return rows.where(sought(at)).join(reps, "record")


def cross_split_classes(df: DataFrame, record: str, text: str, split: str, tokens: Callable[[str], list[str]] = words, n: int = 5, similarity: float = 0.8,
                        train: str = "train", held_out: tuple[str, ...] = ("validation", "test")) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (key_e, key_t, containment, alike, largest) between classes of exact copies, held-out and training,
    that have at least ``similarity`` of the longer one's n-grams in common, counted with multiplicity; members (record,
    held, key). ``containment`` is the share of the held-out record's n-grams, ``largest`` the
    size of the largest class of all.

    A class of copies on both sides is linked to itself. No group of copies is expanded into pairs. Null texts are in no
    class; texts without any word are left out too, as they share nothing. Splits are compared without case and blanks;
    other splits, nulls included, are ignored. Empty tables give empty results. Other columns are ignored. Texts are read
    whole; no number of partners or candidates is capped.
    """
    kind = dict(df.dtypes)[record]
    side = F.lower(F.trim(F.col(split)))
    rows = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("text"), side.isin(*held_out).alias("held"), (side == train).alias("tr"))
    rows = rows.where("(held OR tr) AND text IS NOT NULL AND record IS NOT NULL").drop("tr")
    spark = df.sparkSession
    # Any order gives the same result, this one few candidates.
    levels = spark.sparkContext.broadcast(gram_levels(rows, tokens, n, df.count()))
    looked = materialize(rows.mapInPandas(_lookups(tokens, n, similarity, levels), f"record {kind}, held boolean, key binary, size int, grams array<long>, hot boolean, bag binary").where("size > 0"), "lookups")
    # The shuffled n-grams carry a 64-bit class number; classes that share one only make candidates the check refuses.
    number = F.xxhash64("key").alias("class")
    classes = materialize(looked.groupBy("key").agg(F.min("record").alias("rep"), F.max("held").alias("has_e"), F.min("held").alias("only_e"), F.count(F.lit(1)).alias("n")), "classes")
    held = looked.where("held").select(F.explode("grams").alias("gram"), number.alias("class_e"), F.col("size").alias("size_e"), "hot")
    trained = looked.where("NOT held").select(F.explode("grams").alias("gram"), number.alias("class_t"), F.col("size").alias("size_t"), "hot")
    near = F.least("size_e", "size_t") >= F.greatest("size_e", "size_t") * F.lit(similarity) - F.lit(1e-9)
    met = skew_join(held, trained, "gram", F.col("class_e"), F.col("class_t"), maybe="hot")
    hits = materialize(met.where((F.col("class_e") != F.col("class_t")) & near).select("class_e", "class_t").distinct(), "hits")
    bags = [looked.where(side).groupBy(number).agg(F.first("size").alias("size"), F.first("bag").alias("bag")) for side in ("held", "NOT held")]
    pairs = hits.join(bags[0].toDF("class_e", "size_e", "bag_e"), "class_e").join(bags[1].toDF("class_t", "size_t", "bag_t"), "class_t")
    able = materialize(pairs.select("class_e", "class_t", "size_e", "size_t", "bag_e", "bag_t").mapInPandas(_possible(similarity), "class_e long, class_t long"), "able")
    wanted = able.select(F.col("class_e").alias("class")).unionByName(able.select(F.col("class_t").alias("class"))).distinct()
    reps = materialize(classes.select(number, "key", F.col("rep").alias("record")).join(wanted, "class"), "reps")
    texts = materialize(_texts(rows.select("record", "text"), reps).select("class", "key", "text"), "texts")
    pairs = able.join(texts.toDF("class_e", "key_e", "text_e"), "class_e").join(texts.toDF("class_t", "key_t", "text_t"), "class_t")
    alike = pairs.select("key_e", "key_t", "text_e", "text_t").mapInPandas(_contain(tokens, n, similarity), "key_e binary, key_t binary, containment double, alike double").distinct()
    same = classes.where("has_e AND NOT only_e").select(F.col("key").alias("key_e"), F.col("key").alias("key_t"), F.lit(1.0).alias("containment"), F.lit(1.0).alias("alike"))
    largest = classes.agg(F.max("n")).first()[0] or 0
    links = materialize(alike.unionByName(same).withColumn("largest", F.lit(largest).cast("long")), "alike")
    members = materialize(looked.select("record", "held", "key"), "members")
    release(looked, hits, able, reps, texts, classes)
    return links, members


def cross_split_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(held_id, train_id, containment, alike): the links of ``cross_split_classes`` for each member. Repeated ids give
    repeated pairs. Classes of many members are split over tasks."""
    held = members.where("held").select(F.col("record").alias("held_id"), F.col("key").alias("key_e"))
    trained = members.where("NOT held").select(F.col("record").alias("train_id"), F.col("key").alias("key_t"))
    # No class meets more rows on a side of either join than its links times the members of the largest class.
    most = max((links.groupBy(k).agg(F.count(F.lit(1)).alias("n"), F.max("largest").alias("m")).agg(F.max(F.col("n") * F.col("m"))).first()[0] or 0 for k in ("key_e", "key_t")))
    some = skew_join(held, links.drop("largest"), "key_e", F.col("held_id"), F.col("key_t"), most=most).select("held_id", "key_t", "containment", "alike")
    if most > HOT_ROWS:
        some = materialize(some, "some")
    return skew_join(some, trained, "key_t", F.col("held_id"), F.col("train_id"), most=most).select("held_id", "train_id", "containment", "alike")


def overlap_counts(links: DataFrame, members: DataFrame) -> DataFrame:
    """(record, class_id, links): each held-out record of a linked class, the smallest id of its class, and the number of
    training records it is alike to; no pair is expanded."""
    classes = members.groupBy("key").agg(F.min("record").alias("class_id"), F.count(F.expr("CASE WHEN NOT held THEN 1 END")).alias("n"), F.count(F.expr("CASE WHEN held THEN 1 END")).alias("n_held"))
    classes = materialize(classes, "sizes")
    sizes = links.join(classes.select(F.col("key").alias("key_t"), "n"), "key_t").groupBy(F.col("key_e").alias("key")).agg(F.sum("n").cast("long").alias("links"))
    sizes = materialize(sizes.join(classes.select("key", "class_id", "n_held"), "key"), "links")
    return lookup_join(members.where("held").select("record", "key"), sizes, "key", "inner", F.col("record"), "n_held").select("record", "class_id", "links")


def overlap_report(df: DataFrame, record: str, split: str, source: str, counts: DataFrame, held_out: tuple[str, ...] = ("validation", "test")) -> DataFrame:
    """(split, source, held_records, overlapping, pairs) per held-out split and source as recorded, from
    ``overlap_counts``; a null source is a source of its own."""
    rows = df.select(F.col(record).alias("record"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source")).where(F.col("split").isin(*held_out))
    hit = counts.groupBy("record").agg(F.sum("links").alias("n"))
    return rows.join(hit, "record", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("held_records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs"))
