"""Matching entities across sources without keys.

Probabilistic record linkage: several blocking passes, comparisons in agreement levels, expectation-maximisation of
the match and non-match probabilities over all candidate pairs, and the posterior as confidence. Two such models are
chained: is it the same function, and, among those, is it the function in the same state.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scale import fits_broadcast, frames, lookup_join, materialize, most_used, release, skew_join
from .overlap import COMMENT

TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|[^\W\d]\w*|\d\w*|->|[^\s\w]')
#: Words of C and its library that are no names.
KEYWORDS = frozenset("""
if else for while do switch case default return goto break continue sizeof struct union enum static inline const volatile extern typedef register
int long short char void bool float double unsigned signed size_t ssize_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t
null nullptr true false memcpy memset memmove malloc calloc realloc free printf fprintf sprintf snprintf strcpy strncpy strcat strcmp strncmp strlen
scanf sscanf min max container_of spin_lock spin_unlock mutex_lock mutex_unlock list_for_each_entry copy_from_user copy_to_user read write open close
assert atomic_inc atomic_dec htons ntohs htonl ntohl
""".split())
COMMON_KEYS = 200_000
#: Two codes that share this part of the longer one's names, or of its runs of literals, share two blocking keys.
SHARE = 0.6
LITERALS, STATEMENTS, STATEMENT_KEYS = 3, 3, 2
CONTROL = {"if", "while", "for", "switch"}
FUNCTION = re.compile(r"([^\W\d]\w*)\s*\(")
STATEMENT_END, BRACKET, NUMBER = re.compile(r"[;{}]"), re.compile(r"[()]"), re.compile(r"(?<![\w\"'])\d\w*")


class _Plain(dict):
    """Each token as it stands in a statement without names; emptied when it holds too many."""

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
        if t[0] == "_" or t[0].isalpha():
            plain = t if t in KEYWORDS else "x"
        elif t[0] in "\"'":
            plain = re.sub(r"[;{}]|\s+", " ", t)
        else:
            plain = "." if t == "->" else t
        self[t] = plain
        return plain


_PLAIN = _Plain()


class Parsed:
    """One code without comments, layout and case: its names, literals, statements and name."""

    def __init__(self, code: str):
        text = COMMENT.sub(" ", code).lower()
        self.tokens = TOKEN.findall(text)
        self.names = {t for t in set(self.tokens) if (t[0] == "_" or t[0].isalpha()) and t not in KEYWORDS}
        self.literals = [t for t in self.tokens if t[0].isdigit() or (t[0] == '"' and len(t) > 2)]
        self.statements = [s for part in STATEMENT_END.split(" ".join(map(_PLAIN.__getitem__, self.tokens))) if (s := part.strip())]
        m = FUNCTION.search(text)
        self.name = m[1] if m else ""

    def forms(self) -> set[str]:
        """Its statements without numbers too, a condition apart from what depends on it."""
        out = set()
        for s in self.statements:
            s = NUMBER.sub("0", s)
            word = s.removeprefix("else ").split(" ", 1)[0]
            if word in CONTROL:
                depth = 0
                for m in BRACKET.finditer(s):
                    depth += 1 if m[0] == "(" else -1
                    if not depth:
                        out.add(s[: m.end()])
                        s = s[m.end() :].strip()
                        break
            if s:
                out.add(s)
        return out

    def keys(self) -> tuple[set[int], set[int], set[int]]:
        """Hashed names, runs of literals (which stay when all names change), runs of statements."""
        return ({_hash("1" + t) for t in self.names}, {_hash("3" + " ".join(self.literals[i : i + LITERALS])) for i in range(len(self.literals) - LITERALS + 1)},
                {_hash("4" + ";".join(self.statements[i : i + STATEMENTS])) for i in range(len(self.statements) - STATEMENTS + 1)})


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    count: Counter = Counter()
    for pdf in batches:
        for code in pdf["code"]:
            for keys in Parsed(code).keys():
                count.update(keys)
        if len(count) > 1_000_000:
            yield from frames({"block": list(count), "uses": list(count.values())})
            count.clear()
    yield from frames({"block": list(count), "uses": list(count.values())})


def blocks_of(p: Parsed, uses: dict[int, int]) -> list[int]:
    """Blocking keys, the rarest first: of the names and of the runs of literals as many as any two codes need that have
    SHARE of the longer one's in common to share two; of the runs of statements two."""
    out: set[int] = set()
    for n, keys in enumerate(p.keys()):
        own = sorted((uses.get(h, 0), h) for h in keys)
        need = STATEMENT_KEYS if n == 2 else len(own) - math.ceil(SHARE * len(own)) + 2
        out.update(h for _, h in own[:need])
    return sorted(out)


def _postings(common):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [Parsed(c) for c in pdf["code"]]
            digests = [hashlib.md5(" ".join(p.tokens).encode("utf-8", "surrogatepass")).digest() for p in got]
            yield from frames({c: list(pdf[c]) for c in ("record", "label", "cwe", "origin")} | {"digest": digests, "name": [_hash(p.name) if p.name else None for p in got],
                              "blocks": [blocks_of(p, common.value) for p in got]}, 2_000)

    return run


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What comparisons need of each candidate, as hashes, so that codes are neither shuffled nor read again for each pair."""
    for pdf in batches:
        got = [Parsed(c) for c in pdf["code"]]
        yield from frames({"record": list(pdf["record"]), "statements": [[_hash(s) for s in p.statements] for p in got], "forms": [[_hash(f) for f in sorted(p.forms())] for p in got],
                           "names": [[_hash(t) for t in sorted(p.names)] for p in got]}, 2_000)


def _level(v: float, steps: tuple[float, ...]) -> int:
    return sum(v >= s for s in steps)


def _share(x: Counter, y: Counter) -> float:
    least = min(x.total(), y.total())
    return sum(min(c, y[k]) for k, c in x.items() if k in y) / least if least else 0.0


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def counted(st) -> tuple[Counter, Counter]:
        st = list(st)
        return Counter(st), Counter(zip(st, st[1:]))

    for pdf in batches:
        rows, kept = [], {}
        for a, b, sa, sb, fa, fb, na, nb in zip(*(pdf[c] for c in ("left_id", "right_id", "st_a", "st_b", "fo_a", "fo_b", "na_a", "na_b"))):
            for key, st in ((("a", a), sa), (("b", b), sb)):
                if key not in kept:
                    kept[key] = counted(st)
            x, y = kept["a", a], kept["b", b]
            same, order = _share(x[0], y[0]), _share(x[1], y[1])
            na, nb = set(na), set(nb)
            ids = len(na & nb) / max(1, min(len(na), len(nb)))
            size = max(1, min(len(sa), len(sb))) / max(1, len(sa), len(sb))
            close = (same + order) / 2
            # Only codes that are alike can be the same function; others need no list of differences.
            rows.append((_level(close, (0.3, 0.5, 0.7, 0.85)), _level(ids, (0.2, 0.4, 0.6, 0.8)), _level(size, (0.4, 0.7)), close * size + ids / 10, sorted(set(fa) ^ set(fb)) if close >= 0.3 else []))
        made = ("c_statements", "c_names", "c_size", "closeness", "different")
        yield from frames({c: list(pdf[c]) for c in ("left_id", "right_id", "origin", "c_label", "c_cwe", "c_function", "twin")} | {c: [r[i] for r in rows] for i, c in enumerate(made)}, 5_000)


def agreement(a: Column, b: Column) -> Column:
    """2 agree, 0 disagree, 1 one is missing."""
    return F.when(a.isNull() | b.isNull(), 1).when(a == b, 2).otherwise(0)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior match probability of each pattern of agreement levels (Fellegi and Sunter's model with EM).

    ``patterns``: one row per distinct vector of levels; ``counts``: candidate pairs with it; ``start``: a first guess
    of each pattern's posterior. Levels count as independent within matches and within non-matches.
    """
    post = start.astype(float)
    if not len(patterns):
        return post
    levels = [np.unique(patterns[:, j], return_inverse=True) for j in range(patterns.shape[1])]
    for _ in range(rounds):
        m, u = counts * post, counts * (1 - post)
        p = (m.sum() + 1) / (counts.sum() + 2)
        lm, lu = np.full(len(post), math.log(p)), np.full(len(post), math.log1p(-p))
        for values, at in levels:
            k = len(values)
            pm = (np.bincount(at, m, k) + 0.5) / (m.sum() + 0.5 * k)
            pu = (np.bincount(at, u, k) + 0.5) / (u.sum() + 0.5 * k)
            lm += np.log(pm)[at]
            lu += np.log(pu)[at]
        new = 1 / (1 + np.exp(np.clip(lu - lm, -700, 700)))
        if np.abs(new - post).max() < 1e-7:
            return new
        post = new
    return post


SAME = ["c_statements", "c_names", "c_function", "c_size"]
STATE = ["c_state", "c_label", "c_cwe"]
#: A form counts as a sign of the state if it is this much more frequent (as a logarithm) among the differences of pairs whose labels differ.
SIGNS = (0.8, 1.8)


def _posteriors(pairs: DataFrame, columns: list[str], start, name: str) -> DataFrame:
    """Patterns with their posterior; there are at most as many as products of levels (here 150), so they may be collected.

    Copies of a left record count once, so that a group of copies does not outweigh all others.
    """
    got = pairs.select("twin", "right_id", *columns).distinct().groupBy(*columns).count().orderBy(*columns).collect()
    x = np.array([[r[c] for c in columns] for r in got], dtype=int).reshape(-1, len(columns))
    post = expectation_maximisation(x, np.array([r["count"] for r in got], dtype=float), np.array([start(dict(zip(columns, r))) for r in x.tolist()]))
    rows = [(*map(int, r), float(p)) for r, p in zip(x.tolist(), post)]
    return pairs.sparkSession.createDataFrame(rows, ", ".join(f"{c} int" for c in columns) + f", {name} double")


def _with_state(pairs: DataFrame) -> DataFrame:
    """Adds ``c_state``: 2 if the statements in which two codes differ say nothing of their state, 1 or 0 if they do.

    What says so is learned from all pairs of the same function: forms of statements that differ more often where the
    labels differ than where they agree. No form is given.
    """
    lone = pairs.where("c_label <> 1").dropDuplicates(["twin", "right_id"])
    apart, agreed = lone.agg(F.coalesce(F.sum((F.col("c_label") == 0).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("c_label") == 2).cast("long")), F.lit(0))).first()
    forms = lone.select("c_label", F.explode("different").alias("form")).groupBy("form").agg(F.sum((F.col("c_label") == 0).cast("long")).alias("n0"), F.sum((F.col("c_label") == 2).cast("long")).alias("n2"))
    sign = F.log((F.col("n0") + 0.5) / (apart + 1.0)) - F.log((F.col("n2") + 0.5) / (agreed + 1.0))
    forms = forms.where("n0 >= 2").select("form", sign.alias("sign"), (F.col("n0") + F.col("n2")).alias("uses")).where(F.col("sign") >= SIGNS[0])
    each = pairs.select("left_id", "right_id", F.explode("different").alias("form"))
    told = lookup_join(each, materialize(forms, "forms"), "form", "inner", F.struct("left_id", "right_id"), "uses").groupBy("left_id", "right_id").agg(F.max("sign").alias("sign"))
    level = F.when(F.col("sign") >= SIGNS[1], 0).when(F.col("sign") >= SIGNS[0], 1).otherwise(2)
    return pairs.drop("different").join(told, ["left_id", "right_id"], "left").withColumn("c_state", level).drop("sign")


def _prepared(df: DataFrame, record: str, code: str, label: str, cwe: str, origin: str | None) -> DataFrame:
    lab = F.expr(f"try_cast(trim(cast(`{label}` as string)) as double)")
    return df.select(F.col(record).cast("long").alias("record"), F.col(code).cast("string").alias("code"), F.when(lab == 1, 1).when(lab == 0, 0).alias("label"),
                     F.nullif(F.regexp_extract(F.col(cwe).cast("string"), r"0*(\d+)", 1), F.lit("")).alias("cwe"),
                     (F.col(origin) if origin else F.lit("")).cast("string").alias("origin")).where("record IS NOT NULL AND code IS NOT NULL")


def _classes(df: DataFrame, common, name: str) -> DataFrame:
    """One row for each group of copies with the same label, CWE and origin: that of the smallest id."""
    got = df.mapInPandas(_postings(common), "record long, label int, cwe string, origin string, digest binary, name long, blocks array<long>")
    return materialize(got.groupBy("origin", "digest", "label", "cwe").agg(F.min("record").alias("record"), F.first("name").alias("name"), F.first("blocks").alias("blocks")), name)


def _profiled(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Profiles of the records ``ids``; the ids are broadcast only while they are few (8 bytes each)."""
    few = fits_broadcast(ids)
    rows = df.select("record", "code").join(F.broadcast(ids) if few else ids, "record", "left_semi").dropDuplicates(["record"])
    return materialize(rows.mapInPandas(_profiles, "record long, statements array<long>, forms array<long>, names array<long>"), name)


def match_functions(left: DataFrame, right: DataFrame, left_cols: tuple[str, str, str, str], right_cols: tuple[str, str, str, str], origin: str, threshold: float = 0.5) -> DataFrame:
    """(left_id, right_id, confidence) of records that are the same function in the same state.

    ``*_cols``: id, code, label and CWE column of each side; ``origin``: the right side's collection. A right record
    gets at most one left record, and a left record at most one right record per origin: the most confident, then the
    closest, then the smallest id. Records without id or code are in no pair; missing labels and CWEs are their own
    level of agreement. Exact copies with the same label and CWE count as one on either side, that of the smallest id;
    repeated rows are such copies. A candidate shares two keys, of which the function's name may be one. Empty tables
    give an empty result. Other columns are ignored. Codes are read whole; no block or number of candidates is capped.
    """
    spark = left.sparkSession
    a, b = _prepared(left, *left_cols, None), _prepared(right, *right_cols, origin)
    # Keys common on the right would make large blocks, so they come last; at most COMMON_KEYS reach the driver.
    counts = b.select("code").mapInPandas(_counts, "block long, uses long").groupBy("block").agg(F.sum("uses").alias("uses"))
    common = spark.sparkContext.broadcast(most_used(counts.where("uses > 1"), "block", "uses", COMMON_KEYS))
    ca, cb = _classes(a, common, "left"), _classes(b, common, "right")
    ka = ca.select(F.col("record").alias("left_id"), F.col("name").alias("name_a"), F.explode("blocks").alias("block"))
    kb = cb.select(F.col("record").alias("right_id"), F.col("name").alias("name_b"), F.explode("blocks").alias("block"))
    named = (F.col("name_a") == F.col("name_b")).cast("int")
    met = skew_join(ka, kb, "block", F.col("left_id"), F.col("right_id")).groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("shared"), F.coalesce(F.max(named), F.lit(0)).alias("c_function"))
    cand = materialize(met.where(F.col("shared") + F.col("c_function") >= 2).select("left_id", "right_id", "c_function"), "candidates")
    pa = _profiled(a, cand.select(F.col("left_id").alias("record")).distinct(), "left-profiles")
    pb = _profiled(b, cand.select(F.col("right_id").alias("record")).distinct(), "right-profiles")
    la = pa.join(ca.select("record", "label", "cwe", F.xxhash64("digest").alias("twin")), "record").select(F.col("record").alias("left_id"), F.col("label").alias("label_a"), F.col("cwe").alias("cwe_a"), "twin",
                 F.col("statements").alias("st_a"), F.col("forms").alias("fo_a"), F.col("names").alias("na_a"))
    lb = pb.join(cb.select("record", "label", "cwe", "origin"), "record").select(F.col("record").alias("right_id"), "origin", F.col("label").alias("label_b"), F.col("cwe").alias("cwe_b"),
                 F.col("statements").alias("st_b"), F.col("forms").alias("fo_b"), F.col("names").alias("na_b"))
    pairs = cand.join(lb, "right_id").join(la, "left_id")
    pairs = pairs.withColumn("c_label", agreement(F.col("label_a"), F.col("label_b"))).withColumn("c_cwe", agreement(F.col("cwe_a"), F.col("cwe_b"))).drop("label_a", "label_b", "cwe_a", "cwe_b")
    compared = materialize(pairs.mapInPandas(_compare, "left_id long, right_id long, origin string, c_label int, c_cwe int, c_function int, twin long, c_statements int, c_names int, c_size int, closeness double, different array<long>"), "compared")
    release(cand, pa, pb, ca, cb)
    same = _posteriors(compared, SAME, lambda r: 0.9 if r["c_statements"] >= 2 and r["c_names"] >= 2 else 0.1, "p_same")
    # Both tables of posteriors have at most 150 rows.
    known = materialize(_with_state(materialize(compared.join(F.broadcast(same), SAME).where("p_same >= 0.5"), "same")), "known")
    release(compared)
    state = _posteriors(known, STATE, lambda r: {0: 0.1, 1: 0.4, 2: 0.9}[r["c_state"]] * {0: 0.5, 1: 0.9, 2: 1.0}[r["c_label"]], "p_state")
    scored = known.join(F.broadcast(state), STATE).withColumn("confidence", F.col("p_same") * F.col("p_state")).where(F.col("confidence") >= threshold)
    rank = F.struct("confidence", "closeness", -F.col("left_id"), -F.col("right_id"))
    scored = scored.withColumn("rank", rank).groupBy("right_id").agg(*[F.max_by(c, "rank").alias(c) for c in ("left_id", "origin", "confidence", "rank")])
    scored = scored.groupBy("left_id", "origin").agg(F.max_by("right_id", "rank").alias("right_id"), F.max_by("confidence", "rank").alias("confidence"))
    return scored.select("left_id", "right_id", "confidence")
