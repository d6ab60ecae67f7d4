"""Duplicates hidden by formatting differences.

Dictionary encoding: a record is taken apart into field values; each distinct raw value of the whole table is brought
together in one task and canonicalised there, once; its canonical form gets an integer; records become sorted tuples of
integers, and equal tuples are one group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import frames, lookup_join, materialize, prefix_sums, release

RUN = re.compile(r"\w+")
HEADER = re.compile(r"\W*?/\*(.*?)\*/", re.S)
ENTRY = re.compile(r"[\r\n\v\f\x85  ]+|(?:^|(?<=\s))\*+(?=\s|$)|\b(?=\w+\s*:(?!:))")
FIELD_LIST = re.compile(r"\{(\s*\.\s*\w+\s*=[^{}]*)\}")
FIELD = re.compile(r"(?<![\w)\]])(?=\.\s*\w+\s*=(?!=))")
HEAD, BODY = 1, 2


def _sorted_fields(m: re.Match) -> str:
    return " \x01 " + " ".join(sorted(" ".join(RUN.findall(e)) for e in FIELD.split(m.group(1)))) + " \x02 "


def code_fields(code: str) -> list[tuple[int, str]]:
    """A text's raw field values: the entries of its leading header comment, and the rest."""
    m = HEADER.match(code)
    if not m:
        return [(BODY, code)]
    return [(HEAD, e) for e in ENTRY.split(m.group(1)) if e] + [(BODY, code[m.end() :])]


def canonical(field: int, value: str) -> str:
    """Runs of letters, digits and underscores in lower case; the entries of ``{ .field = value }`` lists in sorted order."""
    value = value.lower()
    if field == BODY and "{" in value:
        while True:  # from the innermost list outwards
            new = FIELD_LIST.sub(_sorted_fields, value)
            if new == value:
                break
            value = new
    return " ".join(RUN.findall(value))


def _digest(field: int, value: str) -> bytes:
    return hashlib.md5(f"{field} {value}".encode("utf-8", "surrogatepass")).digest()


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(record, row, slot, raw) of all field values; ``row`` tells the texts of one id apart."""
    for pdf in batches:
        records, rows, slots, raws = [], [], [], []
        for record, code in zip(pdf["record"], pdf["code"]):
            got = [_digest(field, raw) for field, raw in code_fields(code)]
            row = hashlib.md5(b"".join(got)).digest()[:8]
            records += [record] * len(got)
            rows += [row] * len(got)
            slots += range(len(got))
            raws += got
        yield from frames({"record": records, "row": rows, "slot": slots, "raw": raws})


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(raw, field, value): raw field values, each sent once by a task while it remembers having sent it."""
    sent: set[bytes] = set()
    for pdf in batches:
        out: list[tuple[bytes, int, str]] = []
        for code in pdf["code"]:
            for field, value in code_fields(code):
                d = _digest(field, value)
                if d not in sent:
                    if len(sent) > 1_000_000:
                        sent.clear()
                    sent.add(d)
                    out.append((d, field, value))
        if out:
            yield from frames(dict(zip(("raw", "field", "value"), map(list, zip(*out)))), 2_000)


def _canonicalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(raw, digest): the canonical form's digest, null for a header entry without any word. All copies of a value are in
    one partition, so each is canonicalised once."""
    done: set[bytes] = set()
    for pdf in batches:
        raws, digests = [], []
        for raw, field, value in zip(pdf["raw"], pdf["field"], pdf["value"]):
            if raw not in done:
                done.add(raw)
                text = canonical(field, value)
                raws.append(raw)
                digests.append(_digest(field, text) if text or field == BODY else None)
        yield from frames({"raw": raws, "digest": digests})


def format_groups(df: DataFrame, record: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, groups): members (record, tuple) and groups (tuple, keep, copies), by canonical content of ``text``.

    Null texts are left out: they are no content. Empty texts, and texts without any run, are copies of one another.
    The kept record is the smallest id of the group. Identical rows that repeat an id count once; one id with several
    texts counts once for each. An empty table gives empty results. Other columns are ignored. Texts are read whole.
    """
    kind = dict(df.dtypes)[record]
    rows = df.select(F.col(record).alias("record"), F.col(text).cast("string").alias("code")).where("code IS NOT NULL AND record IS NOT NULL")
    raw = materialize(rows.mapInPandas(_split, f"record {kind}, row binary, slot int, raw binary"), "raw")
    # Only this shuffles texts, and each distinct value about once.
    forms = materialize(rows.select("code").mapInPandas(_values, "raw binary, field int, value string").repartition("raw").mapInPandas(_canonicalise, "raw binary, digest binary").where("digest IS NOT NULL"), "forms")
    uses = raw.groupBy("raw").agg(F.count(F.lit(1)).alias("uses"))
    values = materialize(lookup_join(raw, materialize(forms.join(uses, "raw"), "weights"), "raw", "inner", F.col("record"), "uses").select("record", "row", "slot", "digest"), "values")
    release(raw, forms)
    words = values.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")).withColumn("one", F.lit(1)).withColumn("g", F.lit(0))
    coded = prefix_sums(words, ["g"], ["digest"], "one", "number").select("digest", "number", "uses")
    numbers = lookup_join(values, coded, "digest", "inner", F.col("record"), "uses")
    tuples = materialize(numbers.groupBy("record", "row").agg(F.transform(F.array_sort(F.collect_set(F.struct("number", "slot"))), lambda x: x["number"]).alias("tuple")).select("record", "tuple"), "tuples")
    release(values)
    groups = tuples.groupBy("tuple").agg(F.min("record").alias("keep"), F.count(F.lit(1)).alias("copies"))
    return tuples, groups


def collapse(df: DataFrame, record: str, text: str) -> DataFrame:
    """(keep_id, copies): one row per distinct content with the number of records it stands for."""
    return format_groups(df, record, text)[1].select(F.col("keep").alias("keep_id"), "copies")


def superfluous(df: DataFrame, record: str, text: str) -> DataFrame:
    """(keep_id, copy_id): one row per record that is a copy of the kept one."""
    tuples, groups = format_groups(df, record, text)
    found = lookup_join(tuples, groups.where("copies > 1"), "tuple", "inner", F.col("record"), "copies")
    return found.where("record <> keep").select(F.col("keep").alias("keep_id"), F.col("record").alias("copy_id"))
