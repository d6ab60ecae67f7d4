"""Staged pipelines and model providers.

A pipeline is a composition of functions from DataFrame to DataFrame; a missing stage passes its input on. Model calls go
through a provider; answers are kept in a table by the hash of their request, and only unknown requests are sent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import materialize

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """load -> prefilter -> route -> decide -> validate -> calibrate."""

    load: Callable[[], DataFrame]
    prefilter: Stage | None = None
    route: Callable[[DataFrame], tuple[DataFrame | None, DataFrame]] | None = None
    decide: Stage | None = None
    validate: Stage | None = None
    calibrate: Stage | None = None

    def run(self) -> DataFrame:
        rows = self.load()
        if self.prefilter:
            rows = rows.transform(self.prefilter)
        done = None
        if self.route:
            done, rows = self.route(rows)
        if self.decide:
            rows = rows.transform(self.decide)
        out = rows if done is None else done.unionByName(rows, allowMissingColumns=True)
        for stage in (self.validate, self.calibrate):
            out = out.transform(stage) if stage else out
        return out


def routed(df: DataFrame, confidence: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows at or above the threshold, all others, nulls included); write the scored table before, as both parts read it."""
    sure = F.coalesce(F.col(confidence) >= threshold, F.lit(False))
    return df.where(sure), df.where(~sure)


class Stub:
    """A provider without a network: answers that follow from the request alone, shaped like the schema's example."""

    def complete(self, prompt: str, example: dict | None = None) -> str:
        seed = int(hashlib.sha256(prompt.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
        return json.dumps(self._fill(example, seed), ensure_ascii=False) if example is not None else f"[stub {seed:08x}]"

    def _fill(self, x, seed: int):
        if isinstance(x, dict):
            return {k: self._fill(v, seed + i + 1) for i, (k, v) in enumerate(x.items())}
        if isinstance(x, list):
            return [self._fill(v, seed + i + 1) for i, v in enumerate(x[:1])]
        if isinstance(x, bool):
            return bool(seed % 2)
        if isinstance(x, int):
            return seed % 10
        if isinstance(x, float):
            return (seed % 100) / 100
        if isinstance(x, str) and "|" in x:
            return x.split("|")[seed % len(x.split("|"))]
        return f"stub-{seed % 1000}"


def parse_object(answer: str) -> dict | None:
    """The JSON object in an answer, fences and prose around it allowed; None if there is none."""
    m = re.search(r"\{.*\}", answer, re.S)
    try:
        out = json.loads(m[0]) if m else None
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def request_key(prompt: F.Column, config: str) -> F.Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(config), prompt), 256)


def answered(df: DataFrame, key: str, prompt: str, provider, memo: DataFrame | None = None, config: str = "stub", example: dict | None = None, attempts: int = 3, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``answer``, memo with the new answers). Equal requests are sent once; known ones not at all. The new
    answers are written before they are used, so that a lost executor sends nothing twice. ``tasks`` bounds the number
    of senders at a time."""
    rows = df.withColumn("_key", request_key(F.col(prompt), config))
    asked = rows.groupBy("_key").agg(F.min(prompt).alias("prompt"))
    if memo is not None:
        asked = asked.join(memo.select("_key"), "_key", "left_anti")
    if tasks:
        asked = asked.repartition(tasks, "_key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                answer = ""
                for i in range(attempts):
                    answer = provider.complete(p if not i else f"{p}\n(attempt {i + 1}: answer with JSON only)", example)
                    if example is None or parse_object(answer) is not None:
                        break
                out.append(answer)
            yield pd.DataFrame({"_key": pdf["_key"].astype(object), "answer": pd.Series(out, dtype="object")})

    new = materialize(asked.mapInPandas(run, "_key string, answer string"), "answers")
    known = new if memo is None else memo.unionByName(new)
    return rows.join(known, "_key", "left").drop("_key"), known
