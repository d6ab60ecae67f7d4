"""Exports: flat cells, projections of verdicts, JSON and CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cell, clip

CELL_LIMIT = 32_000
NOTICE = " [cut]"


def flat(df: DataFrame, limit: int = CELL_LIMIT) -> DataFrame:
    """All columns as text cells of bounded length: lists joined, structs and maps as JSON."""
    return df.select(*[clip(cell(F.col(c), kind), limit, NOTICE).alias(c) for c, kind in df.dtypes])


def stacked(*tables: DataFrame) -> DataFrame:
    """Rows of tables with different columns; missing cells are NULL, columns in first-seen order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
