"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICT = "doc_id string, verdict string, confidence double, action string, evidence array<string>, rationale string"
SPANS = "doc_id string, n int, span_start int, span_end int, label string"


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A table, or a glob of shards, with only the named columns read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def code_csv(spark: SparkSession, path: str) -> DataFrame:
    """(unique_id, code) of a CSV corpus with line breaks in quoted cells."""
    return spark.read.schema("unique_id long, code string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows with the label as text and as a number: NULL for conflict and unknown labels."""
    df = spark.read.schema("unique_id long, recovered_label string, match_source string, cwe_id string, source_project string").option("header", True).csv(path)
    return df.withColumn("y", label_number(F.col("recovered_label")))


def label_number(c):
    """0 or 1 from '0', '0.0', '1', '1.0', else NULL."""
    v = c.cast("string").try_cast("double")
    return F.when(v == 1, 1).when(v == 0, 0)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, position) of the ids in a text file, parted by white space, each once, in their first order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("position", "id"))
    return lines.groupBy("id").agg(F.min("position").alias("position"))


def verdicts_json(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts of a JSON array; rows that don't parse, or have no id or verdict, are kept with ``reason``."""
    df = spark.read.schema(VERDICT + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    reason = F.when(F.col("_bad").isNotNull(), "not JSON").when(F.col("doc_id").isNull() | F.col("verdict").isNull(), "not a verdict")
    return df.withColumn("reason", reason).drop("_bad")


def weaknesses_xml(spark: SparkSession, path: str, ids: list[str] | None = None, limit: int = 400) -> DataFrame:
    """(cwe_id, name, description) of a weakness catalogue, descriptions cut at a blank."""
    from ..functions.text import trim_words

    df = spark.read.format("xml").option("rowTag", "Weakness").schema("_ID string, _Name string, Description string").load(path)
    df = df.select(F.col("_ID").alias("cwe_id"), F.col("_Name").alias("name"), trim_words(F.trim(F.regexp_replace("Description", r"\s+", " ")), limit).alias("description"))
    return df.where(F.col("cwe_id").isin(ids)) if ids else df


SARIF = "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,relationships:array<struct<target:struct<id:string>>>>>>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<region:struct<startLine:int>>>>>>>>"


def sarif_hits(df: DataFrame, key: str, sarif: str) -> DataFrame:
    """(key, line, level, rule, cwe_ids, message) of a scanner's reports held as text."""
    run = df.select(key, F.explode(F.from_json(sarif, SARIF)["runs"]).alias("run"))
    rules = F.coalesce(F.col("run.tool.driver.rules"), F.array().cast("array<struct<id:string,relationships:array<struct<target:struct<id:string>>>>>"))
    hit = run.select(key, rules.alias("rules"), F.explode("run.results").alias("r"))
    own = F.flatten(F.transform(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), lambda x: F.transform(F.coalesce(x["relationships"], F.array().cast("array<struct<target:struct<id:string>>>")), lambda y: y["target"]["id"])))
    return hit.select(key, F.col("r.locations")[0]["physicalLocation"]["region"]["startLine"].alias("line"), F.col("r.level").alias("level"), F.col("r.ruleId").alias("rule"), own.alias("cwe_ids"), F.col("r.message.text").alias("message"))


def gold_spans(df: DataFrame, key: str, spans: str) -> DataFrame:
    """(key, n, span_start, span_end, label) of spans kept as the text of a list of dictionaries, without leaving the JVM."""
    # One match holds a whole span, so a text that looks like a span cannot shift the values of others.
    whole = F.regexp_extract_all(spans, F.lit(r"(?s)\{'start': \d+, 'end': \d+, 'text': .*?, 'label': '\w+'\}"), F.lit(0))
    part = lambda p, g=1: F.regexp_extract("x", p, g)
    out = df.where(F.col(spans).isNotNull()).select(key, F.posexplode(whole).alias("n", "x"))
    head = r"^\{'start': (\d+), 'end': (\d+)"
    return out.select(key, "n", part(head, 1).cast("int").alias("span_start"), part(head, 2).cast("int").alias("span_end"), part(r"'label': '(\w+)'\}$").alias("label"))
