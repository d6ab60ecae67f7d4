"""Queries of the training-data problems, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scale import materialize
from . import abuse, formatting, linkage, mixing, overlap, packing, pii, splits

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _table(spark: SparkSession, d: str, name: str, *columns: str | Column) -> DataFrame:
    t = spark.read.parquet(f"{d}/{name}.parquet")
    return t.select(*columns) if columns else t


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_leaks(_table(spark, d, "codereview", "unique_id", "gold_source_project", "split"), "unique_id", "gold_source_project", "split", _table(spark, d, "project_aliases", "alias", "project"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_splits(_table(spark, d, "codereview", "unique_id", "gold_source_project"), "unique_id", "gold_source_project", _table(spark, d, "project_aliases", "alias", "project"), SPLITS)


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return overlap.cross_split_classes(_table(spark, d, "codereview", "unique_id", "code", "split"), "unique_id", "code", "split", overlap.code_runs, 1, 0.85)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(*_classes(spark, d)).select(F.least("held_id", "train_id").alias("id_a"), F.greatest("held_id", "train_id").alias("id_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per held-out fragment that is alike to training fragments: its class of copies and the number of them."""
    return overlap.overlap_counts(*_classes(spark, d)).withColumnRenamed("record", "unique_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "codereview", "unique_id", "split", "gold_source_project")
    return overlap.overlap_report(rows, "unique_id", "split", "gold_source_project", overlap.overlap_counts(*_classes(spark, d))).withColumnRenamed("source", "gold_source_project")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    links = linkage.match_functions(_table(spark, d, "codereview", "unique_id", "code", "gold_label", "gold_cwe_id"), _table(spark, d, "upstream_funcs"),
                                    ("unique_id", "code", "gold_label", "gold_cwe_id"), ("func_id", "func", "target", "cwe"), "origin")
    return links.select(F.col("left_id").alias("unique_id"), F.col("right_id").alias("func_id"), "confidence")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_links(spark, d).select("unique_id", "func_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.superfluous(_table(spark, d, "codereview", "unique_id", "code"), "unique_id", "code")


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return formatting.collapse(_table(spark, d, "codereview", "unique_id", "code"), "unique_id", "code")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, "pii", "doc_id", "locale", "text", "gold_spans")
    return pii.find_spans(table, "doc_id", "text", "locale", pii.trained(table, "doc_id", "text", "gold_spans", "locale"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    table = _table(spark, d, "pii", "doc_id", "locale", "text", "gold_spans")
    return pii.redact(table, "doc_id", "text", "locale", pii.trained(table, "doc_id", "text", "gold_spans", "locale"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), _table(spark, d, "pack_capacities"))


def _mix(spark: SparkSession, d: str, fill: float) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(_table(spark, d, "documents", "doc_id", "source", "text"), "doc_id", "source", "text", _table(spark, d, "mix_targets"), fill=fill)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """As many tokens as the target sources have; small sources repeat as often as they may."""
    return _mix(spark, d, 1.0)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, 1.0)[1]


def p7_shares_capped(spark: SparkSession, d: str) -> DataFrame:
    """Three times the tokens there are, which most sources cannot serve: they stop at their repeats."""
    return _mix(spark, d, 3.0)[1]


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents", "doc_id", "text", "source")
    return abuse.score_documents(docs, "doc_id", "text", "source", abuse.trained(docs, "doc_id", "text", _table(spark, d, "abuse_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.found(_scored(spark, d), "doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


def _bad(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """Of the new splits: records, entities torn between splits, splits more than 2 % of all records off their target."""
    got = materialize(p1_splits(spark, d), "splits")
    torn = got.where("group_key IS NOT NULL").groupBy("group_key").agg(F.count_distinct("new_split").alias("n")).agg(_bad(F.col("n") > 1).alias("torn_entities"))
    sizes = got.groupBy("new_split").agg(F.count(F.lit(1)).alias("n"))
    off = sizes.join(F.broadcast(sizes.agg(F.sum("n").alias("records"))), F.lit(True))
    target = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])
    off = off.groupBy("records").agg(_bad(F.abs(F.col("n") / F.col("records") - F.try_element_at(target, F.col("new_split"))) > 0.02).alias("splits_off_target"))
    return off.join(F.broadcast(torn), F.lit(True)).select("records", "torn_entities", "splits_off_target")


def p2_check(spark: SparkSession, d: str) -> DataFrame:
    """Of the redaction: documents, spans outside their text, spans that overlap, texts changed outside their spans."""
    table = _table(spark, d, "pii", "doc_id", "locale", "text", "gold_spans")
    model = pii.trained(table, "doc_id", "text", "gold_spans", "locale")
    span = F.struct("span_start", "span_end", "kind")
    spans = pii.find_spans(table, "doc_id", "text", "locale", model).groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = table.select("doc_id", "text").join(spans, "doc_id", "left").join(pii.redact(table, "doc_id", "text", "locale", model), "doc_id")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<span_start:int,span_end:int,kind:string>>")))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    made = F.aggregate("spans", state, lambda a, x: F.struct(x["span_end"].alias("at"), F.concat(a["out"], F.substr("text", a["at"] + 1, x["span_start"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")))
    want = F.concat(made["out"], F.substr("text", made["at"] + 1, F.length("text")))
    outside = F.exists("spans", lambda x: (x["span_start"] < 0) | (x["span_end"] > F.length("text")) | (x["span_start"] >= x["span_end"]))
    follows = lambda i: F.coalesce(F.try_element_at("spans", i)["span_end"] > F.try_element_at("spans", i + 1)["span_start"], F.lit(False))
    overlap = F.exists(F.sequence(F.lit(1), F.greatest(F.size("spans"), F.lit(1))), follows)
    return rows.agg(F.count(F.lit(1)).alias("documents"), _bad(outside).alias("outside"), _bad(overlap).alias("overlapping"), _bad(~want.eqNullSafe(F.col("redacted"))).alias("changed_elsewhere"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """By kind of container: documents packed, containers over their capacity, texts cut that would fit, pieces not in a row."""
    caps = _table(spark, d, "pack_capacities").select("container_kind", F.col("capacity_tokens").cast("long").alias("room"))
    packed = materialize(p6_containers(spark, d), "packed")
    full = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(caps), "container_kind").groupBy("container_kind").agg(_bad(F.col("used") > F.col("room")).alias("overfull"))
    texts = packed.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end")).join(F.broadcast(caps), "container_kind")
    texts = texts.groupBy("container_kind").agg(F.count(F.lit(1)).alias("documents"), _bad((F.col("pieces") > 1) & (F.col("tokens") <= F.col("room"))).alias("cut_needlessly"), _bad(F.col("tokens") != F.col("end")).alias("broken"))
    return texts.join(full, "container_kind").select("container_kind", "documents", "overfull", "cut_needlessly", "broken")


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """By target source: records used more often than they may, records of other sources, tokens beyond the budget."""
    chosen, shares = _mix(spark, d, 1.0)
    docs = _table(spark, d, "documents", "doc_id", F.col("source").alias("recorded"))
    used = chosen.join(docs, "doc_id").join(F.broadcast(_table(spark, d, "mix_targets", "source", "max_repeats")), "source", "left")
    used = used.groupBy("source").agg(_bad(F.col("repeats") > F.col("max_repeats")).alias("repeated_too_often"), _bad(F.lower(F.trim("recorded")) != F.lower(F.trim("source"))).alias("of_other_sources"))
    out = shares.select("source", (F.col("tokens") > F.col("budget_tokens")).cast("long").alias("over_budget")).join(F.broadcast(used), "source", "left")
    return out.select("source", F.coalesce("repeated_too_often", F.lit(0)).alias("repeated_too_often"), F.coalesce("of_other_sources", F.lit(0)).alias("of_other_sources"), "over_budget")


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """By source as recorded: documents, and rates that are none."""
    return p8_rates(spark, d).select("source", "documents", sum((F.when(F.col(f"{k}_rate").between(0, 1) & F.col(f"{k}_mean").between(0, 1), 0).otherwise(1) for k in abuse.KINDS), F.lit(0)).cast("long").alias("no_rates"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_splits, p2_found, p2_redacted, p3_found, p3_classes, p3_report, p4_found, p4_links, p5_found, p5_collapsed, p6_containers, p6_fill, p7_mix, p7_shares, p7_shares_capped, p8_found, p8_scores, p8_rates, p1_check, p2_check, p6_check, p7_check, p8_check)
}

_KEY = r"""
regexp_replace(regexp_extract(regexp_replace(regexp_replace(lower(regexp_replace({0}, '[\s  　]+', '', 'g')), '[/\\]+$', ''), '\.git$', ''), '([^/\\:]*)$', 1), '[-_.,;''"()\[\]]+', '', 'g')"""
_BLANK = "lower(regexp_replace({0}, '\\s+', '', 'g')) IN (" + ", ".join(f"'{p}'" for p in splits.PLACEHOLDERS) + ")"

# Every pair of held-out and training fragments that shares a run at all is counted out.
_PAIRS = r"""
WITH runs AS (SELECT unique_id, split, unnest(regexp_extract_all(regexp_replace(lower(code), '(?s:/\*.*?(?:\*/|\z))|//[^\n]*', ' ', 'g'), '\w+')) AS w FROM codereview),
uses AS (SELECT unique_id, split, w, count(*) AS n FROM runs GROUP BY ALL), sizes AS (SELECT unique_id, sum(n) AS size FROM uses GROUP BY 1),
shared AS (SELECT e.unique_id AS held_id, t.unique_id AS train_id, sum(least(e.n, t.n)) AS common FROM uses e JOIN uses t USING (w) WHERE e.split IN ('validation', 'test') AND t.split = 'train' GROUP BY ALL),
pairs AS (SELECT held_id, train_id FROM shared JOIN sizes a ON a.unique_id = held_id JOIN sizes b ON b.unique_id = train_id WHERE common >= 0.85 * greatest(a.size, b.size) - 1e-9)"""
_RUNS = r"array_to_string(regexp_extract_all({0}, '\w+'), ' ')"
_LIST = r"\{[^{}\w]*\.\W*\w+\W*=[^{}]*\}"
_COPIES = rf"""
WITH parts AS (SELECT unique_id, lower(code) AS code, regexp_extract(lower(code), '^\W*?/\*(?s:.*?)\*/') AS head FROM codereview),
cut AS (SELECT unique_id, head, regexp_split_to_array(substr(code, length(head) + 1), '{_LIST}') AS rest, regexp_extract_all(substr(code, length(head) + 1), '{_LIST}') AS lists FROM parts),
keyed AS (SELECT unique_id, md5(array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(head, '[\r\n*]+'), lambda x: {_RUNS.format('x')}), lambda x: x <> '')), '|') || '#'
|| trim(regexp_replace(array_to_string(list_transform(range(1, len(rest) + 1), lambda i: {_RUNS.format('rest[i]')} || ' ' || coalesce(array_to_string(list_sort(list_transform(string_split(lists[i], ','), lambda x: {_RUNS.format('x')})), ' '), '')), ' '), ' +', ' ', 'g'))) AS k FROM cut),
kept AS (SELECT k, min(unique_id) AS keep_id, count(*) AS copies FROM keyed GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
WITH RECURSIVE links AS (SELECT {_KEY.format('alias')} AS a, {_KEY.format('project')} AS b FROM project_aliases),
undirected AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM undirected UNION SELECT r.a, e.b FROM reach r JOIN undirected e ON r.b = e.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
rows AS (SELECT unique_id, split, {_KEY.format('gold_source_project')} AS k FROM codereview WHERE NOT ({_BLANK.format('gold_source_project')})),
named AS (SELECT unique_id, split, coalesce(c, k) AS c FROM rows LEFT JOIN comp ON k = a WHERE k <> '')
SELECT unique_id FROM named WHERE split IN ('validation', 'test') AND c IN (SELECT c FROM named WHERE split = 'train')""",
    "p3_found": f"{_PAIRS} SELECT least(held_id, train_id) AS id_a, greatest(held_id, train_id) AS id_b FROM pairs",
    "p3_classes": rf"""{_PAIRS}, bags AS (SELECT unique_id, split, md5(coalesce(string_agg(w || ' ' || n::VARCHAR, ',' ORDER BY w), '')) AS k FROM uses WHERE split IN ('train', 'validation', 'test') GROUP BY 1, 2),
classes AS (SELECT k, min(unique_id) AS class_id FROM bags GROUP BY 1)
SELECT p.held_id AS unique_id, c.class_id, count(*) AS links FROM pairs p JOIN bags b ON b.unique_id = p.held_id JOIN classes c USING (k) GROUP BY ALL""",
    "p3_report": f"""{_PAIRS}, hit AS (SELECT held_id, count(*) AS n FROM pairs GROUP BY 1)
SELECT split, gold_source_project, count(*) AS held_records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs FROM codereview LEFT JOIN hit ON held_id = unique_id WHERE split IN ('validation', 'test') GROUP BY ALL""",
    "p5_found": f"{_COPIES} SELECT keep_id, unique_id AS copy_id FROM keyed JOIN kept USING (k) WHERE unique_id <> keep_id",
    "p5_collapsed": f"{_COPIES} SELECT keep_id, copies FROM kept",
    # What holds of any right result, whatever models were fitted and however ties fell.
    "p1_check": "SELECT count(*) AS records, 0::BIGINT AS torn_entities, 0::BIGINT AS splits_off_target FROM codereview",
    "p2_check": "SELECT count(*) AS documents, 0::BIGINT AS outside, 0::BIGINT AS overlapping, 0::BIGINT AS changed_elsewhere FROM pii",
    "p6_check": "SELECT container_kind, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS cut_needlessly, 0::BIGINT AS broken FROM pack_capacities",
    "p7_check": "SELECT source, 0::BIGINT AS repeated_too_often, 0::BIGINT AS of_other_sources, 0::BIGINT AS over_budget FROM mix_targets",
    "p8_check": "SELECT source, count(*) AS documents, 0::BIGINT AS no_rates FROM documents GROUP BY 1",
}
