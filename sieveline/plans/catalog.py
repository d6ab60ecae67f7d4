"""Named queries over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.code import line_decile_overlap, signature_of, text_similarity
from ..operators import curves, detectors, joins, metrics, models, pseudonyms, spans, tags, triage, vectors
from ..sources import readers, writers
from .pipeline import Stub, answered, routed
from .scale import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
BUDGETS = [0.10, 0.151, 0.205, 0.30]
SLA_BUDGETS = [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8, 1.0]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return readers.parquet(spark, f"{d}/{name}.parquet", *columns)


# ---- views shared by many queries, and the same in SQL


def gold(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "codereview", "unique_id", "gold_label", *more).withColumn("y", readers.label_number(F.col("gold_label")))


def latest(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each verdict."""
    v = table(spark, d, "verdicts")
    cols = [c for c in v.columns if c not in ("doc_id", "run")]
    return v.groupBy("doc_id", "run").agg(F.max_by(F.struct(*cols), F.struct("received_ts", F.col("decided_ts"))).alias("x")).select("doc_id", "run", *[F.col(f"x.{c}").alias(c) for c in cols])


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(run, unique_id, verdict, confidence, p, y) of verdicts with a known label."""
    v = latest(spark, d).select("run", F.col("doc_id").cast("long").alias("unique_id"), "verdict", "confidence", "action", (F.col("verdict") == "vulnerable").cast("int").alias("p"))
    return v.join(gold(spark, d).where("y IS NOT NULL").select("unique_id", "y"), "unique_id")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, run, verdict, confidence): for each document with a verdict, that of the model, the scanner and the triage."""
    v = latest(spark, d).groupBy("doc_id").agg(F.min_by(F.struct("verdict", "confidence"), "run").alias("x")).select("doc_id", F.lit("model").alias("run"), "x.*")
    bad = lambda c: F.when(c.isNull(), "uncertain").when(c > 0, "vulnerable").otherwise("secure")
    s = v.select("doc_id").join(scanner(spark, d).select(F.col("unique_id").cast("string").alias("doc_id"), "n_hits", "any_hit"), "doc_id", "left")
    s = s.select("doc_id", F.lit("scanner").alias("run"), bad(F.col("any_hit")).alias("verdict"), F.least(F.lit(1.0), 0.5 + 0.1 * F.coalesce("n_hits", F.lit(0))).alias("confidence"))
    t = v.select("doc_id").join(table(spark, d, "codereview", "unique_id", "code").select(F.col("unique_id").cast("string").alias("doc_id"), T.count_matches(F.col("code"), triage.UNSAFE_CALL).alias("n")), "doc_id", "left")
    return v.unionByName(s).unionByName(t.select("doc_id", F.lit("triage").alias("run"), bad(F.col("n")).alias("verdict"), F.lit(0.5).alias("confidence")))


def pair(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, x, cx, z, cz, y): the model's and the scanner's verdict of a document with a known label."""
    s = samples(spark, d)
    a = s.where("run = 'model'").select("doc_id", F.col("verdict").alias("x"), F.coalesce("confidence", F.lit(0.0)).alias("cx"))
    b = s.where("run = 'scanner'").select("doc_id", F.col("verdict").alias("z"), F.coalesce("confidence", F.lit(0.0)).alias("cz"))
    return a.join(b, "doc_id").join(gold(spark, d).where("y IS NOT NULL").select(F.col("unique_id").cast("string").alias("doc_id"), "y"), "doc_id")


def scanner(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scanner_hits").groupBy("unique_id").agg(F.max("n_hits").alias("n_hits"), F.max(F.col("any_hit").cast("int")).alias("any_hit"), F.max(F.col("has_error_level").cast("int")).alias("err"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """(unique_id, y, len, llm, stat, tri): one flag per layer."""
    g = gold(spark, d, "code").where("y IS NOT NULL").select("unique_id", "y", F.length("code").alias("len"), (T.count_matches(F.col("code"), triage.UNSAFE_CALL) > 0).cast("int").alias("tri"))
    v = latest(spark, d).where("run = 'cascade'").select(F.col("doc_id").cast("long").alias("unique_id"), (F.col("verdict") == "vulnerable").cast("int").alias("llm"), "confidence")
    s = scanner(spark, d).select("unique_id", F.col("any_hit").alias("stat"))
    return g.join(v, "unique_id", "left").join(s, "unique_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("llm", "stat")})


G = "g AS (SELECT *, CASE try_cast(gold_label AS DOUBLE) WHEN 1 THEN 1 WHEN 0 THEN 0 END AS y FROM codereview)"
V = "v AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY received_ts DESC, decided_ts DESC) AS rn FROM verdicts) WHERE rn = 1)"
J = f"{G}, {V}, j AS (SELECT run, unique_id, verdict, confidence, action, (verdict = 'vulnerable')::INT AS p, y FROM v JOIN g ON unique_id = doc_id::BIGINT WHERE y IS NOT NULL)"
H = "h AS (SELECT unique_id, max(n_hits) AS n_hits, max(any_hit::INT) AS any_hit, max(has_error_level::INT) AS err FROM scanner_hits GROUP BY 1)"
UNSAFE = triage.UNSAFE_CALL
S = f"""{G}, {V}, {H}, m AS (SELECT doc_id, verdict, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS o FROM v) WHERE o = 1), s AS (SELECT doc_id, 'model' AS run, verdict, confidence FROM m
UNION ALL SELECT doc_id, 'scanner', CASE WHEN any_hit IS NULL THEN 'uncertain' WHEN any_hit > 0 THEN 'vulnerable' ELSE 'secure' END, least(1.0, 0.5 + 0.1 * coalesce(n_hits, 0))::DOUBLE FROM m LEFT JOIN h ON unique_id = doc_id::BIGINT
UNION ALL SELECT doc_id, 'triage', CASE WHEN code IS NULL THEN 'uncertain' WHEN len(regexp_extract_all(code, '{UNSAFE}')) > 0 THEN 'vulnerable' ELSE 'secure' END, 0.5::DOUBLE FROM m LEFT JOIN codereview c ON c.unique_id = doc_id::BIGINT)"""
P = f"{S}, q AS (SELECT a.doc_id, a.verdict AS x, coalesce(a.confidence, 0) AS cx, b.verdict AS z, coalesce(b.confidence, 0) AS cz, y FROM s a JOIN s b USING (doc_id) JOIN g ON g.unique_id = a.doc_id::BIGINT WHERE a.run = 'model' AND b.run = 'scanner' AND y IS NOT NULL)"
FLAG = f"""{G}, {V}, {H}, f AS (SELECT g.unique_id, y, length(code) AS len, (len(regexp_extract_all(code, '{UNSAFE}')) > 0)::INT AS tri,
coalesce((verdict = 'vulnerable')::INT, 0) AS llm, confidence, coalesce(any_hit, 0) AS stat FROM g LEFT JOIN (SELECT * FROM v WHERE run = 'cascade') v ON g.unique_id = v.doc_id::BIGINT LEFT JOIN h USING (unique_id) WHERE y IS NOT NULL)"""


def rate_sql(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"


def rates_sql(source: str, keys: str) -> str:
    p, r, f = rate_sql("tp", "tp + fp"), rate_sql("tp", "tp + fn"), rate_sql("fp", "fp + tn")
    return f"""SELECT {keys}, tp, fp, fn, tn, round({p}, 6) AS precision, round({r}, 6) AS recall, round({rate_sql(f'2 * {p} * {r}', f'{p} + {r}')}, 6) AS f1, round({f}, 6) AS fpr,
round({rate_sql('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round({r} - {f}, 6) AS youden_j,
round({rate_sql('tp::DOUBLE * tn - fp::DOUBLE * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')}, 6) AS mcc FROM {source}"""


COUNTS = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 0 AND p = 0) AS tn"


# ---- sources and samples


@query("""SELECT doc_id, n::INT AS n, s::INT AS span_start, e::INT AS span_end, l AS label FROM (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS s, unnest(e) AS e, unnest(l) AS l FROM (
SELECT doc_id, regexp_extract_all(gold_spans, '\\{''start'': (\\d+), ''end'': \\d+, ''text'': ', 1) AS s, regexp_extract_all(gold_spans, '\\{''start'': \\d+, ''end'': (\\d+), ''text'': ', 1) AS e,
regexp_extract_all(gold_spans, ', ''label'': ''(\\w+)''\\}', 1) AS l FROM pii WHERE gold_spans IS NOT NULL))""")
def S01_gold_spans(spark, d):
    return readers.gold_spans(table(spark, d, "pii", "doc_id", "gold_spans"), "doc_id", "gold_spans")


@query("SELECT split, (label <> 0)::INT::VARCHAR AS verdict_binary, count(*) AS n FROM guard GROUP BY ALL")
def S02_guard_binary(spark, d):
    return table(spark, d, "guard", "split", "label").groupBy("split", (F.col("label") != 0).cast("int").cast("string").alias("verdict_binary")).agg(F.count(F.lit(1)).alias("n"))


def sample_sql(source: str, record: str, stratum: str, n: int) -> str:
    return f"""SELECT {record}, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || {record}::VARCHAR)) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY stratum) * {n} / count(*) OVER (), 0)) AS k
FROM (SELECT {record}, coalesce({stratum}::VARCHAR, 'unmatched') AS stratum FROM {source})) WHERE rn <= k"""


@query(sample_sql("documents", "doc_id", "lang", 200))
def S08_stratified_sample(spark, d):
    rows = table(spark, d, "documents", "doc_id", "lang").withColumn("stratum", F.coalesce("lang", F.lit("unmatched")))
    return joins.stratified_sample(rows, "doc_id", "stratum", 200).select("doc_id", "stratum")


@query(f"WITH {G} " + sample_sql("g", "unique_id", "y", 300))
def S09_sample_by_label(spark, d):
    rows = gold(spark, d).select("unique_id", F.coalesce(F.col("y").cast("string"), F.lit("unmatched")).alias("stratum"))
    return joins.stratified_sample(rows, "unique_id", "stratum", 300)


@query(f"""WITH {G}, {H} SELECT y::VARCHAR AS y, any_hit::VARCHAR AS any_hit, (len(regexp_extract_all(code, '{UNSAFE}')) > 0) AS unsafe, count(*) AS n FROM g LEFT JOIN h USING (unique_id) GROUP BY ALL""")
def S10_composite_load(spark, d):
    g = gold(spark, d, "code").select("unique_id", "y", (T.count_matches(F.col("code"), triage.UNSAFE_CALL) > 0).alias("unsafe"))
    return g.join(scanner(spark, d), "unique_id", "left").groupBy(*[F.col(c).cast("string").alias(c) for c in ("y", "any_hit")], "unsafe").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {G} SELECT gold_label, y::VARCHAR AS y, count(*) AS n, count(gold_cwe_id) AS with_cwe FROM g GROUP BY ALL")
def S11_gold_typed(spark, d):
    return gold(spark, d, "gold_cwe_id").groupBy("gold_label", F.col("y").cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count("gold_cwe_id").alias("with_cwe"))


@query(f"WITH {V} SELECT doc_id, run, verdict, confidence::VARCHAR AS confidence, action, array_to_string(evidence, '; ') AS evidence, CASE WHEN length(rationale) > 20 THEN substr(rationale, 1, 20) || ' [cut]' ELSE rationale END AS rationale FROM v")
def K03_flat_cells(spark, d):
    v = latest(spark, d)
    return v.select("doc_id", "run", "verdict", F.col("confidence").cast("string").alias("confidence"), "action", T.cell(F.col("evidence"), "array<string>").alias("evidence"), T.clip(F.col("rationale"), 20, writers.NOTICE).alias("rationale"))


# ---- projections and routing


@query(f"WITH {J} SELECT run, confidence >= 0.8 IS TRUE AS sure, count(*) AS n, count(*) FILTER (p = y) AS correct FROM j GROUP BY ALL")
def P03_route(spark, d):
    rows = judged(spark, d)
    sure, rest = routed(rows, "confidence", 0.8)
    both = sure.withColumn("sure", F.lit(True)).unionByName(rest.withColumn("sure", F.lit(False)))
    return both.groupBy("run", "sure").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("y")).alias("correct"))


@query(f"WITH {G} SELECT unique_id FROM g WHERE unique_id IN (SELECT unique_id FROM scanner_hits WHERE any_hit) AND unique_id NOT IN (SELECT doc_id::BIGINT FROM verdicts WHERE verdict = 'vulnerable')")
def P04_membership(spark, d):
    hit = table(spark, d, "scanner_hits", "unique_id", "any_hit").where("any_hit")
    bad = table(spark, d, "verdicts", "doc_id", "verdict").where("verdict = 'vulnerable'").select(F.col("doc_id").cast("long").alias("unique_id"))
    return gold(spark, d).join(hit, "unique_id", "left_semi").join(bad, "unique_id", "left_anti").select("unique_id")


@query(f"""WITH {V} SELECT doc_id, run, CASE WHEN verdict IN ('vulnerable', 'secure') THEN verdict ELSE 'secure' END AS forced, verdict NOT IN ('vulnerable', 'secure') AS disobeyed,
least(1.0, greatest(0.0, coalesce(confidence, 0.4))) AS confidence, CASE verdict WHEN 'vulnerable' THEN 'block' WHEN 'secure' THEN 'pass' ELSE 'manual_review' END AS action,
coalesce(array_to_string(list_filter(evidence, lambda x: x IN ('unsafe_func', 'use_after_free', 'double_free')), ';'), '') AS tags FROM v""")
def P06_P07_clamped(spark, d):
    v, known = latest(spark, d), F.col("verdict").isin("vulnerable", "secure")
    vocabulary = F.array(*map(F.lit, ("unsafe_func", "use_after_free", "double_free")))
    return v.select("doc_id", "run", F.when(known, F.col("verdict")).otherwise("secure").alias("forced"), (~known).alias("disobeyed"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.4)))).alias("confidence"),
                    F.when(F.col("verdict") == "vulnerable", "block").when(F.col("verdict") == "secure", "pass").otherwise("manual_review").alias("action"),
                    F.array_join(F.filter("evidence", lambda x: F.array_contains(vocabulary, x)), ";").alias("tags"))


@query("SELECT doc_id, substr(text, 1, 500) AS head, length(text) > 500 AS cut, greatest(1, length(text) // 4) AS tokens, substr(sha256(text), 1, 12) AS digest FROM documents")
def P09_F18_F19_prepared(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.substring(t, 1, 500).alias("head"), (F.length(t) > 500).alias("cut"), T.token_estimate(t).cast("long").alias("tokens"), T.short_hash(t).alias("digest"))


# ---- joins


@query(f"""WITH {S}, b AS (SELECT * FROM s WHERE run = 'model'), p AS (SELECT * FROM s WHERE run = 'scanner' AND verdict <> 'uncertain') SELECT b.doc_id, CASE WHEN p.doc_id IS NULL THEN b.verdict ELSE p.verdict END AS verdict, CASE WHEN p.doc_id IS NULL THEN b.confidence ELSE p.confidence END AS confidence, p.doc_id IS NOT NULL AS patched FROM b LEFT JOIN p USING (doc_id)""")
def J08_overlay(spark, d):
    s = samples(spark, d)
    return joins.overlay(s.where("run = 'model'").select("doc_id", "verdict", "confidence"), s.where("run = 'scanner' AND verdict <> 'uncertain'"), "doc_id", ["verdict", "confidence"])


CODE_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH t AS (SELECT DISTINCT md5({CODE_NORMAL.format('code')}) AS k FROM codereview WHERE split = 'train') SELECT unique_id, md5({CODE_NORMAL.format('code')}) IN (SELECT k FROM t) AS leaked FROM codereview WHERE split = 'test'")
def J06_F03_leakage(spark, d):
    c = table(spark, d, "codereview", "unique_id", "code", "split")
    return joins.leakage(c.where("split = 'train'"), c.where("split = 'test'"), "unique_id", T.code_md5(F.col("code")))


@query(r"SELECT sha256(regexp_replace(func, '\s+', '', 'g')) AS key, min(target) AS payload FROM upstream_funcs GROUP BY 1 HAVING count(*) = count(target) AND min(target) = max(target)")
def J07_F02_conflicts(spark, d):
    return joins.unambiguous(table(spark, d, "upstream_funcs", "func", "target"), T.bare_hash(F.col("func")), F.col("target"))


@query("""WITH k AS (SELECT origin, md5(text) AS k, label FROM (SELECT 'a' AS origin, text, label FROM guard WHERE split = 'train' UNION ALL SELECT 'b', text, label FROM guard WHERE split = 'test')),
a AS (SELECT k, min(label) AS lo, max(label) AS hi FROM k WHERE origin = 'a' GROUP BY 1), b AS (SELECT k, min(label) AS lo, max(label) AS hi FROM k WHERE origin = 'b' GROUP BY 1),
o AS (SELECT CASE WHEN a.lo <> a.hi OR b.lo <> b.hi THEN 'internal_conflict' WHEN a.lo IS NULL AND b.lo IS NULL THEN 'unlabelled' WHEN a.lo IS NULL THEN 'b_only' WHEN b.lo IS NULL THEN 'a_only' WHEN a.lo = b.lo THEN 'both_agree' ELSE 'both_disagree' END AS outcome FROM a FULL JOIN b USING (k))
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def J14_reconcile(spark, d):
    g = table(spark, d, "guard", "text", "label", "split").withColumn("k", F.md5("text"))
    return joins.reconcile(g.where("split = 'train'"), g.where("split = 'test'"), "k", "label").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT x AS verdict, count(*) FILTER (z = 'secure') AS secure, count(*) FILTER (z = 'uncertain') AS uncertain, count(*) FILTER (z = 'vulnerable') AS vulnerable FROM q GROUP BY 1")
def J13_A17_agreement_matrix(spark, d):
    return joins.crosstab(pair(spark, d), "x", "z", ["secure", "uncertain", "vulnerable"]).withColumnRenamed("x", "verdict")


# ---- aggregations


@query(f"WITH {J} SELECT run, verdict, coalesce(action, '') AS action, count(*) AS n, round(avg((p = y)::INT), 6) AS accuracy FROM j GROUP BY ALL")
def A07_A22_per_source(spark, d):
    return judged(spark, d).groupBy("run", "verdict", F.coalesce("action", F.lit("")).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("p") == F.col("y")).cast("double")), 6).alias("accuracy"))


@query(f"WITH {J}, m AS (SELECT run, {COUNTS} FROM j GROUP BY run) {rates_sql('m', 'run')}")
def A04_A05_binary_metrics(spark, d):
    return metrics.binary(judged(spark, d), "y", "p", "run")


@query(f"WITH {J}, l AS (SELECT unnest([0, 1]) AS x) SELECT a.x::VARCHAR AS y_true, b.x::VARCHAR AS y_pred, count(j.y) AS n FROM l a CROSS JOIN l b LEFT JOIN (SELECT * FROM j WHERE run = 'single') j ON y = a.x AND p = b.x GROUP BY ALL")
def A02_confusion(spark, d):
    rows = judged(spark, d).where("run = 'single'").select(F.col("y").cast("string").alias("y"), F.col("p").cast("string").alias("p"))
    return metrics.confusion(rows, "y", "p", spark.createDataFrame([("0",), ("1",)], "label string"))


CLASSES = f"""{P}, c AS (SELECT z AS y, x AS p FROM q),
k AS (SELECT l AS label, count(*) FILTER (y = l AND p = l) AS hit, count(*) FILTER (y = l) AS support, count(*) FILTER (p = l) AS found FROM c, (SELECT DISTINCT unnest([y, p]) AS l FROM c) GROUP BY 1),
r AS (SELECT label, support, {rate_sql('hit', 'found')} AS pr, {rate_sql('hit', 'support')} AS rc FROM k), sc AS (SELECT label, round(pr, 6) AS precision, round(rc, 6) AS recall, round({rate_sql('2 * pr * rc', 'pr + rc')}, 6) AS f1, support FROM r)"""


def _classes(spark, d):
    return metrics.per_class(pair(spark, d).select(F.col("z").alias("y"), F.col("x").alias("p")), "y", "p")


@query(f"WITH {CLASSES} SELECT label, precision, recall, f1, support FROM sc")
def A01_per_class(spark, d):
    return _classes(spark, d)


@query(f"WITH {CLASSES} SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM sc UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM sc")
def A01_averages(spark, d):
    return metrics.averaged(_classes(spark, d))


@query(f"WITH {J} SELECT run, count(*) FILTER (verdict = 'uncertain') AS queued, count(*) FILTER (verdict = 'uncertain' AND y = 1) AS queued_bad, count(*) AS n, round({rate_sql('count(*) FILTER (y = 1 AND p = 1)', 'count(*) FILTER (y = 1)')}, 6) AS caught FROM j GROUP BY 1")
def A16_A24_queue(spark, d):
    unsure, bad = F.col("verdict") == "uncertain", F.col("y") == 1
    return judged(spark, d).groupBy("run").agg(F.count_if(unsure).alias("queued"), F.count_if(unsure & bad).alias("queued_bad"), F.count(F.lit(1)).alias("n"), F.round(metrics.ratio(F.count_if(bad & (F.col("p") == 1)), F.count_if(bad)), 6).alias("caught"))


@query(f"WITH {V} SELECT run, count(confidence) AS n, round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median, round(quantile_cont(confidence, 0.9), 6) AS p90, round(max(confidence), 6) AS max, round(min(confidence), 6) AS min, round(avg((confidence > 0.8)::INT), 6) AS frac_above FROM v WHERE confidence IS NOT NULL GROUP BY 1")
def A09_quantiles(spark, d):
    return metrics.quantile_stats(latest(spark, d), "confidence", 0.8, "run")


@query(f"WITH {V}, e AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.2::DOUBLE), (1, 0.2, 0.4), (2, 0.4, 0.6), (3, 0.6, 0.8), (4, 0.8, 1.0)) t(bin, low, high)) SELECT bin, low, high, count(confidence) AS n FROM e LEFT JOIN v ON confidence >= low AND (confidence < high OR (bin = 4 AND confidence <= high)) GROUP BY ALL")
def A11_histogram(spark, d):
    return metrics.histogram(latest(spark, d), "confidence", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])


@query(f"WITH {P} SELECT x AS before, z AS after, count(*) AS n, count(*) FILTER ((z = 'vulnerable')::INT = y) AS right_after FROM q GROUP BY ALL")
def A18_reversals(spark, d):
    return pair(spark, d).groupBy(F.col("x").alias("before"), F.col("z").alias("after")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("z") == "vulnerable").cast("int") == F.col("y")).alias("right_after"))


@query("SELECT doc_id, count(DISTINCT sha256(rationale)) AS responses, count(*) AS n FROM verdicts GROUP BY 1")
def A19_diversity(spark, d):
    return table(spark, d, "verdicts", "doc_id", "rationale").groupBy("doc_id").agg(F.count_distinct(F.sha2("rationale", 256)).alias("responses"), F.count(F.lit(1)).alias("n"))


CWE = r"CASE WHEN lower(trim(gold_cwe_id)) IN ('none', 'null', 'n/a', 'na', '-', 'нет', '') THEN NULL ELSE 'CWE-' || coalesce(nullif(regexp_extract(trim(gold_cwe_id), '(?i)cwe[\s_:-]*0*(\d+)', 1), ''), nullif(regexp_extract(trim(gold_cwe_id), '^0*(\d+)(?:\.0)?$', 1), '')) END"
NAMED = ", ".join(f"'CWE-{n}'" for n in T.NAMED_CWES)


@query(f"SELECT gold_cwe_id, {CWE} AS cwe, coalesce({CWE} IN ({NAMED}), false) AS named, count(*) AS n FROM codereview WHERE gold_cwe_id IS NOT NULL GROUP BY ALL")
def F08_F09_cwe(spark, d):
    c = T.cwe_canonical(F.col("gold_cwe_id"))
    return table(spark, d, "codereview", "gold_cwe_id").where("gold_cwe_id IS NOT NULL").groupBy("gold_cwe_id", c.alias("cwe"), F.coalesce(T.cwe_is_named(c), F.lit(False)).alias("named")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH c AS (SELECT {CWE} AS cwe FROM codereview) SELECT cwe, count(*) AS n FROM c WHERE cwe IS NOT NULL GROUP BY 1 ORDER BY n DESC, cwe LIMIT 10")
def W13_top_cwes(spark, d):
    return table(spark, d, "codereview", "gold_cwe_id").groupBy(T.cwe_canonical(F.col("gold_cwe_id")).alias("cwe")).agg(F.count(F.lit(1)).alias("n")).where("cwe IS NOT NULL").orderBy(F.desc("n"), "cwe").limit(10)


# ---- windows, ranks, curves


@query("SELECT uid, doc_id, row_number() OVER (PARTITION BY uid ORDER BY doc_id) AS occurrence FROM pii")
def W01_occurrence(spark, d):
    return spans.number_occurrences(table(spark, d, "pii", "uid", "doc_id"), "uid", ["doc_id"]).withColumn("occurrence", F.col("occurrence").cast("long"))


@query("SELECT unique_id, length(code) AS len, round((row_number() OVER (ORDER BY length(code), unique_id) - 1) / count(*) OVER (), 9) AS rank FROM codereview")
def W02_length_rank(spark, d):
    rows = table(spark, d, "codereview", "unique_id", "code").select("unique_id", F.length("code").cast("long").alias("len"))
    return curves.length_rank(rows, "unique_id", "len").withColumn("rank", F.round("rank", 9))


@query(f"""WITH {FLAG}, e AS (SELECT unnest({[f"q{i}" for i in range(21)]}) AS n, unnest([{", ".join(f"quantile_cont(len, {i / 20})" for i in range(21))}]) AS e FROM f), d AS (SELECT list(DISTINCT e) AS e FROM e),
b AS (SELECT y, greatest(llm, stat) AS a, greatest(len(list_filter(d.e, lambda x: x < f.len)) - 1, 0) AS stratum FROM f, d), gg AS (SELECT stratum, sum(y) FILTER (a = 1) AS obs, sum(y) FILTER (a = 0) AS rest, count(*) FILTER (a = 1) AS n, count(*) FILTER (a = 0) AS m FROM b GROUP BY 1)
SELECT sum(coalesce(obs, 0))::BIGINT AS observed, round(sum(n * coalesce(rest, 0) / m), 6) AS expected, round({rate_sql("sum(coalesce(obs, 0))", "sum(n * coalesce(rest, 0) / m)")}, 6) AS lift FROM gg WHERE n > 0 AND m > 0""")
def W03_W17_stratified_lift(spark, d):
    rows = flagged(spark, d).withColumn("any", F.greatest("llm", "stat"))
    return curves.stratified_lift(rows, "len", "y", "any")


@query(f"""WITH {FLAG}, r AS (SELECT y, row_number() OVER (ORDER BY len DESC, unique_id) - 1 AS rank, count(*) OVER () AS n FROM f), b AS (SELECT unnest([0.10, 0.151, 0.205, 0.30])::DOUBLE AS budget),
q AS (SELECT budget, floor(round(budget * n, 9))::BIGINT AS k, y, (rank < floor(round(budget * n, 9)))::INT AS p FROM r, b), m AS (SELECT budget, k, {COUNTS} FROM q GROUP BY ALL) {rates_sql('m', 'budget, k')}""")
def W04_W18_budget(spark, d):
    return curves.budget_top(flagged(spark, d), "unique_id", "len", "y", BUDGETS)


@query(f"""WITH {FLAG}, s AS (SELECT *, (row_number() OVER (ORDER BY len, unique_id) - 1) / count(*) OVER () AS lr FROM f), w AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS w),
r AS (SELECT w, y, row_number() OVER (PARTITION BY w ORDER BY round(lr + w * llm + 0.5 * w * stat, 9) DESC, unique_id) - 1 AS rank, count(*) OVER (PARTITION BY w) AS n FROM s, w),
q AS (SELECT w, y, (rank < floor(round(0.205 * n, 9)))::INT AS p FROM r), m AS (SELECT w, {COUNTS} FROM q GROUP BY w), z AS ({rates_sql('m', 'w')}) SELECT round(w, 6) AS w, tp, fp, youden_j FROM z ORDER BY youden_j DESC, w LIMIT 1""")
def W05_weight_grid(spark, d):
    f = flagged(spark, d)
    s = materialize(f.select("unique_id", "y", "llm", "stat").join(curves.length_rank(f.select("unique_id", "len"), "unique_id", "len"), "unique_id"), "grid")
    from .scale import prefix_sums

    w = spark.createDataFrame([(i / 20,) for i in range(21)], "w double")
    long = s.join(F.broadcast(w), F.lit(True)).select("w", "unique_id", "y", (-F.round(F.col("rank") + F.col("w") * F.col("llm") + 0.5 * F.col("w") * F.col("stat"), 9)).alias("s"), F.lit(1).alias("one"))
    ranked = prefix_sums(long, ["w"], ["s", "unique_id"], "one", "before")
    n = F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))
    q = ranked.join(n, F.lit(True)).withColumn("p", (F.col("before") < F.floor(F.round(0.205 * F.col("n"), 9))).cast("int"))
    return metrics.binary(q, "y", "p", "w").select(F.round("w", 6).alias("w"), "tp", "fp", "youden_j").orderBy(F.desc("youden_j"), "w").limit(1)


CURVE = f"{J}, c AS (SELECT round(coalesce(confidence, 0) * p, 6) AS s, y FROM j WHERE run = 'single'), k AS (SELECT s, sum(y)::BIGINT AS np, sum(1 - y)::BIGINT AS nn FROM c GROUP BY 1), r AS (SELECT s, sum(np) OVER (ORDER BY s DESC)::BIGINT AS tp, sum(nn) OVER (ORDER BY s DESC)::BIGINT AS fp, sum(np) OVER ()::BIGINT AS pos, sum(nn) OVER ()::BIGINT AS neg FROM k)"


def _scores(spark, d):
    return judged(spark, d).where("run = 'single'").select("y", (F.coalesce("confidence", F.lit(0.0)) * F.col("p")).alias("s"))


@query(f"WITH {CURVE}, t AS (SELECT unnest([0.01, 0.05, 0.2])::DOUBLE AS target_fpr) SELECT target_fpr, round(coalesce(max(coalesce(tp / nullif(pos, 0), 0)) FILTER (coalesce(fp / nullif(neg, 0), 0) <= target_fpr), 0), 6) AS recall, min(s) FILTER (coalesce(fp / nullif(neg, 0), 0) <= target_fpr) AS threshold FROM r, t GROUP BY 1")
def W06_N05_recall_at_fpr(spark, d):
    return curves.recall_at_fpr(_scores(spark, d), "s", "y", [0.01, 0.05, 0.2])


@query(f"WITH {CURVE} SELECT s AS threshold, round({rate_sql('2 * tp', 'tp + fp + pos')}, 6) AS f1 FROM r ORDER BY f1 DESC, threshold LIMIT 1")
def W08_best_f1(spark, d):
    return curves.best_f1(_scores(spark, d), "s", "y")


@query(f"""WITH {J}, t AS (SELECT unnest(range(21)) / 20.0::DOUBLE AS threshold), c AS (SELECT round(confidence, 9) AS s, (p = y)::INT AS ok FROM j WHERE run = 'single' AND confidence IS NOT NULL)
SELECT threshold, round(count(*) FILTER (s < threshold) / count(*), 6) AS escalation_rate, count(*) FILTER (s >= threshold) AS auto_count, round(avg(ok) FILTER (s >= threshold), 6) AS auto_accuracy FROM c, t GROUP BY 1""")
def W09_escalation(spark, d):
    rows = judged(spark, d).where("run = 'single'").withColumn("ok", F.col("p") == F.col("y"))
    return curves.escalation(rows, "confidence", "ok")


@query(f"""WITH {J}, t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold), c AS (SELECT round(confidence, 9) AS s, y, p FROM j WHERE run = 'single' AND confidence IS NOT NULL),
m AS (SELECT threshold, round(count(*) FILTER (s >= threshold) / count(*), 6) AS coverage, round(1 - count(*) FILTER (s >= threshold) / count(*), 6) AS grey_zone_share, {COUNTS.replace('(y', '(s >= threshold AND y')} FROM c, t GROUP BY 1) {rates_sql('m', 'threshold, coverage, grey_zone_share')}""")
def W10_W12_coverage(spark, d):
    return curves.coverage(judged(spark, d).where("run = 'single'"), "confidence", "y", "p", THRESHOLDS)


@query(f"""WITH {J}, r AS (SELECT y, p, row_number() OVER (ORDER BY coalesce(confidence, -1), unique_id) - 1 AS rank, count(*) OVER () AS n, (sum(y) OVER ())::BIGINT AS total FROM j WHERE run = 'single'),
b AS (SELECT unnest({SLA_BUDGETS})::DOUBLE AS budget), q AS (SELECT budget, ceil(round(budget * n, 9))::BIGINT AS n_escalated, total, (y = 1 AND (rank < ceil(round(budget * n, 9)) OR p = 1)) AS hit FROM r, b)
SELECT budget, n_escalated, total, count(*) FILTER (hit) AS caught, round({rate_sql('count(*) FILTER (hit)', 'max(total)')}, 6) AS catch_rate FROM q GROUP BY budget, n_escalated, total""")
def W11_sla(spark, d):
    return curves.sla(judged(spark, d).where("run = 'single'"), "unique_id", "confidence", "y", "p", SLA_BUDGETS)


# ---- set operations, layers, votes, label history


@query(f"""WITH {FLAG}, x AS (SELECT y, unnest(['llm', 'stat', 'tri', 'llm|stat', 'llm&stat', 'llm-stat', 'stat-llm', 'llm|tri', 'llm&tri', 'llm-tri', 'tri-llm', 'stat|tri', 'stat&tri', 'stat-tri', 'tri-stat']) AS combination,
unnest([llm, stat, tri, llm | stat, llm & stat, llm & (1 - stat), stat & (1 - llm), llm | tri, llm & tri, llm & (1 - tri), tri & (1 - llm), stat | tri, stat & tri, stat & (1 - tri), tri & (1 - stat)]) AS p FROM f) SELECT combination, {COUNTS} FROM x GROUP BY 1""")
def U01_C08_layers(spark, d):
    return joins.layers(flagged(spark, d), ["llm", "stat", "tri"], "y")


@query(f"""WITH {S}, k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (verdict = 'vulnerable') AS votes, min(run) FILTER (verdict = 'vulnerable') AS fp, min(run) FILTER (verdict <> 'vulnerable') AS fn FROM s GROUP BY 1)
SELECT doc_id, votes >= 2 AS positive, round(CASE WHEN votes >= 2 THEN votes / n ELSE 1 - votes / n END, 6) AS confidence, votes, n, coalesce(CASE WHEN votes >= 2 THEN fp ELSE fn END, fp, fn) AS first FROM k""")
def C04_L10_vote(spark, d):
    return joins.vote(samples(spark, d), "doc_id", "verdict", "run", "vulnerable", 2)


@query(f"""WITH {S}, s1 AS (SELECT doc_id, verdict FROM s WHERE run = 'model'), s2 AS (SELECT doc_id, count(*) FILTER (verdict = 'vulnerable') AS votes FROM s WHERE run <> 'model' GROUP BY 1)
SELECT doc_id, CASE WHEN s1.verdict <> 'uncertain' OR s2.doc_id IS NULL THEN s1.verdict WHEN votes >= 1 THEN 'vulnerable' ELSE 'secure' END AS verdict, s1.verdict = 'uncertain' AND s2.doc_id IS NOT NULL AS second_stage FROM s1 LEFT JOIN s2 USING (doc_id)""")
def C05_C06_cascade(spark, d):
    s = samples(spark, d)
    first = s.where("run = 'model'").select("doc_id", "verdict")
    open_ = first.where("verdict = 'uncertain'").select("doc_id")
    votes = joins.vote(s.where("run <> 'model'").join(open_, "doc_id", "left_semi"), "doc_id", "verdict", "run", "vulnerable", 1)
    second = votes.select("doc_id", F.when(F.col("positive"), "vulnerable").otherwise("secure").alias("verdict"))
    return joins.overlay(first, second, "doc_id", ["verdict"]).withColumnRenamed("patched", "second_stage")


@query(f"""WITH {FLAG} SELECT unique_id, CASE WHEN llm + stat + tri > 0 THEN 'vulnerable' ELSE 'secure' END AS verdict, array_to_string(list_filter([CASE WHEN llm = 1 THEN 'llm' END, CASE WHEN stat = 1 THEN 'scanner' END, CASE WHEN tri = 1 THEN 'triage' END], lambda x: x IS NOT NULL), '+') AS tools,
CASE WHEN llm = 1 THEN coalesce(confidence, 0.4) WHEN stat + tri > 0 THEN 0.4 ELSE confidence END AS confidence FROM f""")
def C07_union(spark, d):
    f = flagged(spark, d)
    any_ = F.col("llm") + F.col("stat") + F.col("tri") > 0
    tools = F.concat_ws("+", *[F.when(F.col(c) == 1, F.lit(n)) for c, n in (("llm", "llm"), ("stat", "scanner"), ("tri", "triage"))])
    conf = F.when(F.col("llm") == 1, F.coalesce("confidence", F.lit(0.4))).when(F.col("stat") + F.col("tri") > 0, F.lit(0.4)).otherwise(F.col("confidence"))
    return f.select("unique_id", F.when(any_, "vulnerable").otherwise("secure").alias("verdict"), tools.alias("tools"), conf.alias("confidence"))


@query(f"""WITH {P}, c AS (SELECT y, (x = 'vulnerable')::INT AS a, (z = 'vulnerable')::INT AS b, (x = 'uncertain')::INT AS ua, (z = 'uncertain')::INT AS ub, cx, cz FROM q),
r AS (SELECT y, unnest(['union', 'intersection', 'union_uncertain', 'any_signal', 'weighted']) AS rule, unnest([greatest(a, b), least(a, b), (a = 1 OR b = 1 OR (ua = 1 AND ub = 1))::INT, greatest(a, b, ua, ub), (round(0.6 * a * cx + 0.4 * b * cz, 9) >= 0.3)::INT]) AS p FROM c), mm AS (SELECT rule, {COUNTS} FROM r GROUP BY 1) {rates_sql('mm', 'rule')}""")
def C01_C02_combinations(spark, d):
    pa, pb, ua, ub = F.col("x") == "vulnerable", F.col("z") == "vulnerable", F.col("x") == "uncertain", F.col("z") == "uncertain"
    score = F.round(0.6 * pa.cast("int") * F.col("cx") + 0.4 * pb.cast("int") * F.col("cz"), 9)
    rules = {"union": pa | pb, "intersection": pa & pb, "union_uncertain": pa | pb | (ua & ub), "any_signal": pa | pb | ua | ub, "weighted": score >= 0.3}
    long = pair(spark, d).select("y", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), c.cast("int").alias("p")) for n, c in rules.items()])).alias("r")).select("y", "r.*")
    return metrics.binary(long, "y", "p", "rule")


@query(f"""WITH {S}, j AS (SELECT run, doc_id, (verdict = 'vulnerable')::INT AS p, y FROM s JOIN g ON g.unique_id = s.doc_id::BIGINT WHERE y IS NOT NULL AND verdict <> 'uncertain'), k AS (SELECT doc_id FROM j GROUP BY 1 HAVING count(DISTINCT run) = 3),
mm AS (SELECT run, {COUNTS} FROM j WHERE doc_id IN (SELECT doc_id FROM k) GROUP BY run) {rates_sql('mm', 'run')}""")
def N04_paired(spark, d):
    g = gold(spark, d).where("y IS NOT NULL").select(F.col("unique_id").cast("string").alias("doc_id"), "y")
    j = samples(spark, d).where("verdict <> 'uncertain'").join(g, "doc_id").withColumn("p", (F.col("verdict") == "vulnerable").cast("int"))
    full = j.groupBy("doc_id").agg(F.count_distinct("run").alias("n")).where("n = 3")
    return metrics.binary(j.join(full, "doc_id", "left_semi"), "y", "p", "run")


@query(f"""WITH {P}, r AS (SELECT floor(cx * 5)::INT AS band, ((x = 'vulnerable')::INT = y) AS ok1, ((z = 'vulnerable')::INT = y) AS ok2 FROM q)
SELECT band, count(*) AS n, count(*) FILTER (NOT ok1 AND ok2) AS fixed, count(*) FILTER (ok1 AND NOT ok2) AS broken FROM r GROUP BY 1""")
def N06_fixed_broken(spark, d):
    ok1, ok2 = (F.col("x") == "vulnerable").cast("int") == F.col("y"), (F.col("z") == "vulnerable").cast("int") == F.col("y")
    return pair(spark, d).groupBy(F.floor(F.col("cx") * 5).cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok1 & ok2).alias("fixed"), F.count_if(ok1 & ~ok2).alias("broken"))


@query(f"""WITH {G} SELECT coalesce(gold_match_source, 'none') AS source, count(*) AS n, round(avg(length(code)), 4) AS mean_len, round(quantile_cont(length(code), 0.1), 4) AS p10, round(quantile_cont(length(code), 0.5), 4) AS median, round(quantile_cont(length(code), 0.9), 4) AS p90,
round(avg(len(string_split(code, chr(10)))), 4) AS lines, round(avg((length(code) < 200)::INT), 6) AS trivial FROM g GROUP BY 1""")
def N02_profile(spark, d):
    n = F.length("code")
    q = lambda x: F.round(F.percentile(n, F.lit(x)), 4)
    return gold(spark, d, "code", "gold_match_source").groupBy(F.coalesce("gold_match_source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 4).alias("mean_len"), q(0.1).alias("p10"), q(0.5).alias("median"), q(0.9).alias("p90"),
        F.round(F.avg(F.regexp_count("code", F.lit("\n")) + 1), 4).alias("lines"), F.round(F.avg((n < 200).cast("double")), 6).alias("trivial"))


@query(f"WITH {G}, k AS (SELECT md5({CODE_NORMAL.format('code')}) AS k, count(*) AS n, min(y) AS lo, max(y) AS hi FROM g GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS rows, count(*) FILTER (lo <> hi) AS conflicting FROM k")
def N03_duplicate_groups(spark, d):
    return joins.duplicate_groups(gold(spark, d, "code"), T.code_md5(F.col("code")), "y")


@query(f"""WITH {G}, {H}, q AS (SELECT coalesce(gold_match_source, 'none') AS source, y AS a, any_hit AS b FROM g JOIN h USING (unique_id) WHERE y IS NOT NULL AND any_hit IS NOT NULL), r AS (SELECT source, count(*) AS n, round(avg((a = b)::INT), 6) AS agree, round(avg((a = 1 - b)::INT), 6) AS inverted FROM q GROUP BY 1) SELECT *, greatest(agree, inverted) >= 0.95 AS accepted FROM r""")
def N01_source_agreement(spark, d):
    rows = gold(spark, d, "gold_match_source").join(scanner(spark, d), "unique_id").select(F.coalesce("gold_match_source", F.lit("none")).alias("source"), "y", "any_hit")
    return joins.agreement(rows, "source", "y", "any_hit")


@query(f"""WITH {J}, t AS (SELECT DISTINCT md5({CODE_NORMAL.format('code')}) AS k FROM codereview WHERE split = 'train'), l AS (SELECT unique_id, md5({CODE_NORMAL.format('code')}) IN (SELECT k FROM t) AS leaked FROM codereview WHERE split <> 'train'),
m AS (SELECT leaked, {COUNTS} FROM j JOIN l USING (unique_id) WHERE run = 'single' GROUP BY 1) {rates_sql('m', 'leaked')}""")
def N07_metrics_by_leak(spark, d):
    c = table(spark, d, "codereview", "unique_id", "code", "split")
    leak = joins.leakage(c.where("split = 'train'"), c.where("split <> 'train'"), "unique_id", T.code_md5(F.col("code")))
    return metrics.binary(judged(spark, d).where("run = 'single'").join(leak, "unique_id"), "y", "p", "leaked")


# ---- text functions and tags


@query(r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS squashed, md5(regexp_replace(replace(text, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS split_ids, CASE WHEN length(text) > 80 THEN regexp_replace(substr(text, 1, 80), ' [^ ]*$', '') || '...' ELSE text END AS head FROM documents")
def F01_F04_F07_normal(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(T.squash(t)).alias("squashed"), F.md5(T.split_identifiers(t)).alias("split_ids"), T.trim_words(t, 80).alias("head"))


TOKEN_SQL = T.C_TOKEN.replace("'", "''")


@query(f"SELECT unique_id, len(regexp_extract_all(code, '{TOKEN_SQL}')) AS n, len(list_distinct(regexp_extract_all(code, '{TOKEN_SQL}'))) AS kinds FROM codereview")
def F10_c_tokens(spark, d):
    t = T.c_tokens(F.col("code"))
    return table(spark, d, "codereview", "unique_id", "code").select("unique_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS t, sum(n * log2(n)) AS s FROM n GROUP BY 1) SELECT doc_id, round(coalesce(log2(t) - s / t, 0), 6) AS entropy FROM documents LEFT JOIN s USING (doc_id)""")
def M01_entropy(spark, d):
    return T.entropies(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _share(p: str) -> str:
    return f"round(CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '{p}')) / length(text) ELSE 0.0 END, 6)"


@query(rf"""SELECT doc_id, length(text) AS char_len, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS word_count, {_share('[^\\x00-\\x7F]')} AS non_ascii_ratio, {_share('[0-9]')} AS digit_ratio, {_share('[A-Z]')} AS upper_ratio, {_share('[{}]')} AS curly_brace_ratio,
len(regexp_extract_all(text, '\b(?:0x)?[0-9a-fA-F]{{16,}}\b')) AS hex_run_count, contains(text, '```')::INT AS has_code_block, len(regexp_extract_all(text, '!')) AS exclaim_count, len(regexp_extract_all(text, 'https?://\S+')) AS url_count FROM documents""")
def G01_text_features(spark, d):
    f = T.text_features(F.col("text"))
    keep = ("char_len", "word_count", "non_ascii_ratio", "digit_ratio", "upper_ratio", "curly_brace_ratio", "hex_run_count", "has_code_block", "exclaim_count", "url_count")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", *[(F.round(f[c], 6) if c.endswith("_ratio") else f[c]).alias(c) for c in keep])


def _tag_sql() -> str:
    esc = lambda p: p.replace("'", "''")
    parts = {t: f"regexp_matches(text, '(?im){esc('|'.join(p))}')" for t, p in tags.TAGS.items()}
    parts["obfuscation_base64"] = f"len(list_filter(regexp_extract_all(text, '{tags.ENCODED}'), lambda x: length(x) >= 32 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]'))) > 0"
    parts["direct_harmful_request"] = f"regexp_matches(text, '(?im){esc(tags.ASKED)}') AND regexp_matches(text, '(?i){esc(tags.HARM)}')"
    rows = " UNION ALL ".join(f"SELECT '{t}' AS tag, label::VARCHAR AS label, ({c})::INT AS hit FROM guard" for t, c in sorted(parts.items()))
    return f"SELECT tag, label, count(*) AS n, sum(hit)::BIGINT AS hits FROM ({rows}) GROUP BY ALL"


@query(_tag_sql())
def G02_G03_tag_counts(spark, d):
    g = table(spark, d, "guard", "text", "label")
    long = g.select(F.col("label").cast("string").alias("label"), F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), c.cast("int").alias("hit")) for t, c in tags.flags(F.col("text")).items()])).alias("x")).select("label", "x.*")
    return long.groupBy("tag", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


WORDS = "[a-z]{2,}"


@query(f"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM documents) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN f USING (term), n), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)
SELECT term, count(*) AS docs, round(sum(weight), 4) AS total FROM u GROUP BY 1 ORDER BY total DESC, term LIMIT 50""")
def G04_tfidf_terms(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    tf = materialize(vectors.terms(docs, "doc_id", F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0))), "tf")
    w = vectors.tfidf(tf, vectors.document_frequency(tf), docs.agg(F.count(F.lit(1)).alias("n")))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.round(F.sum("weight"), 4).alias("total")).orderBy(F.desc("total"), "term").limit(50)


# ---- spans


NATIVE = {"email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b", "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", "phone_number": r"\+?\(?[0-9][0-9. ()-]{6,16}[0-9]\b"}


def native_spans(text: F.Column) -> F.Column:
    """Shapes in order of priority, claimed greedily."""
    return spans.claim(F.concat(*[spans.matches(text, p, label) for label, p in NATIVE.items()]))


def _fold_sql() -> str:
    """The same by list functions: offsets from the gaps, then a greedy fold."""
    parts = []
    for label, p in NATIVE.items():
        parts.append(f"""SELECT doc_id, '{label}' AS label, {list(NATIVE).index(label)} AS prio, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM pii)""")
    return f"""WITH x AS ({' UNION ALL '.join(parts)}), s AS (SELECT doc_id, label, prio, m[i] AS value, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS s FROM x),
c AS (SELECT doc_id, list({{'s': s::INT, 'e': (s + length(value))::INT, 'l': label}} ORDER BY prio, s) AS c FROM s GROUP BY 1),
k AS (SELECT doc_id, unnest(list_reduce(list_transform(c, lambda y: [y]), lambda a, b: CASE WHEN len(list_filter(a, lambda y: y.s < b[1].e AND b[1].s < y.e)) > 0 THEN a ELSE list_concat(a, b) END)) AS x FROM c)
SELECT x.l AS label, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(x.s)::BIGINT AS starts, sum(x.e)::BIGINT AS ends FROM k GROUP BY 1"""


@query(_fold_sql())
def R01_R02_R11_native_spans(spark, d):
    rows = table(spark, d, "pii", "doc_id", "text").select("doc_id", F.explode(native_spans(F.col("text"))).alias("x"))
    return rows.groupBy(F.col("x.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.sum("x.start").alias("starts"), F.sum("x.end").alias("ends"))


@query()
def D35_detector_counts(spark, d):
    return detectors.detected(table(spark, d, "pii", "doc_id", "text"), "doc_id", "text").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


GOLD_SQL = ORACLES["S01_gold_spans"]


@query(f"""WITH gs AS ({GOLD_SQL}), a AS (SELECT doc_id, span_start, span_end, label FROM gs), f AS (SELECT doc_id, span_start, span_end, label FROM gs WHERE n % 3 <> 0 UNION ALL SELECT doc_id, span_start, span_end + 1, label FROM gs WHERE n % 3 = 0),
g AS (SELECT doc_id, span_start, span_end, label, count(*) AS g FROM a GROUP BY ALL), h AS (SELECT doc_id, span_start, span_end, label, count(*) AS f FROM f GROUP BY ALL), b AS (SELECT label, coalesce(g, 0) AS g, coalesce(f, 0) AS f FROM g FULL JOIN h USING (doc_id, span_start, span_end, label)),
s AS (SELECT label, sum(g)::BIGINT AS gold, sum(f)::BIGINT AS found, sum(least(g, f))::BIGINT AS hits FROM b GROUP BY 1), r AS (SELECT *, {rate_sql('hits', 'found')} AS p, {rate_sql('hits', 'gold')} AS q FROM s) SELECT label, gold, found, hits, round(p, 6) AS precision, round(q, 6) AS recall, round({rate_sql('2 * p * q', 'p + q')}, 6) AS f1 FROM r""")
def J10_A12_span_scores(spark, d):
    g = readers.gold_spans(table(spark, d, "pii", "doc_id", "gold_spans"), "doc_id", "gold_spans")
    f = g.withColumn("span_end", F.col("span_end") + (F.col("n") % 3 == 0).cast("int"))
    return spans.precision_recall(spans.exact_matches(g, f, "doc_id"))


@query()
def J09_overlap_scores(spark, d):
    p = table(spark, d, "pii", "doc_id", "text", "gold_spans")
    g = readers.gold_spans(p, "doc_id", "gold_spans")
    f = detectors.detected(p.where("gold_spans IS NOT NULL"), "doc_id", "text")
    return spans.overlap_matches(g, f, "doc_id").agg(F.sum("gold").alias("gold"), F.sum("found").alias("found"), F.sum("hits").alias("hits"))


@query()
def A13_label_confusion(spark, d):
    p = table(spark, d, "pii", "doc_id", "text", "gold_spans")
    g = readers.gold_spans(p, "doc_id", "gold_spans").select("doc_id", F.col("span_start").alias("gs"), F.col("span_end").alias("ge"), F.col("label").alias("gold"))
    f = detectors.detected(p.where("gold_spans IS NOT NULL"), "doc_id", "text").select("doc_id", "span_start", "span_end", F.col("label").alias("found"))
    both = g.join(f, "doc_id").where("gs < span_end AND span_start < ge AND gold <> found")
    return both.groupBy("gold", "found").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "found").limit(20)


@query()
def R03_R04_R07_R10_rewritten(spark, d):
    t = F.col("text")
    first = spans.matches(t, NATIVE["email"], "email")
    merged = spans.leftmost_longest(spans.merge_by_priority(first, native_spans(t)))
    rows = table(spark, d, "pii", "doc_id", "text").select("doc_id", "text", merged.alias("spans")).withColumn("rewritten", spans.replaced(t, F.col("spans")))
    return rows.select("doc_id", "rewritten", F.array_join(spans.labels(F.col("spans")), ";").alias("labels"), F.size(spans.leftovers(F.col("rewritten"), F.col("spans"))).alias("leftovers"))


@query()
def AL08_AL09_A14_anonymised(spark, d):
    """Rewritten and audited with a secret from the session's configuration; tests use their own."""
    secret = spark.conf.get("spark.sieveline.secret", "benchmark")
    return pseudonyms.audit_summary(pseudonyms.anonymised(table(spark, d, "pii", "doc_id", "text"), "doc_id", "text", secret))


# ---- code triage


@query(rf"""SELECT unique_id, len(regexp_extract_all(code, '{UNSAFE}')) AS n_unsafe_func, len(regexp_extract_all(code, '{triage.SIZE_ARITHMETIC}')) AS n_size_int_overflow, least(len(regexp_extract_all(code, '{UNSAFE}')), 3) * 3 + least(len(regexp_extract_all(code, '{triage.SIZE_ARITHMETIC}')), 3) * 2 AS risk_score FROM codereview""")
def T01_T06_T07_native_triage(spark, d):
    return triage.scored(table(spark, d, "codereview", "unique_id", "code"), "code", windows=False).select("unique_id", "n_unsafe_func", "n_size_int_overflow", "risk_score")


@query()
def T02_T05_T08_triage(spark, d):
    return triage.summary(triage.scored(table(spark, d, "codereview", "unique_id", "code"), "code"))


@query()
def T09_candidates(spark, d):
    s = triage.scored(table(spark, d, "codereview", "unique_id", "code"), "code")
    return s.select("unique_id", F.array_join(triage.candidate_cwes(F.col("categories")), ";").alias("candidates"))


@query()
def T11_patch_checks(spark, d):
    """Upstream's fixed functions as patches of its unfixed ones of the same name."""
    u = table(spark, d, "upstream_funcs", "func_id", "func", "func_name", "target", "origin").where("func_name IS NOT NULL")
    bad, good = u.where("target = 1").select("origin", "func_name", F.col("func").alias("original")), u.where("target = 0").select("origin", "func_name", F.col("func").alias("patched"), "func_id")
    checked = triage.patch_checks(bad.join(good, ["origin", "func_name"]), "original", "patched")
    return checked.groupBy("signature_status", "functionality_status", "pattern_status", "passed").agg(F.count(F.lit(1)).alias("n"))


@query()
def F13_F16_C13_patch_likeness(spark, d):
    u = table(spark, d, "upstream_funcs", "func", "func_name", "target", "origin").where("func_name IS NOT NULL")
    bad, good = u.where("target = 1").select("origin", "func_name", F.col("func").alias("a")), u.where("target = 0").select("origin", "func_name", F.col("func").alias("b"))
    rows = bad.join(good, ["origin", "func_name"]).withColumn("sa", signature_of("a")).withColumn("sb", signature_of("b"))
    ta, tb = T.c_tokens(F.col("a")), T.c_tokens(F.col("b"))
    jac = F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))
    rows = rows.select("origin", text_similarity("a", "b").alias("sim"), line_decile_overlap("a", "b", "b").alias("dec"), jac.alias("jac"), (F.col("sa.name") == F.col("sb.name")).cast("double").alias("same"))
    return rows.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("sim", "dec", "jac", "same")])


# ---- neighbours and models


KNN = """q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id AS neighbour, list_cosine_similarity(q.e::DOUBLE[], p.embedding::DOUBLE[]) AS similarity, label FROM q JOIN embeddings p ON p.vec_id <> q.query),
n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM s)"""


def _near(spark, d, k=10):
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", k)


@query(f"WITH {KNN} SELECT query, neighbour, round(similarity, 4) AS similarity, rank::INT AS rank FROM n WHERE rank <= 10")
def G09_W15_neighbours(spark, d):
    return _near(spark, d).withColumn("similarity", F.round("similarity", 4))


@query(f"WITH {KNN} SELECT count(*) AS n, round(avg(similarity), 4) AS mean, round(quantile_cont(similarity, 0.5), 4) AS median, round(quantile_cont(similarity, 0.9), 4) AS p90, round(avg((n.label = e.label)::INT), 6) AS same_label FROM n JOIN embeddings e ON e.vec_id = query WHERE rank = 1")
def G10_near_duplicates(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    n = _near(spark, d, 1).join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("lq")), "query").join(e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("ln")), "neighbour")
    return n.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 4).alias("mean"), F.round(F.percentile("similarity", F.lit(0.5)), 4).alias("median"), F.round(F.percentile("similarity", F.lit(0.9)), 4).alias("p90"), F.round(F.avg((F.col("lq") == F.col("ln")).cast("double")), 6).alias("same_label"))


@query()
def G13_neighbour_vote(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "label")
    v = vectors.neighbour_vote(_near(spark, d), e, "vec_id", "label").join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("truth")), "query")
    return v.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("truth")).cast("double")), 4).alias("accuracy"))


@query()
def G05_G07_classifier(spark, d):
    g = table(spark, d, "guard", "text", "label", "split").withColumn("label", F.col("label").cast("int"))
    model = models.text_classifier(g.where("split = 'train'"), "text", "label")
    got = models.classified(model, g.where("split = 'test'"), ["label"])
    return metrics.binary(got.select((F.col("label") != 0).cast("int").alias("y"), (F.col("prediction") != 0).cast("int").alias("p")), "y", "p")


# ---- model stage


@query()
def L01_L04_L07_stub_pipeline(spark, d):
    g = table(spark, d, "guard", "doc_id", "text")
    rows, _ = answered(g, "doc_id", "text", Stub(), example={"verdict": "pass|block|manual_review", "confidence": 0.5})
    verdict = F.get_json_object("answer", "$.verdict")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.get_json_object("answer", "$.confidence").cast("double")), 6).alias("confidence"))


@query(r"""SELECT doc_id, x IS NOT NULL AS is_object, json_extract_string(x, '$.k')::BIGINT AS k FROM (SELECT event_id AS doc_id, nullif(regexp_extract('answer: ' || props || ' end', '(?s)(\{.*\})', 1), '') AS x FROM events)""")
def X01_json_objects(spark, d):
    x = T.extract_json(F.concat(F.lit("answer: "), F.col("props"), F.lit(" end")))
    return table(spark, d, "events", "event_id", "props").select(F.col("event_id").alias("doc_id"), x.isNotNull().alias("is_object"), F.get_json_object(x, "$.k").cast("long").alias("k"))
