"""More named queries: rule-based requests, error lists, label histories, overlays and knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import detectors, metrics, models, selection, spans, tags, triage
from .catalog import COUNTS, FLAG, H, J, G, P, S, UNSAFE, V, flagged, gold, judged, latest, pair, query, rate_sql, rates_sql, samples, scanner, table
from .pipeline import Pipeline, routed
from .scale import prefix_sums

ANY_TAG = [t for t in tags.NAMES if t != "direct_harmful_request"]


def _tag(t: str) -> str:
    esc = lambda p: p.replace("'", "''")
    if t == "obfuscation_base64":
        return f"len(list_filter(regexp_extract_all(text, '{tags.ENCODED}'), lambda x: length(x) >= 32 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]'))) > 0"
    if t == "direct_harmful_request":
        return f"(regexp_matches(text, '(?im){esc(tags.ASKED)}') AND regexp_matches(text, '(?i){esc(tags.HARM)}'))"
    return f"regexp_matches(text, '(?im){esc('|'.join(tags.TAGS[t]))}')"


RULE = f"r AS (SELECT doc_id, split, label, text, CASE WHEN {_tag('direct_harmful_request')} THEN 2 WHEN {' OR '.join(_tag(t) for t in ANY_TAG)} THEN 1 ELSE 0 END AS pred FROM guard WHERE label IS NOT NULL)"


def ruled(spark, d):
    """(doc_id, split, label, text, pred): the tags as a classifier: 2 a harmful request, 1 any other tag, else 0."""
    f = tags.flags(F.col("text"))
    other = F.lit(False)
    for t in ANY_TAG:
        other = other | f[t]
    return table(spark, d, "guard", "doc_id", "split", "label", "text").where("label IS NOT NULL").withColumn("pred", F.when(f["direct_harmful_request"], 2).when(other, 1).otherwise(0))


@query(f"WITH {RULE}, c AS (SELECT split, (label <> 0)::INT AS y, (pred <> 0)::INT AS p FROM r), m AS (SELECT split, {COUNTS} FROM c GROUP BY 1) {rates_sql('m', 'split')}")
def P01_A03_G14_tag_rule(spark, d):
    return metrics.binary(ruled(spark, d).select("split", (F.col("label") != 0).cast("int").alias("y"), (F.col("pred") != 0).cast("int").alias("p")), "y", "p", "split")


@query(f"WITH {RULE} SELECT count(*) FILTER (label > 0 AND pred > 0) AS both_positive, count(*) FILTER (label > 0 AND pred = label) AS same_kind, round({rate_sql('count(*) FILTER (label > 0 AND pred = label)', 'count(*) FILTER (label > 0 AND pred > 0)')}, 6) AS accuracy FROM r")
def A06_subtype_accuracy(spark, d):
    both, same = F.count_if((F.col("label") > 0) & (F.col("pred") > 0)), F.count_if((F.col("label") > 0) & (F.col("pred") == F.col("label")))
    return ruled(spark, d).agg(both.alias("both_positive"), same.alias("same_kind"), F.round(metrics.ratio(same, both), 6).alias("accuracy"))


@query(f"WITH {RULE} SELECT doc_id, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS kind, label, pred, substr(text, 1, 60) AS head FROM r WHERE (label <> 0) <> (pred <> 0)")
def G08_error_rows(spark, d):
    r = ruled(spark, d).where((F.col("label") != 0) != (F.col("pred") != 0))
    return r.select("doc_id", F.when(F.col("label") == 0, "FP").otherwise("FN").alias("kind"), "label", "pred", F.substring("text", 1, 60).alias("head"))


ERRORS = f"{RULE}, e AS (SELECT label, pred, CASE WHEN (label <> 0) = (pred <> 0) THEN 'none' WHEN length(text) < 60 THEN 'short' WHEN contains(text, chr(10)) THEN 'several lines' ELSE 'other' END AS category FROM r)"


def _categorised(spark, d):
    wrong = (F.col("label") != 0) != (F.col("pred") != 0)
    return ruled(spark, d).withColumn("category", F.when(~wrong, "none").when(F.length("text") < 60, "short").when(F.contains("text", F.lit("\n")), "several lines").otherwise("other"))


@query(f"WITH {ERRORS} SELECT category, label, count(*) AS n FROM e GROUP BY ALL")
def P13_A07_error_categories(spark, d):
    return _categorised(spark, d).groupBy("category", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ERRORS}, s AS (SELECT unnest(['short', 'several lines', 'other']) AS without), c AS (SELECT without, (label <> 0)::INT AS y, (pred <> 0)::INT AS p FROM e, s WHERE category <> without), m AS (SELECT without, {COUNTS} FROM c GROUP BY 1) {rates_sql('m', 'without')}")
def A21_ceiling_without(spark, d):
    s = spark.createDataFrame([("short",), ("several lines",), ("other",)], "without string")
    rows = _categorised(spark, d).join(F.broadcast(s), F.col("category") != F.col("without"))
    return metrics.binary(rows.select("without", (F.col("label") != 0).cast("int").alias("y"), (F.col("pred") != 0).cast("int").alias("p")), "y", "p", "without")


@query(r"""WITH f AS (SELECT doc_id, [len(regexp_extract_all(text, '[0-9]')), len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[{}]'))] AS s FROM documents) SELECT doc_id, list_position(s, list_max(s))::BIGINT - 1 AS best, list_max(s) AS score FROM f""")
def P02_argmax(spark, d):
    s = F.array(*[T.count_matches(F.col("text"), p) for p in ("[0-9]", "[A-Z]", "[{}]")])
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", (F.array_position(s, F.array_max(s)) - 1).alias("best"), F.array_max(s).alias("score"))


@query(f"WITH {G}, {V}, m AS (SELECT doc_id::BIGINT AS unique_id, verdict, confidence FROM v) SELECT unique_id, coalesce(verdict, 'uncertain') AS verdict, CASE WHEN verdict IS NULL THEN 0.0 ELSE confidence END AS confidence, verdict IS NULL AS failed FROM g LEFT JOIN m USING (unique_id)")
def J01_P08_fallback(spark, d):
    m = latest(spark, d).select(F.col("doc_id").cast("long").alias("unique_id"), "verdict", "confidence")
    g = gold(spark, d).select("unique_id").join(m, "unique_id", "left")
    return g.select("unique_id", F.coalesce("verdict", F.lit("uncertain")).alias("verdict"), F.when(F.col("verdict").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"), F.col("verdict").isNull().alias("failed"))


@query(f"WITH {J} SELECT unique_id, run, CASE WHEN confidence < 0.6 OR confidence IS NULL THEN 'manual_review' ELSE action END AS action, CASE WHEN confidence < 0.6 OR confidence IS NULL THEN least(coalesce(confidence, 0.4), 0.4) ELSE confidence END AS confidence FROM j")
def P10_T12_calibrated(spark, d):
    grey = F.coalesce(F.col("confidence") < 0.6, F.lit(True))
    return judged(spark, d).select("unique_id", "run", F.when(grey, "manual_review").otherwise(F.col("action")).alias("action"), F.when(grey, F.least(F.coalesce("confidence", F.lit(0.4)), F.lit(0.4))).otherwise(F.col("confidence")).alias("confidence"))


@query(f"WITH {J} SELECT unique_id, run FROM j WHERE y = 1 AND p = 1 AND unique_id IN (SELECT unique_id FROM codereview WHERE trim(code) <> '')")
def P12_J05_candidates(spark, d):
    return judged(spark, d).where("y = 1 AND p = 1").join(table(spark, d, "codereview", "unique_id", "code").where("trim(code) <> ''"), "unique_id", "left_semi").select("unique_id", "run")


@query(f"WITH {J} SELECT run, count(*) AS n, count(*) FILTER (verdict = 'uncertain') AS uncertain, count(*) FILTER (verdict = 'uncertain' AND run IN ('single', 'cascade')) AS restored FROM j GROUP BY 1")
def P11_P14_uncertain(spark, d):
    u = F.col("verdict") == "uncertain"
    return judged(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(u).alias("uncertain"), F.count_if(u & F.col("run").isin("single", "cascade")).alias("restored"))


@query(f"WITH {G} SELECT (SELECT count(*) FROM g JOIN scanner_hits USING (unique_id)) AS joined, (SELECT count(*) FROM (SELECT unique_id FROM g EXCEPT SELECT unique_id FROM scanner_hits)) AS only_gold, (SELECT count(*) FROM (SELECT unique_id FROM scanner_hits EXCEPT SELECT unique_id FROM g)) AS only_hits, (SELECT count(*) FROM (SELECT unique_id FROM scanner_hits GROUP BY 1 HAVING count(*) > 1)) AS repeated")
def J02_J03_U07_id_sets(spark, d):
    g, h = gold(spark, d).select("unique_id"), table(spark, d, "scanner_hits", "unique_id")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return (one(g.join(h, "unique_id"), "joined").join(one(g.distinct().join(h, "unique_id", "left_anti"), "only_gold")).join(one(h.distinct().join(g, "unique_id", "left_anti"), "only_hits"))
            .join(one(h.groupBy("unique_id").count().where("count > 1"), "repeated")))


@query(f"WITH {J}, c AS (SELECT unique_id, coalesce(gold_source_project, '') AS project FROM codereview) SELECT project, count(*) AS n, count(*) FILTER (p = y) AS correct FROM j JOIN c USING (unique_id) GROUP BY 1")
def J04_J12_by_project(spark, d):
    c = table(spark, d, "codereview", "unique_id", "gold_source_project").select("unique_id", F.coalesce("gold_source_project", F.lit("")).alias("project"))
    return judged(spark, d).join(c, "unique_id").groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") == F.col("y")).alias("correct"))


RULES = [(k, i, v) for i, (k, v) in enumerate(triage.HINTS.items())]
RULES_SQL = ", ".join(f"('{k}', {i}, {v})" for k, i, v in RULES)
NUMBER = r"nullif(ltrim(regexp_extract(gold_cwe_id, '(\d+)', 1), '0'), '')"


@query(f"""WITH u AS (SELECT * FROM (VALUES {RULES_SQL}) t(rule, ord, cwes)), c AS (SELECT unique_id, {NUMBER} AS cwe FROM codereview), h AS (SELECT unique_id, rule, ord, len(cwes) AS n FROM c JOIN u ON list_contains(cwes, cwe) WHERE cwe IS NOT NULL),
k AS (SELECT unique_id, rule, row_number() OVER (PARTITION BY unique_id ORDER BY n, ord)::INT AS rank FROM h) SELECT unique_id, rule, rank FROM k WHERE rank <= 5""")
def J11_W14_T10_rules(spark, d):
    rules = spark.createDataFrame(RULES, "rule string, ord int, cwes array<string>")
    n = F.nullif(F.regexp_replace(F.regexp_extract("gold_cwe_id", r"(\d+)", 1), "^0+", ""), F.lit(""))
    rows = table(spark, d, "codereview", "unique_id", "gold_cwe_id").select("unique_id", F.array(n).alias("cwes")).where("cwes[0] IS NOT NULL")
    return triage.top_rules(rows, "unique_id", "cwes", rules)


@query(f"WITH f AS (SELECT len(regexp_extract_all(code, '{UNSAFE}')) AS n FROM codereview) SELECT count(*) AS n, round(avg((n > 0)::INT), 6) AS share, round(avg(n), 6) AS mean, median(n)::DOUBLE AS median FROM f")
def A08_shares(spark, d):
    n = T.count_matches(F.col("code"), UNSAFE)
    return table(spark, d, "codereview", "code").select(n.alias("n")).agg(F.count(F.lit(1)).alias("m"), F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("share"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").cast("double").alias("median")).withColumnRenamed("m", "n")


@query("WITH r AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) SELECT v AS p90 FROM r WHERE i = round_even(0.9 * (n - 1), 0)")
def A10_nearest_rank(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").select(F.length("text").alias("v"), F.col("doc_id").alias("r"), F.lit(1).alias("one"), F.lit(0).alias("g"))
    ranked = prefix_sums(rows, ["g"], ["v", "r"], "one", "i")
    n = F.broadcast(ranked.agg(F.count(F.lit(1)).alias("n")))
    return ranked.join(n, F.lit(True)).where(F.col("i") == F.bround(F.lit(0.9) * (F.col("n") - 1)).cast("long")).select(F.col("v").cast("long").alias("p90"))


@query("WITH u AS (SELECT run, count(*) AS calls, sum(greatest(1, length(rationale) // 4))::BIGINT AS tokens, count(*) FILTER (received_ts > decided_ts + INTERVAL 1 DAY) AS late FROM verdicts GROUP BY 1) SELECT run, calls, tokens, late, tokens - (SELECT min(tokens) FROM u) AS above_least FROM u")
def A15_usage(spark, d):
    v = table(spark, d, "verdicts", "run", "rationale", "decided_ts", "received_ts")
    u = v.groupBy("run").agg(F.count(F.lit(1)).alias("calls"), F.sum(T.token_estimate(F.col("rationale"))).cast("long").alias("tokens"), F.count_if(F.col("received_ts") > F.col("decided_ts") + F.expr("INTERVAL 1 DAY")).alias("late"))
    least = F.broadcast(u.agg(F.min("tokens").alias("least")))
    return u.join(least, F.lit(True)).select("run", "calls", "tokens", "late", (F.col("tokens") - F.col("least")).alias("above_least"))


@query(f"""WITH {FLAG}, x AS (SELECT y, unnest(['llm', 'scanner', 'triage', 'any']) AS variant, unnest([llm, stat, tri, greatest(llm, stat, tri)]) AS p FROM f), m AS (SELECT variant, {COUNTS} FROM x GROUP BY 1), q AS ({rates_sql('m', 'variant')}) SELECT *, row_number() OVER (ORDER BY f1 DESC, variant)::INT AS place FROM q""")
def A23_C09_W16_variants(spark, d):
    f = flagged(spark, d)
    parts = [metrics.binary(f.withColumn("p", c), "y", "p").withColumn("variant", F.lit(n)) for n, c in (("llm", F.col("llm")), ("scanner", F.col("stat")), ("triage", F.col("tri")), ("any", F.greatest("llm", "stat", "tri")))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    from pyspark.sql import Window

    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "variant")))  # four rows


@query(f"WITH {G}, {V}, e AS (SELECT doc_id::BIGINT AS unique_id, unnest(evidence) AS c FROM v WHERE verdict = 'vulnerable'), u AS (SELECT * FROM (VALUES {RULES_SQL}) t(rule, ord, cwes)), k AS (SELECT unique_id, {NUMBER} AS cwe FROM g WHERE y = 1), h AS (SELECT k.unique_id, max(list_contains(cwes, cwe)::INT) AS hit FROM k JOIN e USING (unique_id) JOIN u ON rule = c WHERE cwe IS NOT NULL GROUP BY 1) SELECT count(*) AS covered, coalesce(sum(hit), 0)::BIGINT AS hits, round({rate_sql('sum(hit)', 'count(*)')}, 6) AS accuracy FROM h")
def A25_cwe_accuracy(spark, d):
    rules = F.broadcast(spark.createDataFrame(RULES, "rule string, ord int, cwes array<string>"))
    n = F.nullif(F.regexp_replace(F.regexp_extract("gold_cwe_id", r"(\d+)", 1), "^0+", ""), F.lit(""))
    k = gold(spark, d, "gold_cwe_id").where("y = 1").select("unique_id", n.alias("cwe")).where("cwe IS NOT NULL")
    e = latest(spark, d).where("verdict = 'vulnerable'").select(F.col("doc_id").cast("long").alias("unique_id"), F.explode("evidence").alias("rule"))
    h = k.join(e, "unique_id").join(rules, "rule").groupBy("unique_id").agg(F.max(F.array_contains("cwes", F.col("cwe")).cast("int")).alias("hit"))
    return h.agg(F.count(F.lit(1)).alias("covered"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.round(metrics.ratio(F.sum("hit"), F.count(F.lit(1))), 6).alias("accuracy"))


@query(f"""WITH {J}, s AS (SELECT coalesce(confidence, 0) * p AS s, y, unique_id FROM j WHERE run = 'single'), r AS (SELECT s, y, sum(1 - y) OVER (ORDER BY s DESC, unique_id ROWS UNBOUNDED PRECEDING) AS fp, (sum(y) OVER ()) AS pos, (sum(1 - y) OVER ()) AS neg FROM s), t AS (SELECT unnest([0.01, 0.05])::DOUBLE AS target_fpr)
SELECT target_fpr, round({rate_sql('sum(y) FILTER (s > 0 AND fp <= floor(neg * target_fpr))', 'max(pos)')}, 6) AS recall FROM r, t GROUP BY 1""")
def W07_recall_scan(spark, d):
    s = judged(spark, d).where("run = 'single'").select("y", (-F.coalesce("confidence", F.lit(0.0)) * F.col("p")).alias("s"), "unique_id", (1 - F.col("y")).alias("neg"), F.lit(0).alias("g"))
    r = prefix_sums(s, ["g"], ["s", "unique_id"], "neg", "before").withColumn("fp", F.col("before") + F.col("neg"))
    total = F.broadcast(r.agg(F.sum("y").alias("pos"), F.sum("neg").alias("all_neg")))
    t = F.broadcast(spark.createDataFrame([(0.01,), (0.05,)], "target_fpr double"))
    ok = (F.col("s") < 0) & (F.col("fp") <= F.floor(F.col("all_neg") * F.col("target_fpr")))
    return r.join(total, F.lit(True)).join(t, F.lit(True)).groupBy("target_fpr").agg(F.round(metrics.ratio(F.sum(F.when(ok, F.col("y")).otherwise(0)), F.max("pos")), 6).alias("recall"))


@query(f"WITH {FLAG} SELECT count(*) FILTER (llm = 1 AND stat = 0) AS only_llm, count(*) FILTER (llm = 0 AND stat = 1) AS only_scanner, count(*) FILTER (llm = 1 AND stat = 1) AS both, count(*) FILTER (llm = 0 AND stat = 0) AS neither, count(*) FILTER ((stat = 1 OR tri = 1) AND llm = 0) AS to_enrich FROM f")
def U02_U03_flag_sets(spark, d):
    a, b, t = F.col("llm") == 1, F.col("stat") == 1, F.col("tri") == 1
    return flagged(spark, d).agg(F.count_if(a & ~b).alias("only_llm"), F.count_if(~a & b).alias("only_scanner"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if((b | t) & ~a).alias("to_enrich"))


@query(f"WITH {S}, u AS (SELECT * FROM s WHERE run = 'model' UNION ALL SELECT * FROM s WHERE run = 'scanner') SELECT run, verdict, count(*) AS n FROM u GROUP BY ALL")
def U04_U05_bag_union(spark, d):
    s = samples(spark, d)
    return s.where("run = 'model'").unionByName(s.where("run = 'scanner'")).groupBy("run", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(text) AS k FROM documents GROUP BY md5(text)")
def U06_dedupe(spark, d):
    return table(spark, d, "documents", "doc_id", "text").groupBy(F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH {P} SELECT doc_id, CASE WHEN x = 'vulnerable' THEN x WHEN z = 'vulnerable' THEN z ELSE x END AS picked_union, CASE WHEN x = z THEN x ELSE 'uncertain' END AS picked_intersection, round(CASE WHEN x = z THEN greatest(cx, cz) ELSE (cx + cz) / 2 END, 6) AS confidence FROM q""")
def C03_pick(spark, d):
    x, z, cx, cz = (F.col(c) for c in ("x", "z", "cx", "cz"))
    return pair(spark, d).select("doc_id", F.when(x == "vulnerable", x).when(z == "vulnerable", z).otherwise(x).alias("picked_union"), F.when(x == z, x).otherwise("uncertain").alias("picked_intersection"), F.round(F.when(x == z, F.greatest(cx, cz)).otherwise((cx + cz) / 2), 6).alias("confidence"))


VERSIONS = f"{G}, {H}, n AS (SELECT unique_id, y AS old, CASE WHEN gold_label = 'conflict' THEN any_hit ELSE y END AS new FROM g LEFT JOIN h USING (unique_id))"


def versions(spark, d):
    """(unique_id, old, new): labels, and labels with conflicts settled by the scanner."""
    return gold(spark, d).join(scanner(spark, d), "unique_id", "left").select("unique_id", F.col("y").alias("old"), F.when(F.col("gold_label") == "conflict", F.col("any_hit")).otherwise(F.col("y")).alias("new"))


@query(f"WITH {VERSIONS} SELECT coalesce(old::VARCHAR, 'none') AS old, coalesce(new::VARCHAR, 'none') AS new, count(*) AS n FROM n GROUP BY ALL")
def C10_label_versions(spark, d):
    return versions(spark, d).groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(c) for c in ("old", "new")]).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {VERSIONS}, {V}, p AS (SELECT run, doc_id::BIGINT AS unique_id, (verdict = 'vulnerable')::INT AS p FROM v), x AS (SELECT run, version, y, p FROM (SELECT run, p, unnest(['old', 'new']) AS version, unnest([old, new]) AS y FROM p JOIN n USING (unique_id)) WHERE y IS NOT NULL), m AS (SELECT run, version, {COUNTS} FROM x GROUP BY ALL) {rates_sql('m', 'run, version')}""")
def C11_rescored(spark, d):
    p = latest(spark, d).select("run", F.col("doc_id").cast("long").alias("unique_id"), (F.col("verdict") == "vulnerable").cast("int").alias("p"))
    long = p.join(versions(spark, d), "unique_id").select("run", "p", F.explode(F.array(F.struct(F.lit("old").alias("version"), F.col("old").alias("y")), F.struct(F.lit("new").alias("version"), F.col("new").alias("y")))).alias("x")).select("run", "p", "x.*")
    return metrics.binary(long, "y", "p", "run", "version")


@query(f"WITH {G} SELECT unique_id, (['119', '787', '125', '120', '20'])[1 + ('0x' || substr(md5('7:' || unique_id::VARCHAR), 1, 6))::BIGINT % 5] AS control FROM g WHERE y = 1")
def C12_seeded_control(spark, d):
    h = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("unique_id").cast("string"))), 1, 6), 16, 10).cast("long")
    return gold(spark, d).where("y = 1").select("unique_id", F.element_at(F.array(*map(F.lit, triage.CLUSTER)), (1 + h % 5).cast("int")).alias("control"))


#: Date forms in the order they are tried, as SQL and Spark spell them.
DATE_FORMS = [("%Y-%m-%d", "yyyy-M-d"), ("%m/%d/%Y", "M/d/yyyy"), ("%d/%m/%Y", "d/M/yyyy"), ("%m-%d-%Y", "M-d-yyyy"), ("%d-%m-%Y", "d-M-yyyy"), ("%d.%m.%Y", "d.M.yyyy"), ("%B %d, %Y", "MMMM d, yyyy"), ("%d %B %Y", "d MMMM yyyy"),
              ("%b %d, %Y", "MMM d, yyyy"), ("%d %b %Y", "d MMM yyyy")]
DATE_LIKE = r"\b(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}|[A-Z][a-z]{2,8} [0-9]{1,2}, [0-9]{4}|[0-9]{1,2} [A-Z][a-z]{2,8} [0-9]{4})\b"


@query(f"""WITH t AS (SELECT doc_id, ('0x' || substr(md5('shift:' || doc_id), 1, 6))::BIGINT % 3651 AS days, unnest(regexp_extract_all(text, '{DATE_LIKE}')) AS v FROM pii),
p AS (SELECT doc_id, days, v, coalesce({', '.join(f"try_strptime(v, '{f}')" for f, _ in DATE_FORMS)}) AS dt FROM t)
SELECT doc_id, v AS written, dt::DATE::VARCHAR AS day, (dt + to_days(days::INTEGER))::DATE::VARCHAR AS moved, count(*) AS n FROM p GROUP BY ALL""")
def D01_D02_dates(spark, d):
    """Every date of ten forms, and where the document's own shift moves it; what no form fits has no day."""
    shift = F.conv(F.substring(F.md5(F.concat(F.lit("shift:"), "doc_id")), 1, 6), 16, 10).cast("long") % 3651
    found = table(spark, d, "pii", "doc_id", "text").select("doc_id", shift.cast("int").alias("days"), F.explode(F.regexp_extract_all("text", F.lit(DATE_LIKE), F.lit(0))).alias("written"))
    at = F.coalesce(*[F.try_to_timestamp("written", F.lit(f)) for _, f in DATE_FORMS]).cast("date")
    return found.groupBy("doc_id", "written", at.cast("string").alias("day"), F.date_add(at, F.col("days")).cast("string").alias("moved")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH m AS (SELECT doc_id, instr(text, 'filter') - 1 AS p, text FROM documents WHERE contains(text, 'filter')) SELECT doc_id, p AS "at", substr(text, greatest(p - 20, 0) + 1, p + 6 + 20 - greatest(p - 20, 0)) AS around FROM m""")
def F05_F06_snippets(spark, d):
    at = F.instr("text", F.lit("filter")) - 1
    return table(spark, d, "documents", "doc_id", "text").where(F.contains("text", F.lit("filter"))).select("doc_id", at.cast("long").alias("at"), T.snippet(F.col("text"), at, at + 6, 20).alias("around"))


@query(r"""WITH p AS (SELECT doc_id, text, project AS needle, string_split(text, project) AS parts FROM documents WHERE text IS NOT NULL AND project <> ''),
o AS (SELECT doc_id, text, needle, unnest(list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(needle)))::BIGINT AS s FROM p)
SELECT doc_id, needle, s AS "start", s + length(needle) AS "end" FROM o WHERE NOT regexp_matches(substr(text, s::INT, CASE WHEN s > 0 THEN 1 ELSE 0 END), '\w') AND NOT regexp_matches(substr(text, (s + length(needle) + 1)::INT, 1), '\w')""")
def F05_occurrences(spark, d):
    """Every place where a document names its project as a word of its own."""
    rows = table(spark, d, "documents", "doc_id", "text", "project").select("doc_id", F.col("project").alias("needle"), F.explode(T.occurrences(F.col("text"), F.col("project"))).alias("at"))
    return rows.select("doc_id", "needle", "at.start", "at.end")


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))::DOUBLE[]), 5) AS cosine FROM embeddings")
def M05_cosine(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    first = F.broadcast(e.agg(F.min_by("embedding", "vec_id").alias("q")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return e.join(first, F.lit(True)).select("vec_id", F.round(dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q")), 5).alias("cosine"))


@query(r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9](?:[ -]?[0-9]){12,18}')) AS v FROM pii), k AS (SELECT doc_id, regexp_replace(v, '[ -]', '', 'g') AS v FROM c), x AS (SELECT v, list_reverse(regexp_extract_all(v, '.')) AS ds FROM k)
SELECT v AS digits, list_sum(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i % 2 = 1 THEN ds[i]::INT WHEN ds[i]::INT * 2 > 9 THEN ds[i]::INT * 2 - 9 ELSE ds[i]::INT * 2 END)) % 10 = 0 AS valid, count(*) AS n FROM x GROUP BY ALL""")
def M03_luhn(spark, d):
    v = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9](?:[ -]?[0-9]){12,18}"), F.lit(0)))
    rows = table(spark, d, "pii", "text").select(v.alias("v")).select(F.regexp_replace("v", "[ -]", "").alias("digits"))
    return rows.groupBy("digits", F.expr("luhn_check(digits)").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V} SELECT doc_id, run, md5(coalesce(verdict, '') || '|' || array_to_string(evidence, ',') || '|' || coalesce(rationale, '')) AS prompt FROM v")
def F17_templates(spark, d):
    return latest(spark, d).select("doc_id", "run", F.md5(F.concat(F.coalesce("verdict", F.lit("")), F.lit("|"), F.array_join("evidence", ","), F.lit("|"), F.coalesce("rationale", F.lit("")))).alias("prompt"))


@query("SELECT gold_source_project IS NULL AS no_project, split, count(*) AS n, strftime(min(collected_ts), '%Y-%m-%d %H:%M:%S') AS first, count(*) FILTER (loaded_ts > collected_ts + INTERVAL 7 DAY) AS late FROM codereview GROUP BY ALL")
def S17_pruned_scan(spark, d):
    c = table(spark, d, "codereview", "gold_source_project", "split", "collected_ts", "loaded_ts")
    return c.groupBy(F.col("gold_source_project").isNull().alias("no_project"), "split").agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("collected_ts"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.count_if(F.col("loaded_ts") > F.col("collected_ts") + F.expr("INTERVAL 7 DAY")).alias("late"))


@query(f"WITH {J} SELECT unique_id, run, 'sure' AS stage, verdict FROM j WHERE confidence >= 0.8 UNION ALL SELECT unique_id, run, 'second', CASE WHEN verdict = 'uncertain' THEN 'secure' ELSE verdict END FROM j WHERE confidence >= 0.8 IS NOT TRUE")
def Q01_staged(spark, d):
    rows = judged(spark, d).select("unique_id", "run", "verdict", "confidence")

    def route(df):
        sure, rest = routed(df, "confidence", 0.8)
        return sure.withColumn("stage", F.lit("sure")), rest

    second = lambda df: df.withColumn("stage", F.lit("second")).withColumn("verdict", F.when(F.col("verdict") == "uncertain", "secure").otherwise(F.col("verdict")))
    return Pipeline(lambda: rows, route=route, decide=second, calibrate=lambda df: df.select("unique_id", "run", "stage", "verdict")).run()


@query()
def R05_R06_R09_leaks(spark, d):
    """Values found again after each span became its label."""
    p = table(spark, d, "pii", "doc_id", "text")
    s = detectors.detected(p, "doc_id", "text").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "label", F.col("value").alias("text")))).alias("spans"))
    r = p.join(s, "doc_id").withColumn("new", spans.replaced(F.col("text"), F.col("spans")))
    again = detectors.detected(r, "doc_id", "new").select("doc_id", T.squash(F.col("value")).alias("v"))
    known = r.select("doc_id", F.explode("spans").alias("x")).select("doc_id", T.squash(F.col("x.text")).alias("v")).distinct()
    return again.join(known, ["doc_id", "v"], "left_semi").agg(F.count(F.lit(1)).alias("leaks"), F.count_distinct("doc_id").alias("docs"))


@query()
def G06_boosted(spark, d):
    g = table(spark, d, "guard", "text", "label", "split").withColumn("label", F.col("label").cast("int"))
    predict = selection.boosted(g.where("split = 'train'"), "text", "label")
    got = predict(g.where("split = 'test' AND label IS NOT NULL"), ["label"])
    return metrics.per_class(got.select(F.col("label").cast("double").alias("y"), F.col("prediction").alias("p")), "y", "p")


@query()
def G11_held_out_project(spark, d):
    """The project with the most rows, under whatever spelling, by a model that saw none of them."""
    rows = gold(spark, d, "code", "gold_source_project").where("y IS NOT NULL")
    path = F.regexp_replace(F.lower(F.regexp_replace("gold_source_project", r"\s+", "")), r"(\.git)?/*$", "")
    rows = rows.withColumn("group", F.nullif(F.regexp_replace(F.regexp_extract(path, r"([^/\\:]*)$", 1), r"[-_.]+", ""), F.lit("")))
    named = rows.where(F.col("group").isNotNull() & ~F.col("group").isin("unknown", "none", "null", "n/a", "na", "nan", "?", "tbd"))
    largest = named.groupBy("group").count().orderBy(F.desc("count"), "group").first()
    return models.held_out_group(rows, "code", "y", "group", largest["group"] if largest else "", code=True)


@query()
def G12_G13_code_folds(spark, d):
    """Candidates by their predictions for each of five stratified folds by a model of the others, with their thresholds."""
    rows = gold(spark, d, "code").where("y IS NOT NULL")
    return selection.selected(rows, "unique_id", "code", "y")
