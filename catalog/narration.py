"""Registered queries: findings, report tables, messages and answers."""

from pyspark.sql import functions as F

from catalog.profiling import GAPPY, GAPPY_SQL, _profile_sql, gappy
from catalog.shared import rounded, sql_round as r, table, union_all
from catalog.statistics import ORACLES as STATS, wide_associations
from plumbline.operators import findings as N
from plumbline.operators import associations as A
from plumbline.operators import outliers, profile, reduce
from plumbline.operators import responses as R


def _plain(df):
    return rounded(df.select("module", "level", "rule", "column_name", "metric", "threshold"))


def _column_rules(profile_sql):
    rule = lambda name, when, metric, limit: (f"SELECT 'profile' AS module, 'WARNING' AS level, '{name}' AS rule, column_name, CAST({metric} AS DOUBLE) AS metric, "
                                              f"CAST({limit} AS DOUBLE) AS threshold FROM p WHERE {when}")
    return f"""(WITH p AS ({profile_sql}) """ + union_all([
        rule("missing_values", "missing_pct > 0.2", "missing_pct", 0.2),
        rule("high_cardinality", "inferred_type IN ('categorical', 'text') AND unique_pct > 0.9", "unique_pct", 0.9),
        rule("constant_column", "unique_count = 1", "unique_count", 1.0),
        rule("skewed", "inferred_type = 'numerical' AND abs(skewness) > 1", "skewness", 1.0),
        rule("column_size", "size_share > 0.2", "size_share", 0.2)]) + ")"


PROFILE_FINDINGS = f"""SELECT * FROM (SELECT 'profile' AS module, 'WARNING' AS level, 'duplicate_rows' AS rule, CAST(NULL AS VARCHAR) AS column_name,
 {r('1 - count(DISTINCT (lang, source)) / count(*)')} AS metric, CAST(0.1 AS DOUBLE) AS threshold FROM documents) WHERE metric > 0.1
UNION ALL SELECT * FROM {_column_rules(_profile_sql('documents'))}
UNION ALL SELECT * FROM {_column_rules(_profile_sql('lineitem', GAPPY_SQL, GAPPY))}"""


def gappy_findings(spark, d):
    docs = table(spark, d, "documents")
    return N.merge_findings(spark, [N.dataset_findings(profile.dataset_stats(docs.select("lang", "source"))),
                                    N.column_findings(profile.column_profile(gappy(spark, d))),
                                    N.column_findings(profile.column_profile(docs))])


def statistics_findings(spark, d):
    e = table(spark, d, "events")
    associations = wide_associations(spark, d)
    return N.merge_findings(spark, [
        N.outlier_findings(outliers.outliers(e, ["value", "user_id"])),
        N.association_findings(associations),
        N.leakage_findings(A.leakage(associations, "event_type", False), "event_type"),
        N.balance_findings(A.class_balance(e.withColumn("large", F.col("value") > 150), "large"), "large")])


STATISTICS_FINDINGS = f"""
SELECT 'statistics' AS module, 'WARNING' AS level, 'outliers' AS rule, column_name, outlier_pct AS metric, CAST(0.05 AS DOUBLE) AS threshold
 FROM ({STATS['outliers_events']}) WHERE outlier_pct > 0.05
UNION ALL SELECT 'statistics', 'WARNING', CASE kind WHEN 'categorical_numerical' THEN 'strong_cat_num' WHEN 'categorical_categorical' THEN 'strong_cat_cat'
 ELSE 'strong_num_num' END, col_a, value, threshold FROM ({STATS['strong_associations']})
UNION ALL SELECT 'statistics', 'WARNING', CASE kind WHEN 'categorical_numerical' THEN 'leakage_eta' WHEN 'numerical_numerical' THEN 'leakage_rho' ELSE 'leakage_v' END,
 column_name, value, threshold FROM ({STATS['leakage_class_target']})
UNION ALL SELECT 'statistics', 'WARNING', 'class_imbalance', 'large', {r('max(n) / min(n)')}, 6.0 FROM (SELECT value > 150, count(*) AS n FROM events GROUP BY 1)
 HAVING max(n) / min(n) > 6"""


def reduction_findings(spark, d):
    numbers = table(spark, d, "orders").select("o_custkey", F.lit(None).cast("double").alias("nothing"))
    return N.reduction_findings(reduce.select_features(profile.light_profile(numbers)))


# --- conversations: turns 1, 4, 7 ... given to the user, so that one role speaks several times in a row
def uneven(spark, d):
    return table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role")))


MERGED = """WITH s AS (SELECT * FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 1 THEN 'user' ELSE role END AS role FROM conversations) WHERE role IN ('user', 'assistant')),
c AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS starts FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
SELECT conv_id, CAST(run - 1 AS BIGINT) AS position, any_value(role) AS role, min(turn) AS first_turn, count(*) AS turns, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content
FROM i GROUP BY conv_id, run"""


# --- answers, put together from the documents: fenced, wrapped in prose, cut short, incomplete
def answers(spark, d):
    docs = table(spark, d, "documents")
    advice = F.format_string('{"category": "%s", "description": "%s", "priority": %d}', "lang", "source", (F.col("doc_id") % 3 + 1).cast("int"))
    ideas = F.when(F.col("doc_id") % 4 == 0, F.lit("null")).otherwise(F.concat(F.lit("["), advice, F.lit("]")))
    body = F.concat(F.lit('{"executive_summary": "'), F.col("source"), F.lit('", "dataset_overview": '),
                    F.when(F.col("doc_id") % 7 == 0, F.lit("null")).otherwise(F.format_string('"%s %d"', "lang", "n_chars")),
                    F.lit(', "recommendations": {"preprocessing_steps": ['), advice, F.lit(", "), advice,
                    F.lit('], "feature_engineering_ideas": '), ideas, F.lit("}}"))
    kind = F.col("doc_id") % 6
    raw = (F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
           .when(kind == 2, F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
           .when(kind == 3, F.expr("substring(b, 1, length(b) - 9)"))
           .when(kind == 4, F.concat(F.lit("```\nno object in here\n```"))).otherwise(body))
    return docs.withColumn("b", body).select("doc_id", raw.alias("raw"))


ANSWERS = """(SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN '```json' || chr(10) || b || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || b || ' Done.'
 WHEN 3 THEN left(b, length(b) - 9) WHEN 4 THEN '```' || chr(10) || 'no object in here' || chr(10) || '```' ELSE b END AS raw FROM (
SELECT doc_id, '{"executive_summary": "' || source || '", "dataset_overview": ' || CASE WHEN doc_id % 7 = 0 THEN 'null' ELSE '"' || lang || ' ' || n_chars || '"' END ||
 ', "recommendations": {"preprocessing_steps": [' || a || ', ' || a || '], "feature_engineering_ideas": ' || CASE WHEN doc_id % 4 = 0 THEN 'null' ELSE '[' || a || ']' END || '}}' AS b
FROM (SELECT *, '{"category": "' || lang || '", "description": "' || source || '", "priority": ' || (doc_id % 3 + 1) || '}' AS a FROM documents)))"""

EXTRACTED = f"""(SELECT doc_id, raw, CASE WHEN strpos(raw, '{{') > 0 AND length(raw) - strpos(reverse(raw), '}}') + 1 > strpos(raw, '{{') AND strpos(raw, '}}') > 0
 THEN substring(raw, strpos(raw, '{{'), length(raw) - strpos(reverse(raw), '}}') + 2 - strpos(raw, '{{')) ELSE trim(trim(raw, '`'), chr(10)) END AS json FROM {ANSWERS})"""
VALID = f"(SELECT *, json_valid(json) AND starts_with(json, '{{') AS is_valid FROM {EXTRACTED})"


def parsed(spark, d):
    return R.parse_responses(answers(spark, d), "raw")


def contexts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("context"), F.lit("supervised").alias("task"),
                                               F.when(F.col("doc_id") % 2 == 0, "fast").otherwise("full").alias("mode"))


def _literal(text):
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


QUERIES = {
    "findings_profile": lambda spark, d: _plain(gappy_findings(spark, d)),
    "findings_statistics": lambda spark, d: _plain(statistics_findings(spark, d)),
    "findings_reduction": lambda spark, d: _plain(reduction_findings(spark, d)),
    "alerts": lambda spark, d: _plain(N.alerts(N.merge_findings(spark, [gappy_findings(spark, d), reduction_findings(spark, d)]))),
    "column_insights": lambda spark, d: N.column_insights(gappy_findings(spark, d), profile.column_profile(gappy(spark, d))).select("column_name", "level", "rule"),
    "health_metrics": lambda spark, d: N.health_metrics(profile.dataset_stats(table(spark, d, "documents").drop("doc_id"))),
    "analysis_context": lambda spark, d: N.analysis_context({"profile": profile.column_profile(table(spark, d, "events")),
                                                             "stats": profile.dataset_stats(table(spark, d, "events"))}, "events"),
    "prompt_messages": lambda spark, d: rounded(R.prompt_messages(contexts(spark, d), ["doc_id"])),
    "merge_turns": lambda spark, d: R.merge_turns(uneven(spark, d)),
    "extract_json": lambda spark, d: answers(spark, d).select("doc_id", R.extract_json(F.col("raw")).alias("json")),
    "parse_responses": lambda spark, d: parsed(spark, d).select("doc_id", "is_valid", F.when(F.col("is_valid"), F.col("answer.dataset_overview")).alias("overview")),
    "normalise_response": lambda spark, d: R.normalise_response(parsed(spark, d)).select(
        "doc_id", "executive_summary", "dataset_overview", "key_findings_and_patterns",
        *[F.size(f"recommendations.{f}").cast("bigint").alias(f) for f in R.ADVICE_FIELDS]),
    "recommendations": lambda spark, d: rounded(R.recommendations(R.normalise_response(parsed(spark, d)), ["doc_id"])),
    "retry_queue": lambda spark, d: rounded(R.retry_queue(parsed(spark, d), "raw", ["doc_id"])),
}

ORACLES = {
    "findings_profile": PROFILE_FINDINGS,
    "findings_statistics": STATISTICS_FINDINGS,
    "findings_reduction": """SELECT 'reduction' AS module, 'INFO' AS level, 'too_few_features' AS rule, CAST(NULL AS VARCHAR) AS column_name,
 CAST(1 AS DOUBLE) AS metric, CAST(3 AS DOUBLE) AS threshold FROM orders HAVING count(DISTINCT o_custkey) > 20""",
    "alerts": PROFILE_FINDINGS,
    "column_insights": f"""SELECT column_name, level, rule FROM ({PROFILE_FINDINGS}) WHERE column_name IN ({', '.join(f"'{c}'" for c in GAPPY)})""",
    "health_metrics": """SELECT count(*) AS row_count, count(*) AS original_row_count, CAST(4 AS BIGINT) AS column_count,
 round((1 - count(DISTINCT (text, lang, source, n_chars)) / count(*)) * 100, 2) AS duplicate_percent,
 round(sum(octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) + 8) / 1048576, 2) AS size_mb FROM documents""",
    "prompt_messages": f"""SELECT doc_id, CAST(0 AS BIGINT) AS position, 'system' AS role, {_literal(R.INSTRUCTIONS)} AS content, true AS cache FROM documents
UNION ALL SELECT doc_id, 1, 'user', 'The analysis task is supervised.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN {_literal(R.SAMPLE_NOTE)} ELSE '' END || 'Results as JSON:' || chr(10) || text, false FROM documents""",
    "merge_turns": MERGED,
    "extract_json": f"SELECT doc_id, json FROM {EXTRACTED}",
    "parse_responses": f"SELECT doc_id, is_valid, CASE WHEN is_valid THEN json_extract_string(json, '$.dataset_overview') END AS overview FROM {VALID}",
    "normalise_response": f"""SELECT doc_id, json_extract_string(json, '$.executive_summary') AS executive_summary, coalesce(json_extract_string(json, '$.dataset_overview'), '') AS dataset_overview,
 '' AS key_findings_and_patterns, CAST(2 AS BIGINT) AS preprocessing_steps, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS BIGINT) AS feature_engineering_ideas,
 CAST(0 AS BIGINT) AS modeling_suggestions, CAST(0 AS BIGINT) AS pitfall_warnings FROM {VALID} WHERE is_valid""",
    "recommendations": f"""SELECT doc_id, list, lang AS category, source AS description, doc_id % 3 + 1 AS priority FROM {VALID} JOIN documents USING (doc_id),
 (VALUES ('preprocessing_steps'), ('preprocessing_steps'), ('feature_engineering_ideas')) l(list) WHERE is_valid AND (list <> 'feature_engineering_ideas' OR doc_id % 4 <> 0)""",
    "retry_queue": f"""SELECT doc_id, CAST(0 AS BIGINT) AS position, 'system' AS role, {_literal(R.REPAIR)} AS content, false AS cache FROM {VALID} WHERE NOT is_valid
UNION ALL SELECT doc_id, 1, 'user', 'Broken JSON:' || chr(10) || chr(10) || raw, false FROM {VALID} WHERE NOT is_valid""",
}
