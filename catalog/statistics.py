"""Registered queries: outliers, pairwise associations, collinearity, balance, leakage."""

from itertools import combinations

from pyspark.sql import functions as F

from catalog.profiling import GAPPY_SQL, _stats_sql, gappy
from catalog.shared import rounded, sql_round as r, table, union_all
from plumbline.functions.tails import chi2_sf, f_sf, t_sf
from plumbline.operators import associations as A
from plumbline.operators import ordering, outliers, profile
from plumbline.operators.collinearity import multicollinearity, vif

NUMS = ["l_quantity", "l_extendedprice", "l_partkey", "l_discount"]
GAPPY_NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


def _scores_sql(method):
    parts = []
    for c in GAPPY_NUMS:
        if method == "z-score":
            score = f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"
        else:
            score = f"0.6745 * ({c} - (SELECT median({c}) FROM g)) / (SELECT mad({c}) FROM g)"
        parts.append(f"SELECT '{c}' AS column_name, {c} AS v, {score} AS z FROM g WHERE {c} IS NOT NULL")
    label = outliers.METHODS[method]
    return f"""WITH g AS (SELECT * FROM {GAPPY_SQL})
SELECT column_name, count(*) FILTER (abs(z) > 3) AS outlier_count, {r('count(*) FILTER (abs(z) > 3) / count(*)')} AS outlier_pct,
 '{label}' AS method FROM ({union_all(parts)}) GROUP BY column_name"""


def _events_outliers(method, threshold):
    return f"""WITH s AS (SELECT {"(value - avg(value) OVER ()) / stddev_pop(value) OVER ()" if method == "z-score" else
"0.6745 * (value - (SELECT median(value) FROM events)) / (SELECT mad(value) FROM events)"} AS z FROM events)
SELECT 'value' AS column_name, count(*) FILTER (abs(z) > {threshold}) AS outlier_count,
 {r(f'count(*) FILTER (abs(z) > {threshold}) / count(*)')} AS outlier_pct, '{outliers.METHODS[method]}' AS method FROM s"""


# --- contingency tables and their tests ---------------------------------------------------
CAT_PAIRS = list(combinations(["l_returnflag", "l_linestatus", "l_linenumber"], 2))
LABEL_PAIR = [("quality", "toxic")]


def _cells_sql(source, pairs):
    return union_all([
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS VARCHAR) AS value_a, CAST({b} AS VARCHAR) AS value_b, count(*) AS n "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for a, b in pairs])


def _chi2_sql(source, pairs):
    """Over the full value x value grid, the continuity correction at one degree of freedom."""
    return f"""
WITH cells AS ({_cells_sql(source, pairs)}),
ra AS (SELECT col_a, col_b, value_a, sum(n) AS rn FROM cells GROUP BY ALL),
cb AS (SELECT col_a, col_b, value_b, sum(n) AS cn FROM cells GROUP BY ALL),
tot AS (SELECT col_a, col_b, sum(n) AS total, count(DISTINCT value_a) AS nr, count(DISTINCT value_b) AS nc FROM cells GROUP BY ALL),
grid AS (SELECT ra.col_a, ra.col_b, coalesce(n, 0) AS o, CAST(rn AS DOUBLE) * cn / total AS e, total, nr, nc
 FROM ra JOIN cb USING (col_a, col_b) JOIN tot USING (col_a, col_b) LEFT JOIN cells USING (col_a, col_b, value_a, value_b)),
x AS (SELECT col_a, col_b, any_value(total) AS n, (any_value(nr) - 1) * (any_value(nc) - 1) AS dof, least(any_value(nr), any_value(nc)) AS smaller_side,
 sum(power(abs(o - e) - CASE WHEN (nr - 1) * (nc - 1) = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2 FROM grid GROUP BY col_a, col_b)"""


def _chi2_select(source, pairs):
    return _chi2_sql(source, pairs) + f" SELECT col_a, col_b, {r('chi2')} AS chi2, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, CAST(smaller_side AS BIGINT) AS smaller_side FROM x"


def _v_select(source, pairs):
    return _chi2_sql(source, pairs) + f" SELECT col_a, col_b, {r('CASE WHEN smaller_side > 1 THEN sqrt(chi2 / (n * (smaller_side - 1))) END')} AS value, CAST(n AS BIGINT) AS n FROM x"


# --- grouped moments ------------------------------------------------------------------------
def _moments_sql(source, cats, nums):
    return union_all([
        f"SELECT '{c}' AS col_a, '{x}' AS col_b, CAST({c} AS VARCHAR) AS category, count({x}) AS n, avg({x}) AS mean, var_pop({x}) AS var_pop "
        f"FROM {source} WHERE {c} IS NOT NULL AND {x} IS NOT NULL GROUP BY {c}" for c in cats for x in nums])


def _squares_sql(source, cats, nums, least=0):
    return f"""
WITH m AS (SELECT * FROM ({_moments_sql(source, cats, nums)}) WHERE n >= {least}),
t AS (SELECT *, sum(n * mean) OVER (PARTITION BY col_a, col_b) / sum(n) OVER (PARTITION BY col_a, col_b) AS grand FROM m),
s AS (SELECT col_a, col_b, CAST(sum(n) AS BIGINT) AS n, count(*) AS g, sum(n * power(mean - grand, 2)) AS ssb, sum(n * var_pop) AS ssw FROM t GROUP BY ALL)"""


EVENT_CATS, EVENT_NUMS = ["event_type"], ["value", "user_id"]
GAP_CATS = ["l_returnflag", "l_linenumber"]


def _rank_sql(source, c):
    return f"(SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS rk FROM {source})"


def _spearman_sql(source, cols):
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(
            f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r('coalesce(corr(ra, rb), 0)')} AS value, count(*) AS n FROM (SELECT "
            f"rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb "
            f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
    return union_all(parts)


PART_NUMS = ["p_partkey", "p_size", "p_retailprice"]
ORDER_CATS = ["o_orderstatus", "o_orderpriority"]


def events_wide(spark, d):
    """Events with derived columns, so that strong associations exist."""
    e = table(spark, d, "events")
    band = F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "middle").otherwise("low")
    return e.select("event_type", "value", "user_id", band.alias("band"), (F.col("value") * 2 + 1).alias("doubled"),
                    F.upper("event_type").alias("kind"))


EVENTS_WIDE_SQL = """(SELECT event_type, value, user_id, CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'middle' ELSE 'low' END AS band,
 value * 2 + 1 AS doubled, upper(event_type) AS kind FROM events)"""
WIDE_CATS, WIDE_NUMS = ["event_type", "band", "kind"], ["value", "user_id", "doubled"]


def wide_associations(spark, d):
    return A.associations(events_wide(spark, d), WIDE_CATS, WIDE_NUMS)


def _eta_sql(source, cats, nums):
    return _squares_sql(source, cats, nums) + (
        " SELECT col_a, col_b, CASE WHEN g >= 2 AND ssb + ssw > 0 THEN sqrt(ssb / (ssb + ssw)) END AS value, n FROM s")


def _wide_sql():
    """kind, pair, raw value of every pair of the derived event columns."""
    eta = f"SELECT 'categorical_numerical' AS kind, col_a, col_b, value, n FROM ({_eta_sql(EVENTS_WIDE_SQL, WIDE_CATS, WIDE_NUMS)})"
    v = (f"SELECT 'categorical_categorical' AS kind, col_a, col_b, CASE WHEN smaller_side > 1 THEN sqrt(chi2 / (n * (smaller_side - 1))) END AS value, "
         f"CAST(n AS BIGINT) AS n FROM ({_chi2_sql(EVENTS_WIDE_SQL, list(combinations(WIDE_CATS, 2)))} SELECT * FROM x)")
    rho = f"SELECT 'numerical_numerical' AS kind, col_a, col_b, value, n FROM ({_spearman_sql(EVENTS_WIDE_SQL, WIDE_NUMS)})"
    return union_all([eta, v, rho])


def _both_ways(kind):
    return f"""
WITH w AS ({_wide_sql()}), k AS (SELECT * FROM w WHERE kind = '{kind}'),
b AS (SELECT col_a AS column_name, col_b AS other, value FROM k UNION ALL SELECT col_b, col_a, value FROM k
 UNION ALL SELECT DISTINCT c, c, 1.0 FROM (SELECT col_a AS c FROM k UNION ALL SELECT col_b FROM k))"""


QUERIES = {
    "z_scores": lambda spark, d: rounded(outliers.z_scores(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"])),
    "modified_z_scores": lambda spark, d: rounded(outliers.z_scores(table(spark, d, "events"), ["value"], ["event_id"], "mz-score")),
    "outliers_modified_z": lambda spark, d: rounded(outliers.outliers(gappy(spark, d), GAPPY_NUMS)),
    "outliers_z": lambda spark, d: rounded(outliers.outliers(gappy(spark, d), GAPPY_NUMS, "z-score")),
    "outliers_events": lambda spark, d: rounded(outliers.outliers(table(spark, d, "events"), ["value"])),
    "outliers_events_z": lambda spark, d: rounded(outliers.outliers(table(spark, d, "events"), ["value"], "z-score", 2.0)),
    "average_rank": lambda spark, d: ordering.average_ranks(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]),
    "spearman": lambda spark, d: rounded(A.spearman(table(spark, d, "lineitem"), NUMS).drop("p_value")),
    "spearman_missing": lambda spark, d: rounded(A.spearman(gappy(spark, d), GAPPY_NUMS).drop("p_value")),
    "spearman_part": lambda spark, d: rounded(A.spearman(table(spark, d, "part"), PART_NUMS).drop("p_value")),
    "spearman_p_values": lambda spark, d: A.spearman(table(spark, d, "part"), PART_NUMS),
    "contingency": lambda spark, d: A.contingency(gappy(spark, d), [("l_returnflag", "l_linenumber"), ("l_returnflag", "l_tax")]),
    "chi2_independence": lambda spark, d: rounded(A.chi2_independence(A.contingency(table(spark, d, "lineitem"), CAT_PAIRS))),
    "chi2_independence_two_by_two": lambda spark, d: rounded(A.chi2_independence(A.contingency(table(spark, d, "labels"), LABEL_PAIR))),
    "cramers_v": lambda spark, d: rounded(A.cramers_v(table(spark, d, "lineitem"), CAT_PAIRS).drop("p_value")),
    "cramers_v_orders": lambda spark, d: rounded(A.cramers_v(table(spark, d, "orders"), [tuple(ORDER_CATS)]).drop("p_value")),
    "cramers_v_p_values": lambda spark, d: A.cramers_v(table(spark, d, "labels"), LABEL_PAIR),
    "grouped_moments": lambda spark, d: rounded(A.grouped_moments(gappy(spark, d), GAP_CATS, GAPPY_NUMS), 4),
    "correlation_ratio": lambda spark, d: rounded(A.correlation_ratio(table(spark, d, "events"), EVENT_CATS, EVENT_NUMS).drop("p_value")),
    "correlation_ratio_missing": lambda spark, d: rounded(A.correlation_ratio(gappy(spark, d), GAP_CATS, GAPPY_NUMS).drop("p_value")),
    "correlation_ratio_documents": lambda spark, d: rounded(A.correlation_ratio(table(spark, d, "documents"), ["lang", "source"], ["n_chars"]).drop("p_value")),
    "anova_f": lambda spark, d: rounded(A.anova_f(gappy(spark, d), GAP_CATS, GAPPY_NUMS).drop("p_value")),
    "anova_p_values": lambda spark, d: A.anova_f(table(spark, d, "documents"), ["lang"], ["n_chars"]),
    "column_pairs": lambda spark, d: A.column_pairs(profile.infer_types(table(spark, d, "lineitem"))),
    "associations": lambda spark, d: rounded(wide_associations(spark, d).drop("p_value")),
    "association_matrix": lambda spark, d: rounded(A.association_matrix(wide_associations(spark, d), A.NUM_NUM)),
    "heatmap_cells": lambda spark, d: A.heatmap_cells(wide_associations(spark, d), A.CAT_NUM),
    "strong_associations": lambda spark, d: rounded(A.strong_associations(wide_associations(spark, d)).drop("p_value", "n")),
    "leakage_class_target": lambda spark, d: rounded(A.leakage(wide_associations(spark, d), "event_type", False).drop("p_value")),
    "leakage_number_target": lambda spark, d: rounded(A.leakage(wide_associations(spark, d), "value", True).drop("p_value")),
    "top_correlated_features": lambda spark, d: rounded(A.top_correlated_features(wide_associations(spark, d), "value", 3)),
    "class_balance": lambda spark, d: rounded(A.class_balance(table(spark, d, "events"), "event_type")),
    "class_balance_labels": lambda spark, d: rounded(A.class_balance(table(spark, d, "labels"), "toxic")),
    "vif": lambda spark, d: rounded(vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])),
    "vif_three": lambda spark, d: rounded(vif(gappy(spark, d), GAPPY_NUMS)),
    "multicollinearity": lambda spark, d: multicollinearity(
        table(spark, d, "lineitem").withColumn("cost", F.col("l_extendedprice") * (1 + F.col("l_tax"))),
        ["l_quantity", "l_extendedprice", "l_partkey", "l_discount", "l_tax", "cost"]).select("column_name"),
    "cramers_v_p_value_two_degrees": lambda spark, d: rounded(A.cramers_v(table(spark, d, "lineitem"), [("l_returnflag", "l_linestatus")])),
    "anova_p_value_three_groups": lambda spark, d: rounded(A.anova_f(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"]).drop("f")),
    "tails_with_closed_forms": lambda spark, d: rounded(
        table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 20000).alias("x"), (5 + F.col("o_custkey") % 200).cast("double").alias("d"))
        .select("o_orderkey", chi2_sf(F.col("x"), F.lit(2.0)).alias("chi2_2"), chi2_sf(F.col("x"), F.lit(6.0)).alias("chi2_6"),
                f_sf(F.col("x"), F.lit(2.0), F.col("d")).alias("f_2"), t_sf(F.col("x"), F.lit(2.0)).alias("t_2")), 9),
    "tail_probabilities": lambda spark, d: (
        table(spark, d, "orders").select((F.col("o_totalprice") / 20000).alias("x"), (1 + F.col("o_custkey") % 9).cast("double").alias("k"), "o_orderkey")
        .select("o_orderkey", chi2_sf("x", "k").alias("chi2"), f_sf(F.col("x"), F.col("k"), F.lit(20.0)).alias("f"), t_sf("x", "k").alias("t"))),
}

_CORR3 = f"""WITH g AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM {GAPPY_SQL}
 WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
k AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM g),
d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM k)"""

ORACLES = {
    "z_scores": f"""SELECT o_orderkey, {r('(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()')} AS o_totalprice_score,
 {r('(o_custkey - avg(o_custkey) OVER ()) / stddev_pop(o_custkey) OVER ()')} AS o_custkey_score FROM orders""",
    "modified_z_scores": f"SELECT event_id, {r('0.6745 * (value - (SELECT median(value) FROM events)) / (SELECT mad(value) FROM events)')} AS value_score FROM events",
    "outliers_modified_z": _scores_sql("mz-score"),
    "outliers_z": _scores_sql("z-score"),
    "outliers_events": _events_outliers("mz-score", 3),
    "outliers_events_z": _events_outliers("z-score", 2),
    "average_rank": union_all([
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value, count(*) AS n, CAST(min(rk) AS DOUBLE) AS avg_rank FROM {_rank_sql('lineitem', c)} GROUP BY {c}"
        for c in ("l_quantity", "l_extendedprice")]),
    "spearman": _spearman_sql("lineitem", NUMS),
    "spearman_missing": _spearman_sql(GAPPY_SQL, GAPPY_NUMS),
    "spearman_part": _spearman_sql("part", PART_NUMS),
    "contingency": _cells_sql(GAPPY_SQL, [("l_returnflag", "l_linenumber"), ("l_returnflag", "l_tax")]),
    "chi2_independence": _chi2_select("lineitem", CAT_PAIRS),
    "chi2_independence_two_by_two": _chi2_select("labels", LABEL_PAIR),
    "cramers_v": _v_select("lineitem", CAT_PAIRS),
    "cramers_v_orders": _v_select("orders", [tuple(ORDER_CATS)]),
    "grouped_moments": f"SELECT col_a, category, col_b, n, {r('mean', 4)} AS mean, {r('var_pop', 4)} AS var_pop FROM ({_moments_sql(GAPPY_SQL, GAP_CATS, GAPPY_NUMS)})",
    "correlation_ratio": f"SELECT col_a, col_b, {r('value')} AS value, n FROM ({_eta_sql('events', EVENT_CATS, EVENT_NUMS)})",
    "correlation_ratio_missing": f"SELECT col_a, col_b, {r('value')} AS value, n FROM ({_eta_sql(GAPPY_SQL, GAP_CATS, GAPPY_NUMS)})",
    "correlation_ratio_documents": f"SELECT col_a, col_b, {r('value')} AS value, n FROM ({_eta_sql('documents', ['lang', 'source'], ['n_chars'])})",
    "anova_f": _squares_sql(GAPPY_SQL, GAP_CATS, GAPPY_NUMS, 2) + f" SELECT col_a, col_b, {r('(ssb / (g - 1)) / (ssw / (n - g))')} AS f, g - 1 AS d1, n - g AS d2 FROM s",
    "column_pairs": f"""WITH t AS (SELECT column_name AS c, ordinal AS o, CASE WHEN inferred_type IN ('categorical', 'boolean') THEN 'c' WHEN inferred_type = 'numerical' THEN 'n' END AS k
 FROM ({_stats_sql('lineitem')}))
SELECT CASE WHEN a.k <> b.k THEN 'categorical_numerical' WHEN a.k = 'c' THEN 'categorical_categorical' ELSE 'numerical_numerical' END AS kind,
 a.c AS col_a, b.c AS col_b FROM t a JOIN t b ON (a.k = b.k AND a.o < b.o) OR (a.k = 'c' AND b.k = 'n')""",
    "associations": f"SELECT kind, col_a, col_b, {r('value')} AS value, n FROM ({_wide_sql()})",
    "association_matrix": _both_ways("numerical_numerical") + f""" SELECT column_name, {r("max(value) FILTER (other = 'doubled')")} AS doubled,
 {r("max(value) FILTER (other = 'user_id')")} AS user_id, {r("max(value) FILTER (other = 'value')")} AS value FROM b GROUP BY column_name""",
    "heatmap_cells": _both_ways("categorical_numerical") + " SELECT column_name, other, round(max(value), 2) AS value FROM b GROUP BY ALL",
    "strong_associations": f"""WITH w AS (SELECT *, CASE kind WHEN 'categorical_numerical' THEN 0.6 WHEN 'categorical_categorical' THEN 0.5 ELSE 0.85 END AS threshold
 FROM ({_wide_sql()})) SELECT kind, col_a, col_b, {r('value')} AS value, CAST(threshold AS DOUBLE) AS threshold FROM w WHERE abs(value) > threshold""",
    "leakage_class_target": f"""SELECT CASE WHEN col_a = 'event_type' THEN col_b ELSE col_a END AS column_name, kind, {r('value')} AS value,
 CAST(CASE kind WHEN 'categorical_numerical' THEN 0.98 ELSE 0.95 END AS DOUBLE) AS threshold FROM ({_wide_sql()})
 WHERE (col_a = 'event_type' OR col_b = 'event_type') AND CASE kind WHEN 'categorical_numerical' THEN value > 0.98 WHEN 'categorical_categorical' THEN value > 0.95 ELSE false END""",
    "leakage_number_target": f"""SELECT CASE WHEN col_a = 'value' THEN col_b ELSE col_a END AS column_name, kind, {r('value')} AS value,
 CAST(0.98 AS DOUBLE) AS threshold FROM ({_wide_sql()})
 WHERE (col_a = 'value' OR col_b = 'value') AND CASE kind WHEN 'categorical_numerical' THEN value > 0.98 WHEN 'numerical_numerical' THEN abs(value) > 0.98 ELSE false END""",
    "top_correlated_features": f"""SELECT CASE WHEN col_a = 'value' THEN col_b ELSE col_a END AS column_name, {r('abs(value)')} AS strength FROM ({_wide_sql()})
 WHERE col_a = 'value' OR col_b = 'value' ORDER BY 2 DESC, 1 LIMIT 3""",
    "cramers_v_p_value_two_degrees": _chi2_sql("lineitem", [("l_returnflag", "l_linestatus")]) + f""" SELECT col_a, col_b,
 {r('sqrt(chi2 / (n * (smaller_side - 1)))')} AS value, {r('exp(-chi2 / 2)')} AS p_value, CAST(n AS BIGINT) AS n FROM x""",
    "anova_p_value_three_groups": _squares_sql("lineitem", ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"], 2) + f"""
 SELECT col_a, col_b, {r('power(1 + 2 * ((ssb / 2) / (ssw / (n - 3))) / (n - 3), -(n - 3) / 2)')} AS p_value, CAST(2 AS BIGINT) AS d1, n - 3 AS d2 FROM s""",
    "tails_with_closed_forms": f"""WITH o AS (SELECT o_orderkey, o_totalprice / 20000 AS x, CAST(5 + o_custkey % 200 AS DOUBLE) AS d FROM orders)
SELECT o_orderkey, {r('exp(-x / 2)', 9)} AS chi2_2, {r('exp(-x / 2) * (1 + x / 2 + x * x / 8)', 9)} AS chi2_6,
 {r('power(1 + 2 * x / d, -d / 2)', 9)} AS f_2, {r('1 - x / sqrt(2 + x * x)', 9)} AS t_2 FROM o""",
    "class_balance": f"""WITH c AS (SELECT event_type AS class, count(*) AS class_count FROM events GROUP BY 1)
SELECT class, class_count, {r('class_count / sum(class_count) OVER ()')} AS class_pct, {r('max(class_count) OVER () / min(class_count) OVER ()')} AS max_min_ratio FROM c""",
    "class_balance_labels": f"""WITH c AS (SELECT CAST(toxic AS VARCHAR) AS class, count(*) AS class_count FROM labels GROUP BY 1)
SELECT class, class_count, {r('class_count / sum(class_count) OVER ()')} AS class_pct, {r('max(class_count) OVER () / min(class_count) OVER ()')} AS max_min_ratio FROM c""",
    "vif": f"""WITH k AS (SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT unnest(['l_quantity', 'l_extendedprice']) AS column_name, {r('1 / (1 - c * c)')} AS vif FROM k""",
    "vif_three": _CORR3 + f""" SELECT 'l_quantity' AS column_name, {r('(1 - bc * bc) / det')} AS vif FROM d
 UNION ALL SELECT 'l_extendedprice', {r('(1 - ac * ac) / det')} FROM d UNION ALL SELECT 'l_discount', {r('(1 - ab * ab) / det')} FROM d""",
}
