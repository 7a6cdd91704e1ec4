"""Registered queries: feature preparation, components, clusters, rankings, chart data."""

import math

from pyspark.sql import functions as F

from catalog.profiling import GAPPY_SQL, _stats_sql, gappy
from catalog.shared import rounded, sql_round as r, table, union_all
from catalog.statistics import _squares_sql
from plumbline.operators import cluster, features, plotdata, profile, reduce

WIDTH = 64
EMBED = [f"e{i}" for i in range(WIDTH)]


def embedded(spark, d):
    return reduce.expand_array(table(spark, d, "embeddings"), "embedding", WIDTH, ["vec_id", "label"])


def gappy_keyed(spark, d):
    """Parts with missing sizes and prices, keyed."""
    return table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(10)).alias("size"),
                                          F.when(F.col("p_size") > 5, F.col("p_retailprice")).alias("price"), "p_type", "p_brand")


GAPPY_PART = "(SELECT p_partkey, nullif(p_size, 10) AS size, CASE WHEN p_size > 5 THEN p_retailprice END AS price, p_type, p_brand FROM part)"


def grouped_part(spark, d):
    """Parts in four groups far apart, by two bits of their size."""
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 * 100).alias("x"),
                                          (F.floor(F.col("p_size") / 2) % 2 * 100 + F.col("p_retailprice") / 10_000).alias("y"))


def labelled(spark, d):
    """Line items with missing numbers and categories, labelled by return flag."""
    return table(spark, d, "lineitem").select(
        F.nullif("l_returnflag", F.lit("Z")).alias("hue"), F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("price"),
        "l_quantity", F.nullif("l_linenumber", F.lit(3)).alias("line"), F.nullif("l_linestatus", F.lit("O")).alias("status"),
        F.lit(7.0).alias("seven"))


LABELLED = """(SELECT l_returnflag AS hue, CASE WHEN l_quantity > 10 THEN l_extendedprice END AS price, l_quantity,
 nullif(l_linenumber, 3) AS line, nullif(l_linestatus, 'O') AS status FROM lineitem)"""


def _hist_sql(source, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name, b.bin, lo + b.bin * width AS low, lo + (b.bin + 1) * width AS high, count(v) AS count FROM (
 SELECT *, (hi - lo) / bins AS width FROM (SELECT *, CAST(greatest(1, ceil((hi - lo) / least(greatest(fd, sq), st))) AS BIGINT) AS bins FROM (
 SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, (max({c}) - min({c})) / (log2(count({c})) + 1) AS st, (max({c}) - min({c})) / sqrt(count({c})) / 2 AS sq,
  2 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / power(count({c}), 1.0 / 3) AS fd FROM {source}))) s,
 LATERAL (SELECT unnest(range(s.bins)) AS bin) b LEFT JOIN (SELECT CAST({c} AS DOUBLE) AS v FROM {source} WHERE {c} IS NOT NULL) d
 ON v >= lo + b.bin * width AND (v < lo + (b.bin + 1) * width OR b.bin = bins - 1) GROUP BY ALL""")
    return f"SELECT column_name, bin, {r('low')} AS low, {r('high')} AS high, count FROM ({union_all(parts)})"


def _kde_sql(parts, points, cut, name):
    """parts: (label, from-clause, value expression)."""
    out = []
    for label, source, v in parts:
        out.append(f"""SELECT '{label}' AS {name}, p AS point, lo + p * step AS x, sum(exp(-0.5 * power((lo + p * step - v) / h, 2))) / (any_value(n) * any_value(h) * {math.sqrt(2 * math.pi)!r}) AS density
 FROM (SELECT *, (hi - lo) / {points - 1} AS step FROM (SELECT lo0 - {cut} * h AS lo, hi0 + {cut} * h AS hi, n, h FROM (
 SELECT min({v}) AS lo0, max({v}) AS hi0, count({v}) AS n, stddev_samp({v}) * power(count({v}), -0.2) AS h FROM {source}))),
 (SELECT unnest(range({points})) AS p), (SELECT CAST({v} AS DOUBLE) AS v FROM {source} WHERE {v} IS NOT NULL) GROUP BY ALL""")
    return f"SELECT {name}, point, {r('x')} AS x, {r('density', 10)} AS density FROM ({union_all(out)})"


def _rounded_curve(df):
    return df.select(*[F.round(c, 10 if c == "density" else 6).alias(c) if c in ("x", "density") else
                       (F.col(c).cast("bigint").alias(c) if c == "point" else F.col(c)) for c in df.columns])


def _chi2_feature_sql():
    parts = []
    for c in ("line", "status"):
        parts.append(f"""SELECT '{c}' AS column_name, hue, sum(code) AS observed, count(*) AS rows FROM (
 SELECT hue, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT hue, coalesce({c}, (SELECT {c} FROM {LABELLED} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS v
 FROM {LABELLED} WHERE hue IS NOT NULL)) GROUP BY hue""")
    return f"""WITH o AS ({union_all(parts)}),
e AS (SELECT *, rows / sum(rows) OVER (PARTITION BY column_name) * sum(observed) OVER (PARTITION BY column_name) AS expected FROM o)
SELECT column_name, sum(power(observed - expected, 2) / expected) AS score FROM e GROUP BY column_name HAVING sum(observed) > 0"""


_F_SQL = _squares_sql("(SELECT hue, coalesce(price, (SELECT median(price) FROM " + LABELLED + ")) AS price, l_quantity FROM " + LABELLED + ")",
                      ["hue"], ["price", "l_quantity"]) + " SELECT col_b AS column_name, (ssb / (g - 1)) / (ssw / (n - g)) AS score FROM s"

_VIOLIN_SOURCE = "(SELECT source, CAST(n_chars AS DOUBLE) AS n_chars FROM documents)"

def _far(spark, d):
    """Prices with a few values far away."""
    first = F.expr("l_orderkey = 1 and l_linenumber = 1")
    return table(spark, d, "lineitem").select(F.when(first, 1e9).otherwise(F.col("l_extendedprice").cast("double")).alias("price"))


QUERIES = {
    "select_features": lambda spark, d: rounded(reduce.select_features(profile.light_profile(
        table(spark, d, "lineitem").withColumn("always", F.lit(1.5))), "l_quantity").drop("ordinal")),
    "impute_median": lambda spark, d: rounded(reduce.impute(gappy_keyed(spark, d), ["size", "price"], "median", ["p_partkey"])),
    "impute_mean": lambda spark, d: rounded(reduce.impute(gappy_keyed(spark, d), ["size", "price"], "mean", ["p_partkey"])),
    "standardise": lambda spark, d: rounded(reduce.standardise(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_brand"])),
    "pca_variance": lambda spark, d: reduce.pca_variance(reduce.prepared(embedded(spark, d), EMBED, ["vec_id"]), EMBED),
    "pca_variance_two": lambda spark, d: rounded(reduce.pca_variance(
        reduce.prepared(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"])),
    "pca_embedding": lambda spark, d: reduce.pca_embedding(reduce.prepared(embedded(spark, d), EMBED, ["vec_id"]), EMBED, ["vec_id"]),
    "pca_embedding_two": lambda spark, d: rounded(reduce.pca_embedding(
        reduce.prepared(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"]), ["o_totalprice", "o_custkey"], ["o_orderkey"])
        .select("o_orderkey", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2")), 4),
    "pca_signed_scores": lambda spark, d: rounded(reduce.pca_embedding(table(spark, d, "orders").select(
        "o_orderkey", F.array(F.col("o_totalprice") / 1000, F.col("o_custkey") / 3).alias("v")), "v", ["o_orderkey"]), 5),
    "pca_vector_trace": lambda spark, d: rounded(reduce.pca_variance(table(spark, d, "embeddings"), "embedding", WIDTH)
        .agg(F.count("*").alias("components"), F.sum("ratio").alias("explained"), F.max("ratio").alias("unused")).drop("unused"), 6),
    "kmeans_separated_groups": lambda spark, d: cluster.kmeans_clusters(grouped_part(spark, d), ["x", "y"], ["p_partkey"]),
    "kmeans_clusters": lambda spark, d: cluster.kmeans_clusters(embedded(spark, d), EMBED, ["vec_id"]),
    "kmeans_cluster_sizes": lambda spark, d: cluster.kmeans_clusters(table(spark, d, "part"), ["p_size", "p_retailprice"], ["p_partkey"])
        .groupBy("cluster").agg(F.count("*").alias("n")),
    "hue_column_clusters": lambda spark, d: cluster.hue_column(grouped_part(spark, d), ["p_partkey"], None, ["x", "y"]),
    "hue_column": lambda spark, d: cluster.hue_column(table(spark, d, "part"), ["p_partkey"], "p_type", []),
    "f_classif": lambda spark, d: rounded(features.f_classif(labelled(spark, d), "hue", ["price", "l_quantity", "seven"]).drop("p_value"), 4),
    "chi2_feature": lambda spark, d: rounded(features.chi2_feature(labelled(spark, d), "hue", ["line", "status"]).drop("p_value"), 4),
    "impute_mode": lambda spark, d: features.impute_mode(features.category_cells(gappy(spark, d), ["l_returnflag", "l_discount"]))
        .select("column_name", "value", "n"),
    "ordinal_encode": lambda spark, d: features.ordinal_encode(features.category_cells(gappy(spark, d), ["l_returnflag", "l_linenumber", "l_discount"])),
    "top_associated_features": lambda spark, d: features.top_associated_features(
        table(spark, d, "events").withColumn("band", F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "middle").otherwise("low")),
        "band", ["value", "user_id"], ["event_type"], 2),
    "histogram": lambda spark, d: rounded(plotdata.histogram(gappy(spark, d), ["l_quantity", "l_extendedprice"])),
    "histogram_far_values": lambda spark, d: rounded(plotdata.histogram(_far(spark, d), ["price"])),
    "histogram_events": lambda spark, d: rounded(plotdata.histogram(table(spark, d, "events"), ["value"])),
    "kde_curve": lambda spark, d: _rounded_curve(plotdata.kde_curve(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])),
    "kde_curve_events": lambda spark, d: _rounded_curve(plotdata.kde_curve(table(spark, d, "events"), ["value"])),
    "count_bars": lambda spark, d: rounded(plotdata.count_bars(table(spark, d, "part"), ["p_brand", "p_type", "p_size"])),
    "embedding_points": lambda spark, d: plotdata.embedding_points(
        reduce.standardise(table(spark, d, "part").withColumn("key", F.col("p_partkey")), ["p_size", "p_retailprice"], ["key"]),
        cluster.hue_column(table(spark, d, "part").withColumn("key", F.col("p_partkey")), ["key"], "p_type", []), ["key"])
        .select("key", F.round("p_size", 6).alias("x"), F.round("p_retailprice", 6).alias("y"), "hue"),
    "regression_line": lambda spark, d: rounded(plotdata.regression_line(gappy(spark, d), "l_extendedprice", "l_quantity")),
    "violin_summary": lambda spark, d: rounded(plotdata.violin_summary(table(spark, d, "documents"), "source", "n_chars")),
    "violin_density": lambda spark, d: _rounded_curve(plotdata.violin_density(table(spark, d, "events"), "event_type", "value")),
    "grouped_counts": lambda spark, d: rounded(plotdata.grouped_counts(table(spark, d, "part"), "p_size", "p_type")),
    "plot_plan": lambda spark, d: plotdata.plot_plan(profile.light_profile(table(spark, d, "events")), "value", True),
}

_STD = lambda c: f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"

ORACLES = {
    # the longer axis of two centred columns, each axis pointing to its larger loading
    "pca_signed_scores": f"""WITH m AS (SELECT o_orderkey, o_totalprice / 1000 AS x, o_custkey / 3.0 AS y FROM orders),
 s AS (SELECT avg(x) AS ax, avg(y) AS ay, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS t FROM m),
 a AS (SELECT *, CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS g, CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN sign(-sin(t)) ELSE sign(cos(t)) END AS h FROM s)
SELECT o_orderkey, {r('g * ((x - ax) * cos(t) + (y - ay) * sin(t))', 5)} AS pc1, {r('h * ((y - ay) * cos(t) - (x - ax) * sin(t))', 5)} AS pc2 FROM m, a""",
    "pca_vector_trace": "SELECT 64 AS components, CAST(1.0 AS DOUBLE) AS explained",
    "kmeans_separated_groups": "SELECT p_partkey, CAST(p_size % 2 * 2 + (p_size // 2) % 2 AS INTEGER) AS cluster FROM part",
    "select_features": f"""SELECT column_name, u + CAST(k < n AS INTEGER) <= 1 AS is_constant FROM ({_stats_sql('lineitem')})
 WHERE inferred_type = 'numerical' AND column_name <> 'l_quantity'""",
    "impute_median": f"SELECT p_partkey, {r(f'coalesce(size, (SELECT median(size) FROM {GAPPY_PART}))')} AS size, {r(f'coalesce(price, (SELECT median(price) FROM {GAPPY_PART}))')} AS price FROM {GAPPY_PART}",
    "impute_mean": f"SELECT p_partkey, {r(f'coalesce(size, (SELECT avg(size) FROM {GAPPY_PART}))')} AS size, {r(f'coalesce(price, (SELECT avg(price) FROM {GAPPY_PART}))')} AS price FROM {GAPPY_PART}",
    "standardise": f"SELECT p_brand, {r(_STD('p_size'))} AS p_size, {r(_STD('p_retailprice'))} AS p_retailprice FROM part",
    "pca_variance_two": f"""WITH k AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS c FROM lineitem)
SELECT CAST(1 AS BIGINT) AS component, {r('(1 + c) / 2')} AS ratio FROM k UNION ALL SELECT 2, {r('(1 - c) / 2')} FROM k""",
    "pca_embedding_two": f"""WITH z AS (SELECT o_orderkey, {_STD('o_totalprice')} AS a, {_STD('o_custkey')} AS b, corr(o_totalprice, o_custkey) OVER () AS c FROM orders)
SELECT o_orderkey, {r('abs(a + CASE WHEN c < 0 THEN -b ELSE b END) / sqrt(2)', 4)} AS pc1, {r('abs(a - CASE WHEN c < 0 THEN -b ELSE b END) / sqrt(2)', 4)} AS pc2 FROM z""",
    "hue_column_clusters": "SELECT p_partkey, CAST(p_size % 2 * 2 + (p_size // 2) % 2 AS INTEGER) AS hue FROM part",
    "hue_column": "SELECT p_partkey, p_type AS hue FROM part",
    "f_classif": f"SELECT column_name, {r('score', 4)} AS score FROM ({_F_SQL})",
    "chi2_feature": f"SELECT column_name, {r('score', 4)} AS score FROM ({_chi2_feature_sql()})",
    "impute_mode": union_all([f"""SELECT '{c}' AS column_name, CAST(v AS VARCHAR) AS value, count(*) AS n FROM (SELECT coalesce({c},
 (SELECT {c} FROM {GAPPY_SQL} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS v FROM {GAPPY_SQL}) GROUP BY v"""
                              for c in ("l_returnflag", "l_discount")]),
    "ordinal_encode": union_all([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY {c}) - 1 AS code FROM "
                                 f"(SELECT DISTINCT {c} FROM {GAPPY_SQL} WHERE {c} IS NOT NULL)" for c in ("l_returnflag", "l_linenumber", "l_discount")]),
    "histogram": _hist_sql(GAPPY_SQL, ["l_quantity", "l_extendedprice"]),
    "histogram_far_values": _hist_sql("(SELECT CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 1e9 ELSE CAST(l_extendedprice AS DOUBLE) END AS price FROM lineitem)", ["price"]),
    "histogram_events": _hist_sql("events", ["value"]),
    "kde_curve": _kde_sql([(c, "lineitem", c) for c in ("l_quantity", "l_extendedprice")], 200, 0, "column_name"),
    "kde_curve_events": _kde_sql([("value", "events", "value")], 200, 0, "column_name"),
    "count_bars": f"""SELECT column_name, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place, value, n AS count FROM (
{union_all([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY {c}" for c in ("p_brand", "p_type", "p_size")])}) QUALIFY place <= 10""",
    "embedding_points": f"SELECT p_partkey AS key, {r(_STD('p_size'))} AS x, {r(_STD('p_retailprice'))} AS y, p_type AS hue FROM part",
    "regression_line": f"""SELECT {r('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
 {r('regr_r2(l_extendedprice, l_quantity)')} AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM {GAPPY_SQL}""",
    "violin_summary": f"""WITH q AS (SELECT source, count(*) AS n, quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.5) AS b, quantile_cont(n_chars, 0.75) AS c
 FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 20)
SELECT source AS category, any_value(n) AS count, {r('any_value(a)')} AS q25, {r('any_value(b)')} AS median, {r('any_value(c)')} AS q75,
 {r('min(n_chars) FILTER (n_chars >= a - 1.5 * (c - a))')} AS whisker_low, {r('max(n_chars) FILTER (n_chars <= c + 1.5 * (c - a))')} AS whisker_high
FROM q JOIN documents USING (source) GROUP BY source""",
    "violin_density": _kde_sql([(t, f"(SELECT value FROM events WHERE event_type = '{t}')", "value") for t in ("click", "error", "purchase", "signup", "view")], 100, 2, "category"),
    "grouped_counts": """WITH t AS (SELECT p_size AS v, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, CAST(p_size AS VARCHAR)) AS place FROM part GROUP BY p_size QUALIFY place <= 15)
SELECT CAST(p_size AS VARCHAR) AS value, p_type AS hue, count(*) AS count, any_value(total) AS value_total, any_value(place) AS place FROM part JOIN t ON v = p_size GROUP BY p_size, p_type""",
    "plot_plan": f"""SELECT column_name, CASE WHEN inferred_type = 'numerical' THEN 'histogram' ELSE 'count_bars' END AS univariate,
 CASE WHEN column_name = 'value' THEN NULL WHEN inferred_type = 'numerical' THEN 'regression_line' ELSE 'violin' END AS bivariate
 FROM ({_stats_sql('events')}) WHERE inferred_type IN ('numerical', 'categorical', 'boolean')""",
}
