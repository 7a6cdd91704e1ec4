"""Registered queries: profiles, missing and distinct values, types, targets."""

from pyspark.sql import functions as F

from catalog.shared import rounded, sql_round as r, table, union_all
from plumbline.operators import profile as P
from plumbline.operators import targets as G
from plumbline.operators.frequencies import duplicate_rows, value_frequencies
from plumbline.operators.ordering import quantiles

# Columns of the profiled tables with the family their values belong to.
TABLES = {
    "lineitem": dict(l_orderkey="whole", l_partkey="whole", l_suppkey="whole", l_linenumber="whole", l_quantity="fraction",
                     l_extendedprice="fraction", l_discount="fraction", l_tax="fraction", l_returnflag="text",
                     l_linestatus="text", l_shipdate="date"),
    "orders": dict(o_orderkey="whole", o_custkey="whole", o_orderstatus="text", o_totalprice="fraction", o_orderdate="date",
                   o_orderpriority="text"),
    "customer": dict(c_custkey="whole", c_name="text", c_nationkey="whole", c_acctbal="fraction", c_mktsegment="text"),
    "part": dict(p_partkey="whole", p_name="text", p_brand="text", p_type="text", p_size="whole", p_retailprice="fraction"),
    "events": dict(event_id="whole", ts="date", user_id="whole", event_type="text", value="fraction", props="text"),
    "documents": dict(doc_id="whole", text="text", lang="text", source="text", n_chars="whole"),
}
# Fixed values, as the library's own layouts, in the checking engine's dialect.
SQL_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"
SQL_DATES = [r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$",
             r"^(1[6-9]|2[01])\d{2}$", r"^(1[6-9]|2[01])\d{6}$", r"^\d{1,2}:\d{2}$",
             r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$"]


def _type_sql(family: str) -> str:
    count = "CASE WHEN u = 2 THEN 'boolean' WHEN u <= 20 THEN 'categorical' ELSE 'numerical' END"
    if family == "date":
        return "'datetime'"
    text = f"WHEN dates = k THEN 'datetime' WHEN numbers = k THEN {count} WHEN u <= 20 THEN 'categorical' ELSE 'text'"
    return (f"CASE WHEN n > 0 AND k = 0 THEN 'categorical' WHEN u / n > 0.99 THEN 'id' "
            + (text if family == "text" else f"ELSE {count}") + " END")


def _stats_sql(name: str, source: str | None = None, columns: dict | None = None) -> str:
    """One row per column with its counts, type and numeric summary."""
    parts = []
    for at, (c, family) in enumerate((columns or TABLES[name]).items()):
        number = family in ("whole", "fraction")
        dates = f"count(*) FILTER ({' OR '.join(f'regexp_matches({c}, $re${d}$re$)' for d in SQL_DATES)})" if family == "text" else "NULL"
        numbers = f"count(*) FILTER (regexp_matches(trim({c}), $re${SQL_NUMBER}$re$))" if family == "text" else "NULL"
        num = (lambda e: e if number else "CAST(NULL AS DOUBLE)")
        size = f"coalesce(sum(octet_length(encode({c}))), 0)" if family == "text" else f"count(*) * {4 if c in NARROW else 8}"
        span = f"CAST(min({c}) AS TIMESTAMP) AS lo_ts, CAST(max({c}) AS TIMESTAMP) AS hi_ts" if family == "date" else \
            "CAST(NULL AS TIMESTAMP) AS lo_ts, CAST(NULL AS TIMESTAMP) AS hi_ts"
        skew = f"CASE WHEN count({c}) >= 3 THEN coalesce(skewness({c}), 0.0) END"
        parts.append(
            f"SELECT column_name, ordinal, {_type_sql(family)} AS inferred_type, n, k, u, bytes, a, s, lo, q1, q2, q3, hi, sk, lo_ts, hi_ts FROM ("
            f"SELECT '{c}' AS column_name, {at} AS ordinal, count(*) AS n, count({c}) AS k, count(DISTINCT {c}) AS u, CAST({size} AS BIGINT) AS bytes, "
            f"{dates} AS dates, {numbers} AS numbers, {num(f'avg({c})')} AS a, {num(f'stddev_samp({c})')} AS s, {num(f'CAST(min({c}) AS DOUBLE)')} AS lo, "
            f"{num(f'quantile_cont({c}, 0.25)')} AS q1, {num(f'quantile_cont({c}, 0.5)')} AS q2, {num(f'quantile_cont({c}, 0.75)')} AS q3, "
            f"{num(f'CAST(max({c}) AS DOUBLE)')} AS hi, {num(skew)} AS sk, {span} FROM {source or name})")
    return union_all(parts)


NARROW = {"l_linenumber", "c_nationkey", "p_size"}


def _top_sql(name: str, columns: dict, top: int = 5, source: str | None = None) -> str:
    parts = []
    for c, family in columns.items():
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT '{c}' AS column_name, {v} AS value, count(*) AS n FROM {source or name} WHERE {c} IS NOT NULL GROUP BY {c}")
    return (f"SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS place "
            f"FROM ({union_all(parts)}) QUALIFY place <= {top}")


def _profile_sql(name: str, source: str | None = None, columns: dict | None = None) -> str:
    kinds = columns or TABLES[name]
    dates = [c for c, f in kinds.items() if f == "date"]
    flat = {c: f for c, f in kinds.items() if c not in dates}
    numeric = (lambda c: f"CASE WHEN inferred_type = 'numerical' THEN {r(c)} END")
    return f"""
WITH s AS ({_stats_sql(name, source, columns)}),
t AS ({_top_sql(name, flat, source=source)}),
g AS (SELECT column_name, string_agg(value || '=' || n, ';' ORDER BY place) AS tops,
             max(value) FILTER (place = 1) AS top, max(n) FILTER (place = 1) AS frequency FROM t GROUP BY column_name)
SELECT s.column_name, CAST(ordinal AS BIGINT) AS ordinal, inferred_type, n AS row_count, n - k AS missing_count,
  {r('(n - k) / n')} AS missing_pct, u AS unique_count, {r('u / n')} AS unique_pct,
  {r('bytes / 1048576')} AS size_mb, {r('bytes / (SELECT sum(bytes) FROM s)')} AS size_share,
  {numeric('sk')} AS skewness, CASE WHEN inferred_type IN ('numerical', 'datetime') THEN k END AS count,
  {numeric('a')} AS mean, {numeric('s.s')} AS std, {numeric('lo')} AS min, {numeric('q1')} AS q25, {numeric('q2')} AS median,
  {numeric('q3')} AS q75, {numeric('hi')} AS max,
  CASE WHEN inferred_type = 'categorical' THEN coalesce(top, 'N/A') END AS top,
  CASE WHEN inferred_type = 'categorical' THEN coalesce(frequency, 0) END AS frequency,
  CASE WHEN inferred_type = 'categorical' THEN coalesce(tops, '') END AS top_values,
  lo_ts AS first, hi_ts AS last
FROM s LEFT JOIN g USING (column_name)"""


def _flat_tops(profile):
    joined = F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), ";")
    return rounded(profile.withColumn("top_values", joined)).drop("dtype")


def _profile(name):
    return lambda spark, d: _flat_tops(P.column_profile(table(spark, d, name).select(*TABLES[name])))


# --- the line items with missing cells ------------------------------------------------
GAPPY = dict(l_linenumber="whole", l_quantity="fraction", l_discount="fraction", l_tax="fraction", l_extendedprice="fraction", l_returnflag="text")
GAPPY_SQL = ("(SELECT l_linenumber, l_quantity, nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.0) AS l_tax, "
             "CASE WHEN l_quantity > 10 THEN l_extendedprice END AS l_extendedprice, nullif(l_returnflag, 'A') AS l_returnflag FROM lineitem)")


def gappy(spark, d):
    """Missing cells of both forms: NULL, and NaN from 0/0-like holes."""
    return table(spark, d, "lineitem").select(
        "l_linenumber", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"),
        F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("l_tax"),
        F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).alias("l_extendedprice"),
        F.nullif("l_returnflag", F.lit("A")).alias("l_returnflag"))


def _per_column(columns, make, source):
    return union_all([f"SELECT '{c}' AS column_name, {make(c)} FROM {source}" for c in columns])


def _dates_as_text(spark, d):
    o = table(spark, d, "orders")
    day = F.col("o_orderdate")
    return o.select(F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "yyyyMMdd").alias("compact"),
                    F.date_format(day, "yyyy").alias("year"), F.date_format(day, "M/d/yyyy").alias("slashed"),
                    F.when(F.col("o_custkey") % 2 == 0, F.date_format(day, "MMM d, yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss")).alias("mixed"),
                    F.when(F.col("o_custkey") % 3 == 0, F.lit("unknown")).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("partly"),
                    F.col("o_orderpriority").alias("priority"), F.col("o_custkey").cast("string").alias("digits"),
                    F.round(F.col("o_totalprice"), 0).cast("string").alias("amount"))


DATES_SQL = """(SELECT strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y') AS year,
 strftime(o_orderdate, '%-m/%-d/%Y') AS slashed,
 CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS mixed,
 CASE WHEN o_custkey % 3 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS partly,
 o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS digits, o_orderdate FROM orders)"""


def _probe(spark, d):
    stats = P.column_stats(_dates_as_text(spark, d).drop("amount"))
    return stats.select("column_name", "is_date", "is_number")


def _probe_sql():
    dates = {"iso": 1, "compact": 1, "year": 1, "slashed": 1, "mixed": 1, "partly": 0, "priority": 0, "digits": None}
    parts = []
    for c in dates:
        is_date = " OR ".join(f"regexp_matches({c}, $re${x}$re$)" for x in SQL_DATES)
        valid = f"CASE WHEN length({c}) = 8 AND regexp_matches({c}, '^[0-9]+$') THEN try_strptime({c}, '%Y%m%d') IS NOT NULL ELSE true END"
        parts.append(f"SELECT '{c}' AS column_name, bool_and(({is_date}) AND {valid}) AS is_date, "
                     f"bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) AS is_number FROM {DATES_SQL}")
    return union_all(parts)


QUERIES = {f"column_profile_{t}": _profile(t) for t in TABLES}
ORACLES = {f"column_profile_{t}": _profile_sql(t) for t in TABLES}

QUERIES["column_profile_missing"] = lambda spark, d: _flat_tops(P.column_profile(gappy(spark, d)))
ORACLES["column_profile_missing"] = _profile_sql("lineitem", GAPPY_SQL, GAPPY)

QUERIES["missing_values"] = lambda spark, d: rounded(P.missing_values(gappy(spark, d)))
ORACLES["missing_values"] = _per_column(
    GAPPY, lambda c: f"count(*) - count({c}) AS missing_count, {r(f'(count(*) - count({c})) / count(*)')} AS missing_pct", GAPPY_SQL)

QUERIES["unique_values"] = lambda spark, d: rounded(P.unique_values(gappy(spark, d)))
ORACLES["unique_values"] = _per_column(
    GAPPY, lambda c: f"count(DISTINCT {c}) AS unique_count, {r(f'count(DISTINCT {c}) / count(*)')} AS unique_pct", GAPPY_SQL)

QUERIES["unique_values_approximate"] = lambda spark, d: P.unique_values(table(spark, d, "lineitem"), approximate=True)

QUERIES["value_frequencies"] = lambda spark, d: value_frequencies(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])
ORACLES["value_frequencies"] = union_all([
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY ALL"
    for c in ("o_orderpriority", "o_orderstatus", "o_custkey")])

QUERIES["infer_types"] = lambda spark, d: P.infer_types(_dates_as_text(spark, d)).select("column_name", F.col("ordinal").cast("bigint").alias("ordinal"), "inferred_type")

_TEXT_KINDS = {"iso": "datetime", "compact": "datetime", "year": "datetime", "slashed": "datetime", "mixed": "datetime", "partly": "", "priority": "", "digits": "number"}
ORACLES["infer_types"] = union_all([
    f"SELECT '{c}' AS column_name, CAST({at} AS BIGINT) AS ordinal, CASE WHEN count(DISTINCT {c}) / count(*) > 0.99 THEN 'id' ELSE "
    + ("'datetime'" if kind == "datetime" else f"CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE '{'numerical' if kind else 'text'}' END")
    + f" END AS inferred_type FROM {DATES_SQL}" for at, (c, kind) in enumerate(_TEXT_KINDS.items())] + [
    "SELECT 'amount', 8, CASE WHEN count(DISTINCT round(o_totalprice)) / count(*) > 0.99 THEN 'id' ELSE 'numerical' END FROM orders"])

QUERIES["date_number_probe"] = _probe
ORACLES["date_number_probe"] = _probe_sql()

QUERIES["infer_types_events"] = lambda spark, d: P.infer_types(table(spark, d, "events")).select("column_name", "inferred_type")
ORACLES["infer_types_events"] = f"SELECT column_name, inferred_type FROM ({_stats_sql('events')})"

QUERIES["duplicate_rows"] = lambda spark, d: rounded(duplicate_rows(table(spark, d, "documents").drop("doc_id")))
ORACLES["duplicate_rows"] = f"""
SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {r('sum(n - 1) / sum(n)')} AS duplicates_pct
FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source, n_chars)"""

QUERIES["duplicate_rows_missing"] = lambda spark, d: rounded(duplicate_rows(gappy(spark, d).select("l_discount", "l_tax", "l_returnflag", "l_linenumber")))
ORACLES["duplicate_rows_missing"] = f"""
SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {r('sum(n - 1) / sum(n)')} AS duplicates_pct
FROM (SELECT count(*) AS n FROM {GAPPY_SQL} GROUP BY l_discount, l_tax, l_returnflag, l_linenumber)"""

QUERIES["dataset_stats"] = lambda spark, d: rounded(P.dataset_stats(table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal")))
ORACLES["dataset_stats"] = f"""
SELECT count(*) AS original_row_count, count(*) AS analyzed_row_count, CAST(3 AS BIGINT) AS column_count,
 {r('sum(12 + octet_length(encode(c_mktsegment))) / 1048576')} AS size_mb,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_acctbal FROM customer)) AS duplicate_rows_count,
 {r('3 / count(*)')} AS column_pct,
 {r('1 - (SELECT count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_acctbal FROM customer)) / count(*)')} AS duplicates_pct
FROM customer"""

QUERIES["storage_footprint"] = lambda spark, d: rounded(P.storage_footprint(table(spark, d, "documents")))
ORACLES["storage_footprint"] = f"""
WITH b AS (SELECT CAST(8 * count(*) AS BIGINT) AS doc_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS text,
  CAST(sum(octet_length(encode(lang))) AS BIGINT) AS lang, CAST(sum(octet_length(encode(source))) AS BIGINT) AS source,
  CAST(8 * count(*) AS BIGINT) AS n_chars FROM documents),
u AS (UNPIVOT b ON doc_id, text, lang, source, n_chars INTO NAME column_name VALUE bytes)
SELECT column_name, bytes, {r('bytes / sum(bytes) OVER ()')} AS size_share FROM u"""

_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_partkey"]
QUERIES["numeric_summary"] = lambda spark, d: rounded(P.numeric_summary(table(spark, d, "lineitem"), _NUMS))
ORACLES["numeric_summary"] = _per_column(
    _NUMS, lambda c: f"count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std, {r(f'min({c})')} AS min, "
    + ", ".join(f"{r(f'quantile_cont({c}, {q})')} AS {n}" for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")))
    + f", {r(f'max({c})')} AS max", "lineitem")

QUERIES["quantiles"] = lambda spark, d: rounded(quantiles(gappy(spark, d), ["l_extendedprice", "l_discount"], [0.0, 0.01, 0.1, 0.9, 0.99, 1.0]))
ORACLES["quantiles"] = union_all([
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, {r(f'quantile_cont({c}, {p})')} AS value FROM {GAPPY_SQL}"
    for c in ("l_extendedprice", "l_discount") for p in (0.0, 0.01, 0.1, 0.9, 0.99, 1.0)])

_CATS = {"o_orderpriority": "text", "o_orderstatus": "text"}
QUERIES["category_summary"] = lambda spark, d: P.category_summary(table(spark, d, "orders"), list(_CATS)).withColumn(
    "top_values", F.array_join(F.transform("top_values", lambda x: F.concat_ws("=", x["value"], x["count"].cast("string"))), ";"))
ORACLES["category_summary"] = f"""
SELECT column_name, max(value) FILTER (place = 1) AS top, max(n) FILTER (place = 1) AS frequency,
 string_agg(value || '=' || n, ';' ORDER BY place) AS top_values FROM ({_top_sql('orders', _CATS)}) GROUP BY column_name"""

QUERIES["date_range"] = lambda spark, d: P.date_range(_dates_as_text(spark, d), ["iso", "mixed", "partly"])
ORACLES["date_range"] = union_all([
    f"SELECT '{c}' AS column_name, CAST(min(o_orderdate) AS TIMESTAMP) AS first, CAST(max(o_orderdate) AS TIMESTAMP) AS last, "
    f"count(*) AS count FROM {DATES_SQL} WHERE {'true' if c != 'partly' else chr(112) + 'artly <> ' + chr(39) + 'unknown' + chr(39)}"
    for c in ("iso", "mixed", "partly")])

QUERIES["skewness"] = lambda spark, d: rounded(P.skewness(table(spark, d, "events"), ["value", "user_id"]))
ORACLES["skewness"] = _per_column(["value", "user_id"], lambda c: f"{r(f'skewness({c})')} AS skewness", "events")

QUERIES["constant_columns"] = lambda spark, d: P.constant_columns(table(spark, d, "orders").select(
    "*", F.lit(1).alias("one"), F.when(F.col("o_orderstatus") == "F", "x").alias("x_or_missing"), F.lit(None).cast("string").alias("none")))
ORACLES["constant_columns"] = """SELECT column_name FROM (SELECT count(DISTINCT o_orderkey) AS o_orderkey, count(DISTINCT o_custkey) AS o_custkey,
 count(DISTINCT o_orderstatus) AS o_orderstatus, count(DISTINCT o_totalprice) AS o_totalprice, count(DISTINCT o_orderdate) AS o_orderdate,
 count(DISTINCT o_orderpriority) AS o_orderpriority, CAST(1 AS BIGINT) AS one, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'x' END) AS x_or_missing FROM orders)
 UNPIVOT (u FOR column_name IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, one, x_or_missing)) WHERE u = 1"""

# --- targets ----------------------------------------------------------------------------


def _scores(name):
    return lambda spark, d: rounded(G.pick_target(G.score_targets(P.light_profile(table(spark, d, name).select(*TABLES[name])))), 2)


def _scores_sql(name):
    return f"""
WITH p AS (SELECT * FROM ({_stats_sql(name)}) WHERE inferred_type NOT IN ('id', 'text', 'datetime')),
s AS (SELECT column_name, ordinal,
  CASE WHEN inferred_type IN ('categorical', 'boolean') OR u <= 50 THEN 'classification' ELSE 'regression' END AS ml_task,
  round(CAST(1.0 AS DOUBLE) - (n - k) / n - CASE WHEN regexp_matches(lower(column_name), 'id|key|name|code') THEN 0.4 ELSE 0 END
   + CASE inferred_type WHEN 'boolean' THEN 0.2
       WHEN 'categorical' THEN CASE WHEN u > 40 THEN -0.15 WHEN u = 2 THEN 0.2 ELSE 0 END
       ELSE CASE WHEN abs(sk) > 1 THEN -0.15 WHEN abs(sk) < 0.5 THEN 0.1 ELSE 0 END
          + CASE WHEN u < 50 THEN -0.2 WHEN u / n >= 0.8 THEN 0.1 ELSE 0 END END, 2) AS confidence_score FROM p),
t AS (SELECT *, row_number() OVER (ORDER BY confidence_score DESC, ordinal) AS rank FROM s)
SELECT column_name, ml_task, confidence_score, rank, rank = 1 AS is_identified, 'auto' AS detection_method FROM t"""


for _t in ("lineitem", "orders", "part", "events"):
    QUERIES[f"pick_target_{_t}"] = _scores(_t)
    ORACLES[f"pick_target_{_t}"] = _scores_sql(_t)

QUERIES["ml_task"] = lambda spark, d: P.light_profile(table(spark, d, "part")).select("column_name", G.ml_task().alias("ml_task"))
ORACLES["ml_task"] = f"""SELECT column_name, CASE WHEN inferred_type IN ('categorical', 'boolean') OR (inferred_type = 'numerical' AND u <= 50)
 THEN 'classification' WHEN inferred_type = 'numerical' THEN 'regression' END AS ml_task FROM ({_stats_sql('part')})"""

QUERIES["validate_target"] = lambda spark, d: rounded(G.validate_target(P.light_profile(table(spark, d, "events").drop("props")), "value"))
ORACLES["validate_target"] = """SELECT 'value' AS column_name, CASE WHEN count(DISTINCT value) <= 50 THEN 'classification' ELSE 'regression' END AS ml_task,
 CAST(1.0 AS DOUBLE) AS confidence_score, CAST(1 AS BIGINT) AS rank, true AS is_identified, 'user_specified' AS detection_method FROM events"""
