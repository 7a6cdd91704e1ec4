"""What deserves attention, as rows; and the small tables of a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.associations import CAT_CAT, CAT_NUM, NUM_NUM, strong_associations
from plumbline.settings import DEFAULTS, Settings

SCHEMA = "module string, level string, rule string, column_name string, metric double, threshold double, message string"


def finding(spark: SparkSession, module: str, level: str, rule: str, message: str, column: str | None = None) -> DataFrame:
    """A finding that is known on the driver, such as a skipped step."""
    return spark.createDataFrame([(module, level, rule, column, None, None, message)], SCHEMA)


def no_target_for_hue(spark: SparkSession, target: str | None = None) -> DataFrame:
    return finding(spark, "charts", "INFO", "no_target_for_hue", "There is no target to colour the charts by; clusters are used.")


def target_missing_for_hue(spark: SparkSession, target: str | None) -> DataFrame:
    return finding(spark, "charts", "WARNING", "target_missing_for_hue", f"The table has no column '{target}', the target; the charts are coloured by clusters.")


def _rows(source: DataFrame, module: str, rule: str, when: Column, column: Column, metric: Column, threshold, message: Column,
          level: str = "WARNING") -> DataFrame:
    return source.where(when).select(
        F.lit(module).alias("module"), F.lit(level).alias("level"), F.lit(rule).alias("rule"), column.cast("string").alias("column_name"),
        metric.cast("double").alias("metric"), (threshold if isinstance(threshold, Column) else F.lit(threshold)).cast("double").alias("threshold"),
        message.alias("message"))


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def dataset_findings(stats: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    none = F.lit(None)
    d, size, wide = F.col("duplicates_pct"), F.col("size_mb"), F.col("column_pct")
    rules = [
        ("duplicate_rows", d, settings.duplicate_pct, F.concat(_percent(d), F.lit(" of the rows repeat an earlier row and weigh double in every statistic."))),
        ("large_dataset", size, settings.dataset_mb, F.format_string("The data takes %.1f MB.", size)),
        ("high_dimensionality", wide, settings.columns_per_row, F.format_string("There are %d columns for only %d rows.", "column_count", "original_row_count")),
    ]
    return reduce(DataFrame.unionByName, [_rows(stats, "profile", name, m > limit, none, m, limit, text) for name, m, limit, text in rules])


def column_findings(profile: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    name, kind = F.col("column_name"), F.col("inferred_type")
    said = lambda *parts: F.concat(F.lit("Column '"), name, F.lit("' "), *parts)
    missing, unique, skew, share = F.col("missing_pct"), F.col("unique_pct"), F.col("skewness"), F.col("size_share")
    rules = [
        ("missing_values", missing > settings.missing_pct, missing, settings.missing_pct, said(F.lit("lacks "), _percent(missing), F.lit(" of its values."))),
        ("high_cardinality", kind.isin("categorical", "text") & (unique > settings.high_cardinality_pct), unique, settings.high_cardinality_pct,
         said(F.lit("is nearly unique: "), _percent(unique), F.lit(" distinct values."))),
        ("constant_column", F.col("unique_count") == 1, F.col("unique_count"), 1.0, said(F.lit("holds a single value and tells nothing apart."))),
        ("skewed", (kind == "numerical") & (F.abs(skew) > settings.skewness), skew, settings.skewness, said(F.format_string("is strongly skewed (%.3f).", skew))),
        ("column_size", share > settings.column_size_share, share, settings.column_size_share, said(F.lit("takes up "), _percent(share), F.lit(" of the data's size."))),
    ]
    return reduce(DataFrame.unionByName, [_rows(profile, "profile", rule, when, name, m, limit, text) for rule, when, m, limit, text in rules])


def target_findings(candidates: DataFrame) -> DataFrame:
    """Candidates without a task that ranked ahead of the identified one."""
    best = candidates.where("is_identified").agg(F.min("rank")).scalar()
    name = F.col("column_name")
    return _rows(candidates.where(F.col("rank") < best), "target", "candidate_without_task", F.col("ml_task").isNull(), name, F.col("confidence_score"), None,
                 F.concat(F.lit("Column '"), name, F.lit("' was passed over as a target: no task fits it.")))


def outlier_findings(outliers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    name, share = F.col("column_name"), F.col("outlier_pct")
    return _rows(outliers, "statistics", "outliers", share > settings.outlier_pct, name, share, settings.outlier_pct,
                 F.concat(F.lit("Column '"), name, F.lit("' has "), _percent(share), F.lit(" outliers.")))


def vif_findings(vif: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    name = F.col("column_name")
    return _rows(vif, "statistics", "multicollinearity", F.col("vif") > settings.vif, name, F.col("vif"), settings.vif,
                 F.concat(F.lit("Column '"), name, F.format_string("' follows from the other numbers (variance inflation %.2f).", F.col("vif"))))


def association_findings(associations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    strong = strong_associations(associations, settings)
    rule = (F.when(F.col("kind") == CAT_NUM, "strong_cat_num").when(F.col("kind") == CAT_CAT, "strong_cat_cat").otherwise("strong_num_num"))
    text = F.concat(F.lit("Columns '"), F.col("col_a"), F.lit("' and '"), F.col("col_b"),
                    F.format_string("' are strongly associated (%.2f, p=%.3g).", F.col("value"), F.col("p_value")))
    return strong.select(
        F.lit("statistics").alias("module"), F.lit("WARNING").alias("level"), rule.alias("rule"), F.col("col_a").alias("column_name"),
        F.col("value").alias("metric"), F.col("threshold").cast("double").alias("threshold"), text.alias("message"))


def balance_findings(balance: DataFrame, target: str, settings: Settings = DEFAULTS) -> DataFrame:
    ratio = F.col("max_min_ratio")
    one = balance.agg(F.max("max_min_ratio").alias("max_min_ratio"), F.max_by("class", "class_count").alias("most"), F.min_by("class", "class_count").alias("fewest"))
    text = F.format_string("Target '%s': class '%s' is %.1f times as frequent as class '%s'.", F.lit(target), "most", ratio, "fewest")
    return _rows(one, "statistics", "class_imbalance", ratio > settings.class_ratio, F.lit(target), ratio, settings.class_ratio, text)


def leakage_findings(leaks: DataFrame, target: str) -> DataFrame:
    name = F.col("column_name")
    rule = F.when(F.col("kind") == CAT_NUM, "leakage_eta").when(F.col("kind") == NUM_NUM, "leakage_rho").otherwise("leakage_v")
    text = F.concat(F.lit("Column '"), name, F.format_string("' all but equals the target '%s' (%.2f, p=%.3g).", F.lit(target), F.col("value"), F.col("p_value")))
    return leaks.select(F.lit("statistics").alias("module"), F.lit("WARNING").alias("level"), rule.alias("rule"), "column_name",
                        F.col("value").alias("metric"), F.col("threshold").cast("double").alias("threshold"), text.alias("message"))


def reduction_findings(features: DataFrame, least: int = 3) -> DataFrame:
    """No numbers at all, constants left out, or too few columns to reduce.

    `features` is `select_features`: one row per numerical column.
    """
    one = features.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("is_constant")).alias("usable"),
                       F.array_join(F.array_sort(F.collect_list(F.when(F.col("is_constant"), F.col("column_name")))), ", ").alias("constants"))
    none, usable = F.lit(None), F.col("usable")
    return reduce(DataFrame.unionByName, [
        _rows(one, "reduction", "no_numeric_features", F.col("all") == 0, none, F.col("all"), None, F.lit("There is no numerical column besides the target."), "INFO"),
        _rows(one, "reduction", "zero_variance_removed", F.col("all") > usable, none, F.col("all") - usable, None,
              F.concat(F.lit("Left out as constant: "), F.col("constants")), "INFO"),
        _rows(one, "reduction", "too_few_features", (F.col("all") > 0) & (usable < least), none, usable, float(least),
              F.format_string("Only %d numerical columns vary, too few to reduce.", usable), "INFO")])


def merge_findings(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], SCHEMA))


def alerts(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("level").isin("WARNING", "ERROR"))


def column_insights(findings: DataFrame, profile: DataFrame) -> DataFrame:
    """(column_name, level, rule, message): findings whose message names the column as a whole word.

    The names come to the driver, one per column, so every finding is matched
    in place and nothing is joined.
    """
    names = [r["column_name"] for r in profile.select("column_name").collect()]
    word = lambda n: F.regexp_like(F.col("message"), F.concat(F.lit(r"\b\Q"), n, F.lit(r"\E\b")))
    named = F.explode(F.filter(F.array(*[F.lit(n) for n in names]), word)).alias("column_name")
    return findings.select(named, "level", "rule", "message")


def health_metrics(stats: DataFrame) -> DataFrame:
    """(row_count, original_row_count, column_count, duplicate_percent, size_mb), rounded for display."""
    return stats.select(F.col("analyzed_row_count").alias("row_count"), "original_row_count", "column_count",
                        F.round(F.col("duplicates_pct") * 100, 2).alias("duplicate_percent"), F.round("size_mb", 2).alias("size_mb"))


def analysis_context(sections: dict[str, DataFrame], dataset: str) -> DataFrame:
    """(dataset, context): the report tables as one JSON document.

    Meant for the tables with one row per column or pair, never per data row.
    """
    parts = []
    for name, df in sections.items():
        rows = df.agg(F.sort_array(F.collect_list(F.to_json(F.struct(*df.columns)))).alias("rows"))
        body = F.concat(F.lit(f'"{name}":['), F.array_join("rows", ","), F.lit("]"))
        parts.append(rows.select(F.lit(name).alias("name"), body.alias("body")))
    every = reduce(DataFrame.unionByName, parts)
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("name", "body"))), lambda x: x["body"])
    return every.agg(F.concat(F.lit("{"), F.array_join(bodies, ","), F.lit("}")).alias("context")).select(F.lit(dataset).alias("dataset"), "context")
