"""Ranking features by their association with classes or clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_number, col, families, known
from plumbline.functions.tails import chi2_sf
from plumbline.operators.associations import anova_f
from plumbline.operators.ordering import running_counts
from plumbline.operators.reduce import impute
from plumbline.settings import DEFAULTS, Settings

LEAST_VARIANCE = 1e-6
NO_VALUE = "missing"


def f_classif(df: DataFrame, hue: str, cols: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """(column_name, score, p_value): one-way F of each median-imputed column over the classes."""
    labelled = df.where(col(hue).isNotNull())
    filled = impute(labelled, cols, "median", [hue])
    spread = filled.agg(*[F.var_pop(col(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first()
    varied = [c for i, c in enumerate(cols) if (spread[f"v{i}"] or 0.0) > LEAST_VARIANCE]
    if not varied:
        return df.sparkSession.createDataFrame([], "column_name string, score double, p_value double")
    return anova_f(filled, [hue], varied, least_rows=1).select(F.col("col_b").alias("column_name"), F.col("f").alias("score"), "p_value")


def category_cells(df: DataFrame, cols: list[str], hue: str | None = None) -> DataFrame:
    """(column_name, value, sort_number, hue, n), missing values kept as NULL.

    `sort_number` orders numeric categories as numbers.
    """
    kinds = families(df)
    label = known(hue, kinds[hue]).cast("string") if hue else F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("column_name"), known(c, kinds[c]).cast("string").alias("value"),
                      (F.lit(None).cast("double") if kinds[c] == "text" else as_number(c, kinds[c])).alias("sort_number"))
             for c in cols]
    return (df.select(label.alias("hue"), F.inline(F.array(*cells)))
            .groupBy("column_name", "value", "sort_number", "hue").agg(F.count("*").alias("n")))


def impute_mode(cells: DataFrame) -> DataFrame:
    """`category_cells` with missing values given to the most frequent one.

    Ties go to the smallest value; a column without any value becomes `missing`.
    """
    totals = cells.where("value is not null").groupBy("column_name", "value", "sort_number").agg(F.sum("n").alias("total"))
    first = Window.partitionBy("column_name").orderBy(F.desc("total"), F.col("sort_number"), F.col("value"))
    mode = (totals.withColumn("place", F.row_number().over(first)).where("place = 1")
            .select("column_name", F.col("value").alias("mode"), F.col("sort_number").alias("mode_number")))
    hole = F.col("value").isNull()
    return (cells.join(mode, "column_name", "left")
            .withColumn("sort_number", F.when(hole, F.col("mode_number")).otherwise(F.col("sort_number")))
            .withColumn("value", F.coalesce("value", "mode", F.lit(NO_VALUE)))
            .groupBy("column_name", "value", "sort_number", "hue").agg(F.sum("n").alias("n")))


def ordinal_encode(cells: DataFrame) -> DataFrame:
    """(column_name, value, code): sorted categories numbered from 0."""
    values = cells.where("value is not null").select("column_name", "value", "sort_number").distinct().withColumn("n", F.lit(1))
    return running_counts(values, ["column_name"], ["sort_number", "value"]).select("column_name", "value", F.col("before").cast("bigint").alias("code"))


def chi2_feature(df: DataFrame, hue: str, cols: list[str]) -> DataFrame:
    """(column_name, score, p_value): summed codes per class against the class shares."""
    cells = impute_mode(category_cells(df.where(col(hue).isNotNull()), cols, hue))
    coded = cells.join(ordinal_encode(cells), ["column_name", "value"])
    per_class = coded.groupBy("column_name", "hue").agg(F.sum(F.col("code") * F.col("n")).alias("observed"), F.sum("n").alias("rows"))
    overall = per_class.groupBy("column_name").agg(F.sum("observed").alias("total"), F.sum("rows").alias("all_rows"), F.count("*").alias("classes"))
    expected = F.col("rows") / F.col("all_rows") * F.col("total")
    off = F.col("observed") - expected
    scored = (per_class.join(overall, "column_name").where("total > 0")     # a single category has code 0 throughout
              .groupBy("column_name").agg(F.sum(off * off / expected).alias("score"), (F.first("classes") - 1).alias("dof")))
    return scored.select("column_name", "score", chi2_sf(F.col("score"), F.col("dof").cast("double")).alias("p_value"))


def top_associated_features(df: DataFrame, hue: str, nums: list[str], cats: list[str], n: int = -1,
                            settings: Settings = DEFAULTS) -> DataFrame:
    """(column_name, score, p_value) of the significant features, best score first."""
    parts = ([f_classif(df, hue, nums, settings)] if nums else []) + ([chi2_feature(df, hue, cats)] if cats else [])
    if not parts:
        return df.sparkSession.createDataFrame([], "column_name string, score double, p_value double")
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = both.where(F.col("p_value") < settings.p_value).orderBy(F.desc("score"), "column_name")
    return best if n < 0 else best.limit(n)
