"""Which column looks like a prediction target, from the column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import InputError
from plumbline.settings import DEFAULTS, Settings

# A name containing one of these is held against a candidate.
KEY_WORDS = ["id", "key", "name", "code"]
NOT_A_TARGET = ["id", "text", "datetime", "unsupported"]


def ml_task(settings: Settings = DEFAULTS) -> Column:
    """classification, regression or NULL, over `column_profile` columns."""
    kind = F.col("inferred_type")
    return (F.when(kind.isin("categorical", "boolean"), "classification")
            .when((kind == "numerical") & (F.col("unique_count") <= settings.target_class_limit), "classification")
            .when(kind == "numerical", "regression"))


def score_targets(profile: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(column_name, ordinal, ml_task, confidence_score) of every candidate."""
    kind, distinct = F.col("inferred_type"), F.col("unique_count")
    skew = F.abs("skewness")
    shape = (F.when(skew > settings.skewness, -0.15).when(skew < 0.5, 0.1).otherwise(0.0)
             + F.when(distinct < settings.target_class_limit, -0.2).when(F.col("unique_pct") >= 0.8, 0.1).otherwise(0.0))
    by_type = (F.when(kind == "boolean", 0.2)
               .when((kind == "categorical") & (distinct > 0.8 * settings.target_class_limit), -0.15)
               .when((kind == "categorical") & (distinct == 2), 0.2)
               .when(kind == "numerical", shape).otherwise(0.0))
    named_like_key = F.lower("column_name").rlike("|".join(KEY_WORDS))
    score = 1.0 - F.coalesce("missing_pct", F.lit(0.0)) - F.when(named_like_key, 0.4).otherwise(0.0) + by_type
    return (profile.where(~kind.isin(NOT_A_TARGET))
            .select("column_name", "ordinal", ml_task(settings).alias("ml_task"), F.round(score, 2).alias("confidence_score")))


def pick_target(scores: DataFrame) -> DataFrame:
    """Candidates with their rank; the best one that has a task is identified.

    One row per column of the analysed table, so the global window is tiny.
    """
    best_first = Window.orderBy(F.desc("confidence_score"), "ordinal")
    has_task_first = Window.orderBy(F.col("ml_task").isNull().cast("int"), F.desc("confidence_score"), "ordinal")
    return scores.select(
        "column_name", "ml_task", "confidence_score",
        F.row_number().over(best_first).alias("rank"),
        (F.col("ml_task").isNotNull() & (F.row_number().over(has_task_first) == 1)).alias("is_identified"),
        F.lit("auto").alias("detection_method"))


def validate_target(profile: DataFrame, target: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The caller's own target as the one candidate, or InputError with the reason."""
    found = profile.where(F.col("column_name") == target).select("inferred_type").first()
    if found is None:
        raise InputError(f"there is no column '{target}' to use as the target")
    if found["inferred_type"] in NOT_A_TARGET:
        raise InputError(f"column '{target}' is of type {found['inferred_type']}, which cannot be a target")
    return profile.where(F.col("column_name") == target).select(
        "column_name", ml_task(settings).alias("ml_task"), F.lit(1.0).alias("confidence_score"), F.lit(1).alias("rank"),
        F.lit(True).alias("is_identified"), F.lit("user_specified").alias("detection_method"))


def identified_target(candidates: DataFrame) -> str:
    row = candidates.where("is_identified").select("column_name").first()
    if row is None:
        raise InputError("no column qualifies as a target")
    return row["column_name"]
