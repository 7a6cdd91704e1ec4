"""Standard and modified z-scores, and outlier counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, numbers
from plumbline.operators.ordering import quantile_values
from plumbline.session import InputError
from plumbline.settings import DEFAULTS

# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_FACTOR = 0.6745
METHODS = {"z-score": "Z-score", "mz-score": "Modified Z-score"}


def score_rules(df: DataFrame, cols: list[str], method: str) -> dict[str, Column | None]:
    """Score expression per column; None where the spread is zero or there are no values."""
    if method not in METHODS:
        raise InputError(f"unknown outlier method '{method}'")
    wide = numbers(df, cols)
    if method == "z-score":
        row = wide.agg(*[e for i, c in enumerate(cols) for e in (
            F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]).first()
        centre = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        spread = {c: row[f"s{i}"] for i, c in enumerate(cols)}
        factor = 1.0
    else:
        centre = {c: v[0] for c, v in quantile_values(wide, cols, [0.5]).items()}
        away = wide.select(*[F.abs(col(c) - F.lit(centre[c]).cast("double")).alias(c) for c in cols])
        spread = {c: v[0] for c, v in quantile_values(away, cols, [0.5]).items()}
        factor = MAD_FACTOR
    return {c: (factor * (col(c) - centre[c]) / spread[c]) if spread[c] else None for c in cols}


def z_scores(df: DataFrame, cols: list[str], keys: list[str], method: str = "z-score") -> DataFrame:
    """The keys and one `<column>_score` per column, NULL where undefined."""
    rules = score_rules(df, cols, method)
    none = F.lit(None).cast("double")
    return numbers(df, cols, keys).select(
        *[col(k) for k in keys], *[(none if rules[c] is None else rules[c]).alias(f"{c}_score") for c in cols])


def outliers(df: DataFrame, cols: list[str], method: str = DEFAULTS.outlier_method,
             threshold: float = DEFAULTS.outlier_score) -> DataFrame:
    """(column_name, outlier_count, outlier_pct, method) of columns that have values."""
    rules = score_rules(df, cols, method)
    entries = []
    for c in cols:
        beyond = F.lit(0).cast("bigint") if rules[c] is None else F.count_if(F.abs(rules[c]) > threshold)
        entries.append(F.struct(F.lit(c).alias("column_name"), beyond.alias("outlier_count"), F.count(col(c)).alias("n")))
    return (numbers(df, cols).agg(F.array(*entries).alias("e")).select(F.inline("e")).where("n > 0")
            .select("column_name", "outlier_count", (F.col("outlier_count") / F.col("n")).alias("outlier_pct"),
                    F.lit(METHODS[method]).alias("method")))
