"""Variance inflation factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import numbers
from plumbline.operators.associations import pearson
from plumbline.settings import DEFAULTS


def vif(df: DataFrame, cols: list[str], threshold: float | None = None) -> DataFrame:
    """(column_name, vif) over complete rows, only those above `threshold` if given.

    The cluster computes the columns x columns correlation matrix; the factor
    of a column is 1 / (1 - R^2) of that column on the others.
    """
    spark = df.sparkSession
    schema = "column_name string, vif double"
    complete = numbers(df, cols).dropna()
    rho = pearson(complete, cols) if len(cols) > 1 else {}
    varied = [c for c in cols if any(v is not None for p, v in rho.items() if c in p)]
    if len(varied) < 2:
        return spark.createDataFrame([], schema)
    matrix = np.array([[1.0 if a == b else rho.get((a, b), rho.get((b, a))) or 0.0 for b in varied] for a in varied])
    rows = []
    for i, name in enumerate(varied):
        others = np.delete(matrix[i], i)
        r2 = float(others @ np.linalg.pinv(np.delete(np.delete(matrix, i, 0), i, 1), hermitian=True) @ others)
        rows.append((name, 1 / (1 - r2) if 1 - r2 > 1e-12 else float("inf")))
    result = spark.createDataFrame(rows, schema)
    return result if threshold is None else result.where(F.col("vif") > threshold)


def multicollinearity(df: DataFrame, cols: list[str], threshold: float = DEFAULTS.vif) -> DataFrame:
    return vif(df, cols, threshold)
