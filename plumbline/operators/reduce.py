"""Feature preparation and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col, numbers
from plumbline.operators.ordering import quantile_values
from plumbline.operators.vectors import principal_axes, scores
from plumbline.session import InputError
from plumbline.settings import DEFAULTS, Settings

LEAST_FEATURES = 3


def select_features(profile: DataFrame, target: str | None = None) -> DataFrame:
    """(column_name, ordinal, is_constant) of the numerical columns but the target.

    A column is constant when it has at most one value, a missing cell counting
    as a value.
    """
    values = F.col("unique_count") + (F.col("missing_count") > 0).cast("int")
    wanted = profile.where(F.col("inferred_type") == "numerical")
    if target is not None:
        wanted = wanted.where(F.col("column_name") != target)
    return wanted.select("column_name", "ordinal", (values <= 1).alias("is_constant"))


def feature_names(profile: DataFrame, target: str | None = None) -> list[str]:
    rows = select_features(profile, target).where(~F.col("is_constant")).orderBy("ordinal").select("column_name").collect()
    return [r["column_name"] for r in rows]


def expand_array(df: DataFrame, column: str, width: int, keys: list[str], prefix: str = "e") -> DataFrame:
    """The keys and one column per array element."""
    return df.select(*[col(k) for k in keys], *[F.get(col(column), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(width)])


def impute(df: DataFrame, cols: list[str], how: str = DEFAULTS.impute_with, keys: list[str] = ()) -> DataFrame:
    """Keys and columns as doubles, missing cells replaced by the exact median or mean.

    Only columns that do have missing cells are looked at.
    """
    if how not in ("median", "mean"):
        raise InputError(f"cannot impute with '{how}'")
    wide = numbers(df, cols, keys)
    counts = wide.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    holes = [c for i, c in enumerate(cols) if counts[f"n{i}"] < counts["rows"]]
    if not holes:
        return wide
    if how == "median":
        fill = {c: v[0] for c, v in quantile_values(wide, holes, [0.5]).items()}
    else:
        means = wide.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(holes)]).first()
        fill = {c: means[f"m{i}"] for i, c in enumerate(holes)}
    return wide.withColumns({c: F.coalesce(col(c), F.lit(v)) for c, v in fill.items() if v is not None})


def standardise(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """Keys and columns with mean 0 and population standard deviation 1; constants become 0."""
    wide = numbers(df, cols, keys)
    vectors = VectorAssembler(inputCols=cols, outputCol="_v").transform(wide.select(*[col(c) for c in cols]))
    row = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select("s.*").first()
    n = row["count"]
    mean, spread = list(row["mean"]), [(v * (n - 1) / n) ** 0.5 if n else 0.0 for v in row["variance"]]
    scaled = [((col(c) - float(mean[i])) / float(spread[i]) if spread[i] > 0 else col(c) * 0.0).alias(c) for i, c in enumerate(cols)]
    return wide.select(*[col(k) for k in keys], *scaled)


def prepared(df: DataFrame, cols: list[str], keys: list[str] = (), settings: Settings = DEFAULTS) -> DataFrame:
    return standardise(impute(df, cols, settings.impute_with, keys), cols, keys)


def pca_fit(ready: DataFrame, cols: list[str], components: int = DEFAULTS.pca_components) -> tuple[list[float], np.ndarray]:
    """Explained-variance ratios and loadings (columns x components) of prepared columns.

    The cluster computes the columns x columns covariance; its decomposition is
    a driver-side step of that size. Each component points to its largest loading.
    """
    rows = ready.select(F.lit(1)).limit(components).count()
    k = min(components, rows, len(cols)) if rows > 1 else 0          # one row has no variance
    if k == 0:
        return [], np.zeros((len(cols), 0))
    vectors = VectorAssembler(inputCols=cols, outputCol="v").transform(ready.select(*[col(c) for c in cols])).select("v")
    model = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return [float(x) for x in model.explainedVariance], loadings * np.where(signs == 0, 1, signs)


def pca_variance(ready: DataFrame, cols: list[str] | str, components: int = DEFAULTS.pca_components) -> DataFrame:
    """(component, ratio), component 1 first. `cols`: prepared columns, or the name of one array column."""
    ratios = principal_axes(ready, cols, components)[0] if isinstance(cols, str) else pca_fit(ready, cols, components)[0]
    return ready.sparkSession.createDataFrame(list(enumerate(ratios, 1)), "component int, ratio double")


def pca_embedding(ready: DataFrame, cols: list[str] | str, keys: list[str], names: tuple[str, str] = ("pc1", "pc2")) -> DataFrame:
    """Keys and the first two component scores. `cols`: prepared columns, or the name of one array column."""
    if isinstance(cols, str):
        _, loadings, mean = principal_axes(ready, cols, 2)
        return scores(ready, cols, keys, loadings, mean, list(names[:loadings.shape[1]]))
    _, loadings = pca_fit(ready, cols, 2)
    found = []
    for j, name in enumerate(names[:loadings.shape[1]]):
        terms = [col(c) * float(loadings[i, j]) for i, c in enumerate(cols)]
        found.append(sum(terms[1:], terms[0]).alias(name))
    return ready.select(*[col(k) for k in keys], *found)
