"""Helpers shared by the registered queries and their checking SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, whole numbers as BIGINT."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def sql_round(text: str, digits: int = 6) -> str:
    return f"(round(CAST({text} AS DOUBLE), {digits}) + 0.0)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
