"""Column and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import (DATED, as_number, col, families, footprint, known, micros, parsed_date,
                                         parsed_number)
from plumbline.operators.frequencies import Frequencies, distinct_counts, duplicate_rows, value_frequencies
from plumbline.operators.ordering import FEW_VALUES, quantile_values
from plumbline.settings import DEFAULTS, Settings

MB = 1024 * 1024


def adjusted_skew(raw: Column, n: Column) -> Column:
    """Bias-adjusted skewness from the population one; 0 for constants, NULL below three rows."""
    n = n.cast("double")
    return F.when(n >= 3, F.coalesce(raw, F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def skewness(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, skewness) of numeric columns in one pass."""
    kinds = families(df)
    entries = [F.struct(F.lit(c).alias("column_name"),
                        adjusted_skew(F.skewness(as_number(c, kinds[c])), F.count(as_number(c, kinds[c]))).alias("skewness"))
               for c in cols]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def _one_cell(name: str, kind: str, dtype, slot: int) -> Column:
    """What the statistics need of a cell, alike for all kinds of columns."""
    c = known(name, kind)
    number, moment = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    if kind in ("whole", "fraction", "decimal"):
        number = as_number(name, kind)
    if kind == "text":
        number, moment = parsed_number(col(name)), parsed_date(col(name))
    if kind in DATED:
        moment = c.cast("timestamp_ntz")
    return F.struct(F.lit(slot).alias("slot"), c.isNotNull().alias("present"), footprint(name, kind, dtype).cast("bigint").alias("bytes"),
                    number.cast("double").alias("number"), moment.cast("timestamp_ntz").alias("moment"))


def column_stats(df: DataFrame) -> DataFrame:
    """Single-pass statistics, one row per column.

    Cells of all columns pass through one aggregation by column number, so the
    table is scanned once, however wide it is; only sums are shuffled.
    """
    kinds = families(df)
    cells = F.explode(F.array(*[_one_cell(f.name, kinds[f.name], f.dataType, i) for i, f in enumerate(df.schema.fields)]))
    # A spelled-out NaN is a number too, though a missing one.
    x = F.when(~F.isnan("number"), F.col("number"))
    found = df.select(cells.alias("cell")).select("cell.*").groupBy("slot").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("present").alias("filled"), F.sum("bytes").alias("size"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), adjusted_skew(F.skewness(x), F.count(x)).alias("skewness"),
        F.min("moment").alias("first"), F.max("moment").alias("last"), F.count("moment").alias("moments"), F.count("number").alias("numbers"))
    names = [(i, f.name, f.dataType.simpleString(), kinds[f.name]) for i, f in enumerate(df.schema.fields)]
    every = df.sparkSession.createDataFrame(names, "slot int, column_name string, dtype string, family string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    is_text, filled = F.col("family") == "text", zero("filled")
    dates = F.when(is_text | F.col("family").isin(*DATED), zero("moments")).when(F.col("family") == "interval", filled)
    return every.join(found, "slot", "left").select(
        "column_name", F.col("slot").alias("ordinal"), "dtype", "family", zero("rows").alias("row_count"), filled.alias("present_count"), zero("size").alias("bytes"),
        "mean", "std", "min", "max", "skewness", "first", "last", dates.alias("date_count"),
        F.when(is_text, zero("moments") == filled).alias("is_date"), F.when(is_text, zero("numbers") == filled).alias("is_number"))


def storage_footprint(df: DataFrame) -> DataFrame:
    """(column_name, bytes, size_share): encoded size of each column."""
    kinds = families(df)
    sized = df.agg(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"),
                 F.coalesce(F.sum(footprint(f.name, kinds[f.name], f.dataType)), F.lit(0)).alias("bytes"))
        for f in df.schema.fields]).alias("e"))
    total = F.aggregate("e", F.lit(0).cast("bigint"), lambda acc, x: acc + x["bytes"])
    return (sized.select(total.alias("total"), F.inline("e"))
            .select("column_name", "bytes",
                    F.when(F.col("total") > 0, F.col("bytes") / F.col("total")).otherwise(0.0).alias("size_share")))


def missing_values(df: DataFrame) -> DataFrame:
    """(column_name, missing_count, missing_pct)."""
    kinds = families(df)
    rows = F.count(F.lit(1))
    entries = [F.struct(F.lit(c).alias("column_name"),
                        (rows - F.count(known(c, kinds[c]))).alias("missing_count"),
                        F.when(rows > 0, (rows - F.count(known(c, kinds[c]))) / rows).alias("missing_pct"))
               for c in df.columns]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def unique_values(df: DataFrame, cols: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column_name, unique_count, unique_pct over all rows).

    Exact by default; `approximate=True` keeps one sketch per column instead of
    shuffling distinct values.
    """
    cols = cols or df.columns
    kinds = families(df)
    if approximate:
        entries = [F.struct(F.lit(c).alias("column_name"), _sketched(known(c, kinds[c]), kinds[c]).alias("unique_count"))
                   for c in cols]
        counts = df.agg(F.array(*entries).alias("e"), F.count(F.lit(1)).alias("row_count")).select("row_count", F.inline("e"))
    else:
        counts = distinct_counts(df, cols).withColumn("row_count", df.agg(F.count(F.lit(1))).scalar())
    return counts.select("column_name", "unique_count",
                         F.when(F.col("row_count") > 0, F.col("unique_count") / F.col("row_count")).alias("unique_pct"))


def _sketched(c: Column, kind: str) -> Column:
    """Distinct count from a sketch of 16384 registers, within about 1%."""
    key = c.cast("bigint") if kind in ("whole", "boolean") else micros(c, kind) if kind in DATED else c.cast("string")
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(key, 14)), F.lit(0)).cast("bigint")


def type_rule(settings: Settings = DEFAULTS) -> Column:
    """Logical type from `column_stats` joined with the distinct counts."""
    few = F.col("unique_count") <= settings.categorical_limit
    by_count = F.when(F.col("unique_count") == 2, "boolean").when(few, "categorical").otherwise("numerical")
    return (F.when(F.col("family") == "nested", "unsupported")
            .when(F.col("family") == "boolean", "boolean")
            .when(F.col("family").isin(*DATED, "interval"), "datetime")
            .when((F.col("row_count") > 0) & (F.col("present_count") == 0), "categorical")
            .when(F.col("unique_count") / F.nullif(F.col("row_count"), F.lit(0)) > settings.id_uniqueness, "id")
            .when(F.col("family").isin("whole", "fraction", "decimal"), by_count)
            .when(F.col("is_date"), "datetime")
            .when(F.col("is_number"), by_count)
            .when(few, "categorical")
            .otherwise("text"))


def typed_stats(df: DataFrame, settings: Settings = DEFAULTS, approximate: bool = False, values: Frequencies | None = None) -> DataFrame:
    stats = column_stats(df)
    flat = [c for c, k in families(df).items() if k != "nested"]
    if values is not None:
        counts = values.distinct()
    elif approximate:
        counts = unique_values(df, flat, approximate=True).drop("unique_pct")
    else:
        counts = distinct_counts(df, flat)
    return (stats.join(counts, "column_name", "left")
            .withColumn("inferred_type", type_rule(settings)))


def infer_types(df: DataFrame, settings: Settings = DEFAULTS, approximate: bool = False) -> DataFrame:
    """(column_name, ordinal, dtype, inferred_type)."""
    return typed_stats(df, settings, approximate).select("column_name", "ordinal", "dtype", "inferred_type")


def light_profile(df: DataFrame, settings: Settings = DEFAULTS, approximate: bool = False) -> DataFrame:
    """The part of `column_profile` that targets and chart choices go by, as one lazy plan."""
    rows = F.nullif(F.col("row_count"), F.lit(0))
    missing, unique = F.col("row_count") - F.col("present_count"), F.coalesce("unique_count", F.lit(0))
    return typed_stats(df, settings, approximate).select(
        "column_name", "ordinal", "dtype", "inferred_type", "row_count", missing.alias("missing_count"), (missing / rows).alias("missing_pct"),
        unique.alias("unique_count"), (unique / rows).alias("unique_pct"), F.when(F.col("inferred_type") == "numerical", F.col("skewness")).alias("skewness"))


def category_summary(df: DataFrame, cols: list[str], top: int = 5, values: Frequencies | None = None) -> DataFrame:
    """(column_name, top, frequency, top_values): the most frequent values.

    Ties go to the smaller value. A column without values reports N/A and 0.
    """
    ranked = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    best = ((value_frequencies(df, cols) if values is None else values.values(cols))
            .withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= top)
            .groupBy("column_name")
            .agg(F.sort_array(F.collect_list(F.struct("place", "value", "n"))).alias("v")))
    names = F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name")
    every = df.sparkSession.range(1).select(names)
    pairs = F.transform("v", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count")))
    none = F.array().cast("array<struct<value:string,count:bigint>>")
    return every.join(best, "column_name", "left").select(
        "column_name", F.coalesce(F.col("v")[0]["value"], F.lit("N/A")).alias("top"),
        F.coalesce(F.col("v")[0]["n"], F.lit(0)).cast("bigint").alias("frequency"),
        F.coalesce(pairs, none).alias("top_values"))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, count, mean, std, min, q25, median, q75, max), all exact."""
    kinds = families(df)
    x = {c: as_number(c, kinds[c]) for c in cols}
    entries = [F.struct(F.lit(c).alias("column_name"), F.count(x[c]).alias("count"), F.avg(x[c]).alias("mean"),
                        F.stddev_samp(x[c]).alias("std"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"))
               for c in cols]
    moments = df.agg(F.array(*entries).alias("e")).select(F.inline("e"))
    return moments.join(_quartiles(df, cols), "column_name").select(
        "column_name", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def _quartiles(df: DataFrame, cols: list[str], distinct: dict[str, int] | None = None, values: Frequencies | None = None) -> DataFrame:
    probs = [0.25, 0.5, 0.75]
    found = values.quantiles(cols, probs, FEW_VALUES) if values is not None else {}
    rest = [c for c in cols if c not in found]
    found |= quantile_values(df, rest, probs, distinct) if rest else {}
    return df.sparkSession.createDataFrame(
        [(c, *found[c]) for c in cols], "column_name string, q25 double, median double, q75 double")


def date_range(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, first, last, count); text that is no date counts as missing."""
    kinds = families(df)
    moments = {c: col(c).cast("timestamp_ntz") if kinds[c] in DATED else parsed_date(col(c).cast("string")) for c in cols}
    entries = [F.struct(F.lit(c).alias("column_name"), F.min(m).alias("first"), F.max(m).alias("last"), F.count(m).alias("count"))
               for c, m in moments.items()]
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def constant_columns(df: DataFrame) -> DataFrame:
    """(column_name): columns with exactly one distinct value."""
    return distinct_counts(df, df.columns).where("unique_count = 1").select("column_name")


def column_profile(df: DataFrame, settings: Settings = DEFAULTS, approximate: bool = False, values: Frequencies | None = None) -> DataFrame:
    """One wide row per column, with the statistics its logical type calls for.

    The types decide which columns need value counts and which need quartiles,
    so they are collected first: one row per column. Unless `approximate`, all
    of it but the quartiles of columns with many values comes from two scans:
    the statistics, and the table of frequencies (`values`, if there is one already).
    """
    df = df.sparkSession.createDataFrame([], df.schema) if not df.columns else df
    if values is None and not approximate:
        values = Frequencies(df, [c for c, k in families(df).items() if k != "nested"])
    typed = typed_stats(df, settings, approximate, values).collect()
    schema = typed_schema(df)
    stats = df.sparkSession.createDataFrame(typed, schema)
    kind_of = {r["column_name"]: r["inferred_type"] for r in typed}
    categories = [c for c, k in kind_of.items() if k == "categorical"]
    measures = [c for c, k in kind_of.items() if k == "numerical"]
    profile = stats
    if categories:
        profile = profile.join(category_summary(df, categories, values=values), "column_name", "left")
    else:
        profile = profile.selectExpr("*", "CAST(NULL AS STRING) AS top", "CAST(NULL AS BIGINT) AS frequency",
                                     "CAST(NULL AS ARRAY<STRUCT<value:STRING,count:BIGINT>>) AS top_values")
    distinct = {r["column_name"]: r["unique_count"] for r in typed}
    profile = profile.join(F.broadcast(_quartiles(df, measures, distinct, values)), "column_name", "left")   # one row per column
    numeric, dated = F.col("inferred_type") == "numerical", F.col("inferred_type") == "datetime"
    rows = F.nullif(F.col("row_count"), F.lit(0))
    total = sum(r["bytes"] for r in typed)
    return profile.select(
        "column_name", "ordinal", "dtype", "inferred_type", "row_count",
        (F.col("row_count") - F.col("present_count")).alias("missing_count"),
        ((F.col("row_count") - F.col("present_count")) / rows).alias("missing_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        (F.coalesce("unique_count", F.lit(0)) / rows).alias("unique_pct"),
        (F.col("bytes") / MB).alias("size_mb"),
        (F.col("bytes") / total if total else F.lit(0.0)).alias("size_share"),
        F.when(numeric, F.col("skewness")).alias("skewness"),
        F.when(numeric, F.col("present_count")).when(dated, F.col("date_count")).alias("count"),
        *[F.when(numeric, F.col(c)).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")],
        "top", "frequency", "top_values",
        *[F.when(dated, F.col(c)).alias(c) for c in ("first", "last")])


def typed_schema(df: DataFrame) -> str:
    return ("column_name string, ordinal int, dtype string, family string, row_count bigint, present_count bigint, "
            "bytes bigint, mean double, std double, min double, max double, skewness double, first timestamp_ntz, "
            "last timestamp_ntz, date_count bigint, is_date boolean, is_number boolean, unique_count bigint, "
            "inferred_type string")


def dataset_stats(df: DataFrame, original_rows: int | None = None) -> DataFrame:
    """One row of dataset-level statistics."""
    kinds = families(df)
    width = sum((footprint(f.name, kinds[f.name], f.dataType) for f in df.schema.fields), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).scalar()
    columns = len(df.columns)
    original = F.lit(original_rows).cast("bigint") if original_rows is not None else F.col("row_count")
    return duplicate_rows(df).select(
        original.alias("original_row_count"), F.col("row_count").alias("analyzed_row_count"),
        F.lit(columns).cast("bigint").alias("column_count"),
        (size / MB).alias("size_mb"),
        F.col("duplicate_rows").alias("duplicate_rows_count"),
        (F.lit(columns) / F.nullif(original, F.lit(0))).alias("column_pct"), "duplicates_pct")
