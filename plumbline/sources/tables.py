"""Reading tables: Parquet, CSV, Arrow files and workbooks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col, normalise_missing
from plumbline.session import InputError, cut
from plumbline.sources.arrow import read_arrow
from plumbline.sources.delimited import read_delimited
from plumbline.sources.workbook import read_workbooks

# Texts that stand for a missing cell in delimited files.
MISSING_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                 "NULL", "NaN", "None", "n/a", "nan", "null"]
DELIMITERS = ",;\t|"
EXACT_DOUBLE = 2 ** 53          # whole numbers beyond it may share a double
FORMATS = {".csv": "csv", ".parquet": "parquet", ".feather": "arrow", ".arrow": "arrow", ".xlsx": "workbook"}


def format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise InputError(f"cannot tell the format of '{path}'; name one of {sorted(set(FORMATS.values()))}")
    return FORMATS[suffix]


def read_table(spark: SparkSession, path: str, fmt: str | None = None, sep: str | None = None) -> DataFrame:
    """A table with one kind of missing value; the format follows from the path unless named."""
    fmt = fmt or format_of(path)
    if fmt == "parquet":
        return normalise_missing(spark.read.parquet(path))
    if fmt == "csv":
        return read_csv(spark, path, sep)
    if fmt == "arrow":
        return normalise_missing(read_arrow(spark, path))
    if fmt == "workbook":
        return typed_text(read_workbooks(spark, path))
    raise InputError(f"unknown format '{fmt}'")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The separator that occurs most evenly in all lines, a comma when in doubt.

    One aggregate over the whole input: per candidate the number a line has
    outside of quotes, and how much that number varies.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    counts = {s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in DELIMITERS}
    found = lines.agg(*[e for i, s in enumerate(DELIMITERS) for e in (F.avg(counts[s]).alias(f"mean{i}"), F.stddev_pop(counts[s]).alias(f"spread{i}"))]).first()
    seen = [(found[f"spread{i}"] / found[f"mean{i}"], -found[f"mean{i}"], i) for i in range(len(DELIMITERS)) if found[f"mean{i}"]]
    return DELIMITERS[min(seen)[2]] if seen else ","


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Header row, quoted cells, inferred types, missing-value texts as NULL.

    Files are split between tasks, whether or not quoted cells span lines.
    """
    sep = sep or detect_delimiter(spark, path)
    if _spans_lines(spark, path):
        return typed_text(read_delimited(spark, path, sep))
    return typed_text(spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path))


def typed_text(raw: DataFrame) -> DataFrame:
    """Text columns turned into bigint, double or boolean where every cell allows it.

    One pass; its result is one row. Whole numbers with missing cells become
    doubles and an empty column is a double one. Whole numbers that a double
    cannot hold stay exact: bigint, else decimal(38,0), else text.
    """
    text = {c: F.when(~col(c).isin(MISSING_TEXTS), col(c)) for c in raw.columns}
    if not text:
        return raw
    whole, number = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"
    # Counted per cell, so that a text column costs one regex that fails at its first letter.
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(raw.columns):
        t = text[c]
        digits = F.when(t.rlike(whole), F.trim(t))
        wide = digits.try_cast("decimal(38,0)")
        aggs += [F.count(t).alias(f"k{i}"), F.count(digits).alias(f"w{i}"), F.count_if(t.rlike(number)).alias(f"f{i}"),
                 F.count(wide).alias(f"d{i}"), F.count(digits.try_cast("bigint")).alias(f"l{i}"), F.count_if(F.abs(wide) > EXACT_DOUBLE).alias(f"e{i}"),
                 F.count_if(F.lower(t).isin("true", "false")).alias(f"b{i}")]
    found = raw.agg(*aggs).first()
    out = []
    for i, c in enumerate(raw.columns):
        present, t = found[f"k{i}"], text[c]
        if present and found[f"b{i}"] == present == found["rows"]:
            t = F.lower(t).cast("boolean")
        elif present and found[f"w{i}"] == present and (found[f"e{i}"] or found[f"d{i}"] < present or present == found["rows"]):
            fits = "bigint" if found[f"l{i}"] == present else "decimal(38,0)" if found[f"d{i}"] == present else "string"
            t = F.trim(t).cast(fits)
        elif found[f"f{i}"] == present:
            t = F.trim(t).try_cast("double")
        out.append(t.alias(c))
    return raw.select(*out)


def row_count(df: DataFrame) -> int:
    """Data rows. No column is read: Parquet answers from its footers."""
    return df.count()


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, or all of them if there are no more.

    The same on every run where the keys tell the rows apart; where they repeat,
    which copies are taken depends on how the table is laid out in files.

    Rows are ordered by a seeded digest of their key. A digest threshold first
    lets through little more than n rows. Where keys repeat, the threshold may
    let through too few rows or far too many: then every further copy of a key
    inside a partition gets a digest of its own, so that no key meets one task,
    and the threshold is raised until enough rows pass.
    """
    total = df.count()
    if total <= n:
        return df
    slack = 12 * n ** 0.5 + 100

    def passing(rows: DataFrame, share: float) -> DataFrame:
        return rows.where(F.col("_digest") < f"{int(share * 16 ** 32):032x}") if share < 1.0 else rows

    def digest(*parts: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys], *parts).cast("binary"))

    share = (n + slack) / total
    rows = df.withColumn("_digest", digest())
    picked = passing(rows, share).count()
    if not n <= picked <= n + 2 * slack:
        copy = Window.partitionBy("_digest", "_part").orderBy("_row")
        numbered = rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).withColumn("_copy", F.row_number().over(copy))
        rows = cut(numbered.withColumn("_digest", F.when(F.col("_copy") > 1, digest(F.col("_part"), F.col("_copy"))).otherwise(F.col("_digest"))).drop("_part", "_copy"), "copies")
        while share < 1.0 and passing(rows, share).count() < n:
            share *= 2
    order = ["_digest", *[col(k) for k in keys], *(["_row"] if "_row" in rows.columns else [])]
    return passing(rows, share).orderBy(*order).limit(n).drop("_digest", "_row")


def preview(df: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[col(k) for k in keys]).limit(n)


def title_from_name(stem: Column) -> Column:
    """Separators as blanks, every run of letters capitalised, and the word Analysis."""
    spaced = F.lower(F.translate(stem, "_-", "  "))
    runs = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.concat(F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 10_000_000))), ""), F.lit(" Analysis"))
