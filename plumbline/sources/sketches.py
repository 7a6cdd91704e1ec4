"""A store of mergeable sketches, one row for each file and column.

A profile of files that only grow in number need not read them all again: each
file is sketched once, and the sketches of all files are merged. Distinct values
come from a HyperLogLog sketch, quantiles from a KLL sketch, frequent values
from a top-k sketch; all three merge without loss of their error bounds. Rows,
missing cells, extremes and sums are exact.

A file is known by path, size and time of change. A changed file is sketched
anew, and a deleted one no longer counts. Sketches are appended to the store and
never rewritten; a run that fails leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_number, col, families, known
from plumbline.session import InputError, cut

DISTINCT_BITS = 14        # 16,384 registers: within about 1 %
QUANTILE_SIZE = 800       # ranks within about 0.3 %
ITEMS = 4096              # values tracked for the most frequent ones
LONGEST_ITEM = 256        # longer texts are counted as distinct values, but are not tracked
NUMBERS = ("whole", "fraction", "decimal")

COUNTS = ["rows", "present"]
KEPT = ["file", "column_name", "rows", "present", "number_sum", "least", "most", "distinct", "ranks", "items"]


def _identity() -> list:
    """(file, path): what a file is known by, alike for every format."""
    parts = [F.col(f"_metadata.{c}").cast("string") for c in ("file_path", "file_size", "file_modification_time")]
    return [F.sha2(F.concat_ws("|", *parts), 256).alias("file")]


def current_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path) of the Parquet files under a path; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return found.select(*_identity(), "path")


def sketched(df: DataFrame) -> DataFrame:
    """The sketches of every file and column of a read of files, from one scan."""
    kinds = {c: k for c, k in families(df).items() if k != "nested"}
    # every column has its own aggregates: one row per cell would cost more than the sketches
    inputs, sketches = [], []
    for i, (name, kind) in enumerate(kinds.items()):
        text = known(name, kind).cast("string")
        number = as_number(name, kind) if kind in NUMBERS else F.lit(None)
        inputs += [text.alias(f"text{i}"), number.cast("double").alias(f"number{i}"), F.when(F.octet_length(text) <= LONGEST_ITEM, text).alias(f"item{i}")]
        sketches.append(F.struct(
            F.lit(name).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count(f"text{i}").alias("present"),
            F.sum(f"number{i}").alias("number_sum"), F.min(f"number{i}").alias("least"), F.max(f"number{i}").alias("most"),
            F.hll_sketch_agg(f"text{i}", DISTINCT_BITS).alias("distinct"), F.kll_sketch_agg_double(f"number{i}", QUANTILE_SIZE).alias("ranks"),
            F.expr(f"approx_top_k_accumulate(item{i}, {ITEMS})").alias("items")).alias(f"column{i}"))
    wide = df.select(*_identity(), *inputs).groupBy("file").agg(*sketches)
    return wide.select("file", F.explode(F.array(*[f"column{i}" for i in range(len(kinds))])).alias("column")).select("file", "column.*").select(*KEPT)


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """All sketches of a store, or None if there are none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/sketches")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(f"{root}/sketches")


def refresh(spark: SparkSession, path: str, root: str) -> int:
    """Sketch the files that the store does not have; how many there were.

    Their paths come to the driver, as Spark's reader takes them."""
    files, there = current_files(spark, path), stored(spark, root)
    fresh = files if there is None else files.join(there.select("file").distinct(), "file", "left_anti")
    paths = sorted(r["path"] for r in fresh.select("path").collect())
    if paths:
        sketched(spark.read.option("mergeSchema", True).parquet(*paths)).write.mode("append").parquet(f"{root}/sketches")
    return len(paths)


def sketched_profile(spark: SparkSession, path: str, root: str, top: int = 5) -> DataFrame:
    """(column_name, row_count, present_count, missing_pct, unique_count, mean, min, q25, median, q75, max, top_values)
    of the files under a path, reading only those that the store has not seen.

    A column that some files lack counts as missing there."""
    refresh(spark, path, root)
    there = stored(spark, root)
    if there is None:
        raise InputError(f"there are no Parquet files under '{path}'")
    now = current_files(spark, path).select("file").distinct()
    # a file may have been sketched by two runs at once
    once = Window.partitionBy("file", "column_name").orderBy("rows")
    used = cut(there.join(now, "file").withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth"), "sketches")
    total = used.groupBy("file").agg(F.max("rows").alias("rows")).agg(F.sum("rows")).scalar()
    merged = used.groupBy("column_name").agg(
        F.sum("present").alias("present_count"), F.sum("number_sum").alias("number_sum"), F.min("least").alias("min"), F.max("most").alias("max"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("unique_count"), F.kll_merge_agg_double("ranks").alias("ranks"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(items, {ITEMS}), {top + 1})").alias("top"))
    numbers = F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])))
    rows = total.cast("bigint")
    return merged.withColumn("q", numbers).select(
        "column_name", rows.alias("row_count"), "present_count", ((rows - F.col("present_count")) / F.nullif(rows, F.lit(0))).alias("missing_pct"), "unique_count",
        (F.col("number_sum") / F.when(F.col("min").isNotNull(), F.col("present_count"))).alias("mean"), "min",
        *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "median", "q75"))], "max",
        # missing cells are an item, too
        F.transform(F.slice(F.filter("top", lambda x: x["item"].isNotNull()), 1, top), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("count"))).alias("top_values"))
