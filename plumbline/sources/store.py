"""Fingerprints, and a store of finished results keyed by them."""

from __future__ import annotations

import dataclasses
import hashlib
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.frequencies import row_digest
from plumbline.session import ship
from plumbline.settings import Settings
from plumbline.sources.arrow import open_file

ship(__name__)

RANGE_BYTES = 64 * 1024 * 1024


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(row_count, hash_sum, hash_xor, fingerprint): independent of row order and file layout.

    Sums of row hashes merge in any order, so nothing is sorted or shuffled. A
    row hash takes in for every column whether its cell is missing, as a missing
    cell alone would leave no trace of its place.
    """
    hashes = df.select(F.xxhash64(*[e for c in df.columns for e in (col(c).isNull(), col(c))]).alias("h"))
    sums = hashes.agg(F.count("h").alias("row_count"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
                      F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor"))
    schema = F.lit(df.schema.simpleString())
    return sums.withColumn("fingerprint", F.sha2(F.concat_ws("|", schema, "row_count", "hash_sum", "hash_xor"), 256))


def row_digests(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys and the 256-bit digest of each whole row."""
    return df.select(*[col(k) for k in keys], row_digest(df).alias("digest"))


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, fingerprint) of the files' names and contents.

    Files are read in ranges of RANGE_BYTES by any number of tasks, so that
    their size does not matter. A file's digest is that of its ordered range
    digests; files are told apart by their place below `path`, and their hashes
    are summed, so no list of all files is formed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")          # contents are not read
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).repartition("path", "start")

    def digests(batches):
        import pyarrow as pa
        for batch in batches:
            found = []
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                uri = name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name
                with open_file(uri) as handle:
                    handle.seek(start)
                    found.append(hashlib.sha256(handle.read(RANGE_BYTES)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["path", "length", "start", "digest"])

    each = ranges.mapInArrow(digests, "path string, length long, start long, digest string")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "digest"))), lambda x: x["digest"])
    root = path.rstrip("/").split("*", 1)[0].split("://")[-1]
    place = F.regexp_replace(F.substring_index("path", root, -1), "^/", "")
    whole = each.groupBy("path", "length").agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"))
    hashes = whole.select("length", F.xxhash64(place, "length", "digest").alias("h"))
    sums = hashes.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"),
                      F.coalesce(F.bit_xor("h"), F.lit(0)).cast("string").alias("xor"))
    return sums.select("files", "bytes", F.sha2(F.concat_ws("|", F.col("files").cast("string"), "sum", "xor"), 256).alias("fingerprint"))


def settings_fingerprint(settings: Settings) -> str:
    return hashlib.sha256(json.dumps(dataclasses.asdict(settings), sort_keys=True).encode()).hexdigest()


def store_key(fingerprint: str, settings: Settings) -> str:
    return hashlib.sha256((fingerprint + settings_fingerprint(settings)).encode()).hexdigest()


def save_section(df: DataFrame, root: str, key: str, name: str) -> DataFrame:
    """Write a result table; the row in `done` is written last and marks it finished."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/{key}/{name}/data")
    saved = spark.read.schema(df.schema).parquet(f"{root}/{key}/{name}/data")
    spark.createDataFrame([(name, df.schema.json())], "name string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{key}/{name}/done")
    return saved


def _shape(schema: dict) -> list[tuple[str, str]]:
    """Names and types of the columns; Parquet makes every one nullable."""
    return [(f["name"], json.dumps(f["type"], sort_keys=True).replace("false", "true")) for f in schema["fields"]]


def load_section(spark: SparkSession, root: str, key: str, name: str) -> DataFrame | None:
    """A finished result table, or None when it is absent, unfinished or unreadable."""
    try:
        done = spark.read.parquet(f"{root}/{key}/{name}/done").first()
        saved = spark.read.parquet(f"{root}/{key}/{name}/data")
    except Exception as error:
        if isinstance(error, AnalysisException) or "parquet" in str(error).lower():
            return None
        raise
    if done is None or _shape(saved.schema.jsonValue()) != _shape(json.loads(done["schema"])):
        return None
    return saved


def clear_store(spark: SparkSession, root: str, key: str) -> bool:
    """Delete the stored results of one key; false when there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{key}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_section(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a matrix, an embedding or a report table: parquet, json, or csv with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
