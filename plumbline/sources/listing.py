"""Many files of one format: listed by Spark, looked into by tasks.

Headers are read where the data is read. Equal headers are one row after one
aggregation, and what is left is merged in ranges of paths, so that the driver
sees one merged header for each range and not one for each file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import InputError, cut, ship

ship(__name__)

FILES_PER_TASK = 64       # files whose headers one task reads
HEADERS_PER_TASK = 256    # different headers that one task merges
BYTES_PER_TASK = 128 * 1024 * 1024


def plain_path(path: str) -> str:
    """A local file's path without its scheme; other paths as they are."""
    return re.sub(r"^file:/+", "/", path)


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of the file at `path`, or of the matching files under it; nothing is opened."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise InputError(f"there is nothing at '{path}'")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if system.getFileStatus(place).isDirectory():
        endings = ",".join(e for s in suffixes for e in (s[1:], s[1:].upper()))
        reader = reader.option("pathGlobFilter", f"*.{{{endings}}}")
    return reader.load(path).select("path", "length")


def headers(files: DataFrame, read: Callable[[str], tuple[bytes, int]], label: str) -> DataFrame:
    """(path, length, header, parts), written once: what `read` says of every file,
    its header as bytes and into how many parts it can be cut."""
    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [read(plain_path(p)) for p in frame["path"]]
            yield frame.assign(header=[h for h, _ in found], parts=[n for _, n in found])

    count = files.count()
    spread = files.repartition(max(1, -(-count // FILES_PER_TASK)), "path")
    return cut(spread.mapInPandas(look, "path string, length long, header binary, parts long"), label)


def merged(found: DataFrame, merge: Callable[[list[bytes]], bytes]) -> bytes | None:
    """The headers of all files merged in the order of their paths."""
    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for frame in frames for r in zip(frame["path"], frame["header"])]
        if rows:
            rows.sort()
            yield pd.DataFrame({"path": [rows[0][0]], "header": [merge([bytes(h) for _, h in rows])]})

    different = cut(found.groupBy("header").agg(F.min("path").alias("path")).select("path", "header"), "headers")
    while True:
        count = different.count()
        if count == 0:
            return None
        ranges = -(-count // HEADERS_PER_TASK)
        one = different.coalesce(1) if ranges == 1 else different.repartitionByRange(ranges, "path")
        different = cut(one.mapInPandas(join, "path string, header binary"), "headers")
        if ranges == 1:
            return bytes(different.first()["header"])


def tasks_for(spark: SparkSession, found: DataFrame, pieces: int) -> int:
    """How many tasks read the files: enough for the cores and for BYTES_PER_TASK each, no more than there are pieces."""
    size = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return max(1, min(pieces, max(spark.sparkContext.defaultParallelism, -(-size // BYTES_PER_TASK))))
