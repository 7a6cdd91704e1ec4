"""What the operators share: words, batches and gapless numbering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import scratch_path, ship

ship(__name__)

#: Rows of one Arrow batch inside a task; long texts make batches smaller still.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS."""
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """`fn` over the Arrow batches of every partition, in small batches."""
    return df.mapInArrow(lambda batches: fn(small(batches)), schema)


def kept(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared scratch folder, tightly packed, and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def like(df: DataFrame) -> T.StructType:
    """The schema of `df` with every column nullable."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])


def offsets(counts: DataFrame, key: str, part: str, count: str, offset: str) -> DataFrame:
    """For every (key, part): how many rows of the key lie in earlier parts.

    `counts` has one row per key and part, so the window never sees the rows
    themselves.
    """
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, part, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(offset))
