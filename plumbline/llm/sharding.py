"""Sharding by vector bin packing: bytes, tokens and rows at once.

Groups of equal texts are the items. Small groups travel in bundles by the hash
of their text, so that the number of items does not grow with the input; only a
group larger than a shard is split into parts. Items are placed from
the largest down, each into the shard where the dot product of its size vector
with the shard's residual capacity is highest. Sizes are then near equal: the
law is `bytes`.

All sums and counts are partial aggregations. At most BUNDLES + 3 x (SPLIT + 2)
x shards item sizes meet on the driver. Slots come from counts per
written partition, so no shard meets one task.

Defined results: a null text has no bytes and counts as an empty one; groups are
told apart by a 64-bit hash; repeated rows are rows of their own; an empty table
gives no rows. Columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import mapped, offsets, raw_texts
from plumbline.session import cut, ship

ship(__name__)

SHARDS = 40
#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Bundles of small groups.
BUNDLES = 32_768
#: A group of over 1 / SPLIT of a shard, in any measure, is an item of its own.
SPLIT = 64


def measured(docs: DataFrame) -> DataFrame:
    """Size, checksum, token count and group of every row, written once; `part`
    and `nth` number the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(1)):
                group = xxhash.xxh3_64_intdigest(raw)
                rows.append((len(raw) + ROW_BYTES, zlib.crc32(raw), len(raw.split()), group - (1 << 64) if group >> 63 else group, part, n))
                n += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "size", "text_crc32", "tokens", "group", "part", "nth"])

    return cut(mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, size long, text_crc32 long, tokens long, group long, part int, nth long"), "measured")


def placed(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item. `sizes`: items x measures."""
    total = sizes.sum(axis=0).astype(float)
    share = sizes / np.where(total > 0, total, 1) * shards              # a shard's capacity is 1 in each measure
    residual = np.ones((shards, sizes.shape[1]))
    where = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -share.max(axis=1))):
        fits = (residual >= share[i]).all(axis=1)
        score = residual @ share[i]
        if fits.any():
            score = np.where(fits, score, -np.inf)
        where[i] = best = int(np.argmax(score))
        residual[best] -= share[i]
    return where


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    rows = measured(docs)
    measures = [F.sum("size"), F.sum("tokens"), F.count("*")]
    names = ["bytes", "tokens", "n"]
    total = rows.agg(*(m.alias(n) for m, n in zip(measures, names))).first()
    fair = [max(1.0, (total[n] or 0) / shards) for n in names]
    limit = [max(1.0, f / SPLIT) for f in fair]
    groups = rows.groupBy("group").agg(*(m.alias(n) for m, n in zip(measures, names)))
    parts = F.ceil(F.greatest(*(F.col(n) / F.lit(x) for n, x in zip(names, fair)))).cast("long")
    # over 1 / SPLIT of a shard in one of three measures: at most 3 x SPLIT x shards groups
    large = sorted(tuple(r) for r in groups.filter(" or ".join(f"{n} > {x!r}" for n, x in zip(names, limit))).select("group", F.least(parts, F.col("n")).alias("parts")).collect())
    starts = np.cumsum([0, *(p for _, p in large)])
    known = rows.sparkSession.createDataFrame([(g, p, BUNDLES + int(s)) for (g, p), s in zip(large, starts)], "group long, parts long, first long")
    item = (rows.join(F.broadcast(known), "group", "left")
            .withColumn("item", F.when(F.col("first").isNull(), F.pmod(F.col("group"), F.lit(BUNDLES)))
                        .otherwise(F.col("first") + F.pmod(F.xxhash64("part", "nth"), F.col("parts")))))
    sums = sorted(tuple(r) for r in item.groupBy("item").agg(*(m.alias(n) for m, n in zip(measures, names))).collect())
    where = placed(np.array([s[1:] for s in sums], dtype=np.int64), shards) if sums else []
    homes = rows.sparkSession.createDataFrame([(s[0], int(w)) for s, w in zip(sums, where)], "item long, shard int")
    found = item.join(F.broadcast(homes), "item").select("doc_id", "size", "text_crc32", "shard", "part", "nth")
    # ranks inside each written partition, offsets across them
    counts = found.groupBy("shard", "part").agg(F.count("*").alias("in_part"))
    earlier = offsets(counts, "shard", "part", "in_part", "earlier")
    inside = Window.partitionBy("shard", "part").orderBy("nth")
    return (found.withColumn("inside", F.row_number().over(inside) - 1).join(earlier, ["shard", "part"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("earlier") + F.col("inside")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
