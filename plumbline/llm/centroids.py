"""Clusters around centroids, each vector assigned by the threshold algorithm.

Every dimension has a list of the centroids sorted by their value there. From a
vector's own value the lists are walked outward, one entry in each dimension at
a time; a centroid met for the first time gets its exact squared distance. A
centroid that no list has shown yet lies at or beyond the frontier, the next
entry, of every list; so the search ends for a vector as soon as the sum of its
squared frontier distances strictly exceeds the best exact distance. A tie is
thus always looked at, and goes to the smaller number.

Vectors are whole numbers: floor(scale x) of each component. All arithmetic is
exact. One job a round assigns all vectors and adds up each cluster in the
tasks; what the driver sees is `clusters` x `width` sums a round, whatever the
input, and what tasks get is the centroids. The vectors are written once.

Defined results: a vector counts only with exactly `width` components, all
finite and none null; others, null vectors too, give no row. Repeated rows count
and start each for themselves; equal hashes of starts are ordered by their
components. A null id is hashed as the empty text and comes back null. With fewer
vectors than `clusters` there are as many clusters as vectors. An empty cluster
keeps its centroid. An empty table gives no rows. Columns other than the id and
the vector are not read. A component of over 2^24 in size after scaling is an
error, as its distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept
from plumbline.session import ship

ship(__name__)

CLUSTERS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024
#: Vectors of one step inside a task.
BLOCK = 2048
#: Largest size of a scaled component: squared distances of up to 2^11 components then fit a long.
LARGEST = 1 << 24

SCHEMA = "vec_id long, cluster int, distance long"


class Walk:
    """The sorted lists of some centroids (clusters x width, whole numbers)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable")
        self.values = np.take_along_axis(centroids, self.order, axis=0)
        self.steps = 0                                   # entries walked, over all vectors

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector, and its squared distance."""
        number, distance = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors), dtype=np.int64)
        for start in range(0, len(vectors), BLOCK):
            number[start:start + BLOCK], distance[start:start + BLOCK] = self._block(vectors[start:start + BLOCK])
        return number, distance

    def _block(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = vectors.shape
        k = len(self.centroids)
        far = np.int64(2 * LARGEST + 1)                  # beyond any true gap
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64)
        seen = np.zeros((n, k), dtype=bool)
        right = np.empty((n, width), dtype=np.int64)
        for d in range(width):
            right[:, d] = np.searchsorted(self.values[:, d], vectors[:, d])
        left = right - 1
        at, row = np.arange(n), np.arange(width)[None, :]
        x = vectors

        def gaps(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            below = np.where(left >= 0, x - self.values[np.maximum(left, 0), row], far)
            above = np.where(right < k, self.values[np.minimum(right, k - 1), row] - x, far)
            return below, above

        below, above = gaps(left, right)
        while len(at):
            go_left = below <= above
            shown = self.order[np.clip(np.where(go_left, left, right), 0, k - 1), row]
            self.steps += shown.size
            left, right = left - go_left, right + ~go_left
            first = np.zeros((len(at), k), dtype=bool)
            first[np.arange(len(at))[:, None], shown] = True
            first &= ~seen[at]
            i, c = np.nonzero(first)
            gap = x[i] - self.centroids[c]
            exact = np.einsum("ij,ij->i", gap, gap)
            seen[at] |= first
            # by distance, then by number; the first of each vector is its new candidate
            by = np.lexsort((c, exact, i))
            i, c, exact = i[by], c[by], exact[by]
            head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.array([], dtype=np.int64)
            rows = at[i[head]]
            nearer = (exact[head] < best[rows]) | ((exact[head] == best[rows]) & (c[head] < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = exact[head][nearer], c[head][nearer]
            below, above = gaps(left, right)
            frontier = np.minimum(below, above)
            going = (np.einsum("ij,ij->i", frontier, frontier) <= best[at]) & ~seen[at].all(axis=1)
            at, x, left, right, below, above = at[going], x[going], left[going], right[going], below[going], above[going]
        return number, best


def whole_vectors(df: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that count as whole numbers, written once."""
    value = F.col(vector).cast("array<double>")
    sound = value.isNotNull() & (F.size(value) == width) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floored = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    fits = F.forall("v", lambda x: F.abs(x * F.lit(float(scale))) < float(LARGEST))
    return kept(df.select(F.col(key).cast("long").alias("vec_id"), F.when(sound, value).alias("v")).filter("v is not null")
                .select("vec_id", F.when(fits, floored).otherwise(F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")).cast("array<bigint>")).alias("v")), "vectors")


def starts(vectors: DataFrame, clusters: int, salt: str) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.orderBy(digest, "v").limit(clusters).select("v").collect()]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def moved(vectors: DataFrame, centroids: list[list[int]], width: int) -> list[list[int]]:
    """The centroids after one round: exact floored means of their vectors."""
    at = np.array(centroids, dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, total, count = Walk(at), np.zeros(at.shape, dtype=object), np.zeros(len(at), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                number, _ = walk.nearest(x)
                for c in np.unique(number):
                    total[c] += x[number == c].sum(axis=0)
                    count[c] += int((number == c).sum())
        used = np.flatnonzero(count)
        rows = [(int(c), d, str(total[c, d]), int(count[c])) for c in used for d in range(width)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64()))], names=["cluster", "dim", "total", "n"])

    partial = vectors.select("v").mapInArrow(sums, "cluster int, dim int, total string, n long")
    found = partial.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [list(c) for c in centroids]
    for r in found.collect():                            # clusters x width rows
        out[r["cluster"]][r["dim"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]], width: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    at = np.array(centroids, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(at)
        for batch in batches:
            number, distance = walk.nearest(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, SCHEMA)


def clustered(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
              width: int = WIDTH, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """Every vector with its cluster, distances and the centroid's digest."""
    vectors = whole_vectors(df, key, vector, width, scale)
    centroids = starts(vectors, clusters, salt)
    if not centroids:
        return vectors.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256").limit(0)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, width)
    found = kept(assigned(vectors, centroids, width), "assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()      # one row a cluster
    inertia = sum(int(r["total"]) for r in sums)
    rows = [(r["cluster"], int(r["total"]), inertia, hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()) for r in sums]
    per_cluster = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
