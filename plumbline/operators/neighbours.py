"""Exact k nearest neighbours by Euclidean distance.

Points are assigned to the nearest of a bounded set of pivots. A point first
searches its own cell, which bounds the distance of its k-th neighbour, and
then only those cells that the triangle inequality cannot rule out. Cells are
searched in blocks of bounded size on both sides, and a task gives back only
the k best per point and block. Equal points are searched once.

Wide vectors rule out hardly any cell. Where sending points to the cells they
ask for would move more rows than sending all points past every share of the
queries, the latter is done: a task holds one share with its k best so far, the
points stream by in packs, and move once per share, not once per cell. Products of
matrices of floats shortlist; distances that count are computed again in doubles.

Distances are compared at nine decimals and ties go to the smaller key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.session import cut, ship

ship(__name__)

POINTS_PER_PIVOT = 512
MOST_PIVOTS = 16_384
BLOCK = 1024           # points per data block
QUERIES = 4096         # queries per task and data block
SHARES = 24            # shares of the queries when all points stream by them, unless a share would get too large
SHARE_VALUES = 1 << 21 # numbers held of the queries of a share
CHUNK = 512            # queries compared at once with a batch of points
MATRIX = 1 << 20       # distances to pivots computed at once
FIRST = 1024           # points compared at once with a chunk of queries
PACK = 1024            # numbers of the points that travel in one row
STRIDE = 512           # such rows seen at once
DECIMALS = 9
SLACK = 4e-9


def _vectors(rows) -> np.ndarray:
    return np.vstack(rows.to_numpy()) if len(rows) else np.zeros((0, 0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T)


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int):
    """(query position, point position, distance) of the k nearest other points per query.

    The fast product form only shortlists; shortlisted distances are computed again exactly.
    """
    rough = _squared(queries, points)
    kth = min(k, rough.shape[1] - 1)             # one place more than k, as the point itself may be in the block
    limit = np.partition(rough, kth, axis=1)[:, kth]
    scale = (queries * queries).sum(1) + (points * points).sum(1).max()
    near, at = np.nonzero(rough <= (limit + 1e-9 * scale + SLACK * (1 + np.sqrt(limit)))[:, None])
    other = query_ids[near] != point_ids[at]
    near, at = near[other], at[other]
    distance = np.round(np.sqrt(((queries[near] - points[at]) ** 2).sum(1)), DECIMALS)
    order = np.lexsort((np.unique(point_ids, return_inverse=True)[1][at], distance, near))
    near, at, distance = near[order], at[order], distance[order]
    place = np.arange(len(near)) - np.searchsorted(near, near)
    return near[place < k], at[place < k], distance[place < k]


def _search(queries: DataFrame, data: DataFrame, sizes: dict[int, int], wanted: dict[int, int], k: int, key_type: str) -> DataFrame:
    """(query, neighbour, distance): the k best of every data block for the queries sent to its cell.

    `sizes` and `wanted` count the points and queries of each cell: at most
    MOST_PIVOTS entries. They fix into how many blocks both sides are cut.
    """
    spark = queries.sparkSession
    cuts = F.broadcast(spark.createDataFrame(
        [(c, -(-sizes[c] // BLOCK), -(-wanted[c] // QUERIES)) for c in wanted if c in sizes], "cell int, blocks int, shares int"))
    share = F.pmod(F.xxhash64("query", F.lit(1)), F.col("shares")).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    left = queries.join(cuts, "cell").select(
        "cell", share.alias("share"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "vector")
    # Both sides may come from one table: fresh names keep them apart.
    right = data.join(cuts, "cell").select(
        F.col("cell").alias("of_cell"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("of_share"),
        block.alias("of_block"), F.col("id").alias("point"), F.col("vector").alias("place"))

    def best(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if q.empty or p.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "distance": []})
        qid, pid = q["query"].to_numpy(), p["point"].to_numpy()
        i, j, d = nearest_in_block(_vectors(q["vector"]), qid, _vectors(p["place"]), pid, k)
        return pd.DataFrame({"query": qid[i], "neighbour": pid[j], "distance": d})

    return (left.groupBy("cell", "share", "block").cogroup(right.groupBy("of_cell", "of_share", "of_block"))
            .applyInPandas(best, f"query {key_type}, neighbour {key_type}, distance double"))


def _best(candidates: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query").orderBy("distance", "neighbour")
    return candidates.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def _under(rough: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries that are at most their row's `most`."""
    return np.divmod(np.flatnonzero(rough <= most[:, None]), rough.shape[1])


class _Nearest:
    """The k best of a share of queries among the points seen so far, none farther than the queries' bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.vectors, self.limit, self.k = ids, vectors, bounds.astype(float), k
        self.centre = vectors.mean(0) if len(vectors) else np.zeros(0)
        self.found = [(np.zeros(0, dtype=int), ids[:0], np.zeros(0)) for _ in range(0, len(ids), CHUNK)]

    def see(self, point_ids: np.ndarray, points: np.ndarray) -> None:
        """Rough distances of blocks of points, from one matrix product, only shortlist; those that count are
        computed again. The product is in floats wherever their error is small beside the distances sought."""
        if not len(points) or not len(self.ids):
            return
        shifted = points - self.centre
        square = (shifted * shifted).sum(1)
        largest, error = square.max(), (points.shape[1] + 8) * 2.0 ** -23
        wide = np.column_stack([shifted, square])
        with np.errstate(over="ignore"):
            narrow = wide.astype(np.float32)
        for c, start in enumerate(range(0, len(self.ids), CHUNK)):
            x, ids, limit = (a[start:start + CHUNK] for a in (self.vectors, self.ids, self.limit))
            own = x - self.centre
            norm = (own * own).sum(1)
            left = np.column_stack([-2 * own, np.ones(len(own))])
            first, fresh = 0, not np.isfinite(limit).all()
            while first < len(points):
                known = np.isfinite(limit)
                tight = known.any() and error * (np.median(norm[known]) + largest) > 0.05 * np.median(limit[known] ** 2)
                floats = not tight and norm.max() + largest < 1e30
                a, b = (left.astype(np.float32), narrow) if floats else (left, wide)
                slack = (error if floats else 1e-9) * (norm + largest)
                most = limit ** 2 + slack + SLACK * (1 + limit) - norm
                # without bounds the limits get tighter with the points seen
                end, hits, n = max(first + FIRST, 2 * first) if fresh else len(points), [], 0
                while first < min(end, len(points)) and n <= MATRIX // 8:
                    rough, reach = a @ b[first:first + FIRST].T, most
                    if not known.all() and rough.shape[1] > self.k:
                        kth = np.partition(rough, self.k, axis=1)[:, self.k].astype(float)           # the point itself may be among them
                        reach = np.minimum(most, kth + 2 * slack + SLACK * (1 + np.sqrt(np.maximum(0.0, kth + norm))))
                    near, at = _under(rough, reach.astype(a.dtype))
                    hits.append((near, at + first))
                    n += len(near)
                    first += FIRST
                self._take(c, x, ids, limit, point_ids, points, *map(np.concatenate, zip(*hits)))

    def _take(self, c: int, x: np.ndarray, ids: np.ndarray, limit: np.ndarray, point_ids: np.ndarray, points: np.ndarray, near: np.ndarray, at: np.ndarray) -> None:
        """Shortlisted pairs of a chunk's queries and points join its k best; `limit` follows."""
        other = ids[near] != point_ids[at]
        near, at = near[other], at[other]
        if not len(near):
            return
        distance = np.concatenate([
            np.round(np.sqrt(((x[near[i:i + BLOCK]] - points[at[i:i + BLOCK]]) ** 2).sum(1)), DECIMALS) for i in range(0, len(near), BLOCK)])
        q, n, d = (np.concatenate(pair) for pair in zip(self.found[c], (near, point_ids[at], distance)))
        sizes = np.bincount(q, minlength=len(x))
        most = int(sizes.max())
        even = len(x) * most <= 4 * MATRIX
        if most > self.k and even:
            # only the k-th distances are looked for; what is nearer is put in order at last
            order = np.argsort(q.astype(np.int16) if len(x) < 1 << 15 else q, kind="stable")
            q, n, d = q[order], n[order], d[order]
            table = np.full((len(x), most), np.inf)
            table[q, np.arange(len(q)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = d
            kth = np.partition(table, self.k - 1, axis=1)[:, self.k - 1]
            inside = d <= kth[q]
            q, n, d = q[inside], n[inside], d[inside]
            np.minimum(limit, kth, out=limit)                                 # a view of self.limit
        if most > self.k and (not even or len(q) > 2 * self.k * len(x)):
            q, n, d = nearest_first(q, n, d, self.k)
            last = np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1
            limit[q[last]] = np.minimum(limit[q[last]], d[last])
        self.found[c] = q, n, d

    def _best(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        for start, found in zip(range(0, len(self.ids), CHUNK), self.found):
            yield start, nearest_first(*found, self.k)

    def rows(self, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        for start, (q, n, d) in self._best():
            columns = [pa.array(self.ids[start + q], key_type), pa.array(n, key_type), pa.array(d, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "neighbour", "distance"])

    def lists(self, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query, neighbours, distances), the nearest first; a row for every query that has any."""
        for start, (q, n, d) in self._best():
            yield listed(self.ids[start + q], n, d, key_type)


def nearest_first(query: np.ndarray, neighbour: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different neighbours of every query, in order; `query`: whole numbers."""
    ranked = neighbour if neighbour.dtype.kind in "iuf" else np.unique(neighbour, return_inverse=True)[1]
    order = np.lexsort((ranked, distance, query))
    q, n, d = query[order], neighbour[order], distance[order]
    if len(q):
        again = np.r_[False, (q[1:] == q[:-1]) & (n[1:] == n[:-1]) & (d[1:] == d[:-1])]
        q, n, d = q[~again], n[~again], d[~again]
    inside = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[inside], n[inside], d[inside]


def listed(query: np.ndarray, neighbour: np.ndarray, distance: np.ndarray, key_type: pa.DataType) -> pa.RecordBatch:
    """One row of lists for each stretch of equal queries."""
    head = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, dtype=int)
    ends = pa.array(np.r_[head, len(query)], pa.int32())
    columns = [pa.array(query[head], key_type), pa.ListArray.from_arrays(ends, pa.array(neighbour, key_type)), pa.ListArray.from_arrays(ends, pa.array(distance, pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["query", "neighbours", "distances"])


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def _packed(rows: DataFrame, width: int, key_type: str, floats: bool) -> DataFrame:
    """(ids, vectors, bounds) of (id, vector, bound): some points a row, their vectors as one string of bytes."""
    each, kind = max(1, PACK // width), np.float32 if floats else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors_of(batch.column(1)).astype(kind) if batch.num_rows else np.zeros((0, width))
            starts = range(0, batch.num_rows, each)
            ends = pa.array([*starts, batch.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch.column(i)) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([lists[0], pa.array([x[s:s + each].tobytes() for s in starts], pa.binary()), lists[1]], names=["ids", "vectors", "bounds"])

    return rows.mapInArrow(pack, f"ids array<{key_type}>, vectors binary, bounds array<double>")


def _streamed(asking: DataFrame, points: DataFrame, shares: int, k: int, key_type: str, width: int, floats: bool) -> DataFrame:
    """(query, neighbour, distance): the k best of all points for every row of
    `asking` (id, vector, bound); all points pass every share of the queries."""
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shares)).cast("int")
    kind, schema = np.float32 if floats else np.float64, f"share int, kind int, ids array<{key_type}>, vectors binary, bounds array<double>"

    def one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = pa.array([v.tobytes() for v in vectors_of(batch.column(3)).astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], strings, batch.column(4)], names=["share", "kind", "ids", "vectors", "bounds"])

    queries = asking.select(share.alias("share"), F.lit(0).alias("kind"), F.array("id").alias("ids"), "vector", F.array("bound").alias("bounds")).mapInArrow(one_each, schema)
    passing = _packed(points.select("id", "vector", F.lit(None).cast("double").alias("bound")), width, key_type, floats).select(
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(1).alias("kind"), "ids", "vectors", "bounds")

    def taken(rows: list[pa.Table]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = pa.concat_tables(rows)
        x = np.frombuffer(b"".join(table.column("vectors").to_pylist()), dtype=kind)
        ids, bounds = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("ids", "bounds"))
        return ids, x.reshape(len(ids), width).astype(float), bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, waiting, best = None, [], [], None

        def see() -> None:
            nonlocal best, waiting
            if waiting and held:
                best = best or _Nearest(*taken(held), k)
                ids, x, _ = taken(waiting)
                best.see(ids, x)
            waiting = []

        def done() -> Iterator[pa.RecordBatch]:
            see()
            yield from best.rows(held[0].schema.field("ids").type.value_type) if best is not None else ()

        for batch in batches:
            number, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))       # in order, as the rows are
            heads = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (role[1:] != role[:-1])]) if len(number) else []
            for first, end in zip(heads, [*heads[1:], len(number)]):
                if number[first] != at:
                    yield from done()
                    at, held, waiting, best = number[first], [], [], None
                rows = pa.Table.from_batches([batch.slice(first, end - first)])
                if role[first] == 0:
                    held.append(rows)
                    continue
                for s in range(0, len(rows), STRIDE):
                    waiting.append(rows.slice(s, STRIDE))
                    if sum(map(len, waiting)) >= STRIDE:
                        see()
        yield from done()

    rows = queries.unionByName(passing).repartitionById(shares, F.col("share")).sortWithinPartitions("share", "kind")
    return rows.mapInArrow(run, f"query {key_type}, neighbour {key_type}, distance double")


def _slices(batches, pivots: int):
    """Batches so small that their distances to all pivots fit."""
    step = max(1, MATRIX // pivots)
    for frame in batches:
        for start in range(0, len(frame), step):
            yield frame.iloc[start:start + step]


def _distinct_neighbours(points: DataFrame, k: int, key_type: str) -> DataFrame:
    """(query, neighbour, distance) between points that all differ: (id, vector)."""
    floats = F.bool_and(F.col("vector").cast("array<float>").cast("array<double>") == F.col("vector"))
    first = points.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), floats.alias("floats")).first()
    total, width = first["n"], max(1, first["width"] or 0)
    pivots_wanted = max(1, min(MOST_PIVOTS, total // POINTS_PER_PIVOT))
    chosen = points.orderBy(F.xxhash64("id"), "id").limit(pivots_wanted).select("vector").collect()
    pivots = np.array([r["vector"] for r in chosen], dtype=float)
    shared = points.sparkSession.sparkContext.broadcast(pivots)           # at most MOST_PIVOTS vectors

    def assign(batches):
        for frame in _slices(batches, len(shared.value)):
            vectors = _vectors(frame["vector"])
            cell = _squared(vectors, shared.value).argmin(1).astype("int32")
            yield frame.assign(cell=cell, reach=np.sqrt(((vectors - shared.value[cell]) ** 2).sum(1)))

    data = cut(points.mapInPandas(assign, f"id {key_type}, vector array<double>, cell int, reach double"), "cells")
    stats = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()
    sizes = {r["cell"]: r["n"] for r in stats}
    inside = _best(_search(data.select("cell", F.col("id").alias("query"), "vector"), data, sizes, sizes, k, key_type), k)
    inside = cut(inside, "inside")
    if len(sizes) == 1:
        return inside.select("query", "neighbour", "distance")

    bound = inside.groupBy("query").agg(F.max("distance").alias("bound"), F.count("*").alias("found"))
    asking = (data.join(bound, F.col("id") == F.col("query"), "left")
              .select("id", "vector", "cell", F.when(F.col("found") == k, F.col("bound")).otherwise(float("inf")).alias("bound")))
    asking = cut(asking, "asking")
    radius = np.full(len(pivots), -np.inf)
    for r in stats:
        radius[r["cell"]] = r["radius"]
    radii = points.sparkSession.sparkContext.broadcast(radius)

    def asks(frame: pd.DataFrame) -> np.ndarray:
        """For every row, whether another cell may hold a nearer point."""
        own = frame["cell"].to_numpy()
        d2 = _squared(_vectors(frame["vector"]), shared.value)
        d = np.sqrt(d2)
        between = np.sqrt(_squared(shared.value[own], shared.value))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(between > 0, (d2 - d2[np.arange(len(own)), own][:, None]) / (2 * between), 0.0)
        least = np.maximum(d - radii.value[None, :], plane)
        ask = (least <= frame["bound"].to_numpy()[:, None] + 1e-7 * (1 + d)) & np.isfinite(radii.value)[None, :]
        ask[np.arange(len(own)), own] = False
        return ask

    def count(batches):
        found = np.zeros(len(shared.value), dtype=np.int64)
        for frame in _slices(batches, len(shared.value)):
            found += asks(frame).sum(0)
        cells = np.flatnonzero(found)
        if len(cells):
            yield pd.DataFrame({"cell": cells.astype("int32"), "n": found[cells]})

    def elsewhere(batches):
        """One row per other cell that may hold a nearer point."""
        for frame in _slices(batches, len(shared.value)):
            ids, vectors = frame["id"].to_numpy(), frame["vector"].to_numpy()
            at, cells = np.nonzero(asks(frame))
            for start in range(0, len(at), QUERIES):
                i, j = at[start:start + QUERIES], cells[start:start + QUERIES]
                yield pd.DataFrame({"cell": j.astype("int32"), "query": ids[i], "vector": vectors[i]})

    wanted = {r["cell"]: r["n"] for r in asking.mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    found = inside.select("query", "neighbour", "distance")
    if not wanted:
        return found
    shares = -(-total // max(BLOCK, min(SHARE_VALUES // width, total // SHARES)))
    if sum(n * -(-sizes[c] // BLOCK) for c, n in wanted.items()) > total * (shares + 1):
        return _streamed(asking, data, shares, k, key_type, width, bool(first["floats"]))
    asked = cut(asking.mapInPandas(elsewhere, f"cell int, query {key_type}, vector array<double>"), "asked")
    found = found.unionByName(_search(asked, data, sizes, wanted, k, key_type))
    return _best(found, k).select("query", "neighbour", "distance")


def knn_graph(ready: DataFrame, cols: list[str] | str, key: str, k: int) -> DataFrame:
    """(id, neighbour, rank, distance): the k nearest other rows of every row.

    `cols`: numerical columns, or the name of one array column."""
    return graph_of(ready, cols, key, k, _distinct_neighbours)


def graph_of(ready: DataFrame, cols: list[str] | str, key: str, k: int, between: Callable[[DataFrame, int, str], DataFrame]) -> DataFrame:
    """The graph of all rows by a search `between` points that all differ."""
    key_type = dict(ready.dtypes)[key]
    if isinstance(cols, str):
        vector = F.transform(col(cols).cast("array<double>"), lambda x: x + F.lit(0.0))
    else:
        vector = F.array(*[col(c).cast("double") + F.lit(0.0) for c in cols])
    rows = cut(ready.select(col(key).alias("id"), vector.alias("vector")), "points")
    # Of equal points only the k + 1 smallest keys can be anyone's neighbours.
    copies = Window.partitionBy("vector").orderBy("id")
    members = (rows.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
               .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("members")))
    members = cut(members.select(F.col("members")[0].alias("id"), "vector", "members"), "distinct")
    apart = between(members.select("id", "vector"), k, key_type)
    near = (apart.join(members.select(F.col("id").alias("neighbour"), "members"), "neighbour")
            .select(F.col("query").alias("first"), F.explode("members").alias("id"), "distance"))
    own = members.select(F.col("id").alias("first"), F.explode("members").alias("id"), F.lit(0.0).alias("distance"))
    order = Window.partitionBy("first").orderBy("distance", "id")
    lists = (own.unionByName(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
             .groupBy("first").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near")))
    of_vector = members.select(F.col("id").alias("first"), "vector").join(lists, "first").select("vector", "near")
    others = F.filter("near", lambda x: x["id"] != F.col("id"))
    picked = F.slice(others, 1, k)
    return (rows.join(of_vector, "vector").select("id", F.posexplode(picked).alias("at", "x"))
            .select("id", F.col("x.id").alias("neighbour"), (F.col("at") + 1).alias("rank"), F.col("x.distance").alias("distance")))
