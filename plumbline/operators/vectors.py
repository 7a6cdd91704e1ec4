"""Principal components of wide vectors that stay arrays.

No plan has a column per dimension and no covariance matrix of width x width is
formed. A random block of directions is multiplied by the data again and again;
the blocks together span a Krylov space, in which the components are found. A
round is one scan: each task multiplies its rows with the block and back and
adds up width x block numbers, which are summed by dimension. What reaches the
driver is the block, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.session import InputError, ship

ship(__name__)

SPARE = 8                 # directions beside the wanted components
ROUNDS = 12               # blocks of the Krylov space, at most
SETTLED = 1e-10           # relative change of the wanted variances that ends the rounds


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column(0).flatten()
    if len(flat) != batch.num_rows * width or flat.null_count:
        raise ValueError(f"every vector needs {width} components, none of them missing")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _summed(df: DataFrame, vector: str, width: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `of` (a matrix of `shape`) over all tasks' blocks of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + of(_rows(batch, width)), True
        if seen:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, total.size + 1, shape[1]), pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), lists], names=["line", "sums"])

    lines = df.select(col(vector).cast("array<double>").alias("v")).mapInArrow(run, "line int, sums array<double>")
    cells = lines.select("line", F.posexplode("sums").alias("place", "x")).groupBy("line", "place").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda c: c["x"]).alias("sums"))
    out = np.zeros(shape)
    for r in whole.collect():                            # shape[0] rows of shape[1] numbers
        out[r["line"]] = r["sums"]
    return out


def width_of(df: DataFrame, vector: str) -> int:
    """The number of components of every vector; InputError if they differ."""
    sizes = df.select(F.size(col(vector)).alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("rows")).first()
    if sizes["rows"] and (sizes["least"] != sizes["most"] or sizes["least"] < 0):
        raise InputError(f"the vectors of '{vector}' have between {sizes['least']} and {sizes['most']} components")
    return sizes["most"] or 0


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and population variances of the dimensions."""
    width = width_of(df, vector)
    if not width:
        return 0, np.zeros(0), np.zeros(0)
    first = _summed(df, vector, width, (2, width), lambda x: np.stack([x.sum(0), np.full(width, float(len(x)))]))
    n = first[1, 0]
    mean = first[0] / max(n, 1)
    spread = _summed(df, vector, width, (1, width), lambda x: ((x - mean) ** 2).sum(0)[None])
    return int(n), mean, spread[0] / max(n, 1)


def standardise_vectors(df: DataFrame, vector: str, keys: list[str] = ()) -> DataFrame:
    """Keys and the vectors with mean 0 and deviation 1 in each dimension; constant dimensions become 0."""
    _, mean, variance = moments(df, vector)
    scale = np.where(variance > 0, 1 / np.sqrt(np.where(variance > 0, variance, 1)), 0.0)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_rows(batch.select([at]), len(mean)) - mean) * scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, len(mean)))[: len(x) + 1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists], names=batch.schema.names)

    chosen = df.select(*[col(k) for k in keys], col(vector).cast("array<double>").alias(vector))
    return chosen.mapInArrow(run, chosen.schema)


def principal_axes(df: DataFrame, vector: str, components: int, seed: int = 42) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Explained-variance ratios, loadings (width x components) and means of the vectors.

    Each component points to its largest loading."""
    n, mean, variance = moments(df, vector)
    width = len(mean)
    k = min(components, n, width) if n > 1 else 0
    if k == 0:
        return [], np.zeros((width, 0)), mean
    total = variance.sum()
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + SPARE))))[0]
    space, image, known = np.zeros((width, 0)), np.zeros((width, 0)), None
    for _ in range(ROUNDS):
        product = _summed(df, vector, width, block.shape, lambda x, b=block: (x - mean).T @ ((x - mean) @ b)) / n
        space, image = np.hstack([space, block]), np.hstack([image, product])
        # the covariance as the space sees it
        small = space.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        best = np.argsort(values)[::-1][:k]
        values, axes = values[best], space @ turns[:, best]
        if space.shape[1] >= width or known is not None and np.abs(values - known).max() <= SETTLED * max(values[0], 1e-300):
            break
        known = values
        rest = product - space @ (space.T @ product)
        rest -= space @ (space.T @ rest)
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        block = left[:, size > 1e-10 * max(float(np.abs(values).max()), 1e-300)][:, :width - space.shape[1]]
        if not block.shape[1]:
            break
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    ratios = [float(max(v, 0.0) / total) if total > 0 else 0.0 for v in values]
    return ratios, axes * np.where(signs == 0, 1, signs), mean


def scores(df: DataFrame, vector: str, keys: list[str], loadings: np.ndarray, mean: np.ndarray, names: list[str]) -> DataFrame:
    """Keys and one column for each axis: the centred vectors' products with it."""
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (_rows(batch.select([at]), len(mean)) - mean) @ loadings
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(found[:, j]) for j in range(len(names)))], names=[*batch.schema.names[:at], *names])

    chosen = df.select(*[col(k) for k in keys], col(vector).cast("array<double>").alias("v"))
    schema = ", ".join([f"`{n}` {t}" for n, t in chosen.dtypes[:at]] + [f"`{n}` double" for n in names])
    return chosen.mapInArrow(run, schema)
