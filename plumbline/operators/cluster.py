"""K-means clusters and the colouring column built from them.

All restarts run together: a round is one scan of the vectors, whatever their
number, in which each task assigns its rows for every restart and adds up
restarts x clusters vectors. Seeds are drawn in rounds by distance from the
seeds so far; a task keeps the few rows that win a race with such odds, so
drawing costs one scan a round and nothing of the rows leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.reduce import prepared
from plumbline.session import cut, ship
from plumbline.settings import DEFAULTS, Settings

ship(__name__)

SEED_ROUNDS = 5
SEEDS = 2                 # seeds drawn a round, times the clusters
SETTLED = 1e-4            # a restart ends when no centre moves farther


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.vstack(frame["v"].to_numpy())


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T)


def _chances(lots: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1), the same for a row on every run."""
    x = lots.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2 ** 53 + 2.0 ** -54


def _drawn(vectors: DataFrame, seeds: list[np.ndarray], wanted: int, seed: int) -> list[np.ndarray]:
    """For every restart its seeds and `wanted` more, with odds by squared distance."""
    def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, list[float]]]] = [[] for _ in seeds]
        for frame in batches:
            if frame.empty:
                continue
            x, lots = _matrix(frame), frame["lot"].to_numpy()
            for i, known in enumerate(seeds):
                odds = _squared(x, known).min(1) if len(known) else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    time = np.where(odds > 1e-12, -np.log(_chances(lots, seed * 1000 + i)) / odds, np.inf)
                first = np.argsort(time, kind="stable")[:wanted]
                best[i] = sorted([*best[i], *((float(time[j]), x[j].tolist()) for j in first if np.isfinite(time[j]))])[:wanted]
        rows = [(i, t, v) for i, found in enumerate(best) for t, v in found]
        if rows:                      # a task may be empty, or hold nothing but copies of seeds
            yield pd.DataFrame({"restart": [r[0] for r in rows], "time": [r[1] for r in rows], "v": [r[2] for r in rows]})

    found = vectors.mapInPandas(race, "restart int, time double, v array<double>").collect()       # wanted x restarts rows a task
    out = []
    for i, known in enumerate(seeds):
        first = sorted((r["time"], list(r["v"])) for r in found if r["restart"] == i)[:wanted]
        fresh = [v for _, v in first]
        out.append(np.vstack([known, fresh]) if len(known) and fresh else np.array(fresh) if fresh else known)
    return out


def _sums(vectors: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For every restart, from one scan: sums and counts of its clusters, and the cost."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros_like(c) for c in centres]
        count, cost = [np.zeros(len(c)) for c in centres], [0.0] * len(centres)
        for frame in batches:
            if frame.empty:
                continue
            x = _matrix(frame)
            for i, at in enumerate(centres):
                d = _squared(x, at)
                own = d.argmin(1)
                np.add.at(total[i], own, x)
                count[i] += np.bincount(own, minlength=len(at))
                cost[i] += float(d[np.arange(len(x)), own].sum())
        rows = [(i, c, total[i][c].tolist(), count[i][c], cost[i] if c == 0 else 0.0) for i, at in enumerate(centres) for c in range(len(at))]
        yield pd.DataFrame(rows, columns=["restart", "cluster", "total", "n", "cost"])

    partial = vectors.mapInPandas(add, "restart int, cluster int, total array<double>, n double, cost double")
    parts = partial.select("restart", "cluster", "n", "cost", F.posexplode("total").alias("dim", "x"))
    found = parts.groupBy("restart", "cluster", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    out = [(np.zeros_like(c), np.zeros(len(c)), 0.0) for c in centres]
    costs = [0.0] * len(centres)
    for r in found:
        total, count, _ = out[r["restart"]]
        total[r["cluster"], r["dim"]] = r["x"]
        count[r["cluster"]] = r["n"]
        if r["dim"] == 0:
            costs[r["restart"]] += r["cost"]
    return [(t, n, costs[i]) for i, (t, n, _) in enumerate(out)]


def _chosen(seeds: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted seeds, each with odds by weight and squared distance from those before."""
    picked = [int(rng.choice(len(seeds), p=weights / weights.sum()))]
    while len(picked) < min(k, len(seeds)):
        odds = weights * _squared(seeds, seeds[picked]).min(1)
        if odds.sum() <= 0:
            break
        picked.append(int(rng.choice(len(seeds), p=odds / odds.sum())))
    return seeds[picked]


def lloyd(vectors: DataFrame, k: int, restarts: int, rounds: int, seed: int) -> np.ndarray:
    """The centres of the cheapest of several runs over (lot, v), all of them in one scan a round."""
    seeds = _drawn(vectors, [np.zeros((0, 0))] * restarts, 1, seed)
    for turn in range(1, SEED_ROUNDS + 1):
        seeds = _drawn(vectors, seeds, SEEDS * k, seed + turn)
    rng = np.random.default_rng(seed)
    centres = [_chosen(s, np.maximum(n, 1e-9), k, rng) for s, (_, n, _) in zip(seeds, _sums(vectors, seeds))]
    running, best = list(range(restarts)), (np.inf, centres[0])
    for turn in range(rounds + 1):
        found = _sums(vectors, [centres[i] for i in running])
        going = []
        for i, (total, count, cost) in zip(running, found):
            mean = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres[i])
            if cost < best[0]:
                best = cost, centres[i]
            if turn < rounds and np.sqrt(((mean - centres[i]) ** 2).sum(1)).max() > SETTLED:
                going.append(i)
            centres[i] = mean
        running = going
        if not running:
            break
    return best[1]


def kmeans_clusters(df: DataFrame, cols: list[str], keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Keys and `cluster`: the cheapest of several K-means runs on prepared columns.

    Clusters are numbered by the order of their centres, so that the labels do
    not depend on the winning run. Without columns everything is cluster 0.
    """
    if not cols:
        return df.select(*[col(k) for k in keys], F.lit(0).alias("cluster"))
    ready = prepared(df, cols, keys, settings)
    names = [f"k{i}" for i in range(len(keys))]
    vectors = cut(ready.select(*[col(k).alias(n) for k, n in zip(keys, names)], F.array(*[col(c) for c in cols]).alias("v")).withColumn("lot", F.xxhash64(*names)), "vectors")
    k = max(1, min(settings.clusters, vectors.select(F.lit(1)).limit(settings.clusters).count()))
    if k < 2:
        return vectors.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], F.lit(0).alias("cluster"))
    centres = lloyd(vectors.select("lot", "v"), k, settings.cluster_restarts, settings.cluster_rounds, settings.sample_seed)
    centres = centres[np.lexsort(np.round(centres, 9).T[::-1])]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if not frame.empty:
                frame["cluster"] = _squared(_matrix(frame), centres).argmin(1).astype("int32")
                yield frame[[*names, "cluster"]]

    kinds = dict(vectors.dtypes)
    found = vectors.select(*names, "v").mapInPandas(label, ", ".join(f"{n} {kinds[n]}" for n in names) + ", cluster int")
    return found.select(*[F.col(n).alias(c) for c, n in zip(keys, names)], "cluster")


def hue_column(df: DataFrame, keys: list[str], target: str | None, cols: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Keys and `hue`: the target if there is one, else the cluster."""
    if target is not None:
        return df.select(*[col(k) for k in keys], col(target).alias("hue"))
    return kmeans_clusters(df, cols, keys, settings).withColumnRenamed("cluster", "hue")
