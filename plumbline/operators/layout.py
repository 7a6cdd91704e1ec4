"""Two-dimensional layouts of a neighbour graph: t-SNE and UMAP.

Both are laws of force that `descent` applies block by block: edges of the graph
pull exactly, all other points push, those of other blocks as quadtree cells.
Positions start from the principal components and a hash of the key, so a run
repeats exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.operators.descent import BLOCK, Block, settle
from plumbline.operators.forest import Search, knn_graph_approximate
from plumbline.operators.neighbours import knn_graph
from plumbline.operators.reduce import pca_embedding
from plumbline.session import cut, ship
from plumbline.settings import DEFAULTS, Settings

ship(__name__)

STEPS = 64                # halvings of each bandwidth search
EXAGGERATION = 12.0
TSNE_ROUNDS = 25          # rounds between exchanges
TSNE_BLOCK = 2048         # points of a block; of wide vectors' neighbours most are outside a small one, and stand still between exchanges
MATRIX = 1 << 18          # kernels computed at once
FORCES = 1 << 15          # pushes computed at once
UMAP_ROUNDS = 10
REPEL_RATE = 5.0
LEAST_SIGMA = 1e-3


def _lists(graph: DataFrame) -> DataFrame:
    """(id, neighbours, distances): at most k entries a row."""
    near = F.sort_array(F.collect_list(F.struct("rank", "neighbour", "distance")))
    return graph.groupBy("id").agg(near.alias("near")).select(
        "id", F.transform("near", lambda x: x["neighbour"]).alias("neighbours"), F.transform("near", lambda x: x["distance"]).alias("distances"))


def _weighted(graph: DataFrame, weigh) -> DataFrame:
    """(id, neighbour, weight) with `weigh` turning a row's distances into its weights."""
    def rows(batches):
        for frame in batches:
            sizes = frame["distances"].map(len).to_numpy()
            weights = np.empty(len(frame), dtype=object)
            for n in np.unique(sizes):                        # rows of one length are weighed at once
                alike = np.flatnonzero(sizes == n)
                weights[alike] = list(weigh(np.stack(frame["distances"].to_numpy()[alike]).astype(float)))
            frame["weights"] = weights
            yield frame[["id", "neighbours", "weights"]]

    key = dict(graph.dtypes)["id"]
    listed = _lists(graph).mapInPandas(rows, f"id {key}, neighbours array<{key}>, weights array<double>")
    pairs = F.arrays_zip(F.col("neighbours").alias("neighbour"), F.col("weights").alias("weight"))
    return listed.select("id", F.inline(pairs))


def perplexity_weights(distances: np.ndarray, perplexity: float) -> np.ndarray:
    """Gaussian neighbour probabilities whose entropy is log(perplexity), of a row of distances or of many rows."""
    d2 = np.atleast_2d(distances) ** 2
    d2 = d2 - d2.min(1, initial=np.inf if d2.shape[1] else 0.0)[:, None]
    out, live = np.zeros(d2.shape), np.arange(len(d2))
    low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
    for _ in range(STEPS):
        p = np.exp(-d2 * beta[:, None])
        total = p.sum(1)
        out[live] = p / total[:, None]
        entropy = np.log(total) + beta * (d2 * p).sum(1) / total
        going = ~(np.abs(entropy - np.log(perplexity)) < 1e-5)
        more = entropy > np.log(perplexity)
        low, high = np.where(more, beta, low), np.where(more, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
        d2, live, low, high, beta = (a[going] for a in (d2, live, low, high, beta))
        if not len(live):
            break
    return out.reshape(np.shape(distances))


def fuzzy_weights(distances: np.ndarray, neighbours: int) -> np.ndarray:
    """Membership of each neighbour: 1 at the nearest, decaying so that they add up to log2(neighbours); of a row of distances or of many rows."""
    rows = np.atleast_2d(distances)
    rho = np.where(rows > 0, rows, np.inf).min(1, initial=np.inf)
    beyond = np.maximum(0.0, rows - np.where(np.isinf(rho), 0.0, rho)[:, None])
    sigmas, live, part = np.ones(len(rows)), np.arange(len(rows)), beyond
    low, high, sigma = np.zeros(len(rows)), np.full(len(rows), np.inf), np.ones(len(rows))
    for _ in range(STEPS):
        total = np.exp(-part / sigma[:, None]).sum(1)
        going = ~(np.abs(total - np.log2(neighbours)) < 1e-5)
        more = total > np.log2(neighbours)
        low, high = np.where(more, low, sigma), np.where(more, sigma, high)
        sigma = np.where(going, np.where(np.isinf(high), sigma * 2, (low + high) / 2), sigma)
        sigmas[live] = sigma
        part, live, low, high, sigma = (a[going] for a in (part, live, low, high, sigma))
        if not len(live):
            break
    # The row's mean counts the point itself, at distance 0.
    sigmas = np.maximum(sigmas, LEAST_SIGMA * rows.sum(1) / (rows.shape[1] + 1))[:, None]
    spread = np.exp(-beyond / np.where(sigmas > 0, sigmas, 1.0))
    return np.where(sigmas > 0, spread, 1.0).reshape(np.shape(distances))


def tsne_affinities(graph: DataFrame, perplexity: float) -> DataFrame:
    """(id, neighbour, weight): symmetric joint probabilities, adding up to 1."""
    one_way = _weighted(graph, lambda d: perplexity_weights(d, perplexity))
    both = one_way.unionByName(one_way.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), "weight"))
    joint = cut(both.groupBy("id", "neighbour").agg(F.sum("weight").alias("weight")), "affinities")
    total = joint.agg(F.sum("weight")).first()[0]
    return joint.withColumn("weight", F.col("weight") / total)


def umap_weights(graph: DataFrame, neighbours: int) -> DataFrame:
    """(id, neighbour, weight): fuzzy union a + b - ab of both directions."""
    one_way = _weighted(graph, lambda d: fuzzy_weights(d, neighbours))
    there = one_way.select("id", "neighbour", F.col("weight").alias("a"), F.lit(0.0).alias("b"))
    back = one_way.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), F.lit(0.0).alias("a"), F.col("weight").alias("b"))
    sides = there.unionByName(back).groupBy("id", "neighbour").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return cut(sides.select("id", "neighbour", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight")), "fuzzy")


def started(ready: DataFrame, cols: list[str] | str, key: str, extent: float, noise: float, by_spread: bool) -> DataFrame:
    """(id and STATE): the first two components, scaled, with a little noise that
    tells equal rows apart. `by_spread`: `extent` is the deviation, else the reach."""
    scores = pca_embedding(ready, cols, [key], ("x", "y"))
    scores = scores.withColumns({c: F.lit(0.0) for c in "xy" if c not in scores.columns})
    size = F.stddev_pop("x") if by_spread else F.max(F.greatest(F.abs("x"), F.abs("y")))
    scale = extent / (scores.agg(size).first()[0] or 1.0)
    shaken = [(F.col(c) * scale + F.xxhash64(col(key), F.lit(c)) / 2.0 ** 63 * noise).alias(c) for c in "xy"]
    return scores.select(col(key).alias("id"), *shaken, *[F.lit(0.0).alias(c) for c in ("vx", "vy")], *[F.lit(1.0).alias(c) for c in ("gx", "gy")], F.lit(0.0).alias("z"))


def _graph(ready: DataFrame, cols: list[str] | str, key: str, k: int, exact: bool) -> DataFrame:
    return cut(knn_graph(ready, cols, key, k) if exact else knn_graph_approximate(ready, cols, key, k, Search(floats=True)), "knn")


def exchanges(rounds: int, each: int) -> list[int]:
    """Rounds between exchanges, adding up to `rounds`."""
    return [each] * (rounds // each) + ([rounds % each] if rounds % each else [])


# --- t-SNE ---------------------------------------------------------------------------

class Attraction:
    """Student-t forces: edges pull, all points push, in a share of their total."""

    def __init__(self, rows: int, early: int, total: float):
        self.early, self.rate = early, max(rows / EXAGGERATION / 4, 50.0)
        self.total = total if total > 0 else rows * max(rows - 1.0, 1.0)           # at first all points are in one place

    def run(self, own: Block, turn: int, rounds: int) -> np.ndarray:
        y, speed, gain, z = own.state[:, 0:2].copy(), own.state[:, 2:4].copy(), own.state[:, 4:6].copy(), own.state[:, 6].copy()
        first = None
        for i in range(turn, turn + rounds):
            push, z = repulsion(y, own.cells)
            # the total changes as this block's part of it does
            first = z.sum() if first is None else first
            total = max(self.total * z.sum() / first if first > 0 else self.total, 1e-12)
            gx, gy = own.pulls(y)
            force = own.weight / (1 + (gx * gx + gy * gy))
            pull = own.per_point(force * gx, force * gy)
            slope = 4 * ((EXAGGERATION if i < self.early else 1.0) * pull - push / total)
            moving = speed != 0
            gain = np.maximum(0.01, np.where(moving & (speed * slope >= 0), gain * 0.8, gain + np.where(moving, 0.2, 0.0)))
            speed = (0.5 if i < self.early else 0.8) * speed - self.rate * gain * slope
            y = y + speed
        return np.column_stack([y, speed, gain, z])


def repulsion(y: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of kernel^2 x gap over all other points, and of the kernel, per point."""
    middle = y.mean(0)
    own, others = y - middle, np.vstack([y, cells[:, 1:]]) - middle
    count = np.concatenate([np.ones(len(y)), cells[:, 0]])
    squares = np.column_stack([-2 * others, np.ones(len(others)), (others * others).sum(1)]).T
    moments = np.column_stack([count, count[:, None] * others])
    push, z = np.zeros_like(y), np.zeros(len(y))
    step = max(1, MATRIX // len(others))
    for start in range(0, len(y), step):
        part = own[start:start + step]
        kernel = np.column_stack([part, 1 + (part * part).sum(1), np.ones(len(part))]) @ squares
        np.reciprocal(kernel, out=kernel)
        z[start:start + step] = kernel @ count - 1             # a point's own kernel is 1
        kernel *= kernel
        sums = kernel @ moments
        push[start:start + step] = sums[:, :1] * part - sums[:, 1:]
    return push, z


def tsne(ready: DataFrame, cols: list[str] | str, key: str, settings: Settings = DEFAULTS, iterations: int | None = None, exact: bool = False, block: int = TSNE_BLOCK) -> DataFrame:
    """(key, tsne1, tsne2) of prepared columns, starting from their principal components.

    `exact` takes the exact neighbours instead of the approximate ones."""
    rows = ready.count()
    perplexity = min(settings.tsne_perplexity, max(1.0, (rows - 1) / 3.1))
    edges = cut(tsne_affinities(_graph(ready, cols, key, max(1, min(rows - 1, int(3 * perplexity + 1))), exact), perplexity), "edges")
    rounds = settings.tsne_iterations if iterations is None else iterations
    early = min(250, rounds // 4)
    schedule = exchanges(early, TSNE_ROUNDS) + exchanges(rounds - early, TSNE_ROUNDS)
    placed = settle(edges, started(ready, cols, key, 1e-4, 1e-6, True), rows, lambda total: Attraction(rows, early, total), schedule, block)
    return placed.select(F.col("id").alias(key), F.col("x").alias("tsne1"), F.col("y").alias("tsne2"))


# --- UMAP ----------------------------------------------------------------------------

def curve_parameters(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to a plateau up to min_dist with an exponential tail."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    wanted = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b, damping = 1.0, 1.0, 1e-3
    error = lambda a, b: ((1 / (1 + a * d ** (2 * b)) - wanted) ** 2).sum()
    for _ in range(200):
        power = d ** (2 * b)
        value = 1 / (1 + a * power)
        jacobian = np.stack([-value ** 2 * power, -value ** 2 * a * power * 2 * np.log(d)], 1)
        step = np.linalg.solve(jacobian.T @ jacobian + damping * np.eye(2), jacobian.T @ (wanted - value))
        if error(a + step[0], b + step[1]) < error(a, b):
            a, b, damping = a + step[0], b + step[1], damping / 3
        else:
            damping *= 3
    return float(a), float(b)


class Membership:
    """Fuzzy-set forces: edges pull in proportion to their weight, the average other point pushes."""

    def __init__(self, rows: int, rounds: int, a: float, b: float):
        self.others, self.rounds, self.a, self.b = max(1, rows - 1), rounds, a, b

    def pushes(self, y: np.ndarray, others: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Sums over all others of what each pushes."""
        out = np.zeros_like(y)
        step = max(1, FORCES // max(1, len(others)))
        for start in range(0, len(y), step):
            dx, dy = (y[start:start + step, c][:, None] - others[:, c] for c in range(2))
            d2 = dx * dx + dy * dy
            force = np.maximum(d2, 1e-12)
            np.power(force, self.b, out=force)
            force *= self.a
            force += 1
            d2 += 0.001
            force *= d2
            np.divide(2.0 * self.b, force, out=force)
            for c, gap in enumerate((dx, dy)):
                gap *= force
                out[start:start + step, c] = np.clip(gap, -4.0, 4.0, out=gap) @ count
        return out

    def run(self, own: Block, turn: int, rounds: int) -> np.ndarray:
        y = own.state[:, 0:2].copy()
        n, a, b = len(y), self.a, self.b
        share = own.weight / np.maximum(np.bincount(own.of, own.weight, n)[own.of], 1e-300)
        count = np.concatenate([np.ones(n), own.cells[:, 0]])
        for i in range(turn, turn + rounds):
            gx, gy = own.pulls(y)
            d2 = np.maximum(gx * gx + gy * gy, 1e-12)
            force = -2.0 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b)
            pull = own.per_point(*(share * np.clip(force * gap, -4.0, 4.0) for gap in (gx, gy)))
            push = self.pushes(y, np.vstack([y, own.cells[:, 1:]]), count)
            y = y + 0.25 * (1 - i / self.rounds) * (2 * pull + REPEL_RATE * push / self.others)
        return np.column_stack([y, own.state[:, 2:]])


def umap(ready: DataFrame, cols: list[str] | str, key: str, settings: Settings = DEFAULTS, rounds: int = 200, exact: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, umap1, umap2) of prepared columns, starting from their principal components.

    `exact` takes the exact neighbours instead of the approximate ones."""
    rows = ready.count()
    neighbours = max(2, min(settings.umap_neighbours, rows - 1))
    # A point counts as its own first neighbour.
    edges = umap_weights(_graph(ready, cols, key, neighbours - 1, exact), neighbours)
    law = Membership(rows, rounds, *curve_parameters(settings.umap_min_dist))
    placed = settle(edges, started(ready, cols, key, 10.0, 1e-4, False), rows, law, exchanges(rounds, UMAP_ROUNDS), block)
    return placed.select(F.col("id").alias(key), F.col("x").alias("umap1"), F.col("y").alias("umap2"))


def preserved(graph: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """One row: points, and the share of their neighbours in `graph` that are
    among as many nearest points of the layout `placed` (key and two columns)."""
    k = graph.agg(F.max("rank")).first()[0] or 1
    flat = knn_graph(placed, [c for c in placed.columns if c != key], key, k).select("id", "neighbour", F.lit(1).alias("kept"))
    return graph.join(flat, ["id", "neighbour"], "left").agg(
        F.countDistinct("id").alias("points"), F.avg(F.coalesce("kept", F.lit(0))).alias("share"))
