"""Preparation, components, clusters, charts and layouts."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cluster, descent, forest, layout, neighbours, plotdata, profile, reduce, vectors
from plumbline.session import InputError, Rewritten, cut
from plumbline.settings import Settings


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(30, 5)) + c for c in ([0] * 5, [9] * 5, [0, 9, 0, 9, 0])])
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, a double, b double, c double, d double, e double")


COLS = list("abcde")


def test_impute_and_standardise(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, None, 5.0), (3, 2.0, 5.0), (4, 9.0, 5.0)], "k int, a double, flat double")
    assert [r["a"] for r in reduce.impute(df, ["a"], "median", ["k"]).orderBy("k").collect()] == [1.0, 2.0, 2.0, 9.0]
    assert [r["a"] for r in reduce.impute(df, ["a"], "mean", ["k"]).orderBy("k").collect()] == [1.0, 4.0, 2.0, 9.0]
    with pytest.raises(InputError):
        reduce.impute(df, ["a"], "mode")
    rows = reduce.prepared(df, ["a", "flat"], ["k"]).collect()
    assert sum(r["a"] for r in rows) == pytest.approx(0) and sum(r["a"] ** 2 for r in rows) == pytest.approx(4)
    assert {r["flat"] for r in rows} == {0.0}


def test_components(spark, cloud):
    ready = reduce.prepared(cloud, COLS, ["k"])
    ratios = [r["ratio"] for r in reduce.pca_variance(ready, COLS).collect()]
    assert len(ratios) == 5 and ratios == sorted(ratios, reverse=True) and sum(ratios) == pytest.approx(1)
    scores = reduce.pca_embedding(ready, COLS, ["k"]).toPandas().sort_values("k")
    x = ready.toPandas().sort_values("k")[COLS].to_numpy()
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    for j in range(2):
        axis = axes[j] * np.sign(axes[j][np.abs(axes[j]).argmax()])
        assert scores[f"pc{j + 1}"].to_numpy() == pytest.approx(x @ axis)


def test_components_of_wide_vectors(spark):
    """1,536 dimensions as an array: no plan of 1,536 columns; the components are those of a full decomposition."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)) * [9, 7, 5, 4, 3, 2] @ rng.normal(size=(6, 1536)) + rng.normal(size=(300, 1536)) * 0.3 + 5
    df = cut(spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "k long, v array<double>").repartition(5), "wide")
    ratios, axes, mean = vectors.principal_axes(df, "v", 4)
    centred = x - x.mean(0)
    _, size, true = np.linalg.svd(centred, full_matrices=False)
    assert ratios == pytest.approx(list(size[:4] ** 2 / (size ** 2).sum()), rel=1e-8) and mean == pytest.approx(x.mean(0))
    true = true[:4].T * np.sign(true[:4].T[np.abs(true[:4].T).argmax(0), range(4)])
    assert np.abs(axes - true).max() < 1e-5
    found = reduce.pca_embedding(df, "v", ["k"])
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 5000
    rows = found.toPandas().sort_values("k")
    assert np.allclose(rows[["pc1", "pc2"]].to_numpy(), centred @ true[:, :2], atol=1e-3)
    ready = vectors.standardise_vectors(df, "v", ["k"]).toPandas().sort_values("k")
    assert np.allclose(np.vstack(ready["v"]), centred / x.std(0))


def test_vectors_of_few_rows_and_dimensions(spark):
    make = lambda rows: spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, v array<double>")
    assert vectors.principal_axes(make([[1.0, 2.0]]), "v", 2)[0] == [] and vectors.principal_axes(make([]), "v", 2)[0] == []
    ratios, axes, _ = vectors.principal_axes(make([[1.0, 2.0], [1.0, 4.0], [1.0, 9.0]]), "v", 2)
    assert ratios == pytest.approx([1.0, 0.0]) and axes[:, 0] == pytest.approx([0.0, 1.0])
    flat = vectors.standardise_vectors(make([[1.0, 2.0], [1.0, 4.0]]), "v", ["k"]).orderBy("k").collect()
    assert [r["v"] for r in flat] == [[0.0, -1.0], [0.0, 1.0]]
    with pytest.raises(InputError):
        vectors.moments(make([[1.0], [1.0, 2.0]]), "v")


def test_layouts_of_array_columns(spark, cloud):
    ready = vectors.standardise_vectors(cloud.select("k", F.array(*COLS).alias("v")), "v", ["k"])
    flat = layout.umap(ready, "v", "k", rounds=30).toPandas().sort_values("k")[["umap1", "umap2"]].to_numpy()
    high = np.vstack(ready.toPandas().sort_values("k")["v"])
    assert np.isfinite(flat).all() and preserved(high, flat) > 0.4


def test_features_leave_out_constants_and_target(spark):
    df = spark.createDataFrame([(i % 40, float(i % 30), 1.0, i % 35) for i in range(200)], "a int, b double, flat double, t int")
    light = profile.light_profile(df)
    assert reduce.feature_names(light, "t") == ["a", "b"]


def test_clusters_are_found_and_numbered_by_centre(spark, cloud):
    rows = cluster.kmeans_clusters(cloud, COLS, ["k"], Settings(clusters=3, cluster_restarts=4)).orderBy("k").collect()
    labels = [r["cluster"] for r in rows]
    assert [len(set(labels[i:i + 30])) for i in (0, 30, 60)] == [1, 1, 1] and len(set(labels)) == 3
    assert cluster.kmeans_clusters(cloud.limit(1), COLS, ["k"]).first()["cluster"] == 0
    assert {r["cluster"] for r in cluster.kmeans_clusters(cloud, [], ["k"]).collect()} == {0}


def test_tasks_without_new_seeds(spark):
    """Empty tasks, and tasks that hold only copies of the seeds."""
    df = spark.range(40, numPartitions=4).selectExpr("id AS k", "id div 20 * 5.0 AS a").repartitionByRange(8, "a")
    rows = cluster.kmeans_clusters(df, ["a"], ["k"]).collect()
    assert {(r["k"] // 20, r["cluster"]) for r in rows} == {(0, 0), (1, 1)} and len(rows) == 40


def test_restarts_share_their_scans(spark, cloud, monkeypatch):
    """Rows are read once a round, however many runs there are, and the best of them is as good as any."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(60, 2)) + c for c in ([0, 0], [12, 0], [0, 12], [12, 12], [30, 30])] + [np.zeros((20, 2))])
    vectors = cut(spark.createDataFrame([(int(rng.integers(-2 ** 63, 2 ** 63)), [float(a) for a in p]) for p in x], "lot long, v array<double>").repartition(6), "lots")
    cost = lambda centres: ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()
    scans = []
    kind, plain = type(vectors), type(vectors).mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", lambda self, *a, **b: (scans.append(1), plain(self, *a, **b))[1])
    for restarts in (1, 6):
        scans.clear()
        centres = cluster.lloyd(vectors, 5, restarts, 8, 42)
        assert len(scans) <= 1 + cluster.SEED_ROUNDS + 1 + 8 + 1
        assert centres.shape == (5, 2)
    groups = [x[i * 60:(i + 1) * 60] for i in range(4)] + [x[240:300]]
    groups[0] = np.vstack([groups[0], x[300:]])
    assert cost(centres) <= 1.001 * sum(((g - g.mean(0)) ** 2).sum() for g in groups)


def test_histogram_counts_everything(spark):
    df = spark.range(1000).select((F.col("id") % 97).cast("double").alias("x"), F.lit(3.0).alias("flat"))
    rows = plotdata.histogram(df, ["x", "flat"]).collect()
    values = np.arange(1000) % 97
    counts, edges = np.histogram(values.astype(float), bins="auto")
    found = sorted((r for r in rows if r["column_name"] == "x"), key=lambda r: r["bin"])
    assert [r["count"] for r in found] == list(counts)
    assert [r["low"] for r in found] == pytest.approx(list(edges[:-1]))
    flat = [r for r in rows if r["column_name"] == "flat"]
    assert [(r["low"], r["high"], r["count"]) for r in flat] == [(2.5, 3.5, 1000)]


def test_density_by_either_route(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=300)
    df = spark.createDataFrame([(float(v), float(round(v))) for v in values], "x double, r double")
    for name, data in (("x", values), ("r", np.round(values))):
        h = data.std(ddof=1) * len(data) ** -0.2
        grid = np.linspace(data.min(), data.max(), 200)
        exact = np.exp(-0.5 * ((grid[:, None] - data[None]) / h) ** 2).sum(1) / (len(data) * h * math.sqrt(2 * math.pi))
        rows = plotdata.kde_curve(df, [name]).orderBy("point").collect()
        assert [r["x"] for r in rows] == pytest.approx(list(grid)) and [r["density"] for r in rows] == pytest.approx(list(exact))
    assert plotdata.kde_curve(df.select(F.lit(1.0).alias("one")), ["one"]).count() == 0


def test_plot_plan(spark):
    df = spark.createDataFrame([(i % 60, str(i % 3), float(i), f"t{i}") for i in range(600)], "n int, c string, u double, t string")
    light = profile.light_profile(df)
    plan = {r["column_name"]: (r["univariate"], r["bivariate"]) for r in plotdata.plot_plan(light, "c", False).collect()}
    assert plan == {"n": ("histogram", "violin"), "c": ("count_bars", None)}
    assert plotdata.numeric_hue(light, "n") and not plotdata.numeric_hue(light, "c")


def test_violins_take_the_most_frequent_categories(spark):
    df = spark.range(900).select((F.floor(F.sqrt("id"))).alias("c"), F.col("id").cast("double").alias("x"))
    rows = plotdata.violin_summary(df, "c", "x").collect()
    assert {r["category"] for r in rows} == {str(i) for i in range(10, 30)}
    assert all(r["whisker_low"] <= r["q25"] <= r["median"] <= r["q75"] <= r["whisker_high"] for r in rows)
    assert plotdata.violin_density(df, "c", "x").count() == 20 * 100


def preserved(high, low, k=8):
    def near(x):
        d = ((x[:, None] - x[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, 1)[:, :k]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(high), near(low))])


def test_weights(spark, cloud):
    graph = neighbours.knn_graph(cloud, COLS, "k", 9)
    joint = layout.tsne_affinities(graph, 3.0).toPandas()
    assert joint["weight"].sum() == pytest.approx(1)
    there = {(r.id, r.neighbour): r.weight for r in joint.itertuples()}
    assert all(there[(b, a)] == pytest.approx(w) for (a, b), w in there.items())
    fuzzy = layout.umap_weights(graph, 10).toPandas()
    assert fuzzy["weight"].between(0, 1 + 1e-9).all() and (fuzzy.groupby("id")["weight"].max() > 0.999).all()
    assert layout.fuzzy_weights(np.array([1.0, 2.0, 3.0, 4.0]), 5).sum() == pytest.approx(np.log2(5), abs=1e-4)
    a, b = layout.curve_parameters(0.1)
    assert (a, b) == pytest.approx((1.577, 0.895), abs=2e-3)


def test_approximate_neighbours(spark):
    """Several tree passes, full leaves and descent; candidates stay bounded."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(2500, 12)), np.round(rng.normal(size=(300, 12))), np.zeros((40, 12))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "k long, v array<double>").repartition(5)
    search = forest.Search(trees=3, leaf=32, rounds=4)
    exact = cut(neighbours.knn_graph(df, "v", "k", 8), "exact")
    found = cut(forest.knn_graph_approximate(df, "v", "k", 8, search), "found")
    row = forest.recall(found, exact).first()
    assert (row["points"], row["neighbours"]) == (2840, 2840 * 8) and row["recall"] >= 0.95
    assert forest.recall(exact, exact).first()["recall"] == 1.0
    trees_only = forest.knn_graph_approximate(df, "v", "k", 8, forest.Search(trees=3, leaf=32, rounds=0))
    assert forest.recall(trees_only, exact).first()["recall"] < row["recall"]
    by = {}
    for r in found.collect():
        by.setdefault(r["id"], []).append((r["rank"], r["distance"], r["neighbour"]))
        assert r["distance"] == pytest.approx(np.linalg.norm(points[r["id"]] - points[r["neighbour"]]), abs=1e-8)
    assert all([x[0] for x in sorted(v)] == list(range(1, 9)) and [x[1] for x in sorted(v)] == sorted(x[1] for x in v) and i not in [x[2] for x in v] for i, v in by.items())


def test_approximate_search_goes_on_until_a_sample_is_found(spark):
    """Directions all alike: few candidates miss most neighbours, so that more have to be kept."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "k long, v array<float>")
    exact = cut(neighbours.knn_graph(df, "v", "k", 10), "exact")
    found = forest.knn_graph_approximate(df, "v", "k", 10, forest.Search(trees=2, leaf=64, keep=10, reverse=5, rounds=3))
    assert forest.recall(found, exact).first()["recall"] >= 0.93


def test_further_trees_do_without_descent(spark, monkeypatch):
    """Leaves of a share of the points: the recall asks for more trees, and vectors do not move to every neighbour."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 48)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "k long, v array<float>")
    monkeypatch.setattr(forest, "gathered", lambda *rest: pytest.fail("descent"))
    grown, plain = [], forest.leaves
    monkeypatch.setattr(forest, "leaves", lambda points, total, width, search: grown.append(search.trees) or plain(points, total, width, search))
    found = cut(forest.knn_graph_approximate(df, "v", "k", 10, forest.Search(trees=2, leaf=800)), "found")
    assert len(grown) > 1 and sum(grown) <= forest.Search().most_trees
    row = forest.recall(found, cut(neighbours.knn_graph(df, "v", "k", 10), "exact")).first()
    assert (row["points"], row["neighbours"]) == (3000, 30000) and row["recall"] >= 0.93


@pytest.mark.parametrize("far, scale", [(0.0, 1.0), (1e6, 1e-2), (1e25, 1e24)])
def test_shortlists_miss_nothing(far, scale, monkeypatch):
    """Products in floats where they are near enough, in doubles else; ties go to the smaller key."""
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(700, 20)), rng.integers(0, 2, size=(300, 20))]) * scale + far
    monkeypatch.setattr(neighbours, "CHUNK", 128)
    monkeypatch.setattr(neighbours, "FIRST", 64)
    ids = rng.permutation(1000)
    nearest = neighbours._Nearest(ids, x, np.full(1000, np.inf), 6)
    for part in np.array_split(np.arange(1000), 3):
        nearest.see(ids[part], x[part])
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    d[np.arange(1000), np.arange(1000)] = np.inf
    best = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :6]
    found = {}
    for batch in nearest.lists(pa.int64()):
        found |= {r["query"]: r["neighbours"] for r in batch.to_pylist()}
    assert found == {int(ids[i]): ids[row].tolist() for i, row in enumerate(best)}


def test_written_tables_leave_no_shuffle_files(spark):
    """An iteration writes a table an exchange: what was shuffled for it goes with it."""
    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for name in (blocks.apply(i).toString() for i in range(blocks.size())) if name.startswith("shuffle_")}

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = held(), spark.conf.get(conf, None)
    grouped = lambda n: spark.range(n).groupBy((F.col("id") % 7).alias("x")).agg(F.collect_list("id").alias("ids"))
    table = cut(grouped(70), "grouped")
    again = Rewritten(grouped(70), "again")
    again.write(again.df.repartition(3, "x"))
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(conf, None) == setting
    assert {r["x"]: sorted(r["ids"]) for r in table.collect()} == {r["x"]: sorted(r["ids"]) for r in again.df.collect()} == {x: list(range(x, 70, 7)) for x in range(7)}


def test_search_among_floats_gives_exact_distances(spark):
    x = np.random.default_rng(9).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    found = forest.knn_graph_approximate(df, "v", "k", 5, forest.Search(trees=2, leaf=40, floats=True)).collect()
    assert len(found) == 2000
    assert all(r["distance"] == round(float(np.sqrt(((x[r["id"]] - x[r["neighbour"]]) ** 2).sum())), 9) for r in found)


def test_edges_travel_as_one_row_of_each_point(spark, monkeypatch):
    edges = spark.createDataFrame([(i, j, float(i + j)) for i in range(40) for j in range(40) if i != j], "id long, neighbour long, weight double")
    seen = []

    class Still:
        def run(self, own, turn, rounds):
            assert len(own.weight) == 40 * 39 and np.allclose(np.sort(np.bincount(own.of, own.weight)), 780 + 38 * np.arange(40))
            return own.state

    plain = descent.exchanged
    monkeypatch.setattr(descent, "exchanged", lambda links, *rest: seen.append(links.count()) or plain(links, *rest))
    assert descent.settle(edges, plane(spark, np.random.default_rng(2).normal(size=(40, 2))), 40, Still(), [1]).count() == 40
    assert seen == [40]


def test_positions_travel_as_one_row_of_a_lot():
    """A batch of points sends a row to each lot, and a lot a row to each block, with edges in order."""
    ends = [[2, 3], [0, 2, 3], [1], []]
    lots = [[2, 0], [1, 2, 0], [1], []]
    lists = [pa.array(ends, pa.list_(pa.int64())), pa.array([[10.0 * i + j for j in e] for i, e in enumerate(ends)], pa.list_(pa.float64())), pa.array(lots, pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), *lists, pa.array([0.5, 1.5, 2.5, 3.5]), pa.array([-0.5, -1.5, -2.5, -3.5])], names=["neighbour", "ids", "weights", "lots", "x", "y"])
    sent = pa.Table.from_batches(descent._sent([batch]))
    assert sent.to_pydict() == {"lot": [0, 1, 2], "ids": [[3, 3], [0, 1], [2, 2]], "others": [[0, 1], [1, 2], [0, 1]], "weights": [[3.0, 13.0], [10.0, 21.0], [2.0, 12.0]],
                                "xs": [[0.5, 1.5], [1.5, 2.5], [0.5, 1.5]], "ys": [[-0.5, -1.5], [-1.5, -2.5], [-0.5, -1.5]]}
    points = pa.table({**{c: pa.array(v, pa.int32()) for c, v in zip(descent.AT, ([1, 1, 1], [0, 1, 0], [0, 0, 0], [0, 0, 0]))}, "id": [3, 2, 1], **{c: [3.0 + i, 2.0, 1.0] for i, c in enumerate(descent.STATE)}})
    rows = descent._gathered(sent, points).to_pydict()
    assert rows["ids"] == [[1, 3], [2]] and rows["counts"] == [[1, 2], [2]] and rows["others"] == [[2, 0, 1], [0, 1]] and rows["weights"] == [[21.0, 3.0, 13.0], [2.0, 12.0]]
    assert rows["xs"] == [[2.5, 0.5, 1.5], [0.5, 1.5]] and [len(x) for x in rows["states"]] == [14, 7] and rows["states"][0][7:9] == [3.0, 4.0]
    assert descent._gathered(sent.slice(0, 0), points).to_pydict()["counts"] == [[0, 0], [0]]


@pytest.mark.parametrize("weigh", [lambda d: layout.perplexity_weights(d, 4.0), lambda d: layout.fuzzy_weights(d, 12)])
def test_rows_are_weighed_together_as_alone(weigh):
    d = np.sort(np.random.default_rng(1).gamma(2.0, size=(50, 11)), axis=1)
    d[0], d[1], d[2, :4] = 0.0, 2.0, 0.0
    together = weigh(d)
    assert together.shape == d.shape and np.array_equal(together, np.stack([weigh(row) for row in d]))
    assert np.allclose(together[3:].sum(1), 1.0) or np.allclose(together[3:].sum(1), np.log2(12), atol=1e-4)


def test_pushes_match_the_direct_sum(monkeypatch):
    rng = np.random.default_rng(4)
    law = layout.Membership(100, 200, 1.577, 0.895)
    y, others, count = rng.normal(size=(40, 2)), rng.normal(size=(90, 2)) * 3, rng.integers(1, 9, size=90).astype(float)
    others[:40] = y
    gap = y[:, None] - others[None]
    d2 = (gap * gap).sum(2)
    force = 2.0 * 0.895 / ((0.001 + d2) * (1 + 1.577 * np.maximum(d2, 1e-12) ** 0.895))
    monkeypatch.setattr(layout, "FORCES", 500)
    assert np.allclose(law.pushes(y, others, count), (np.clip(force[..., None] * gap, -4.0, 4.0) * count[:, None]).sum(1), rtol=1e-12)


def test_wide_vectors_do_not_travel_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 24)), rng.integers(0, 2, size=(300, 24))]).astype(float)
    df = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "k string, v array<double>")
    written = {}

    def recorded(table, label):
        out = cut(table, label)
        written[label] = out.count()
        return out

    for name, value in {"cut": recorded, "POINTS_PER_PIVOT": 16, "BLOCK": 64, "CHUNK": 32, "MATRIX": 1000}.items():
        monkeypatch.setattr(neighbours, name, value)
    found = neighbours.knn_graph(df, "v", "k", 7).collect()
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    d[np.arange(600), np.arange(600)] = np.inf
    best = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert {(r["id"], r["rank"], r["neighbour"]) for r in found} == {(f"p{i:03d}", j + 1, f"p{n:03d}") for i, row in enumerate(best) for j, n in enumerate(row)}
    assert len(found) == 4200 and max(written.values()) <= 7 * 600


def test_candidates_are_bounded(spark):
    """Leaves hold at most twice their size, centres gather at most k + reverse + 1 points, hubs too."""
    rng = np.random.default_rng(4)
    search = forest.Search(trees=2, leaf=16, reverse=5)
    hub = [(0, [0.0] * 6)] + [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1, 900)]
    points = spark.createDataFrame(hub, "id long, vector array<double>").repartition(3)
    placed = forest.leaves(points, 900, 6, search)
    sizes = [r["count"] for r in placed.groupBy("tree", "leaf", "block").count().collect()]
    assert sum(sizes) == 1800 and max(sizes) <= 32 and len(sizes) > 80
    graph = spark.createDataFrame([(i, 0, 1.0) for i in range(1, 900)] + [(0, 1, 1.0)], "query long, neighbour long, distance double")
    gathered = [r["count"] for r in forest.gathered(graph, points, 1, search, 0).groupBy("centre").count().collect()]
    assert max(gathered) <= 1 + 5 + 1
    ties = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(300)], "id long, vector array<double>")
    assert max(r["count"] for r in forest.leaves(ties, 300, 2, search).groupBy("tree", "leaf", "block").count().collect()) < 3 * 16


def plane(spark, points):
    state = [(i, float(x), float(y), 0.0, 0.0, 1.0, 1.0, 0.0) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(state, "id long, " + ", ".join(f"{c} double" for c in descent.STATE)).repartition(3)


def test_blocks_see_every_other_point_once(spark):
    """Points of a block and the cells around it add up to all points, with crowded and single cells."""
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(size=(300, 2)), rng.normal(size=(200, 2)) * 0.01 + 3, np.full((90, 2), 1.5)])
    depth, size = 6, 16
    grid = descent.gridded(plane(spark, points), depth, (points[:, 0].min(), points[:, 1].min(), np.ptp(points, axis=0).max() * (1 + 1e-9)))
    tree = cut(descent.quadtree(grid, depth), "tree")
    home = descent.homes(tree, depth, size)
    placed = grid.join(home, ["fi", "fj"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = {tuple(r)[:4]: r["count"] for r in placed.groupBy(*descent.AT).count().collect()}
    assert sum(members.values()) == len(points) and max(r for (level, *_), r in members.items() if level < depth) <= size
    around = descent.seen_cells(home.select("level", "i", "j", "parts").distinct(), tree, depth).toPandas()
    assert around.groupby(descent.AT).size().max() <= 4 * 27 * depth + 8 * 4 ** descent.SUB + 1
    for at, rows in around.groupby(descent.AT):
        assert rows["n"].sum() + (0 if rows["own"].any() else members[at]) == len(points)      # a crowded cell counts its own points


@pytest.mark.parametrize("size", [1000, 24])
def test_repulsion_matches_the_direct_sum(spark, size):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 2)) * 6
    d2 = ((points[:, None] - points[None]) ** 2).sum(2)
    kernel = 1 / (1 + d2)
    np.fill_diagonal(kernel, 0)
    exact = ((kernel ** 2)[:, :, None] * (points[:, None] - points[None])).sum(1)

    class Still:
        def run(self, own, turn, rounds):
            push, z = layout.repulsion(own.state[:, :2], own.cells)
            return np.column_stack([own.state[:, :2], push, push, z])

    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "id long, neighbour long, weight double")
    found = descent.settle(edges, plane(spark, points), 400, Still(), [1], size).toPandas().sort_values("id")
    error, largest = np.abs(found[["vx", "vy"]].to_numpy() - exact), np.abs(exact).max()
    assert error.max() <= (1e-9 if size == 1000 else 0.12) * largest and error.mean() <= (1e-9 if size == 1000 else 0.01) * largest
    assert found["z"].sum() == pytest.approx(kernel.sum(), rel=1e-9 if size == 1000 else 0.01)
    assert np.allclose(found[["x", "y"]].to_numpy(), points)


def test_layouts_keep_neighbours_together(spark, cloud):
    """Small blocks: points move by what they see of others."""
    ready = reduce.prepared(cloud, COLS, ["k"])
    high = ready.toPandas().sort_values("k")[COLS].to_numpy()
    spread = layout.umap(ready, COLS, "k", rounds=60, block=24)
    flat = spread.toPandas().sort_values("k")[["umap1", "umap2"]].to_numpy()
    assert np.isfinite(flat).all() and preserved(high, flat) > 0.5
    apart = layout.tsne(ready, COLS, "k", Settings(tsne_perplexity=6.0), iterations=200, block=40).toPandas().sort_values("k")[["tsne1", "tsne2"]].to_numpy()
    assert np.isfinite(apart).all() and preserved(high, apart) > 4 * 8 / 89
    row = layout.preserved(neighbours.knn_graph(ready, COLS, "k", 8), spread, "k").first()
    assert row["points"] == 90 and row["share"] == pytest.approx(preserved(high, flat), abs=0.02)


def test_tiny_layouts(spark):
    for rows in ([(1, 0.0, 0.0)], [(i, 0.0, 0.0) for i in range(3)]):
        df = spark.createDataFrame(rows, "k long, a double, b double")
        for made in (layout.umap(df, ["a", "b"], "k", rounds=2, exact=True), layout.tsne(df, ["a", "b"], "k", iterations=2)):
            assert sorted(r["k"] for r in made.collect()) == [r[0] for r in rows]
            assert np.isfinite(made.drop("k").toPandas().to_numpy()).all()


def test_tsne_takes_large_blocks(spark, cloud, monkeypatch):
    """Neighbours outside a block stand still between exchanges; forces are computed a bounded number at once."""
    taken = []
    monkeypatch.setattr(layout, "settle", lambda edges, start, rows, law, schedule, block: taken.append(block) or start)
    assert layout.tsne(reduce.prepared(cloud, COLS, ["k"]), COLS, "k", exact=True).count() == 90 and taken[0] >= 2000
    assert descent.sub_of(256) == descent.SUB < descent.sub_of(taken[0])
    rng = np.random.default_rng(11)
    y, cells = rng.normal(size=(70, 2)) + 40, np.column_stack([rng.integers(1, 9, size=30), rng.normal(size=(30, 2)) * 9])
    gap = y[:, None] - np.vstack([y, cells[:, 1:]])[None]
    kernel = 1 / (1 + (gap * gap).sum(2))
    count = np.concatenate([np.ones(70), cells[:, 0]])
    monkeypatch.setattr(layout, "MATRIX", 1000)
    push, z = layout.repulsion(y, cells)
    assert np.allclose(push, ((kernel ** 2 * count)[:, :, None] * gap).sum(1)) and np.allclose(z, kernel @ count - 1)
    assert layout.repulsion(np.full((1, 2), 3.7), np.zeros((0, 3)))[1].tolist() == [0.0]
