"""Order statistics and neighbours against brute force, with hot values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import neighbours, ordering
from plumbline.session import cut


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, the rest are all different."""
    return spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1) * F.col("id")).alias("x")).transform(lambda d: cut(d, "test"))


def test_quantiles_by_bracket_match(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordering, "FEW_VALUES", 10)
    values = np.array([r["x"] for r in skewed.collect()])
    probs = [0.0, 0.1, 0.25, 0.33, 0.5, 0.75, 0.999, 1.0]
    assert ordering.quantile_values(skewed, ["x"], probs)["x"] == pytest.approx(list(np.quantile(values, probs)))


def test_quantiles_outside_their_bracket_are_still_found(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordering, "FEW_VALUES", 10)
    monkeypatch.setattr(ordering, "_merge", lambda spans: [(-2.0, -1.0)])       # brackets that hold nothing
    values = np.array([r["x"] for r in skewed.collect()])
    assert ordering.quantile_values(skewed, ["x"], [0.4])["x"] == pytest.approx([np.quantile(values, 0.4)])


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert ordering.quantile_values(df, ["x"], [0.5]) == {"x": [None]}


def test_running_counts_across_partitions(spark, skewed):
    ranks = ordering.average_ranks(skewed, ["x"]).orderBy("value").collect()
    assert len(ranks) == 6001
    hot = [r for r in ranks if r["n"] > 1]
    assert len(hot) == 1 and hot[0]["n"] == 3000
    assert sum(r["avg_rank"] * r["n"] for r in ranks) == 9000 * 9001 / 2
    assert [r["avg_rank"] for r in ranks] == sorted(r["avg_rank"] for r in ranks)


def brute(points, ids, k):
    d = np.round(np.sqrt(((points[:, None] - points[None]) ** 2).sum(2)), 9)
    result = {}
    for i in range(len(points)):
        order = np.lexsort((ids, d[i]))
        result[ids[i]] = [(ids[j], d[i, j]) for j in order if j != i][:k]
    return result


@pytest.mark.parametrize("shape", ["plane", "copies"])
def test_neighbours_are_exact(spark, monkeypatch, shape):
    monkeypatch.setattr(neighbours, "POINTS_PER_PIVOT", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "QUERIES", 25)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 2)) if shape == "plane" else np.vstack([rng.integers(0, 9, (250, 2)), np.zeros((150, 2))]).astype(float)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, a double, b double")
    found: dict = {}
    for r in neighbours.knn_graph(df, ["a", "b"], "k", 6).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    assert found == brute(points, np.arange(len(points)), 6)


def test_neighbours_with_text_keys_and_few_rows(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 1.0), ("c", 3.0)], "k string, x double")
    rows = neighbours.knn_graph(df, ["x"], "k", 5).orderBy("id", "rank").collect()
    assert [(r["id"], r["neighbour"]) for r in rows] == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "a")]
    assert math.isclose(rows[0]["distance"], 1.0)
