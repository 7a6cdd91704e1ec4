"""Ranks of many columns by one shuffle."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import associations, ranking


@pytest.fixture
def many_stretches(spark):
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def frame(n=1500, seed=1):
    """A value held by a third of the rows, ties, missing cells in common and apart, a constant, an empty column."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    data = pd.DataFrame({"x": x, "tied": np.round(x * 2 + rng.normal(size=n)), "hot": np.where(rng.random(n) < 0.4, 7.0, rng.integers(0, 5, n)),
                         "far": x ** 3 * 1e12, "flat": 3.0, "row": rng.normal(size=n)})
    gone = rng.random(n) < 0.2
    data["gap1"], data["gap2"] = np.where(gone, np.nan, x + rng.normal(size=n)), np.where(gone, np.nan, rng.integers(0, 9, n))
    data["gap3"] = np.where(rng.random(n) < 0.5, np.nan, -x)
    data["zero"] = np.where(rng.random(n) < 0.5, 0.0, -0.0) + rng.integers(0, 2, n)
    return data


def loaded(spark, data):
    return spark.createDataFrame(data.replace({np.nan: None}).astype(object).where(data.notna(), None).values.tolist(), ", ".join(f"`{c}` double" for c in data)).repartition(7)


def test_ranks_are_average_ranks(spark, many_stretches):
    data = frame()
    rows = ranking.numbered_rows(loaded(spark, data))
    cols = list(data)[:6]
    sides = rows.select(associations.F.monotonically_increasing_id().alias("row"), *[associations.F.col(c).alias(f"s{i}") for i, c in enumerate(cols) if c != "row"])
    ranks, total = ranking.row_ranks(sides)
    values = sides.toPandas().set_index("row").sort_index()
    found = ranks.toPandas().pivot(index="row", columns="side", values="rank").sort_index()
    for i, c in enumerate(values):
        assert np.array_equal(found[i].to_numpy(), values[c].rank(method="average").to_numpy()) and total[i] == len(data)


def test_spearman_of_all_pairs(spark, many_stretches):
    data = frame()
    cols = list(data)
    found = {(r["col_a"], r["col_b"]): r for r in associations.spearman(loaded(spark, data), cols).collect()}
    assert list(found) == list(combinations(cols, 2))
    for (a, b), r in found.items():
        both = data[[a, b]].dropna()
        assert r["n"] == len(both)
        ranks = both.rank()
        undefined = ranks[a].std() == 0 or ranks[b].std() == 0
        assert r["value"] == pytest.approx(0.0 if undefined else ranks[a].corr(ranks[b]), abs=1e-12)
        assert (r["p_value"] is None) == bool(undefined)


@pytest.mark.parametrize("few", [0, 60, 1 << 16])
def test_columns_of_few_values_are_not_dealt(spark, many_stretches, monkeypatch, few):
    """Ranked by counts or by order, or some by each, the correlations are alike; what has few values meets no range shuffle."""
    data, dealt = frame(), []
    monkeypatch.setattr(ranking, "FEW", few)
    plain = ranking.stretches
    monkeypatch.setattr(ranking, "stretches", lambda sides, partners=None: dealt.extend(partners) or plain(sides, partners))
    cols = ["x", "tied", "hot", "flat", "gap2", "zero", "far"]
    for r in associations.spearman(loaded(spark, data), cols).collect():
        both = data[[r["col_a"], r["col_b"]]].dropna().rank()
        undefined = (both.std() == 0).any()
        assert r["value"] == pytest.approx(0.0 if undefined else both.corr().iloc[0, 1], abs=1e-12) and r["n"] == len(both)
    # seven whole columns and sides, then six beside the gaps
    assert len(dealt) == {0: 13, 60: 4, 1 << 16: 0}[few]


def test_partners_with_the_same_gaps_share_ranks(spark):
    data = frame(200)
    rows = ranking.numbered_rows(loaded(spark, data).withColumnRenamed("row", "other"))
    cols = ["x", "far", "gap1", "gap2", "gap3"]
    sides, places = associations._ranked_sides(rows, cols, list(combinations(cols, 2)))
    # x and far whole, beside gap1 or gap2, beside gap3: 6; the gaps by themselves: 3, beside each other: 3; 20 if nothing were shared
    assert len(sides.columns) - 1 == 12
    assert places[0] == (0, 1)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_shuffles_do_not_grow_with_columns(spark, many_stretches):
    data = frame(100)
    counts = []
    for cols in (["x", "tied"], ["x", "tied", "hot", "far", "flat"], list(data.columns.drop("row"))):
        rows = ranking.numbered_rows(loaded(spark, data).drop("row"))
        sides, places = associations._ranked_sides(rows, cols, list(combinations(cols, 2)))
        ranks, _ = ranking.row_ranks(sides)
        counts.append(exchanges(ranks.repartition("row").sortWithinPartitions("row")))
    assert counts == [1, 1, 1]                            # beside the one that dealt the ranges


def test_no_rows_and_one(spark):
    for n in (0, 1):
        rows = associations.spearman(spark.createDataFrame([(1.0, 2.0)][:n], "a double, b double"), ["a", "b"]).collect()
        assert [(r["value"], r["p_value"], r["n"]) for r in rows] == [(0.0, None, n)]


def test_cells_are_ordered_by_one_number(spark, monkeypatch):
    """Each side's cells are dealt and sorted on their own: no comparison of side, value and row for every two cells."""
    sides = spark.range(4000).select(associations.F.col("id").alias("row"), *[(associations.F.xxhash64("id", associations.F.lit(i)) / 1e9).alias(f"s{i}") for i in range(2)])
    plans, plain = [], ranking.cut
    monkeypatch.setattr(ranking, "cut", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, label))
    ranks, total = ranking.row_ranks(sides)
    sorts = [line.split("Sort [", 1)[1].split("], false")[0] for line in plans[0].splitlines() if "Sort [" in line]
    assert len(sorts) == 2 and not any("," in s for s in sorts)
    values, found = sides.toPandas().set_index("row"), ranks.toPandas().pivot(index="row", columns="side", values="rank")
    assert all(np.array_equal(found[i].sort_index(), values[f"s{i}"].rank().sort_index()) for i in range(2)) and total == {0: 4000, 1: 4000}


def test_groups_are_counted_in_one_scan(spark, monkeypatch):
    """The tables of all pairs are written, not computed again for every sum over them."""
    df = spark.createDataFrame([(f"c{i % 3}", f"d{i * i % 4}", float(i % 17), float(i)) for i in range(200)], "a string, b string, x double, y double")
    written, plain = [], associations.cut
    monkeypatch.setattr(associations, "cut", lambda table, label: written.append(label) or plain(table, label))
    made = [associations.correlation_ratio(df, ["a", "b"], ["x", "y"]), associations.cramers_v(df, [("a", "b")])]
    assert written == ["moments", "contingency"] and [m.count() for m in made] == [4, 1]
    assert not any("LogicalRDD [a#" in m._jdf.queryExecution().optimizedPlan().toString() for m in made)
