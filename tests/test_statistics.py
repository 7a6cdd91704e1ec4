"""Tails against known constants; outliers, associations, balance and leakage on small frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import tails
from plumbline.operators import associations as A
from plumbline.operators import collinearity, features, outliers, targets, profile
from plumbline.session import InputError


def one(rule, *values):
    return float(rule(*(np.array([float(v)]) for v in values))[0])


@pytest.mark.parametrize("found, known", [
    (one(tails.chi2_tails, 3.841458820694124, 1), 0.05), (one(tails.chi2_tails, 9.487729036781154, 4), 0.05), (one(tails.chi2_tails, 0.0, 3), 1.0),
    (one(tails.gamma_tails, 0.5, 130.0), 1.71599549e-58), (one(tails.f_tails, 3.1, 3, 20), 0.04992455), (one(tails.f_tails, math.inf, 2, 9), 0.0),
    (one(tails.t_tails, 2.228138851964939, 10), 0.05), (one(tails.t_tails, 0.0, 5), 1.0), (one(tails.f_tails, 3.841458820694124, 1, 4e9), 0.05),
    (one(tails.t_tails, 1.959963984540054, 1e12), 0.05), (one(tails.f_tails, 2.3719328, 4, 3e5), 0.0500024),
])
def test_tails(found, known):
    assert found == pytest.approx(known, rel=2e-5)


@pytest.mark.parametrize("dof", [1, 2, 3, 10, 1e3, 99_999, 199_999, 200_001, 1e6, 1e8, 1e10, 1e12])
def test_one_method_at_all_sizes(dof):
    """Closed forms of F with two degrees of freedom above, and of chi-square with an even number."""
    for f in (0.5, 3.0, 80.0):
        closed = math.exp(-dof / 2 * math.log1p(2 * f / dof))
        assert one(tails.f_tails, f, 2, dof) == pytest.approx(closed, rel=1e-8, abs=1e-300)
    if dof <= 1e3 and dof % 2 == 0:
        x = dof * 1.2
        poisson = math.fsum(math.exp(-x / 2 + k * math.log(x / 2) - math.lgamma(k + 1)) for k in range(int(dof) // 2))
        assert one(tails.chi2_tails, x, dof) == pytest.approx(poisson, rel=1e-10)


def test_arrays_and_missing_cells():
    t = np.array([1.0, math.nan, -2.0, math.inf, 0.0])
    found = tails.t_tails(t, np.full(5, 1.0))
    assert found[[0, 2, 3, 4]] == pytest.approx([0.5, 1 - 2 / math.pi * math.atan(2), 0.0, 1.0]) and math.isnan(found[1])
    assert np.isnan(tails.chi2_tails(np.array([1.0, -1.0]), np.array([0.0, 3.0]))).all()


def test_what_does_not_settle_is_an_error(monkeypatch):
    monkeypatch.setattr(tails, "_ROUNDS", 3)
    with pytest.raises(ArithmeticError):
        one(tails.f_tails, 1.1, 500, 600)
    with pytest.raises(ArithmeticError):
        one(tails.chi2_tails, 90.0, 100)


def test_tails_far_out_keep_their_digits():
    assert one(tails.chi2_tails, 1400.0, 1) == pytest.approx(math.sqrt(2 / (math.pi * 1400)) * math.exp(-700), rel=1e-2)
    assert 0 < one(tails.t_tails, 30.0, 200) < 1e-70


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def outlier_count(spark, values, method):
    row = outliers.outliers(frame(spark, [(v,) for v in values], "c double"), ["c"], method).first()
    return row["outlier_count"] if row else None


def test_outliers(spark):
    assert outlier_count(spark, [0.0] * 100 + [1000.0], "z-score") == 1
    assert outlier_count(spark, [1.0, 2.0, 3.0, 2.0, 1.5, 1000.0], "mz-score") == 1
    assert outlier_count(spark, [5.0] * 9, "z-score") == 0
    assert outlier_count(spark, [5.0] * 9, "mz-score") == 0
    assert outlier_count(spark, [None, None], "mz-score") is None
    with pytest.raises(InputError):
        outlier_count(spark, [1.0], "guess")


def test_z_score_uses_the_population_deviation(spark):
    rows = outliers.z_scores(frame(spark, [(1, 1.0), (2, 3.0)], "k int, c double"), ["c"], ["k"]).orderBy("k").collect()
    assert [r["c_score"] for r in rows] == [-1.0, 1.0]


def test_identical_categories_have_v_one(spark):
    df = frame(spark, [(x, x) for x in "abc" * 20], "a string, b string")
    row = A.cramers_v(df, [("a", "b")]).first()
    assert row["value"] == pytest.approx(1.0) and row["p_value"] < 1e-20


def test_two_by_two_is_corrected(spark):
    df = frame(spark, [(0, 0)] * 20 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(1, 1)] * 15, "a int, b int")
    test = A.chi2_independence(A.contingency(df, [("a", "b")])).first()
    assert test["chi2"] == pytest.approx(6.75, abs=1e-9)
    perfect = frame(spark, [(0, 0)] * 20 + [(1, 1)] * 20, "a int, b int")          # two empty cells
    assert A.chi2_independence(A.contingency(perfect, [("a", "b")])).first()["chi2"] == pytest.approx(36.1)


def test_constant_or_empty_side_has_no_v(spark):
    df = frame(spark, [("x", "a", None), ("x", "b", None)], "a string, b string, c string")
    rows = {(r["col_a"], r["col_b"]): r for r in A.cramers_v(df, [("a", "b"), ("a", "c")]).collect()}
    assert rows[("a", "b")]["value"] is None and rows[("a", "c")]["value"] is None and rows[("a", "c")]["n"] == 0


def test_correlation_ratio(spark):
    df = frame(spark, [("A", 1.0)] * 50 + [("B", 10.0)] * 50, "g string, x double")
    row = A.correlation_ratio(df, ["g"], ["x"]).first()
    assert row["value"] == pytest.approx(1.0) and row["p_value"] == 0.0
    single = A.correlation_ratio(frame(spark, [("A", 1.0), ("A", 2.0)], "g string, x double"), ["g"], ["x"]).first()
    assert single["value"] is None and single["p_value"] is None
    flat = A.correlation_ratio(frame(spark, [("A", 1.0), ("B", 1.0)], "g string, x double"), ["g"], ["x"]).first()
    assert flat["value"] is None


def test_anova_leaves_out_lone_rows(spark):
    df = frame(spark, [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), ("c", 99.0)], "g string, x double")
    assert (A.anova_f(df, ["g"], ["x"]).first()["d1"], A.anova_f(df, ["g"], ["x"], least_rows=1).first()["d1"]) == (1, 2)


def test_spearman(spark):
    df = frame(spark, [(i, i ** 3, None if i % 2 else -i, 7) for i in range(40)], "a int, b int, c int, d int")
    rows = {(r["col_a"], r["col_b"]): r for r in A.spearman(df, ["a", "b", "c", "d"]).collect()}
    assert rows[("a", "b")]["value"] == pytest.approx(1.0) and rows[("a", "b")]["p_value"] == 0.0
    assert rows[("a", "c")]["value"] == pytest.approx(-1.0) and rows[("a", "c")]["n"] == 20
    assert rows[("a", "d")]["value"] == 0.0 and rows[("a", "d")]["p_value"] is None
    one = A.spearman(frame(spark, [(1.0, 2.0)], "a double, b double"), ["a", "b"]).first()
    assert (one["value"], one["p_value"]) == (0.0, None)


def test_spearman_p_value(spark):
    df = frame(spark, list(zip([1, 2, 3, 4, 5], [5, 6, 7, 8, 7])), "a int, b int")
    row = A.spearman(df, ["a", "b"]).first()
    assert row["value"] == pytest.approx(0.8207826816681233) and row["p_value"] == pytest.approx(0.08858700531354381)


def test_matrix_is_symmetric_with_ones(spark):
    pairs = spark.createDataFrame([(A.NUM_NUM, "a", "b", 0.5, 0.1, 9), (A.NUM_NUM, "b", "c", -0.2, 0.1, 9)],
                                  "kind string, col_a string, col_b string, value double, p_value double, n long")
    rows = {r["column_name"]: r for r in A.association_matrix(pairs, A.NUM_NUM).collect()}
    assert rows["a"]["b"] == rows["b"]["a"] == 0.5 and rows["c"]["c"] == 1.0 and rows["a"]["c"] is None


def test_leakage_and_strength_need_significance(spark):
    pairs = spark.createDataFrame([(A.CAT_NUM, "t", "x", 0.99, 0.001, 9), (A.CAT_NUM, "t", "y", 0.99, 0.2, 9), (A.CAT_CAT, "t", "z", 0.96, 0.0, 9),
                                   (A.NUM_NUM, "x", "y", -0.99, 0.0, 9), (A.CAT_NUM, "t", "w", None, None, 9)],
                                  "kind string, col_a string, col_b string, value double, p_value double, n long")
    assert {r["column_name"] for r in A.leakage(pairs, "t", False).collect()} == {"x", "z"}
    assert {r["column_name"] for r in A.leakage(pairs, "x", True).collect()} == {"t", "y"}
    assert A.strong_associations(pairs).count() == 3
    assert [r["column_name"] for r in A.top_correlated_features(pairs, "t", 2).collect()] == ["x", "y"]


def test_balance(spark):
    df = frame(spark, [("major",)] * 90 + [("minor",)] * 10 + [(None,)], "t string")
    rows = {r["class"]: r for r in A.class_balance(df, "t").collect()}
    assert rows["major"]["class_pct"] == 0.9 and rows["minor"]["max_min_ratio"] == 9.0
    assert A.class_balance(frame(spark, [("one",)], "t string"), "t").first()["max_min_ratio"] is None


def test_vif(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.rand(1).alias("c"), F.lit(3.0).alias("d"))
    rows = {r["column_name"]: r["vif"] for r in collinearity.vif(df, ["a", "b", "c", "d"]).collect()}
    assert rows["a"] == math.inf and rows["c"] < 1.2 and "d" not in rows
    assert {r["column_name"] for r in collinearity.multicollinearity(df, ["a", "b", "c"]).collect()} == {"a", "b"}
    assert collinearity.vif(df, ["a"]).count() == 0


def test_targets(spark):
    df = spark.createDataFrame([(i % 60, i % 2) for i in range(120)], "feature int, target int")
    picked = targets.pick_target(targets.score_targets(profile.light_profile(df)))
    assert targets.identified_target(picked) == "target"
    ids = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "a int, b string")
    with pytest.raises(InputError):
        targets.identified_target(targets.pick_target(targets.score_targets(profile.light_profile(ids))))
    light = profile.light_profile(df)
    assert targets.validate_target(light, "target").first()["ml_task"] == "classification"
    for wrong in ("nothing",):
        with pytest.raises(InputError):
            targets.validate_target(light, wrong)
    with pytest.raises(InputError):
        targets.validate_target(profile.light_profile(ids), "a")


def test_names_like_keys_are_marked_down(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(90)], "width int, size int")
    scores = {r["column_name"]: r["confidence_score"] for r in targets.score_targets(profile.light_profile(df)).collect()}
    assert scores == {"width": 0.6, "size": 1.0}


def test_feature_ranking(spark):
    df = spark.createDataFrame([("x" if i % 2 else "y", float(i % 2) * 10 + i % 3, 2.0, "p" if i % 2 else None, 10 if i % 5 else 9) for i in range(60)],
                               "hue string, strong double, flat double, side string, ten int")
    best = features.top_associated_features(df, "hue", ["strong", "flat"], ["side", "ten"])
    assert [r["column_name"] for r in best.collect()] == ["strong"]
    codes = {r["value"]: r["code"] for r in features.ordinal_encode(features.category_cells(df, ["ten"])).collect()}
    assert codes == {"9": 0, "10": 1}                # as numbers, not as texts
    modes = features.impute_mode(features.category_cells(df.select(F.lit(None).cast("string").alias("none")), ["none"])).collect()
    assert [r["value"] for r in modes] == ["missing"]


def test_correlations_of_many_columns_take_one_pass(spark, monkeypatch):
    """Sums of products come from the tasks; constant columns have no correlation, large means lose no digits."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 1e6
    x[:, 4], x[:, 5] = 7.0, 2 * x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(6))).repartition(4)
    asked, plain = [], A.summed
    monkeypatch.setattr(A, "summed", lambda parts, n: asked.append(n) or plain(parts, n))
    found = A.pearson(df, df.columns)
    assert asked == [49] and len(found) == 15 and all(v is None for p, v in found.items() if "c4" in p)
    want = np.corrcoef(x[:, [0, 1, 2, 3, 5]].T)
    names = ["c0", "c1", "c2", "c3", "c5"]
    assert all(found[a, b] == pytest.approx(want[i, j], abs=1e-9) for i, a in enumerate(names) for j, b in enumerate(names) if i < j)
