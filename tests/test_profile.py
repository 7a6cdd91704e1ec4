"""Logical types, summaries and the decisions about doubtful cases."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from plumbline.operators import frequencies, ordering, profile
from plumbline.settings import Settings

TYPES = {"boolean", "datetime", "id", "categorical", "numerical", "text"}
LIMIT = Settings(categorical_limit=15)


def frame(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def type_of(spark, values, kind, settings=LIMIT):
    return profile.infer_types(frame(spark, values, kind), settings).first()["inferred_type"]


@pytest.mark.parametrize("values, kind, expected", [
    ([True, False] * 40, "boolean", "boolean"),
    ([0, 1] * 100, "int", "boolean"),
    (list(range(200)), "int", "id"),
    ([i % 5 for i in range(300)], "int", "categorical"),
    (list(range(60)) * 2, "int", "numerical"),
    ([datetime.datetime(2024, 1, 1 + i % 28) for i in range(50)], "timestamp", "datetime"),
    ([datetime.date(2024, 1, 1 + i % 28) for i in range(50)], "date", "datetime"),
    (["2024-01-01", "2024-01-02", "2024-02-03"] * 100, "string", "datetime"),
    (["2021", "Jan 5, 2021", "20210101", "10:30", "1/31/2020"] * 20, "string", "datetime"),
    (["12", "100", "1.5"] * 100, "string", "categorical"),
    ([" 1 ", "2"] * 100, "string", "boolean"),
    ([str(i) for i in range(60)] * 2, "string", "numerical"),
    (["apple", "pear", "plum"] * 100, "string", "categorical"),
    ([f"word number {i}" for i in range(60)] * 3, "string", "text"),
    (["N", "Y"] * 100, "string", "categorical"),
    ([None] * 10, "double", "categorical"),
    ([None] * 10, "string", "categorical"),
    ([5.0] * 10, "double", "categorical"),
    ([[1]] * 3, "array<int>", "unsupported"),
])
def test_types(spark, values, kind, expected):
    assert type_of(spark, values, kind) == expected


def test_id_threshold_is_a_setting(spark):
    values = list(range(95)) + list(range(5))
    assert type_of(spark, values, "int") == "numerical"
    assert type_of(spark, values, "int", Settings(id_uniqueness=0.9)) == "id"


def test_nan_is_missing(spark):
    df = frame(spark, [1.0, float("nan"), None, 2.0], "double")
    row = profile.column_profile(df).first()
    assert (row["missing_count"], row["unique_count"]) == (2, 2)
    assert profile.missing_values(df).first()["missing_pct"] == 0.5


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, value double, label string")
    rows = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert len(rows) == 3 and rows["value"]["missing_pct"] is None and rows["value"]["unique_count"] == 0
    stats = profile.dataset_stats(df).first()
    assert (stats["analyzed_row_count"], stats["duplicate_rows_count"], stats["column_pct"]) == (0, 0, None)


def test_single_row_is_all_ids(spark):
    df = spark.createDataFrame([(1, 2.5, "a")], "id int, value double, category string")
    assert {r["inferred_type"] for r in profile.infer_types(df).collect()} == {"id"}


def test_all_missing_category_summary(spark):
    row = profile.category_summary(frame(spark, [None, None], "string"), ["c"]).first()
    assert (row["top"], row["frequency"], row["top_values"]) == ("N/A", 0, [])


def test_ties_go_to_the_smaller_value(spark):
    row = profile.category_summary(frame(spark, ["b", "a", "b", "a", "c"], "string"), ["c"]).first()
    assert row["top"] == "a" and [x["value"] for x in row["top_values"]] == ["a", "b", "c"]


def test_summary_of_known_values(spark):
    row = profile.numeric_summary(frame(spark, [1.0, 2.0, 3.0, 10.0, 4.0], "double"), ["c"]).first()
    assert (row["count"], row["mean"], row["min"], row["q25"], row["median"], row["q75"], row["max"]) == (5, 4.0, 1.0, 2.0, 3.0, 4.0, 10.0)
    assert row["std"] == pytest.approx(3.5355339)
    assert profile.skewness(frame(spark, [1.0, 2.0, 3.0, 10.0, 4.0], "double"), ["c"]).first()["skewness"] == pytest.approx(1.6971, abs=1e-4)
    assert profile.skewness(frame(spark, [4.0] * 5, "double"), ["c"]).first()["skewness"] == 0
    assert profile.skewness(frame(spark, [4.0, 5.0], "double"), ["c"]).first()["skewness"] is None


def test_duplicates(spark):
    assert frequencies.duplicate_rows(frame(spark, [7] * 12, "int")).first()["duplicate_rows"] == 11
    df = spark.createDataFrame([("a", None), ("a", None), ("a", "")], "a string, b string")
    assert frequencies.duplicate_rows(df).first()["duplicate_rows"] == 1
    wide = df.select("a", "b", *[F.lit(i).alias(f"c{i}") for i in range(30)])       # grouped by digest
    assert frequencies.duplicate_rows(wide).first()["duplicate_rows"] == 1
    nested = spark.createDataFrame([([1, 2],), ([1, 2],), ([2, 1],)], "v array<int>")
    assert frequencies.duplicate_rows(nested).first()["duplicate_rows"] == 1


def test_long_texts_are_told_apart_to_the_last_letter(spark):
    base = "x" * 5000
    df = frame(spark, [base + "a", base + "b", base + "a"], "string")
    assert frequencies.distinct_counts(df, ["c"]).first()["unique_count"] == 2


def test_large_whole_numbers_stay_exact(spark):
    df = frame(spark, [2 ** 53, 2 ** 53 + 1], "bigint")
    assert profile.unique_values(df).first()["unique_count"] == 2


def test_many_columns_take_several_scans(spark):
    df = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(11)])
    rows = profile.column_profile(df).orderBy("ordinal").collect()
    assert [r["column_name"] for r in rows] == [f"c{i}" for i in range(11)]


def test_odd_column_names(spark):
    df = spark.createDataFrame([(i % 30, "a", float(i)) for i in range(90)], "`two words` int, `dot.ted` string, `tick``ed` double")
    rows = {r["column_name"]: r["inferred_type"] for r in profile.column_profile(df).collect()}
    assert rows == {"two words": "numerical", "dot.ted": "categorical", "tick`ed": "id"}


cells = st.one_of(st.lists(st.integers(-2 ** 40, 2 ** 40) | st.none(), min_size=1, max_size=30).map(lambda v: (v, "bigint")),
                  st.lists(st.floats(allow_nan=True, allow_infinity=False) | st.none(), min_size=1, max_size=30).map(lambda v: (v, "double")),
                  st.lists(st.text(max_size=12) | st.none(), min_size=1, max_size=30).map(lambda v: (v, "string")),
                  st.lists(st.booleans() | st.none(), min_size=1, max_size=30).map(lambda v: (v, "boolean")))


@hyp(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cells)
def test_every_column_gets_one_of_the_six_types(spark, drawn):
    values, kind = drawn
    assert type_of(spark, values, kind) in TYPES


def test_light_profile_agrees(spark):
    df = spark.range(300).select((F.col("id") % 70).alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    full, light = profile.column_profile(df), profile.light_profile(df)
    assert sorted(map(tuple, full.select(*light.columns).collect())) == sorted(map(tuple, light.collect()))


def test_scan_reads_only_the_wanted_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile.skewness(df, ["l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan


def test_wall_clock_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")         # 02:30 happened twice, and once not at all
        df = spark.sql("SELECT explode(array(timestamp_ntz'2024-03-31 02:30:00', timestamp_ntz'2024-03-31 03:30:00', timestamp_ntz'2024-10-27 02:30:00.000001')) AS t")
        row = profile.column_profile(df.unionAll(df)).first()
        assert (row["unique_count"], row["first"], row["last"]) == (3, datetime.datetime(2024, 3, 31, 2, 30), datetime.datetime(2024, 10, 27, 2, 30, 0, 1))
        text = profile.date_range(frame(spark, ["2024-03-31 02:30", "3/31/2024"], "string"), ["c"]).first()
        assert (text["first"], text["last"]) == (datetime.datetime(2024, 3, 31), datetime.datetime(2024, 3, 31, 2, 30))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_scratch_folder_without_a_setting(spark):
    from plumbline import InputError
    from plumbline.session import scratch_dir

    class Conf(dict):
        set = dict.__setitem__

    class Stub:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), type("Context", (), {"master": master})

    local = Stub("local[2]")
    assert scratch_dir(local) == scratch_dir(local) != scratch_dir(Stub("local[2]"))
    with pytest.raises(InputError):
        scratch_dir(Stub("yarn"))
    shared = Stub("yarn")
    shared.conf["spark.checkpoint.dir"] = "hdfs://shared/tmp"
    assert scratch_dir(shared) == "hdfs://shared/tmp"


def mixed(spark):
    rows = [(i % 7, i % 3 == 0, float(i % 5) / 4, None if i % 4 else f"t{i % 6}", "long " * 10 + str(i % 3), f"{i % 9}", None, float("nan") if i % 2 else 1.5) for i in range(400)]
    df = spark.createDataFrame(rows, "w int, flag boolean, x double, t string, long string, spelled string, none string, gap double")
    return df.withColumns({"day": F.expr("date_add(date'2020-01-01', w)"), "price": F.expr("cast(x as decimal(8,2))"), "small": F.col("x").cast("float")}).repartition(5)


def test_frequencies_answer_like_the_source(spark):
    df = mixed(spark)
    values = frequencies.Frequencies(df, df.columns)
    plain = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert plain(values.distinct()) == plain(frequencies.distinct_counts(df, df.columns))
    assert plain(values.values(df.columns)) == plain(frequencies.value_frequencies(df, df.columns))
    assert plain(profile.category_summary(df, df.columns, values=values)) == plain(profile.category_summary(df, df.columns))
    assert values.spelled("long") is None and values.spelled("w") is not None
    probs = [0.0, 0.25, 0.5, 0.9]
    exact = ordering.quantile_values(df, ["w", "x", "gap"], probs)
    assert values.quantiles(["w", "x", "gap", "t", "day"], probs, 100) == exact and values.quantiles(["w"], probs, 2) == {}
    empty = frequencies.Frequencies(df.limit(0), df.columns)
    assert set(empty.unique.values()) == {0} and empty.quantiles(["w"], probs, 5) == {"w": [None] * 4}


def test_statistics_scan_a_wide_table_once(spark, folder):
    df = mixed(spark)
    wide = df.select("*", *[F.col("x").alias(f"x{i}") for i in range(30)], *[F.col("t").alias(f"t{i}") for i in range(10)])
    wide.write.parquet(f"{folder}/wide")
    stats = profile.column_stats(spark.read.parquet(f"{folder}/wide"))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    rows = {r["column_name"]: r for r in stats.collect()}
    assert len(rows) == len(wide.columns) and rows["x29"]["mean"] == pytest.approx(rows["x"]["mean"]) and rows["t"]["present_count"] == 100
    assert (rows["none"]["present_count"], rows["none"]["row_count"], rows["gap"]["present_count"]) == (0, 400, 200)
