"""Sketches of files, kept and merged."""

import os

import numpy as np
import pytest

from plumbline import InputError
from plumbline.sources import sketches


def add(spark, folder, name, low, high, extra=False):
    df = spark.range(low, high).selectExpr("id", "cast(id % 1000 as double) / 10 as x", "case when id % 4 > 0 then concat('t', cast(sqrt(id % 100) as int)) end as t",
                                           "repeat(cast(id % 7 as string), 300) as long", "array(id) as nested", *(["id % 3 as more"] if extra else []))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/data/{name}")


def test_only_new_files_are_read(spark, folder, monkeypatch):
    add(spark, folder, "a b", 0, 6000)
    add(spark, folder, "c", 6000, 9000)
    assert sketches.refresh(spark, f"{folder}/data", f"{folder}/store") == 2
    first = {r["column_name"]: r for r in sketches.sketched_profile(spark, f"{folder}/data", f"{folder}/store").collect()}
    assert set(first) == {"id", "x", "t", "long"} and first["id"]["row_count"] == 9000
    add(spark, folder, "d", 9000, 20000, extra=True)
    reads = []
    plain = sketches.sketched
    monkeypatch.setattr(sketches, "sketched", lambda df: (reads.append(len(df.inputFiles())), plain(df))[1])
    rows = {r["column_name"]: r for r in sketches.sketched_profile(spark, f"{folder}/data", f"{folder}/store").collect()}
    assert reads == [1]                                   # one added file, one file read
    assert sketches.refresh(spark, f"{folder}/data", f"{folder}/store") == 0
    ids = np.arange(20000)
    assert rows["id"]["row_count"] == 20000 and abs(rows["id"]["unique_count"] / 20000 - 1) < 0.03
    assert (rows["id"]["min"], rows["id"]["max"], rows["id"]["mean"]) == (0, 19999, pytest.approx(ids.mean()))
    for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        assert abs(rows["id"][name] / 20000 - p) < 0.01 and abs(rows["x"][name] - np.quantile(ids % 1000 / 10, p)) < 1
    assert rows["t"]["present_count"] == 15000 and rows["t"]["missing_pct"] == 0.25 and rows["t"]["unique_count"] == 9
    words, counts = np.unique([f"t{int(np.sqrt(i % 100))}" for i in ids if i % 4], return_counts=True)
    assert sorted((v["count"] for v in rows["t"]["top_values"]), reverse=True) == sorted(counts, reverse=True)[:5]
    assert {v["value"]: v["count"] for v in rows["t"]["top_values"]}.items() <= dict(zip(words, counts)).items()
    assert rows["long"]["unique_count"] == 7 and rows["long"]["top_values"] == [] and rows["long"]["mean"] is None
    assert rows["more"]["present_count"] == 11000 and rows["more"]["missing_pct"] == pytest.approx(9 / 20)


def test_changed_and_deleted_files(spark, folder):
    add(spark, folder, "a", 0, 100)
    add(spark, folder, "b", 100, 300)
    profile = lambda: {r["column_name"]: r for r in sketches.sketched_profile(spark, f"{folder}/data", f"{folder}/store").collect()}["id"]
    assert (profile()["row_count"], profile()["max"]) == (300, 299)
    spark.range(5000, 5010).selectExpr("id").coalesce(1).write.mode("overwrite").parquet(f"{folder}/data/b")
    assert (profile()["row_count"], profile()["max"]) == (110, 5009)
    os.makedirs(f"{folder}/none")
    with pytest.raises(InputError):
        sketches.sketched_profile(spark, f"{folder}/none", f"{folder}/other")


def test_cells_are_not_rows_of_their_own(spark, folder):
    """Rows reach the sketches as they are; only finished sketches are unfolded into columns."""
    spark.createDataFrame([(i, f"t{i % 3}", None if i % 2 else 0.5) for i in range(20)], "id long, t string, x double").write.parquet(f"{folder}/data")
    made = sketches.sketched(spark.read.parquet(f"{folder}/data"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Generate") == 1
    found = {r["column_name"]: r for r in made.groupBy("column_name").agg({"rows": "sum", "present": "sum", "number_sum": "sum"}).collect()}
    assert {c: (r["sum(rows)"], r["sum(present)"], r["sum(number_sum)"]) for c, r in found.items()} == {"id": (20, 20, 190.0), "t": (20, 20, None), "x": (20, 10, 5.0)}
