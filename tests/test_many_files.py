"""Arrow files and workbooks of many schemas, read without a loop on the driver."""

import gc
import os

import pandas as pd
import pyarrow as pa
import pytest

from catalog import intake
from catalog.intake import write_workbooks
from plumbline import InputError, read_table
from plumbline.sources import arrow, listing, workbook


def arrow_file(path, columns, batch=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    table = pa.table(columns)
    with pa.OSFile(path, "wb") as out, pa.ipc.new_file(out, table.schema) as sink:
        sink.write_table(table, max_chunksize=batch)


def test_files_of_many_schemas(spark, folder, monkeypatch):
    """Columns in the order they are met, the wider number, missing ones NULL; headers in several rounds of merging."""
    monkeypatch.setattr(listing, "HEADERS_PER_TASK", 4)
    monkeypatch.setattr(listing, "FILES_PER_TASK", 7)
    for i in range(60):
        name = "feather" if i % 2 else "ARROW"
        arrow_file(f"{folder}/{i % 3}/f{i:02d}.{name}", {"id": [i * 10, i * 10 + 1], f"c{i % 20:02d}": [1.5, None], "n": pa.array([i, i], pa.int32() if i % 2 else pa.int64())})
    os.makedirs(f"{folder}/x")
    open(f"{folder}/x/other.txt", "w").close()
    opened = []
    plain = arrow.open_file
    monkeypatch.setattr(arrow, "open_file", lambda path: (opened.append(path), plain(path))[1])
    df = arrow.read_arrow(spark, folder)
    assert not opened                                     # the driver opens no file
    paths = sorted(f"{i % 3}/f{i:02d}" for i in range(60))
    met = list(dict.fromkeys(c for p in paths for c in ("id", f"c{int(p[3:]) % 20:02d}", "n")))
    assert df.columns == met and dict(df.dtypes)["n"] == "bigint"
    rows = {r["id"]: r.asDict() for r in df.collect()}
    assert sorted(rows) == sorted([i * 10 for i in range(60)] + [i * 10 + 1 for i in range(60)])
    assert all(rows[i * 10][f"c{i % 20:02d}"] == 1.5 and sum(v is not None for v in rows[i * 10].values()) == 3 for i in range(60))
    assert read_table(spark, folder, "arrow").count() == 120


def test_stretches_of_one_file(spark, folder):
    arrow_file(f"{folder}/one.feather", {"x": list(range(5000))}, 10)
    df = arrow.read_arrow(spark, f"{folder}/one.feather")
    assert sorted(r["x"] for r in df.collect()) == list(range(5000)) and df.rdd.getNumPartitions() == 8
    arrow_file(f"{folder}/none/none.feather", {"x": pa.array([], pa.int64())})
    assert arrow.read_arrow(spark, f"{folder}/none").count() == 0
    with pytest.raises(InputError):
        arrow.read_arrow(spark, f"{folder}/nowhere")
    os.makedirs(f"{folder}/empty")
    with pytest.raises(InputError):
        arrow.read_arrow(spark, f"{folder}/empty")


def test_the_data_sources_still_read(spark, folder):
    arrow_file(f"{folder}/a/one.feather", {"x": [1, 2]})
    arrow_file(f"{folder}/a/two.feather", {"y": [1.5], "x": [3]})
    spark.dataSource.register(arrow.ArrowFiles)
    rows = spark.read.format("plumbline_arrow").load(f"{folder}/a").collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [(1, None), (2, None), (3, 1.5)] or len(rows) == 3
    spark.dataSource.register(workbook.Workbooks)
    books = write_workbooks(spark.range(30).selectExpr("id", "cast(id % 3 as string) as t"), "t")
    assert spark.read.format("plumbline_workbooks").load(books).count() == read_table(spark, books, "workbook").count() == 30


def test_workbooks_are_bounded_and_read_as_a_stream(spark, monkeypatch):
    monkeypatch.setattr(intake, "BOOK_ROWS", 100)
    books = write_workbooks(spark.range(1000).selectExpr("id", "'v' AS t"), "t")
    paths = [f"{books}/{name}" for name in os.listdir(books) if name.endswith(".xlsx")]
    assert max(sum(1 for _ in workbook.sheet_rows(p)) for p in paths) < 200
    assert read_table(spark, books, "workbook").selectExpr("sum(id)", "count(*)").first()[:] == (499500, 1000)
    one = f"{books}/one.xlsx"
    with open(one, "wb") as sink:
        sink.write(intake._sheet(pd.DataFrame({"a": range(3000)})))
    rows = workbook.sheet_rows(one)
    held = [sum(type(x).__name__ == "Element" for x in gc.get_objects()) for i, _ in enumerate(rows) if i % 1000 == 0]
    assert len(held) == 4 and held[-1] < held[0] + 1500
