"""Delimited files with line breaks inside quoted cells, cut into small blocks."""

import csv
import os
import random

import pytest

from plumbline.sources import delimited, tables

CELLS = ["plain", "", "two words", 'say "hi"', "a,b", "line\nbreak", "three\n\nline\nbreaks, and \"quotes\"", "5\" disk", "x" * 300 + "\n" + "y" * 300, "é\nß", "\n", '"']


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "512", "spark.sql.files.openCostInBytes": "1"}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(path, rows, ending="\n"):
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out, lineterminator=ending).writerows(rows)


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [[str(i), *(rng.choice(CELLS) for _ in range(3))] for i in range(n)]


def known(rows):
    return sorted((tuple(None if c in ("", "None") else c for c in r) for r in rows), key=str)


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_is_read_by_many_tasks(spark, folder, small_blocks, ending):
    rows = random_rows(1)
    write(f"{folder}/a.csv", [["id", "a", "b", "c"], *rows], ending)
    names, found = delimited.records(spark, f"{folder}/a.csv", ",")
    assert names == ["id", "a", "b", "c"] and found.count() == 120
    df = delimited.read_delimited(spark, f"{folder}/a.csv", ",")
    assert df.columns == names and known(df.collect()) == known(rows)
    assert df.rdd.getNumPartitions() > os.path.getsize(f"{folder}/a.csv") / 1024
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_many_files_and_cells_longer_than_blocks(spark, folder, small_blocks):
    everything = []
    for i in range(3):
        rows = random_rows(i + 10, 10 + 10 * i) + [[f"long{i}", "begin\n" + "\n".join(f"w{j}" * 9 for j in range(150)) + "\nend", "next", "q\"\n"]] + random_rows(i + 20, 5)
        write(f"{folder}/{i}.csv", [["id", "a", "b", "c"], *rows])
        everything += rows
    assert known(delimited.read_delimited(spark, folder, ",").collect()) == known(everything)
    df = tables.read_table(spark, folder, "csv", ",")
    assert df.count() == len(everything)


@pytest.mark.parametrize("size", [128, 200, 333])
def test_every_cut_gives_the_same_records(spark, folder, size):
    rows = random_rows(5, 60)
    write(f"{folder}/a.csv", [["id", "a", "b", "c"], *rows])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        assert known(delimited.read_delimited(spark, f"{folder}/a.csv", ",").collect()) == known(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_odd_quotes(spark, folder, small_blocks):
    """Quotes inside plain cells open nothing; an unclosed cell takes the rest of its file only."""
    with open(f"{folder}/a.csv", "w") as out:
        out.write('id;"a\nb";c\n1;5" disk;x\n2;"open\nclosed";y\n' + "".join(f'{i};6" nail;z\n' for i in range(3, 200)) + '200;"never\nclosed;z\n201;w;w\n')
    with open(f"{folder}/b.csv", "w") as out:
        out.write('id;"a\nb";c\n\n300;"in";"x ""y"" z"\n')
    df = delimited.read_delimited(spark, folder, ";")
    found = {r["id"]: tuple(r)[1:] for r in df.collect()}
    assert df.columns == ["id", "a\nb", "c"] and len(found) == 201
    assert found["1"] == ('5" disk', "x") and found["2"] == ("open\nclosed", "y") and found["150"] == ('6" nail', "z") and found["300"] == ("in", 'x "y" z')
    assert found["200"][0].startswith("never\nclosed;z\n201")


def test_no_rows(spark, folder):
    with open(f"{folder}/a.csv", "w") as out:
        out.write('id,"a\nb"\n')
    df = delimited.read_delimited(spark, f"{folder}/a.csv", ",")
    assert df.columns == ["id", "a\nb"] and df.count() == 0
    with open(f"{folder}/e.csv", "w"):
        pass
    assert delimited.read_delimited(spark, f"{folder}/e.csv", ",").count() == 0


def test_state_of_a_line():
    cases = [("a,b", 0, 0), ('"a', 0, 1), ('a"', 0, 0), ('a,"b', 0, 1), ('x",y', 1, 0), ('x"",y', 1, 1), ('x"",y"', 1, 0), ('x"z,"', 1, 1), ('"a"b"c,d', 0, 0), ('""', 0, 0), ('"""', 0, 1), ("", 1, 1)]
    assert [delimited.after_line(line, state, ",") for line, state, _ in cases] == [end for *_, end in cases]


def test_names_of_columns():
    assert delimited._cells('a,,A,"x\ny",b', ",") == ["a0", "_c1", "A2", "x\ny", "b"]


def test_long_records_fill_no_batch_without_bound():
    """Batches close by their characters, too, and hold the same records."""
    lines = ["name,note"] + [f'{i},"{"x" * 40_000}' if i % 2 else '""y"' for i in range(1, 401)]
    column = lambda values, kind: delimited.pa.array(values, kind)
    batch = delimited.pa.RecordBatch.from_arrays([column([1] * len(lines), delimited.pa.int64()), column([0] * len(lines), delimited.pa.int64()), column(lines, delimited.pa.string())], names=["file", "block", "value"])
    made = [b.column("text").to_pylist() for b in delimited._assembled(iter([batch]), {}, ",", False)]
    assert [t for b in made for t in b] == [f"{a}\n{b}" for a, b in zip(lines[1::2], lines[2::2])]
    assert max(sum(map(len, b)) for b in made) < 3_000_000
