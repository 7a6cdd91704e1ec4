"""Delimited files whose quoted cells may span lines, read by many tasks.

Spark splits a text file into blocks of lines. Whether a block begins inside a
quoted cell depends on everything before it, so each block is first read under
both assumptions, and says where either leaves the reader at its end and whether
a record ends in it at all. Following these steps from a file's first block to
its last gives the true start of every block. Then each task puts its own
records together; a record that a block border cuts comes back from both sides
in pieces, and the pieces are joined by the block where it begins.

What tasks need of other blocks is one entry for each block whose border cuts a
record, at most one for `spark.sql.files.maxPartitionBytes` of input.

A quote opens a cell only where the cell begins, two quotes in a quoted cell are
one, and what follows a closing quote up to the next separator is plain text.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut, ship

ship(__name__)

OUTSIDE, INSIDE = 0, 1
QUOTE = '"'
RECORDS = 20_000          # records of one Arrow batch, at most
CHARS = 1 << 21           # characters that close a batch before
LINES = 512               # lines of a batch that are Python texts at once


def after_line(line: str, state: int, sep: str) -> int:
    """Whether the end of a line is inside a quoted cell, given its start."""
    at = 0
    while True:
        if state == INSIDE:
            closing = line.find(QUOTE, at)
            if closing < 0:
                return INSIDE
            if line.startswith(QUOTE, closing + 1):
                at = closing + 2
                continue
            following = line.find(sep, closing + 1)
            if following < 0:
                return OUTSIDE
            at, state = following + 1, OUTSIDE
        quote = line.find(QUOTE, at)
        if quote < 0:
            return OUTSIDE
        cell = line.rfind(sep, at, quote) + 1 or at
        if cell == quote:
            at, state = quote + 1, INSIDE
        else:
            following = line.find(sep, quote)
            if following < 0:
                return OUTSIDE
            at = following + 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, path, value): lines with the block they are in; a task has whole blocks, in order."""
    meta = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return meta.select(F.xxhash64("file_path").alias("file"), F.col("file_block_start").alias("block"), F.col("file_path").alias("path"), "value")


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, int, str, bool]]:
    """(file, block, line or path, first of its block) of every row."""
    last = None
    for batch in batches:
        for start in range(0, batch.num_rows, LINES):
            some = batch.slice(start, LINES)
            for file, block, text in zip(some.column("file").to_pylist(), some.column("block").to_pylist(), some.column(column).to_pylist()):
                yield file, block, text, (file, block) != last
                last = file, block


def _steps(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, path, end0, end1, breaks1, header): what a block does under both assumptions.

    `breaks1`: a record ends in the block if it begins inside a cell; `header`: the first record of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        for batch in batches:
            paths = batch.column("path")
            for i, (file, block, line, _) in enumerate(_blocks(iter([batch]), "value")):
                if not found or (found[-1]["file"], found[-1]["block"]) != (file, block):
                    found.append({"file": file, "block": block, "path": paths[i].as_py(), "end0": OUTSIDE, "end1": INSIDE, "breaks1": False, "header": [] if block == 0 else None, "whole": False})
                now = found[-1]
                if now["header"] is not None and not now["whole"]:
                    now["header"].append(line.removesuffix("\r"))
                if QUOTE in line:
                    bare = line.removesuffix("\r")
                    now["end0"], now["end1"] = after_line(bare, now["end0"], sep), after_line(bare, now["end1"], sep)
                now["whole"] = now["whole"] or now["end0"] == OUTSIDE
                now["breaks1"] = now["breaks1"] or now["end1"] == OUTSIDE
        columns = {n: [f[n] for f in found] for n in ("file", "block", "path", "end0", "end1", "breaks1", "header")}
        columns["header"] = [None if h is None else "\n".join(h) for h in columns["header"]]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns.values(), kinds)], names=list(columns))

    return lines.mapInArrow(run, "file long, block long, path string, end0 int, end1 int, breaks1 boolean, header string")


def _followed(blocks: pd.DataFrame) -> pd.DataFrame:
    """(file, block, inside, opened, goes_on) of those blocks of one file that a
    record is cut by: whether it begins inside a cell, the block where its first
    record began, and whether its last record goes on in the next block."""
    state, opened, out = OUTSIDE, 0, []
    rows = list(blocks.sort_values("block").itertuples())
    for i, row in enumerate(rows):
        inside = state == INSIDE
        state = row.end1 if inside else row.end0
        began = opened if inside else row.block
        opened = row.block if not inside or row.breaks1 else opened
        goes_on = state == INSIDE and i + 1 < len(rows)
        if inside or goes_on:
            out.append((row.file, row.block, inside, began, goes_on))
    return pd.DataFrame(out, columns=["file", "block", "inside", "opened", "goes_on"])


def _assembled(batches: Iterator[pa.RecordBatch], borders: dict[tuple[int, int], tuple[bool, int, bool]], sep: str, pieces: bool) -> Iterator[pa.RecordBatch]:
    """The whole records of the blocks, without headers; or the pieces of those that a border cuts."""
    out: list[tuple[int, int, int, bool, str]] = []
    held: list[str] = []
    state, header, opened, goes_on = OUTSIDE, False, 0, False
    file = block = -1
    chars = 0                                             # in `out`

    def close(whole: bool) -> None:
        nonlocal chars
        piece = not whole or opened != block
        if held and piece == pieces and (piece or not header):
            out.append((file, opened, block, header, "\n".join(held)))
            chars += len(out[-1][4])

    def flush() -> pa.RecordBatch:
        nonlocal chars
        kinds = (("file", pa.int64()), ("opened", pa.int64()), ("block", pa.int64()), ("header", pa.bool_()), ("text", pa.string()))
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])
        out.clear()
        chars = 0
        return batch

    for now_file, now_block, line, new in _blocks(batches, "value"):
        if new:
            close(not goes_on)                            # what is left of the block before
            file, block, held, header = now_file, now_block, [], now_block == 0
            inside, opened, goes_on = borders.get((file, block), (False, block, False))
            state = INSIDE if inside else OUTSIDE
        bare = line.removesuffix("\r")
        if QUOTE in line:
            state = after_line(bare, state, sep)
        held.append(bare if state == OUTSIDE else line)
        if state == OUTSIDE:
            close(True)
            held, opened, header = [], block, False
            if len(out) >= RECORDS or chars >= CHARS:
                yield flush()
    close(not goes_on)
    yield flush()


def records(spark: SparkSession, path: str, sep: str) -> tuple[list[str], DataFrame]:
    """The header's cells, and (text): every other record of all files with its line breaks."""
    lines = _lines(spark, path)
    steps = cut(_steps(lines, sep), "csv_blocks")
    first = steps.where("header is not null").agg(F.min(F.struct("path", "header")).alias("first"), F.countDistinct("path").alias("paths"), F.countDistinct("file").alias("files")).first()
    if first["first"] is None:
        return [], spark.createDataFrame([], "text string")
    if first["paths"] != first["files"]:
        raise RuntimeError("two paths share one hash: rename one of the files")
    cuts = steps.groupBy("file").applyInPandas(_followed, "file long, block long, inside boolean, opened long, goes_on boolean")
    borders = {(r["file"], r["block"]): (r["inside"], r["opened"], r["goes_on"]) for r in cuts.collect()}
    schema = "file long, opened long, block long, header boolean, text string"
    plain = lines.select("file", "block", "value")
    whole = plain.mapInArrow(lambda batches: _assembled(batches, borders, sep, False), schema).select("text")
    names = _cells(first["first"]["header"], sep)
    if not borders:
        return names, whole
    near = F.broadcast(spark.createDataFrame(sorted(borders), "file long, block long"))
    pieces = plain.join(near, ["file", "block"]).mapInArrow(lambda batches: _assembled(batches, borders, sep, True), schema)
    joined = (pieces.groupBy("file", "opened").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"), F.max("header").alias("header"))
              .where("not header").select(F.array_join(F.col("parts.text"), "\n").alias("text")))
    return names, whole.unionByName(cut(joined, "csv_cut_records"))


def _cells(record: str, sep: str) -> list[str]:
    """Column names of a header record: nameless and repeated ones get their place."""
    names = next(csv.reader([record], delimiter=sep)) if "\n" not in record else next(csv.reader(record.splitlines(keepends=True), delimiter=sep))
    seen = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All cells as text, one column for each cell of the header."""
    names, found = records(spark, path, sep)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    if not names:
        return spark.createDataFrame([], "struct<>")
    cells = F.from_csv("text", schema, {"sep": sep, "quote": QUOTE, "escape": QUOTE, "maxCharsPerColumn": "-1"})
    return found.where(F.length("text") > 0).select(cells.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
