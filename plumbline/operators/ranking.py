"""Ranks of many columns at once, and their correlations.

A column of few values needs no order of its rows: its values' counts, a bounded
number, give the rank of each value, which tasks look up.

The cells (row, side, value) of every other column are dealt once by ranges of
(value, row). A task then ranks its own stretch in place; how many rows of
a side come before it, and how far a value reaches over a border, follows from
the counts and border values of the stretches, two of each at most. A value
that a third of the rows share spreads over as many tasks as it fills.

A cell takes the values of its partners of few values along, so the task that
ranks it adds up the products. Where both columns of a pair have many values, a
second shuffle brings their ranks of a row together. So there are at most two
shuffles of the cells, however many columns and pairs there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut, ship

ship(__name__)

#: Where a run of equal values lies in its stretch.
INNER, FIRST, LAST, ALONE = 0, 1, 2, 3
FEW = 1 << 16             # values of a side that is ranked by their counts, at most
ALL_FEW = 1 << 18         # values of all such sides, at most


def _value(c: str) -> Column:
    return F.col(c) + F.lit(0.0)                          # one zero


def value_ranks(sides: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every side of few values these in order, their average ranks and their counts, on the driver."""
    names = [c for c in sides.columns if c != "row"]
    guess = sides.agg(*[F.approx_count_distinct(_value(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    few, room = [], ALL_FEW
    for n, i in sorted((guess[f"n{i}"], i) for i in range(len(names))):
        if n <= min(FEW, room):
            few.append(i)
            room -= n
    if not few:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), _value(names[i]).alias("value")) for i in few]))
    counted = sides.select(cells.alias("cell")).select("cell.*").where("value is not null").groupBy("side", "value").agg(F.count("*").alias("n")).collect()
    of = defaultdict(list)
    for r in counted:
        of[r["side"]].append((r["value"], r["n"]))
    out = {}
    for i in few:
        table = np.array(sorted(of[i]), dtype=float).reshape(-1, 2)
        counts = table[:, 1]
        out[i] = table[:, 0], np.cumsum(counts) - counts + (counts + 1) / 2, counts
    return out


def stretches(sides: DataFrame, partners: dict[int, list[int]] | None = None) -> DataFrame:
    """(row, side, part, start, run, edge, value), written once: every cell with
    the place and length of its run of equal values among the side's cells in
    its stretch; `value` only at the edges. `sides`: `row` and one double column per side, in order.

    `partners`: the only sides taken, each with the sides whose values go along with its cells, as o0, o1, ..."""
    names = [c for c in sides.columns if c != "row"]
    partners = {i: [] for i in range(len(names))} if partners is None else partners
    along = [f"o{j}" for j in range(max((len(p) for p in partners.values()), default=0))]
    other = lambda p, j: _value(names[p[j]]) if j < len(p) else F.lit(None).cast("double")

    def cells(i: int, p: list[int]) -> DataFrame:
        """A side's cells in order; equal values are dealt by row, but need no order among themselves, so that one number is the whole key."""
        side = sides.select(F.lit(i).alias("side"), _value(names[i]).alias("value"), "row", *[other(p, j).alias(o) for j, o in enumerate(along)])
        return side.where("value is not null").repartitionByRange("value", "row").sortWithinPartitions("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] | None = None              # the run that may go on
        position, side_of, first_run = 0, -1, True        # cells of the current side so far

        def ranked(closing: bool, side: np.ndarray, value: np.ndarray, row: np.ndarray, *others: np.ndarray) -> pa.RecordBatch:
            nonlocal position, side_of, first_run
            head = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (value[1:] != value[:-1])])
            length = np.diff(np.r_[head, len(side)])
            if side[0] != side_of:
                position, side_of = 0, side[0]
            # places count from the first cell of the side
            begins = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
            zero = np.repeat(begins, np.diff(np.r_[begins, len(side)]))
            start = head - zero[head] + np.where(side[head] == side_of, position, 0)
            edge = np.zeros(len(head), dtype=np.int32)
            if first_run:
                edge[0] += FIRST
                first_run = False
            if closing:
                edge[-1] += LAST
            position = (position if side[-1] == side_of else 0) + int(len(side) - begins[-1])
            side_of = side[-1]
            each = lambda x: np.repeat(x, length)
            edges = each(edge)
            values = pa.array(value, mask=edges == INNER)
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(side), pa.array(np.full(len(row), part, dtype=np.int32)), pa.array(each(start)), pa.array(each(length)), pa.array(edges), values, *map(pa.array, others)],
                                              names=["row", "side", "part", "start", "run", "edge", "value", *along])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            side, value = now[:2]
            going = len(side) - int(np.argmax(~((side == side[-1]) & (value == value[-1]))[::-1])) if not ((side == side[-1]) & (value == value[-1])).all() else 0
            held = [x[going:] for x in now]
            if going:
                yield ranked(False, *(x[:going] for x in now))
        if held is not None:
            yield ranked(True, *held)

    ordered = reduce(DataFrame.unionAll, [cells(i, p) for i, p in partners.items()])
    schema = "row long, side int, part int, start long, run long, edge int, value double" + "".join(f", {o} double" for o in along)
    return cut(ordered.mapInArrow(run, schema), "stretches")


def _positions(table: DataFrame) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int, float], float], dict[int, int]]:
    """How many cells of the side come before each stretch, the rank of every
    border value, and each side's cells. Collected: the sides of every stretch,
    and two values of it."""
    counts = table.groupBy("side", "part").agg(F.count("*").alias("n")).collect()
    edges = table.where(F.col("edge") != INNER).groupBy("side", "part", "value").agg(F.min("start").alias("start"), F.min("run").alias("run")).collect()
    before, total = {}, defaultdict(int)
    for r in sorted(counts, key=lambda r: (r["side"], r["part"])):
        before[r["side"], r["part"]] = total[r["side"]]
        total[r["side"]] += r["n"]
    first, length = {}, defaultdict(int)
    for r in edges:
        at = r["side"], r["value"]
        first[at] = min(first.get(at, 1 << 62), before[r["side"], r["part"]] + r["start"])
        length[at] += r["run"]
    ranks = {(r["side"], r["part"], r["value"]): first[r["side"], r["value"]] + (length[r["side"], r["value"]] + 1) / 2 for r in edges}
    return before, ranks, dict(total)


def _placed(batches: Iterator[pa.RecordBatch], before: dict, ranks: dict) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of stretches, with the side and the rank of every cell."""
    for batch in batches:
        if not batch.num_rows:
            continue
        side, part, start, run, edge = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
        if (side[0] == side).all() and (part[0] == part).all():                  # as a stretch's file is, mostly
            offset = before[int(side[0]), int(part[0])]
        else:
            at, inverse = np.unique(side.astype(np.int64) << 32 | part, return_inverse=True)
            offset = np.array([before[int(k >> 32), int(k & 0xFFFFFFFF)] for k in at])[inverse]
        rank = offset + start + (run + 1) / 2
        borders = np.flatnonzero(edge != INNER)
        if len(borders):
            value = batch.column(6).take(pa.array(borders)).to_numpy(zero_copy_only=False)
            rank[borders] = [ranks[int(s), int(p), float(v)] for s, p, v in zip(side[borders], part[borders], value)]
        yield batch, side, rank.astype(np.float64)


def _row_ranks(table: DataFrame, before: dict, ranks: dict) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, side, rank in _placed(batches, before, ranks):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(side), pa.array(rank)], names=["row", "side", "rank"])

    return table.select("row", "side", "part", "start", "run", "edge", "value").mapInArrow(place, "row long, side int, rank double")


def row_ranks(sides: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(row, side, rank): the average rank of every cell among its side's; and each side's cells."""
    table = stretches(sides)
    before, ranks, total = _positions(table)
    return _row_ranks(table, before, ranks), total


def summed(parts: DataFrame, n: int) -> np.ndarray:
    """The sums of (pair, product) rows of n pairs."""
    out = np.zeros(n)
    for r in parts.groupBy("pair").agg(F.sum("product").alias("product")).collect():
        out[r["pair"]] = r["product"]
    return out


def sums_of(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["pair", "product"])


def rank_correlations(sides: DataFrame, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[float | None, int]]:
    """(rho, rows) of pairs of sides, on the driver. Both sides of a pair have
    values in the same rows. An undefined rho is None."""
    names = [c for c in sides.columns if c != "row"]
    width = len(names)
    few = value_ranks(sides)
    total = {i: int(counts.sum()) for i, (_, _, counts) in few.items()}
    shifted = {i: (values, ranks - (total[i] + 1) / 2) for i, (values, ranks, _) in few.items()}
    own = np.zeros(width)
    for i, (_, _, counts) in few.items():
        own[i] = (counts * shifted[i][1] ** 2).sum()
    product = {}

    def looked_up(side: int, value: np.ndarray) -> np.ndarray:
        values, ranks = shifted[side]
        known = ~np.isnan(value)
        out = np.zeros(len(value))
        out[known] = ranks[np.searchsorted(values, value[known])]
        return out

    simple = [p for p in pairs if p[0] in few and p[1] in few]
    if simple:
        met = sorted({i for p in simple for i in p})
        a, b = (np.array([met.index(p[at]) for p in simple]) for at in range(2))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(simple))
            for batch in batches:
                if batch.num_rows:
                    matrix = np.stack([looked_up(i, batch.column(at).to_numpy(zero_copy_only=False).astype(float)) for at, i in enumerate(met)], 1)
                    sums += (matrix.T @ matrix)[a, b]
            yield sums_of(sums)

        parts = sides.select(*[_value(names[i]).alias(f"v{i}") for i in met]).mapInArrow(coded, "pair long, product double")
        product |= dict(zip(simple, summed(parts, len(simple))))

    ranged = [i for i in range(width) if i not in few]
    if ranged:
        mixed = [p for p in pairs if (p[0] in few) != (p[1] in few)]
        partners = {i: sorted({x for p in mixed if i in p for x in p if x in few}) for i in ranged}
        table = stretches(sides, partners)
        before, ranks, found = _positions(table)
        total |= found
        centre = np.array([(total.get(i, 0) + 1) / 2 for i in range(width)])
        places = [(i, x, at) for i, p in partners.items() for at, x in enumerate(p)]

        def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width + len(places))
            for batch, side, rank in _placed(batches, before, ranks):
                rank = rank - centre[side]
                sums[:width] += np.bincount(side, rank * rank, width)
                for n, (i, x, at) in enumerate(places):
                    of = side == i
                    if of.any():
                        sums[width + n] += rank[of] @ looked_up(x, batch.column(7 + at).to_numpy(zero_copy_only=False)[of])
            yield sums_of(sums)

        sums = summed(table.mapInArrow(along, "pair long, product double"), width + len(places))
        own += sums[:width]
        with_few = {(i, x): s for (i, x, _), s in zip(places, sums[width:])}
        product |= {p: with_few[p if p in with_few else p[::-1]] for p in mixed}

        wide = [p for p in pairs if p[0] not in few and p[1] not in few]
        if wide:
            met = sorted({i for p in wide for i in p})
            product |= dict(zip(wide, summed(_joined(_row_ranks(table.where(F.col("side").isin(met)), before, ranks), wide, centre), len(wide))))

    out = {}
    for p, q in pairs:
        scale = (own[p] * own[q]) ** 0.5
        out[p, q] = (float(max(-1.0, min(1.0, product[p, q] / scale))) if scale > 0 else None, total.get(p, 0))
    return out


def _joined(ranks: DataFrame, pairs: list[tuple[int, int]], centre: np.ndarray) -> DataFrame:
    """(pair, product): parts of the sums of products of ranks, brought together by row."""
    a, b = np.array(pairs).T

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(len(pairs)), None

        def add(row: np.ndarray, side: np.ndarray, rank: np.ndarray) -> None:
            at = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
            matrix = np.zeros((int(at[-1]) + 1, len(centre)))
            matrix[at, side] = rank - centre[side]
            sums[:] += (matrix.T @ matrix)[a, b]

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                now = [np.concatenate([h, x]) for h, x in zip(held, now)]
            whole = int(np.argmax(now[0] == now[0][-1]))
            held = [x[whole:] for x in now]
            if whole:
                add(*(x[:whole] for x in now))
        if held is not None:
            add(*held)
        yield sums_of(sums)

    return ranks.repartition("row").sortWithinPartitions("row").mapInArrow(products, "pair long, product double")


def numbered_rows(wide: DataFrame) -> DataFrame:
    """The rows with a number `row` each, written once."""
    return cut(wide.withColumn("row", F.monotonically_increasing_id()), "rows")


def missing_masks(rows: DataFrame, cols: list[str], quoted: dict[str, Column]) -> dict[str, tuple]:
    """For every column what tells its set of missing rows from others'; () if none is missing."""
    gone = [F.when(quoted[c].isNull(), F.xxhash64("row", F.lit(salt))) for c in cols for salt in (1, 2)]
    aggs = [F.count_if(quoted[c].isNull()).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.bit_xor(g).alias(f"x{i // 2}_{i % 2}") for i, g in enumerate(gone)]
    found = rows.agg(*aggs).first()
    return {c: (found[f"n{i}"], found[f"x{i}_0"], found[f"x{i}_1"]) if found[f"n{i}"] else () for i, c in enumerate(cols)}
