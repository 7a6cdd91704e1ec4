"""Order statistics without ever sorting a column inside one task.

`running_counts` is the building block: a range shuffle spreads the ordered
distinct values over many tasks, each task counts its own stretch, and the
few per-stretch totals give every stretch its starting position.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_number, col, families
from plumbline.operators.frequencies import melt, number_frequencies
from plumbline.session import cut

SKETCH_ACCURACY = 10_000   # rank error of the sketch is at most rows / accuracy
FEW_VALUES = 50_000        # distinct values up to which percentile() keeps a small state


def running_counts(freq: DataFrame, keys: list[str], order: list[str], weight: str = "n") -> DataFrame:
    """Add `before`: how many rows of the key come ahead of this entry.

    The entries are written once with the number of the range partition they
    fell into, because both reads below must see the same partitioning.
    """
    ranged = cut(freq.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_rows"))
              .select(*keys, "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_start")))
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # At most partitions + keys start rows exist: ranges are contiguous.
    return (ranged.join(F.broadcast(starts), [*keys, "_part"])
            .withColumn("before", F.col("_start") + F.coalesce(F.sum(weight).over(local), F.lit(0)))
            .drop("_part", "_start"))


def average_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n, avg_rank): equal values share their mean rank."""
    placed = running_counts(number_frequencies(df, cols), ["column_name"], ["value"])
    return placed.select("column_name", "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def _bracketed(wide: DataFrame, brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Counts of the values inside the brackets, and of the gaps between them.

    Zone 2i+1 is bracket i, even zones are gaps. Only bracket values keep their
    identity, so everything else collapses to a handful of rows on the map side.
    """
    long = melt(wide)
    zone, value = F.lit(None).cast("int"), F.lit(None).cast("double")
    for name, spans in brackets.items():
        of_column = F.lit(2 * len(spans))
        inside = F.lit(False)
        for i, (low, high) in reversed(list(enumerate(spans))):
            of_column = (F.when(F.col("value") < low, 2 * i)
                         .when(F.col("value") <= high, 2 * i + 1).otherwise(of_column))
            inside = inside | F.col("value").between(low, high)
        here = F.col("column_name") == name
        zone = F.when(here, of_column).otherwise(zone)
        value = F.when(here, F.when(inside, F.col("value"))).otherwise(value)
    return (long.select("column_name", zone.alias("zone"), value.alias("value"))
            .groupBy("column_name", "zone", "value").agg(F.count("*").alias("n")))


def _merge(spans: list[tuple[float, float]]) -> list[tuple[float, float]]:
    merged: list[tuple[float, float]] = []
    for low, high in sorted(spans):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def _select_ranks(wide: DataFrame, brackets, ranks: dict[str, list[int]]) -> dict[str, dict[int, float | None]]:
    placed = running_counts(_bracketed(wide, brackets), ["column_name"], ["zone", "value"])
    hit = F.lit(False)
    for name, wanted in ranks.items():
        for k in wanted:
            hit = hit | ((F.col("column_name") == name) & (F.col("before") <= k) & (F.col("before") + F.col("n") > k))
    found: dict[str, dict[int, float | None]] = {name: {} for name in ranks}
    for row in placed.where(hit).collect():        # at most columns x ranks rows
        for k in ranks[row["column_name"]]:
            if row["before"] <= k < row["before"] + row["n"]:
                found[row["column_name"]][k] = row["value"]
    return found


def quantile_values(df: DataFrame, cols: list[str], probs: list[float],
                    distinct: dict[str, int] | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of many columns, on the driver.

    One scan sketches every column. Columns with few distinct values finish
    with percentile(), whose state is one entry per distinct value. For the
    others the sketch brackets each wanted rank within rows/accuracy and a
    second scan orders only the values inside the brackets. Should a rank fall
    outside its bracket, the column is ordered as a whole. `distinct` passes on
    distinct counts that are known already.
    """
    kinds = families(df)
    wide = df.select(*[as_number(c, kinds[c]).alias(c) for c in cols])
    slack = 4 / SKETCH_ACCURACY
    points = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)})
    distinct = distinct or {}
    few = [c for c in cols if 0 < distinct.get(c, FEW_VALUES + 1) <= FEW_VALUES]
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    sketched = [c for c in cols if c not in few and distinct.get(c) != 0]
    many, sketch = [], {}
    if sketched:
        sketch = wide.agg(*[e for i, c in enumerate(sketched) for e in (
            F.count(col(c)).alias(f"n{i}"), F.approx_count_distinct(col(c), 0.05).alias(f"d{i}"),
            F.percentile_approx(col(c), points, SKETCH_ACCURACY).alias(f"q{i}"))]).first()
        for i, c in enumerate(sketched):
            if sketch[f"n{i}"]:
                (few if sketch[f"d{i}"] <= FEW_VALUES else many).append(c)
    if few:
        row = wide.agg(*[F.percentile(col(c), F.array(*[F.lit(float(p)) for p in probs])).alias(f"p{i}")
                         for i, c in enumerate(few)]).first()
        result.update({c: list(row[f"p{i}"]) for i, c in enumerate(few)})
    if many:
        at, brackets, ranks = {}, {}, {}
        for c in many:
            i = sketched.index(c)
            n = sketch[f"n{i}"]
            value_at = dict(zip(points, sketch[f"q{i}"]))
            brackets[c] = _merge([(value_at[max(0.0, p - slack)], value_at[min(1.0, p + slack)]) for p in probs])
            at[c] = [p * (n - 1) for p in probs]
            ranks[c] = sorted({k for x in at[c] for k in (math.floor(x), math.ceil(x))})
        found = _select_ranks(wide.select(*[col(c) for c in many]), brackets, ranks)
        missed = [c for c in many if any(found[c].get(k) is None for k in ranks[c])]
        if missed:
            everything = {c: [(-math.inf, math.inf)] for c in missed}
            found.update(_select_ranks(wide.select(*[col(c) for c in missed]), everything, {c: ranks[c] for c in missed}))
        for c in many:
            result[c] = []
            for x in at[c]:
                low, high = found[c][math.floor(x)], found[c][math.ceil(x)]
                result[c].append(low + (high - low) * (x - math.floor(x)))
    return result


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column_name, prob, value): exact quantiles as a table."""
    values = quantile_values(df, cols, probs)
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, values[c])]
    return df.sparkSession.createDataFrame(rows, "column_name string, prob double, value double")
