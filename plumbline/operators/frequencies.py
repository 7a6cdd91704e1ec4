"""Value-frequency tables: every column's distinct values with their counts.

One scan, one shuffle, partial aggregation on the map side. Later steps read
distinct values with weights instead of the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import DATED, as_number, col, families, known, micros
from plumbline.session import cut

NARROW = 24      # columns up to which a row is its own grouping key
LONG_TEXT = 31  # bytes up to which a text is its own distinct key


def melt(wide: DataFrame, keep: list[str] = (), name: str = "column_name", value: str = "value") -> DataFrame:
    """Long form of the columns that are not kept, without missing cells."""
    rest = [c for c in wide.columns if c not in keep]
    return wide.unpivot([col(k) for k in keep], [col(c) for c in rest], name, value).where(F.col(value).isNotNull())


def value_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n) with values as text."""
    kinds = families(df)
    wide = df.select(*[known(c, kinds[c]).cast("string").alias(c) for c in cols])
    return melt(wide).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def number_frequencies(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, n) with values as doubles."""
    kinds = families(df)
    wide = df.select(*[as_number(c, kinds[c]).alias(c) for c in cols])
    return melt(wide).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def _distinct_key(name: str, kind: str) -> tuple[Column, Column, Column]:
    """(whole, fraction, bytes): the one slot holding a column's key."""
    none_whole, none_fraction, none_bytes = (F.lit(None).cast(t) for t in ("bigint", "double", "binary"))
    c = known(name, kind)
    if kind in ("whole", "boolean"):
        return c.cast("bigint"), none_fraction, none_bytes
    if kind in DATED:
        return micros(c, kind), none_fraction, none_bytes
    if kind == "fraction":
        return none_whole, c.cast("double"), none_bytes
    text = c.cast("string")
    digest = F.unhex(F.sha2(text, 256))
    return none_whole, none_fraction, F.when(F.octet_length(text) > LONG_TEXT, digest).otherwise(F.encode(text, "utf-8"))


def _slot_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """(slot, w, f, b): the key of every cell that is not missing."""
    kinds = families(df)
    # A column number is a narrower shuffle key than a name.
    staged, groups = [], []
    for i, name in enumerate(cols):
        for slot, key in zip("wfb", _distinct_key(name, kinds[name])):
            staged.append(key.alias(f"{slot}{i}"))
        groups.append(f"(w{i}, f{i}, b{i}) AS `{i}`")
    return df.sparkSession.sql(
        "SELECT CAST(slot AS INT) AS slot, w, f, b FROM {wide} UNPIVOT INCLUDE NULLS "
        f"((w, f, b) FOR slot IN ({', '.join(groups)})) "
        "WHERE w IS NOT NULL OR f IS NOT NULL OR b IS NOT NULL",
        wide=df.select(*staged),
    )


def _named_counts(counts: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, unique_count) of all columns from (slot, unique_count) of those with values."""
    names = F.array(*[F.lit(c) for c in cols])
    every = counts.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("slot"))
    return every.join(counts, "slot", "left").select(
        F.element_at(names, F.col("slot") + 1).alias("column_name"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, unique_count), exact, missing values left out.

    Numbers keep their native key; long texts are shuffled as a 256-bit digest,
    so a text column costs 32 bytes a row and not its whole length.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, unique_count bigint")
    once = _slot_keys(df, cols).groupBy("slot", "w", "f", "b").agg(F.lit(1).alias("_"))
    return _named_counts(once.groupBy("slot").agg(F.count("*").alias("unique_count")), cols)


class Frequencies:
    """The distinct values of all columns with their counts, written once.

    One scan and one shuffle make the table (slot, w, f, b, n); it is sorted by
    column inside its files, so that reading a column skips the rest. Distinct
    counts, most frequent values and quantiles of columns with few values come
    from it without another scan of the source.
    """

    def __init__(self, df: DataFrame, cols: list[str]):
        self.df, self.cols, self.kinds, self.types = df, cols, families(df), dict(df.dtypes)
        counted = _slot_keys(df, cols).groupBy("slot", "w", "f", "b").agg(F.count("*").alias("n")) if cols else df.sparkSession.createDataFrame([], "slot int, w bigint, f double, b binary, n bigint")
        self.table = cut(counted.sortWithinPartitions("slot"), "frequencies")
        digest = F.octet_length("b") > LONG_TEXT
        summary = self.table.groupBy("slot").agg(F.count("*").alias("unique_count"), F.max(F.coalesce(digest, F.lit(False))).alias("digested")).collect()
        self.unique = {c: 0 for c in cols} | {cols[r["slot"]]: r["unique_count"] for r in summary}
        self.digested = {cols[r["slot"]] for r in summary if r["digested"]}

    def distinct(self) -> DataFrame:
        """(column_name, unique_count)."""
        return self.df.sparkSession.createDataFrame(list(self.unique.items()), "column_name string, unique_count bigint")

    def spelled(self, name: str) -> Column | None:
        """The values of a column as text, where the table still has them."""
        kind = self.kinds[name]
        if kind == "whole":
            return F.col("w").cast("string")
        if kind == "boolean":
            return F.when(F.col("w") == 1, "true").otherwise("false")
        if kind == "fraction" and self.types[name] == "double":
            return F.col("f").cast("string")
        if kind == "text" and name not in self.digested:
            return F.decode("b", "utf-8")
        return None

    def values(self, cols: list[str]) -> DataFrame:
        """(column_name, value, n) with values as text; columns whose text is not kept are counted anew."""
        held = {c: self.spelled(c) for c in cols}
        parts = [self.table.where(F.col("slot") == self.cols.index(c)).select(F.lit(c).alias("column_name"), text.alias("value"), "n") for c, text in held.items() if text is not None]
        rest = [c for c, text in held.items() if text is None]
        if rest:
            parts.append(value_frequencies(self.df, rest))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def quantiles(self, cols: list[str], probs: list[float], most: int) -> dict[str, list[float | None]]:
        """Exact quantiles of the numeric columns among `cols` with at most so many values."""
        small = [c for c in cols if self.kinds[c] in ("whole", "fraction") and self.unique[c] <= most]
        if not small:
            return {}
        slots = [self.cols.index(c) for c in small]
        at = F.array(*[F.lit(float(p)) for p in probs])
        found = (self.table.where(F.col("slot").isin(slots)).groupBy("slot")
                 .agg(F.percentile(F.coalesce(F.col("w").cast("double"), F.col("f")), at, F.col("n")).alias("q")).collect())
        return {c: [None] * len(probs) for c in small} | {self.cols[r["slot"]]: list(r["q"]) for r in found}


def row_digest(df: DataFrame) -> Column:
    """256-bit digest of a whole row; a missing cell equals a missing cell."""
    kinds = families(df)
    parts = []
    for field in df.schema.fields:
        c = known(field.name, kinds[field.name])
        text = F.to_json(F.struct(c)) if _is_nested(field, kinds) else c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws("|", *parts), 256)


def _is_nested(field: T.StructField, kinds: dict[str, str]) -> bool:
    return kinds[field.name] == "nested" and not isinstance(field.dataType, T.BinaryType)


def copy_keys(df: DataFrame) -> list[Column]:
    """What two rows must share to be copies of each other.

    Narrow tables group by their own cells, long texts shortened to a digest;
    wide tables group by one digest of the whole row.
    """
    kinds = families(df)
    if len(df.columns) > NARROW or any(_is_nested(f, kinds) for f in df.schema.fields):
        return [row_digest(df).alias("k0")]
    keys = []
    for i, name in enumerate(df.columns):
        w, f, b = _distinct_key(name, kinds[name])
        kind = kinds[name]
        keys.append((w if kind in ("whole", "boolean", *DATED) else f if kind == "fraction" else b).alias(f"k{i}"))
    return keys


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows, rows beyond their first copy, and that share."""
    keys = copy_keys(df)
    copies = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias("n"))
    rows, extra = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))
    return copies.agg(
        rows.cast("bigint").alias("row_count"),
        extra.cast("bigint").alias("duplicate_rows"),
        F.when(rows > 0, extra / rows).otherwise(0.0).alias("duplicates_pct"))
