"""Pairwise associations: Cramer's V, correlation ratio, Spearman's rho.

All pairs of a kind come out of one job; nothing loops over pairs with a job
each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import as_number, col, families, known, numbers
from plumbline.functions.tails import chi2_sf, f_sf, t_sf
from plumbline.operators.frequencies import melt
from plumbline.operators.ranking import missing_masks, numbered_rows, rank_correlations, summed, sums_of
from plumbline.session import cut, ship
from plumbline.settings import DEFAULTS, Settings

ship(__name__)

CAT_NUM, CAT_CAT, NUM_NUM = "categorical_numerical", "categorical_categorical", "numerical_numerical"
FEW_COLUMNS = 4     # up to here plain corr() beats products of matrices
NO_SPREAD = 1e-12   # variances up to here count as none


def column_pairs(types: DataFrame) -> DataFrame:
    """(kind, col_a, col_b) from (column_name, ordinal, inferred_type).

    The columns are gathered into one array, which every column is then
    matched against; booleans count as categories.
    """
    role = (F.when(F.col("inferred_type").isin("categorical", "boolean"), "c")
            .when(F.col("inferred_type") == "numerical", "n"))
    usable = types.where(role.isNotNull()).agg(F.collect_list(F.struct("ordinal", "column_name", role.alias("role"))).alias("every"))
    first = usable.select("every", F.explode("every").alias("a"))
    fits = lambda b: (((F.col("a.role") == b["role"]) & (F.col("a.ordinal") < b["ordinal"]))
                      | ((F.col("a.role") == "c") & (b["role"] == "n")))
    pairs = first.select("a", F.explode(F.filter("every", fits)).alias("b"))
    both = F.concat("a.role", "b.role")
    return pairs.select(F.when(both == "cn", CAT_NUM).when(both == "cc", CAT_CAT).otherwise(NUM_NUM).alias("kind"),
                        F.col("a.column_name").alias("col_a"), F.col("b.column_name").alias("col_b"))


# --- categories against categories -------------------------------------------------

def contingency(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, value_a, value_b, n) for all pairs, rows with a missing side left out."""
    kinds = families(df)
    text = {c: known(c, kinds[c]).cast("string") for pair in pairs for c in pair}
    wide = df.select(*[F.when(text[a].isNotNull() & text[b].isNotNull(),
                              F.struct(text[a].alias("value_a"), text[b].alias("value_b"))).alias(str(i))
                       for i, (a, b) in enumerate(pairs)])
    cells = (melt(wide, name="pair", value="cell").select(F.col("pair").cast("int").alias("pair"), "cell.value_a", "cell.value_b")
             .groupBy("pair", "value_a", "value_b").agg(F.count("*").alias("n")))
    return cells.select(_name(pairs, 0).alias("col_a"), _name(pairs, 1).alias("col_b"), "value_a", "value_b", "n")


def _name(pairs: list[tuple[str, str]], side: int) -> Column:
    return F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair") + 1)


def chi2_independence(cells: DataFrame) -> DataFrame:
    """(col_a, col_b, chi2, dof, n, smaller_side) of every contingency table.

    Empty cells add their expectation, and those add up to n less the
    expectations of the filled cells, so no value x value product is formed.
    A 2x2 table gets the continuity correction; all its cells deviate equally.
    """
    pair = ["col_a", "col_b"]
    rows = cells.groupBy(*pair, "value_a").agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy(*pair, "value_b").agg(F.sum("n").alias("col_n"))
    row_side = rows.groupBy(*pair).agg(F.sum("row_n").alias("total"), F.count("*").alias("r"), F.sum(1 / F.col("row_n")).alias("inv_r"))
    col_side = columns.groupBy(*pair).agg(F.count("*").alias("c"), F.sum(1 / F.col("col_n")).alias("inv_c"))
    sides = row_side.join(col_side, pair)
    expected = F.col("row_n").cast("double") * F.col("col_n") / F.col("total")
    off = F.abs(F.col("n") - F.col("e"))
    sums = (cells.join(rows, [*pair, "value_a"]).join(columns, [*pair, "value_b"]).join(row_side.select(*pair, "total"), pair)
            .withColumn("e", expected)
            .groupBy(*pair).agg(F.sum(off * off / F.col("e")).alias("filled"), F.sum("e").alias("filled_e"), F.max(off).alias("off")))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    corrected = F.col("off") - F.least(F.lit(0.5), F.col("off"))
    yates = corrected * corrected * F.col("total") * F.col("inv_r") * F.col("inv_c")
    plain = F.col("filled") + F.greatest(F.lit(0.0), F.col("total") - F.col("filled_e"))
    return sums.join(sides, pair).select(
        *pair, F.when(dof == 1, yates).otherwise(plain).alias("chi2"), dof.alias("dof"),
        F.col("total").alias("n"), F.least("r", "c").alias("smaller_side"))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, value, p_value, n); NULL where one side is constant or empty."""
    tests = chi2_independence(cut(contingency(df, pairs), "contingency"))            # read five times
    v = F.when(F.col("smaller_side") > 1, F.sqrt(F.col("chi2") / (F.col("n") * (F.col("smaller_side") - 1))))
    found = tests.select("col_a", "col_b", v.alias("value"), "n", F.when(F.col("smaller_side") > 1, F.col("chi2")).alias("chi2"), "dof")
    return (_listed(df, pairs).join(found, ["col_a", "col_b"], "left")
            .select("col_a", "col_b", "value", chi2_sf(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def _listed(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    every = F.explode(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")) for a, b in pairs]))
    return df.sparkSession.range(1).select(every.alias("p")).select("p.col_a", "p.col_b")


# --- categories against numbers ----------------------------------------------------

def grouped_moments(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """(col_a category column, category, col_b number column, n, mean, var_pop).

    Each row is expanded once per category column and met by partial
    aggregation before the shuffle.
    """
    kinds = families(df)
    x = [as_number(c, kinds[c]).alias(f"x{j}") for j, c in enumerate(nums)]
    wide = df.select(*x, *[known(c, kinds[c]).cast("string").alias(f"c{i}") for i, c in enumerate(cats)])
    long = wide.unpivot([f"x{j}" for j in range(len(nums))], [f"c{i}" for i in range(len(cats))], "slot", "category")
    aggs = [e for j in range(len(nums)) for e in (F.count(f"x{j}").alias(f"n{j}"), F.avg(f"x{j}").alias(f"m{j}"), F.var_pop(f"x{j}").alias(f"v{j}"))]
    grouped = long.where("category is not null").groupBy("slot", "category").agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("col_b"), F.col(f"n{j}").alias("n"), F.col(f"m{j}").alias("mean"), F.col(f"v{j}").alias("var_pop"))
                      for j, c in enumerate(nums)])
    column = F.element_at(F.array(*[F.lit(c) for c in cats]), F.substring("slot", 2, 9).cast("int") + 1)
    return grouped.select(column.alias("col_a"), "category", F.inline(cells)).where("n > 0")


def _sums_of_squares(moments: DataFrame) -> DataFrame:
    """Between and within sums of squares per (col_a, col_b)."""
    pair = ["col_a", "col_b"]
    totals = moments.groupBy(*pair).agg(F.sum("n").alias("n_all"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    off = F.col("mean") - F.col("grand")
    return moments.join(totals, pair).groupBy(*pair).agg(
        F.first("n_all").alias("n"), F.count("*").alias("groups"),
        F.sum(F.col("n") * off * off).alias("between"), F.sum(F.col("n") * F.col("var_pop")).alias("within"))


def anova_from(moments: DataFrame, least_rows: int = 2) -> DataFrame:
    """(col_a, col_b, f, d1, d2) over the groups with at least `least_rows` rows."""
    s = _sums_of_squares(moments.where(F.col("n") >= least_rows)).where("groups >= 2")
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    f = (F.when(d2 <= 0, None).when(F.col("within") > 0, (F.col("between") / d1) / (F.col("within") / F.nullif(d2, F.lit(0))))
         .when(F.col("between") > 0, F.lit(float("inf"))))
    return s.select("col_a", "col_b", f.alias("f"), d1.alias("d1"), d2.alias("d2"))


def anova_f(df: DataFrame, cats: list[str], nums: list[str], least_rows: int = 2) -> DataFrame:
    """(col_a, col_b, f, p_value, d1, d2)."""
    tests = anova_from(grouped_moments(df, cats, nums), least_rows)
    p = f_sf(F.col("f"), F.col("d1").cast("double"), F.col("d2").cast("double"))
    return tests.select("col_a", "col_b", "f", p.alias("p_value"), "d1", "d2")


def correlation_ratio(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """(col_a, col_b, value, p_value, n); NULL below two categories or without spread."""
    moments = cut(grouped_moments(df, cats, nums), "moments")            # read four times
    s = _sums_of_squares(moments)
    total = F.col("between") + F.col("within")
    eta = F.when((F.col("groups") >= 2) & (total > 0), F.sqrt(F.col("between") / F.nullif(total, F.lit(0.0))))
    tests = anova_from(moments).select("col_a", "col_b", "f", "d1", "d2")
    listed = _listed(df, [(a, b) for a in cats for b in nums])
    joined = (listed.join(s.select("col_a", "col_b", eta.alias("value"), "n"), ["col_a", "col_b"], "left")
              .join(tests, ["col_a", "col_b"], "left"))
    f = F.when(F.col("value").isNotNull(), F.col("f"))
    return joined.select("col_a", "col_b", "value", f_sf(f, F.col("d1").cast("double"), F.col("d2").cast("double")).alias("p_value"),
                         F.coalesce("n", F.lit(0)).alias("n"))


# --- numbers against numbers -------------------------------------------------------

def _corr(a: Column, b: Column) -> Column:
    """Pearson correlation; NULL for a constant side, where corr() itself raises under ANSI rules."""
    return F.covar_pop(a, b) / F.nullif(F.sqrt(F.var_pop(a) * F.var_pop(b)), F.lit(0.0))


def pearson(wide: DataFrame, cols: list[str]) -> dict[tuple[str, str], float | None]:
    """Correlations of all pairs over rows without missing cells, on the driver (columns x columns)."""
    pairs = list(combinations(cols, 2))
    if len(cols) <= FEW_COLUMNS:
        row = wide.agg(*[_corr(col(a), col(b)).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
        return {p: _number(row[str(i)]) for i, p in enumerate(pairs)}
    # Centre first: the Gram matrix would lose digits on large means.
    means = wide.agg(*[F.avg(col(c)).alias(str(i)) for i, c in enumerate(cols)]).first()
    if means["0"] is None:
        return {p: None for p in pairs}
    centred = wide.select(*[(col(c) - means[str(i)]).alias(f"x{i}") for i, c in enumerate(cols)])
    width = len(cols)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, width + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.stack([*(c.to_numpy(zero_copy_only=False) for c in batch.columns), np.ones(batch.num_rows)], 1)
                sums += x.T @ x
        yield sums_of(sums.ravel())

    sums = summed(centred.mapInArrow(products, "pair long, product double"), (width + 1) ** 2).reshape(width + 1, width + 1)
    n = sums[-1, -1]
    spread = (sums[:-1, :-1] - np.outer(sums[-1, :-1], sums[-1, :-1]) / n) / max(n - 1, 1)
    deviation = np.sqrt(np.where(np.diag(spread) > NO_SPREAD, np.diag(spread), np.nan))
    matrix = spread / np.outer(deviation, deviation)
    at = {c: i for i, c in enumerate(cols)}
    return {(a, b): _number(matrix[at[a], at[b]]) for a, b in pairs}


def _number(x) -> float | None:
    return None if x is None or x != x else max(-1.0, min(1.0, float(x)))


def _ranked_sides(rows: DataFrame, cols: list[str], pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """What has to be ranked for the pairs, and each pair as two of these sides.

    A side is a column over the rows where it and its partner have values;
    partners with the same missing rows share it."""
    masks = missing_masks(rows, cols, {c: col(c) for c in cols})
    standing = {m: c for c, m in reversed(masks.items()) if m}          # a column for every set of missing rows
    sides: dict[tuple, int] = {}
    places = [tuple(sides.setdefault((c, frozenset(x for x in (masks[a], masks[b]) if x)), len(sides)) for c in (a, b)) for a, b in pairs]
    wanted = []
    for (c, missing), i in sides.items():
        value = col(c)
        for m in missing:
            value = F.when(col(standing[m]).isNotNull(), value)
        wanted.append(value.alias(f"s{i}"))
    return rows.select("row", *wanted), places


def spearman(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(col_a, col_b, value, p_value, n) over the complete rows of each pair.

    All columns are ranked by one shuffle, see `ranking`; columns with the same
    missing rows share their ranks. Fewer than two complete rows give 0 without
    a p-value; an undefined rho is 0.
    """
    pairs = pairs or list(combinations(cols, 2))
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    short = {c: f"c{i}" for i, c in enumerate(cols)}
    rows = numbered_rows(numbers(df, cols).toDF(*short.values()))
    sides, places = _ranked_sides(rows, list(short.values()), [(short[a], short[b]) for a, b in pairs])
    rho = rank_correlations(sides, list(dict.fromkeys(places)))
    rows = [(a, b, *rho[p]) for (a, b), p in zip(pairs, places)]
    found = df.sparkSession.createDataFrame(rows, "col_a string, col_b string, rho double, n bigint")
    rho, dof = F.col("rho"), F.col("n") - 2
    t = F.when(F.abs(rho) < 1, rho * F.sqrt(dof / ((1 - rho) * (1 + rho)))).when(rho.isNotNull(), F.lit(float("inf")))
    t = F.when(dof > 0, t)
    return found.select("col_a", "col_b", F.coalesce("rho", F.lit(0.0)).alias("value"),
                        t_sf(t, dof.cast("double")).alias("p_value"), "n")


# --- all kinds -----------------------------------------------------------------------

def associations(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """(kind, col_a, col_b, value, p_value, n) of every pair of usable columns."""
    parts = []
    if cats and nums:
        parts.append((CAT_NUM, correlation_ratio(df, cats, nums)))
    if len(cats) > 1:
        parts.append((CAT_CAT, cramers_v(df, list(combinations(cats, 2)))))
    if len(nums) > 1:
        parts.append((NUM_NUM, spearman(df, nums)))
    result = df.sparkSession.createDataFrame([], "kind string, col_a string, col_b string, value double, p_value double, n bigint")
    for kind, part in parts:
        result = result.unionByName(part.select(F.lit(kind).alias("kind"), "*"))
    return result


def association_matrix(associations: DataFrame, kind: str) -> DataFrame:
    """Symmetric square table of one kind, diagonal 1, unknown pairs NULL."""
    one = associations.where(F.col("kind") == kind)
    ab = one.select(F.col("col_a").alias("column_name"), F.col("col_b").alias("other"), "value")
    ba = one.select(F.col("col_b").alias("column_name"), F.col("col_a").alias("other"), "value")
    names = ab.select("column_name").union(ba.select("column_name")).distinct()
    diagonal = names.select("column_name", F.col("column_name").alias("other"), F.lit(1.0).alias("value"))
    wanted = sorted(r["column_name"] for r in names.collect())     # one entry per column
    return ab.union(ba).union(diagonal).groupBy("column_name").pivot("other", wanted).agg(F.first("value", ignorenulls=True))


def heatmap_cells(associations: DataFrame, kind: str) -> DataFrame:
    """(column_name, other, value to 2 decimals): the matrix as long rows."""
    one = associations.where(F.col("kind") == kind)
    both = F.explode(F.array(F.struct(F.col("col_a").alias("column_name"), F.col("col_b").alias("other"), "value"),
                             F.struct(F.col("col_b").alias("column_name"), F.col("col_a").alias("other"), "value"),
                             F.struct(F.col("col_a").alias("column_name"), F.col("col_a").alias("other"), F.lit(1.0).alias("value")),
                             F.struct(F.col("col_b").alias("column_name"), F.col("col_b").alias("other"), F.lit(1.0).alias("value"))))
    cells = one.select(both.alias("c")).select("c.*")
    return cells.groupBy("column_name", "other").agg(F.round(F.max("value"), 2).alias("value"))


def significant(threshold: Column, settings: Settings = DEFAULTS) -> Column:
    return (F.abs("value") > threshold) & (F.col("p_value") < settings.p_value)


def strong_associations(associations: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    limit = (F.when(F.col("kind") == CAT_NUM, settings.correlation_ratio_strong)
             .when(F.col("kind") == CAT_CAT, settings.cramers_v_strong).otherwise(settings.spearman_strong))
    return associations.withColumn("threshold", limit).where(significant(F.col("threshold"), settings))


def leakage(associations: DataFrame, target: str, target_is_numeric: bool, settings: Settings = DEFAULTS) -> DataFrame:
    """(column_name, kind, value, p_value, threshold): features that all but equal the target."""
    limit = F.when(F.col("kind") == CAT_NUM, settings.correlation_ratio_leak)
    if target_is_numeric:
        limit = limit.when(F.col("kind") == NUM_NUM, settings.spearman_leak)
    else:
        limit = limit.when(F.col("kind") == CAT_CAT, settings.cramers_v_leak)
    touching = associations.where((F.col("col_a") == target) | (F.col("col_b") == target)).withColumn("threshold", limit)
    return (touching.where(significant(F.col("threshold"), settings))
            .select(F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a")).alias("column_name"),
                    "kind", "value", "p_value", "threshold"))


def top_correlated_features(associations: DataFrame, target: str, n: int = -1) -> DataFrame:
    """(column_name, strength): features by absolute association with the target; -1 keeps all."""
    touching = associations.where((F.col("col_a") == target) | (F.col("col_b") == target)).select(
        F.when(F.col("col_a") == target, F.col("col_b")).otherwise(F.col("col_a")).alias("column_name"), F.abs("value").alias("strength"))
    best = touching.where("strength is not null").orderBy(F.desc("strength"), "column_name")
    return best if n < 0 else best.limit(n)


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """(class, class_count, class_pct, max_min_ratio); the ratio needs two classes."""
    kinds = families(df)
    counts = (df.select(known(target, kinds[target]).cast("string").alias("class")).where("class is not null")
              .groupBy("class").agg(F.count("*").alias("class_count")))
    total, most, fewest = (counts.agg(f("class_count")).scalar() for f in (F.sum, F.max, F.min))
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.select("class", "class_count", (F.col("class_count") / total).alias("class_pct"),
                         F.when(classes > 1, most / fewest).alias("max_min_ratio"))
