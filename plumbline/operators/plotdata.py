"""The numbers behind the usual charts, as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import as_number, col, families, known, numbers
from plumbline.operators.frequencies import Frequencies, melt, value_frequencies
from plumbline.operators.ordering import quantile_values
from plumbline.settings import DEFAULTS, Settings

# Fixed values of the charts.
VIOLIN_CATEGORIES = 20
GROUPED_CATEGORIES = 15
CURVE_POINTS = 200
VIOLIN_POINTS = 100
VIOLIN_CUT = 2.0
WHISKER = 1.5
REACH = 8.5          # bandwidths beyond which a Gaussian is below double precision


def _spread(wide: DataFrame, cols: list[str]) -> dict[str, dict]:
    row = wide.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(col(c)).alias(f"n{i}"), F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"),
        F.stddev_samp(col(c)).alias(f"sd{i}"), F.approx_count_distinct(col(c), 0.05).alias(f"d{i}"))]).first()
    return {c: {k: row[f"{k}{i}"] for k in ("n", "lo", "hi", "sd", "d")} for i, c in enumerate(cols)}


def bin_count(n: int, low: float, high: float, iqr: float) -> int:
    """The finer of the Freedman-Diaconis and Sturges rules; half the width of
    the square-root rule bounds the former, so that far values add few bins."""
    span = high - low
    if span == 0:
        return 1
    sturges = span / (math.log2(n) + 1)
    diaconis = max(2 * iqr / n ** (1 / 3), span / math.sqrt(n) / 2)
    return max(1, math.ceil(span / min(diaconis, sturges)))


def histogram(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, bin, low, high, count) with automatic bins, empty bins included."""
    wide = numbers(df, cols)
    spread = _spread(wide, cols)
    cols = [c for c in cols if spread[c]["n"]]
    quartiles = quantile_values(wide, cols, [0.25, 0.75])
    plan = []
    for c in cols:
        s = spread[c]
        bins = bin_count(s["n"], s["lo"], s["hi"], quartiles[c][1] - quartiles[c][0])
        low, high = (s["lo"], s["hi"]) if s["hi"] > s["lo"] else (s["lo"] - 0.5, s["hi"] + 0.5)
        plan.append((c, bins, low, high, (high - low) / bins))
    rules = df.sparkSession.createDataFrame(plan, "column_name string, bins int, low double, high double, width double")
    rules = F.broadcast(rules)                                     # one row per column
    guess = F.least(F.floor((F.col("value") - F.col("low")) * (F.col("bins") / (F.col("high") - F.col("low")))).cast("int"), F.col("bins") - 1)
    # The product may round across an edge; the edge itself decides.
    edge = lambda i: F.col("low") + i * F.col("width")
    settled = (F.when((F.col("guess") > 0) & (F.col("value") < edge(F.col("guess"))), F.col("guess") - 1)
               .when((F.col("guess") < F.col("bins") - 1) & (F.col("value") >= edge(F.col("guess") + 1)), F.col("guess") + 1)
               .otherwise(F.col("guess")))
    counts = (melt(wide.select(*[col(c) for c in cols])).join(rules, "column_name").withColumn("guess", guess)
              .groupBy("column_name", settled.alias("bin")).agg(F.count("*").alias("count")))
    every = rules.select("column_name", "low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return every.join(counts, ["column_name", "bin"], "left").select(
        "column_name", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def kde_curve(df: DataFrame, cols: list[str], points: int = CURVE_POINTS, cut: float = 0.0) -> DataFrame:
    """(column_name, point, x, density): Gaussian density, Scott bandwidth, over all values.

    Every value adds only to the grid points its kernel reaches, and partial
    sums per grid point are formed before the shuffle. Columns with many equal
    values are counted first. Constant columns have no curve.
    """
    wide = numbers(df, cols)
    spread = {c: s for c, s in _spread(wide, cols).items() if s["n"] > 1 and s["sd"]}
    plan = []
    for c, s in spread.items():
        h = s["sd"] * s["n"] ** (-1 / 5)
        low, high = s["lo"] - cut * h, s["hi"] + cut * h
        plan.append((c, s["n"], h, low, (high - low) / (points - 1)))
    schema = "column_name string, rows bigint, h double, low double, step double"
    rules = F.broadcast(df.sparkSession.createDataFrame(plan, schema))      # one row per column
    if not plan:
        return rules.select("column_name", F.lit(0).alias("point"), F.col("low").alias("x"), F.col("h").alias("density"))
    repeated = [c for c, s in spread.items() if s["d"] * 10 < s["n"]]
    weighted = []
    if repeated:
        weighted.append(melt(wide.select(*[col(c) for c in repeated])).groupBy("column_name", "value").agg(F.count("*").alias("n")))
    if len(repeated) < len(spread):
        weighted.append(melt(wide.select(*[col(c) for c in spread if c not in repeated])).withColumn("n", F.lit(1).cast("bigint")))
    values = weighted[0] if len(weighted) == 1 else weighted[0].unionByName(weighted[1])
    at = lambda x: ((x - F.col("low")) / F.col("step"))
    first = F.greatest(F.lit(0), F.ceil(at(F.col("value") - REACH * F.col("h"))).cast("int"))
    last = F.least(F.lit(points - 1), F.floor(at(F.col("value") + REACH * F.col("h"))).cast("int"))
    z = (F.col("low") + F.col("point") * F.col("step") - F.col("value")) / F.col("h")
    sums = (values.join(rules, "column_name").where(first <= last)
            .select("column_name", "value", "n", "h", "low", "step", F.explode(F.sequence(first, last)).alias("point"))
            .groupBy("column_name", "point").agg(F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("mass")))
    every = rules.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return every.join(sums, ["column_name", "point"], "left").select(
        "column_name", "point", (F.col("low") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce("mass", F.lit(0.0)) / (F.col("rows") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))


def count_bars(df: DataFrame, cols: list[str], bars: int = DEFAULTS.bars, values: Frequencies | None = None) -> DataFrame:
    """(column_name, place, value, count): the most frequent categories, from `values` if they are counted already."""
    ranked = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return ((value_frequencies(df, cols) if values is None else values.values(cols)).withColumn("place", F.row_number().over(ranked))
            .where(F.col("place") <= bars).select("column_name", "place", "value", F.col("n").alias("count")))


def embedding_points(embedding: DataFrame, hue: DataFrame, keys: list[str]) -> DataFrame:
    """The embedded points with their colouring value, matched by row key."""
    return embedding.join(hue, keys)


def regression_line(df: DataFrame, feature: str, target: str) -> DataFrame:
    """(slope, intercept, r2, n) of the feature over the target, complete rows."""
    y, x = F.col("y"), F.col("x")
    wide = numbers(df, [feature, target]).select(col(feature).alias("y"), col(target).alias("x"))
    return wide.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                    F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def _by_category(df: DataFrame, cat: str, num: str) -> tuple[DataFrame, dict[str, str]]:
    """The number spread over one column per category, the most frequent categories only."""
    kinds = families(df)
    category = known(cat, kinds[cat]).cast("string")
    top = [r["value"] for r in value_frequencies(df, [cat]).orderBy(F.desc("n"), "value").limit(VIOLIN_CATEGORIES).collect()]
    names = {f"v{i}": value for i, value in enumerate(top)}
    x = as_number(num, kinds[num])
    return df.select(*[F.when(category == v, x).alias(c) for c, v in names.items()]), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.select(label[F.col("column_name")].alias("category"), *[c for c in df.columns if c != "column_name"])


def violin_summary(df: DataFrame, cat: str, num: str) -> DataFrame:
    """(category, count, q25, median, q75, whisker_low, whisker_high) of the 20 most frequent categories."""
    wide, names = _by_category(df, cat, num)
    schema = "category string, count bigint, q25 double, median double, q75 double, whisker_low double, whisker_high double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    quartiles = quantile_values(wide, list(names), [0.25, 0.5, 0.75])
    entries = []
    for c, label in names.items():
        q1, q2, q3 = quartiles[c]
        if q1 is None:
            continue
        reach = WHISKER * (q3 - q1)
        entries.append(F.struct(
            F.lit(label).alias("category"), F.count(col(c)).alias("count"), F.lit(q1).alias("q25"), F.lit(q2).alias("median"), F.lit(q3).alias("q75"),
            F.min(F.when(col(c) >= q1 - reach, col(c))).alias("whisker_low"), F.max(F.when(col(c) <= q3 + reach, col(c))).alias("whisker_high")))
    if not entries:
        return df.sparkSession.createDataFrame([], schema)
    return wide.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def violin_density(df: DataFrame, cat: str, num: str) -> DataFrame:
    """(category, point, x, density): one density curve per category."""
    wide, names = _by_category(df, cat, num)
    if not names:
        return df.sparkSession.createDataFrame([], "category string, point int, x double, density double")
    return _named(kde_curve(wide, list(names), VIOLIN_POINTS, VIOLIN_CUT), names)


def grouped_counts(df: DataFrame, feature: str, hue: str) -> DataFrame:
    """(value, hue, count, value_total, place): bars of the 15 largest feature values, split by hue."""
    kinds = families(df)
    pairs = df.select(known(feature, kinds[feature]).cast("string").alias("value"), known(hue, kinds[hue]).cast("string").alias("hue")).dropna()
    counts = pairs.groupBy("value", "hue").agg(F.count("*").alias("count"))
    top = counts.groupBy("value").agg(F.sum("count").alias("value_total")).orderBy(F.desc("value_total"), "value").limit(GROUPED_CATEGORIES)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value_total"), "value")))    # 15 rows
    return counts.join(F.broadcast(top), "value").select("value", "hue", "count", "value_total", "place")


def plot_plan(profile: DataFrame, hue: str | None = None, hue_is_numeric: bool = False) -> DataFrame:
    """(column_name, univariate, bivariate): which view each usable column gets."""
    kind = F.col("inferred_type")
    one = F.when(kind == "numerical", "histogram").otherwise("count_bars")
    if hue is None:
        two = F.lit(None).cast("string")
    elif hue_is_numeric:
        two = F.when(kind == "numerical", "regression_line").otherwise("violin")
    else:
        two = F.when(kind == "numerical", "violin").otherwise("grouped_counts")
    two = F.when(F.col("column_name") != F.lit(hue), two) if hue is not None else two
    return profile.where(kind.isin("numerical", "categorical", "boolean")).select(
        "column_name", one.alias("univariate"), two.alias("bivariate"))


def numeric_hue(profile: DataFrame, hue: str, settings: Settings = DEFAULTS) -> bool:
    """Whether a colouring column counts as a number: numeric cells, many values."""
    row = profile.where(F.col("column_name") == hue).select("dtype", "unique_count").first()
    numeric = row is not None and row["dtype"].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    return numeric and row["unique_count"] > settings.target_class_limit
