"""Column helpers: type families, missing values, text probes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Date layouts recognised in text, as (shape, Spark pattern).
# A pattern of None means the ISO form, read by a plain cast.
DATE_LAYOUTS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$", None),
    (r"^(1[6-9]|2[01])\d{2}$", "yyyy"),
    (r"^(1[6-9]|2[01])\d{6}$", "yyyyMMdd"),
    (r"^\d{1,2}:\d{2}$", "H:mm"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
]

# Fixed value: the spellings read as a number, apart from surrounding blanks.
NUMBER_SHAPE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)$"

_DATES = (T.DateType, T.TimestampNTZType)
DATED = ("date", "instant")
_INTERVALS = (T.DayTimeIntervalType, T.YearMonthIntervalType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType)


def family(dtype: T.DataType) -> str:
    """boolean, whole, fraction, decimal, date (no zone), instant, interval, text or nested."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _WHOLE):
        return "whole"
    if isinstance(dtype, _FRACTION):
        return "fraction"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, _DATES):
        return "date"
    if isinstance(dtype, T.TimestampType):
        return "instant"
    if isinstance(dtype, _INTERVALS):
        return "interval"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "nested"


def families(df: DataFrame) -> dict[str, str]:
    return {field.name: family(field.dataType) for field in df.schema.fields}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def known(name: str, kind: str) -> Column:
    """The column with NaN turned into NULL."""
    c = col(name)
    return F.when(~F.isnan(c), c) if kind == "fraction" else c


def normalise_missing(df: DataFrame) -> DataFrame:
    """One missing value: NaN in fractional columns becomes NULL."""
    kinds = families(df)
    fixed = {c: known(c, k) for c, k in kinds.items() if k == "fraction"}
    return df.withColumns(fixed) if fixed else df


def as_number(name: str, kind: str) -> Column:
    """The column as a finite-or-NULL double, whatever it is stored as."""
    c = col(name)
    if kind in ("whole", "decimal", "boolean"):
        return c.cast("double")
    if kind == "fraction":
        return known(name, kind).cast("double")
    if kind in DATED:
        return micros(c, kind).cast("double")
    number = parsed_number(c)
    return F.when(~F.isnan(number), number)


def micros(c: Column, kind: str) -> Column:
    """Microseconds since 1970, of the instant or of the wall clock; no time zone comes into the latter."""
    if kind == "instant":
        return F.unix_micros(c)
    c = c.cast("timestamp_ntz")
    seconds = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
    return (F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(c).cast("bigint") * 3_600_000_000
            + F.minute(c).cast("bigint") * 60_000_000 + seconds)


def numbers(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Only the wanted columns, as doubles; `keep` columns pass unchanged."""
    kinds = families(df)
    return df.select(*[col(k) for k in keep],
                     *[as_number(c, kinds[c]).alias(c) for c in cols])


def parsed_number(c: Column) -> Column:
    """Double for text that spells a number, else NULL.

    The shape test comes first: a failing cast costs far more than a regex.
    """
    text = F.trim(c)
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def parsed_date(c: Column) -> Column:
    """Timestamp for text in one of the known layouts, else NULL."""
    def step(rest, layout):
        shape, pattern = layout
        value = c.try_cast("timestamp_ntz") if pattern is None else F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
        return F.when(c.rlike(shape), value).otherwise(rest)

    none = F.lit(None).cast("timestamp_ntz")
    return F.when(F.length(c).between(4, 40), reduce(step, reversed(DATE_LAYOUTS), none))


def footprint(name: str, kind: str, dtype: T.DataType) -> Column:
    """Encoded bytes of one cell: fixed width, or the length of the content."""
    c = col(name)
    if kind == "text" or isinstance(dtype, T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint")
    if kind == "nested":
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("bigint")
    widths = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    width = next((w for t, w in widths.items() if isinstance(dtype, t)), 8)
    return F.lit(16 if kind == "decimal" else width).cast("bigint")
