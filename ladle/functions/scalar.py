"""Scalar column expressions. All are built-in functions and safe under ANSI mode."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Meal-time peaks of a day, as half-open hour ranges.
PEAK_HOURS = ((12, 14), (19, 22))
#: Friday, Saturday, Sunday in Spark's numbering.
WEEKEND = (6, 7, 1)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is null or 0."""
    return F.try_divide(numerator, denominator)


def before_end_of(column: Column, day: date) -> Column:
    """Whether a timestamp lies on or before a day, all of which counts."""
    return column < F.lit(day + timedelta(days=1)).cast("timestamp")


def up_to(column: Column, day: date) -> Column:
    """Whether a date lies on or before a day."""
    return column <= F.lit(day)


def is_peak_hour(ts: Column, hours: tuple[tuple[int, int], ...] = PEAK_HOURS) -> Column:
    hour = F.hour(ts)
    return reduce(Column.__or__, [(hour >= a) & (hour < b) for a, b in hours])


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(*WEEKEND)


def day_number(day: Column) -> Column:
    """Days since 2000-01-01: an integer axis for range windows."""
    return F.datediff(day, F.lit(date(2000, 1, 1)))


def week_start(ts: Column) -> Column:
    """The Monday of the week, as a date."""
    return F.date_trunc("week", ts).cast("date")


def week_number(ts: Column) -> Column:
    """Weeks since that of 2000-01-03, a Monday."""
    return F.floor(F.datediff(week_start(ts), F.lit(date(2000, 1, 3))) / 7).cast("int")


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def held_out(id_: Column, modulus: int = 5) -> Column:
    """A split by crc32 of the id as text: one in modulus is held out, the same in every run."""
    return F.crc32(id_.cast("string")) % modulus == 0


def mapped(column: Column, mapping: dict[str, str], keep_unknown: bool = True) -> Column:
    """A value for a code. Codes without one stay as they are, or become null."""
    found = F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), column)
    return F.coalesce(found, column) if keep_unknown else found


def not_negative(column: Column) -> Column:
    return F.greatest(column, F.lit(0.0))


def with_calendar(df: DataFrame, day: str) -> DataFrame:
    """Adds dow (1 is Sunday), month and is_weekend as integers."""
    c = F.col(day)
    return df.withColumns({"dow": F.dayofweek(c), "month": F.month(c), "is_weekend": is_weekend(c).cast("int")})


def severity(kind: Column, score: Column, z_kinds: tuple[str, ...]) -> Column:
    """How serious an anomaly is, by its absolute z-score; kinds without one want review."""
    z = F.abs(score)
    return F.when(~kind.isin(*z_kinds), "Review").when(z >= 6, "Critical").when(z >= 4.5, "High").otherwise("Medium")


def joined_text(items: Column, separator: str = " | ") -> Column:
    return F.array_join(items, separator)


def decimals_as_double(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The chosen columns, each decimal cast to double."""
    chosen = df.select(*columns) if columns else df
    return chosen.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in chosen.schema.fields])


def with_values(df: DataFrame, zero: list[str] = (), sentinel: list[str] = (), sentinel_value: float = -1) -> DataFrame:
    """Nulls of some columns become 0, those of others a sentinel that says there is no history."""
    return df.fillna({**dict.fromkeys(zero, 0), **dict.fromkeys(sentinel, sentinel_value)})


def choose(df: DataFrame, day: str | None = None, start: date | None = None, end: date | None = None, **allowed: list) -> DataFrame:
    """Rows from start to end (a day column), whose columns have one of the allowed values; an empty list allows all."""
    if day and start:
        df = df.where(F.col(day) >= F.lit(start))
    if day and end:
        df = df.where(F.col(day) <= F.lit(end))
    for column, values in allowed.items():
        if values:
            df = df.where(F.col(column).isin(list(values)))
    return df


def search(df: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with the needle, in any case, in one of the columns; an empty needle finds all."""
    if not needle.strip():
        return df
    hits = [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.strip().lower()), F.lit(False)) for c in columns]
    return df.where(reduce(Column.__or__, hits))


def of_kind(df: DataFrame, kind_col: str, kind: str, condition: Column) -> DataFrame:
    """A condition that binds rows of one kind only."""
    return df.where((F.col(kind_col) != kind) | condition)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a whole history: none of the columns is null."""
    return df.dropna(subset=columns)
