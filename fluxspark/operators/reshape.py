"""Grids, long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, key_join


def add_time_keys(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.select(
        "*",
        C.month_of(ts).alias("month"),
        F.to_date(ts).alias("date"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month_of_year"),
        F.hour(ts).alias("hour"),
        C.half_hour_of_day(ts).alias("half_hour"),
        C.season_of(ts).alias("season"),
        C.decimal_year(ts).alias("decimal_year"),
    )


def to_long(df: DataFrame, value_columns: Sequence[str], ids: Sequence[str] = ("ts",), ts: str = "ts") -> DataFrame:
    """One row per reported value, with the day it fell on."""
    long = df.unpivot(list(ids), list(value_columns), "column", "value").filter(F.col("value").isNotNull())
    return long.withColumn("date", F.to_date(ts)) if ts in ids else long


def pivot_counts(
    df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str | None = None
) -> DataFrame:
    """Counts (or means of a value) by index and category, one column per listed category.

    Categories are named up front, so the schema is fixed and no extra job looks them up. Missing
    counts are zero, missing means stay null.
    """
    grouped = df.groupBy(*index)
    is_ = lambda v: F.col(column) == v
    if value is None:
        return grouped.agg(*[F.count_if(is_(v)).alias(v) for v in values])
    return grouped.agg(*[F.avg(F.when(is_(v), F.col(value))).alias(v) for v in values])


def month_grid(bounds: DataFrame, start: str = "first", end: str = "last", keys: Keys = ()) -> DataFrame:
    """Every month from start to end, per key."""
    months = F.sequence(F.trunc(start, "MM"), F.trunc(end, "MM"), F.expr("interval 1 month"))
    return bounds.filter(F.col(start).isNotNull()).select(*keys, F.explode(months).alias("month"))


def regrid(series: DataFrame, keys: Keys = (), start: str | None = None, end: str | None = None) -> DataFrame:
    """The series on a gapless month grid, so that absent months are null rows."""
    bounds = series.groupBy(*keys).agg(F.min("month").alias("__m"), F.max("month").alias("__n"))
    if start or end:
        bounds = bounds.select(
            *keys,
            (F.lit(start).cast("date") if start else F.col("__m")).alias("__m"),
            (F.lit(end).cast("date") if end else F.col("__n")).alias("__n"),
        )
    return key_join(month_grid(bounds, "__m", "__n", keys), series, [*keys, "month"], "left")


def stack_labelled(frames: dict[str, DataFrame], label: str = "family") -> DataFrame:
    """Frames of the same columns under each other, each row carrying its frame's name."""
    out = None
    for name, frame in frames.items():
        part = frame.withColumn(label, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
