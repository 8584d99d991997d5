"""CSV readers of the record's file shapes. All parsing is done by Spark's own CSV source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators.common import key_join, require_columns
from fluxspark.operators.reshape import regrid

BOM = "﻿"


def _csv(spark: SparkSession, path: str, comment: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Every column as text. Naming the columns gives an explicit schema and no look at the file."""
    reader = spark.read.option("header", True)
    if comment:
        reader = reader.option("comment", comment)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns)).option("enforceSchema", True)
    df = reader.csv(path)
    return df.toDF(*[c.removeprefix(BOM).strip() for c in df.columns])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file or folder as a table (file, n, line), n rising within a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def comma_separated(lines: DataFrame, comment: str = "#", line: str = "line", n: str = "n", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of comma-separated lines that stand in a table: the keys, ``n``, and every column as text.

    The header is the first line that is neither empty nor a comment; the files of all keys share it, and a line equal to it is a header
    wherever it stands. Values may be quoted. Short rows end in nulls. No lines: no columns but the keys.
    """
    text = F.regexp_replace(F.col(line), f"^{BOM}|\\r$", "")
    body = lines.select(*keys, n, text.alias("__line")).filter((F.trim("__line") != "") & ~F.startswith(F.ltrim("__line"), F.lit(comment)))
    first = body.agg(F.min_by("__line", F.struct(*keys, n)).alias("h")).first()["h"]
    if first is None:
        return body.select(*keys, n)
    names = [c.strip().strip('"') for c in first.split(",")]
    parsed = F.from_csv("__line", ", ".join(f"c{i} string" for i in range(len(names))), {"mode": "PERMISSIVE", "emptyValue": ""})
    rows = body.filter(F.col("__line") != first).select(*keys, n, parsed.alias("__r"))
    value = lambda i: F.nullif(F.trim(F.col(f"__r.c{i}")), F.lit(""))
    return rows.select(*keys, n, *[value(i).alias(c) for i, c in enumerate(names)])


def comment_pairs(lines: DataFrame, comment: str = "#", line: str = "line", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, k, v): the key=value; pairs of comment lines."""
    said = lines.filter(F.startswith(F.ltrim(F.col(line)), F.lit(comment)))
    pairs = said.select(*keys, F.explode(F.split(F.regexp_replace(line, rf"^\s*\{comment}\s*", ""), ";")).alias("p")).filter(F.contains("p", F.lit("=")))
    return pairs.select(*keys, F.trim(F.substring_index("p", "=", 1)).alias("k"), F.trim(F.expr("substring(p, locate('=', p) + 1)")).alias("v"))


def parse_stamp(c):
    """Time stamp of a yyyyMMddHHmm text, without a time zone."""
    return F.to_timestamp_ntz(C.col(c).cast("string"), F.lit(K.STAMP_FORMAT))


def readings_of(raw: DataFrame, sentinel: float = K.SENTINEL, stamp: str = "TIMESTAMP_START", value_columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Half-hourly rows of text columns: exact sentinel to null, time stamp as ``ts``."""
    require_columns(raw, [stamp, *(value_columns or [])])
    values = value_columns or [c for c in raw.columns if not c.startswith("TIMESTAMP_") and c not in keys]
    return raw.select(*keys, parse_stamp(stamp).alias("ts"), *[C.clean_value(c, sentinel, tolerant=False).alias(c) for c in values])


def read_readings(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    sentinel: float = K.SENTINEL,
    stamp: str = "TIMESTAMP_START",
    value_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Half-hourly product: comment lines, exact sentinel to null, time stamp as ``ts``.

    ``columns`` is the file's full header. ``value_columns`` keeps only those, and only
    they are parsed.
    """
    return readings_of(_csv(spark, path, "#", columns), sentinel, stamp, value_columns)


def clean_sentinel(
    df: DataFrame, columns: Sequence[str], sentinel: float = K.SENTINEL, tolerant: bool = True
) -> DataFrame:
    """Numbers or null: unreadable text and values close to the sentinel go."""
    require_columns(df, columns)
    return df.withColumns({c: C.clean_value(c, sentinel, tolerant) for c in columns})


def select_value_columns(df: DataFrame, columns: Sequence[str], ts: str = "ts", keys: Sequence[str] = ()) -> DataFrame:
    return require_columns(df, [ts, *columns]).select(*keys, ts, *columns)


def _month(c: str, pattern: str | None):
    text = F.col(f"`{c}`")
    if pattern:
        return F.trunc(F.try_to_timestamp(text, F.lit(pattern)).cast("date"), "MM")
    tried = [F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd", "yyyy-MM", "M/d/yyyy", "MMM-yy", "MM/yyyy")]
    return F.trunc(F.coalesce(*tried).cast("date"), "MM")


def monthly_of(raw: DataFrame, date_column: str, value_column: str, name: str, pattern: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, month, name) of the text rows that hold both."""
    require_columns(raw, [date_column, value_column])
    out = raw.select(*keys, _month(date_column, pattern).alias("month"), C.clean_value(F.col(f"`{value_column}`")).alias(name))
    return out.dropna(subset=["month", name])


def read_monthly_csv(
    spark: SparkSession, path: str, date_column: str, value_column: str, name: str, pattern: str | None = None
) -> DataFrame:
    """(month, name) of the rows that hold both."""
    return monthly_of(_csv(spark, path), date_column, value_column, name, pattern)


def blocks_of(raw: DataFrame, blocks: dict[str, tuple[str, str]], pattern: str | None = None, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Tables that stand side by side in the same rows, each with its own date column: name -> (date, value)."""
    return {name: monthly_of(raw, d, v, name, pattern, keys) for name, (d, v) in blocks.items()}


def read_block_csv(
    spark: SparkSession, path: str, blocks: dict[str, tuple[str, str]], pattern: str | None = None
) -> dict[str, DataFrame]:
    """Tables that stand side by side in one file."""
    return blocks_of(_csv(spark, path), blocks, pattern)


def readings_to_month_mean(df: DataFrame, date: str, value: str, name: str, pattern: str = "MM/yyyy") -> DataFrame:
    """Single readings in Celsius to a monthly mean in Fahrenheit with its count."""
    rows = df.select(_month(date, pattern).alias("month"), F.col(value).try_cast("double").alias("v")).dropna()
    return rows.groupBy("month").agg(
        C.celsius_to_fahrenheit(F.avg("v")).alias(f"{name}_f"), F.count("*").alias(f"{name}_n")
    )


def read_commented_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV, and the key=value; pairs of its comment lines as one row."""
    pairs = comment_pairs(spark.read.text(path), line="value")
    meta = pairs.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    return _csv(spark, path, "#"), meta


def load_series(monthly: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """One column of a monthly table as a gapless series (keys, month, value)."""
    return regrid(monthly.select(*keys, "month", F.col(column).alias("value")), keys)


def load_covariates(
    covariates: DataFrame,
    series: DataFrame,
    columns: Sequence[str],
    masked: str | None = None,
    break_month: str = K.DATUM_BREAK,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Covariates on a series' grid, one of them cut from its datum break onward."""
    rows = covariates.withColumn(masked, C.mask_from(masked, "month", break_month)) if masked else covariates
    shared = [k for k in keys if k in covariates.columns]
    on = [*shared, "month"]
    return key_join(series.select(*keys, "month"), rows.select(*on, *columns), on)


def join_covariates(frames: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Outer join of covariate tables on the month, in one shuffle: stack, then fold per month."""
    values = [(i, c) for i, f in enumerate(frames) for c in f.columns if c not in (*keys, "month")]
    types = {c: f.schema[c].dataType for f in frames for c in f.columns}
    stacked = None
    for i, f in enumerate(frames):
        part = f.select(
            *keys, "month", *[(F.col(c) if j == i else F.lit(None)).cast(types[c]).alias(c) for j, c in values]
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy(*keys, "month").agg(*[F.max(c).alias(c) for _, c in values])


def verify_spot_checks(
    covariates: DataFrame, expected=K.SPOT_CHECKS, tolerance: float = 1e-3, columns: Sequence[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Known values beside the table's own, for every key: difference and whether it matches."""
    known = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(f"{m}-01").cast("date").alias("month"), F.lit(float(v)).alias("expected")) for c, checks in expected.items() for m, v in checks.items()]
    )
    each = covariates.select(*keys).distinct() if keys else covariates.sparkSession.range(1)
    asked = each.select(*keys, F.explode(known).alias("e")).select(*keys, "e.*")
    named = [c for c in (columns or expected) if c in covariates.columns]
    actual = covariates.unpivot([*keys, "month"], named, "column", "actual")
    gap = F.abs(F.col("actual") - F.col("expected"))
    return key_join(asked, actual, [*keys, "column", "month"]).select(
        *keys, "column", "month", "expected", "actual", gap.alias("abs_diff"), F.coalesce(gap < tolerance, F.lit(False)).alias("match")
    )
