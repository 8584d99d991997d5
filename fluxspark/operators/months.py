"""Month sets: complete months, windows, runs, selections by rank or by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, attach, by, key_join
from fluxspark.operators.reshape import month_grid


def complete_months(covariates: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    return covariates.dropna(subset=list(columns)).select(*keys, "month")


WINDOWS = ("fit", "fit_nominal", "excluded", "reconstruction", "interior_gaps", "observed_excluded")
CONTIGUOUS = ("fit", "fit_nominal", "reconstruction")


def build_windows(
    covariates: DataFrame,
    observed: DataFrame,
    columns: Sequence[str],
    exclude: Sequence[str] = K.ARTIFACT_MONTHS,
    keys: Keys = (),
) -> DataFrame:
    """Label every month with the windows it belongs to; one row per month and window.

    fit_nominal holds months with an observation and all covariates, and splits into fit and excluded.
    Covariate months without an observation are reconstruction before the first observed month and
    interior gaps after. Observed months without all covariates are observed_excluded.
    """
    on = [*keys, "month"]
    complete = complete_months(covariates, columns, keys).distinct().withColumn("__c", F.lit(True))
    seen = observed.select(*on).distinct()
    flags = complete.join(seen.withColumn("__o", F.lit(True)), on, "full_outer")
    first = seen.groupBy(*keys).agg(F.min("month").alias("__first"))
    flags = attach(flags, first, keys)
    c, o = F.coalesce("__c", F.lit(False)), F.coalesce("__o", F.lit(False))
    out = F.col("month").isin(*[F.lit(m).cast("date") for m in exclude]) if exclude else F.lit(False)
    labels = [
        F.when(c & o & ~out, "fit"),
        F.when(c & o, "fit_nominal"),
        F.when(c & o & out, "excluded"),
        F.when(c & ~o & (F.col("month") < F.col("__first")), "reconstruction"),
        F.when(c & ~o & (F.col("month") >= F.col("__first")), "interior_gaps"),
        F.when(o & ~c, "observed_excluded"),
    ]
    return flags.select(*on, F.explode(F.array_compact(F.array(*labels))).alias("window"))


def window_accounting(windows: DataFrame, keys: Keys = ()) -> DataFrame:
    """Size and ends of each window; span and absences only for those meant to be contiguous."""
    span = C.month_index(F.max("month")) - C.month_index(F.min("month")) + 1
    contiguous = F.col("window").isin(*CONTIGUOUS)
    entities = windows.select(*keys).distinct() if keys else windows.agg(F.count("*")).select()
    every = entities.select(*keys, F.explode(F.array(*[F.lit(w) for w in WINDOWS])).alias("window"))
    sizes = (
        windows.groupBy(*keys, "window")
        .agg(
            F.count("*").alias("n_months"),
            F.min("month").alias("first"),
            F.max("month").alias("last"),
            span.cast("bigint").alias("__span"),
        )
    )
    return key_join(every, sizes, [*keys, "window"]).select(
        *keys,
        "window",
        F.coalesce("n_months", F.lit(0)).alias("n_months"),
        "first",
        "last",
        F.when(contiguous, F.col("__span")).alias("span_months"),
        F.when(contiguous, F.col("__span") - F.col("n_months")).alias("n_absent"),
    )


def window_months(windows: DataFrame, name: str, keys: Keys = ()) -> DataFrame:
    return windows.filter(F.col("window") == name).select(*keys, "month")


def absent_months(months: DataFrame, keys: Keys = ()) -> DataFrame:
    """Months inside the span of the set that the set does not hold."""
    bounds = months.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    return key_join(month_grid(bounds, keys=keys), months.select(*keys, "month"), [*keys, "month"], "left_anti")


def months_without_counts(monthly: DataFrame, counts: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Grid months on which every named count is zero."""
    total = sum((F.coalesce(c, F.lit(0)) for c in counts[1:]), F.coalesce(counts[0], F.lit(0)))
    return monthly.filter(total == 0).select(*keys, "month")


def month_islands(months: DataFrame, keys: Keys = ()) -> DataFrame:
    """The same months with an island number shared by neighbours without a gap."""
    order = by(*keys).orderBy("month")
    return months.withColumn("island", C.month_index("month") - F.row_number().over(order))


def month_runs(months: DataFrame, keys: Keys = ()) -> DataFrame:
    return (
        month_islands(months.select(*keys, "month"), keys)
        .groupBy(*keys, "island")
        .agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("n_months"))
        .drop("island")
    )


def compact_runs(months: DataFrame, keys: Keys = ()) -> DataFrame:
    """Runs as one text, such as '2011-02, 2021-07..2021-12'."""
    text = F.when(F.col("first") == F.col("last"), F.date_format("first", "yyyy-MM")).otherwise(
        F.concat(F.date_format("first", "yyyy-MM"), F.lit(".."), F.date_format("last", "yyyy-MM"))
    )
    return (
        month_runs(months, keys)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("runs"))
    )


def to_covariate_long(covariates: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    """(keys, month, covariate, value), reported values only."""
    return covariates.unpivot([*keys, "month"], list(columns), "covariate", "value").filter("value is not null")


def covariate_coverage(
    covariates: DataFrame,
    columns: Sequence[str],
    capable: Sequence[str] = K.RECONSTRUCTION_COVARIATES,
    keys: Keys = (),
) -> DataFrame:
    """Ends, count and interior gaps of each covariate."""
    long = to_covariate_long(covariates, columns, keys)
    on = [*keys, "covariate"]
    span = C.month_index(F.max("month")) - C.month_index(F.min("month")) + 1
    stats = long.groupBy(*on).agg(
        F.min("month").alias("first"),
        F.max("month").alias("last"),
        F.count("*").alias("n_months"),
        span.cast("bigint").alias("span_months"),
    )
    gaps = (
        absent_months(long, on)
        .groupBy(*on)
        .agg(F.array_join(F.array_sort(F.collect_list(F.date_format("month", "yyyy-MM"))), ", ").alias("interior_gaps"))
    )
    return key_join(stats, gaps, on).select(
        *on,
        "first",
        "last",
        "n_months",
        "span_months",
        (F.col("span_months") - F.col("n_months")).alias("n_interior_gaps"),
        F.coalesce("interior_gaps", F.lit("")).alias("interior_gaps"),
        F.col("covariate").isin(*capable).alias("reconstruction_capable"),
    )


def grid_coverage(
    covariates: DataFrame, columns: Sequence[str], start: str, end: str, keys: Keys = ()
) -> DataFrame:
    """Coverage of each covariate on a target grid, missing months as runs."""
    long = to_covariate_long(covariates, columns, keys)
    on = [*keys, "covariate"]
    inside = F.col("month").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    stats = long.groupBy(*on).agg(
        F.min("month").alias("first"),
        F.max("month").alias("last"),
        F.count("*").alias("n_months_total"),
        F.count_if(inside).alias("n_months_on_grid"),
    )
    bounds = stats.select(*on, F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last"))
    missing = key_join(month_grid(bounds, keys=on), long.select(*on, "month"), [*on, "month"], "left_anti")
    out = key_join(stats, missing.groupBy(*on).agg(F.count("*").alias("n_missing_from_grid")), on)
    out = key_join(out, compact_runs(missing, on).withColumnRenamed("runs", "missing_months"), on)
    return out.fillna({"n_missing_from_grid": 0, "missing_months": ""})


def binding_constraint(coverage: DataFrame, keys: Keys = ()) -> DataFrame:
    """The capable covariate that ends first, and the one that starts last."""
    ends = F.struct("last", "covariate")
    latest = F.struct(-F.unix_date("first"), F.col("covariate"))
    wide = coverage.filter("reconstruction_capable").groupBy(*keys).agg(
        F.min(ends).alias("e"), F.min_by(F.struct("first", "covariate"), latest).alias("s")
    )
    row = lambda text, s, month: F.struct(
        F.lit(text).alias("bound"), F.col(f"{s}.covariate").alias("covariate"), F.col(f"{s}.{month}").alias("month")
    )
    rows = F.array(row("fit window ends at", "e", "last"), row("reconstruction window starts at", "s", "first"))
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def availability(
    series: DataFrame, set_aside: DataFrame | None = None, keys: Keys = ("series",)
) -> DataFrame:
    """Every month of each series' span as present, gap, or set aside, with the series' drawing rank.

    Series are ranked by latest end, then earliest start.
    """
    on = [*keys, "month"]
    present = series.filter("value is not null").select(*on).distinct()
    bounds = present.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"), F.count("*").alias("n_months"))
    grid = month_grid(bounds, keys=keys)
    out = key_join(grid, present.withColumn("__p", F.lit(1)), on)
    status = F.when(F.col("__p").isNull(), "gap").otherwise("present")
    if set_aside is not None:
        out = key_join(out, set_aside.select(*on, F.col("reason").alias("__why")), on)
        status = F.when(F.col("__p").isNotNull() & F.col("__why").isNotNull(), F.col("__why")).otherwise(status)
    return key_join(out.select(*on, status.alias("status")), bounds, keys)


def forecast_span(forecasts: DataFrame, series: DataFrame, keys: Keys = ()) -> DataFrame:
    """First and last scored month, how many, and the training lead before them."""
    scored = forecasts.filter("actual is not null").groupBy(*keys).agg(
        F.min("target").alias("first"), F.max("target").alias("last"), F.count_distinct("target").alias("n_months")
    )
    start = series.filter("value is not null").groupBy(*keys).agg(F.min("month").alias("lead_from"))
    return attach(scored, start, keys)


def selected_count(share: float, n: Column) -> Column:
    """How many of n rows a share takes: half-even rounding, at least one."""
    return F.greatest(F.lit(1), F.bround(F.lit(share) * n, 0).cast("int"))


def extreme_share(
    df: DataFrame, column: str, share: float = 0.10, descending: bool = True, keys: Keys = ()
) -> DataFrame:
    """Months with the highest (or lowest) share of a column. Ties go to the earlier month."""
    rows = df.filter(F.col(column).isNotNull())
    order = F.desc(column) if descending else F.asc(column)
    return (
        rows.withColumn("__r", F.row_number().over(by(*keys).orderBy(order, "month")))
        .withColumn("__n", F.count("*").over(by(*keys)))
        .filter(F.col("__r") <= selected_count(share, F.col("__n")))
        .drop("__r", "__n")
    )


def years_at_end(df: DataFrame, n_years: int = 3, latest: bool = False, keys: Keys = ()) -> DataFrame:
    """Months in the first (or last) whole years that hold any."""
    order = F.desc("__y") if latest else F.asc("__y")
    return (
        df.withColumn("__y", F.year("month"))
        .withColumn("__r", F.dense_rank().over(by(*keys).orderBy(order)))
        .filter(F.col("__r") <= n_years)
        .drop("__y", "__r")
    )


def earliest_years(df: DataFrame, n_years: int = 3, keys: Keys = ()) -> DataFrame:
    return years_at_end(df, n_years, False, keys)


def latest_years(df: DataFrame, n_years: int = 3, keys: Keys = ()) -> DataFrame:
    return years_at_end(df, n_years, True, keys)


def drier_subset(df: DataFrame, column: str, drop_share: float, keys: Keys = ()) -> DataFrame:
    """What stays after the highest share of a column is removed. Ties keep the earlier month."""
    if not 0.0 <= drop_share < 1.0:
        raise ValueError("drop_share lies in [0, 1)")
    keep = F.col("__n") - F.bround(F.lit(drop_share) * F.col("__n"), 0).cast("int")
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn("__r", F.row_number().over(by(*keys).orderBy(column, "month")))
        .withColumn("__n", F.count("*").over(by(*keys)))
        .filter(F.col("__r") <= keep)
        .drop("__r", "__n")
    )


def rising_flag(df: DataFrame, column: str, keys: Keys = (), alias: str = "rising") -> DataFrame:
    """Whether the column rose from the previous row of the full record."""
    step = F.col(column) - F.lag(column).over(by(*keys).orderBy("month"))
    return df.withColumn(alias, F.coalesce(step > 0, F.lit(False)))


def build_splits(df: DataFrame, wet: str, cold: str, keys: Keys = ()) -> DataFrame:
    """The four held-out blocks of the fit months: (keys, split, month)."""
    blocks = {
        "wettest decile": extreme_share(df, wet, 0.10, True, keys),
        "coldest decile": extreme_share(df, cold, 0.10, False, keys),
        "earliest three years": earliest_years(df, 3, keys),
        "latest three years": latest_years(df, 3, keys),
    }
    out = None
    for name, block in blocks.items():
        part = block.select(*keys, F.lit(name).alias("split"), "month")
        out = part if out is None else out.unionByName(part)
    return out


