"""Daily and monthly aggregation that keeps the evidence behind each mean."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, attach, key_join


def mean_stats(value, prefix: str) -> list[Column]:
    """Mean, count, sample deviation and standard error of the non-null values."""
    v = C.col(value)
    return [
        F.avg(v).alias(f"{prefix}_mean"),
        F.count(v).alias(f"{prefix}_n"),
        F.stddev_samp(v).alias(f"{prefix}_sd"),
        (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{prefix}_se"),
    ]


def monthly_stats(df: DataFrame, value: str, ts: str = "ts", prefix: str | None = None, keys: Keys = ()) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, C.month_of(ts).alias("month"))
        .agg(*mean_stats(value, prefix or value.lower()))
    )


def monthly_stats_all(df: DataFrame, values: Sequence[str], ts: str = "ts", keys: Keys = ()) -> DataFrame:
    """The same for several columns side by side, in one pass. A month needs any of them."""
    any_value = F.coalesce(*values).isNotNull()
    return (
        df.filter(any_value)
        .groupBy(*keys, C.month_of(ts).alias("month"))
        .agg(*[e for v in values for e in mean_stats(v, v.lower())])
    )


def observation_count_distribution(
    monthly: DataFrame, count: str, thresholds: Sequence[int] = (10, 30, 100), keys: Keys = ()
) -> DataFrame:
    q = lambda p: F.percentile(count, F.lit(p))
    return monthly.groupBy(*keys).agg(
        F.count(count).alias("count"),
        F.avg(count).alias("mean"),
        F.stddev_samp(count).alias("std"),
        F.min(count).alias("min"),
        q(0.25).alias("p25"),
        q(0.5).alias("p50"),
        q(0.75).alias("p75"),
        F.max(count).alias("max"),
        *[F.count_if(F.col(count) < t).alias(f"months_under_{t}") for t in thresholds],
    )


def daily_stats(
    df: DataFrame,
    value: str = "value",
    ts: str = "ts",
    sources: Mapping[str, str] | None = None,
    min_obs: int | None = K.MIN_OBS_PER_DAY,
    source: str = "source",
    keys: Keys = (),
) -> DataFrame:
    """Daily mean with count and dispersion, for days that hold enough values.

    ``sources`` maps source labels to slugs; with it each day carries the share every source gave.
    ``min_obs=None`` keeps every day that holds a value.
    """
    aggs = mean_stats(value, value)
    if sources:
        # Fixed label set: a source that never reports is a column of zeros.
        aggs += [
            (F.count_if(F.col(source) == label) / F.count("*")).alias(f"frac_{slug}")
            for label, slug in sources.items()
        ]
        # Counting the known labels keeps this a single aggregate, where a distinct count would shuffle twice.
        n_sources = sum(((F.count_if(F.col(source) == label) > 0).cast("bigint") for label in sources), F.lit(0).cast("bigint"))
        aggs += [n_sources.alias("n_sources"), (n_sources > 1).alias("is_mixed")]
    daily = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs)
    return daily if min_obs is None else daily.filter(F.col(f"{value}_n") >= min_obs)


def daily_to_monthly(
    daily: DataFrame, value: str = "value", slugs: Sequence[str] | None = None, keys: Keys = ()
) -> DataFrame:
    """Mean of daily means, with days, dispersion across days and observation-weighted shares."""
    mean, n = f"{value}_mean", f"{value}_n"
    sd = F.stddev_samp(mean)
    aggs = [
        F.avg(mean).alias(mean),
        F.count("*").alias(f"{value}_days"),
        sd.alias(f"{value}_sd_across_days"),
        F.sum(n).alias(f"{value}_obs"),
        (sd / F.sqrt(F.count("*"))).alias(f"{value}_se_across_days"),
    ]
    if slugs:
        aggs.append(F.count_if("is_mixed").alias("n_mixed_days"))
        share = lambda s: F.sum(F.col(f"frac_{s}") * F.col(n)) / F.sum(n)
        aggs += [share(s).alias(f"frac_{s}") for s in slugs]
        aggs.append(
            sum((F.max((F.col(f"frac_{s}") > 0).cast("bigint")) for s in slugs[1:]),
                F.max((F.col(f"frac_{slugs[0]}") > 0).cast("bigint"))).alias("n_sources")
        )
    return daily.groupBy(*keys, C.month_of("date").alias("month")).agg(*aggs)


def monthly_balanced(df: DataFrame, value: str, ts: str = "ts", keys: Keys = ()) -> DataFrame:
    """Monthly mean in which every half-hour of the day weighs the same."""
    cells = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, C.month_of(ts).alias("month"), C.half_hour_of_day(ts).alias("half_hour"))
        .agg(F.avg(value).alias("__m"), F.count("*").alias("__n"))
    )
    sd = F.stddev_samp("__m")
    return cells.groupBy(*keys, "month").agg(
        F.avg("__m").alias(f"{value}_mean"),
        F.count("*").alias(f"{value}_cells"),
        sd.alias(f"{value}_sd_across_cells"),
        F.sum("__n").alias(f"{value}_obs"),
        (sd / F.sqrt(F.count("*"))).alias(f"{value}_se_across_cells"),
    )


def threshold_comparison(
    df: DataFrame,
    value: str = "value",
    ts: str = "ts",
    thresholds: Sequence[int] = K.DAILY_THRESHOLDS,
    keys: Keys = (),
) -> DataFrame:
    """Monthly series under each daily coverage rule, side by side, from one pass over the days."""
    daily = daily_stats(df, value, ts, min_obs=None, keys=keys)
    n = F.col(f"{value}_n")
    aggs = []
    for t in thresholds:
        aggs += [
            F.avg(F.when(n >= t, F.col(f"{value}_mean"))).alias(f"mean_t{t}"),
            F.when(F.count_if(n >= t) > 0, F.count_if(n >= t)).alias(f"days_t{t}"),
        ]
    months = daily.groupBy(*keys, C.month_of("date").alias("month")).agg(*aggs)
    return months.filter(F.coalesce(*[f"days_t{t}" for t in thresholds]).isNotNull())


def threshold_summary(
    comparison: DataFrame, thresholds: Sequence[int] = K.DAILY_THRESHOLDS, keys: Keys = ()
) -> DataFrame:
    base = thresholds[0]
    shift = lambda t: F.abs(F.col(f"mean_t{t}") - F.col(f"mean_t{base}"))
    aggs = []
    for t in thresholds:
        aggs += [
            F.count(f"mean_t{t}").alias(f"n{t}"),
            F.coalesce(F.sum(f"days_t{t}"), F.lit(0)).alias(f"d{t}"),
            F.avg(f"mean_t{t}").alias(f"m{t}"),
            F.max(shift(t)).alias(f"x{t}"),
            F.percentile(shift(t), F.lit(0.5)).alias(f"q{t}"),
        ]
    row = lambda t: F.struct(
        F.lit(t).alias("threshold"),
        F.col(f"n{t}").alias("n_months"),
        F.col(f"d{t}").alias("total_days"),
        F.col(f"m{t}").alias("mean_flux"),
        F.col(f"x{t}").alias("max_abs_shift"),
        F.col(f"q{t}").alias("median_abs_shift"),
        (F.col(f"n{base}") - F.col(f"n{t}")).alias("months_lost"),
    )
    return (
        comparison.groupBy(*keys)
        .agg(*aggs)
        .select(*keys, F.explode(F.array(*[row(t) for t in thresholds])).alias("r"))
        .select(*keys, "r.*")
    )


def cycle_strength(df: DataFrame, value: str = "value", ts: str = "ts", keys: Keys = ()) -> DataFrame:
    """Amplitude and explained variance of the daily cycle against the seasonal one.

    The table of half-hour by month-of-year cells (at most 576 per key) is built once, and both
    cycles and the totals come from it.
    """
    rows = df.filter(F.col(value).isNotNull())
    total = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("__mu"), F.var_pop(value).alias("total_variance")
    )
    cells = rows.groupBy(*keys, C.half_hour_of_day(ts).alias("__h"), F.month(ts).alias("__m")).agg(
        F.sum(value).alias("__s"), F.count("*").alias("__n")
    )

    def cycle(cell: str, name: str) -> DataFrame:
        means = attach(
            cells.groupBy(*keys, cell).agg((F.sum("__s") / F.sum("__n")).alias("__g"), F.sum("__n").alias("__c")),
            total,
            keys,
        )
        between = F.sum(F.col("__c") * F.pow(F.col("__g") - F.col("__mu"), 2)) / F.max("n")
        return means.groupBy(*keys).agg(
            (F.max("__g") - F.min("__g")).alias(f"{name}_amplitude"),
            F.try_divide(between, F.max("total_variance")).alias(f"{name}_eta_squared"),
        )

    out = attach(attach(total.drop("__mu"), cycle("__h", "diurnal"), keys), cycle("__m", "seasonal"), keys)
    return out.withColumn("amplitude_ratio", F.try_divide("seasonal_amplitude", "diurnal_amplitude"))


def diurnal_cycle_by_season(df: DataFrame, value: str = "value", ts: str = "ts", keys: Keys = ()) -> DataFrame:
    season = C.season_of(ts)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.hour(ts).alias("hour"))
        .agg(*[F.avg(F.when(season == s, F.col(value))).alias(s) for s in ("JJA", "other")])
    )


def daylight_share(
    df: DataFrame, value: str = "value", ts: str = "ts", low: int = 6, high: int = 18, keys: Keys = ()
) -> DataFrame:
    inside = (F.hour(ts) >= low) & (F.hour(ts) < high)
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("n"), F.avg(inside.cast("int")).alias("daylight_share"))
    )


def build_monthly(
    df: DataFrame,
    values: Sequence[str],
    covariates: DataFrame,
    start: str,
    end: str,
    ts: str = "ts",
    keys: Keys = (),
) -> DataFrame:
    """Monthly statistics and covariates on a full month grid; absent counts become zero."""
    from fluxspark.operators.reshape import month_grid

    entities = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    bounds = entities.select(*keys, F.lit(start).cast("date").alias("first"), F.lit(end).cast("date").alias("last"))
    grid = month_grid(bounds, keys=keys)
    out = key_join(grid, monthly_stats_all(df, values, ts, keys), [*keys, "month"])
    cov_keys = [k for k in keys if k in covariates.columns]
    out = key_join(out, covariates, [*cov_keys, "month"])
    return out.fillna(0, [c for c in out.columns if c.endswith("_n")])


def series_profile(
    monthly: DataFrame, value: str, days: str, few: int = 10, keys: Keys = ()
) -> DataFrame:
    """Span, absences, evidence and range of a monthly series."""
    span = F.max(C.month_index("month")) - F.min(C.month_index("month")) + 1
    v = F.col(value)
    return monthly.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_months"),
        F.min("month").alias("first"),
        F.max("month").alias("last"),
        span.cast("bigint").alias("span_months"),
        (span - F.count("*")).cast("bigint").alias("n_absent"),
        F.percentile(days, F.lit(0.5)).alias("median_days"),
        F.min(days).alias("min_days"),
        F.max(days).alias("max_days"),
        F.count_if(F.col(days) < few).alias("months_under_few_days"),
        F.avg(v).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        ((F.min(v) < 0) & (F.max(v) > 0)).alias("crosses_zero"),
        F.count_if(v >= 0).alias("months_at_or_above_zero"),
    )


def series_agreement(
    left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float = 5e-4, keys: Keys = ()
) -> DataFrame:
    """Two monthly series side by side: shared months, correlation, differences."""
    on = [*keys, "month"]
    both = (
        left.select(*on, F.col(left_value).alias("__a"))
        .filter("__a is not null")
        .join(right.select(*on, F.col(right_value).alias("__b")).filter("__b is not null"), on, "full_outer")
    )
    d = F.col("__b") - F.col("__a")
    return both.groupBy(*keys).agg(
        F.count(d).alias("n_shared"),
        F.count_if(F.col("__b").isNull()).alias("only_left"),
        F.count_if(F.col("__a").isNull()).alias("only_right"),
        F.corr("__a", "__b").alias("correlation"),
        F.avg(d).alias("mean_difference"),
        F.percentile(d, F.lit(0.5)).alias("median_difference"),
        F.stddev_samp(d).alias("sd_difference"),
        F.max(F.abs(d)).alias("max_abs_difference"),
        F.count_if(F.abs(d) < tolerance).alias("n_identical"),
    )


def seasonal_bias_of_rule(
    rule: DataFrame, balanced: DataFrame, rule_value: str, balanced_value: str, keys: Keys = ()
) -> DataFrame:
    """Bias of one monthly rule against another, and how its seasonal swing compares with the series.

    Months of the year whose biases differ by less than a 1e-10th of the largest monthly mean tie, since the sums behind them agree no
    further; the earliest of those that tie is the lowest or highest one.
    """
    on = [*keys, "month"]
    both = rule.select(*on, F.col(rule_value).alias("__a")).join(
        balanced.select(*on, F.col(balanced_value).alias("__b")), on
    ).withColumn("__d", F.col("__a") - F.col("__b"))
    total = both.groupBy(*keys).agg(F.avg("__d").alias("mean_bias"), F.max(F.abs("__d")).alias("max_abs_bias"))
    largest = F.max(F.nanvl(F.greatest(F.abs("__a"), F.abs("__b")), F.lit(0.0)))
    moy = both.groupBy(*keys, F.month("month").alias("__moy")).agg(
        F.avg("__d").alias("__db"), F.avg("__a").alias("__s"), largest.alias("__l")
    )
    swing = moy.groupBy(*keys).agg(
        F.min("__db").alias("__lo"),
        F.max("__db").alias("__hi"),
        (F.max("__l") * 1e-10).alias("__tie"),
        F.collect_list(F.struct("__db", "__moy")).alias("__months"),
        (F.max("__s") - F.min("__s")).alias("series_amplitude"),
    )
    earliest = lambda near: F.array_min(F.transform(F.filter("__months", lambda m: near(m["__db"])), lambda m: m["__moy"]))
    swing = swing.select(
        *keys,
        (F.col("__hi") - F.col("__lo")).alias("bias_swing"),
        earliest(lambda x: x <= F.col("__lo") + F.col("__tie")).alias("lowest_month"),
        earliest(lambda x: x >= F.col("__hi") - F.col("__tie")).alias("highest_month"),
        "series_amplitude",
    )
    return attach(total, swing, keys).withColumn(
        "swing_pct_of_amplitude", F.try_divide(100 * F.col("bias_swing"), F.col("series_amplitude"))
    )


def annual_grams(flux: str) -> Column:
    """Sum of the months' mass, each month held over its own length; 0 without any."""
    return F.coalesce(F.sum(C.monthly_flux_to_grams(flux, "month")), F.lit(0.0))


def annual_carbon(flux: str) -> Column:
    return F.bround(annual_grams(flux) * K.C_PER_CH4, 3)


def monthly_flux_to_annual(monthly: DataFrame, flux: str, keys: Keys = ()) -> DataFrame:
    """Annual mass from monthly mean flux, each month held over its own length."""
    grams = annual_grams(flux)
    return (
        monthly.groupBy(*keys, F.year("month").alias("year"))
        .agg(
            F.count("*").alias("n_months"),
            F.bround(grams, 3).alias("g_ch4_m2"),
            annual_carbon(flux).alias("g_c_m2"),
        )
    )


def annual_means(df: DataFrame, columns: Sequence[str], months: DataFrame | None = None, keys: Keys = ()) -> DataFrame:
    rows = df if months is None else key_join(df, months.select(*keys, "month").distinct(), [*keys, "month"], "left_semi")
    return rows.groupBy(*keys, F.year("month").alias("year")).agg(
        F.count("*").alias("n_months"), *[F.bround(F.avg(c), 3).alias(c) for c in columns]
    )


