"""Coverage of a merged series against the calendar, and annual budgets built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, key_join
from fluxspark.operators.reshape import month_grid


def possible_by_month(df: DataFrame, ts: str = "ts", keys: Keys = ()) -> DataFrame:
    """Slots the calendar allows for every month in the record's span, reported or not."""
    bounds = df.groupBy(*keys).agg(F.to_date(F.min(ts)).alias("first"), F.to_date(F.max(ts)).alias("last"))
    return month_grid(bounds, keys=keys).select(
        *keys,
        "month",
        F.year("month").alias("year"),
        F.month("month").alias("month_of_year"),
        C.slots_in_month("month").alias("possible"),
    )


def _counts(df: DataFrame, group: list, slugs: Mapping[str, str], value: str, keys: Keys) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, *group)
        .agg(*[F.count_if(F.col("source") == label).alias(slug) for label, slug in slugs.items()])
    )


def coverage_by_year_month(
    merged: DataFrame, slugs: Mapping[str, str], value: str = "value", ts: str = "ts", keys: Keys = ()
) -> DataFrame:
    possible = possible_by_month(merged, ts, keys)
    counts = _counts(merged, [C.month_of(ts).alias("month")], slugs, value, keys)
    names = list(slugs.values())
    out = key_join(possible, counts, [*keys, "month"]).fillna(0, names)
    observed = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    return out.select(
        *keys,
        "year",
        "month_of_year",
        *names,
        "possible",
        observed.alias("observed"),
        (observed / F.col("possible")).alias("frac_observed"),
    )


def coverage_by_month_of_year(
    merged: DataFrame, slugs: Mapping[str, str], value: str = "value", ts: str = "ts", keys: Keys = ()
) -> DataFrame:
    """Coverage per calendar month, pooled over years. All twelve months are present."""
    per_month = coverage_by_year_month(merged, slugs, value, ts, keys)
    names = list(slugs.values())
    pooled = per_month.groupBy(*keys, "month_of_year").agg(
        *[F.sum(c).alias(c) for c in names], F.sum("observed").alias("observed"), F.sum("possible").alias("possible")
    )
    if keys:
        entities = merged.select(*keys).distinct()
    else:
        entities = merged.groupBy().agg(F.count("*").alias("__n")).select()
    year = entities.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month_of_year"))
    out = key_join(year, pooled, [*keys, "month_of_year"]).fillna(0, [*names, "observed"])
    return out.select(
        "*", *[(F.col(c) / F.col("possible")).alias(f"frac_{c}") for c in [*names, "observed"]]
    )


def coverage_matrix(by_year_month: DataFrame, keys: Keys = ()) -> DataFrame:
    """Year by month-of-year grid of the observed fraction, columns m1 to m12."""
    cell = lambda m: F.max(F.when(F.col("month_of_year") == m, F.col("frac_observed")))
    return by_year_month.groupBy(*keys, "year").agg(*[cell(m).alias(f"m{m}") for m in range(1, 13)])


def seasonal_bias_summary(
    merged: DataFrame,
    slugs: Mapping[str, str],
    winter: Sequence[int] = (11, 12, 1, 2, 3),
    summer: Sequence[int] = (6, 7, 8),
    value: str = "value",
    ts: str = "ts",
    keys: Keys = (),
) -> DataFrame:
    """Cold-season against growing-season coverage and mean flux (means of monthly means)."""
    pooled = coverage_by_month_of_year(merged, slugs, value, ts, keys)
    means = (
        merged.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.month(ts).alias("month_of_year"))
        .agg(F.avg(value).alias("__mean"))
    )
    rows = key_join(pooled, means, [*keys, "month_of_year"])

    def cover(months):
        hit = F.col("month_of_year").isin(*months)
        return F.sum(F.when(hit, F.col("observed"))) / F.sum(F.when(hit, F.col("possible")))

    mean = lambda months: F.avg(F.when(F.col("month_of_year").isin(*months), F.col("__mean")))
    return rows.groupBy(*keys).agg(
        cover(winter).alias("winter_coverage"),
        cover(summer).alias("summer_coverage"),
        (cover(summer) - cover(winter)).alias("summer_minus_winter"),
        F.try_divide(cover(summer), cover(winter)).alias("coverage_ratio"),
        mean(winter).alias("winter_mean_flux"),
        mean(summer).alias("summer_mean_flux"),
    )


def published_lookup(year: Column, published: Mapping[int, float]) -> Column:
    """Published value of a year, null when none was published."""
    return F.create_map(*[F.lit(x) for kv in published.items() for x in (int(kv[0]), float(kv[1]))])[year.cast("int")]


def annual_budget(
    merged: DataFrame,
    published: Mapping[int, float] = K.PUBLISHED_BUDGET,
    value: str = "value",
    ts: str = "ts",
    keys: Keys = (),
) -> DataFrame:
    """Annual mass from measured slots alone, and from their mean held over a whole year.

    Slots are the rows present, so values and slots come from the same pass.
    """
    rows = merged.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.count(value).alias("n_halfhours"), F.avg(value).alias("mean_flux"), F.count("*").alias("slots_in_year")
    )
    out = rows.filter(F.col("n_halfhours") > 0).select(
        *keys,
        "year",
        "n_halfhours",
        "mean_flux",
        "slots_in_year",
        F.bround(100 * F.col("n_halfhours") / F.col("slots_in_year"), 1).alias("coverage_pct"),
        (F.col("n_halfhours") * F.col("mean_flux") * K.GRAMS_PER_SLOT).alias("observed_only"),
        (F.col("mean_flux") * K.SLOTS_PER_YEAR * K.GRAMS_PER_SLOT).alias("coverage_scaled"),
        published_lookup(F.col("year"), published).alias("published"),
    )
    return out.select(
        "*",
        F.bround(100 * F.col("observed_only") / F.col("published"), 1).alias("observed_pct_of_published"),
        (F.col("published") - F.col("observed_only")).alias("shortfall_g"),
    )


def annual_budget_month_weighted(merged: DataFrame, value: str = "value", ts: str = "ts", keys: Keys = ()) -> DataFrame:
    """Annual mean from monthly means, each weighted by its calendar length. Empty months are not filled."""
    months = (
        merged.filter(F.col(value).isNotNull())
        .groupBy(*keys, C.month_of(ts).alias("month"))
        .agg(F.avg(value).alias("__m"))
        .withColumn("__w", C.slots_in_month("month"))
    )
    weighted = F.sum(F.col("__m") * F.col("__w")) / F.sum("__w")
    return months.groupBy(*keys, F.year("month").alias("year")).agg(
        F.count("*").alias("months_with_data"),
        weighted.alias("weighted_mean_flux"),
        (weighted * K.SLOTS_PER_YEAR * K.GRAMS_PER_SLOT).alias("month_weighted"),
    )


def budget_method_comparison(
    merged: DataFrame,
    published: Mapping[int, float] = K.PUBLISHED_BUDGET,
    value: str = "value",
    ts: str = "ts",
    keys: Keys = (),
) -> DataFrame:
    pooled = annual_budget(merged, published, value, ts, keys).select(
        *keys, "year", "coverage_pct", "mean_flux", "observed_only", "coverage_scaled", "published"
    )
    both = key_join(pooled, annual_budget_month_weighted(merged, value, ts, keys), [*keys, "year"])
    gap = F.col("coverage_scaled") - F.col("month_weighted")
    return both.select(
        "*",
        gap.alias("divergence_g"),
        F.try_divide(100 * gap, F.col("month_weighted")).alias("divergence_pct"),
        (100 * F.col("month_weighted") / F.col("published")).alias("weighted_pct_of_published"),
    )


def budget_gap(annual: DataFrame, keys: Keys = ()) -> DataFrame:
    """The years a budget was published for."""
    return annual.filter(F.col("published").isNotNull()).select(
        *keys, "year", "n_halfhours", "coverage_pct", "mean_flux", "observed_only", "coverage_scaled",
        "published", "observed_pct_of_published", "shortfall_g",
    )


def _published_rows(spark, published: Mapping[int, tuple[float, float]]) -> DataFrame:
    rows = [(int(y), float(v), float(u)) for y, (v, u) in sorted(published.items())]
    return spark.createDataFrame(rows, "year int, value double, uncertainty double")


def published_annual_targets(spark, published: Mapping[int, tuple[float, float]] = K.PUBLISHED_CARBON) -> DataFrame:
    """Published annual carbon budgets, in carbon and in methane mass."""
    return _published_rows(spark, published).select(
        "year",
        F.col("value").alias("g_c_m2"),
        F.col("uncertainty").alias("uncertainty_g_c"),
        F.bround(C.carbon_to_methane("value"), 2).alias("g_ch4_m2"),
        F.bround(C.carbon_to_methane("uncertainty"), 2).alias("uncertainty_g_ch4"),
    )


def published_reconstruction_range(spark, limits=K.PUBLISHED_CARBON_RANGE) -> DataFrame:
    low, high, uncertainty = limits
    frame = spark.createDataFrame([(low, high, uncertainty)], "low_g_c double, high_g_c double, uncertainty_g_c double")
    return frame.select(
        "*",
        *[F.bround(C.carbon_to_methane(c), 2).alias(c.replace("_c", "_ch4")) for c in frame.columns],
    )


def observed_against_published(
    annual: DataFrame, published: Mapping[int, tuple[float, float]] = K.PUBLISHED_CARBON
) -> DataFrame:
    """Observed annual mass beside the published budgets; a year without data stays, with nulls."""
    targets = published_annual_targets(annual.sparkSession, published)
    rows = key_join(targets, annual.select("year", "observed_only", "coverage_pct", "coverage_scaled"), ["year"])
    return rows.select(
        "year",
        "coverage_pct",
        F.bround("observed_only", 2).alias("observed_g_ch4"),
        F.bround(C.methane_to_carbon("observed_only"), 2).alias("observed_g_c"),
        F.bround("coverage_scaled", 2).alias("coverage_scaled_g_ch4"),
        F.bround(C.methane_to_carbon("coverage_scaled"), 2).alias("coverage_scaled_g_c"),
        F.col("g_ch4_m2").alias("published_g_ch4"),
        F.col("g_c_m2").alias("published_g_c"),
    )


def holdout_against_published(
    annual: DataFrame, published: Mapping[int, tuple[float, float]] = K.PUBLISHED_CARBON, keys: Keys = ()
) -> DataFrame:
    """Predicted annual carbon against the published budget, and whether its interval holds it."""
    targets = _published_rows(annual.sparkSession, published)
    gap = F.col("g_c_m2") - F.col("value")
    return annual.join(targets, "year").select(
        *keys,
        "year",
        F.col("n_months").alias("n_months_integrated"),
        F.bround("g_c_m2", 2).alias("predicted_g_c_m2"),
        F.col("value").alias("published_g_c_m2"),
        F.col("uncertainty").alias("uncertainty_g_c"),
        F.bround(gap, 2).alias("difference_g_c"),
        (F.abs(gap) <= F.col("uncertainty")).alias("within_interval"),
    )


def independent_check_coverage(
    months: DataFrame, seasons: Sequence[int] = K.GROWING_SEASONS, first: int = 5, last: int = 10, keys: Keys = ()
) -> DataFrame:
    """How many months of each named growing season the record holds."""
    month, moy = F.year("month"), F.month("month")
    count = lambda y: F.count_distinct(F.when((month == y) & moy.between(first, last), F.col("month")))
    wide = months.groupBy(*keys).agg(*[count(y).alias(f"s{y}") for y in seasons])
    rows = F.array(
        *[
            F.struct(
                F.lit(f"{y}-{first:02d}..{y}-{last:02d}").alias("growing_season"),
                F.lit(last - first + 1).alias("months_in_season"),
                F.col(f"s{y}").alias("months_observed"),
            )
            for y in seasons
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def season_totals(
    monthly: DataFrame, columns: Sequence[str], first: int = 5, last: int = 10, keys: Keys = ()
) -> DataFrame:
    """Carbon mass of one part of the year, per year, for a projection and its bounds."""
    grams = lambda c: F.bround(F.sum(C.monthly_flux_to_grams(c, "month")) * K.C_PER_CH4, 3)
    return (
        monthly.filter(F.month("month").between(first, last))
        .groupBy(*keys, F.year("month").alias("year"))
        .agg(F.count("*").alias("n_months"), *[grams(c).alias(f"{c}_g_c") for c in columns])
    )


