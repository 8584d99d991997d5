"""Statistics over tables: paired differences, regressions, rank tests, seasonal structure."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.functions import exact, tails
from fluxspark.functions.linear import solved
from fluxspark.operators.common import (
    Keys,
    attach,
    by,
    cumulative_counts,
    exact_quantiles,
    interpolated,
    key_join,
    order_statistics,
    quantile_targets,
)

# ---- paired differences -----------------------------------------------------------------------


def difference_statistics(df: DataFrame, value: str = "difference", trim: float = 0.005, keys: Keys = ()) -> DataFrame:
    """Location, spread and shape of row-level differences, with exact quantiles.

    ``skewness_trimmed`` drops floor(trim * n) rows at each end. The two cut values come from exact order
    statistics, and rows tied with a cut count by their multiplicity, so nothing is sorted whole.
    """
    cut = lambda n: F.floor(n * F.lit(trim)).cast("bigint")
    probs = {"__q1": 0.25, "median": 0.5, "__q3": 0.75}
    cuts = [("__lo", trim, lambda n: cut(n) + 1), ("__hi", 1 - trim, lambda n: n - cut(n))]
    ranks = order_statistics(df, value, [*quantile_targets(probs), *cuts], keys, count="__cnt")
    ranks = ranks.select(*keys, *[interpolated(c, p, F.col("__cnt")) for c, p in probs.items()], "__lo", "__hi")
    v = F.col(value)
    moments = df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd_raw_moment"),
        F.skewness(v).alias("skewness_raw"),
        F.kurtosis(v).alias("excess_kurtosis"),
    )
    stats = attach(moments, ranks, keys)
    centred = attach(
        df.select(*keys, v.alias("__v")).filter("__v is not null"),
        stats.select(*keys, F.col("mean").alias("__c"), "__lo", "__hi"),
        keys,
    )
    d, inside = F.col("__v") - F.col("__c"), (F.col("__v") > F.col("__lo")) & (F.col("__v") < F.col("__hi"))
    sums = centred.groupBy(*keys).agg(
        F.count_if(F.col("__v") <= F.col("__lo")).alias("__nlo"),
        F.count_if(F.col("__v") >= F.col("__hi")).alias("__nhi"),
        *[F.coalesce(F.sum(F.when(inside, F.pow(d, m))), F.lit(0.0)).alias(f"__s{m}") for m in (1, 2, 3)],
    )
    full = attach(stats, sums, keys)
    k, kept = cut(F.col("n")), F.col("n") - 2 * cut(F.col("n"))
    flat = F.col("__lo") == F.col("__hi")
    at_low = F.when(flat, kept).otherwise(F.col("__nlo") - k)
    at_high = F.when(flat, 0).otherwise(F.col("__nhi") - k)
    raw = lambda m: (
        F.col(f"__s{m}")
        + at_low * F.pow(F.col("__lo") - F.col("mean"), m)
        + at_high * F.pow(F.col("__hi") - F.col("mean"), m)
    ) / kept
    a, b, c = raw(1), raw(2), raw(3)
    m2, m3 = b - a * a, c - 3 * a * b + 2 * a * a * a
    iqr = F.col("__q3") - F.col("__q1")
    return full.select(
        *keys,
        "n",
        "median",
        "mean",
        iqr.alias("iqr"),
        (iqr / (2 * math.log(2))).alias("laplace_scale_from_iqr"),
        (iqr / (2 * math.log(2)) * math.sqrt(2)).alias("sigma_robust"),
        "sd_raw_moment",
        "skewness_raw",
        F.when(m2 > 0, m3 / F.pow(m2, 1.5)).alias("skewness_trimmed"),
        "excess_kurtosis",
    )


def _fits(df: DataFrame, value: str, keys: Keys) -> DataFrame:
    """Maximum-likelihood location and scale of both families, and their log likelihoods."""
    median = exact_quantiles(df, value, {"__med": 0.5}, keys)
    v = F.col(value)
    rows = attach(df.filter(v.isNotNull()).select(*keys, v.alias("__v")), median, keys)
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("__med").alias("laplace_loc"),
        F.avg(F.abs(F.col("__v") - F.col("__med"))).alias("laplace_scale"),
        F.avg("__v").alias("gaussian_loc"),
        F.stddev_pop("__v").alias("gaussian_scale"),
    )
    n = F.col("n")
    return stats.select(
        "*",
        (-n * F.ln(2 * F.col("laplace_scale")) - n).alias("laplace_loglik"),
        (-n / 2 * F.ln(2 * math.pi * F.pow("gaussian_scale", F.lit(2.0))) - n / 2).alias("gaussian_loglik"),
    )


def laplace_vs_gaussian(
    df: DataFrame, value: str = "difference", ks: bool | Sequence[str] = True, keys: Keys = ()
) -> DataFrame:
    """Both fits as rows: location, scale, log likelihood, AIC, and the Kolmogorov-Smirnov distance.

    ``ks`` may name the families whose distance is wanted; the other's is null then.
    """
    fits, wanted = _fits(df, value, keys), ("laplace", "gaussian") if ks is True else tuple(ks or ())
    if wanted:
        ranks = attach(cumulative_counts(df, value, keys), fits, keys)
        top, bottom = F.col("n_through") / F.col("n"), (F.col("n_through") - F.col("n_at")) / F.col("n")
        z = F.try_divide(F.col(value) - F.col("gaussian_loc"), F.col("gaussian_scale"))
        cdf = {"laplace": C.laplace_cdf(value, "laplace_loc", "laplace_scale"), "gaussian": tails.normal_cdf(F.col("__z"))}
        gap = lambda f: F.max(F.greatest(top - f, f - bottom))
        distances = [(gap(cdf[f]) if f in wanted else F.lit(None).cast("double")).alias(f"{f}_ks") for f in cdf]
        fits = attach(fits, ranks.withColumn("__z", z).groupBy(*keys).agg(*distances), keys)
    best = F.least(4 - 2 * F.col("laplace_loglik"), 4 - 2 * F.col("gaussian_loglik"))
    row = lambda f: F.struct(
        F.lit(f).alias("distribution"),
        F.col(f"{f}_loc").alias("loc"),
        F.col(f"{f}_scale").alias("scale"),
        F.col(f"{f}_loglik").alias("loglik"),
        (4 - 2 * F.col(f"{f}_loglik")).alias("aic"),
        *([F.col(f"{f}_ks").alias("ks_statistic")] if ks else []),
        (4 - 2 * F.col(f"{f}_loglik") - best).alias("delta_aic_vs_best"),
    )
    return fits.select(*keys, F.explode(F.array(row("laplace"), row("gaussian"))).alias("r")).select(*keys, "r.*")


def residual_distribution(df: DataFrame, value: str = "residual", keys: Keys = ()) -> DataFrame:
    """AIC of both families; a positive gap prefers Laplace."""
    fits = _fits(df, value, keys)
    a, g = 4 - 2 * F.col("laplace_loglik"), 4 - 2 * F.col("gaussian_loglik")
    return fits.select(*keys, "n", a.alias("aic_laplace"), g.alias("aic_gaussian"), (g - a).alias("delta_aic"))


# ---- regressions -------------------------------------------------------------------------------


def _moments(x: Column, y: Column, tag: str) -> list[Column]:
    return [
        F.count(x).alias(f"n{tag}"),
        F.avg(x).alias(f"mx{tag}"),
        F.avg(y).alias(f"my{tag}"),
        F.var_samp(x).alias(f"vx{tag}"),
        F.var_samp(y).alias(f"vy{tag}"),
        F.covar_samp(x, y).alias(f"cv{tag}"),
    ]


def _rma(tag: str = "") -> dict[str, Column]:
    n, mx, my, vx, vy, cv = (F.col(f"{c}{tag}") for c in ("n", "mx", "my", "vx", "vy", "cv"))
    r = F.try_divide(cv, F.sqrt(vx * vy))
    slope = F.signum(r) * F.try_divide(F.sqrt(vy), F.sqrt(vx))
    se = F.abs(slope) * F.sqrt((1 - r * r) / n)
    left = F.try_divide((n - 1) * (vy - 2 * slope * cv + slope * slope * vx), (n - 2).cast("double"))
    return {
        "n": n,
        "slope": slope,
        "slope_se": se,
        "intercept": my - slope * mx,
        "intercept_se": F.sqrt(left / n + F.pow(se * mx, 2)),
        "r": r,
    }


def _ols(tag: str = "") -> dict[str, Column]:
    n, mx, my, vx, vy, cv = (F.col(f"{c}{tag}") for c in ("n", "mx", "my", "vx", "vy", "cv"))
    r2 = F.try_divide(cv * cv, vx * vy)
    slope = F.try_divide(cv, vx)
    se = F.sqrt(F.try_divide((1 - r2) * vy, vx * (n - 2)))
    intercept = my - slope * mx
    intercept_se = se * F.sqrt(vx * (n - 1) / n + mx * mx)
    return {
        "n": n,
        "slope": slope,
        "slope_se": se,
        "t_slope_vs_1": F.try_divide(slope - 1, se),
        "intercept": intercept,
        "intercept_se": intercept_se,
        "t_intercept_vs_0": F.try_divide(intercept, intercept_se),
        "r2": r2,
    }


def _both(x: str, y: str, mask: Column | None = None) -> tuple[Column, Column]:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    ok = ok if mask is None else ok & mask
    return F.when(ok, F.col(x)), F.when(ok, F.col(y))


def reduced_major_axis(df: DataFrame, x: str, y: str, keys: Keys = ()) -> DataFrame:
    """Regression that lets both variables carry error, from one pass of moments."""
    stats = df.groupBy(*keys).agg(*_moments(*_both(x, y), ""))
    return stats.select(*keys, *[e.alias(c) for c, e in _rma().items()])


def ols_regression(df: DataFrame, x: str, y: str, keys: Keys = ()) -> DataFrame:
    stats = df.groupBy(*keys).agg(*_moments(*_both(x, y), ""))
    return stats.select(*keys, *[e.alias(c) for c, e in _ols().items()])


def regression_sweep(
    pairs: DataFrame,
    x: str,
    y: str,
    quantiles: Sequence[float] = K.SCREEN_QUANTILES,
    limits: Sequence[float] = K.SCREEN_LIMITS,
    combined: tuple[float, float] = (100, 0.98),
    keys: Keys = (),
) -> DataFrame:
    """Both regressions under each outlier screen: all screens share one pass over the pairs."""
    rows = pairs.withColumn("__d", F.abs(F.col(x) - F.col(y)))
    probs = {f"__q{q:g}".replace(".", "_"): q for q in {*quantiles, combined[1]}}
    rows = attach(rows, exact_quantiles(rows, "__d", probs, keys), keys)
    q_at = lambda q: F.col(f"__q{q:g}".replace(".", "_"))
    within = lambda m: (F.abs(x) < m) & (F.abs(y) < m)
    screens = {"none": F.lit(True)}
    screens |= {f"|diff| <= q{q:g}": F.col("__d") <= q_at(q) for q in quantiles}
    screens |= {f"|flux| < {m:g}": within(m) for m in limits}
    m, q = combined
    screens[f"|flux| < {m:g} & |diff| <= q{q:g}"] = within(m) & (F.col("__d") <= q_at(q))
    aggs = [e for i, mask in enumerate(screens.values()) for e in _moments(*_both(x, y, mask), str(i))]

    def row(i: int, name: str) -> Column:
        rma, ols = _rma(str(i)), _ols(str(i))
        return F.struct(
            F.lit(name).alias("screen"),
            rma["n"].alias("n"),
            *[rma[c].alias(f"rma_{c}") for c in ("slope", "slope_se", "intercept", "intercept_se")],
            ols["slope"].alias("ols_slope"),
            ols["t_slope_vs_1"].alias("ols_t_vs_1"),
            ols["intercept"].alias("ols_intercept"),
            ols["t_intercept_vs_0"].alias("ols_t_vs_0"),
            rma["r"].alias("r"),
        )

    wide = rows.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[row(i, s) for i, s in enumerate(screens)])).alias("r")).select(
        *keys, "r.*"
    )


def published_agreement(sweep: DataFrame, published=K.PUBLISHED_RMA, keys: Keys = ()) -> DataFrame:
    """Which screens put the regression inside the published error bars."""
    inside = lambda c: F.col(f"rma_{c}").between(
        published[c] - published[f"{c}_se"], published[c] + published[f"{c}_se"]
    )
    return sweep.select(
        *keys,
        "screen",
        "n",
        "rma_slope",
        "rma_intercept",
        inside("slope").alias("slope_in_range"),
        inside("intercept").alias("intercept_in_range"),
        (inside("slope") & inside("intercept")).alias("both"),
    )


# ---- two-sample comparisons ---------------------------------------------------------------------


def two_samples(rows: DataFrame, first: str, second: str, value: str = "value", on: Keys = ("covariate",)) -> DataFrame:
    """Two samples per group, flagged by boolean columns: means, effect sizes, rank and shape tests.

    Equal values fold into one counted row before the ordered window. P-values are asymptotic.
    """
    in1, in2 = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    v1, v2 = F.when(in1, F.col(value)), F.when(in2, F.col(value))
    rows = rows.filter(F.col(value).isNotNull())
    stats = rows.groupBy(*on).agg(
        F.count(v1).alias("n1"),
        F.count(v2).alias("n2"),
        F.avg(v1).alias("m1"),
        F.avg(v2).alias("m2"),
        F.var_samp(v1).alias("s1"),
        F.var_samp(v2).alias("s2"),
    )
    counts = rows.groupBy(*on, value).agg(F.count(v1).alias("c1"), F.count(v2).alias("c2"))
    upto = by(*on).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cum = attach(
        counts.withColumn("t1", F.sum("c1").over(upto)).withColumn("t2", F.sum("c2").over(upto)), stats, on
    )
    t = F.col("c1") + F.col("c2")
    tests = cum.groupBy(*on).agg(
        F.sum(F.col("c1") * (F.col("t2") - F.col("c2") / 2)).alias("u"),
        F.max(F.abs(F.try_divide(F.col("t1"), F.col("n1")) - F.try_divide(F.col("t2"), F.col("n2")))).alias("ks_statistic"),
        F.sum((t * t * t - t).cast("double")).alias("ties"),
    )
    out = attach(stats, tests, on)
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    pooled = F.sqrt(F.try_divide((n1 - 1) * F.col("s1") + (n2 - 1) * F.col("s2"), (n - 2).cast("double")))
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), (n * (n - 1)).cast("double"))))
    z = F.greatest(F.try_divide(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5, sd), F.lit(0.0))
    return out.select(
        *on,
        "n1",
        "n2",
        F.col("m1").alias("mean1"),
        F.col("m2").alias("mean2"),
        (F.col("m1") - F.col("m2")).alias("mean_difference"),
        F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled).alias("standardised_difference"),
        (F.try_divide(2 * F.col("u"), (n1 * n2).cast("double")) - 1).alias("cliffs_delta"),
        tails.normal_p_value(z).alias("mann_whitney_p"),
        "ks_statistic",
        tails.kolmogorov_p_value(F.sqrt(n1 * n2 / n) * F.col("ks_statistic")).alias("ks_p"),
    )


def exact_two_samples(rows: DataFrame, first: str, second: str, value: str = "value", on: Keys = ("covariate",), most: int = 8, cells: int = 10_000) -> DataFrame:
    """n1, n2, u, ks_statistic and exact p-values of two samples per group.

    The rank-sum p is exact where there are no ties and one sample has at most ``most`` values, the distance p where n1 n2 is at most
    ``cells``; elsewhere they are null, and the asymptotic ones of ``two_samples`` hold.
    """
    tests = two_samples(rows, first, second, value, on)
    in1, in2 = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    used = rows.filter(F.col(value).isNotNull() & (in1 | in2)).groupBy(*on, value).agg(F.count("*").alias("__c"))
    tied = used.groupBy(*on).agg((F.max("__c") > 1).alias("__tied"))
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.round((F.col("cliffs_delta") + 1) / 2 * n1 * n2, 1)
    small = (F.least(n1, n2) <= most) & (n1 * n2 <= cells) & ~F.col("__tied")
    return attach(tests, tied, on).withColumn("u", u).select(
        *on, "n1", "n2", "u", "ks_statistic",
        F.when(small, exact.rank_sum_p(F.col("u"), n1, n2)).alias("mann_whitney_p"),
        F.when(n1 * n2 <= cells, exact.two_sample_distance_p(F.col("ks_statistic"), n1, n2)).alias("ks_p"),
    )


def deseasonalise(df: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Each column less its own month-of-year mean over every month it holds."""
    moy = by(*keys, "__moy")
    rows = df.withColumn("__moy", F.month("month"))
    return rows.withColumns({c: F.col(c) - F.avg(c).over(moy) for c in columns}).drop("__moy")


def compare_periods(
    covariates: DataFrame,
    fit: DataFrame,
    target: DataFrame,
    columns: Sequence[str],
    deseasonalised: bool = False,
    keys: Keys = (),
) -> DataFrame:
    """Target-period against fit-period values of each covariate (sample 1 is the target)."""
    from fluxspark.operators.support import _roles

    frame = deseasonalise(covariates, columns, keys) if deseasonalised else covariates
    return two_samples(_roles(frame, fit, target, columns, keys), "__t", "__f", on=[*keys, "covariate"])


def early_late_contrast(
    covariates: DataFrame, columns: Sequence[str], early: tuple[str, str], late: tuple[str, str], keys: Keys = ()
) -> DataFrame:
    """Two named spans; a covariate absent from either is left out."""
    month = F.col("month")
    between = lambda span: month.between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
    rows = (
        covariates.withColumn("__e", between(early))
        .withColumn("__l", between(late))
        .filter("__e or __l")
        .unpivot([*keys, "month", "__e", "__l"], list(columns), "covariate", "value")
    )
    out = two_samples(rows, "__e", "__l", on=[*keys, "covariate"]).filter("n1 > 0 and n2 > 0")
    return out.select(
        *keys,
        "covariate",
        F.bround("mean1", 3).alias("early_mean"),
        F.bround("mean2", 3).alias("late_mean"),
        F.bround(-F.col("mean_difference"), 3).alias("difference"),
        F.bround("mann_whitney_p", 4).alias("mann_whitney_p"),
    )


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a Pearson correlation."""
    left = F.greatest((1 - r) * (1 + r), F.lit(0.0))
    t = F.try_divide(r * F.sqrt((n - 2).cast("double")), F.sqrt(left))
    return F.when((left == 0) & (n > 2), F.lit(0.0)).otherwise(tails.t_p_value(t, (n - 2).cast("double")))


def axis_independence(df: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Correlation of each covariate with calendar time."""
    long = df.unpivot([*keys, "month"], list(columns), "covariate", "value").filter("value is not null")
    stats = long.groupBy(*keys, "covariate").agg(
        F.count("*").alias("n"), F.corr(C.month_index("month").cast("double"), "value").alias("correlation_with_time")
    )
    return stats.withColumn("p_value", correlation_p(F.col("correlation_with_time"), F.col("n")))


def covariate_anomaly(
    covariates: DataFrame, period: DataFrame, reference: DataFrame, columns: Sequence[str], keys: Keys = ()
) -> DataFrame:
    """How a period's covariates differ from a reference period."""
    from fluxspark.operators.support import _roles

    rows = _roles(covariates, reference, period, columns, keys)
    t, r = F.when(F.col("__t"), F.col("value")), F.when(F.col("__f"), F.col("value"))
    gap, spread = F.avg(t) - F.avg(r), F.stddev_samp(r)
    return rows.groupBy(*keys, "covariate").agg(
        F.bround(F.avg(t), 3).alias("period_mean"),
        F.bround(F.avg(r), 3).alias("reference_mean"),
        F.bround(gap, 3).alias("difference"),
        F.when(spread > 0, F.bround(gap / spread, 2)).alias("standardized"),
        F.bround(F.max(t), 3).alias("period_max"),
        F.bround(F.max(r), 3).alias("reference_max"),
    )


# ---- observed against predicted -------------------------------------------------------------------


def monthly_comparison(observed: DataFrame, predicted: DataFrame, keys: Keys = ()) -> DataFrame:
    """Observed and predicted monthly flux with their carbon mass (columns observed, predicted)."""
    on = [*keys, "month"]
    rows = observed.select(*on, "observed").join(predicted.select(*on, "predicted"), on)
    carbon = lambda c: C.monthly_flux_to_grams(c, "month") * K.C_PER_CH4
    return rows.select(
        "*",
        carbon("observed").alias("observed_g_c"),
        carbon("predicted").alias("predicted_g_c"),
        (carbon("observed") - carbon("predicted")).alias("shortfall_g_c"),
        F.try_divide("predicted", "observed").alias("ratio"),
    )


def concentration(comparison: DataFrame, column: str = "shortfall_g_c", keys: Keys = ()) -> DataFrame:
    """How much of the total the largest one, two and three months carry."""
    v = F.col(column)
    ranked = comparison.withColumn("__r", F.row_number().over(by(*keys).orderBy(F.desc(column), "month")))
    total = F.sum(v)
    top = lambda k: F.when(
        (F.count("*") >= k) & (total != 0), F.bround(100 * F.sum(F.when(F.col("__r") <= k, v)) / total, 1)
    )
    return ranked.groupBy(*keys).agg(
        total.alias("total_shortfall"),
        F.count("*").alias("n_months"),
        F.count_if(v > 0).alias("n_months_under_predicted"),
        *[top(k).alias(f"top_{k}_share_pct") for k in (1, 2, 3)],
        F.min_by("month", "__r").alias("largest_month"),
        F.bround(F.max(v), 3).alias("largest_value"),
        F.bround(F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)), 3).alias("sum_of_positive"),
    )


def climatology_lookup(df: DataFrame, reference: DataFrame, value: str, keys: Keys = ()) -> DataFrame:
    """Month-of-year mean and deviation of a reference set beside each row."""
    moy = reference.groupBy(*keys, F.month("month").alias("month_of_year")).agg(
        F.avg(value).alias("reference_mean"), F.stddev_samp(value).alias("reference_sd")
    )
    return key_join(df.withColumn("month_of_year", F.month("month")), moy, [*keys, "month_of_year"])


def extreme_months(df: DataFrame, reference: DataFrame, value: str, n: int = 5, keys: Keys = ()) -> DataFrame:
    """Months furthest above the same calendar month elsewhere; a month without spread is unranked."""
    rows = climatology_lookup(df, reference, value, keys)
    z = F.when(F.col("reference_sd") > 0, (F.col(value) - F.col("reference_mean")) / F.col("reference_sd"))
    rows = rows.withColumn("__z", z).filter("__z is not null")
    ranked = rows.withColumn("rank", F.row_number().over(by(*keys).orderBy(F.desc("__z"), "month")))
    return ranked.filter(F.col("rank") <= n).select(
        *keys,
        "month",
        F.bround(value, 3).alias("flux"),
        F.bround("reference_mean", 3).alias("reference_mean"),
        F.bround("reference_sd", 3).alias("reference_sd"),
        F.bround("__z", 3).alias("standardized"),
    )


def bias_by_band(df: DataFrame, residual: str, covariate: str, n_bands: int = 3, keys: Keys = ()) -> DataFrame:
    """Mean residual by quantile band of a covariate. Bands are right-closed; tied edges stop the job."""
    rows = df.filter(F.col(residual).isNotNull() & F.col(covariate).isNotNull())
    probs = F.array(*[F.lit(i / n_bands) for i in range(1, n_bands)])
    edges = rows.groupBy(*keys).agg(
        F.percentile(covariate, probs).alias("__e"),
        F.min(covariate).alias("__lo"),
        F.max(covariate).alias("__hi"),
    )
    all_edges = F.concat(F.array("__lo"), F.col("__e"), F.array("__hi"))
    tied = F.raise_error(F.lit("band edges are tied")).cast("array<double>")
    edges = edges.withColumn("__e", F.when(F.size(F.array_distinct(all_edges)) == n_bands + 1, F.col("__e")).otherwise(tied))
    band = F.size(F.filter("__e", lambda e: e < F.col(covariate))) + 1
    mean = F.avg(residual)
    return (
        attach(rows, edges.select(*keys, "__e"), keys)
        .groupBy(*keys, band.alias("band"))
        .agg(
            F.count("*").alias("n"),
            F.bround(F.avg(covariate), 4).alias("covariate_mean"),
            F.bround(mean, 4).alias("bias_log"),
            F.bround(C.prediction_error_pct(mean), 4).alias("prediction_error_pct"),
            C.bias_direction(mean).alias("direction"),
        )
    )


def bias_table(df: DataFrame, bias: str = "bias_log") -> DataFrame:
    return df.select(
        "*",
        C.predicted_over_observed(bias).alias("predicted_over_observed"),
        C.prediction_error_pct(bias).alias("prediction_error_pct"),
        C.bias_direction(bias).alias("direction"),
    )


def combine_additively(df: DataFrame, bias: str = "bias_log", keys: Keys = ()) -> DataFrame:
    """Net of several log biases, and how much of them cancels."""
    net = F.sum(bias)
    return df.groupBy(*keys).agg(
        net.alias("net_bias_log"),
        C.predicted_over_observed(net).alias("predicted_over_observed"),
        C.prediction_error_pct(net).alias("prediction_error_pct"),
        C.bias_direction(net).alias("direction"),
        (1 - F.try_divide(F.abs(net), F.sum(F.abs(bias)))).alias("cancellation_share"),
    )


# ---- seasonal structure ---------------------------------------------------------------------------


def _seasonal_coefficients(n: str, s: str) -> Column:
    """Least squares on the calendar terms from per-calendar-month counts and sums."""
    terms = [(1.0, math.sin(math.pi * m / 6), math.cos(math.pi * m / 6), (m - 1) / 12) for m in range(1, 13)]
    weighted = lambda c, f: reduce(lambda x, y: x + y, [F.col(c)[m] * f(terms[m]) for m in range(12)])
    row = lambda i: F.array(*[weighted(n, lambda t, j=j: t[i] * t[j]) for j in range(4)], weighted(s, lambda t: t[i]))
    return solved(F.array(*[row(i) for i in range(4)]), 4)


def seasonal_residuals(rows: DataFrame, value: str, on: Keys) -> DataFrame:
    """Residual of a value on intercept and three calendar terms, per group."""
    rows = rows.filter(F.col(value).isNotNull())
    mean = rows.groupBy(*on).agg(F.avg(value).alias("__mu"))
    rows = attach(rows, mean, on)
    moy, d = F.month("month"), F.col(value) - F.col("__mu")
    cells = rows.groupBy(*on).agg(
        F.array(*[F.count_if(moy == m).cast("double") for m in range(1, 13)]).alias("__n"),
        F.array(*[F.coalesce(F.sum(F.when(moy == m, d)), F.lit(0.0)) for m in range(1, 13)]).alias("__s"),
    )
    coefs = cells.withColumn("__b", _seasonal_coefficients("__n", "__s")).select(*on, "__b")
    terms = list(C.seasonal_terms("month").values())
    fitted = sum((F.col("__b")[i + 1] * t for i, t in enumerate(terms)), F.col("__b")[0])
    return attach(rows, coefs, on).withColumn("residual", d - fitted).drop("__b", "__mu")


def explained_by_calendar(covariates: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Share of each covariate's variance the calendar terms hold; null below twelve months."""
    on = [*keys, "covariate"]
    long = covariates.unpivot([*keys, "month"], list(columns), "covariate", "value")
    res = seasonal_residuals(long, "value", on)
    share = 1 - F.try_divide(F.var_pop("residual"), F.var_pop("value"))
    return res.groupBy(*on).agg(F.count("*").alias("n"), F.when(F.count("*") >= 12, share).alias("explained"))


def seasonal_redundancy(
    series: DataFrame, covariates: DataFrame, lags: Sequence[tuple[str, int]], value: str = "value", keys: Keys = ()
) -> DataFrame:
    """Per covariate lag: what the calendar explains, and the partial correlation with the flux.

    ``series`` and ``covariates`` are month grids without holes, so lags are calendar lags.
    """
    on = [*keys, "month"]
    flux = deseasonalise(series.select(*on, F.col(value).alias("__y")), ["__y"], keys)
    order = by(*keys).orderBy("month")
    names = [f"{c}_lag{k}" for c, k in lags]
    wide = covariates.select(*on, *[F.lag(c, k).over(order).alias(f"{c}_lag{k}") for c, k in lags])
    long = key_join(wide, flux, on, "inner").unpivot([*on, "__y"], names, "predictor", "__x")
    res = seasonal_residuals(long.filter("__x is not null and __y is not null"), "__x", [*keys, "predictor"])
    stats = res.groupBy(*keys, "predictor").agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.var_pop("residual"), F.var_pop("__x"))).alias("__e"),
        F.corr("residual", "__y").alias("__r"),
    )
    return stats.select(
        *keys,
        "predictor",
        "n",
        F.bround("__e", 3).alias("explained_by_calendar"),
        F.bround("__r", 3).alias("partial_r"),
        F.bround(correlation_p(F.col("__r"), F.col("n")), 4).alias("p"),
    )


def autocorrelation(df: DataFrame, value: str = "value", nlags: int = 13, keys: Keys = ()) -> DataFrame:
    """Autocorrelation of the observed rows at each lag (lags count observations, not months)."""
    rows = df.filter(F.col(value).isNotNull())
    rows = attach(rows, rows.groupBy(*keys).agg(F.avg(value).alias("__mu")), keys).withColumn(
        "__x", F.col(value) - F.col("__mu")
    )
    order = by(*keys).orderBy("month")
    lagged = rows.select(*keys, "__x", *[F.lag("__x", k).over(order).alias(f"__l{k}") for k in range(1, nlags + 1)])
    wide = lagged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[
            F.try_divide(F.sum(F.col("__x") * F.col(f"__l{k}")), F.sum(F.col("__x") * F.col("__x"))).alias(f"a{k}")
            for k in range(1, nlags + 1)
        ],
    )
    rows_ = F.array(
        F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("autocorrelation")),
        *[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("autocorrelation")) for k in range(1, nlags + 1)],
    )
    return wide.select(*keys, "n", F.explode(rows_).alias("r")).select(*keys, "n", "r.*")


def seasonal_significance(acf: DataFrame, period: int = K.PERIOD, keys: Keys = ()) -> DataFrame:
    """Autocorrelation at the seasonal lag against its Bartlett standard error."""
    a = F.col("autocorrelation")
    below = F.sum(F.when((F.col("lag") >= 1) & (F.col("lag") < period), a * a))
    at = F.max(F.when(F.col("lag") == period, a))
    se = F.sqrt((1 + 2 * below) / F.max("n"))
    return acf.groupBy(*keys).agg(
        F.max("n").alias("n"),
        at.alias("seasonal_autocorrelation"),
        se.alias("bartlett_se"),
        (at / se).alias("z"),
        (F.abs(at / se) > 1.96).alias("significant"),
    )


def _trend(x, y) -> list[Column]:
    return [F.regr_slope(y, x), F.corr(y, x), F.count(y)]


def trend_tests(df: DataFrame, value: str = "value", min_months: int = 10, keys: Keys = ()) -> DataFrame:
    """Linear trend of the series raw and deseasonalised, and of its within-year amplitude."""
    rows = df.filter(F.col(value).isNotNull())
    order = by(*keys).orderBy("month")
    flat = deseasonalise(rows.select(*keys, "month", F.col(value).alias("__y"), F.col(value).alias("__d")), ["__d"], keys)
    flat = flat.withColumn("__t", (F.row_number().over(order) - 1).cast("double"))
    s, r, n = _trend("__t", "__y")
    sd, rd, _ = _trend("__t", "__d")
    base = flat.groupBy(*keys).agg(
        n.alias("n"),
        (s * 12).alias("trend_per_year"),
        r.alias("__r"),
        (sd * 12).alias("deseasonalised_trend_per_year"),
        rd.alias("__rd"),
    )
    years = rows.groupBy(*keys, F.year("month").alias("__yr")).agg(
        (F.max(value) - F.min(value)).alias("__a"), F.count("*").alias("__c")
    )
    sa, ra, na = _trend(F.col("__yr").cast("double"), F.col("__a"))
    swing = years.filter(F.col("__c") >= min_months).groupBy(*keys).agg(
        na.alias("n_years"),
        F.avg("__a").alias("amplitude_mean"),
        F.min("__a").alias("amplitude_min"),
        F.max("__a").alias("amplitude_max"),
        F.try_divide(100 * F.stddev_samp("__a"), F.avg("__a")).alias("amplitude_cv_pct"),
        sa.alias("amplitude_trend_per_year"),
        ra.alias("__ra"),
    )
    out = attach(base, swing, keys)
    return out.select(
        *keys,
        "n",
        "trend_per_year",
        correlation_p(F.col("__r"), F.col("n")).alias("trend_p"),
        "deseasonalised_trend_per_year",
        correlation_p(F.col("__rd"), F.col("n")).alias("deseasonalised_trend_p"),
        "n_years",
        "amplitude_mean",
        "amplitude_min",
        "amplitude_max",
        "amplitude_cv_pct",
        "amplitude_trend_per_year",
        correlation_p(F.col("__ra"), F.col("n_years")).alias("amplitude_trend_p"),
    )


def seasonal_parts(df: DataFrame, value: str = "value", keys: Keys = ()) -> DataFrame:
    """Observed value as the repeating month-of-year mean and what is left."""
    rows = df.filter(F.col(value).isNotNull()).withColumn("__moy", F.month("month"))
    mean = F.avg(value).over(by(*keys, "__moy"))
    return rows.select(
        *keys, "month", F.col(value).alias("observed"), mean.alias("repeating"), (F.col(value) - mean).alias("leftover")
    )


def seasonal_parts_summary(parts: DataFrame, keys: Keys = ()) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (1 - F.try_divide(F.var_samp("leftover"), F.var_samp("observed"))).alias("explained"),
        F.try_divide(F.stddev_samp("leftover"), F.stddev_samp("observed")).alias("left_share"),
    )


def yearly_swing(df: DataFrame, value: str = "value", min_months: int = 10, keys: Keys = ()) -> DataFrame:
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.year("month").alias("year"))
        .agg(F.count("*").alias("n_months"), (F.max(value) - F.min(value)).alias("swing"))
        .filter(F.col("n_months") >= min_months)
    )


# ---- residual quantiles and their band ---------------------------------------------------------------


def scale_by_weight(residuals: DataFrame, weights: DataFrame, residual: str = "residual", keys: Keys = ()) -> DataFrame:
    """Residuals on the scale a weighted fit assumes: each times its month's weight."""
    rows = residuals.join(weights.select(*keys, "month", "weight"), [*keys, "month"])
    return rows.withColumn(residual, F.col(residual) * F.col("weight")).drop("weight")


def qq_table(df: DataFrame, value: str = "residual", family: str = "laplace", keys: Keys = ()) -> DataFrame:
    """Ordered residuals against the quantiles the fitted family puts them at, (k - 1/2) / n."""
    rows = attach(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("observed")), _fits(df, value, keys), keys)
    order = by(*keys).orderBy("observed")
    p = (F.col("k") - 0.5) / F.col("n")
    if family == "laplace":
        expected = C.laplace_quantile_of(p, "laplace_loc", "laplace_scale")
    elif family == "gaussian":
        expected = F.col("gaussian_loc") + F.col("gaussian_scale") * tails.normal_quantile(p)
    else:
        raise ValueError(f"unknown family {family!r}")
    return rows.withColumn("k", F.row_number().over(order)).select(*keys, "k", "observed", expected.alias("expected"))


def simultaneous_band(
    df: DataFrame, value: str = "residual", overall: float = 0.05, replicates: int = 2000, seed: int = K.SEED, keys: Keys = ()
) -> DataFrame:
    """Band in probability units that all n order statistics of a uniform sample stay inside together.

    Simulated on the cluster: each replicate is a hashed uniform sample of the group's own size. A rank's
    level in a replicate is its two-sided position among all replicates, and the level the
    band needs is the overall quantile of each replicate's least level.
    """
    sizes = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    draws = sizes.select("n").distinct().select(
        "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    ).repartition("rep").select("n", "rep", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("j"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "n", "rep", "j"), 11) + 0.5) / float(2**53)
    ranked = draws.withColumn("u", u).withColumn("k", F.row_number().over(Window.partitionBy("n", "rep").orderBy("u")))
    place = (F.row_number().over(Window.partitionBy("n", "k").orderBy("u")) - 0.5) / replicates
    levels = ranked.withColumn("__p", place)
    least = levels.groupBy("n", "rep").agg(F.min(2 * F.least("__p", 1 - F.col("__p"))).alias("__least"))
    level = least.groupBy("n").agg(F.percentile("__least", F.lit(overall)).alias("level"))
    at = levels.join(level, "n")
    inside = F.col("__p").between(F.col("level") / 2, 1 - F.col("level") / 2)
    band = at.groupBy("n", "k").agg(
        F.max("level").alias("level"),
        F.min(F.when(inside, F.col("u"))).alias("p_low"),
        F.max(F.when(inside, F.col("u"))).alias("p_high"),
    )
    return sizes.join(band, "n").select(*keys, "n", "k", "level", "p_low", "p_high")
