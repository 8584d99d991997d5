"""Designs, holdout experiments, stability under narrowing, and backward reconstruction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators import lad
from fluxspark.operators.aggregate import annual_carbon
from fluxspark.operators.common import Keys, attach, by, checkpointed, key_join
from fluxspark.operators.months import drier_subset, earliest_years, rising_flag
from fluxspark.operators.stats import bias_by_band, correlation_p
from fluxspark.operators.support import nearest_distance

BASE = ["intercept", "soil_temp_c"]
FULL = [*BASE, "water_table_clamped"]
VARIANTS = ("clamped", "unclamped", "reduced")


def clamp_bounds(df: DataFrame, column: str, keys: Keys = ()) -> DataFrame:
    """Lowest and highest value over training rows."""
    return df.groupBy(*keys).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def clamp_to(df: DataFrame, bounds: DataFrame, column: str, alias: str, keys: Keys = ()) -> DataFrame:
    b = bounds.select(*keys, F.col("low").alias("__low"), F.col("high").alias("__high"))
    return attach(df, b, keys).withColumn(alias, C.clamp(column, "__low", "__high")).drop("__low", "__high")


def build_design(
    df: DataFrame,
    bounds: DataFrame | None,
    soil: str = "soil_temp_f",
    water: str = "wte_m",
    include_water: bool = True,
    rising: str | None = None,
    keys: Keys = (),
) -> DataFrame:
    """Design columns beside the rows. The water-table term needs bounds of the training rows.

    ``rising`` names a boolean column; with it the warming limb gets its own level and slope.
    """
    out = df.withColumn("intercept", F.lit(1.0)).withColumn("soil_temp_c", C.fahrenheit_to_celsius(soil))
    if include_water:
        if bounds is None:
            raise ValueError("the water-table term needs training bounds")
        out = clamp_to(out, bounds, water, "water_table_clamped", keys)
    if rising:
        up = F.col(rising).cast("double")
        out = out.withColumn("warming_limb", up).withColumn("soil_temp_c_warming", F.col("soil_temp_c") * up)
    return out


def log_target(df: DataFrame, mean: str, alias: str = "y") -> DataFrame:
    return df.withColumn(alias, C.checked_log(mean))


def fit_frame(
    covariates: DataFrame, monthly: DataFrame, months: DataFrame, mean: str, se: str, keys: Keys = ()
) -> DataFrame:
    """Covariates, log flux, its standard error and its weight for a set of months."""
    on = [*keys, "month"]
    rows = key_join(covariates, months.select(*on).distinct(), on, "left_semi")
    rows = key_join(rows, monthly.select(*on, F.col(mean).alias("flux"), F.col(se).alias("se")), on)
    return log_target(rows, "flux").select(
        "*", C.log_standard_error("se", "flux").alias("se_log"), C.inverse_variance_weight("se").alias("weight")
    )


def run_experiments(
    frame: DataFrame,
    splits: DataFrame,
    distance_columns: Sequence[str],
    level: float = 0.90,
    soil: str = "soil_temp_f",
    water: str = "wte_m",
    with_water: Sequence[bool] = (True, False),
    weighted: Sequence[bool] = (False, True),
    hysteresis: bool = False,
    keys: Keys = (),
) -> DataFrame:
    """Fit without each held-out block and score the block: splits x {with, without water} x {weighted, not}.

    ``frame`` comes from :func:`fit_frame`. All series and splits of one model fit together in a
    single grouped job; bounds, residual quantiles and scales come from training rows alone.
    """
    xk = [*keys, "split"]
    ek = [*xk, "model", "weighting"]
    if hysteresis:
        frame = rising_flag(frame, soil, keys)
    names = splits.select(*keys, "split").distinct().groupBy(*keys).agg(F.collect_set("split").alias("__names"))
    spread = attach(checkpointed(frame), names, keys).withColumn("split", F.explode("__names")).drop("__names")
    held = splits.select(*xk, "month").withColumn("__h", F.lit(True))
    rows = key_join(spread, held, [*xk, "month"]).withColumn("held", F.coalesce("__h", F.lit(False))).drop("__h")
    # Monthly rows times splits: small, and every later step reads them.
    rows = checkpointed(rows)
    bounds = clamp_bounds(rows.filter(~F.col("held")), water, xk)
    design = build_design(rows, bounds, soil, water, True, "rising" if hysteresis else None, xk)
    extra = ["warming_limb", "soil_temp_c_warming"] if hysteresis else []
    suffix = " + hysteresis" if hysteresis else ""
    x = lambda on: F.array(*[F.col(c) for c in [*(FULL if on else BASE), *extra]])
    configs = F.array(
        *[
            F.struct(
                F.lit(("with water table" if on else "without water table") + suffix).alias("model"),
                F.lit("inverse variance" if use else "unweighted").alias("weighting"),
                x(on).alias("x"),
                (F.col("weight") if use else F.lit(1.0)).alias("w"),
            )
            for on in with_water
            for use in weighted
        ]
    )
    rows4 = design.select(*xk, "month", "held", "y", "se_log", F.explode(configs).alias("c")).select(
        *xk, "month", "held", "y", "se_log", "c.*"
    ).filter(F.col("held") | F.col("w").isNotNull())
    models = lad.fit_arrays(rows4.filter(~F.col("held")), ek)
    scored = attach(rows4, models, ek).withColumn("prediction", lad.dot("x", "beta"))
    scored = checkpointed(scored.withColumn("residual", F.col("y") - F.col("prediction")))
    train, test = scored.filter(~F.col("held")), scored.filter("held")
    summary = lad.residual_summary(train, "w", level, ek)
    both = attach(test, summary, ek)
    tail = (1 - level) / 2
    b = F.sqrt((2 * F.col("laplace_scale") * F.col("laplace_scale") + F.pow(F.coalesce("se_log", F.lit(0.0)), F.lit(2.0))) / 2)
    inside = lambda lo, hi: F.avg(F.col("residual").between(lo, hi).cast("int"))
    table = both.groupBy(*ek).agg(
        *lad.error_columns("y", "prediction"),
        F.max("n_train").alias("n_train"),
        F.max("laplace_scale").alias("laplace_scale_log"),
        F.max("train_medae_log").alias("train_medae_log"),
        F.first("beta")[1].alias("__slope"),
        inside(F.col("residual_low"), F.col("residual_high")).alias("coverage_empirical"),
        inside(C.laplace_quantile(tail, b), C.laplace_quantile(1 - tail, b)).alias("coverage_laplace"),
    )
    out = table.select(
        *ek, "n_train", "n_test", C.q10_from_slope("__slope").alias("q10"), "laplace_scale_log", "train_medae_log",
        "mae_log", "medae_log", "bias_log", "mae_flux", "medae_flux", "bias_flux", "mape_pct",
        "coverage_empirical", "coverage_laplace", F.lit(level).alias("nominal_level"),
    )
    return attach(out, _split_distances(rows, distance_columns, xk), xk)


def _split_distances(rows: DataFrame, columns: Sequence[str], xk: Keys) -> DataFrame:
    """Joint distance of the held-out months to the training months, per split."""
    train, test = rows.filter(~F.col("held")), rows.filter("held")
    own = nearest_distance(train, train, columns, True, keys=xk).withColumn("__held", F.lit(False))
    far = nearest_distance(test, train, columns, False, keys=xk).withColumn("__held", F.lit(True))
    both = own.unionByName(far)
    d = lambda held: F.when(F.col("__held") == held, F.col("distance"))
    q = both.groupBy(*xk).agg(
        F.percentile(d(False), F.array(F.lit(0.5), F.lit(0.95))).alias("__t"),
        F.percentile(d(True), F.lit(0.5)).alias("holdout_nn_median"),
        F.max(d(True)).alias("holdout_nn_max"),
    )
    beyond = attach(both, q.select(*xk, F.col("__t")[1].alias("__limit")), xk).groupBy(*xk).agg(
        F.count_if(F.col("__held") & (F.col("distance") > F.col("__limit"))).alias("holdout_beyond_train_p95")
    )
    return attach(q, beyond, xk).select(
        *xk,
        F.col("__t")[0].alias("train_nn_median"),
        F.col("__t")[1].alias("train_nn_p95"),
        "holdout_nn_median",
        "holdout_nn_max",
        "holdout_beyond_train_p95",
    )


def coefficient_path(
    frame: DataFrame,
    weighted: bool = False,
    shares: Sequence[float] = K.DROP_SHARES,
    n_bootstrap: int = K.N_BOOTSTRAP,
    seed: int = K.SEED,
    soil: str = "soil_temp_f",
    water: str = "wte_m",
    keys: Keys = (),
) -> DataFrame:
    """Coefficients as the wettest months go, each with a bootstrap interval.

    Draw j of replicate r is a hash of (seed, r, j), so results do not depend on partitions. Repeated
    draws become a count that multiplies the weight. Every replicate of every share and
    series is one group of the same fitting job.
    """
    pk = [*keys, "dropped_wettest_pct"]
    frame = checkpointed(frame)
    subsets = None
    for s in shares:
        part = drier_subset(frame, water, s, keys).withColumn("dropped_wettest_pct", F.lit(round(100 * s)))
        subsets = part if subsets is None else subsets.unionByName(part)
    if weighted:
        subsets = subsets.filter("weight is not null")
    rows = build_design(subsets, clamp_bounds(subsets, water, pk), soil, water, True, None, pk)
    rows = rows.withColumn("w", F.col("weight") if weighted else F.lit(1.0)).select(
        *pk, *FULL, "y", "w", F.col(water).alias("__wte"),
        (F.row_number().over(by(*pk).orderBy("month")) - 1).alias("i"),
    )
    rows = checkpointed(rows)
    fitted = lad.fit_lad(rows, FULL, "y", "w", pk, bounded=True)
    sizes = rows.groupBy(*pk).agg(F.count("*").alias("__n"))
    draws = (
        sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_bootstrap))))
        .withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))))
        .withColumn("i", F.pmod(F.xxhash64(F.lit(seed), *pk, "rep", "j"), F.col("__n")).cast("int"))
        .groupBy(*pk, "rep", "i")
        .agg(F.count("*").alias("times"))
    )
    sample = key_join(draws, rows.drop("__wte"), [*pk, "i"], "inner").withColumn("w", F.col("w") * F.col("times"))
    boot = lad.fit_lad(sample, FULL, "y", "w", [*pk, "rep"], bounded=True).filter("beta is not null")
    q = lambda i: F.percentile(F.col("beta")[i], F.array(F.lit(0.025), F.lit(0.975)))
    spread = boot.groupBy(*pk).agg(q(1).alias("__s"), q(2).alias("__w"), F.count("*").alias("n_bootstrap_ok"))
    span = rows.groupBy(*pk).agg(
        F.count("*").alias("n_months"),
        F.bround(F.min("__wte"), 3).alias("wte_min"),
        F.bround(F.max("__wte"), 3).alias("wte_max"),
        F.bround(F.max("__wte") - F.min("__wte"), 3).alias("wte_range"),
    )
    lo, hi = (lambda c: F.col(c)[0]), (lambda c: F.col(c)[1])
    return attach(attach(span, fitted, pk), spread, pk).select(
        *pk,
        "n_months", "wte_min", "wte_max", "wte_range",
        F.col("beta")[2].alias("water_table_coef"),
        lo("__w").alias("water_table_lo"),
        hi("__w").alias("water_table_hi"),
        ((lo("__w") <= 0) & (hi("__w") >= 0)).alias("water_table_includes_zero"),
        F.col("beta")[1].alias("soil_temp_coef"),
        lo("__s").alias("soil_temp_lo"),
        hi("__s").alias("soil_temp_hi"),
        C.q10_from_slope(F.col("beta")[1]).alias("q10"),
        C.q10_from_slope(lo("__s")).alias("q10_lo"),
        C.q10_from_slope(hi("__s")).alias("q10_hi"),
        "n_bootstrap_ok",
    )


def stability_verdict(path: DataFrame, max_drift: float = 0.25, alpha: float = 0.05, keys: Keys = ()) -> DataFrame:
    """Whether the water-table coefficient holds as its range narrows, and why not: ``failures`` by name, ``reasons`` with their numbers."""
    c, pct = F.col("water_table_coef"), F.col("dropped_wettest_pct")
    order = by(*keys).orderBy("dropped_wettest_pct")
    # Ties share their mean rank, as in Spearman's coefficient.
    mean_rank = lambda col: F.rank().over(by(*keys).orderBy(col)) + (F.count("*").over(by(*keys, col)) - 1) / 2
    rows = path.select(
        "*",
        F.first(c).over(order).alias("__base"),
        mean_rank("water_table_coef").alias("__rc"),
        mean_rank("dropped_wettest_pct").alias("__rp"),
    )
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.min_by(c, pct).alias("baseline_coefficient"),
        F.count_if(F.signum(c) != F.signum("__base")).alias("sign_changes"),
        F.count_if("water_table_includes_zero").alias("steps_spanning_zero"),
        (F.max(c) - F.min(c)).alias("coefficient_spread"),
        F.corr("__rc", "__rp").alias("trend"),
    )
    base, n, r = F.col("baseline_coefficient"), F.col("__n"), F.col("trend")
    drift = F.when(base != 0, F.col("coefficient_spread") / F.abs(base)).otherwise(F.lit(float("inf")))
    stats = stats.withColumn("relative_drift", drift).withColumn(
        "trend_p", correlation_p(r, n)
    )
    failures = F.array_compact(
        F.array(
            F.when(F.col("sign_changes") > 0, "sign changes"),
            F.when(F.col("steps_spanning_zero") > 0, "interval spans zero"),
            F.when(F.col("relative_drift") > max_drift, "coefficient drifts"),
            F.when((F.abs(r) >= 0.9) & (F.col("trend_p") < alpha), "monotone trend"),
        )
    )
    whole = lambda x: F.bround(x, 0).cast("bigint")
    reasons = F.transform(
        failures,
        lambda f: F.when(f == "sign changes", F.format_string("the sign changes at %d of %d steps", "sign_changes", n))
        .when(f == "interval spans zero", F.format_string("the interval spans zero at %d of %d steps", "steps_spanning_zero", n))
        .when(f == "coefficient drifts", F.format_string("the coefficient drifts by %d%% of its first value", whole(100 * F.col("relative_drift"))))
        .otherwise(F.format_string("the coefficient follows the share removed with a rank correlation of %d%%", whole(100 * r))),
    )
    return stats.withColumn("failures", failures).withColumn("stable", F.size("failures") == 0).withColumn("reasons", reasons).drop("__n")


def stability_paths(paths: DataFrame) -> DataFrame:
    """Paths of several treatments, ordered within each."""
    return paths.orderBy("treatment", "dropped_wettest_pct")


def fit_variant(
    fit: DataFrame, variant: str, weighted: bool = False, soil: str = "soil_temp_f", water: str = "wte_m", keys: Keys = ()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Models, training bounds and training residuals of one variant of the water-table term."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; known: {VARIANTS}")
    features = BASE if variant == "reduced" else FULL
    rows = fit.filter("weight is not null") if weighted else fit
    bounds = clamp_bounds(fit, water, keys)
    design = build_design(rows, bounds, soil, water, True, None, keys)
    models = lad.fit_lad(design, features, "y", "weight" if weighted else None, keys, bounded=True)
    return models, bounds, lad.residuals(design, models, features, "y", keys)


def predict_variant(
    target: DataFrame, models: DataFrame, bounds: DataFrame, variant: str,
    soil: str = "soil_temp_f", water: str = "wte_m", keys: Keys = (),
) -> DataFrame:
    """Log prediction over the target months. 'unclamped' lets the water table run past the fitted range."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant!r}; known: {VARIANTS}")
    if variant == "unclamped":
        wide = clamp_bounds(target, water, keys)
        bounds = wide.withColumns({"low": F.col("low") - 1.0, "high": F.col("high") + 1.0})
    design = build_design(target, bounds, soil, water, True, None, keys)
    return lad.predict(design, models, BASE if variant == "reduced" else FULL, keys)


def monthly_reconstruction(
    fit: DataFrame, target: DataFrame, weighted: bool = True, level: float = 0.90,
    soil: str = "soil_temp_f", water: str = "wte_m", keys: Keys = (),
) -> DataFrame:
    """Monthly flux of the three variants, with an empirical interval on the clamped one."""
    on = [*keys, "month"]
    fit, target = checkpointed(fit), checkpointed(target)
    full, bounds, res = fit_variant(fit, "clamped", weighted, soil, water, keys)
    full = checkpointed(full)
    reduced, _, _ = fit_variant(fit, "reduced", weighted, soil, water, keys)
    summary = lad.residual_summary(res, "weight" if weighted else None, level, keys)
    main = lad.empirical_interval(predict_variant(target, full, bounds, "clamped", soil, water, keys), summary, keys)
    out = main.select(*on, F.exp("prediction").alias("clamped"), F.exp("lower").alias("lower"), F.exp("upper").alias("upper"))
    for variant, models in (("unclamped", full), ("reduced", reduced)):
        part = predict_variant(target, models, bounds, variant, soil, water, keys)
        out = key_join(out, part.select(*on, F.exp("prediction").alias(variant)), on)
    return out


def wet_end_bias(
    frame: DataFrame, weighted: bool = True, n_years: int = 3, n_bands: int = 3,
    soil: str = "soil_temp_f", water: str = "wte_m", keys: Keys = (),
) -> DataFrame:
    """Mean residual in the wettest band of the first years, fitted without them."""
    on = [*keys, "month"]
    frame = checkpointed(frame)
    early = earliest_years(frame, n_years, keys)
    train = key_join(frame, early.select(*on), on, "left_anti")
    models, bounds, _ = fit_variant(train, "clamped", weighted, soil, water, keys)
    design = build_design(early, bounds, soil, water, True, None, keys)
    res = lad.residuals(design, models, FULL, "y", keys)
    bands = bias_by_band(res, "residual", water, n_bands, keys)
    return bands.filter(F.col("band") == n_bands).select(*keys, F.col("bias_log").alias("expected_bias_log"))


def annual_reconstruction(
    monthly: DataFrame, support: DataFrame, bias: DataFrame, keys: Keys = ()
) -> DataFrame:
    """Annual carbon per variant and edge, sensitivity range, support verdict and bias expectation."""
    yk = [*keys, "year"]
    annual = monthly.groupBy(*keys, F.year("month").alias("year")).agg(*[annual_carbon(c).alias(c) for c in (*VARIANTS, "lower", "upper")])
    low, high = F.least(*VARIANTS), F.greatest(*VARIANTS)
    rows = attach(annual, bias, keys)
    ratio = C.predicted_over_observed("expected_bias_log")
    rows = rows.select(
        *yk,
        *[F.bround(c, 2).alias(c) for c in (*VARIANTS, "lower", "upper")],
        F.bround(low, 2).alias("sensitivity_low"),
        F.bround(high, 2).alias("sensitivity_high"),
        F.bround(100 * (high - low) / F.col("clamped"), 0).alias("sensitivity_span_pct"),
        C.bias_direction("expected_bias_log").alias("bias_expectation"),
        F.bround(F.col("clamped") / ratio, 2).alias("if_corrected"),
    )
    kept = support.select(
        *yk, "n_months", "support", "n_months_outside_range", "pct_months_outside", "covariates_outside", "joint_distance_max"
    )
    return key_join(kept, rows, yk)


