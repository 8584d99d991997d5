"""Scores, comparable month sets, and significance of forecast differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.forecast.rolling import rolling_forecasts
from fluxspark.functions import tails
from fluxspark.operators.common import Keys, attach, by, exact_quantiles, key_join

SCORED = ("actual", "forecast", "mase_scale")


def usable(frame: DataFrame, columns: Sequence[str] = SCORED) -> DataFrame:
    return frame.dropna(subset=list(columns))


def shared_targets(frame: DataFrame, keys: Keys = ()) -> DataFrame:
    """(horizon, target) pairs that every method of every family scored.

    ``frame`` stacks the families under a ``family`` column.
    """
    names = F.concat_ws("/", "family", "method")
    rows = usable(frame)
    total = rows.groupBy(*keys).agg(
        F.count_distinct(names).alias("__all"), F.count_distinct("family").alias("__families")
    )
    asked = frame.groupBy(*keys).agg(F.count_distinct("family").alias("__asked"))
    per = rows.groupBy(*keys, "horizon", "target").agg(F.count_distinct(names).alias("__n"))
    return (
        attach(attach(per, total, keys), asked, keys)
        .filter((F.col("__n") == F.col("__all")) & (F.col("__families") == F.col("__asked")))
        .select(*keys, "horizon", "target")
    )


def restrict(frame: DataFrame, targets: DataFrame, keys: Keys = ()) -> DataFrame:
    return key_join(frame, targets, [*keys, "horizon", "target"], "left_semi")


def score_columns() -> list[Column]:
    q = lambda p: F.percentile("scaled", F.lit(p))
    return [
        F.count("*").alias("n"),
        F.avg("scaled").alias("mase"),
        q(0.5).alias("mase_median"),
        q(0.25).alias("mase_q25"),
        q(0.75).alias("mase_q75"),
        F.avg(F.abs("error")).alias("mae"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg((F.col("scaled") < 1).cast("int")).alias("share_beating_snaive"),
    ]


def score(frame: DataFrame, keys: Keys = (), pooled: bool = False) -> DataFrame:
    """Error measures per method and horizon, over the rows that could be scored.

    With the series among the keys a group is one series' origins. ``pooled`` scores any number of
    series together and takes the quantiles from exact order statistics instead of one task's list.
    """
    gk = [*keys, "method", "horizon"]
    rows = usable(frame)
    if not pooled:
        return rows.groupBy(*gk).agg(*score_columns())
    plain = [c for c in score_columns() if "percentile" not in str(c)]
    probs = {"mase_median": 0.5, "mase_q25": 0.25, "mase_q75": 0.75}
    return attach(rows.groupBy(*gk).agg(*plain), exact_quantiles(rows, "scaled", probs, gk), gk)


def relative_to(
    frame: DataFrame, methods: Sequence[str], reference: str = "seasonal naive", keys: Keys = ()
) -> DataFrame:
    """Mean absolute error of each method over the reference's, per horizon, one column per method."""
    rows = usable(frame, ("actual", "forecast"))
    mae = lambda m: F.avg(F.when(F.col("method") == m, F.abs("error")))
    return rows.groupBy(*keys, "horizon").agg(*[F.try_divide(mae(m), mae(reference)).alias(m.replace(" ", "_")) for m in methods])


def origin_summary(frame: DataFrame, keys: Keys = ()) -> DataFrame:
    ok = F.col("actual").isNotNull() & F.col("forecast").isNotNull() & F.col("mase_scale").isNotNull()
    return frame.groupBy(*keys).agg(
        F.count_distinct(F.when(ok, F.col("origin"))).alias("origins"),
        F.count_distinct(F.when(ok, F.col("target"))).alias("distinct_targets"),
        F.count_if(ok).alias("scored_forecasts"),
        F.count_if(F.col("actual").isNull()).alias("dropped_target_not_observed"),
    )


def per_origin(frame: DataFrame, horizon: int, methods: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Scaled error by origin, one column per method."""
    rows = frame.filter((F.col("horizon") == horizon) & F.col("scaled").isNotNull())
    return rows.groupBy(*keys, "origin").agg(
        *[F.avg(F.when(F.col("method") == m, F.col("scaled"))).alias(m.replace(" ", "_")) for m in methods]
    )


def errors_at(frame: DataFrame, horizon: int, columns: Sequence[tuple[str, str]], keys: Keys = ()) -> DataFrame:
    """Signed error by target month, one column per (family, method)."""
    pick = lambda f, m: F.avg(F.when((F.col("family") == f) & (F.col("method") == m), F.col("error")))
    name = lambda f, m: f"{f[:4]}/{m}".replace(" ", "_")
    return (
        frame.filter(F.col("horizon") == horizon)
        .groupBy(*keys, "target")
        .agg(*[pick(f, m).alias(name(f, m)) for f, m in columns])
    )


def diebold_mariano(
    pairs: DataFrame,
    left: str = "left",
    right: str = "right",
    horizon: str = "horizon",
    power: int = 1,
    alpha: float = 0.05,
    keys: Keys = (),
) -> DataFrame:
    """Whether the left errors are smaller than the right ones, with overlap accounted for.

    ``pairs`` holds one row per target month and pair. The loss differentials of a pair are one array of
    months in order; its Bartlett variance is array arithmetic in the row. The margin is the
    difference in mean loss that would reach ``alpha``. Below eight months all of it is null.
    """
    both = pairs.dropna(subset=[left, right])
    loss = F.pow(F.abs(left), F.lit(power)) - F.pow(F.abs(right), F.lit(power))
    months = both.groupBy(*keys, horizon).agg(
        F.count("*").alias("n"), F.avg(loss).alias("mean_difference"),
        F.transform(F.array_sort(F.collect_list(F.struct("target", loss.alias("d")))), lambda s: s["d"]).alias("__d"),
    )
    n, h = F.col("n"), F.col(horizon)
    lag = F.greatest(h - 1, F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("int"))
    ok = n >= 8
    rows = months.withColumn("lag", F.when(ok, lag)).withColumn(
        "__c", F.transform("__d", lambda d: d - F.col("mean_difference"))
    )
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    at_lag = lambda k: dot(F.slice("__c", k + 1, n.cast("int") - k), F.slice("__c", 1, n.cast("int") - k)) / n
    gamma0 = dot(F.col("__c"), F.col("__c")) / n
    weighted = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("lag"), n.cast("int") - 1)),
        gamma0,
        lambda s, k: s + 2 * (1 - k / (F.col("lag") + 1)) * at_lag(k),
    )
    total = F.when(F.col("lag") >= 1, weighted).otherwise(gamma0)
    rows = rows.withColumn("__g", F.when(ok, gamma0)).withColumn("__v", F.when(ok, F.greatest(total, F.lit(1e-12))))
    correction = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(1e-12)))
    error = F.sqrt(F.col("__v") / n)
    out = rows.withColumn("statistic", F.col("mean_difference") / error * correction).withColumn("__e", error / correction)
    df = (n - 1).cast("double")
    return out.select(
        *keys,
        horizon,
        "n",
        "lag",
        "statistic",
        tails.t_p_value("statistic", df).alias("p"),
        F.when(F.col("__g") > 0, n * F.col("__g") / F.col("__v")).alias("effective_n"),
        F.when(ok, F.col("mean_difference")).alias("mean_difference"),
        (tails.t_quantile_two_sided(F.when(ok, F.lit(alpha)), df) * F.col("__e")).alias("margin"),
    )


def significance_margin(pairs: DataFrame, alpha: float = 0.05, keys: Keys = (), **names) -> DataFrame:
    return diebold_mariano(pairs, alpha=alpha, keys=keys, **names).select(*keys, "horizon", "n", "margin")


def predictor_frequency(frame: DataFrame, keys: Keys = ()) -> DataFrame:
    """Share of folds that kept each predictor, per horizon."""
    folds = frame.select(*keys, "horizon", "origin", "predictors").dropDuplicates([*keys, "horizon", "origin"])
    total = folds.groupBy(*keys, "horizon").agg(F.count("*").alias("__t"))
    kept = folds.select(*keys, "horizon", F.explode("predictors").alias("predictor"))
    counts = kept.groupBy(*keys, "horizon", "predictor").agg(F.count("*").alias("folds"))
    return key_join(counts, total, [*keys, "horizon"]).select(
        *keys, "horizon", "predictor", "folds", F.bround(F.col("folds") / F.col("__t"), 3).alias("share")
    )


def survival_table(frequency: DataFrame, horizons: Sequence[int] = K.HORIZONS, keys: Keys = ()) -> DataFrame:
    """Predictor by horizon; a predictor a horizon never kept is zero there."""
    at = lambda h: F.coalesce(F.max(F.when(F.col("horizon") == h, F.col("share"))), F.lit(0.0))
    return frequency.groupBy(*keys, "predictor").agg(*[at(h).alias(f"h{h}") for h in horizons])


def survivors_worth_testing(
    survival: DataFrame, covariates: Sequence[str], threshold: float = 0.25, horizons: Sequence[int] = K.HORIZONS
) -> DataFrame:
    name = F.regexp_extract("predictor", r"^(.*)_lag\d+$", 1)
    best = F.greatest(*[f"h{h}" for h in horizons]) if len(horizons) > 1 else F.col(f"h{horizons[0]}")
    return survival.filter(name.isin(*covariates) & (best >= threshold))


def best_method(scores: DataFrame, measure: str = "mase", keys: Keys = ()) -> DataFrame:
    """Best method per horizon; ties go to the first name."""
    return scores.groupBy(*keys, "horizon").agg(
        F.min(F.struct(F.col(measure).alias("v"), F.col("method"))).alias("b")
    ).select(*keys, "horizon", F.col("b.method").alias("method"), F.col("b.v").alias(measure))


def error_by_year(frame: DataFrame, method: str = "climatology", keys: Keys = ()) -> DataFrame:
    """One method's scaled error by target year, and its share of the total."""
    rows = frame.filter((F.col("method") == method) & F.col("scaled").isNotNull())
    years = rows.groupBy(*keys, F.year("target").alias("year")).agg(
        F.count("*").alias("n"),
        F.avg("scaled").alias("mean"),
        F.percentile("scaled", F.lit(0.5)).alias("median"),
        F.max("scaled").alias("max"),
        F.avg((F.col("scaled") > 1).cast("int")).alias("share_above_1"),
        F.sum("scaled").alias("__s"),
    )
    share = F.try_divide(100 * F.col("__s"), F.sum("__s").over(by(*keys)))
    return years.withColumn("share_of_total_error", share).drop("__s")


def worst_years(by_year: DataFrame, n: int = 2, keys: Keys = ()) -> DataFrame:
    """What the worst years carry: share of the error on what share of the forecasts."""
    ranked = by_year.withColumn("__r", F.row_number().over(by(*keys).orderBy(F.desc("share_of_total_error"), "year")))
    top = F.col("__r") <= n
    return ranked.groupBy(*keys).agg(
        F.sum(F.when(top, F.col("share_of_total_error"))).alias("error_share_pct"),
        (100 * F.sum(F.when(top, F.col("n"))) / F.sum("n")).alias("forecast_share_pct"),
    )


def scale_comparability(frame: DataFrame, method: str = "seasonal naive", keys: Keys = ()) -> DataFrame:
    """Whether the training scale is as hard as the months scored."""
    scales = frame.filter("mase_scale is not null").groupBy(*keys, "origin").agg(F.max("mase_scale").alias("s"))
    stats = scales.groupBy(*keys).agg(
        F.avg("s").alias("scale_mean"), F.min_by("s", "origin").alias("scale_first"), F.max_by("s", "origin").alias("scale_last")
    )
    scored = usable(frame, ("actual", "forecast")).filter(F.col("method") == method)
    out = attach(stats, scored.groupBy(*keys).agg(F.avg(F.abs("error")).alias("out_of_sample_mae")), keys)
    return out.withColumn("ratio", F.try_divide("out_of_sample_mae", "scale_mean"))


def min_train_sensitivity(
    series: DataFrame,
    minimums: Sequence[int] = (36, 48, 60, 72),
    horizons: Sequence[int] = K.HORIZONS,
    keys: Keys = (),
) -> DataFrame:
    """Origins, targets and the climatology ratio under several minimum training windows, from one forecast table."""
    base = rolling_forecasts(series, min_train=min(minimums), horizons=horizons, keys=keys)
    spread = base.withColumn(
        "min_train", F.explode(F.array_compact(F.array(*[F.when(F.col("train_n") >= m, m) for m in minimums])))
    )
    mk = [*keys, "min_train"]
    first = spread.groupBy(*mk).agg(
        F.min(F.when(F.col("actual").isNotNull(), F.col("target"))).alias("first_scored"),
        (F.min("train_n") / K.PERIOD).alias("obs_per_month"),
    )
    mae = lambda m, h: F.avg(F.when((F.col("method") == m) & (F.col("horizon") == h), F.abs("error")))
    ratios = usable(spread, ("actual", "forecast")).groupBy(*mk).agg(
        *[F.try_divide(mae("climatology", h), mae("seasonal naive", h)).alias(f"ratio_h{h}") for h in horizons]
    )
    return attach(attach(origin_summary(spread, mk), first, mk), ratios, mk)


def savings_by_year(
    frame: DataFrame, family: str, method: str, reference=("benchmarks", "climatology"), horizon: int = 1, keys: Keys = ()
) -> DataFrame:
    """Absolute error one method saves against the reference, per target year."""
    wide = errors_at(frame, horizon, [reference, (family, method)], keys)
    r, m = [c for c in wide.columns if c not in (*keys, "target")]
    saved = F.abs(F.col(f"`{r}`")) - F.abs(F.col(f"`{m}`"))
    return wide.groupBy(*keys, F.year("target").alias("year")).agg(
        F.count(saved).alias("months"), F.sum(saved).alias("saved"), F.avg(saved).alias("per_month")
    )


def savings_with_without(
    frame: DataFrame, family: str, method: str, year: int, reference=("benchmarks", "climatology"), horizon: int = 1, keys: Keys = ()
) -> DataFrame:
    """The same saving over all months, without one year, and in it alone, with its significance."""
    wide = errors_at(frame, horizon, [reference, (family, method)], keys)
    r, m = [c for c in wide.columns if c not in (*keys, "target")]
    rows = wide.select(*keys, "target", F.col(f"`{m}`").alias("left"), F.col(f"`{r}`").alias("right"), F.lit(horizon).alias("horizon"))
    inside = F.year("target") == year
    sets = F.array_compact(F.array(F.lit("all"), F.when(~inside, "without"), F.when(inside, "only")))
    rows = rows.withColumn("months", F.explode(sets))
    mk = [*keys, "months"]
    saved = rows.groupBy(*mk).agg(F.sum(F.abs("right") - F.abs("left")).alias("saved"))
    return attach(diebold_mariano(rows, keys=mk).drop("margin"), saved, mk)


def savings_per_method(frame: DataFrame, year: int, reference=("benchmarks", "climatology"), horizon: int = 1, keys: Keys = ()) -> DataFrame:
    """What every method saved against the reference in one year."""
    rows = frame.filter((F.col("horizon") == horizon) & (F.year("target") == year))
    is_ref = (F.col("family") == reference[0]) & (F.col("method") == reference[1])
    loss = rows.groupBy(*keys, "family", "method").agg(F.sum(F.abs("error")).alias("__l"), F.max(is_ref).alias("__ref"))
    ref = F.max(F.when(F.col("__ref"), F.col("__l"))).over(by(*keys))
    return loss.withColumn("saved", ref - F.col("__l")).filter(~F.col("__ref")).select(*keys, "family", "method", "saved")


def best_against_reference(
    frame: DataFrame, reference=("benchmarks", "climatology"), keys: Keys = ()
) -> DataFrame:
    """Best fitted method against the reference per horizon: significance and sign test."""
    hk = [*keys, "horizon"]
    errors = frame.groupBy(*hk, "family", "method", "target").agg(F.avg("error").alias("error"))
    ref = errors.filter((F.col("family") == reference[0]) & (F.col("method") == reference[1])).select(
        *hk, "target", F.col("error").alias("right")
    )
    fitted = errors.filter(F.col("family") != reference[0])
    mae = fitted.groupBy(*hk, "family", "method").agg(F.avg(F.abs("error")).alias("m"))
    best = mae.groupBy(*hk).agg(F.min(F.struct("m", "family", "method")).alias("b")).select(*hk, "b.family", "b.method")
    chosen = key_join(fitted, best, [*hk, "family", "method"], "left_semi").withColumnRenamed("error", "left")
    pairs = ref.join(chosen.select(*hk, "target", "left"), [*hk, "target"], "full_outer")
    wins = pairs.groupBy(*hk).agg(
        F.count_if(F.abs("right") > F.abs("left")).alias("wins"), F.count("*").alias("n_months")
    )
    out = attach(attach(diebold_mariano(pairs, keys=keys), best, hk), wins, hk)
    return out.withColumn("sign_test_p", tails.sign_test_p_value(F.col("wins"), F.col("n_months")))


def group_contrast(
    frame: DataFrame, groups: dict[str, str], left: str, right: str, keys: Keys = ()
) -> DataFrame:
    """Mean absolute error of one group of methods against another's, per family and horizon."""
    label = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("method")]
    gk = [*keys, "family", "horizon"]
    per = frame.withColumn("group", label).groupBy(*gk, "target", "group").agg(F.avg(F.abs("error")).alias("e"))
    pick = lambda g: F.max(F.when(F.col("group") == g, F.col("e")))
    pairs = per.groupBy(*gk, "target").agg(pick(left).alias("left"), pick(right).alias("right"))
    return diebold_mariano(pairs, keys=[*keys, "family"])


def leaderboard(frame: DataFrame, benchmark: str = "benchmarks", keys: Keys = ()) -> DataFrame:
    """Every family's methods on their shared months, against the best benchmark of the horizon."""
    shared = restrict(frame, shared_targets(frame, keys), keys)
    rows = usable(shared).groupBy(*keys, "family", "method", "horizon").agg(*score_columns())
    best = F.min(F.when(F.col("family") == benchmark, F.col("mase"))).over(by(*keys, "horizon"))
    return rows.withColumn("vs_best_benchmark", F.bround(F.try_divide(F.col("mase"), best), 3))
