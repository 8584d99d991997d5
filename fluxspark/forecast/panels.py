"""Tables behind the comparison of forecasts: ranges, agreement, screening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.forecast.scoring import diebold_mariano, predictor_frequency, restrict, shared_targets
from fluxspark.functions.columns import annual_lag
from fluxspark.operators.common import Keys, attach, by, key_join
from fluxspark.operators.stats import correlation_p

BENCH = "benchmarks"


def _shared(frame: DataFrame, keys: Keys) -> DataFrame:
    return restrict(frame, shared_targets(frame, keys), keys)


def forecast_panel(
    frame: DataFrame,
    benchmarks: Sequence[str] = ("seasonal naive", "naive", "climatology", "seasonal naive with drift"),
    reference: str = "climatology",
    keys: Keys = (),
) -> DataFrame:
    """Per horizon, on shared months: each benchmark's error, the fitted range, and the margin that matters."""
    hk = [*keys, "horizon"]
    rows = _shared(frame, keys)
    errors = rows.groupBy(*hk, "family", "method", "target").agg(F.avg("error").alias("error"))
    mae = errors.groupBy(*hk, "family", "method").agg(F.avg(F.abs("error")).alias("m"))
    is_fit = F.col("family") != BENCH
    bench = lambda b: F.max(F.when(~is_fit & (F.col("method") == b), F.col("m"))).alias(b.replace(" ", "_"))
    table = mae.groupBy(*hk).agg(
        F.min(F.when(is_fit, F.col("m"))).alias("fitted_low"),
        F.max(F.when(is_fit, F.col("m"))).alias("fitted_high"),
        F.min(F.when(is_fit, F.struct("m", "family", "method"))).alias("__b"),
        *[bench(b) for b in benchmarks],
    )
    chosen = table.select(*hk, "__b.family", "__b.method")
    left = key_join(errors, chosen, [*hk, "family", "method"], "left_semi").select(*hk, "target", F.col("error").alias("left"))
    right = errors.filter(~is_fit & (F.col("method") == reference)).select(*hk, "target", F.col("error").alias("right"))
    tests = diebold_mariano(left.join(right, [*hk, "target"], "full_outer"), keys=keys)
    return attach(table.drop("__b"), tests.select(*hk, "n", "effective_n", "margin"), hk)


def flux_panel(observed: DataFrame, frame: DataFrame, horizon: int = 1, keys: Keys = ()) -> DataFrame:
    """The whole observed series with climatology and the fitted range where forecasts exist."""
    rows = _shared(frame, keys).filter(F.col("horizon") == horizon)
    is_fit = F.col("family") != BENCH
    per = rows.groupBy(*keys, F.col("target").alias("month")).agg(
        F.max(F.when(~is_fit & (F.col("method") == "climatology"), F.col("forecast"))).alias("climatology"),
        F.min(F.when(is_fit, F.col("forecast"))).alias("fitted_low"),
        F.max(F.when(is_fit, F.col("forecast"))).alias("fitted_high"),
    )
    return key_join(observed, per, [*keys, "month"])


def screening_panel(
    frame: DataFrame, covariates: Sequence[str], horizons: Sequence[int] = K.HORIZONS, keys: Keys = ()
) -> DataFrame:
    """Share of folds each driver survived, per horizon, a covariate by its best lag.

    Never kept is a measured zero. The one-month flux lag only exists at horizon one and is null elsewhere.
    """
    freq = predictor_frequency(frame, keys)
    name, lag = F.regexp_extract("predictor", r"^(.*)_lag\d+$", 1), F.regexp_extract("predictor", r"_lag(\d+)$", 1)
    yearly = F.create_map(*[F.lit(x) for h in horizons for x in (h, f"{annual_lag(h)}")])[F.col("horizon")]
    driver = (
        F.when((name == "flux") & (lag == "1") & (F.col("horizon") == 1), "flux, one month")
        .when((name == "flux") & (lag == yearly), "flux, one year")
        .when(name.isin(*covariates), name)
    )
    best = freq.withColumn("driver", driver).filter("driver is not null").groupBy(*keys, "driver", "horizon").agg(
        F.max("share").alias("share")
    )
    names = ["flux, one month", "flux, one year", *covariates]
    entities = frame.select(*keys, "horizon").filter(F.col("horizon").isin(*horizons)).distinct()
    every = entities.withColumn("driver", F.explode(F.array(*[F.lit(c) for c in names])))
    share = F.when((F.col("driver") == "flux, one month") & (F.col("horizon") != 1), F.lit(None).cast("double")).otherwise(
        F.coalesce("share", F.lit(0.0))
    )
    return key_join(every, best, [*keys, "driver", "horizon"]).select(*keys, "driver", "horizon", share.alias("share"))


def with_calendar_share(panel: DataFrame, explained: DataFrame, keys: Keys = ()) -> DataFrame:
    """The panel with what the calendar alone explains of each covariate (``covariate``, ``explained``); null beside the flux lags."""
    shares = explained.select(*keys, F.col("covariate").alias("driver"), F.col("explained").alias("calendar_share"))
    return key_join(panel, shares, [*keys, "driver"])


def usage_order(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """Drivers by mean use over everything, most used first; per key where keys are given."""
    means = panel.groupBy(*keys, "driver").agg(F.avg("share").alias("mean_share"))
    return means.withColumn("rank", F.row_number().over(by(*keys).orderBy(F.desc("mean_share"), "driver")))


def agreement_panel(frame: DataFrame, horizon: int = 1, keys: Keys = ()) -> DataFrame:
    """Each month's measurement with the lowest, middle and highest of all fitted methods, and the season."""
    rows = _shared(frame, keys).filter(F.col("horizon") == horizon)
    is_fit = F.col("family") != BENCH
    # A family and a method make one forecaster; its rows for a month average first.
    each = rows.groupBy(*keys, "target", "family", "method").agg(
        F.avg("forecast").alias("forecast"), F.max("actual").alias("actual")
    )
    fit = F.when(is_fit, F.col("forecast"))
    return each.groupBy(*keys, "target").agg(
        F.max(F.when(is_fit, F.col("actual"))).alias("measured"),
        F.min(fit).alias("lowest"),
        F.max(fit).alias("highest"),
        F.percentile(fit, F.lit(0.5)).alias("middle"),
        F.max(F.when(~is_fit & (F.col("method") == "climatology"), F.col("forecast"))).alias("seasonal"),
    )


def agreement_errors(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """The panel as measured less predicted, so the ends of the range swap."""
    m = F.col("measured")
    return panel.select(
        *keys, "target", "measured",
        (m - F.col("highest")).alias("lowest"),
        (m - F.col("lowest")).alias("highest"),
        (m - F.col("middle")).alias("middle"),
        (m - F.col("seasonal")).alias("seasonal"),
    )


def agreement_summary(panel: DataFrame, keys: Keys = ()) -> DataFrame:
    """Bracketing share, agreement of the error's side, and tilt of the middle error."""
    m = F.col("measured")
    mid, sea = F.col("middle") - m, F.col("seasonal") - m
    stats = panel.groupBy(*keys).agg(
        F.count("*").alias("months"),
        F.avg(m.between(F.col("lowest"), F.col("highest")).cast("int")).alias("brackets"),
        F.avg((F.signum(mid) == F.signum(sea)).cast("int")).alias("same_way"),
        F.regr_slope(-mid, m).alias("tilt"),
        F.corr(-mid, m).alias("__r"),
    )
    return stats.withColumn("tilt_p", correlation_p(F.col("__r"), F.col("months"))).drop("__r")


def _misses(frame: DataFrame, horizon: int, keys: Keys) -> DataFrame:
    """Fitted forecasts of the shared months with their miss and the size third of their month.

    Thirds are cut on distinct months; edges are right-closed.
    """
    rows = _shared(frame, keys).filter((F.col("horizon") == horizon) & (F.col("family") != BENCH))
    months = rows.groupBy(*keys, "target").agg(F.max(F.abs("actual")).alias("__size"))
    edges = months.groupBy(*keys).agg(F.percentile("__size", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("__e"))
    size = F.abs("actual")
    third = F.when(size <= F.col("__e")[0], 1).when(size <= F.col("__e")[1], 2).otherwise(3)
    return attach(rows, edges, keys).select(
        *keys, "target", third.alias("third"), size.alias("size"), F.abs(F.col("forecast") - F.col("actual")).alias("miss")
    )


def miss_by_size(frame: DataFrame, horizon: int = 1, keys: Keys = ()) -> DataFrame:
    """Mean and relative miss of all fitted methods by thirds of the month's size."""
    return _misses(frame, horizon, keys).groupBy(*keys, "third").agg(
        F.count("*").alias("n"),
        F.avg("miss").alias("mean_miss"),
        F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("root_mean_square"),
        F.avg(F.try_divide("miss", "size")).alias("relative_miss"),
    )


def size_matched_year_ratio(frame: DataFrame, horizon: int = 1, keys: Keys = ()) -> DataFrame:
    """Each year's miss over what months of its sizes are missed by on the whole record."""
    rows = _misses(frame, horizon, keys)
    typical = rows.groupBy(*keys, "third").agg(F.avg("miss").alias("__t"))
    return (
        attach(rows, typical, [*keys, "third"])
        .groupBy(*keys, F.year("target").alias("year"))
        .agg(F.avg("miss").alias("mean_miss"), F.try_divide(F.avg("miss"), F.avg("__t")).alias("ratio"))
    )
