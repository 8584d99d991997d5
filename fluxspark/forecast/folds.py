"""Designs of direct forecasts and their folds, with every fold's season learned inside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.forecast.rolling import forecast_origins, lag_months, origin_state
from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, by, key_join


def seasonal_adjustment(train: DataFrame, value: str = "value", keys: Keys = ()) -> DataFrame:
    """Month-of-year means of a training window, absent calendar months falling back to the overall mean.

    One row per key: ``means``, an array of twelve, January first.
    """
    v = F.col(value)
    mean = lambda m: F.coalesce(F.avg(F.when(F.month("month") == m, v)), F.avg(v))
    return train.groupBy(*keys).agg(F.array(*[mean(m) for m in range(1, 13)]).alias("means"))


def apply_adjustment(
    df: DataFrame, adjustment: DataFrame, value: str = "value", inverse: bool = False, keys: Keys = (), month: str = "month"
) -> DataFrame:
    """Take the seasonal level off a column, or put it back."""
    from fluxspark.operators.common import attach

    level = F.element_at("means", F.month(month))
    out = attach(df, adjustment, keys)
    return out.withColumn(value, F.col(value) + level if inverse else F.col(value) - level).drop("means")


def design_names(horizon: int, covariates: Sequence[str] = (), recent=K.RECENT_LAGS, covariate_lags=K.COVARIATE_LAGS) -> list[str]:
    """Predictor names of a horizon, in design order; every lag is at least the horizon."""
    return [
        *K.SEASONAL_TERMS,
        *[f"flux_lag{k}" for k in C.flux_lags(horizon, recent)],
        *[f"{c}_lag{k}" for c in covariates for k in C.horizon_lags(covariate_lags, horizon)],
    ]


def build_design(
    grid: DataFrame, horizon: int, covariates: Sequence[str] = (), value: str = "value", keys: Keys = ()
) -> DataFrame:
    """Predictors beside each grid month: calendar terms, flux lags, covariate lags."""
    rows = grid.withColumns(C.seasonal_terms("month"))
    rows = lag_months(rows, [value], C.flux_lags(horizon), keys, {value: "flux"})
    return lag_months(rows, covariates, C.horizon_lags(K.COVARIATE_LAGS, horizon), keys) if covariates else rows


def fold_rows(
    grid: DataFrame,
    horizon: int,
    covariates: Sequence[str] = (),
    min_train: int = K.MIN_TRAIN,
    horizons: Sequence[int] = K.HORIZONS,
    value: str = "value",
    keys: Keys = (),
) -> DataFrame:
    """All folds of one horizon: (keys, origin, month, is_test, y, x, level, train_n, mase_scale).

    A fold holds its training months up to the origin and its one test month, all complete, at least
    MIN_FOLD_ROWS of the former. Flux and flux lags carry the season of the fold's own window: twelve
    means known at the origin, which are the last twelve running means of the grid. The expansion
    is months times origins of one series, both bounded by the calendar.
    """
    order = by(*keys).orderBy("month")
    state = origin_state(grid, value, keys=keys)
    # Element k is the mean of the calendar month k months before the origin.
    level = F.array(*[F.coalesce(F.lag("same_month_mean", k).over(order), F.col("overall_mean")) for k in range(12)])
    origins = forecast_origins(state.withColumn("__level", level), min_train, horizons, keys).select(
        *keys, F.col("month").alias("origin"), "__level", "train_n", "mase_scale"
    )
    names = design_names(horizon, covariates)
    base = build_design(grid, horizon, covariates, value, keys)
    folds = origins.groupBy(*keys).agg(F.collect_list(F.struct("origin", "__level", "train_n", "mase_scale")).alias("__o"))
    if keys:
        met = key_join(base, folds, keys, "inner")
    else:
        from fluxspark.operators.common import attach

        met = attach(base, folds)
    target = lambda o: F.add_months(o["origin"], horizon)
    wanted = F.filter("__o", lambda o: (F.col("month") <= o["origin"]) | (F.col("month") == target(o)))
    rows = met.withColumn("__f", F.explode(wanted)).drop("__o").select("*", "__f.*").drop("__f")
    back = lambda k: F.col("__level")[
        F.pmod(F.month("origin") - F.month("month") + k, F.lit(12)).cast("int")
    ]
    lags = set(C.flux_lags(horizon))
    x = [
        F.col(c) - back(int(c.removeprefix("flux_lag"))) if c.startswith("flux_lag") and int(c.removeprefix("flux_lag")) in lags else F.col(c)
        for c in names
    ]
    rows = rows.select(
        *keys,
        "origin",
        "month",
        (F.col("month") > F.col("origin")).alias("is_test"),
        (F.col(value) - back(0)).alias("y"),
        F.array(*[e.cast("double") for e in x]).alias("x"),
        back(0).alias("level"),
        F.col(value).alias("actual"),
        "train_n",
        "mase_scale",
    ).filter(~F.exists("x", lambda e: e.isNull()) & (F.col("is_test") | F.col("y").isNotNull()))
    fold = by(*keys, "origin")
    n = F.count_if(~F.col("is_test")).over(fold)
    tests = F.count_if("is_test").over(fold)
    counted = rows.withColumn("n_rows", n).withColumn("__tests", tests)
    return counted.filter((F.col("n_rows") >= K.MIN_FOLD_ROWS) & (F.col("__tests") == 1)).drop("__tests")
