"""Rolling-origin benchmarks on gapless month grids, from running windows.

Everything a benchmark knows at an origin is a running value of the grid, and everything it is asked about
is a fixed number of rows ahead. So the forecasts of all origins come from one ordered pass per
series, without joins and without expanding any window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark import constants as K
from fluxspark.functions.columns import annual_lag
from fluxspark.operators.common import Keys, by


def lag_months(df: DataFrame, columns: Sequence[str], lags: Sequence[int], keys: Keys = (), names=None) -> DataFrame:
    """Calendar lags: ``df`` is a gapless grid, so k rows back is k months back."""
    order = by(*keys).orderBy("month")
    names = names or {c: c for c in columns}
    return df.select("*", *[F.lag(c, k).over(order).alias(f"{names[c]}_lag{k}") for c in columns for k in lags])


def lag_rows(df: DataFrame, column: str, k: int, alias: str, keys: Keys = ()) -> DataFrame:
    """Positional lag: the k-th observed value before, whatever the time between."""
    part = ", ".join(f"`{c}`" for c in keys) or "0"
    lagged = F.expr(f"lag(`{column}`, {k}) ignore nulls over (partition by {part} order by month)")
    return df.withColumn(alias, F.when(F.col(column).isNotNull(), lagged))


def origin_state(series: DataFrame, value: str = "value", period: int = K.PERIOD, keys: Keys = ()) -> DataFrame:
    """What is known at the end of each grid month.

    train_n, last_value, the running mean of the positional yearly difference (``drift``), the scale of the
    scaled error, and per calendar month the last value and the mean so far.
    """
    v = F.col(value)
    so_far = by(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    same_month = by(*keys, "__moy").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = lag_rows(series, value, period, "__back", keys).withColumn("__moy", F.month("month"))
    d = v - F.col("__back")
    scale, size = F.avg(F.abs(d)).over(so_far), F.avg(F.abs(v)).over(so_far)
    return rows.select(
        *keys,
        "month",
        v.alias("value"),
        F.count(v).over(so_far).alias("train_n"),
        F.last(v, ignorenulls=True).over(so_far).alias("last_value"),
        F.avg(v).over(so_far).alias("overall_mean"),
        F.coalesce(F.avg(d).over(so_far) / period, F.lit(0.0)).alias("drift"),
        F.when(scale > 1e-10 * F.greatest(size, F.lit(1.0)), scale).alias("mase_scale"),
        F.last(v, ignorenulls=True).over(same_month).alias("same_month_last"),
        F.avg(v).over(same_month).alias("same_month_mean"),
    )


def forecast_origins(
    state: DataFrame, min_train: int = K.MIN_TRAIN, horizons: Sequence[int] = K.HORIZONS, keys: Keys = ()
) -> DataFrame:
    """Months with enough observations behind them and at least one target on the record."""
    last = F.max("month").over(by(*keys))
    return state.withColumn("__last", last).filter(
        (F.col("train_n") >= min_train) & (F.add_months("month", min(horizons)) <= F.col("__last"))
    ).drop("__last")


# Each benchmark: horizon -> forecast column. Same-month columns are already shifted to the target's
# calendar month (see rolling_forecasts).
BENCHMARKS: dict[str, Callable[[int], Column]] = {
    "seasonal naive": lambda h: F.col(f"__sn{h}"),
    "naive": lambda h: F.col("last_value"),
    "climatology": lambda h: F.col(f"__cl{h}"),
    "seasonal naive with drift": lambda h: F.col(f"__sn{h}") + F.col("drift") * h,
}


def rolling_forecasts(
    series: DataFrame,
    methods: dict[str, Callable[[int], Column]] | None = None,
    min_train: int = K.MIN_TRAIN,
    horizons: Sequence[int] = K.HORIZONS,
    value: str = "value",
    period: int = K.PERIOD,
    keys: Keys = (),
) -> DataFrame:
    """One row per origin, method and horizon, with target, actual and errors.

    The newest month at or before the origin that shares the target's calendar month lies
    annual_lag(h) - h rows back.
    """
    methods = methods or BENCHMARKS
    order = by(*keys).orderBy("month")
    state = origin_state(series, value, period, keys)
    ahead = state.select(
        "*",
        *[F.lag("same_month_last", annual_lag(h, period) - h).over(order).alias(f"__sn{h}") for h in horizons],
        *[F.lag("same_month_mean", annual_lag(h, period) - h).over(order).alias(f"__cl{h}") for h in horizons],
        *[F.lead("value", h).over(order).alias(f"__y{h}") for h in horizons],
    )
    origins = forecast_origins(ahead, min_train, horizons, keys)
    row = lambda name, f, h: F.struct(
        F.lit(name).alias("method"),
        F.lit(h).alias("horizon"),
        F.add_months("month", h).alias("target"),
        f(h).cast("double").alias("forecast"),
        F.col(f"__y{h}").alias("actual"),
    )
    rows = F.explode(F.array(*[row(name, f, h) for name, f in methods.items() for h in horizons]))
    out = origins.select(*keys, F.col("month").alias("origin"), rows.alias("r"), "train_n", "mase_scale")
    return with_errors(out.select(*keys, "origin", "r.*", "train_n", "mase_scale"))


def with_errors(forecasts: DataFrame) -> DataFrame:
    e = F.col("actual") - F.col("forecast")
    return forecasts.withColumn("error", e).withColumn("scaled", F.try_divide(F.abs(e), F.col("mase_scale")))


def rolling_custom(
    series: DataFrame,
    methods: dict[str, Callable[[pd.Series, Sequence[int]], Sequence[float]]],
    min_train: int = K.MIN_TRAIN,
    horizons: Sequence[int] = K.HORIZONS,
    value: str = "value",
    period: int = K.PERIOD,
    keys: Keys = (),
) -> DataFrame:
    """The same table for methods written in pandas: f(training window, horizons) -> one value per horizon.

    A task holds one series' months, which the calendar bounds; series run in parallel.
    """
    state = origin_state(series, value, period, keys)
    order = by(*keys).orderBy("month")
    leads = state.select("*", *[F.lead("value", h).over(order).alias(f"__y{h}") for h in horizons])
    chosen = forecast_origins(leads, min_train, horizons, keys).select(*keys, "month").withColumn("__o", F.lit(True))
    rows = leads.join(chosen, [*keys, "month"], "left").fillna({"__o": False})
    group = list(keys) or ["__all"]
    rows = rows if keys else rows.withColumn("__all", F.lit(0))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*group).schema.fields)
    schema = f"{kinds}, origin date, method string, horizon int, forecast double, actual double, train_n bigint, mase_scale double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        values = pd.Series(pdf["value"].to_numpy(dtype=float), index=pd.PeriodIndex(pd.to_datetime(pdf["month"]), freq="M"))
        head, out = [pdf[k].iloc[0] for k in group], []
        for i in range(len(pdf)):
            if not pdf["__o"].iloc[i]:
                continue
            for name, method in methods.items():
                for h, f in zip(horizons, method(values.iloc[: i + 1], horizons)):
                    out.append([*head, pdf["month"].iloc[i], name, h, float(f), pdf[f"__y{h}"].iloc[i],
                                pdf["train_n"].iloc[i], pdf["mase_scale"].iloc[i]])
        return pd.DataFrame(out, columns=[*group, "origin", "method", "horizon", "forecast", "actual", "train_n", "mase_scale"])

    out = rows.groupBy(*group).applyInPandas(run, schema)
    clean = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("forecast", "actual", "mase_scale")})
    target = F.expr("add_months(origin, horizon)")
    return with_errors(
        clean.select(*keys, "origin", "method", "horizon", target.alias("target"), "forecast", "actual", "train_n", "mase_scale")
    )
