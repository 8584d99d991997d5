"""Least-absolute-deviation fits for many models at once, their intervals and errors.

A model is one group of rows, for instance the months of one series under one holdout. Groups that the calendar
bounds are solved whole inside a task. Otherwise one solver serves every size: it starts from weighted least squares on sums over
all rows, keeps a window of rows near the fit, folds the rest by residual sign into two summed rows, which leaves
the optimum where it was as long as the signs hold, and confirms the signs by a pass over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, attach, checkpointed, key_join

#: Rows of a model that the folding solver holds at first; twice as many after each round whose signs don't hold.
WINDOW_ROWS = 20_000


def _start_basis(Q: np.ndarray, r: np.ndarray) -> list[int]:
    """Rows of least residual that span the column space."""
    basis, span = [], np.zeros((0, Q.shape[1]))
    for i in np.argsort(np.abs(r), kind="stable"):
        v = Q[i] - span.T @ (span @ Q[i])
        size = np.linalg.norm(v)
        if size > 1e-7 * max(np.linalg.norm(Q[i]), 1e-300):
            basis.append(int(i))
            span = np.vstack([span, v / size])
            if len(basis) == Q.shape[1]:
                break
    return basis


def lad_solve(X: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray | None:
    """Exact optimum by moving along edges between vertices; None when the columns are dependent.

    Equal rows are merged, and a relative nudge of 1e-10 keeps vertices simple, so that a vertex
    without a falling edge is optimal. The coefficients come from the untouched values.
    """
    rows, where = np.unique(np.column_stack([X, y]), axis=0, return_inverse=True)
    w = np.bincount(where.ravel(), weights=w)
    X, y = rows[:, :-1], rows[:, -1]
    n, k = X.shape
    if n < k or np.linalg.matrix_rank(X / np.maximum(np.abs(X).max(axis=0), 1e-300)) < k:
        return None
    Q, R = np.linalg.qr(X)
    nudge = np.modf(np.arange(1, n + 1) * ((math.sqrt(5) - 1) / 2))[0] - 0.5
    t = y + nudge * 1e-10 * max(np.abs(y - np.median(y)).mean(), 1e-300)
    s = np.sqrt(w)
    for _ in range(12):
        g = np.linalg.lstsq(Q * s[:, None], t * s, rcond=None)[0]
        r = t - Q @ g
        s = np.sqrt(w / np.maximum(np.abs(r), 1e-6 * np.abs(r).mean() + 1e-300))
    basis, best = _start_basis(Q, r), math.inf
    for _ in range(200 + 20 * n):
        inverse = np.linalg.inv(Q[basis])
        r = t - Q @ (inverse @ t[basis])
        r[basis] = 0.0
        # Every step lowers the objective; once it no longer does, only rounding is left.
        now = float(w @ np.abs(r))
        if now >= best * (1.0 - 1e-14):
            break
        best = now
        D = Q @ inverse
        free = np.sign(r) * w
        pull = free @ D
        gain = np.abs(pull) - w @ np.where((r == 0.0)[:, None], np.abs(D), 0.0)
        j = int(np.argmax(gain))
        if gain[j] <= 1e-11 * w.sum():
            break
        d = D[:, j] * np.sign(pull[j])
        ahead = np.flatnonzero((r * d > 0) & (np.abs(d) > 1e-14))
        step = r[ahead] / d[ahead]
        order = np.argsort(step, kind="stable")
        climb = np.cumsum(2.0 * w[ahead][order] * np.abs(d[ahead][order]))
        at = np.searchsorted(climb, gain[j])
        if at >= len(order):
            break
        basis[j] = int(ahead[order[at]])
    return np.linalg.solve(X[basis], y[basis])


def _fit_groups(rows: DataFrame, keys: Keys) -> DataFrame:
    """One solved model per group of (keys, x, y, w)."""
    group = list(keys)
    schema = StructType([rows.schema[k] for k in group] + [StructField("beta", ArrayType(DoubleType())), StructField("status", StringType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        X, y = np.vstack(pdf["x"].to_numpy()).astype(float), pdf["y"].to_numpy(dtype=float)
        w = pdf["w"].to_numpy(dtype=float)
        if not (np.isfinite(w).all() and (w > 0).all()):
            raise ValueError("weights are finite and positive")
        if not (np.isfinite(X).all() and np.isfinite(y).all()):
            raise ValueError("design and target hold no nulls")
        beta = lad_solve(X, y, w)
        out = pdf[group].iloc[:1].copy()
        out["beta"] = [None if beta is None else beta.tolist()]
        out["status"] = "dependent terms" if beta is None else "optimal"
        return out

    return rows.groupBy(*group).applyInPandas(solve, schema)


def dot(x: str, beta: str) -> Column:
    return F.aggregate(F.zip_with(x, beta, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def _least_squares(rows: DataFrame, keys: Keys, k: int) -> DataFrame:
    """(keys, start, n, flags): weighted least squares from sums over all rows, the row count, and of each term the rows where it isn't 0."""
    x = [F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)) for i in range(k)]
    moments = [F.sum(F.col("w") * x[i] * x[j]) for i in range(k) for j in range(k)]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(F.size("x")).alias("terms"), F.array(*moments).alias("xx"),
        F.array(*[F.sum(F.col("w") * c * F.col("y")) for c in x]).alias("xy"), F.array(*[F.count_if(c != 0) for c in x]).alias("flags"),
    )

    @F.pandas_udf(ArrayType(DoubleType()))
    def start(terms: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(a, (k, k))[:t, :t], np.asarray(b)[:t], rcond=None)[0].tolist() for t, a, b in zip(terms, xx, xy)])

    return sums.select(*keys, start("terms", "xx", "xy").alias("start"), "n", "flags")


def _fit_folded(rows: DataFrame, keys: Keys, window: int) -> DataFrame:
    """Models of any size. The window holds the rows of least residual and, of a term that is rarely other than 0, those rows.

    A model is settled when no folded row has changed its sign, or when the window holds all its rows. A fit
    without a solution in the window stays open; dependent terms are a result only over all rows.
    """
    rows = checkpointed(rows)
    k = rows.agg(F.max(F.size("x"))).first()[0]
    if k is None:
        return _fit_groups(rows, keys)
    sums = checkpointed(_least_squares(rows, keys, k))
    merge = lambda df: df.groupBy(*keys, "x", "y").agg(F.sum("w").alias("w"))
    cuts = [2.0**-e for e in range(30, 0, -1)]
    models, done, turn = sums.select(*keys, "start", "n", "flags"), None, 0
    while True:
        size = F.lit(float(window * 2**turn))
        residual = F.abs(F.col("y") - dot("x", "start"))
        open_rows = key_join(rows, models, keys, "inner").withColumn("__r", residual)
        edges = open_rows.groupBy(*keys).agg(F.percentile_approx("__r", cuts, 10_000).alias("__q"), F.max("n").alias("__n"))
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= size / F.col("__n")))
        edge = F.when(F.col("__n") <= size, float("inf")).otherwise(F.element_at("__q", F.greatest(F.lit(1), at)))
        sided = attach(open_rows, edges.select(*keys, edge.alias("__edge")), keys)
        rare = F.exists(F.zip_with("x", F.slice("flags", F.lit(1), F.size("x")), lambda v, f: (v != 0) & (f <= size / k)), lambda b: b)
        side = F.when(rare | (F.col("__r") <= F.col("__edge")), 0).when(F.col("y") > dot("x", "start"), 1).otherwise(-1)
        sided = sided.withColumn("__s", side)
        near = merge(sided.filter("__s = 0"))
        total = F.slice(F.array(*[F.sum(F.col("w") * F.get("x", F.lit(i))) for i in range(k)]), F.lit(1), F.max(F.size("x")))
        folded = sided.filter("__s <> 0").groupBy(*keys, "__s").agg(total.alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"), F.lit(1.0).alias("w"))
        solved = checkpointed(_fit_groups(near.unionByName(folded.drop("__s")), keys))
        check = key_join(sided, solved, keys, "inner")
        turned = (F.col("__s") != 0) & (F.col("beta").isNull() | (F.signum(F.col("y") - dot("x", "beta")) * F.col("__s") < 0))
        state = checkpointed(check.groupBy(*keys).agg(F.count_if(turned).alias("__bad")))
        flagged = key_join(key_join(solved, state, keys, "inner"), models, keys, "inner")
        good = flagged.filter("__bad = 0").select(*keys, "beta", "status")
        done = good if done is None else done.unionByName(good)
        models = flagged.filter("__bad > 0").select(*keys, F.coalesce("beta", "start").alias("start"), "n", "flags")
        if models.isEmpty():
            return done
        turn += 1


def fit_lad(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    weight: str | None = None,
    keys: Keys = (),
    bounded: bool = False,
    window: int = WINDOW_ROWS,
) -> DataFrame:
    """Coefficients of every model: (keys, beta, status), beta in the order of ``features``.

    ``bounded=True`` states that the calendar bounds the groups (monthly rows), so that each fits in a task. A model
    whose terms depend on each other has a null beta and says so in its status.
    """
    data = rows.select(
        *keys,
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.col(target).cast("double").alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    return fit_arrays(data, keys, bounded, window)


def fit_arrays(data: DataFrame, keys: Keys = (), bounded: bool = True, window: int = WINDOW_ROWS) -> DataFrame:
    """The same for rows that already hold x, y and w; models may differ in their number of terms."""
    if not keys:
        return fit_arrays(data.withColumn("__all", F.lit(0)), ["__all"], bounded, window).drop("__all")
    data = data.select(*keys, "x", "y", "w")
    return _fit_groups(data, keys) if bounded else _fit_folded(data, keys, window)


def coefficients(models: DataFrame, features: Sequence[str], keys: Keys = ()) -> DataFrame:
    """One row per model and term."""
    names = F.array(*[F.lit(c) for c in features])
    pairs = F.arrays_zip(names.alias("term"), F.col("beta").alias("value"))
    return models.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.term", "p.value")


def predict(rows: DataFrame, models: DataFrame, features: Sequence[str], keys: Keys = (), alias: str = "prediction") -> DataFrame:
    terms = [F.col("beta")[i] * F.col(c) for i, c in enumerate(features)]
    return attach(rows, models.select(*keys, "beta"), keys).withColumn(alias, reduce(lambda a, b: a + b, terms)).drop("beta")


def residuals(
    rows: DataFrame, models: DataFrame, features: Sequence[str], target: str, keys: Keys = ()
) -> DataFrame:
    """Rows with prediction and residual; residuals are observed less predicted everywhere."""
    return predict(rows, models, features, keys).withColumn("residual", F.col(target) - F.col("prediction"))


def residual_summary(res: DataFrame, weight: str | None = None, level: float = 0.90, keys: Keys = ()) -> DataFrame:
    """Per model: count, Laplace scale, residual quantiles of the level, median absolute residual.

    The scale is the weighted mean distance from the unweighted median.
    """
    tail = (1 - level) / 2
    q = res.groupBy(*keys).agg(
        F.count("residual").alias("n_train"),
        F.percentile("residual", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("__q"),
        F.percentile(F.abs("residual"), F.lit(0.5)).alias("train_medae_log"),
    )
    w = F.col(weight) if weight else F.lit(1.0)
    off = attach(res, q.select(*keys, F.col("__q")[1].alias("__med")), keys)
    scale = off.groupBy(*keys).agg(
        (F.sum(w * F.abs(F.col("residual") - F.col("__med"))) / F.sum(w)).alias("laplace_scale")
    )
    return attach(q, scale, keys).select(
        *keys,
        "n_train",
        "laplace_scale",
        F.col("__q")[0].alias("residual_low"),
        F.col("__q")[2].alias("residual_high"),
        "train_medae_log",
    )


def empirical_interval(predicted: DataFrame, summary: DataFrame, keys: Keys = ()) -> DataFrame:
    """Prediction with bounds from the training residuals' quantiles."""
    rows = attach(predicted, summary.select(*keys, "residual_low", "residual_high"), keys)
    return rows.withColumns(
        {"lower": F.col("prediction") + F.col("residual_low"), "upper": F.col("prediction") + F.col("residual_high")}
    ).drop("residual_low", "residual_high")


def laplace_interval(
    predicted: DataFrame, summary: DataFrame, level: float = 0.90, observation_scale: str | None = None, keys: Keys = ()
) -> DataFrame:
    """Laplace bounds whose variance adds each row's own standard error; a missing one adds nothing."""
    tail = (1 - level) / 2
    rows = attach(predicted, summary.select(*keys, F.col("laplace_scale").alias("__b")), keys)
    variance = 2 * F.col("__b") * F.col("__b")
    if observation_scale:
        se = F.coalesce(observation_scale, F.lit(0.0))
        variance = variance + se * se
    b = F.sqrt(variance / 2)
    return rows.withColumns(
        {
            "lower": F.col("prediction") + C.laplace_quantile(tail, b),
            "upper": F.col("prediction") + C.laplace_quantile(1 - tail, b),
        }
    ).drop("__b")


def back_transform(interval: DataFrame, columns: Sequence[str] = ("prediction", "lower", "upper")) -> DataFrame:
    return interval.withColumns({c: F.exp(c) for c in columns})


def interval_coverage(interval: DataFrame, observed: str, keys: Keys = ()) -> DataFrame:
    inside = F.col(observed).between(F.col("lower"), F.col("upper"))
    return interval.groupBy(*keys).agg(F.avg(F.coalesce(inside, F.lit(False)).cast("int")).alias("coverage"))


def error_columns(observed: str, predicted: str) -> list[Column]:
    """Errors on the log scale and, after the exponential, on the flux scale."""
    e = F.col(observed) - F.col(predicted)
    f = F.exp(observed) - F.exp(predicted)
    med = lambda c: F.percentile(c, F.lit(0.5))
    return [
        F.count("*").alias("n_test"),
        F.avg(F.abs(e)).alias("mae_log"),
        med(F.abs(e)).alias("medae_log"),
        F.avg(e).alias("bias_log"),
        F.avg(F.abs(f)).alias("mae_flux"),
        med(F.abs(f)).alias("medae_flux"),
        F.avg(f).alias("bias_flux"),
        (100 * F.avg(F.abs(f / F.exp(observed)))).alias("mape_pct"),
    ]


def error_metrics(rows: DataFrame, observed: str, predicted: str, keys: Keys = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(*error_columns(observed, predicted))
