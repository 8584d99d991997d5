"""Models on folds: linear ones per fold from sums, forests on the pooled panel with MLlib."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fluxspark import constants as K
from fluxspark.forecast.folds import design_names, fold_rows
from fluxspark.forecast.rolling import with_errors
from fluxspark.operators.common import Keys, by, checkpointed, key_join

FAMILY = {
    "ordinary least squares": "statistical",
    "ridge": "statistical",
    "random forest": "machine learning",
    "gradient boosting": "machine learning",
}


def _solver(p: int, alpha: float):
    upper = [(i, j) for i in range(p) for j in range(i, p)]

    @F.pandas_udf(StructType([StructField("ols", DoubleType()), StructField("ridge", DoubleType())]))
    def solve(n: pd.Series, mean_x: pd.Series, mean_y: pd.Series, xx: pd.Series, xy: pd.Series, test: pd.Series, kept: pd.Series) -> pd.DataFrame:
        out = []
        for m, a, my, g, h, t, use in zip(n, mean_x, mean_y, xx, xy, test, kept):
            mx, G = np.asarray(a), np.zeros((p, p))
            for (i, j), v in zip(upper, g):
                G[i, j] = G[j, i] = v
            k = np.flatnonzero(np.asarray(use, dtype=bool))
            S = m * G[np.ix_(k, k)]
            c, d = m * np.asarray(h)[k], (np.asarray(t) - mx)[k]
            s = np.sqrt(np.maximum(np.diag(S), 1e-300))
            ols = np.linalg.lstsq(S / np.outer(s, s), c / s, rcond=1e-12)[0] / s
            ridge = np.linalg.solve(S + alpha * np.eye(len(k)), c)
            out.append((my + d @ ols, my + d @ ridge))
        return pd.DataFrame(out, columns=["ols", "ridge"])

    return solve


def linear_forecasts(
    folds: DataFrame, width: int, keys: Keys = (), alpha: float = 1.0, kept: DataFrame | None = None
) -> DataFrame:
    """Ordinary least squares and ridge of every fold, from one aggregate of means and covariances, which are centred as they are summed.

    The intercept is not penalized. ``kept`` optionally masks the predictors of an origin.
    """
    fk = [*keys, "origin"]
    x, train = (lambda i: F.col("x")[i]), ~F.col("is_test")
    of = lambda e: F.when(train, e)
    agg = folds.groupBy(*fk).agg(
        F.count_if(train).alias("__n"),
        F.array(*[F.avg(of(x(i))) for i in range(width)]).alias("__mx"),
        F.avg(of(F.col("y"))).alias("__my"),
        F.array(*[F.covar_pop(of(x(i)), of(x(j))) for i in range(width) for j in range(i, width)]).alias("__xx"),
        F.array(*[F.covar_pop(of(x(i)), of(F.col("y"))) for i in range(width)]).alias("__xy"),
        F.max(F.when(~train, F.struct("month", "x", "level", "actual", "train_n", "mase_scale"))).alias("t"),
    )
    if kept is None:
        agg = agg.withColumn("__kept", F.array(*[F.lit(True)] * width))
    else:
        agg = key_join(agg, kept.select("origin", F.col("mask").alias("__kept")), ["origin"], "inner")
    solved = agg.withColumn("p", _solver(width, alpha)("__n", "__mx", "__my", "__xx", "__xy", "t.x", "__kept"))
    both = F.explode(
        F.array(
            F.struct(F.lit("ordinary least squares").alias("method"), F.col("p.ols").alias("a")),
            F.struct(F.lit("ridge").alias("method"), F.col("p.ridge").alias("a")),
        )
    )
    return solved.select(*fk, both.alias("m"), "t.*").select(
        *fk, "m.method", F.col("month").alias("target"), (F.col("m.a") + F.col("level")).alias("forecast"),
        "actual", "train_n", "mase_scale",
    )


def forest(n_trees: int = 300, depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", labelCol="label", numTrees=n_trees, maxDepth=depth, minInstancesPerNode=2, seed=K.SEED,
        featureSubsetStrategy="all",
    )


def boosting(n_iter: int = 300, depth: int = 4) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="label", maxIter=n_iter, maxDepth=depth, stepSize=0.05, seed=K.SEED,
        validationIndicatorCol="held_back", validationTol=1e-4,
    )


def _pooled(folds: DataFrame, mask: Sequence[bool] | None = None) -> DataFrame:
    """Fold rows of all series on one scale: flux in units of the fold's ``scale``."""
    cols = range(len(mask)) if mask else None
    x = F.col("x") if mask is None else F.array(*[F.col("x")[i] for i in cols if mask[i]])
    return folds.select(
        "*", array_to_vector(x).alias("features"), (F.col("y") / F.col("scale")).alias("label"),
        (F.pmod(F.xxhash64("month", "y"), F.lit(5)) == 0).alias("held_back"),
    )


def scaled_folds(folds: DataFrame, names: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Flux lags in units of the fold's ``scale``, so that series of any size can share a model.

    The scale is the scaled-error denominator; where that is missing or zero (an exactly periodic series), the mean size of
    the fold's training target; else 1.
    """
    size = F.avg(F.when(~F.col("is_test"), F.abs("y"))).over(by(*keys, "origin"))
    positive = lambda c: F.when(c > 0, c)
    folds = folds.withColumn("scale", F.coalesce(positive(F.col("mase_scale")), positive(size), F.lit(1.0)))
    x = [F.col("x")[i] / F.col("scale") if n.startswith("flux_lag") else F.col("x")[i] for i, n in enumerate(names)]
    return folds.withColumn("x", F.array(*x))


def pooled_forecasts(
    folds: DataFrame,
    names: Sequence[str],
    learners: dict[str, Callable],
    refit_every: int = 1,
    masks: dict[str, list[bool]] | None = None,
    keys: Keys = (),
) -> DataFrame:
    """Tree models fitted on every series' fold rows at once, refitted every ``refit_every`` origins.

    A model fitted at one origin serves the following ones until the next refit, and so never
    sees a month after its own origin. The driver only walks the refit origins, which the calendar bounds;
    each fit is a distributed job over the whole panel. None where there is no fold.
    """
    folds = checkpointed(scaled_folds(folds, names, keys))
    months = [r[0] for r in folds.select("origin").distinct().orderBy("origin").collect()]
    out = None
    for i in range(0, len(months), refit_every):
        block = months[i : i + refit_every]
        mask = masks.get(str(block[0])) if masks else None
        train = _pooled(folds.filter((F.col("origin") == F.lit(block[0])) & ~F.col("is_test")), mask)
        tests = _pooled(folds.filter(F.col("is_test") & F.col("origin").between(F.lit(block[0]), F.lit(block[-1]))), mask)
        for name, make in learners.items():
            part = make().fit(train).transform(tests).select(
                *keys, "origin", F.lit(name).alias("method"), F.col("month").alias("target"),
                (F.col("prediction") * F.col("scale") + F.col("level")).alias("forecast"),
                "actual", "train_n", "mase_scale",
            )
            out = part if out is None else out.unionByName(part)
    return out


LEARNERS: dict[str, Callable] = {"random forest": forest, "gradient boosting": boosting}


def run(
    grid: DataFrame,
    covariates: Sequence[str] = (),
    learners: dict[str, Callable] | None = None,
    horizons: Sequence[int] = K.HORIZONS,
    min_train: int = K.MIN_TRAIN,
    screen: Callable | None = None,
    refit_every: int = 1,
    keys: Keys = (),
) -> DataFrame:
    """Every fold forecast by the linear models and the pooled learners, in the benchmarks' row shape.

    ``screen(folds, names, group=keys)`` returns (predictor, kept) for one refit origin's training rows; every
    method of a fold sees the same predictors. Rows add how many and which predictors were used.
    """
    learners = LEARNERS if learners is None else learners
    out = None
    for h in horizons:
        names = design_names(h, covariates)
        folds = fold_rows(grid, h, covariates, min_train, horizons, keys=keys)
        masks = None
        if screen is not None:
            folds = checkpointed(folds)
            masks = screen_masks(folds, names, screen, refit_every, keys)
        spark = grid.sparkSession
        kept = None
        if masks is not None:
            months = [r[0] for r in folds.select("origin").distinct().orderBy("origin").collect()]
            rows = [(m, masks[str(months[i - i % refit_every])]) for i, m in enumerate(months)]
            kept = spark.createDataFrame(rows, "origin date, mask array<boolean>")
        parts = linear_forecasts(folds, len(names), keys, kept=kept)
        fitted = pooled_forecasts(folds, names, learners, refit_every, masks, keys) if learners else None
        if fitted is not None:
            parts = parts.unionByName(fitted)
        all_names = F.array(*[F.lit(c) for c in names])
        if kept is None:
            parts = parts.withColumn("predictors", all_names)
        else:
            used = F.transform(
                F.filter(F.arrays_zip(all_names.alias("n"), F.col("mask").alias("m")), lambda s: s["m"]), lambda s: s["n"]
            )
            parts = key_join(parts, kept, ["origin"]).withColumn("predictors", used).drop("mask")
        parts = parts.withColumn("horizon", F.lit(h)).withColumn("n_predictors", F.size("predictors"))
        out = parts if out is None else out.unionByName(parts)
    return with_errors(
        out.select(
            *keys, "origin", "method", "horizon", "target", "forecast", "actual", "train_n", "mase_scale",
            "n_predictors", "predictors",
        )
    )


def screen_masks(folds: DataFrame, names: Sequence[str], screen: Callable, refit_every: int, keys: Keys = ()) -> dict[str, list[bool]]:
    """Kept predictors at each refit origin, as masks over the design."""
    months = [r[0] for r in folds.select("origin").distinct().orderBy("origin").collect()]
    scaled, masks = scaled_folds(folds, names, keys), {}
    for m in months[::refit_every]:
        chosen = screen(scaled.filter((F.col("origin") == F.lit(m)) & ~F.col("is_test")), names, group=keys)
        keep = {r["predictor"] for r in chosen.filter("kept").collect()}
        masks[str(m)] = [c in keep for c in names]
    return masks


# ---- screening --------------------------------------------------------------------------------------


def shadow_importances(
    rows: DataFrame,
    names: Sequence[str],
    repeats: int = K.SCREEN_REPEATS,
    n_trees: int = 100,
    depth: int = 8,
    seed: int = K.SEED,
    min_shadows: int = K.SCREEN_MIN_SHADOWS,
    shadowed: Sequence[str] | None = None,
    group: Keys = (),
) -> DataFrame:
    """(repeat, predictor, importance, is_shadow): impurity importances of forests over predictors and permuted copies.

    Each repeat permutes copies of the ``shadowed`` predictors inside every group (one series' months, which the calendar
    bounds) by a hash of seed, repeat, copy, group and month, and fits one distributed forest to all rows. A forest's
    importances are one number per column; those of all repeats become one table.
    """
    scale = F.col("scale") if "scale" in rows.columns else F.lit(1.0)
    usable = rows.filter(~F.exists("x", lambda e: e.isNull()) & F.col("y").isNotNull())
    series = checkpointed(
        usable.select(*group, "month", "x", (F.col("y") / scale).alias("label")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("month", "x", "label"))).alias("r"))
    )
    copied = list(names if shadowed is None else shadowed)
    source = [names.index(copied[j % len(copied)]) for j in range(max(len(copied), min_shadows))] if copied else []
    columns = [(c, False) for c in names] + [(names[i], True) for i in source]
    table = []
    for repeat in range(repeats):
        copies = [_permuted(i, (seed, repeat, j), group).alias(f"s{j}") for j, i in enumerate(source)]
        z = series.select("r", *copies).select(F.explode(F.arrays_zip("r", *[f"s{j}" for j in range(len(source))])).alias("z"))
        wide = z.select(array_to_vector(F.concat("z.r.x", F.array(*[F.col(f"z.s{j}") for j in range(len(source))]))).alias("features"), F.col("z.r.label").alias("label"))
        forest_ = RandomForestRegressor(numTrees=n_trees, maxDepth=depth, seed=seed + repeat, featureSubsetStrategy="all").fit(wide)
        table += [(repeat, c, float(v), shadow) for (c, shadow), v in zip(columns, forest_.featureImportances.toArray(), strict=True)]
    return rows.sparkSession.createDataFrame(table, "repeat int, predictor string, importance double, is_shadow boolean")


def _permuted(i: int, salt: Sequence[int], group: Keys):
    """Predictor i of the row array ``r`` in hash order."""
    drawn = lambda s: F.struct(F.xxhash64(*map(F.lit, salt), *[F.col(c) for c in group], s["month"]).alias("h"), s["x"][i].alias("v"))
    return F.transform(F.array_sort(F.transform("r", drawn)), lambda s: s["v"])


def coin_tail(hits, n):
    """P(X >= hits) of n fair coin tosses, as a column."""
    choose = lambda k: F.when(k == 0, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), F.lit(1.0), lambda a, i: a * (n - k + i) / i))
    return F.aggregate(F.sequence(hits, n), F.lit(0.0), lambda a, k: a + choose(k)) / F.pow(F.lit(2.0), n)


def screened(importances: DataFrame, always_keep: Sequence[str] = K.SEASONAL_TERMS, alpha: float = K.SCREEN_ALPHA) -> DataFrame:
    """(predictor, hits, kept): how often each beat the best shadow of its repeat, and whether a fair coin would so at most with ``alpha``."""
    bars = importances.groupBy("repeat").agg(F.max(F.when(F.col("is_shadow"), F.col("importance"))).alias("bar"))
    won = (F.col("importance") > F.col("bar")).cast("int")
    counted = importances.filter("not is_shadow").join(bars, "repeat").groupBy("predictor").agg(F.sum(won).cast("int").alias("hits"), F.count("*").cast("int").alias("n"))
    always = F.col("predictor").isin(list(always_keep))
    return counted.select("predictor", F.when(~always, F.col("hits")).alias("hits"), (always | (coin_tail(F.col("hits"), F.col("n")) <= alpha)).alias("kept"))


def boruta_select(
    rows: DataFrame, names: Sequence[str], always_keep: Sequence[str] = K.SEASONAL_TERMS, alpha: float = K.SCREEN_ALPHA, group: Keys = (), **options
) -> DataFrame:
    """Screen the predictors ``names`` of arrays ``x`` against target ``y``: (predictor, hits, kept).

    The always-kept columns are in every forest but have no shadow and no count of hits. With fewer than 12 complete rows, or nothing to
    judge, all are kept.
    """
    judged = [c for c in names if c not in always_keep]
    complete = rows.filter(~F.exists("x", lambda e: e.isNull()) & F.col("y").isNotNull())
    if not judged or complete.limit(12).count() < 12:
        spark = rows.sparkSession
        return spark.createDataFrame([(c, None, True) for c in names], "predictor string, hits int, kept boolean")
    return screened(shadow_importances(rows, list(names), shadowed=judged, group=group, **options), always_keep, alpha)
