"""Trees, linear models and shadow screening of every fold: one Spark group a fold, all trees of a fold grown together.

A fold is one series' months up to an origin, which the calendar bounds, so it fits one group; Spark spreads the folds of
all series, origins and horizons over the cluster in one job. Inside a group the trees of a forest share each level's arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.forecast.folds import design_names, fold_rows
from fluxspark.forecast.rolling import with_errors
from fluxspark.operators.common import Keys


@dataclass
class Grown:
    """What a batch of trees gives: the prediction of each rider in each tree, and each tree's gains by predictor."""

    predictions: np.ndarray
    gains: np.ndarray

    def importances(self) -> np.ndarray:
        """Gains as shares of each tree's, averaged over the trees; a tree without a split counts zeros."""
        total = self.gains.sum(axis=1, keepdims=True)
        return np.divide(self.gains, total, out=np.zeros_like(self.gains), where=total > 0).mean(axis=0)


def grow(x: np.ndarray, y: np.ndarray, weights: np.ndarray, riders: np.ndarray, depth: int | None = None, min_leaf: int = 1, l2: float = 0.0) -> Grown:
    """Regression trees over the same rows, one for each row of ``weights`` (trees x rows; rows of weight 0 are left out).

    Splits are exact: between any two neighbouring values of a predictor, where both sides keep ``min_leaf`` rows, the one with the
    largest fall in squared error; ties go to the earlier predictor and the smaller value. ``riders`` (rows to
    predict) go down with the trees, so no tree is kept. A level of all trees is one set of array operations.
    """
    trees, p = len(weights), x.shape[1]
    ranks = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T]) if p else np.zeros((0, len(x)), dtype=np.int64)
    node, row = np.nonzero(weights)
    w = weights[node, row].astype(np.float64)
    t = w * y[row]
    gains, predictions = np.zeros((trees, p)), np.zeros((trees, len(riders)))
    # Entries of each predictor in the order of (node, value); the nodes' stretches are the same for all predictors.
    order = np.argsort(ranks[:, row], axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(node[order], axis=1, kind="stable"), axis=1)
    tree_of = np.arange(trees)
    at_tree, at_rider = (v.ravel() for v in np.meshgrid(np.arange(trees), np.arange(len(riders)), indexing="ij"))
    at_node, level = at_tree.copy(), 0
    while len(tree_of):
        counts = np.bincount(node, minlength=len(tree_of))
        full, sums = np.bincount(node, w, len(tree_of)), np.bincount(node, t, len(tree_of))
        splits = np.zeros(len(tree_of), dtype=bool)
        if p and order.shape[1] and (depth is None or level < depth):
            first = np.cumsum(counts) - counts
            nd = np.repeat(np.arange(len(counts)), counts)
            place = np.arange(len(nd)) - first[nd]
            lw, ls = np.cumsum(w[order], axis=1), np.cumsum(t[order], axis=1)
            lw, ls = lw - (lw[:, first] - w[order[:, first]])[:, nd], ls - (ls[:, first] - t[order[:, first]])[:, nd]
            r = np.take_along_axis(ranks, row[order], axis=1)
            fits = (place + 1 >= min_leaf) & (counts[nd] - place - 1 >= max(min_leaf, 1))
            differs = np.zeros(r.shape, dtype=bool)
            differs[:, :-1] = r[:, 1:] != r[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = ls**2 / (lw + l2) + (sums[nd] - ls) ** 2 / (full[nd] - lw + l2)
            gain = np.where(differs & fits, gain, -np.inf)
            most = np.maximum.reduceat(gain, first, axis=1)
            # Sums in another order differ in the last digits, so near ties are ties.
            which = (most >= (1 - 1e-12) * most.max(axis=0)).argmax(axis=0)
            top = most[which, np.arange(len(counts))]
            before = sums**2 / (full + l2)
            splits = top > before + 1e-12 * np.maximum(np.abs(before), 1e-300)
        # Riders in nodes that end here get the node's value.
        ended = ~splits[at_node]
        value = sums / np.maximum(full + l2, 1e-300)
        predictions[at_tree[ended], at_rider[ended]] = value[at_node[ended]]
        if not splits.any():
            break
        np.add.at(gains, (tree_of[splits], which[splits]), (top - before)[splits])
        hits = np.flatnonzero(gain[which[nd], np.arange(len(nd))] == top[nd])
        cut = np.full(len(counts), -1)
        cut[nd[hits[::-1]]] = hits[::-1]
        s = np.flatnonzero(splits)
        edge = np.zeros(len(counts), dtype=np.int64)
        edge[s] = r[which[s], cut[s]]
        below, above = order[which[s], cut[s]], order[which[s], cut[s] + 1]
        threshold = np.zeros(len(counts))
        threshold[s] = (x[row[below], which[s]] + x[row[above], which[s]]) / 2
        child = np.full(len(counts), -1)
        child[s] = 2 * np.arange(len(s))
        keep = splits[node]
        moved = child[node] + (ranks[which[node], row] > edge[node])
        stay = ~ended
        on = at_node[stay]
        at_tree, at_rider = at_tree[stay], at_rider[stay]
        at_node = child[on] + (riders[at_rider, which[on]] > threshold[on])
        # Entries of ended nodes leave; the others are dealt to their new nodes, each predictor's order kept inside them.
        new_place = np.cumsum(keep) - 1
        order = new_place[order[keep[order]].reshape(p, -1)]
        node, row, w, t = moved[keep], row[keep], w[keep], t[keep]
        kind = np.uint16 if 2 * len(s) <= 1 << 16 else np.int64
        order = np.take_along_axis(order, np.argsort(node.astype(kind)[order], axis=1, kind="stable"), axis=1)
        tree_of, level = np.repeat(tree_of[s], 2), level + 1
    return Grown(predictions, gains)


def bootstrap(rng: np.random.Generator, trees: int, n: int) -> np.ndarray:
    return rng.multinomial(n, np.full(n, 1 / n), size=trees)


# A learner forecasts one test row: (x, y, test, rng) -> number.
Learner = Callable[[np.ndarray, np.ndarray, np.ndarray, np.random.Generator], float]


def least_squares(x: np.ndarray, y: np.ndarray, test: np.ndarray, rng: np.random.Generator) -> float:
    mean = x.mean(axis=0)
    return float(y.mean() + (test - mean) @ np.linalg.lstsq(x - mean, y - y.mean(), rcond=None)[0])


@dataclass(frozen=True)
class RidgeRegression:
    """The intercept is not penalized."""

    alpha: float = 1.0

    def __call__(self, x: np.ndarray, y: np.ndarray, test: np.ndarray, rng: np.random.Generator) -> float:
        mean = x.mean(axis=0)
        c = x - mean
        return float(y.mean() + (test - mean) @ np.linalg.solve(c.T @ c + self.alpha * np.eye(x.shape[1]), c.T @ (y - y.mean())))


@dataclass(frozen=True)
class RandomForest:
    n_trees: int = 300
    depth: int | None = None
    min_leaf: int = 2

    def __call__(self, x: np.ndarray, y: np.ndarray, test: np.ndarray, rng: np.random.Generator) -> float:
        return float(grow(x, y, bootstrap(rng, self.n_trees, len(y)), test[None, :], self.depth, self.min_leaf).predictions.mean())


@dataclass(frozen=True)
class Boosting:
    """Trees on residuals; a fifth of the rows is held back and ends it when they haven't improved for ``patience`` rounds."""

    rounds: int = 300
    rate: float = 0.05
    depth: int = 4
    min_leaf: int = 20
    l2: float = 1.0
    held: float = 0.2
    patience: int = 10

    def __call__(self, x: np.ndarray, y: np.ndarray, test: np.ndarray, rng: np.random.Generator) -> float:
        back = np.zeros(len(y), dtype=bool)
        back[rng.permutation(len(y))[: int(np.ceil(self.held * len(y)))]] = True
        riders, base = np.vstack([x, test]), float(y[~back].mean())
        fitted, best, since = np.full(len(riders), base), np.inf, 0
        for _ in range(self.rounds):
            fitted = fitted + self.rate * grow(x, y - fitted[:-1], (~back)[None, :], riders, self.depth, self.min_leaf, self.l2).predictions[0]
            loss = float(((y - fitted[:-1])[back] ** 2).mean()) if back.any() else -np.inf
            best, since = (loss, 0) if loss < best - 1e-7 else (best, since + 1)
            if since >= self.patience:
                break
        return float(fitted[-1])


LEARNERS: dict[str, Learner] = {"ordinary least squares": least_squares, "ridge": RidgeRegression(), "random forest": RandomForest(), "gradient boosting": Boosting()}


@dataclass(frozen=True)
class Screening:
    """Shadow comparison: a predictor stays if it beats the best permuted copy more often than a fair coin plausibly would."""

    repeats: int = K.SCREEN_REPEATS
    n_trees: int = 100
    depth: int | None = None
    alpha: float = K.SCREEN_ALPHA
    min_shadows: int = K.SCREEN_MIN_SHADOWS
    always_keep: Sequence[str] = field(default_factory=lambda: tuple(K.SEASONAL_TERMS))

    def needed(self) -> int:
        """The least count of wins that a fair coin reaches with a chance of at most ``alpha``."""
        chance, choose, tail = 0.5**self.repeats, 1, 0.0
        for hits in range(self.repeats, -1, -1):
            tail += choose * chance
            if tail > self.alpha:
                return hits + 1
            choose = choose * hits // (self.repeats - hits + 1)
        return 0

    def hits(self, x: np.ndarray, y: np.ndarray, judged: Sequence[int], rng: np.random.Generator) -> np.ndarray:
        """How often each judged column's importance exceeds that of every shadow of the repeat."""
        source = [judged[j % len(judged)] for j in range(max(len(judged), self.min_shadows))]
        won = np.zeros(len(judged), dtype=np.int64)
        for _ in range(self.repeats):
            shadows = np.stack([rng.permutation(x[:, j]) for j in source], axis=1)
            found = grow(np.hstack([x, shadows]), y, bootstrap(rng, self.n_trees, len(y)), np.empty((0, x.shape[1] + len(source))), self.depth).importances()
            won += found[list(judged)] > found[x.shape[1] :].max()
        return won

    def kept(self, x: np.ndarray, y: np.ndarray, names: Sequence[str], rng: np.random.Generator) -> list[bool]:
        judged = [i for i, n in enumerate(names) if n not in self.always_keep]
        if not judged or len(y) < 12:
            return [True] * len(names)
        won = dict(zip(judged, self.hits(x, y, judged, rng), strict=True))
        return [i not in won or bool(won[i] >= self.needed()) for i in range(len(names))]


def fold_forecasts(
    folds: DataFrame, names: dict[int, list[str]], learners: dict[str, Learner] | None = None, screen: Screening | None = None, keys: Keys = (), seed: int = K.SEED
) -> DataFrame:
    """Every learner's forecast of every fold: (keys, origin, horizon, method, target, forecast, actual, train_n, mase_scale, n_predictors, predictors).

    ``folds`` are ``fold_rows`` of one or more horizons with their ``horizon``; ``names`` has each horizon's predictors. With ``screen`` a
    fold's methods see the predictors that its own training rows keep. Draws depend on the seed and the fold alone.
    """
    learners = LEARNERS if learners is None else learners
    fk = [*keys, "origin", "horizon"]
    schema = folds.select(*fk, F.lit("").alias("method"), F.col("month").alias("target"), F.lit(0.0).alias("forecast"), "actual", "train_n", "mase_scale", F.lit(0).alias("n_predictors"), F.array(F.lit("")).alias("predictors")).schema

    def fit(fold: pd.DataFrame) -> pd.DataFrame:
        fold = fold.sort_values("month")
        of = names[int(fold["horizon"].iloc[0])]
        train, test = fold[~fold["is_test"]], fold[fold["is_test"]].iloc[-1]
        x, y = np.stack(train["x"].to_list()).astype(np.float64), train["y"].to_numpy(dtype=np.float64)
        drawn = lambda *what: np.random.default_rng([seed, zlib.crc32(repr([*map(str, fold[fk].iloc[0]), *what]).encode())])
        keep = np.array(screen.kept(x, y, of, drawn("screen")) if screen else [True] * len(of))
        used = [n for n, k in zip(of, keep, strict=True) if k]
        at = np.asarray(test["x"], dtype=np.float64)[keep]
        fixed = {c: fold[c].iloc[0] for c in fk} | {"target": test["month"], "actual": test["actual"], "train_n": test["train_n"], "mase_scale": test["mase_scale"], "n_predictors": len(used), "predictors": used}
        rows = [fixed | {"method": m, "forecast": make(x[:, keep], y, at, drawn(m)) + test["level"]} for m, make in learners.items()]
        return pd.DataFrame(rows)[schema.names]

    # Few bytes and much work a fold: the tasks are set by number, so that they are not merged by size.
    tasks = 4 * int(folds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return folds.repartition(tasks, *fk).groupBy(*fk).applyInPandas(fit, schema)


def run_folds(
    grid: DataFrame,
    covariates: Sequence[str] = (),
    learners: dict[str, Learner] | None = None,
    horizons: Sequence[int] = K.HORIZONS,
    min_train: int = K.MIN_TRAIN,
    screen: Screening | None = Screening(),
    keys: Keys = (),
    seed: int = K.SEED,
) -> DataFrame:
    """Rolling-origin evaluation of fitted methods: each series' folds of all origins and horizons, screened and fitted one by one.

    The rows have the benchmarks' shape, with how many and which predictors were used.
    """
    names = {h: design_names(h, covariates) for h in horizons}
    folds = None
    for h in horizons:
        part = fold_rows(grid, h, covariates, min_train, horizons, keys=keys).withColumn("horizon", F.lit(h))
        folds = part if folds is None else folds.unionByName(part)
    return with_errors(fold_forecasts(folds, names, learners, screen, keys, seed))
