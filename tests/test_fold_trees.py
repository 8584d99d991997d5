"""Trees of a fold against plain recursion, screening, and the whole run against fitting fold by fold."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fluxspark.forecast import fold_trees as T
from fluxspark.forecast.folds import design_names, fold_rows
from fluxspark.functions.linear import solved


def plain_tree(x, y, w, rider, depth, min_leaf, l2, gains):
    rows = np.flatnonzero(w)
    total, weight = (w[rows] * y[rows]).sum(), w[rows].sum()
    value, before, best = total / (weight + l2), total**2 / (weight + l2), None
    for f in range(x.shape[1] if depth else 0):
        values = np.unique(x[rows, f])
        for a, b in zip(values, values[1:]):
            sides = rows[x[rows, f] <= a], rows[x[rows, f] > a]
            if min(map(len, sides)) >= min_leaf:
                gain = sum((w[q] * y[q]).sum() ** 2 / (w[q].sum() + l2) for q in sides)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, (a + b) / 2
    if best is None or best[0] <= before + 1e-12 * abs(before):
        return value
    gains[best[1]] += best[0] - before
    below = x[:, best[1]] <= best[2]
    here = below if rider[best[1]] <= best[2] else ~below
    other = np.where(~here, w, 0)
    plain_tree(x, y, other, x[np.flatnonzero(other)[0]], depth - 1, min_leaf, l2, gains)
    return plain_tree(x, y, np.where(here, w, 0), rider, depth - 1, min_leaf, l2, gains)


def test_trees_are_grown_as_by_recursion():
    rng = np.random.default_rng(0)
    for _ in range(40):
        n, p = rng.integers(1, 40), rng.integers(1, 5)
        x, y, riders = np.round(rng.standard_normal((n, p)), 1), rng.standard_normal(n), rng.standard_normal((2, p))
        w, depth, min_leaf, l2 = T.bootstrap(rng, 3, n), int(rng.integers(0, 5)), int(rng.integers(1, 4)), float(rng.integers(0, 2))
        grown = T.grow(x, y, w, riders, depth, min_leaf, l2)
        for t in range(3):
            for i in range(2):
                gains = np.zeros(p)
                assert math.isclose(plain_tree(x, y, w[t], riders[i], depth, min_leaf, l2, gains), grown.predictions[t, i], abs_tol=1e-9)
            assert np.allclose(gains, grown.gains[t])


def test_trees_of_awkward_rows():
    one = T.grow(np.array([[1.0]]), np.array([3.0]), np.array([[1]]), np.array([[5.0]]))
    assert one.predictions.tolist() == [[3.0]] and one.importances().tolist() == [0.0]
    flat = T.grow(np.ones((9, 2)), np.arange(9.0), np.ones((2, 9), dtype=int), np.ones((1, 2)))
    assert flat.predictions.tolist() == [[4.0], [4.0]]
    assert T.grow(np.empty((4, 0)), np.arange(4.0), np.ones((1, 4), dtype=int), np.empty((1, 0))).predictions.tolist() == [[1.5]]


def test_screening_counts_wins():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 4))
    y = np.sin(x[:, 0]) + 3 * x[:, 1] + 0.1 * rng.standard_normal(80)
    screen = T.Screening(repeats=10, n_trees=20, always_keep=("season",))
    names = ["season", "real", "noise", "other"]
    assert screen.kept(x, y, names, rng) == [True, True, False, False]
    assert screen.kept(x[:5], y[:5], names, rng) == [True] * 4
    assert T.Screening().needed() == 15 and T.Screening(repeats=6).needed() == 6 and T.Screening(repeats=4).needed() == 5


def test_boosting_and_forest_learn():
    rng = np.random.default_rng(6)
    x = rng.uniform(-1, 1, (300, 3))
    y = 4 * (x[:, 1] > 0) + 0.1 * rng.standard_normal(300)
    for learner in (T.RandomForest(60), T.Boosting()):
        assert abs(learner(x, y, np.array([0.0, 0.5, 0.0]), rng) - 4) < 0.3 and abs(learner(x, y, np.array([0.0, -0.5, 0.0]), rng)) < 0.3


def grid(spark):
    rnd = random.Random(3)
    from test_models import month

    rows = [(k, month(i), math.sin(i * math.pi / 6) + rnd.gauss(0, 0.3), rnd.gauss(0, 1)) for k in ("a", "b") for i in range(66)]
    return spark.createDataFrame(rows, "site string, month date, value double, c double")


def test_run_is_each_fold_alone(spark):
    """The distributed run gives what the learners give on one fold's rows, whatever the number of partitions."""
    learners = {"ordinary least squares": T.least_squares, "random forest": T.RandomForest(5, 3), "gradient boosting": T.Boosting(8)}
    screen, g = T.Screening(repeats=4, n_trees=4), grid(spark)
    run = lambda: {(r.site, r.origin, r.horizon, r.method): r for r in T.run_folds(g, ["c"], learners, (1, 6), 60, screen, keys=["site"]).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = run()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) >= 20 and got == again
    rows = fold_rows(g, 6, ["c"], 60, (1, 6), keys=["site"]).filter("site = 'b'").collect()
    names = design_names(6, ["c"])
    for origin in {r.origin for r in rows}:
        train = sorted((r for r in rows if r.origin == origin and not r.is_test), key=lambda r: r.month)
        test = next(r for r in rows if r.origin == origin and r.is_test)
        one = got["b", origin, 6, "ordinary least squares"]
        keep = [n in one.predictors for n in names]
        x, y = np.array([r.x for r in train])[:, keep], np.array([r.y for r in train])
        want = T.least_squares(x, y, np.array(test.x)[keep], None) + test.level
        assert math.isclose(one.forecast, want, rel_tol=1e-9) and one.n_predictors == sum(keep) and set(names[:3]) <= set(one.predictors)
        assert one.target == test.month and math.isclose(one.error, one.actual - one.forecast)


def test_run_without_folds_or_screening(spark):
    g = grid(spark)
    assert T.run_folds(g.filter("month < date'1996-01-01'"), keys=["site"]).count() == 0
    rows = T.run_folds(g, (), {"ridge": T.RidgeRegression()}, (1,), 62, None, keys=["site"]).collect()
    assert rows and all(r.predictors == design_names(1) for r in rows)


def test_small_systems(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((9, 4))
    a[:, 3] = a[:, 0] - 2 * a[:, 2]
    m, b = a.T @ a, a.T @ rng.standard_normal(9)
    rows = [(np.c_[q, r].tolist(),) for q, r in ((m[:3, :3], b[:3]), (m, b), (np.zeros((2, 2)), np.zeros(2)))]
    one = lambda row, n: spark.createDataFrame([row], "m array<array<double>>").select(solved(F.col("m"), n).alias("x")).first().x
    full, dependent, none = (one(r, n) for r, n in zip(rows, (3, 4, 2)))
    assert np.allclose(full, np.linalg.solve(m[:3, :3], b[:3])) and np.allclose(m @ dependent, b) and dependent[3] == 0 and none == [0.0, 0.0]
