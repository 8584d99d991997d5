"""Robust fits, support, month sets and forecasts."""

import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluxspark.forecast import models as FM
from fluxspark.forecast import rolling as L
from fluxspark.forecast import scoring as S
from fluxspark.forecast.folds import build_design, design_names, fold_rows
from fluxspark.functions import columns as C
from fluxspark.functions import tails
from fluxspark.operators import lad
from fluxspark.operators import months as N
from fluxspark.operators import stats as T
from fluxspark.operators import studies as D
from fluxspark.operators import support as P
from fluxspark.operators import weights as W


def month(i, start=(2000, 1)):
    m = start[0] * 12 + start[1] - 1 + i
    return dt.date(m // 12, m % 12 + 1, 1)


def series(spark, values, site="x"):
    return spark.createDataFrame([(site, month(i), v) for i, v in enumerate(values)], "site string, month date, value double")


def objective(X, y, w, b):
    return float((w * np.abs(y - X @ b)).sum())


def test_lad_line_and_outlier():
    X = np.column_stack([np.ones(9), np.arange(9.0)])
    y = 2 + 3 * np.arange(9.0)
    y[4] += 100
    assert np.allclose(lad.lad_solve(X, y, np.ones(9)), [2, 3])
    assert lad.lad_solve(np.ones((5, 2)), np.arange(5.0), np.ones(5)) is None


@pytest.mark.parametrize("seed", range(6))
def test_lad_is_no_worse_than_every_vertex(seed):
    rng = np.random.default_rng(seed)
    X = np.column_stack([np.ones(14), rng.integers(0, 6, 14), rng.normal(size=14)])
    y, w = np.round(rng.normal(size=14) * 3, 1), rng.uniform(0.2, 3, 14)
    best = objective(X, y, w, lad.lad_solve(X, y, w))
    import itertools

    for rows in itertools.combinations(range(14), 3):
        A = X[list(rows)]
        if abs(np.linalg.det(A)) > 1e-9:
            assert best <= objective(X, y, w, np.linalg.solve(A, y[list(rows)])) + 1e-9


def test_large_groups_give_the_same_optimum(spark):
    rnd = random.Random(5)
    rows = []
    for g in ("small", "large"):
        for i in range(60 if g == "small" else 3000):
            x = rnd.uniform(-3, 3)
            rows.append((g, x, 1.5 - 0.7 * x + rnd.choice([-1, 1]) * rnd.expovariate(1.0)))
    df = spark.createDataFrame(rows, "g string, x double, y double").withColumn("one", F.lit(1.0))
    whole = {r.g: r.beta for r in lad.fit_lad(df, ["one", "x"], "y", keys=["g"], bounded=True).collect()}
    split = {r.g: r.beta for r in lad.fit_lad(df, ["one", "x"], "y", keys=["g"], window=300).collect()}
    assert whole.keys() == split.keys()
    for g in whole:
        assert np.allclose(whole[g], split[g], atol=1e-9)


def test_weights_must_be_positive(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (1.0, 2.0, 1.0)], "one double, y double, w double")
    with pytest.raises(PySparkException, match="positive"):
        lad.fit_lad(df, ["one"], "y", "w").collect()


def q10_rows(spark, n=48):
    rows = []
    for i in range(n):
        t = 10 + 9 * math.sin(2 * math.pi * i / 12)
        rows.append((month(i, (2009, 1)), t * 9 / 5 + 32, 413 + 0.1 * ((i * 7) % 5), 10 * 2 ** (t / 10), 0.5 + (i % 3) * 0.1))
    return spark.createDataFrame(rows, "month date, soil_temp_f double, wte_m double, flux_mean double, flux_se double")


def test_q10_is_recovered_in_every_holdout(spark):
    rows = q10_rows(spark)
    frame = D.fit_frame(rows.select("month", "soil_temp_f", "wte_m"), rows, rows.select("month"), "flux_mean", "flux_se")
    splits = N.build_splits(frame, "wte_m", "soil_temp_f")
    out = D.run_experiments(frame, splits, ["soil_temp_f", "wte_m"]).collect()
    assert len(out) == 16
    assert all(math.isclose(r.q10, 2.0, rel_tol=1e-6) for r in out)
    assert {r.n_train + r.n_test for r in out} == {48}


def test_bootstrap_of_an_exact_relation_is_a_point(spark):
    rows = q10_rows(spark, 36)
    frame = D.fit_frame(rows.select("month", "soil_temp_f", "wte_m"), rows, rows.select("month"), "flux_mean", "flux_se")
    path = D.coefficient_path(frame, shares=(0.0, 0.4), n_bootstrap=10)
    for r in path.collect():
        assert math.isclose(r.q10, 2.0, rel_tol=1e-6) and math.isclose(r.q10_lo, r.q10_hi, rel_tol=1e-6)
    verdict = D.stability_verdict(path.withColumn("water_table_coef", F.lit(1.0) + F.col("dropped_wettest_pct"))).first()
    assert verdict.stable is False and "coefficient drifts" in verdict.failures


def test_clamp_holds_the_edge_and_bounds_are_needed(spark):
    df = q10_rows(spark, 6)
    bounds = spark.createDataFrame([(413.1, 413.2)], "low double, high double")
    got = {round(r.water_table_clamped, 3) for r in D.build_design(df, bounds).collect()}
    assert got == {413.1, 413.2}
    with pytest.raises(ValueError):
        D.build_design(df, None)
    with pytest.raises(ValueError, match="unknown variant"):
        D.fit_variant(df, "wild")


def test_log_of_non_positive_stops(spark):
    with pytest.raises(PySparkException, match="strictly positive"):
        D.log_target(spark.createDataFrame([(0.0,)], "flux double"), "flux").collect()


def support_frame(spark):
    rows = [(month(i), a, b) for i, (a, b) in enumerate([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0), (0.0, 1.0), (5.0, 1.0)])]
    df = spark.createDataFrame(rows, "month date, a double, b double")
    first = df.filter(F.col("month") < F.lit(month(3)))
    return df, first.select("month"), df.join(first, "month", "left_anti").select("month")


def test_out_of_range_directions_and_excess(spark):
    df, fit, target = support_frame(spark)
    rows = P.out_of_range_months(df, fit, target, ["a"]).orderBy("month").collect()
    assert [(r.direction, r.excess) for r in rows] == [("below", 1.0), ("above", 2.0)]
    runs = P.out_of_range_runs(P.out_of_range_months(df, fit, target, ["a"])).collect()
    assert len(runs) == 1 and runs[0].n_months == 2 and runs[0].direction == "below"


def test_constant_columns_leave_the_distance(spark):
    df, fit, target = support_frame(spark)
    f, t = df.join(fit, "month"), df.join(target, "month")
    for tile in (4096, 1):
        got = {r.month: r.distance for r in P.nearest_distance(t, f, ["a", "b"], tile_rows=tile).collect()}
        assert got == {month(3): 1.0, month(4): 2.0}
    with pytest.raises(Exception, match="no column varies"):
        P.nearest_distance(t, f, ["b"]).collect()
    own = {r.month: r.distance for r in P.nearest_distance(f, f, ["a"], exclude_self=True).collect()}
    assert set(own.values()) == {1.0}


def test_windows_partition_the_months(spark):
    cov = spark.createDataFrame([(month(i), 1.0 if i != 5 else None) for i in range(24)], "month date, a double")
    obs = spark.createDataFrame([(month(i),) for i in range(8, 24) if i != 12], "month date")
    win = N.build_windows(cov, obs, ["a"], [str(month(10))])
    sizes = {r.window: r.n_months for r in N.window_accounting(win).collect()}
    assert sizes == {"fit": 14, "fit_nominal": 15, "excluded": 1, "reconstruction": 7, "interior_gaps": 1, "observed_excluded": 0}
    text = N.compact_runs(N.window_months(win, "reconstruction")).first().runs
    assert text == "2000-01..2000-05, 2000-07..2000-08"


def test_null_weight_is_not_zero(spark):
    df = spark.createDataFrame([(month(0), 0.5), (month(1), None), (month(2), 0.0)], "month date, se double")
    assert [r.weight for r in W.add_weights(df, "se").orderBy("month").collect()] == [4.0, None, None]


def test_tied_band_edges_stop(spark):
    df = spark.createDataFrame([(0.1, 1.0)] * 9 + [(0.1, 2.0)], "r double, c double")
    with pytest.raises(Exception, match="tied"):
        T.bias_by_band(df, "r", "c").collect()


def test_tails_against_known_values(spark):
    given = [(2.228, 10.0, 1.36, 7, 10, -1.5, 0.975), (0.3, 1.0, 0.4, 5, 10, 6.0, 1e-9), (40.0, 400.0, 3.0, 300, 400, 0.0, 0.5), (None, 0.0, None, None, 3, None, 1.0)]
    df = spark.createDataFrame(given, "t double, d double, k double, w bigint, n bigint, z double, p double")
    c = F.col
    rows = df.select(
        "*", tails.t_p_value(c("t"), c("d")).alias("tp"), tails.t_quantile_two_sided(F.lit(0.05), c("d")).alias("tq"), tails.kolmogorov_p_value(c("k")).alias("kp"),
        tails.sign_test_p_value(c("w"), c("n")).alias("sp"), tails.normal_cdf(c("z")).alias("cdf"), tails.normal_p_value(c("z")).alias("np"), tails.normal_quantile(c("p")).alias("q")).collect()
    assert math.isclose(rows[0].tp, 0.05, abs_tol=2e-4) and math.isclose(rows[0].tq, 2.2281, abs_tol=1e-3) and math.isclose(rows[0].kp, 0.0494, abs_tol=1e-3)
    assert math.isclose(rows[1].tp, 1 - 2 / math.pi * math.atan(0.3), rel_tol=1e-12) and math.isclose(rows[1].tq, math.tan(0.475 * math.pi), rel_tol=1e-10)
    for r in rows[:3]:
        assert math.isclose(r.cdf, 0.5 * math.erfc(-r.z / math.sqrt(2)), rel_tol=1e-13) and math.isclose(r.np, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-12)
        assert math.isclose(r.q, NormalDist().inv_cdf(r.p), abs_tol=1e-12)
        tail = sum(math.comb(r.n, k) for k in range(max(r.w, r.n - r.w), r.n + 1)) / 2**r.n
        assert math.isclose(r.sp, min(1.0, 2 * tail), rel_tol=1e-10)
    assert (rows[3].tp, rows[3].tq, rows[3].kp, rows[3].sp, rows[3].cdf, rows[3].q) == (None,) * 6


def test_identical_periods_do_not_differ(spark):
    rows = [(i % 2 == 0, i % 2 == 1, float(i // 2), "c") for i in range(40)]
    df = spark.createDataFrame(rows, "first boolean, second boolean, value double, covariate string")
    r = T.two_samples(df, "first", "second").first()
    assert r.cliffs_delta == 0 and r.ks_statistic == 0 and r.mann_whitney_p > 0.9


def test_band_keeps_about_the_level_asked(spark):
    df = spark.createDataFrame([(float(i),) for i in range(25)], "residual double")
    band = T.simultaneous_band(df, replicates=400).orderBy("k").collect()
    assert len(band) == 25 and all(b.p_low < b.k / 26 < b.p_high for b in band)
    assert 0.0005 < band[0].level < 0.03


# ---- forecasts -----------------------------------------------------------------------------------------


def seasonal(n=96, slope=0.0, noise=0.0, seed=0):
    rnd = random.Random(seed)
    return [20 + slope * t + 10 * math.sin(2 * math.pi * t / 12) + rnd.gauss(0, noise) for t in range(n)]


def test_lags_are_never_shorter_than_the_horizon():
    for h in (1, 2, 3, 6, 11, 12, 13):
        assert min(C.flux_lags(h)) >= h and C.annual_lag(h) >= h
    assert C.annual_lag(13) == 24 and C.flux_lags(1) == [1, 2, 3, 12]


def test_periodic_series_is_forecast_exactly_and_has_no_scale(spark):
    rows = L.rolling_forecasts(series(spark, seasonal()), keys=["site"])
    exact = rows.filter("method in ('seasonal naive', 'climatology') and actual is not null")
    assert exact.agg(F.max(F.abs("error"))).first()[0] < 1e-9
    assert rows.agg(F.count("mase_scale")).first()[0] == 0


def test_drift_follows_a_trend(spark):
    # A year ahead the drift covers the whole step from the value it starts at.
    rows = L.rolling_forecasts(series(spark, seasonal(slope=0.5)))
    err = rows.filter("method = 'seasonal naive with drift' and horizon = 12").agg(F.max(F.abs("error"))).first()[0]
    assert err < 1e-9


def test_future_cannot_move_a_forecast(spark):
    values = seasonal(noise=2.0)
    late = values[:70] + [v + 1000 for v in values[70:]]
    cut = F.col("origin") <= F.lit(month(69))
    cols = ["origin", "method", "horizon", "forecast"]
    for make in (
        lambda v: L.rolling_forecasts(series(spark, v)).filter(cut).select(*cols),
        lambda v: FM.run(series(spark, v), learners={}, horizons=(1, 12)).filter(cut).select(*cols),
    ):
        a, b = (sorted(map(tuple, make(v).collect())) for v in (values, late))
        assert a and [x[:3] for x in a] == [x[:3] for x in b]
        assert all(math.isclose(x[3], y[3], rel_tol=1e-6) for x, y in zip(a, b))


def test_scale_counts_observations_not_months(spark):
    values = seasonal(60, noise=1.0)
    values[20] = values[33] = None
    seen = [v for v in values if v is not None]
    diffs = [abs(a - b) for a, b in zip(seen[12:], seen[:-12])]
    last = L.origin_state(series(spark, values)).orderBy(F.desc("month")).first()
    assert last.train_n == 58 and math.isclose(last.mase_scale, sum(diffs) / len(diffs))


def test_linear_models_against_direct_least_squares(spark):
    grid = series(spark, seasonal(80, noise=2.0, seed=4))
    folds = fold_rows(grid, 3).persist()
    got = {(r.origin, r.method): r.forecast for r in FM.linear_forecasts(folds, len(design_names(3))).collect()}
    origin = max(o for o, _ in got)
    rows = folds.filter(F.col("origin") == F.lit(origin)).collect()
    X = np.array([r.x for r in rows if not r.is_test])
    y = np.array([r.y for r in rows if not r.is_test])
    test = next(r for r in rows if r.is_test)
    A = np.column_stack([np.ones(len(X)), X])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert math.isclose(got[origin, "ordinary least squares"], beta[0] + np.dot(beta[1:], test.x) + test.level, rel_tol=1e-6)
    Xc, yc = X - X.mean(0), y - y.mean()
    r = np.linalg.solve(Xc.T @ Xc + np.eye(X.shape[1]), Xc.T @ yc)
    assert math.isclose(got[origin, "ridge"], y.mean() + (np.array(test.x) - X.mean(0)) @ r + test.level, rel_tol=1e-6)


def test_design_of_a_horizon_uses_only_older_values(spark):
    rows = build_design(series(spark, [float(i) for i in range(40)]), 6).filter(F.col("month") == F.lit(month(30))).first()
    assert (rows.flux_lag6, rows.flux_lag8, rows.flux_lag12) == (24.0, 22.0, 18.0)


def test_screening_keeps_signal_and_drops_noise(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(80):
        real, noise, season = rnd.gauss(0, 1), rnd.gauss(0, 1), math.sin(i)
        rows.append((month(i), [season, real, noise], 3 * real + rnd.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "month date, x array<double>, y double")
    kept = FM.boruta_select(df, ["sin_year", "real", "noise"], always_keep=["sin_year"], repeats=6, n_trees=10, depth=4, alpha=0.05)
    assert {r.predictor: r.kept for r in kept.collect()} == {"sin_year": True, "real": True, "noise": False}
    few = FM.boruta_select(df.limit(5), ["sin_year", "real", "noise"], always_keep=["sin_year"])
    assert few.filter("kept").count() == 3


def test_a_method_that_misses_a_month_leaves_it_unshared(spark):
    rows = [("f", m, "o", h, month(t), 1.0, 1.0, 1.0) for m in "ab" for h in (1, 3) for t in range(4)]
    rows = [r for r in rows if not (r[1] == "b" and r[3] == 1 and r[4] == month(2))]
    df = spark.createDataFrame(rows, "family string, method string, origin string, horizon int, target date, forecast double, actual double, mase_scale double")
    shared = {(r.horizon, r.target) for r in S.shared_targets(df).collect()}
    assert len(shared) == 7 and (1, month(2)) not in shared


def test_diebold_mariano_limits(spark):
    rnd = random.Random(8)
    rows = [("same", 1, month(i), e, e) for i, e in enumerate([rnd.gauss(0, 1) for _ in range(120)])]
    rows += [("worse", 1, month(i), 3 * e, e) for i, e in enumerate([rnd.gauss(0, 1) for _ in range(120)])]
    rows += [("short", 1, month(i), 1.0, 2.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, horizon int, target date, left double, right double")
    out = {r.k: r for r in S.diebold_mariano(df, keys=["k"]).collect()}
    assert out["same"].statistic == 0 and math.isclose(out["same"].p, 1.0)
    assert out["worse"].statistic > 5 and out["worse"].p < 1e-4 and out["worse"].mean_difference > out["worse"].margin
    assert out["short"].statistic is None and out["short"].margin is None


def test_folding_solver_agrees_on_awkward_models(spark):
    """A rare flag, tied rows, models with different numbers of terms, and dependent terms, by both routes."""
    rnd = random.Random(9)
    rows = []
    for i in range(1200):
        x = rnd.uniform(-2, 2)
        flag = 1.0 if i in (5, 600, 1100) else 0.0
        rows.append(("flag", [1.0, x, flag], 2 + 3 * x + 5 * flag + rnd.choice([-1, 1]) * rnd.expovariate(1.0)))
        rows.append(("short", [1.0, x], 1 - x + rnd.gauss(0, 1)))
        rows.append(("tied", [1.0, float(i % 3)], float(i % 5)))
        rows.append(("dependent", [1.0, x, 2 * x], x))
    df = spark.createDataFrame(rows, "g string, x array<double>, y double").withColumn("w", F.lit(1.0))
    whole = {r.g: r for r in lad.fit_arrays(df, ["g"], bounded=True).collect()}
    split = {r.g: r for r in lad.fit_arrays(df, ["g"], bounded=False, window=100).collect()}
    assert whole.keys() == split.keys() and split["dependent"].beta is None and split["dependent"].status == "dependent terms"
    for g in ("flag", "short", "tied"):
        cost = lambda b: sum(abs(y - sum(p * q for p, q in zip(x, b))) for k, x, y in rows if k == g)
        assert math.isclose(cost(whole[g].beta), cost(split[g].beta), rel_tol=1e-9), g
    assert np.allclose(whole["flag"].beta, split["flag"].beta, atol=1e-8)
    assert lad.fit_arrays(df.limit(0), ["g"], bounded=False).count() == 0


def test_a_key_without_reference_keeps_its_points(spark):
    points = spark.createDataFrame([(k, month(i), float(i)) for k in "ab" for i in range(4)], "k string, month date, v double")
    out = P.nearest_distance(points, points.filter("k = 'a'"), ["v"], keys=["k"]).collect()
    assert len(out) == 8 and all((r.distance is None) == (r.k == "b") for r in out)
    flat = points.filter("k = 'a'").withColumn("v", F.lit(1.0))
    assert {r.distance for r in P.nearest_distance(points.filter("k = 'a'"), flat, ["v"], keys=["k"], strict=False).collect()} == {None}


def test_trees_forecast_series_without_a_scale(spark):
    """An exactly periodic series has no scaled-error denominator and still gets its forecasts."""
    rnd = random.Random(4)
    rows = [(k, month(i), math.sin(i * math.pi / 6) + (rnd.gauss(0, 0.3) if k == "noisy" else 0.0)) for k in ("flat", "noisy") for i in range(72)]
    grid = spark.createDataFrame(rows, "site string, month date, value double")
    folds = fold_rows(grid, 1, keys=["site"])
    out = FM.pooled_forecasts(folds, design_names(1), {"forest": lambda: FM.forest(3, 3)}, refit_every=30, keys=["site"])
    assert {r.site for r in out.collect()} == {"flat", "noisy"} and out.filter("forecast is null").count() == 0
    assert FM.pooled_forecasts(folds.limit(0), design_names(1), {"forest": lambda: FM.forest(3, 3)}, keys=["site"]) is None


def test_forecast_run_with_learners_and_screening(spark):
    from functools import partial

    from fluxspark.forecast import models as M
    from fluxspark.plans.forecasts import QUERIES, forecast_whole

    assert "forecast_run_whole" in QUERIES
    rows = forecast_whole(
        spark, "/root/testdata/sf0.01", learners={"random forest": partial(M.forest, 2, 2)}, horizons=(1,), min_train=77,
        screen=partial(M.boruta_select, n_trees=2, depth=2)).collect()
    assert rows and {"random forest"} < {r.method for r in rows}
    assert all(r.n_predictors == len(r.predictors) > 0 for r in rows)
