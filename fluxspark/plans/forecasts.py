"""Queries over rolling-origin forecasts: benchmarks, designs, models, scores, panels."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.forecast import fold_trees as T
from fluxspark.forecast import folds as O
from fluxspark.forecast import models as M
from fluxspark.forecast import panels as P
from fluxspark.forecast import rolling as L
from fluxspark.forecast import scoring as S
from fluxspark.operators import months as N
from fluxspark.operators import stats as ST
from fluxspark.operators.common import attach, checkpointed, key_join
from fluxspark.operators.reshape import stack_labelled
from fluxspark.plans import bindings as B
from fluxspark.plans import densities as I
from fluxspark.plans.bindings import KEYS, ON, query
from fluxspark.plans.monthly import CALENDAR

QUERIES = {}
HORIZONS = ", ".join(f"({h})" for h in K.HORIZONS)

# What is known at an origin, by joining every earlier month.
STATE = """
  dd AS (SELECT site, month, value, value - lag(value, 12) OVER (PARTITION BY site ORDER BY month) AS dif FROM series WHERE value IS NOT NULL),
  st AS (SELECT s.site, s.month AS origin, count(d.value) AS train_n, arg_max(d.value, d.month) AS last_value, avg(d.value) AS overall_mean,
           coalesce(avg(dif), 0) / 12 AS drift, CASE WHEN avg(abs(dif)) > 1e-10 * greatest(avg(abs(d.value)), 1) THEN avg(abs(dif)) END AS mase_scale
         FROM series s JOIN dd d ON d.site = s.site AND d.month <= s.month GROUP BY 1, 2),
  ends AS (SELECT site, max(month) AS e FROM series GROUP BY 1),
  org AS (SELECT st.* FROM st JOIN ends USING (site) WHERE train_n >= {m} AND origin + INTERVAL 1 MONTH <= e)"""
FORE = STATE + f""",
  cand AS (SELECT o.*, h AS horizon, CAST(origin + h * INTERVAL 1 MONTH AS DATE) AS target FROM org o, (VALUES {HORIZONS}) t(h)),
  known AS (SELECT c.site, c.origin, c.horizon, arg_max(d.value, d.month) AS sn, avg(d.value) AS cl FROM cand c
            JOIN dd d ON d.site = c.site AND d.month <= c.origin AND month(d.month) = month(c.target) GROUP BY 1, 2, 3),
  base AS (SELECT c.*, sn, cl, y.value AS actual FROM cand c LEFT JOIN known k ON k.site = c.site AND k.origin = c.origin AND k.horizon = c.horizon
           LEFT JOIN series y ON y.site = c.site AND y.month = c.target)"""
METHODS = {"seasonal naive": "sn", "naive": "last_value", "climatology": "cl", "seasonal naive with drift": "sn + drift * horizon"}
# Two more column methods stand in for fitted families where SQL has to follow.
BLEND = {"blend": lambda h: (F.col(f"__sn{h}") + F.col(f"__cl{h}")) / 2, "shrunk": lambda h: F.col(f"__cl{h}") * 0.8 + F.col("last_value") * 0.2}
BLEND_SQL = {"blend": "(sn + cl) / 2", "shrunk": "cl * 0.8 + last_value * 0.2"}
EXTRA = {"blend": lambda h: F.col(f"__sn{h}") * 0.4 + F.col(f"__cl{h}") * 0.6}
EXTRA_SQL = {"blend": "sn * 0.4 + cl * 0.6"}


def rows_of(methods: dict[str, str], family: str | None = None, cond: str = "TRUE") -> str:
    fam = f", '{family}' AS family" if family else ""
    parts = [
        f"""SELECT site, origin, '{n}' AS method, horizon, target, {e} AS forecast, actual, train_n, mase_scale, actual - ({e}) AS error,
        abs(actual - ({e})) / mase_scale AS scaled{fam} FROM base WHERE {cond}""" for n, e in methods.items()]
    return " UNION ALL ".join(parts)


bench = lambda s, d: L.rolling_forecasts(B.series(s, d), keys=KEYS)


def families(s, d):
    series = checkpointed(B.series(s, d))
    return checkpointed(stack_labelled({
        "benchmarks": L.rolling_forecasts(series, keys=KEYS),
        "autoregressive": L.rolling_forecasts(series, BLEND, keys=KEYS),
        "exogenous": L.rolling_forecasts(series, EXTRA, min_train=54, keys=KEYS),
    }))


WITH1 = f"WITH {FORE.format(m=48)}, fr AS ({rows_of(METHODS)})"
WITHF = (f"WITH {FORE.format(m=48)}, fr AS ({rows_of(METHODS, 'benchmarks')} UNION ALL {rows_of(BLEND_SQL, 'autoregressive')} UNION ALL "
         f"{rows_of(EXTRA_SQL, 'exogenous', 'train_n >= 54')}), us AS (SELECT * FROM fr WHERE actual IS NOT NULL AND forecast IS NOT NULL AND mase_scale IS NOT NULL)")
SHARED = WITHF + """, sh AS (SELECT site, horizon, target FROM us GROUP BY 1, 2, 3 HAVING count(DISTINCT family || '/' || method) = 7),
  rs AS (SELECT fr.* FROM fr JOIN sh USING (site, horizon, target))"""
COLS = "site origin method i:horizon target *forecast *actual train_n *mase_scale *error *scaled"


def restricted(s, d):
    frame = families(s, d)
    return S.restrict(frame, S.shared_targets(frame, KEYS), KEYS)



QUERIES["rolling_forecasts"] = query(bench, "series", COLS, f"{WITH1} SELECT * FROM fr")
QUERIES["origin_state"] = query(
    lambda s, d: L.origin_state(B.series(s, d), keys=KEYS).filter("train_n > 0").select("site", F.col("month").alias("origin"), "train_n", "last_value", "overall_mean", "drift", "mase_scale"),
    "series", "site origin train_n *last_value *overall_mean *drift *mase_scale", f"WITH {STATE.format(m=48)} SELECT * FROM st")
QUERIES["forecast_origins"] = query(
    lambda s, d: L.forecast_origins(L.origin_state(B.series(s, d), keys=KEYS), keys=KEYS).select("site", F.col("month").alias("origin"), "train_n"),
    "series", "site origin train_n", f"WITH {STATE.format(m=48)} SELECT site, origin, train_n FROM org")
for name in L.BENCHMARKS:
    QUERIES["benchmark_" + name.replace(" ", "_")] = query(
        lambda s, d, name=name: L.rolling_forecasts(B.series(s, d), {name: L.BENCHMARKS[name]}, keys=KEYS).select("site", "origin", "horizon", "target", "forecast"),
        "series", "site origin i:horizon target *forecast", f"{WITH1} SELECT * FROM fr WHERE method = '{name}'")


def pandas_naive(train, horizons):
    return [train.dropna().iloc[-1]] * len(horizons)


QUERIES["rolling_custom"] = query(
    lambda s, d: L.rolling_custom(B.series(s, d), {"naive": pandas_naive}, keys=KEYS), "series", COLS, f"{WITH1} SELECT * FROM fr WHERE method = 'naive'")
QUERIES["seasonal_adjustment"] = query(
    lambda s, d: O.apply_adjustment(B.series(s, d), O.seasonal_adjustment(B.series(s, d).filter("month < date'1999-01-01'"), keys=KEYS), keys=KEYS),
    "series", "site month *value",
    """SELECT s.site, s.month, s.value - coalesce(m, o) AS value FROM series s JOIN (SELECT site, avg(value) AS o FROM series WHERE month < DATE '1999-01-01' GROUP BY 1) a ON a.site = s.site
       LEFT JOIN (SELECT site, month(month) AS moy, avg(value) AS m FROM series WHERE month < DATE '1999-01-01' GROUP BY 1, 2) c ON c.site = s.site AND c.moy = month(s.month)""")
panel = lambda s, d: key_join(B.series(s, d), B.covariates(s, d).select(*ON, "soil_temp_f", "wte_m"), ON)
LAG = lambda c, k, a: f"(SELECT site, CAST(month + INTERVAL {k} MONTH AS DATE) AS month, {c} AS {a} FROM p)"
D3 = [("value", k, f"flux_lag{k}") for k in (3, 4, 5, 12)] + [(c, k, f"{c}_lag{k}") for c in ("soil_temp_f", "wte_m") for k in (3, 4)]
QUERIES["build_design_forecast"] = query(
    lambda s, d: O.build_design(panel(s, d), 3, ["soil_temp_f", "wte_m"], keys=KEYS).select(*ON, *O.design_names(3, ["soil_temp_f", "wte_m"])),
    "series cov", "site month *sin_year *cos_year *year_fraction " + " ".join(f"*{a}" for _, _, a in D3),
    "WITH p AS (SELECT s.site, s.month, s.value, soil_temp_f, wte_m FROM series s LEFT JOIN cov c ON c.site = s.site AND c.month = s.month) SELECT p.site, p.month, sin(2 * pi() * month(p.month) / 12) AS sin_year, "
    "cos(2 * pi() * month(p.month) / 12) AS cos_year, (month(p.month) - 1) / 12.0 AS year_fraction, " + ", ".join(a for _, _, a in D3) + " FROM p "
    + " ".join(f"LEFT JOIN {LAG(c, k, a)} t{i} ON t{i}.site = p.site AND t{i}.month = p.month" for i, (c, k, a) in enumerate(D3)))
# Fold sizes and the season taken off each row, by joining every fold with its months.
QUERIES["fold_rows"] = query(
    lambda s, d: O.fold_rows(B.series(s, d), 1, keys=KEYS).select("site", "origin", "month", "is_test", "y", F.col("x")[3].alias("flux_lag1"), F.col("x")[6].alias("flux_lag12"), "level", "n_rows"),
    "series", "site origin month is_test *y *flux_lag1 *flux_lag12 *level n_rows",
    f"""WITH {STATE.format(m=48)},
        cl AS (SELECT o.site, o.origin, g.moy, coalesce(avg(d.value), max(o.overall_mean)) AS level FROM org o, (SELECT unnest(range(1, 13)) AS moy) g
               LEFT JOIN dd d ON d.site = o.site AND d.month <= o.origin AND month(d.month) = g.moy GROUP BY 1, 2, 3),
        ad AS (SELECT c.site, c.origin, s.month, s.value - level AS a, level FROM cl c JOIN series s ON s.site = c.site AND month(s.month) = c.moy AND s.month <= c.origin + INTERVAL 1 MONTH),
        rw AS (SELECT a.site, a.origin, a.month, a.month > a.origin AS is_test, a.a AS y, l1.a AS flux_lag1, l12.a AS flux_lag12, a.level FROM ad a
               JOIN ad l1 ON l1.site = a.site AND l1.origin = a.origin AND l1.month = a.month - INTERVAL 1 MONTH JOIN ad l2 ON l2.site = a.site AND l2.origin = a.origin AND l2.month = a.month - INTERVAL 2 MONTH
               JOIN ad l3 ON l3.site = a.site AND l3.origin = a.origin AND l3.month = a.month - INTERVAL 3 MONTH JOIN ad l12 ON l12.site = a.site AND l12.origin = a.origin AND l12.month = a.month - INTERVAL 12 MONTH
               WHERE l1.a IS NOT NULL AND l2.a IS NOT NULL AND l3.a IS NOT NULL AND l12.a IS NOT NULL AND (a.a IS NOT NULL OR a.month > a.origin))
        SELECT * FROM (SELECT *, count(*) FILTER (NOT is_test) OVER (PARTITION BY site, origin) AS n_rows, count(*) FILTER (is_test) OVER (PARTITION BY site, origin) AS n_test FROM rw)
        WHERE n_rows >= 24 AND n_test = 1""")
QUERIES["linear_forecasts"] = query(lambda s, d: M.linear_forecasts(O.fold_rows(panel(s, d), 1, ["soil_temp_f", "wte_m"], keys=KEYS), 11, KEYS))
QUERIES["pooled_tree_forecasts"] = query(
    lambda s, d: M.pooled_forecasts(
        O.fold_rows(B.series(s, d), 12, keys=KEYS), O.design_names(12),
        {"random forest": partial(M.forest, 30, 6), "gradient boosting": partial(M.boosting, 15, 3)}, refit_every=24, keys=KEYS))
QUERIES["boruta_select"] = query(
    lambda s, d: _kept(s, O.fold_rows(panel(s, d), 1, ["soil_temp_f", "wte_m"], keys=KEYS), O.design_names(1, ["soil_temp_f", "wte_m"])))


def _kept(spark, folds, names):
    """The screening of the last origin, with its origin."""
    last = folds.agg(F.max("origin").alias("o"))
    train = M.scaled_folds(folds.filter(~F.col("is_test")).join(last, F.col("origin") == F.col("o")), names, KEYS)
    kept = M.boruta_select(train, names, n_trees=20, depth=5, group=KEYS).filter("kept").select("predictor")
    return attach(kept, last.select(F.col("o").alias("origin"))).select("origin", "predictor")


def model_frame(s, d):
    """Linear models of both families beside the benchmarks."""
    grid = checkpointed(panel(s, d))
    both = [M.run(grid, c, learners={}, horizons=(1, 6), keys=KEYS) for c in ((), ("soil_temp_f", "wte_m"))]
    return checkpointed(
        stack_labelled({"benchmarks": bench(s, d).filter("horizon in (1, 6)"), "autoregressive": both[0], "exogenous": both[1]})
    )


_FITTED = {}


def forecast_whole(s, d, **less):
    """Pooled trees of all series with covariates; by default all learners, all horizons, screening and refits at every origin."""
    return M.run(checkpointed(panel(s, d)), ("soil_temp_f", "wte_m"), **({"screen": M.boruta_select, "keys": KEYS} | less))


def fitted(s, d):
    """All learners with covariates, all horizons, screening and a new fit at every origin of every series; computed once a session and input."""
    key = s.sparkContext.applicationId, d
    if key not in _FITTED:
        _FITTED[key] = checkpointed(T.run_folds(checkpointed(panel(s, d)), ("soil_temp_f", "wte_m"), keys=KEYS))
    return _FITTED[key]


def fitted_families(s, d):
    """The fitted methods as one family beside the benchmarks."""
    return stack_labelled({"benchmarks": bench(s, d), "fitted": fitted(s, d).drop("n_predictors", "predictors")})


def fitted_restricted(s, d):
    frame = fitted_families(s, d)
    return S.restrict(frame, S.shared_targets(frame, KEYS), KEYS)


QUERIES["forecast_run_whole"] = query(lambda s, d: fitted(s, d).drop("predictors"))
QUERIES["fitted_leaderboard"] = query(lambda s, d: S.leaderboard(fitted_families(s, d), keys=KEYS))
QUERIES["fitted_predictor_frequency"] = query(lambda s, d: S.predictor_frequency(fitted(s, d), KEYS))
QUERIES["fitted_screening_panel"] = query(lambda s, d: P.screening_panel(fitted(s, d), B.COVARIATES, keys=KEYS))
QUERIES["fitted_best_against_reference"] = query(lambda s, d: S.best_against_reference(fitted_restricted(s, d), keys=KEYS))
QUERIES["forecast_run"] = query(lambda s, d: M.run(panel(s, d), ("soil_temp_f",), learners={}, horizons=(1, 3), keys=KEYS).drop("predictors"))
QUERIES["model_leaderboard"] = query(lambda s, d: S.leaderboard(model_frame(s, d), keys=KEYS))

# ---- scores -----------------------------------------------------------------------------------------

SC = """count(*) AS n, avg(scaled) AS mase, quantile_cont(scaled, 0.5) AS mase_median, quantile_cont(scaled, 0.25) AS mase_q25, quantile_cont(scaled, 0.75) AS mase_q75,
  avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(CASE WHEN scaled < 1 THEN 1 ELSE 0 END) AS share_beating_snaive"""
SCC = "n *mase *mase_median *mase_q25 *mase_q75 *mae *rmse *share_beating_snaive"
OK = "actual IS NOT NULL AND forecast IS NOT NULL AND mase_scale IS NOT NULL"
QUERIES["score"] = query(
    lambda s, d: S.score(bench(s, d), KEYS), "series", f"site method i:horizon {SCC}", f"{WITH1} SELECT site, method, horizon, {SC} FROM fr WHERE {OK} GROUP BY 1, 2, 3")
QUERIES["score_pooled"] = query(
    lambda s, d: S.score(bench(s, d), pooled=True), "series", f"method i:horizon {SCC}", f"{WITH1} SELECT method, horizon, {SC} FROM fr WHERE {OK} GROUP BY 1, 2")
MN = list(METHODS)
QUERIES["relative_to"] = query(
    lambda s, d: S.relative_to(bench(s, d), MN, keys=KEYS), "series", "site i:horizon " + " ".join("*" + m.replace(" ", "_") for m in MN),
    f"""{WITH1} SELECT site, horizon, {", ".join(f"avg(abs(error)) FILTER (method = '{m}') / avg(abs(error)) FILTER (method = 'seasonal naive') AS {m.replace(' ', '_')}" for m in MN)}
        FROM fr WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY 1, 2""")
OS = f"count(DISTINCT origin) FILTER ({OK}) AS origins, count(DISTINCT target) FILTER ({OK}) AS distinct_targets, count(*) FILTER ({OK}) AS scored_forecasts, count(*) FILTER (actual IS NULL) AS dropped_target_not_observed"
OSC = "origins distinct_targets scored_forecasts dropped_target_not_observed"
QUERIES["origin_summary"] = query(lambda s, d: S.origin_summary(bench(s, d), KEYS), "series", f"site {OSC}", f"{WITH1} SELECT site, {OS} FROM fr GROUP BY 1")
QUERIES["per_origin"] = query(
    lambda s, d: S.per_origin(bench(s, d), 3, MN, KEYS), "series", "site origin " + " ".join("*" + m.replace(" ", "_") for m in MN),
    f"""{WITH1} SELECT site, origin, {", ".join(f"avg(scaled) FILTER (method = '{m}') AS {m.replace(' ', '_')}" for m in MN)} FROM fr WHERE horizon = 3 AND scaled IS NOT NULL GROUP BY 1, 2""")
QUERIES["best_method"] = query(
    lambda s, d: S.best_method(S.score(bench(s, d), KEYS), keys=KEYS), "series", "site i:horizon method *mase",
    f"{WITH1} SELECT site, horizon, arg_min(method, mase) AS method, min(mase) AS mase FROM (SELECT site, method, horizon, {SC} FROM fr WHERE {OK} GROUP BY 1, 2, 3) GROUP BY 1, 2")
QUERIES["shared_targets"] = query(lambda s, d: S.shared_targets(families(s, d), KEYS), "series", "site i:horizon target", f"{SHARED} SELECT * FROM sh")
QUERIES["restrict"] = query(restricted, "series", COLS + " family", f"{SHARED} SELECT * FROM rs")
QUERIES["leaderboard"] = query(
    lambda s, d: S.leaderboard(families(s, d), keys=KEYS), "series", f"site family method i:horizon {SCC} *vs_best_benchmark",
    f"""{SHARED} SELECT *, round_even(mase / min(mase) FILTER (family = 'benchmarks') OVER (PARTITION BY site, horizon), 3) AS vs_best_benchmark
        FROM (SELECT site, family, method, horizon, {SC} FROM rs WHERE {OK} GROUP BY 1, 2, 3, 4)""")
WIDE = [("benchmarks", "climatology"), ("autoregressive", "blend"), ("exogenous", "blend")]
WN = lambda f, m: f"{f[:4]}/{m}"
QUERIES["errors_at"] = query(
    lambda s, d: S.errors_at(restricted(s, d), 1, WIDE, KEYS), "series", "site target " + " ".join("*" + WN(*w) for w in WIDE),
    f"""{SHARED} SELECT site, target, {", ".join(f"avg(error) FILTER (family = '{f}' AND method = '{m}') AS \"{WN(f, m)}\"" for f, m in WIDE)} FROM rs WHERE horizon = 1 GROUP BY 1, 2""")


def dm_pairs(s, d):
    rows = bench(s, d)
    pick = lambda m: F.max(F.when(F.col("method") == m, F.col("error")))
    return rows.groupBy("site", "horizon", "target").agg(pick("climatology").alias("left"), pick("seasonal naive").alias("right"))


DM = lambda src, part: f"""dmx AS (SELECT *, abs(l) - abs(r) AS dl FROM {src} WHERE l IS NOT NULL AND r IS NOT NULL),
  dmn AS (SELECT {part}, count(*) AS n, avg(dl) AS mean_difference, greatest(horizon - 1, CAST(floor(4 * (count(*) / 100.0) ** (2 / 9.0)) AS INT)) AS lag FROM dmx GROUP BY {part}),
  dmk AS (SELECT x.*, dl - mean_difference AS c, n, lag, row_number() OVER (PARTITION BY {part} ORDER BY target) AS k FROM dmx x JOIN dmn USING ({part})),
  dmg AS (SELECT {part}, sum(c * c) / max(n) AS g0 FROM dmk GROUP BY {part}),
  dml AS (SELECT {part}, sum(2 * (1 - (a.k - b.k) / (a.lag + 1.0)) * a.c * b.c / a.n) AS ex FROM dmk a JOIN dmk b USING ({part}) WHERE a.k - b.k BETWEEN 1 AND a.lag GROUP BY {part}),
  dmr AS (SELECT {part}, n, lag, mean_difference, g0, greatest(g0 + coalesce(ex, 0), 1e-12) AS v,
     sqrt(greatest((n + 1 - 2 * horizon + horizon * (horizon - 1) / n::DOUBLE) / n, 1e-12)) AS corr FROM dmn JOIN dmg USING ({part}) LEFT JOIN dml USING ({part}))"""
DMOUT = "n, lag, mean_difference / sqrt(v / n) * corr AS statistic, CASE WHEN g0 > 0 THEN n * g0 / v END AS effective_n, mean_difference"
QUERIES["diebold_mariano"] = query(
    lambda s, d: S.diebold_mariano(dm_pairs(s, d), keys=KEYS).drop("p", "margin"), "series", "site i:horizon n i:lag *statistic *effective_n *mean_difference",
    f"""{WITH1}, pr AS (SELECT site, horizon, target, max(error) FILTER (method = 'climatology') AS l, max(error) FILTER (method = 'seasonal naive') AS r FROM fr GROUP BY 1, 2, 3),
        {DM("pr", "site, horizon")} SELECT site, horizon, {DMOUT} FROM dmr""", 7)
PAIRED = f"""{WITH1}, pr AS (SELECT site, horizon, target, max(error) FILTER (method = 'climatology') AS l, max(error) FILTER (method = 'seasonal naive') AS r FROM fr GROUP BY 1, 2, 3),
        {DM("pr", "site, horizon")}"""
QUERIES["diebold_mariano_p"] = query(
    lambda s, d: S.diebold_mariano(dm_pairs(s, d), keys=KEYS).select("site", "horizon", "p"), "series", "site i:horizon *p",
    f"{PAIRED} SELECT site, horizon, {I.t_p('t', 'n - 1')} AS p FROM (SELECT *, mean_difference / sqrt(v / n) * corr AS t FROM dmr)", 7)
QUERIES["significance_margin"] = query(
    lambda s, d: S.significance_margin(dm_pairs(s, d), keys=KEYS), "series", "site i:horizon n *margin",
    f"{PAIRED} SELECT site, horizon, n, q * sqrt(v / n) / corr AS margin FROM dmr JOIN {I.t_quantiles('(SELECT n - 1 AS df FROM dmr)')} c ON c.df = n - 1", 6)


def predictors(s, d):
    """Forecast rows with a predictor list that varies by month."""
    extra = F.when(F.month("origin") % 2 == 0, "soil_temp_f_lag1").when(F.month("origin") % 3 == 0, "wte_m_lag2")
    yearly = F.when(F.year("origin") < 2001, "flux_lag12")
    lag1 = F.when(F.col("horizon") == 1, "flux_lag1")
    return bench(s, d).withColumn("predictors", F.array_compact(F.array(F.lit("sin_year"), extra, yearly, lag1)))


PF = f"""{WITH1}, fo AS (SELECT DISTINCT site, horizon, origin FROM fr), kp AS (
  SELECT site, horizon, origin, 'sin_year' AS predictor FROM fo UNION ALL
  SELECT site, horizon, origin, CASE WHEN month(origin) % 2 = 0 THEN 'soil_temp_f_lag1' ELSE 'wte_m_lag2' END FROM fo WHERE month(origin) % 2 = 0 OR month(origin) % 3 = 0 UNION ALL
  SELECT site, horizon, origin, 'flux_lag12' FROM fo WHERE year(origin) < 2001 UNION ALL SELECT site, horizon, origin, 'flux_lag1' FROM fo WHERE horizon = 1),
  pf AS (SELECT site, horizon, predictor, count(*) AS folds, round_even(count(*) / max(t)::DOUBLE, 3) AS share FROM kp JOIN (SELECT site, horizon, count(*) AS t FROM fo GROUP BY 1, 2) USING (site, horizon) GROUP BY 1, 2, 3)"""
freq = lambda s, d: S.predictor_frequency(predictors(s, d), KEYS)
QUERIES["predictor_frequency"] = query(freq, "series", "site i:horizon predictor folds *share", f"{PF} SELECT * FROM pf")
SV = "(SELECT site, predictor, " + ", ".join(f"coalesce(max(share) FILTER (horizon = {h}), 0) AS h{h}" for h in K.HORIZONS) + " FROM pf GROUP BY 1, 2)"
QUERIES["survival_table"] = query(
    lambda s, d: S.survival_table(freq(s, d), keys=KEYS), "series", "site predictor *h1 *h3 *h6 *h12", f"{PF} SELECT * FROM {SV}")
QUERIES["survivors_worth_testing"] = query(
    lambda s, d: S.survivors_worth_testing(S.survival_table(freq(s, d), keys=KEYS), B.COVARIATES), "series", "site predictor *h1 *h3 *h6 *h12",
    f"{PF} SELECT * FROM {SV} WHERE regexp_extract(predictor, '^(.*)_lag[0-9]+$', 1) IN ('soil_temp_f', 'atm_temp_f', 'precip_in', 'wte_m') AND greatest(h1, h3, h6, h12) >= 0.25")
DRV = """CASE WHEN predictor = 'flux_lag1' AND horizon = 1 THEN 'flux, one month' WHEN predictor = 'flux_lag12' THEN 'flux, one year'
  WHEN predictor = 'soil_temp_f_lag1' THEN 'soil_temp_f' WHEN predictor = 'wte_m_lag2' THEN 'wte_m' END"""
SPANEL = f"""(SELECT e.site, e.driver, e.horizon, CASE WHEN e.driver = 'flux, one month' AND e.horizon <> 1 THEN NULL ELSE coalesce(m, 0) END AS share
  FROM (SELECT DISTINCT site, horizon, driver FROM fr, (VALUES ('flux, one month'), ('flux, one year'), ('soil_temp_f'), ('atm_temp_f'), ('precip_in'), ('wte_m')) t(driver)) e
  LEFT JOIN (SELECT site, horizon, {DRV} AS driver, max(share) AS m FROM pf GROUP BY 1, 2, 3) b USING (site, horizon, driver))"""
spanel = lambda s, d: P.screening_panel(predictors(s, d), B.COVARIATES, keys=KEYS)
QUERIES["screening_panel"] = query(spanel, "series", "site driver i:horizon *share", f"{PF} SELECT * FROM {SPANEL}")
QUERIES["screening_panel_calendar"] = query(
    lambda s, d: P.with_calendar_share(spanel(s, d), ST.explained_by_calendar(B.covariates(s, d), B.COVARIATES, KEYS), KEYS), "series long_cov",
    "site driver i:horizon *share *calendar_share",
    f"{PF} SELECT p.site, p.driver, horizon, share, explained AS calendar_share FROM {SPANEL} p LEFT JOIN ({CALENDAR}) e ON e.site = p.site AND e.covariate = p.driver")
QUERIES["usage_order"] = query(
    lambda s, d: P.usage_order(spanel(s, d)), "series", "driver *mean_share i:rank",
    f"{PF} SELECT driver, avg(share) AS mean_share, row_number() OVER (ORDER BY round(avg(share), 9) DESC, driver) AS rank FROM {SPANEL} GROUP BY driver")
YR = f"""(SELECT *, 100 * s / sum(s) OVER (PARTITION BY site) AS share_of_total_error FROM (SELECT site, year(target) AS year, count(*) AS n, avg(scaled) AS mean, quantile_cont(scaled, 0.5) AS median,
  max(scaled) AS max, avg(CASE WHEN scaled > 1 THEN 1 ELSE 0 END) AS share_above_1, sum(scaled) AS s FROM fr WHERE method = 'climatology' AND scaled IS NOT NULL GROUP BY 1, 2))"""
QUERIES["error_by_year"] = query(
    lambda s, d: S.error_by_year(bench(s, d), keys=KEYS), "series", "site i:year n *mean *median *max *share_above_1 *share_of_total_error", f"{WITH1} SELECT * FROM {YR}")
QUERIES["worst_years"] = query(
    lambda s, d: S.worst_years(S.error_by_year(bench(s, d), keys=KEYS), keys=KEYS), "series", "site *error_share_pct *forecast_share_pct",
    f"""{WITH1} SELECT site, sum(share_of_total_error) FILTER (k <= 2) AS error_share_pct, 100.0 * sum(n) FILTER (k <= 2) / sum(n) AS forecast_share_pct
        FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY share_of_total_error DESC, year) AS k FROM {YR}) GROUP BY 1""")
QUERIES["scale_comparability"] = query(
    lambda s, d: S.scale_comparability(bench(s, d), keys=KEYS), "series", "site *scale_mean *scale_first *scale_last *out_of_sample_mae *ratio",
    f"""{WITH1} SELECT site, m AS scale_mean, f AS scale_first, l AS scale_last, e AS out_of_sample_mae, e / m AS ratio FROM (SELECT site, avg(s) AS m, arg_min(s, origin) AS f, arg_max(s, origin) AS l
        FROM (SELECT site, origin, max(mase_scale) AS s FROM fr WHERE mase_scale IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        JOIN (SELECT site, avg(abs(error)) AS e FROM fr WHERE method = 'seasonal naive' AND actual IS NOT NULL AND forecast IS NOT NULL GROUP BY 1) USING (site)""")
QUERIES["min_train_sensitivity"] = query(
    lambda s, d: S.min_train_sensitivity(B.series(s, d), keys=KEYS), "series",
    f"site i:min_train {OSC} first_scored *obs_per_month *ratio_h1 *ratio_h3 *ratio_h6 *ratio_h12",
    f"""WITH {FORE.format(m=36)}, fr AS ({rows_of(METHODS)}) SELECT site, m AS min_train, {OS}, min(target) FILTER (actual IS NOT NULL) AS first_scored, min(train_n) / 12.0 AS obs_per_month,
        {", ".join(f"avg(abs(error)) FILTER (method = 'climatology' AND horizon = {h}) / avg(abs(error)) FILTER (method = 'seasonal naive' AND horizon = {h}) AS ratio_h{h}" for h in K.HORIZONS)}
        FROM fr JOIN (VALUES (36), (48), (60), (72)) t(m) ON train_n >= m GROUP BY 1, 2""")
SAVE = """(SELECT site, target, avg(error) FILTER (family = 'benchmarks' AND method = 'climatology') AS r, avg(error) FILTER (family = 'autoregressive' AND method = 'blend') AS l, 1 AS horizon
  FROM rs WHERE horizon = 1 GROUP BY 1, 2)"""
QUERIES["savings_by_year"] = query(
    lambda s, d: S.savings_by_year(restricted(s, d), "autoregressive", "blend", keys=KEYS), "series", "site i:year months *saved *per_month",
    f"{SHARED} SELECT site, year(target) AS year, count(*) AS months, sum(abs(r) - abs(l)) AS saved, avg(abs(r) - abs(l)) AS per_month FROM {SAVE} GROUP BY 1, 2")
QUERIES["savings_with_without"] = query(
    lambda s, d: S.savings_with_without(restricted(s, d), "autoregressive", "blend", 2000, keys=KEYS).drop("p"), "series",
    "site months i:horizon n i:lag *statistic *effective_n *mean_difference *saved",
    f"""{SHARED}, sv AS (SELECT s.*, m AS months FROM {SAVE} s, (VALUES ('all'), ('without'), ('only')) t(m) WHERE m = 'all' OR (m = 'only') = (year(target) = 2000)),
        {DM("sv", "site, months, horizon")} SELECT site, months, horizon, n, CASE WHEN n >= 8 THEN lag END AS lag, CASE WHEN n >= 8 THEN mean_difference / sqrt(v / n) * corr END AS statistic,
        CASE WHEN n >= 8 AND g0 > 0 THEN n * g0 / v END AS effective_n, CASE WHEN n >= 8 THEN mean_difference END AS mean_difference, saved
        FROM dmr JOIN (SELECT site, months, sum(abs(r) - abs(l)) AS saved FROM sv GROUP BY 1, 2) USING (site, months)""", 7)
QUERIES["savings_per_method"] = query(
    lambda s, d: S.savings_per_method(restricted(s, d), 2000, keys=KEYS), "series", "site family method *saved",
    f"""{SHARED}, ls AS (SELECT site, family, method, sum(abs(error)) AS e FROM rs WHERE horizon = 1 AND year(target) = 2000 GROUP BY 1, 2, 3) SELECT a.site, a.family, a.method, b.e - a.e AS saved
        FROM ls a JOIN ls b ON a.site = b.site AND b.family = 'benchmarks' AND b.method = 'climatology' WHERE NOT (a.family = 'benchmarks' AND a.method = 'climatology')""")
BEST = """er AS (SELECT site, horizon, family, method, target, avg(error) AS e FROM rs GROUP BY ALL), ma AS (SELECT site, horizon, family, method, avg(abs(e)) AS m FROM er WHERE family <> 'benchmarks' GROUP BY ALL),
  bs AS (SELECT site, horizon, family, method FROM (SELECT *, row_number() OVER (PARTITION BY site, horizon ORDER BY m, family, method) AS k FROM ma) WHERE k = 1),
  bp AS (SELECT e.site, e.horizon, e.target, e.e AS l, c.e AS r FROM er e JOIN bs USING (site, horizon, family, method) JOIN er c ON c.site = e.site AND c.horizon = e.horizon AND c.target = e.target
         AND c.family = 'benchmarks' AND c.method = 'climatology')"""
QUERIES["best_against_reference"] = query(
    lambda s, d: S.best_against_reference(restricted(s, d), keys=KEYS).drop("p", "margin", "sign_test_p"), "series",
    "site i:horizon n i:lag *statistic *effective_n *mean_difference family method wins n_months",
    f"""{SHARED}, {BEST}, {DM("bp", "site, horizon")} SELECT site, horizon, {DMOUT}, family, method, wins, n_months FROM dmr JOIN bs USING (site, horizon)
        JOIN (SELECT site, horizon, count(*) FILTER (abs(r) > abs(l)) AS wins, count(*) AS n_months FROM bp GROUP BY 1, 2) USING (site, horizon)""", 7)
QUERIES["best_against_reference_p"] = query(
    lambda s, d: S.best_against_reference(restricted(s, d), keys=KEYS).select("site", "horizon", "p", "sign_test_p"), "series", "site i:horizon *p *sign_test_p",
    f"""{SHARED}, {BEST}, {DM("bp", "site, horizon")} SELECT site, horizon, {I.t_p("t", "n - 1")} AS p, {I.sign_test_p("wins", "n_months")} AS sign_test_p
        FROM (SELECT *, mean_difference / sqrt(v / n) * corr AS t FROM dmr JOIN (SELECT site, horizon, count(*) FILTER (abs(r) > abs(l)) AS wins, count(*) AS n_months FROM bp GROUP BY 1, 2) USING (site, horizon))""", 7)
GROUPS = {"seasonal naive": "simple", "naive": "simple", "climatology": "mean"}
QUERIES["group_contrast"] = query(
    lambda s, d: S.group_contrast(restricted(s, d).filter("family = 'benchmarks' and method <> 'seasonal naive with drift'"), GROUPS, "mean", "simple", KEYS).drop("p", "margin"), "series",
    "site family i:horizon n i:lag *statistic *effective_n *mean_difference",
    f"""{SHARED}, gp AS (SELECT site, family, horizon, target, avg(abs(error)) FILTER (method = 'climatology') AS l, avg(abs(error)) FILTER (method IN ('naive', 'seasonal naive')) AS r FROM rs
        WHERE family = 'benchmarks' GROUP BY 1, 2, 3, 4), {DM("gp", "site, family, horizon")} SELECT site, family, horizon, {DMOUT} FROM dmr""", 7)

# ---- panels --------------------------------------------------------------------------------------------

QUERIES["forecast_panel"] = query(
    lambda s, d: P.forecast_panel(families(s, d), keys=KEYS).drop("margin"), "series",
    "site i:horizon *fitted_low *fitted_high *seasonal_naive *naive *climatology *seasonal_naive_with_drift n *effective_n",
    f"""{SHARED}, {BEST}, {DM("bp", "site, horizon")}, al AS (SELECT site, horizon, family, method, avg(abs(e)) AS m FROM er GROUP BY ALL)
        SELECT site, horizon, min(m) FILTER (family <> 'benchmarks') AS fitted_low, max(m) FILTER (family <> 'benchmarks') AS fitted_high,
        {", ".join(f"max(m) FILTER (family = 'benchmarks' AND method = '{b}') AS {b.replace(' ', '_')}" for b in MN)}, max(n) AS n, max(n * g0 / v) AS effective_n
        FROM al JOIN dmr USING (site, horizon) GROUP BY 1, 2""", 7)
QUERIES["flux_panel"] = query(
    lambda s, d: P.flux_panel(B.series(s, d), families(s, d), keys=KEYS), "series", "site month *value *climatology *fitted_low *fitted_high",
    f"""{SHARED} SELECT s.site, s.month, s.value, climatology, fitted_low, fitted_high FROM series s LEFT JOIN (SELECT site, target, max(forecast) FILTER (family = 'benchmarks' AND method = 'climatology') AS climatology,
        min(forecast) FILTER (family <> 'benchmarks') AS fitted_low, max(forecast) FILTER (family <> 'benchmarks') AS fitted_high FROM rs WHERE horizon = 1 GROUP BY 1, 2) p ON p.site = s.site AND p.target = s.month""")
AP = """(SELECT site, target, max(actual) AS measured, min(forecast) FILTER (family <> 'benchmarks') AS lowest, max(forecast) FILTER (family <> 'benchmarks') AS highest,
  quantile_cont(forecast, 0.5) FILTER (family <> 'benchmarks') AS middle, max(forecast) FILTER (family = 'benchmarks' AND method = 'climatology') AS seasonal FROM rs WHERE horizon = 1 GROUP BY 1, 2)"""
ap = lambda s, d: P.agreement_panel(families(s, d), keys=KEYS)
APC = "site target *measured *lowest *highest *middle *seasonal"
QUERIES["agreement_panel"] = query(ap, "series", APC, f"{SHARED} SELECT * FROM {AP}")
QUERIES["agreement_errors"] = query(
    lambda s, d: P.agreement_errors(ap(s, d), KEYS), "series", APC,
    f"{SHARED} SELECT site, target, measured, measured - highest AS lowest, measured - lowest AS highest, measured - middle AS middle, measured - seasonal AS seasonal FROM {AP}")
QUERIES["agreement_summary"] = query(
    lambda s, d: P.agreement_summary(ap(s, d), KEYS).drop("tilt_p"), "series", "site months *brackets *same_way *tilt",
    f"""{SHARED} SELECT site, count(*) AS months, avg(CASE WHEN measured BETWEEN lowest AND highest THEN 1 ELSE 0 END) AS brackets,
        avg(CASE WHEN sign(middle - measured) = sign(seasonal - measured) THEN 1 ELSE 0 END) AS same_way, regr_slope(measured - middle, measured) AS tilt FROM {AP} GROUP BY 1""")
TH = """, mi AS (SELECT site, target, abs(actual) AS size, abs(forecast - actual) AS miss FROM rs WHERE horizon = 1 AND family <> 'benchmarks'),
  eg AS (SELECT site, quantile_cont(size, 1 / 3.0) AS a, quantile_cont(size, 2 / 3.0) AS b FROM (SELECT DISTINCT site, target, size FROM mi) GROUP BY 1),
  ms AS (SELECT mi.*, CASE WHEN size <= a THEN 1 WHEN size <= b THEN 2 ELSE 3 END AS third FROM mi JOIN eg USING (site))"""
QUERIES["miss_by_size"] = query(
    lambda s, d: P.miss_by_size(families(s, d), keys=KEYS), "series", "site i:third n *mean_miss *root_mean_square *relative_miss",
    f"{SHARED}{TH} SELECT site, third, count(*) AS n, avg(miss) AS mean_miss, sqrt(avg(miss * miss)) AS root_mean_square, avg(miss / size) AS relative_miss FROM ms GROUP BY 1, 2")
QUERIES["size_matched_year_ratio"] = query(
    lambda s, d: P.size_matched_year_ratio(families(s, d), keys=KEYS), "series", "site i:year *mean_miss *ratio",
    f"""{SHARED}{TH} SELECT site, year(target) AS year, avg(miss) AS mean_miss, avg(miss) / avg(t) AS ratio FROM ms JOIN (SELECT site, third, avg(miss) AS t FROM ms GROUP BY 1, 2) USING (site, third) GROUP BY 1, 2""")
QUERIES["forecast_span"] = query(
    lambda s, d: N.forecast_span(bench(s, d), B.series(s, d), KEYS), "series", "site first last n_months lead_from",
    f"""{WITH1} SELECT site, min(target) AS "first", max(target) AS "last", count(DISTINCT target) AS n_months, max(l) AS lead_from FROM fr
        JOIN (SELECT site, min(month) AS l FROM series WHERE value IS NOT NULL GROUP BY 1) USING (site) WHERE actual IS NOT NULL GROUP BY 1""")
