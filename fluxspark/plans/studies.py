"""Queries over fitted models: robust fits, holdouts, stability, reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxspark.operators import coverage as V
from fluxspark.operators import lad
from fluxspark.operators import stats as T
from fluxspark.operators import studies as D
from fluxspark.operators import support as P
from fluxspark.operators.common import by, key_join
from fluxspark.plans import bindings as B
from fluxspark.plans import densities as I
from fluxspark.plans.bindings import COVARIATES, KEYS, ON, query
from fluxspark.plans.monthly import FITS, TGT, YEAR_SUPPORT, fit, splits, target

QUERIES = {}


def fit_rows(s, d):
    return D.fit_frame(B.covariates(s, d), B.flux(s, d), fit(s, d), "flux_mean", "flux_se", KEYS)


def design(s, d):
    rows = fit_rows(s, d)
    return D.build_design(rows, D.clamp_bounds(rows, "wte_m", KEYS), keys=KEYS)


def target_rows(s, d):
    return key_join(B.covariates(s, d), target(s, d), ON, "left_semi")


# Fixed coefficients let prediction, intervals and metrics be checked in SQL apart from the fit.
def given_models(s, d):
    beta = F.array(F.lit(3.5), F.lit(-0.02) + F.col("site") / 1000, F.lit(0.01))
    return B.covariates(s, d).select("site").distinct().withColumn("beta", beta)


GIVEN = "3.5 + (-0.02 + site / 1000) * ((soil_temp_f - 32) * 5 / 9) + 0.01 * wte_m"
ROWS = f"""(SELECT site, month, ln(flux_mean) AS y, flux_se / flux_mean AS se_log, {GIVEN} AS prediction, ln(flux_mean) - ({GIVEN}) AS residual
  FROM {FITS} JOIN flux USING (site, month))"""
res = lambda s, d: lad.residuals(design(s, d), given_models(s, d), D.FULL, "y", KEYS)
summary = lambda s, d: lad.residual_summary(res(s, d), keys=KEYS)
SUMMARY = f"""(SELECT site, n AS n_train, avg(abs(residual - med)) AS laplace_scale, max(lo) AS residual_low, max(hi) AS residual_high, max(ma) AS train_medae_log
  FROM {ROWS} JOIN (SELECT site, count(*) AS n, quantile_cont(residual, 0.5) AS med, quantile_cont(residual, 0.05) AS lo, quantile_cont(residual, 0.95) AS hi,
  quantile_cont(abs(residual), 0.5) AS ma FROM {ROWS} GROUP BY 1) USING (site) GROUP BY site, n)"""
QUERIES["predict"] = query(
    lambda s, d: res(s, d).select(*ON, "prediction", "residual"), "windows", "site month *prediction *residual", f"SELECT site, month, prediction, residual FROM {ROWS}")
QUERIES["residual_summary"] = query(
    summary, "windows", "site n_train *laplace_scale *residual_low *residual_high *train_medae_log", f"SELECT * FROM {SUMMARY}")
EMP = f"(SELECT site, month, y, prediction, prediction + residual_low AS lower, prediction + residual_high AS upper FROM {ROWS} JOIN {SUMMARY} USING (site))"
emp = lambda s, d: lad.empirical_interval(res(s, d), summary(s, d), KEYS)
QUERIES["empirical_interval"] = query(
    lambda s, d: emp(s, d).select(*ON, "prediction", "lower", "upper"), "windows", "site month *prediction *lower *upper", f"SELECT site, month, prediction, lower, upper FROM {EMP}")
HALF = "ln(0.1) * sqrt((2 * laplace_scale * laplace_scale + se_log * se_log) / 2)"
QUERIES["laplace_interval"] = query(
    lambda s, d: lad.laplace_interval(res(s, d), summary(s, d), 0.90, "se_log", KEYS).select(*ON, "prediction", "lower", "upper"), "windows",
    "site month *prediction *lower *upper", f"SELECT site, month, prediction, prediction + {HALF} AS lower, prediction - {HALF} AS upper FROM {ROWS} JOIN {SUMMARY} USING (site)")
QUERIES["back_transform"] = query(
    lambda s, d: lad.back_transform(emp(s, d)).select(*ON, "prediction", "lower", "upper"), "windows", "site month *prediction *lower *upper",
    f"SELECT site, month, exp(prediction) AS prediction, exp(lower) AS lower, exp(upper) AS upper FROM {EMP}")
QUERIES["interval_coverage"] = query(
    lambda s, d: lad.interval_coverage(emp(s, d), "y", KEYS), "windows", "site *coverage",
    f"SELECT site, avg(CASE WHEN y BETWEEN lower AND upper THEN 1 ELSE 0 END) AS coverage FROM {EMP} GROUP BY site")
QUERIES["error_metrics"] = query(
    lambda s, d: lad.error_metrics(res(s, d), "y", "prediction", KEYS), "windows",
    "site n_test *mae_log *medae_log *bias_log *mae_flux *medae_flux *bias_flux *mape_pct",
    f"""SELECT site, count(*) AS n_test, avg(abs(residual)) AS mae_log, quantile_cont(abs(residual), 0.5) AS medae_log, avg(residual) AS bias_log, avg(abs(f)) AS mae_flux,
        quantile_cont(abs(f), 0.5) AS medae_flux, avg(f) AS bias_flux, 100 * avg(abs(f / exp(y))) AS mape_pct FROM (SELECT *, exp(y) - exp(prediction) AS f FROM {ROWS}) GROUP BY site""")
QUERIES["residual_distribution"] = query(
    lambda s, d: T.residual_distribution(res(s, d), keys=KEYS), "windows", "site n *aic_laplace *aic_gaussian *delta_aic",
    f"""SELECT site, n, 4 - 2 * (-n * ln(2 * b) - n) AS aic_laplace, 4 - 2 * (-n / 2.0 * ln(2 * pi() * g * g) - n / 2.0) AS aic_gaussian,
        (4 - 2 * (-n / 2.0 * ln(2 * pi() * g * g) - n / 2.0)) - (4 - 2 * (-n * ln(2 * b) - n)) AS delta_aic
        FROM (SELECT site, n_train AS n, laplace_scale AS b, g FROM {SUMMARY} JOIN (SELECT site, stddev_pop(residual) AS g FROM {ROWS} GROUP BY 1) USING (site))""")
QUERIES["qq_table"] = query(
    lambda s, d: T.qq_table(res(s, d), keys=KEYS), "windows", "site i:k *observed *expected",
    f"""SELECT site, k, residual AS observed, med - b * sign(p - 0.5) * ln(1 - 2 * abs(p - 0.5)) AS expected
        FROM (SELECT site, residual, row_number() OVER (PARTITION BY site ORDER BY residual) AS k, (row_number() OVER (PARTITION BY site ORDER BY residual) - 0.5) / count(*) OVER (PARTITION BY site) AS p FROM {ROWS})
        JOIN (SELECT site, laplace_scale AS b FROM {SUMMARY}) USING (site) JOIN (SELECT site, quantile_cont(residual, 0.5) AS med FROM {ROWS} GROUP BY 1) USING (site)""")
RANKED = f"""(SELECT site, residual, k, (k - 0.5) / n AS p, mu, sd FROM (SELECT site, residual, row_number() OVER (PARTITION BY site ORDER BY residual) AS k, count(*) OVER (PARTITION BY site) AS n,
  avg(residual) OVER (PARTITION BY site) AS mu, stddev_pop(residual) OVER (PARTITION BY site) AS sd FROM {ROWS}))"""
QUERIES["qq_table_gaussian"] = query(
    lambda s, d: T.qq_table(res(s, d), family="gaussian", keys=KEYS), "windows", "site i:k *observed *expected",
    f"SELECT site, k, residual AS observed, mu + sd * q AS expected FROM {I.normal_quantile_steps(RANKED, 'site, residual, k, mu, sd')}")
QUERIES["simultaneous_band"] = query(lambda s, d: T.simultaneous_band(res(s, d), keys=KEYS))
QUERIES["scale_by_weight"] = query(
    lambda s, d: T.scale_by_weight(res(s, d).select(*ON, "residual"), fit_rows(s, d).select(*ON, "weight"), keys=KEYS), "windows", "site month *residual",
    f"SELECT site, month, residual / (flux_se * flux_se) AS residual FROM {ROWS} JOIN flux USING (site, month)")


def best_plane(rows: str, group: str = "site", water: bool = True) -> str:
    """(group, b0, b1, b2) of least summed w |y - b0 - b1 x1 - b2 x2|: the best of all planes (lines without x2) through as many rows as they have terms."""
    third, u2 = ("JOIN r c ON c.g = a.g AND b.i < c.i", "c") if water else ("", "b")
    solved = (
        "y0 - (p1 * v2 - p2 * v1) / det * s0 - (u1 * p2 - u2 * p1) / det * t0 AS b0, (p1 * v2 - p2 * v1) / det AS b1, (u1 * p2 - u2 * p1) / det AS b2" if water
        else "y0 - p1 / u1 * s0 AS b0, p1 / u1 AS b1, 0.0 AS b2"
    )
    return f"""(WITH r AS MATERIALIZED (SELECT *, row({group}) AS g, row_number() OVER (PARTITION BY {group} ORDER BY y, x1, x2, w) AS i FROM {rows}),
      d AS (SELECT a.g, a.y AS y0, a.x1 AS s0, a.x2 AS t0, b.x1 - a.x1 AS u1, b.x2 - a.x2 AS v1, b.y - a.y AS p1, {u2}.x1 - a.x1 AS u2, {u2}.x2 - a.x2 AS v2, {u2}.y - a.y AS p2 FROM r a JOIN r b ON a.g = b.g AND a.i < b.i {third}),
      m AS MATERIALIZED (SELECT g, row_number() OVER () AS id, {solved} FROM (SELECT *, {"u1 * v2 - u2 * v1" if water else "u1"} AS det FROM d) WHERE abs(det) > 1e-12),
      k AS (SELECT m.g, id, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(w * abs(y - b0 - b1 * x1 - b2 * x2)) AS cost FROM m JOIN r ON r.g = m.g GROUP BY m.g, id),
      o AS (SELECT DISTINCT {group}, g FROM r)
      SELECT {group}, arg_min(b0, cost) AS b0, arg_min(b1, cost) AS b1, arg_min(b2, cost) AS b2 FROM k JOIN o USING (g) GROUP BY {group})"""


FITTED = f"""(SELECT site, month, soil_temp_f, wte_m, (soil_temp_f - 32) * 5 / 9 AS x1, wte_m AS x2, ln(flux_mean) AS y, flux_se, CASE WHEN flux_se > 0 THEN 1 / (flux_se * flux_se) END AS w
  FROM {FITS} JOIN flux USING (site, month))"""
UNWEIGHTED = f"(SELECT * REPLACE (1.0 AS w) FROM {FITTED})"
WEIGHTED = f"(SELECT * FROM {FITTED} WHERE w IS NOT NULL)"
TERMS = lambda rows: f"""SELECT site, term, CASE term WHEN 'intercept' THEN b0 WHEN 'soil_temp_c' THEN b1 ELSE b2 END AS value
  FROM {best_plane(rows)}, (VALUES ('intercept'), ('soil_temp_c'), ('water_table_clamped')) t(term)"""
QUERIES["fit_lad"] = query(
    lambda s, d: lad.coefficients(lad.fit_lad(design(s, d), D.FULL, "y", keys=KEYS), D.FULL, KEYS), "windows", "site term *value", TERMS(UNWEIGHTED), 6)
QUERIES["fit_lad_weighted"] = query(
    lambda s, d: lad.coefficients(lad.fit_lad(design(s, d).filter("weight is not null"), D.FULL, "y", "weight", KEYS, bounded=True), D.FULL, KEYS),
    "windows", "site term *value", TERMS(WEIGHTED), 6)
# The least absolute deviation through the origin is a weighted median, which SQL can state.
QUERIES["fit_lad_through_origin"] = query(
    lambda s, d: lad.fit_lad(B.readings(s, d).filter("v_ref <> 0 and v_alt is not null").select("site", "v_ref", "v_alt"), ["v_ref"], "v_alt", keys=KEYS)
    .select("site", F.col("beta")[0].alias("slope")),
    "readings", "site *slope",
    """SELECT site, min(q) AS slope FROM (SELECT site, v_alt / v_ref AS q, sum(abs(v_ref)) OVER (PARTITION BY site ORDER BY v_alt / v_ref) AS c, sum(abs(v_ref)) OVER (PARTITION BY site) AS t
       FROM readings WHERE v_ref <> 0 AND v_alt IS NOT NULL) WHERE c >= t / 2 GROUP BY site""")
QUERIES["run_experiments"] = query(
    lambda s, d: D.run_experiments(fit_rows(s, d), splits(s, d), COVARIATES, keys=KEYS))
QUERIES["coefficient_path"] = query(
    lambda s, d: D.coefficient_path(fit_rows(s, d), weighted=True, keys=KEYS))


def paths(s, d):
    """A path of fixed shape per site, from the covariates' means."""
    rows = B.covariates(s, d).groupBy("site", F.year("month").alias("y")).agg(F.avg("wte_m").alias("c")).filter("c is not null")
    return rows.select(
        "site", ((F.col("y") - F.min("y").over(by("site"))) * 10).alias("dropped_wettest_pct"), F.col("c").alias("water_table_coef"), (F.col("c") < 3.95).alias("water_table_includes_zero"))


PATHS = "(SELECT site, (y - min(y) OVER (PARTITION BY site)) * 10 AS pct, c FROM (SELECT site, year(month) AS y, avg(wte_m) AS c FROM cov GROUP BY 1, 2) WHERE c IS NOT NULL)"
QUERIES["stability_verdict"] = query(
    lambda s, d: D.stability_verdict(paths(s, d), keys=KEYS).drop("failures", "reasons", "trend_p", "stable"), "cov",
    "site *baseline_coefficient sign_changes steps_spanning_zero *coefficient_spread *trend *relative_drift",
    f"""SELECT site, b AS baseline_coefficient, count(*) FILTER (sign(c) <> sign(b)) AS sign_changes, count(*) FILTER (c < 3.95) AS steps_spanning_zero, max(c) - min(c) AS coefficient_spread,
        corr(rc, rp) AS trend, (max(c) - min(c)) / abs(b) AS relative_drift FROM (SELECT site, pct, c, first(c) OVER (PARTITION BY site ORDER BY pct) AS b,
        rank() OVER (PARTITION BY site ORDER BY c) AS rc, rank() OVER (PARTITION BY site ORDER BY pct) AS rp FROM {PATHS}) GROUP BY site, b""")
QUERIES["stability_verdict_failures"] = query(
    lambda s, d: D.stability_verdict(paths(s, d), keys=KEYS).select("site", "trend_p", F.array_join("reasons", "; ").alias("reasons"), "stable"), "cov", "site *trend_p reasons stable",
    f"""WITH v AS (SELECT site, b, count(*) AS n, count(*) FILTER (sign(c) <> sign(b)) AS sc, count(*) FILTER (c < 3.95) AS sz, corr(rc, rp) AS r, (max(c) - min(c)) / abs(b) AS dr FROM (
          SELECT site, pct, c, first(c) OVER (PARTITION BY site ORDER BY pct) AS b, rank() OVER (PARTITION BY site ORDER BY c) AS rc, rank() OVER (PARTITION BY site ORDER BY pct) AS rp FROM {PATHS}) GROUP BY 1, 2),
        p AS (SELECT *, CASE WHEN abs(r) < 1 THEN {I.t_p("r * sqrt(n - 2) / sqrt(1 - r * r)", "n - 2")} ELSE 0 END AS trend_p FROM v),
        f AS (SELECT *, list_filter([CASE WHEN sc > 0 THEN 'the sign changes at ' || sc || ' of ' || n || ' steps' END, CASE WHEN sz > 0 THEN 'the interval spans zero at ' || sz || ' of ' || n || ' steps' END,
          CASE WHEN dr > 0.25 THEN 'the coefficient drifts by ' || CAST(round_even(100 * dr, 0) AS BIGINT) || '% of its first value' END,
          CASE WHEN abs(r) >= 0.9 AND trend_p < 0.05 THEN 'the coefficient follows the share removed with a rank correlation of ' || CAST(round_even(100 * r, 0) AS BIGINT) || '%' END], lambda x: x IS NOT NULL) AS why FROM p)
        SELECT site, trend_p, coalesce(array_to_string(why, '; '), '') AS reasons, len(why) = 0 AS stable FROM f""")
QUERIES["stability_paths"] = query(
    lambda s, d: D.stability_paths(paths(s, d).withColumn("treatment", F.when(F.col("site") % 2 == 0, "weighted").otherwise("unweighted"))), "cov",
    "site i:dropped_wettest_pct *water_table_coef water_table_includes_zero treatment",
    f"SELECT site, pct AS dropped_wettest_pct, c AS water_table_coef, c < 3.95 AS water_table_includes_zero, CASE WHEN site % 2 = 0 THEN 'weighted' ELSE 'unweighted' END AS treatment FROM {PATHS}")


def variants(s, d):
    rows, out = fit_rows(s, d), None
    for v in D.VARIANTS:
        models, bounds, _ = D.fit_variant(rows, v, True, keys=KEYS)
        part = D.predict_variant(target_rows(s, d), models, bounds, v, keys=KEYS).select(*ON, F.lit(v).alias("variant"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out


# Both models of the reconstruction with the bounds of their training rows, and the target months under each variant.
MODELS = f"""md AS MATERIALIZED (SELECT f.site, f.b0, f.b1, f.b2, r.b0 AS r0, r.b1 AS r1, lo, hi FROM {best_plane(WEIGHTED)} f JOIN {best_plane(WEIGHTED, water=False)} r USING (site)
    JOIN (SELECT site, min(x2) AS lo, max(x2) AS hi FROM {FITTED} GROUP BY 1) USING (site)),
  pv AS (SELECT site, month, b0 + b1 * x1 + b2 * greatest(least(wte_m, hi), lo) AS clamped, b0 + b1 * x1 + b2 * wte_m AS unclamped, r0 + r1 * x1 AS reduced
    FROM (SELECT *, (soil_temp_f - 32) * 5 / 9 AS x1 FROM cov JOIN {TGT} USING (site, month)) JOIN md USING (site))"""
QUERIES["predict_variant"] = query(
    variants, "windows", "site month variant *prediction", f"WITH {MODELS} SELECT site, month, variant, prediction FROM pv UNPIVOT (prediction FOR variant IN (clamped, unclamped, reduced))", 6)
recon = lambda s, d: D.monthly_reconstruction(fit_rows(s, d), target_rows(s, d), keys=KEYS)
RECON = f"""{MODELS}, rq AS (SELECT site, quantile_cont(e, 0.05) AS rl, quantile_cont(e, 0.95) AS rh FROM (SELECT site, y - b0 - b1 * x1 - b2 * x2 AS e FROM {WEIGHTED} JOIN md USING (site)) GROUP BY 1),
  rc AS (SELECT site, month, exp(clamped) AS clamped, exp(clamped + rl) AS lower, exp(clamped + rh) AS upper, exp(unclamped) AS unclamped, exp(reduced) AS reduced FROM pv JOIN rq USING (site))"""
QUERIES["monthly_reconstruction"] = query(recon, "windows", "site month *clamped *lower *upper *unclamped *reduced", f"WITH {RECON} SELECT * FROM rc", 5)
EARLY = f"""ey AS MATERIALIZED (SELECT * FROM {FITTED} JOIN (SELECT site, year FROM (SELECT site, year, row_number() OVER (PARTITION BY site ORDER BY year) AS k FROM (SELECT DISTINCT site, year(month) AS year FROM {FITTED})) WHERE k <= 3) e
    USING (site) WHERE year(month) = year),
  tr AS MATERIALIZED (SELECT f.* FROM {FITTED} f WHERE NOT EXISTS (SELECT 1 FROM ey WHERE ey.site = f.site AND ey.month = f.month)),
  tb AS (SELECT site, min(x2) AS lo, max(x2) AS hi FROM tr GROUP BY 1),
  tm AS MATERIALIZED (SELECT * FROM {best_plane("(SELECT site, x1, x2, y, w FROM tr WHERE w IS NOT NULL)")}),
  er AS (SELECT site, x2, y - b0 - b1 * x1 - b2 * greatest(least(x2, hi), lo) AS e FROM ey JOIN tm USING (site) JOIN tb USING (site)),
  eb AS (SELECT site, quantile_cont(x2, 2 / 3.0) AS edge FROM er GROUP BY 1),
  wb AS (SELECT site, round_even(avg(e), 4) AS expected_bias_log FROM er JOIN eb USING (site) WHERE x2 > edge GROUP BY 1)"""
QUERIES["wet_end_bias"] = query(lambda s, d: D.wet_end_bias(fit_rows(s, d), keys=KEYS), "windows", "site *expected_bias_log", f"WITH {EARLY} SELECT * FROM wb", 6)
YEARLY = lambda c: f"round_even(sum({c} * day(last_day(month)) * 86400 * 1e-9 * 16.043) * (12.011::DOUBLE / 16.043), 3)"
# Half-even rounding of a value of three decimals to two, in whole thousandths, so that a tie is one.
CENTS = lambda x: f"((n_({x}) // 10) + CASE WHEN n_({x}) % 10 > 5 OR (n_({x}) % 10 = 5 AND (n_({x}) // 10) % 2 = 1) THEN 1 ELSE 0 END) / 100.0".replace(f"n_({x})", f"CAST(round({x} * 1000) AS BIGINT)")
QUERIES["annual_reconstruction"] = query(
    lambda s, d: D.annual_reconstruction(
        recon(s, d), P.year_support(B.covariates(s, d), fit(s, d), target(s, d), COVARIATES, KEYS), D.wet_end_bias(fit_rows(s, d), keys=KEYS), KEYS),
    "long_cov windows",
    "site i:year n_months support n_months_outside_range *pct_months_outside covariates_outside *joint_distance_max *clamped *unclamped *reduced *lower *upper *sensitivity_low *sensitivity_high "
    "*sensitivity_span_pct bias_expectation *if_corrected",
    f"""WITH {RECON}, {EARLY}, ys AS ({YEAR_SUPPORT}),
        yr AS (SELECT site, year(month) AS year, {", ".join(f"{YEARLY(c)} AS {c}" for c in (*D.VARIANTS, "lower", "upper"))} FROM rc GROUP BY 1, 2),
        sp AS (SELECT *, least(clamped, unclamped, reduced) AS l, greatest(clamped, unclamped, reduced) AS h FROM yr)
        SELECT ys.site, ys.year, n_months, support, n_months_outside_range, pct_months_outside, covariates_outside, joint_distance_max, {", ".join(f"{CENTS(c)} AS {c}" for c in (*D.VARIANTS, "lower", "upper"))},
        {CENTS("l")} AS sensitivity_low, {CENTS("h")} AS sensitivity_high, round_even(100 * (h - l) / clamped, 0) AS sensitivity_span_pct,
        CASE WHEN abs(expected_bias_log) < 0.01 THEN 'no material bias' WHEN expected_bias_log > 0 THEN 'model predicts low' WHEN expected_bias_log <= 0 THEN 'model predicts high' END AS bias_expectation,
        round_even(clamped / exp(-expected_bias_log), 2) AS if_corrected
        FROM ys LEFT JOIN sp ON sp.site = ys.site AND sp.year = ys.year LEFT JOIN wb ON wb.site = ys.site""", 4)
SEASON = "sum({c} * day(last_day(month)) * 86400 * 1e-9 * 16.043) * (12.011::DOUBLE / 16.043)"
QUERIES["season_totals"] = query(
    lambda s, d: V.season_totals(B.flux(s, d).select(*ON, "flux_mean", "flux_sd"), ["flux_mean", "flux_sd"], keys=KEYS), "flux",
    "site i:year n_months *flux_mean_g_c *flux_sd_g_c",
    f"""SELECT site, year(month) AS year, count(*) AS n_months, round_even({SEASON.format(c="flux_mean")}, 3) AS flux_mean_g_c, round_even({SEASON.format(c="flux_sd")}, 3) AS flux_sd_g_c
        FROM flux WHERE month(month) BETWEEN 5 AND 10 GROUP BY 1, 2""")
QUERIES["season_totals_whole"] = B.whole(
    lambda f: V.season_totals(f.select(*ON, "flux_mean", "flux_sd"), ["flux_mean", "flux_sd"], keys=KEYS), QUERIES["season_totals"])
