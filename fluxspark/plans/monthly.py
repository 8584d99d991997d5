"""Queries over monthly tables: windows, selections, weights, support, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxspark.forecast import rolling as L
from fluxspark.functions import columns as C
from fluxspark.operators import aggregate as A
from fluxspark.operators import coverage as V
from fluxspark.operators import months as N
from fluxspark.operators import reshape as R
from fluxspark.operators import stats as T
from fluxspark.operators import studies as D
from fluxspark.operators import support as P
from fluxspark.operators import weights as W
from fluxspark.operators.common import by, exact_quantiles, key_join
from fluxspark.operators.merge import paired
from fluxspark.plans import bindings as B
from fluxspark.plans import densities as I
from fluxspark.plans.bindings import COVARIATES, KEYS, ON, query, whole
from fluxspark.sources import readers as S

QUERIES = {}
MI = "(year(month) * 12 + month(month) - 1)"


def win(s, d):
    return N.build_windows(B.covariates(s, d), B.flux(s, d), COVARIATES, B.EXCLUDE, KEYS)


def fit(s, d):
    return N.window_months(win(s, d), "fit", KEYS)


def target(s, d):
    return N.window_months(win(s, d), "reconstruction", KEYS)


FIT = """(SELECT site, month FROM windows WHERE "window" = 'fit')"""
TGT = """(SELECT site, month FROM windows WHERE "window" = 'reconstruction')"""

# ---- monthly columns ------------------------------------------------------------------------------

QUERIES["clamp_to_training"] = query(
    lambda s, d: D.clamp_to(B.covariates(s, d), D.clamp_bounds(key_join(B.covariates(s, d), fit(s, d), ON, "left_semi"), "wte_m", KEYS),
                            "wte_m", "clamped", KEYS).select(*ON, "clamped"),
    "windows", "site month *clamped",
    f"""SELECT site, month, CASE WHEN wte_m IS NOT NULL THEN greatest(least(wte_m, hi), lo) END AS clamped FROM cov
        JOIN (SELECT site, min(wte_m) AS lo, max(wte_m) AS hi FROM cov JOIN {FIT} USING (site, month) GROUP BY site) USING (site)""")
QUERIES["clamp_bounds"] = query(
    lambda s, d: D.clamp_bounds(key_join(B.covariates(s, d), fit(s, d), ON, "left_semi"), "wte_m", KEYS),
    "windows", "site *low *high", f"SELECT site, min(wte_m) AS low, max(wte_m) AS high FROM cov JOIN {FIT} USING (site, month) GROUP BY site")
QUERIES["out_of_range"] = query(
    lambda s, d: B.covariates(s, d).select(*ON, C.out_of_range("soil_temp_f", F.lit(25.0), F.lit(26.0)).alias("direction")),
    "cov", "site month direction",
    "SELECT site, month, CASE WHEN soil_temp_f < 25 THEN 'below' WHEN soil_temp_f > 26 THEN 'above' END AS direction FROM cov")
QUERIES["mask_from"] = query(
    lambda s, d: B.covariates(s, d).select(*ON, C.mask_from("wte_m", "month", "2000-01-01").alias("wte_m")),
    "cov", "site month *wte_m", "SELECT site, month, CASE WHEN month < DATE '2000-01-01' THEN wte_m END AS wte_m FROM cov")
QUERIES["log_target"] = query(
    lambda s, d: D.log_target(B.flux(s, d), "flux_mean").select(*ON, "y", C.log_standard_error("flux_se", "flux_mean").alias("se_log"),
                                                                C.inverse_variance_weight("flux_se").alias("weight")),
    "flux", "site month *y *se_log *weight",
    "SELECT site, month, ln(flux_mean) AS y, flux_se / flux_mean AS se_log, CASE WHEN flux_se > 0 THEN 1 / (flux_se * flux_se) END AS weight FROM flux")
QUERIES["q10_and_slope"] = query(
    lambda s, d: B.covariates(s, d).select(*ON, C.q10_from_slope(F.col("wte_m") / 40).alias("q10"), C.slope_from_q10("wte_m").alias("slope")),
    "cov", "site month *q10 *slope", "SELECT site, month, exp(wte_m / 40 * 10) AS q10, CASE WHEN wte_m > 0 THEN ln(wte_m) / 10 END AS slope FROM cov")
QUERIES["seasonal_terms"] = query(
    lambda s, d: B.series(s, d).select(*ON, *[e.alias(n) for n, e in C.seasonal_terms("month").items()]),
    "series", "site month *sin_year *cos_year *year_fraction",
    """SELECT site, month, sin(2 * pi() * month(month) / 12) AS sin_year, cos(2 * pi() * month(month) / 12) AS cos_year,
       (month(month) - 1) / 12.0 AS year_fraction FROM series""")
BIAS = "(SELECT site, month, wte_m / 4 - 1 AS b FROM cov WHERE wte_m IS NOT NULL)"
bias_rows = lambda s, d: B.covariates(s, d).filter("wte_m is not null").select(*ON, (F.col("wte_m") / 4 - 1).alias("bias_log"))
DIRECTION = lambda e: f"CASE WHEN abs({e}) < 0.01 THEN 'no material bias' WHEN {e} > 0 THEN 'model predicts low' ELSE 'model predicts high' END"
QUERIES["bias_table"] = query(
    lambda s, d: T.bias_table(bias_rows(s, d)), "cov", "site month *bias_log *predicted_over_observed *prediction_error_pct direction",
    f"""SELECT site, month, b AS bias_log, exp(-b) AS predicted_over_observed, 100 * (exp(-b) - 1) AS prediction_error_pct, {DIRECTION('b')} AS direction FROM {BIAS}""")
QUERIES["combine_additively"] = query(
    lambda s, d: T.combine_additively(bias_rows(s, d), keys=KEYS), "cov",
    "site *net_bias_log *predicted_over_observed *prediction_error_pct direction *cancellation_share",
    f"""SELECT site, n AS net_bias_log, exp(-n) AS predicted_over_observed, 100 * (exp(-n) - 1) AS prediction_error_pct, {DIRECTION('n')} AS direction,
        1 - abs(n) / a AS cancellation_share FROM (SELECT site, sum(b) AS n, sum(abs(b)) AS a FROM {BIAS} GROUP BY site)""")
QUERIES["rising_flag"] = query(
    lambda s, d: key_join(N.rising_flag(B.covariates(s, d), "soil_temp_f", KEYS).select(*ON, "rising"), fit(s, d), ON, "left_semi"),
    "windows", "site month rising",
    f"""SELECT site, month, rising FROM (SELECT site, month, coalesce(soil_temp_f - lag(soil_temp_f) OVER (PARTITION BY site ORDER BY month) > 0, FALSE) AS rising
        FROM cov) JOIN {FIT} USING (site, month)""")
QUERIES["laplace_quantile"] = query(
    lambda s, d: B.flux(s, d).select(*ON, C.laplace_quantile(0.05, "flux_se").alias("low"), C.laplace_quantile(0.95, "flux_se").alias("high")),
    "flux", "site month *low *high", "SELECT site, month, flux_se * ln(0.1) AS low, -flux_se * ln(0.1) AS high FROM flux", 7)
QUERIES["build_design"] = query(
    lambda s, d: D.build_design(
        N.rising_flag(B.covariates(s, d), "soil_temp_f", KEYS), D.clamp_bounds(B.covariates(s, d).filter("month >= date'1998-01-01'"), "wte_m", KEYS),
        rising="rising", keys=KEYS).select(*ON, "intercept", "soil_temp_c", "water_table_clamped", "warming_limb", "soil_temp_c_warming"),
    "cov", "site month *intercept *soil_temp_c *water_table_clamped *warming_limb *soil_temp_c_warming",
    """SELECT site, month, 1.0 AS intercept, (soil_temp_f - 32) * 5 / 9 AS soil_temp_c, CASE WHEN wte_m IS NOT NULL THEN greatest(least(wte_m, hi), lo) END AS water_table_clamped,
       up AS warming_limb, (soil_temp_f - 32) * 5 / 9 * up AS soil_temp_c_warming
       FROM (SELECT *, CASE WHEN soil_temp_f - lag(soil_temp_f) OVER (PARTITION BY site ORDER BY month) > 0 THEN 1.0 ELSE 0.0 END AS up FROM cov)
       JOIN (SELECT site, min(wte_m) AS lo, max(wte_m) AS hi FROM cov WHERE month >= DATE '1998-01-01' GROUP BY site) USING (site)""")

# ---- sources and reshaping ----------------------------------------------------------------------------

QUERIES["load_series"] = query(
    lambda s, d: S.load_series(B.flux(s, d), "flux_mean", KEYS), "flux", "site month *value",
    """SELECT g.site, g.month, flux_mean AS value FROM (SELECT site, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
       FROM flux GROUP BY site) g LEFT JOIN flux f ON g.site = f.site AND g.month = f.month""")
QUERIES["load_covariates"] = query(
    lambda s, d: S.load_covariates(B.covariates(s, d), S.load_series(B.flux(s, d), "flux_mean", KEYS), COVARIATES, "wte_m", "2000-01-01", KEYS),
    "cov flux", "site month *soil_temp_f *atm_temp_f *precip_in *wte_m",
    """SELECT g.site, g.month, soil_temp_f, atm_temp_f, precip_in, CASE WHEN g.month < DATE '2000-01-01' THEN wte_m END AS wte_m
       FROM (SELECT site, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM flux GROUP BY site) g
       LEFT JOIN cov c ON g.site = c.site AND g.month = c.month""")
QUERIES["join_covariates"] = query(
    lambda s, d: S.join_covariates([B.covariates(s, d).select(*ON, "soil_temp_f"), B.covariates(s, d).filter("month(month) <> 2").select(*ON, "wte_m"),
                                    B.flux(s, d).select(*ON, "flux_mean")], KEYS),
    "cov flux", "site month *soil_temp_f *wte_m *flux_mean",
    """SELECT site, month, soil_temp_f, CASE WHEN month(month) <> 2 THEN wte_m END AS wte_m, flux_mean FROM cov FULL JOIN flux USING (site, month)""")
QUERIES["verify_spot_checks"] = query(
    lambda s, d: S.verify_spot_checks(B.covariates(s, d), {"atm_temp_f": {"1996-02": 37.0, "1990-01": 1.0}, "wte_m": {"1999-05": 4.0}}, 1.0, keys=KEYS),
    "cov", "site column month *expected *actual *abs_diff match",
    """SELECT s.site, "column", e.month, expected, actual, abs(actual - expected) AS abs_diff, coalesce(abs(actual - expected) < 1.0, FALSE) AS match
       FROM (SELECT DISTINCT site FROM cov) s, (VALUES ('atm_temp_f', DATE '1996-02-01', 37.0), ('atm_temp_f', DATE '1990-01-01', 1.0), ('wte_m', DATE '1999-05-01', 4.0)) e("column", month, expected)
       LEFT JOIN (SELECT site, month, covariate, value AS actual FROM (SELECT site, month, 'atm_temp_f' AS covariate, atm_temp_f AS value FROM cov
         UNION ALL SELECT site, month, 'wte_m', wte_m FROM cov)) a ON a.site = s.site AND a.month = e.month AND a.covariate = e."column" """)
QUERIES["stack_labelled"] = query(
    lambda s, d: R.stack_labelled({"soil": B.covariates(s, d).select(*ON, F.col("soil_temp_f").alias("v")), "water": B.covariates(s, d).select(*ON, F.col("wte_m").alias("v"))}),
    "cov", "site month *v family", "SELECT site, month, soil_temp_f AS v, 'soil' AS family FROM cov UNION ALL SELECT site, month, wte_m, 'water' FROM cov")

# ---- month sets -------------------------------------------------------------------------------------------

QUERIES["complete_months"] = query(
    lambda s, d: N.complete_months(B.covariates(s, d), COVARIATES, KEYS), "windows", "site month", "SELECT site, month FROM complete")
QUERIES["build_windows"] = query(win, "windows", "site month window", "SELECT * FROM windows")
ALLW = ", ".join(f"('{w}')" for w in N.WINDOWS)
QUERIES["window_accounting"] = query(
    lambda s, d: N.window_accounting(win(s, d), KEYS), "windows", "site window n_months first last b:span_months b:n_absent",
    f"""SELECT e.site, e.w AS "window", count(x.month) AS n_months, min(x.month) AS "first", max(x.month) AS "last",
        CASE WHEN e.w IN ('fit', 'fit_nominal', 'reconstruction') THEN max({MI.replace('month(', 'month(x.').replace('year(', 'year(x.')}) - min({MI.replace('month(', 'month(x.').replace('year(', 'year(x.')}) + 1 END AS span_months,
        CASE WHEN e.w IN ('fit', 'fit_nominal', 'reconstruction') THEN max({MI.replace('month(', 'month(x.').replace('year(', 'year(x.')}) - min({MI.replace('month(', 'month(x.').replace('year(', 'year(x.')}) + 1 - count(x.month) END AS n_absent
        FROM (SELECT DISTINCT site, w FROM flux, (VALUES {ALLW}) t(w)) e LEFT JOIN windows x ON x.site = e.site AND x."window" = e.w GROUP BY 1, 2""")
QUERIES["absent_months"] = query(
    lambda s, d: N.absent_months(fit(s, d), KEYS), "windows", "site month",
    f"""SELECT g.site, g.month FROM (SELECT site, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM {FIT} GROUP BY site) g
        ANTI JOIN {FIT} f ON f.site = g.site AND f.month = g.month""")
QUERIES["months_without_counts"] = query(
    lambda s, d: N.months_without_counts(
        A.build_monthly(B.readings(s, d), ["v_base"], B.covariates(s, d), "1994-06-01", "2002-03-01", keys=KEYS), ["v_base_n"], KEYS),
    "readings", "site month",
    """SELECT g.site, g.month FROM (SELECT site, CAST(unnest(generate_series(DATE '1994-06-01', DATE '2002-03-01', INTERVAL 1 MONTH)) AS DATE) AS month
       FROM (SELECT DISTINCT site FROM readings)) g WHERE NOT EXISTS
       (SELECT 1 FROM readings r WHERE r.site = g.site AND CAST(date_trunc('month', r.ts) AS DATE) = g.month AND r.v_base IS NOT NULL)""")
ISL = lambda src, part="site": f"""(SELECT *, {MI} - row_number() OVER (PARTITION BY {part} ORDER BY month) AS isl FROM {src})"""
MRUNS = f"""(SELECT site, min(month) AS "first", max(month) AS "last", count(*) AS n_months FROM {ISL(FIT)} GROUP BY site, isl)"""
QUERIES["month_runs"] = query(
    lambda s, d: N.month_runs(fit(s, d), KEYS), "windows", "site first last n_months", f"SELECT * FROM {MRUNS}")
TXT = """CASE WHEN "first" = "last" THEN strftime("first", '%Y-%m') ELSE strftime("first", '%Y-%m') || '..' || strftime("last", '%Y-%m') END"""
QUERIES["compact_runs"] = query(
    lambda s, d: N.compact_runs(fit(s, d), KEYS), "windows", "site runs", f"""SELECT site, string_agg({TXT}, ', ' ORDER BY "first") AS runs FROM {MRUNS} GROUP BY site""")
CCOV = f"""(SELECT c.site, c.covariate, "first", "last", n_months, span AS span_months, span - n_months AS n_interior_gaps, coalesce(gaps, '') AS interior_gaps,
  c.covariate IN ('soil_temp_f', 'atm_temp_f', 'precip_in', 'wte_m') AS reconstruction_capable
  FROM (SELECT site, covariate, min(month) AS "first", max(month) AS "last", count(*) AS n_months, max({MI}) - min({MI}) + 1 AS span FROM long_cov GROUP BY 1, 2) c
  LEFT JOIN (SELECT g.site, g.covariate, string_agg(strftime(g.month, '%Y-%m'), ', ' ORDER BY g.month) AS gaps FROM
     (SELECT site, covariate, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM long_cov GROUP BY 1, 2) g
     ANTI JOIN long_cov l ON l.site = g.site AND l.covariate = g.covariate AND l.month = g.month GROUP BY 1, 2) x ON x.site = c.site AND x.covariate = c.covariate)"""
ccov = lambda s, d: N.covariate_coverage(B.covariates(s, d), COVARIATES, keys=KEYS)
QUERIES["covariate_coverage"] = query(
    ccov, "long_cov", "site covariate first last n_months b:span_months b:n_interior_gaps interior_gaps reconstruction_capable", f"SELECT * FROM {CCOV}")
QUERIES["grid_coverage"] = query(
    lambda s, d: N.grid_coverage(B.covariates(s, d), COVARIATES, "1996-01-01", "2001-12-01", KEYS), "long_cov",
    "site covariate first last n_months_total n_months_on_grid n_missing_from_grid missing_months",
    f"""WITH st AS (SELECT site, covariate, min(month) AS "first", max(month) AS "last", count(*) AS n_months_total,
          count(*) FILTER (month BETWEEN DATE '1996-01-01' AND DATE '2001-12-01') AS n_months_on_grid FROM long_cov GROUP BY 1, 2),
        miss AS (SELECT g.site, g.covariate, g.month FROM (SELECT site, covariate, CAST(unnest(generate_series(DATE '1996-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM st) g
          ANTI JOIN long_cov l ON l.site = g.site AND l.covariate = g.covariate AND l.month = g.month),
        rn AS (SELECT site, covariate, min(month) AS "first", max(month) AS "last" FROM {ISL("miss", "site, covariate")} GROUP BY site, covariate, isl)
        SELECT st.*, coalesce(n, 0) AS n_missing_from_grid, coalesce(t, '') AS missing_months FROM st
        LEFT JOIN (SELECT site, covariate, count(*) AS n FROM miss GROUP BY 1, 2) a USING (site, covariate)
        LEFT JOIN (SELECT site, covariate, string_agg({TXT}, ', ' ORDER BY "first") AS t FROM rn GROUP BY 1, 2) b USING (site, covariate)""")
QUERIES["binding_constraint"] = query(
    lambda s, d: N.binding_constraint(ccov(s, d), KEYS), "long_cov", "site bound covariate month",
    f"""SELECT site, 'fit window ends at' AS bound, covariate, "last" AS month FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY "last", covariate) AS k FROM {CCOV}) WHERE k = 1
        UNION ALL SELECT site, 'reconstruction window starts at', covariate, "first" FROM
        (SELECT *, row_number() OVER (PARTITION BY site ORDER BY "first" DESC, covariate) AS k FROM {CCOV}) WHERE k = 1""")


def aside(s, d):
    return B.covariates(s, d).filter("month(month) = 4").select("site", F.lit("wte_m").alias("series"), "month", F.lit("gauge change").alias("reason"))


QUERIES["availability"] = query(
    lambda s, d: N.availability(N.to_covariate_long(B.covariates(s, d), COVARIATES, KEYS).withColumnRenamed("covariate", "series"), aside(s, d), ["site", "series"]),
    "long_cov", "site series month status first last n_months",
    """SELECT g.site, g.series, g.month, CASE WHEN l.month IS NULL THEN 'gap' WHEN g.series = 'wte_m' AND month(g.month) = 4 THEN 'gauge change' ELSE 'present' END AS status,
       "first", "last", n_months FROM (SELECT site, covariate AS series, min(month) AS "first", max(month) AS "last", count(*) AS n_months,
       CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM long_cov GROUP BY 1, 2) g
       LEFT JOIN long_cov l ON l.site = g.site AND l.covariate = g.series AND l.month = g.month""")
fits = lambda s, d: key_join(B.covariates(s, d), fit(s, d), ON, "left_semi")
FITS = f"(SELECT cov.* FROM cov JOIN {FIT} USING (site, month))"
TOP = lambda col, order, cond, src=None: f"""SELECT site, month FROM (SELECT site, month, row_number() OVER (PARTITION BY site ORDER BY {col} {order}, month) AS k,
  count(*) OVER (PARTITION BY site) AS n FROM {src or FITS} WHERE {col} IS NOT NULL) WHERE {cond}"""
QUERIES["extreme_share"] = query(
    lambda s, d: N.extreme_share(fits(s, d), "wte_m", 0.10, True, KEYS).select(*ON), "windows", "site month",
    TOP("wte_m", "DESC", "k <= greatest(1, round_even(0.1 * n, 0))"))
QUERIES["coldest_share"] = query(
    lambda s, d: N.extreme_share(fits(s, d), "soil_temp_f", 0.10, False, KEYS).select(*ON), "windows", "site month",
    TOP("soil_temp_f", "ASC", "k <= greatest(1, round_even(0.1 * n, 0))"))
YEARS = lambda order: f"SELECT site, month FROM (SELECT site, month, dense_rank() OVER (PARTITION BY site ORDER BY year(month) {order}) AS k FROM {FIT}) WHERE k <= 2"
QUERIES["earliest_years"] = query(lambda s, d: N.earliest_years(fit(s, d), 2, KEYS), "windows", "site month", YEARS("ASC"))
QUERIES["latest_years"] = query(lambda s, d: N.latest_years(fit(s, d), 2, KEYS), "windows", "site month", YEARS("DESC"))
QUERIES["drier_subset"] = query(
    lambda s, d: N.drier_subset(fits(s, d), "wte_m", 0.3, KEYS).select(*ON), "windows", "site month",
    TOP("wte_m", "ASC", "k <= n - round_even(0.3 * n, 0)"))
SPLITS = f"""(SELECT site, 'wettest decile' AS split, month FROM ({TOP("wte_m", "DESC", "k <= greatest(1, round_even(0.1 * n, 0))")})
  UNION ALL SELECT site, 'coldest decile', month FROM ({TOP("soil_temp_f", "ASC", "k <= greatest(1, round_even(0.1 * n, 0))")})
  UNION ALL SELECT site, 'earliest three years', month FROM ({YEARS("ASC").replace("<= 2", "<= 3")})
  UNION ALL SELECT site, 'latest three years', month FROM ({YEARS("DESC").replace("<= 2", "<= 3")}))"""
splits = lambda s, d: N.build_splits(fits(s, d), "wte_m", "soil_temp_f", KEYS)
QUERIES["build_splits"] = query(splits, "windows", "site split month", f"SELECT * FROM {SPLITS}")

# ---- weights --------------------------------------------------------------------------------------------------

RW = "(SELECT *, 100 * w / sum(w) OVER (PARTITION BY site) AS rw, count(*) OVER (PARTITION BY site) AS n FROM (SELECT *, 1 / (flux_se * flux_se) AS w FROM flux))"
DESC = lambda c, e: f"""SELECT site, '{c}' AS measure, count({e}) AS count, round_even(avg({e}), 4) AS mean, round_even(stddev_samp({e}), 4) AS std,
  round_even(min({e}), 4) AS min, {", ".join(f"round_even(quantile_cont({e}, {p}), 4) AS p{int(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))},
  round_even(max({e}), 4) AS max FROM {RW} GROUP BY site"""
QUERIES["weight_summary"] = query(
    lambda s, d: W.weight_summary(B.flux(s, d), ["flux_days", "flux_obs", "flux_sd"], "flux_se", KEYS), "flux",
    "site measure count *mean *std *min *p5 *p25 *p50 *p75 *p95 *max",
    " UNION ALL ".join(DESC(c, f"CAST({e} AS DOUBLE)") for c, e in [("flux_days", "flux_days"), ("flux_obs", "flux_obs"), ("flux_sd", "flux_sd"), ("flux_se", "flux_se"), ("relative_weight_pct", "rw")]), 4)
RK = "(SELECT *, row_number() OVER (PARTITION BY site ORDER BY w DESC, month) AS k FROM " + RW + ")"
QUERIES["weight_concentration"] = query(
    lambda s, d: W.weight_concentration(B.flux(s, d), "flux_se", keys=KEYS), "flux", "site group n_months *value",
    " UNION ALL ".join(
        f"""SELECT site, '{e} {int(p * 100)}% of months by weight' AS "group", count(*) AS n_months, round_even(sum(rw), 1) AS value FROM {RK}
        WHERE {"k <= greatest(1, round_even(%s * n, 0))" % p if e == "top" else "k > n - greatest(1, round_even(%s * n, 0))" % p} GROUP BY site"""
        for p in (0.1, 0.25, 0.5) for e in ("top", "bottom")) +
    f""" UNION ALL SELECT site, 'effective number of months', count(*), round_even(sum(w) * sum(w) / sum(w * w), 1) FROM {RW} GROUP BY site""", 4)
INF = lambda order, n: f"""SELECT site, month, flux_mean, flux_se, round_even(rw, 4) AS relative_weight_pct, round_even(100.0 / n, 4) AS equal_weight_pct, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY site ORDER BY w {order}, month) AS rank FROM {RW}) WHERE rank <= {n}"""
INFC = "site month *flux_mean *flux_se *relative_weight_pct *equal_weight_pct i:rank"
QUERIES["least_influential"] = query(lambda s, d: W.least_influential(B.flux(s, d), "flux_se", 12, ["flux_mean"], KEYS), "flux", INFC, INF("ASC", 12), 4)
QUERIES["most_influential"] = query(lambda s, d: W.most_influential(B.flux(s, d), "flux_se", 6, ["flux_mean"], KEYS), "flux", INFC, INF("DESC", 6), 4)
QUERIES["seasonal_weight_balance"] = query(
    lambda s, d: W.seasonal_weight_balance(B.flux(s, d), "flux_mean", "flux_se", KEYS), "flux",
    "site i:month_of_year n_months *mean_flux *mean_se *weight_share_pct *equal_share_pct",
    f"""SELECT site, month(month) AS month_of_year, count(*) AS n_months, round_even(avg(flux_mean), 3) AS mean_flux, round_even(avg(flux_se), 3) AS mean_se,
        round_even(sum(rw), 3) AS weight_share_pct, round_even(100.0 * count(*) / max(n), 3) AS equal_share_pct FROM {RW} GROUP BY 1, 2""", 4)

# ---- support ------------------------------------------------------------------------------------------------------

FT = f"""(SELECT l.*, f.month IS NOT NULL AS isf, t.month IS NOT NULL AS ist FROM long_cov l LEFT JOIN {FIT} f ON f.site = l.site AND f.month = l.month
  LEFT JOIN {TGT} t ON t.site = l.site AND t.month = l.month)"""
BND = f"(SELECT site, covariate, min(value) FILTER (isf) AS fit_min, max(value) FILTER (isf) AS fit_max FROM {FT} GROUP BY 1, 2)"
QUERIES["distribution_comparison"] = query(
    lambda s, d: P.distribution_comparison(B.covariates(s, d), fit(s, d), target(s, d), COVARIATES, KEYS), "long_cov windows",
    "site covariate *fit_min *fit_max *fit_mean *target_min *target_max *target_mean *mean_shift n_below n_above n_outside *pct_outside",
    f"""SELECT site, covariate, fit_min, fit_max, avg(value) FILTER (isf) AS fit_mean, min(value) FILTER (ist) AS target_min, max(value) FILTER (ist) AS target_max,
        avg(value) FILTER (ist) AS target_mean, avg(value) FILTER (ist) - avg(value) FILTER (isf) AS mean_shift,
        count(*) FILTER (ist AND value < fit_min) AS n_below, count(*) FILTER (ist AND value > fit_max) AS n_above,
        count(*) FILTER (ist AND (value < fit_min OR value > fit_max)) AS n_outside,
        round_even(100.0 * count(*) FILTER (ist AND (value < fit_min OR value > fit_max)) / count(*) FILTER (ist), 1) AS pct_outside
        FROM {FT} JOIN {BND} USING (site, covariate) GROUP BY ALL""")
OUT = f"""(SELECT site, month, covariate, value, CASE WHEN value < fit_min THEN 'below' ELSE 'above' END AS direction, fit_min, fit_max,
  greatest(fit_min - value, value - fit_max) AS excess FROM {FT} JOIN {BND} USING (site, covariate) WHERE ist AND (value < fit_min OR value > fit_max))"""
outside = lambda s, d: P.out_of_range_months(B.covariates(s, d), fit(s, d), target(s, d), COVARIATES, KEYS)
QUERIES["out_of_range_months"] = query(
    outside, "long_cov windows", "site month covariate *value direction *fit_min *fit_max *excess", f"SELECT * FROM {OUT}")
QUERIES["months_any_outside"] = query(
    lambda s, d: P.months_any_outside(outside(s, d), target(s, d), KEYS), "long_cov windows", "site n_months_any_outside *pct_of_target",
    f"""SELECT t.site, count(o.month) AS n_months_any_outside, round_even(100.0 * count(o.month) / count(*), 1) AS pct_of_target
        FROM {TGT} t LEFT JOIN (SELECT DISTINCT site, month FROM {OUT}) o ON o.site = t.site AND o.month = t.month GROUP BY 1""")
QUERIES["out_of_range_runs"] = query(
    lambda s, d: P.out_of_range_runs(outside(s, d), KEYS), "long_cov windows", "site covariate first last n_months direction *max_excess",
    f"""SELECT site, covariate, min(month) AS "first", max(month) AS "last", count(*) AS n_months, arg_min(direction, month) AS direction, round_even(max(excess), 3) AS max_excess
        FROM {ISL(OUT, "site, covariate")} GROUP BY site, covariate, isl""")
ZS = f"""(SELECT site, {", ".join(f"avg({c}) AS m{i}, stddev_samp({c}) AS s{i}" for i, c in enumerate(COVARIATES))} FROM {FITS} GROUP BY site)"""
ZD = " + ".join(f"((p.{c} - r.{c}) / s{i}) ** 2" for i, c in enumerate(COVARIATES))
NEAR = lambda pts, extra="": f"""(SELECT p.site, p.month, sqrt(min({ZD})) AS distance FROM (SELECT cov.* FROM cov JOIN {pts} USING (site, month)) p
  JOIN {FITS} r ON r.site = p.site {extra} JOIN {ZS} z ON z.site = p.site GROUP BY 1, 2)"""
OWN = NEAR(FIT, "AND r.month <> p.month")
QUERIES["nearest_distance"] = query(
    lambda s, d: P.nearest_distance(key_join(B.covariates(s, d), target(s, d), ON, "left_semi"), fits(s, d), COVARIATES, keys=KEYS),
    "windows", "site month *distance", f"SELECT * FROM {NEAR(TGT)}")
QUERIES["joint_support"] = query(
    lambda s, d: P.joint_support(B.covariates(s, d), fit(s, d), target(s, d), COVARIATES, KEYS), "windows", "site group n *median *p95 *max n_beyond_fit_p95",
    f"""WITH own AS (SELECT * FROM {OWN}), far AS (SELECT * FROM {NEAR(TGT)}), lim AS (SELECT site, quantile_cont(distance, 0.95) AS l FROM own GROUP BY 1)
        SELECT site, 'fit' AS "group", count(*) AS n, quantile_cont(distance, 0.5) AS median, quantile_cont(distance, 0.95) AS p95, max(distance) AS max, 0 AS n_beyond_fit_p95
        FROM own GROUP BY 1 UNION ALL SELECT site, 'target', count(*), quantile_cont(distance, 0.5), quantile_cont(distance, 0.95), max(distance),
        count(*) FILTER (distance > l) FROM far JOIN lim USING (site) GROUP BY 1""")
YEAR_SUPPORT = f"""WITH o AS (SELECT * FROM {OUT}), far AS (SELECT * FROM {NEAR(TGT)})
        SELECT t.site, year(t.month) AS year, count(*) AS n_months, count(x.month) AS n_months_outside_range, round_even(100.0 * count(x.month) / count(*), 0) AS pct_months_outside,
        coalesce(max(names), '') AS covariates_outside,
        round_even(quantile_cont(distance, 0.5), 3) AS joint_distance_median, round_even(max(distance), 3) AS joint_distance_max,
        CASE WHEN count(x.month) > 0 THEN 'outside' ELSE 'inside' END AS support
        FROM {TGT} t LEFT JOIN (SELECT DISTINCT site, month FROM o) x ON x.site = t.site AND x.month = t.month
        LEFT JOIN far f ON f.site = t.site AND f.month = t.month
        LEFT JOIN (SELECT site, year(month) AS y, string_agg(DISTINCT covariate, ', ' ORDER BY covariate) AS names FROM o GROUP BY 1, 2) c ON c.site = t.site AND c.y = year(t.month)
        GROUP BY t.site, year(t.month)"""
QUERIES["year_support"] = query(
    lambda s, d: P.year_support(B.covariates(s, d), fit(s, d), target(s, d), COVARIATES, KEYS), "long_cov windows",
    "site i:year n_months n_months_outside_range *pct_months_outside covariates_outside *joint_distance_median *joint_distance_max support", YEAR_SUPPORT)
QUERIES["support_classes"] = query(
    lambda s, d: P.support_classes(B.covariates(s, d), "wte_m", fit(s, d), B.EXCLUDE, KEYS), "windows", "site month *wte_m *fit_min *fit_max support",
    f"""SELECT g.site, g.month, wte_m, lo AS fit_min, hi AS fit_max, CASE WHEN g.month IN (DATE '1999-06-01', DATE '1999-09-01') THEN 'removed' WHEN wte_m IS NULL THEN 'missing'
        WHEN wte_m < lo THEN 'below' WHEN wte_m > hi THEN 'above' ELSE 'within' END AS support
        FROM (SELECT site, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM cov GROUP BY site) g
        LEFT JOIN cov c ON c.site = g.site AND c.month = g.month
        JOIN (SELECT site, min(wte_m) AS lo, max(wte_m) AS hi FROM {FITS} GROUP BY site) b ON b.site = g.site""")
EARLY = f"({YEARS('ASC')})"
QUERIES["holdout_covariate_contrast"] = query(
    lambda s, d: P.holdout_covariate_contrast(
        B.covariates(s, d), key_join(fit(s, d), N.earliest_years(fit(s, d), 2, KEYS), ON, "left_anti"), N.earliest_years(fit(s, d), 2, KEYS), COVARIATES, KEYS),
    "long_cov windows", "site covariate *train_min *train_max *holdout_min *holdout_max n_holdout_outside *pct_holdout_outside",
    f"""WITH e AS (SELECT * FROM {EARLY}), x AS (SELECT l.*, e.month IS NOT NULL AS held FROM long_cov l JOIN {FIT} f ON f.site = l.site AND f.month = l.month
          LEFT JOIN e ON e.site = l.site AND e.month = l.month),
        y AS (SELECT *, min(value) FILTER (NOT held) OVER w AS lo, max(value) FILTER (NOT held) OVER w AS hi FROM x WINDOW w AS (PARTITION BY site, covariate))
        SELECT site, covariate, round_even(lo, 3) AS train_min, round_even(hi, 3) AS train_max, round_even(min(value) FILTER (held), 3) AS holdout_min,
        round_even(max(value) FILTER (held), 3) AS holdout_max, count(*) FILTER (held AND (value < lo OR value > hi)) AS n_holdout_outside,
        round_even(100.0 * count(*) FILTER (held AND (value < lo OR value > hi)) / count(*) FILTER (held), 1) AS pct_holdout_outside FROM y GROUP BY site, covariate, lo, hi""")
QUERIES["analogue_strength"] = query(
    lambda s, d: P.analogue_strength(B.covariates(s, d), fit(s, d), target(s, d), splits(s, d), "wte_m", KEYS), "windows",
    "site split *train_range *max_excess *target_max_excess *share_of_target_excess",
    f"""WITH f AS (SELECT site, month, wte_m AS v FROM {FITS} WHERE wte_m IS NOT NULL), sp AS (SELECT * FROM {SPLITS}),
        goal AS (SELECT f.site, greatest(max(t.wte_m) - max(f.v), min(f.v) - min(t.wte_m), 0.0) AS g FROM f JOIN (SELECT cov.* FROM cov JOIN {TGT} USING (site, month)) t ON t.site = f.site GROUP BY 1),
        x AS (SELECT n.site, n.split, v, sp.month IS NOT NULL AS held FROM (SELECT DISTINCT site, split FROM sp) n JOIN f ON f.site = n.site
              LEFT JOIN sp ON sp.site = n.site AND sp.split = n.split AND sp.month = f.month),
        p AS (SELECT site, split, max(v) FILTER (NOT held) - min(v) FILTER (NOT held) AS r,
              greatest(max(v) FILTER (held) - max(v) FILTER (NOT held), min(v) FILTER (NOT held) - min(v) FILTER (held), 0.0) AS e FROM x GROUP BY 1, 2)
        SELECT site, split, round_even(r, 3) AS train_range, round_even(e, 3) AS max_excess, round_even(g, 3) AS target_max_excess,
        CASE WHEN g > 0 THEN round_even(e / g, 2) END AS share_of_target_excess FROM p JOIN goal USING (site)""")

# ---- row-level statistics ----------------------------------------------------------------------------------------

pairs = lambda s, d: paired(B.readings(s, d).select("site", "ts", "v_ref", "v_alt"), "v_ref", "v_alt")
PR = "(SELECT site, v_ref AS x, v_alt AS y, v_ref - v_alt AS d FROM readings WHERE v_ref IS NOT NULL AND v_alt IS NOT NULL)"
QUERIES["exact_quantiles"] = query(
    lambda s, d: exact_quantiles(B.readings(s, d), "v_ref", {"p01": 0.01, "p50": 0.5, "p999": 0.999}, KEYS), "readings", "site *p01 *p50 *p999",
    "SELECT site, quantile_cont(v_ref, 0.01) AS p01, quantile_cont(v_ref, 0.5) AS p50, quantile_cont(v_ref, 0.999) AS p999 FROM readings GROUP BY site")
QUERIES["difference_statistics"] = query(
    lambda s, d: T.difference_statistics(pairs(s, d), trim=0.02, keys=KEYS), "readings",
    "site n *median *mean *iqr *laplace_scale_from_iqr *sigma_robust *sd_raw_moment *skewness_raw *skewness_trimmed *excess_kurtosis",
    f"""WITH r AS (SELECT site, d, row_number() OVER (PARTITION BY site ORDER BY d) AS k, count(*) OVER (PARTITION BY site) AS n FROM {PR}),
        m AS (SELECT site, avg(d) AS mu FROM {PR} GROUP BY 1), a AS (SELECT site, count(*) AS n, quantile_cont(d, 0.5) AS median, avg(d) AS mean,
          quantile_cont(d, 0.75) - quantile_cont(d, 0.25) AS iqr, stddev_samp(d) AS sd, stddev_pop(d) AS sp FROM {PR} GROUP BY 1),
        c AS (SELECT site, avg((d - mu) ** 3) AS m3, avg((d - mu) ** 4) AS m4 FROM {PR} JOIN m USING (site) GROUP BY 1),
        t AS (SELECT site, d FROM r WHERE k > floor(0.02 * n) AND k <= n - floor(0.02 * n)), tm AS (SELECT site, avg(d) AS mu FROM t GROUP BY 1),
        tc AS (SELECT site, avg((d - mu) ** 3) / avg((d - mu) ** 2) ** 1.5 AS st FROM t JOIN tm USING (site) GROUP BY 1)
        SELECT site, n, median, mean, iqr, iqr / (2 * ln(2)) AS laplace_scale_from_iqr, iqr / (2 * ln(2)) * sqrt(2) AS sigma_robust, sd AS sd_raw_moment,
        m3 / sp ** 3 AS skewness_raw, st AS skewness_trimmed, m4 / sp ** 4 - 3 AS excess_kurtosis FROM a JOIN c USING (site) JOIN tc USING (site)""", 7)
AIC = lambda src: f"""WITH x AS (SELECT * FROM {src}), m AS (SELECT site, quantile_cont(d, 0.5) AS med FROM x GROUP BY 1),
  f AS (SELECT site, count(*) AS n, max(med) AS ll, avg(abs(d - med)) AS ls, avg(d) AS gl, stddev_pop(d) AS gs FROM x JOIN m USING (site) GROUP BY 1),
  k AS (SELECT *, -n * ln(2 * ls) - n AS lll, -n / 2.0 * ln(2 * pi() * gs * gs) - n / 2.0 AS gll FROM f)"""
QUERIES["laplace_vs_gaussian"] = query(
    lambda s, d: T.laplace_vs_gaussian(pairs(s, d), ks=False, keys=KEYS), "readings", "site distribution *loc *scale *loglik *aic *delta_aic_vs_best",
    f"""{AIC(PR)} SELECT site, 'laplace' AS distribution, ll AS loc, ls AS scale, lll AS loglik, 4 - 2 * lll AS aic, 4 - 2 * lll - least(4 - 2 * lll, 4 - 2 * gll) AS delta_aic_vs_best FROM k
        UNION ALL SELECT site, 'gaussian', gl, gs, gll, 4 - 2 * gll, 4 - 2 * gll - least(4 - 2 * lll, 4 - 2 * gll) FROM k""", 6)
QUERIES["laplace_ks_distance"] = query(
    lambda s, d: T.laplace_vs_gaussian(pairs(s, d), ks=["laplace"], keys=KEYS).filter("distribution = 'laplace'").select("site", "ks_statistic"), "readings", "site *ks_statistic",
    f"""WITH x AS (SELECT * FROM {PR}), m AS (SELECT site, quantile_cont(d, 0.5) AS med, count(*) AS n FROM x GROUP BY 1),
        b AS (SELECT site, avg(abs(d - med)) AS b FROM x JOIN m USING (site) GROUP BY 1),
        v AS (SELECT site, d, count(*) AS c FROM x GROUP BY 1, 2), u AS (SELECT site, d, c, sum(c) OVER (PARTITION BY site ORDER BY d) AS t FROM v)
        SELECT site, max(greatest(t / n - g, g - (t - c) / n)) AS ks_statistic FROM (SELECT site, c, t, n::DOUBLE AS n,
          CASE WHEN d < med THEN exp((d - med) / b) / 2 ELSE 1 - exp(-(d - med) / b) / 2 END AS g FROM u JOIN m USING (site) JOIN b USING (site)) GROUP BY site""")
QUERIES["gaussian_ks_distance"] = query(
    lambda s, d: T.laplace_vs_gaussian(pairs(s, d), ks=["gaussian"], keys=KEYS).filter("distribution = 'gaussian'").select("site", "ks_statistic"), "readings", "site *ks_statistic",
    f"""{AIC(PR)}, v AS (SELECT site, d, count(*) AS c FROM x GROUP BY 1, 2), w AS (SELECT site, d, c, sum(c) OVER (PARTITION BY site ORDER BY d) AS t FROM v),
        g AS (SELECT site, t / n AS top, (t - c) / n AS bottom, (d - gl) / gs AS z FROM w JOIN f USING (site)), e AS (SELECT site, top, bottom, {I.normal_cdf("z", 800)} AS p FROM g)
        SELECT site, max(greatest(top - p, p - bottom)) AS ks_statistic FROM e GROUP BY site""")
REG = lambda src, g="site": f"""(SELECT {g}, n, sign(r) * sy / sx AS b, my - sign(r) * sy / sx * mx AS a, sy / sx * sqrt((1 - r * r) / n) AS bse, r, mx,
  (n - 1) * (sy * sy - 2 * sign(r) * sy / sx * cv + sy * sy) / (n - 2) AS left_var, cv / (sx * sx) AS ob, my - cv / (sx * sx) * mx AS oa,
  sqrt((1 - r * r) * sy * sy / (sx * sx) / (n - 2)) AS obse, sx * sx * (n - 1) / n AS ssx FROM (SELECT {g}, count(*) AS n, corr(x, y) AS r, stddev_samp(x) AS sx, stddev_samp(y) AS sy,
  avg(x) AS mx, avg(y) AS my, covar_samp(x, y) AS cv FROM {src} GROUP BY {g}))"""
QUERIES["reduced_major_axis"] = query(
    lambda s, d: T.reduced_major_axis(pairs(s, d), "v_ref", "v_alt", KEYS), "readings", "site n *slope *slope_se *intercept *intercept_se *r",
    f"SELECT site, n, b AS slope, bse AS slope_se, a AS intercept, sqrt(left_var / n + (bse * mx) ** 2) AS intercept_se, r FROM {REG(PR)}")
QUERIES["ols_regression"] = query(
    lambda s, d: T.ols_regression(pairs(s, d), "v_ref", "v_alt", KEYS), "readings",
    "site n *slope *slope_se *t_slope_vs_1 *intercept *intercept_se *t_intercept_vs_0 *r2",
    f"""SELECT site, n, ob AS slope, obse AS slope_se, (ob - 1) / obse AS t_slope_vs_1, oa AS intercept, obse * sqrt(ssx + mx * mx) AS intercept_se,
        oa / (obse * sqrt(ssx + mx * mx)) AS t_intercept_vs_0, r * r AS r2 FROM {REG(PR)}""", 7)
QUANT = ", ".join(f"quantile_cont(abs(d), {q}) AS q{str(q).replace('.', '')}" for q in (0.99, 0.98, 0.95, 0.9))
SCREENS = [("none", "TRUE"), *[(f"|diff| <= q{q:g}", f"abs(d) <= q{str(q).replace('.', '')}") for q in (0.99, 0.98, 0.95, 0.9)],
           *[(f"|flux| < {m}", f"abs(x) < {m} AND abs(y) < {m}") for m in (200, 100, 50)],
           ("|flux| < 100 & |diff| <= q0.98", "abs(x) < 100 AND abs(y) < 100 AND abs(d) <= q098")]
SWEPT = REG("(SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT site, '{n}' AS screen, x, y FROM {PR} JOIN (SELECT site, {QUANT} FROM {PR} GROUP BY site) USING (site) WHERE {c}" for n, c in SCREENS) + "))", "site, screen")
sweep = lambda s, d: T.regression_sweep(pairs(s, d), "v_ref", "v_alt", keys=KEYS)
QUERIES["regression_sweep"] = query(
    sweep, "readings", "site screen n *rma_slope *rma_slope_se *rma_intercept *rma_intercept_se *ols_slope *ols_t_vs_1 *ols_intercept *ols_t_vs_0 *r",
    f"""SELECT site, screen, n, b AS rma_slope, bse AS rma_slope_se, a AS rma_intercept, sqrt(left_var / n + (bse * mx) ** 2) AS rma_intercept_se, ob AS ols_slope,
        (ob - 1) / obse AS ols_t_vs_1, oa AS ols_intercept, oa / (obse * sqrt(ssx + mx * mx)) AS ols_t_vs_0, r FROM {SWEPT}""", 6)
QUERIES["published_agreement"] = query(
    lambda s, d: T.published_agreement(sweep(s, d), {"slope": 1.1, "slope_se": 0.001, "intercept": -3.0, "intercept_se": 0.01}, KEYS), "readings",
    "site screen n *rma_slope *rma_intercept slope_in_range intercept_in_range both",
    f"""SELECT site, screen, n, b AS rma_slope, a AS rma_intercept, b BETWEEN 1.1 - 0.001 AND 1.1 + 0.001 AS slope_in_range, a BETWEEN -3.01 AND -2.99 AS intercept_in_range,
        b BETWEEN 1.1 - 0.001 AND 1.1 + 0.001 AND a BETWEEN -3.01 AND -2.99 AS both FROM {SWEPT}""", 6)

# ---- period statistics --------------------------------------------------------------------------------------------

CP = lambda src: f"""WITH x AS (SELECT * FROM {src} WHERE isf OR ist),
  st AS (SELECT site, covariate, count(*) FILTER (ist) AS n1, count(*) FILTER (isf) AS n2, avg(value) FILTER (ist) AS mean1, avg(value) FILTER (isf) AS mean2,
    var_samp(value) FILTER (ist) AS s1, var_samp(value) FILTER (isf) AS s2 FROM x GROUP BY 1, 2),
  u AS (SELECT a.site, a.covariate, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END) AS u FROM x a JOIN x b ON a.site = b.site AND a.covariate = b.covariate
        AND a.ist AND b.isf GROUP BY 1, 2),
  ks AS (SELECT site, covariate, max(abs(c1 / n1 - c2 / n2)) AS ks FROM (SELECT p.site, p.covariate, p.value, n1, n2, (SELECT count(*) FROM x a WHERE a.ist AND a.site = p.site AND
        a.covariate = p.covariate AND a.value <= p.value)::DOUBLE AS c1, (SELECT count(*) FROM x a WHERE a.isf AND a.site = p.site AND a.covariate = p.covariate AND a.value <= p.value)::DOUBLE AS c2
        FROM x p JOIN st USING (site, covariate)) GROUP BY 1, 2)
  SELECT site, covariate, n1, n2, mean1, mean2, mean1 - mean2 AS mean_difference, (mean1 - mean2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS standardised_difference,
  2 * u / (n1 * n2) - 1 AS cliffs_delta, ks AS ks_statistic FROM st JOIN u USING (site, covariate) JOIN ks USING (site, covariate)"""
CPC = "site covariate n1 n2 *mean1 *mean2 *mean_difference *standardised_difference *cliffs_delta *ks_statistic"
compared = lambda s, d, flat: T.compare_periods(B.covariates(s, d), fit(s, d), target(s, d), COVARIATES, flat, KEYS)
QUERIES["compare_periods"] = query(lambda s, d: compared(s, d, False).drop("mann_whitney_p", "ks_p"), "long_cov windows", CPC, CP(FT))
QUERIES["compare_periods_deseasonalised"] = query(
    lambda s, d: compared(s, d, True).drop("mann_whitney_p", "ks_p", "cliffs_delta", "ks_statistic"), "long_cov windows",
    "site covariate n1 n2 *mean1 *mean2 *mean_difference *standardised_difference",
    f"""WITH x AS (SELECT site, covariate, value - m AS value, isf, ist FROM {FT} JOIN (SELECT site, covariate, month(month) AS moy, avg(value) AS m FROM long_cov GROUP BY 1, 2, 3) c
          USING (site, covariate) WHERE month(month) = moy),
        st AS (SELECT site, covariate, count(*) FILTER (ist) AS n1, count(*) FILTER (isf) AS n2, avg(value) FILTER (ist) AS mean1, avg(value) FILTER (isf) AS mean2,
          var_samp(value) FILTER (ist) AS s1, var_samp(value) FILTER (isf) AS s2 FROM x GROUP BY 1, 2)
        SELECT site, covariate, n1, n2, mean1, mean2, mean1 - mean2 AS mean_difference, (mean1 - mean2) / sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS standardised_difference FROM st""")
QUERIES["period_test_p_values"] = query(
    lambda s, d: compared(s, d, False).select("site", "covariate", "mann_whitney_p", "ks_p"), "long_cov windows", "site covariate *mann_whitney_p *ks_p",
    f"""WITH cp AS ({CP(FT)}), ti AS (SELECT site, covariate, sum(t * t * t - t) AS ties FROM (SELECT site, covariate, value, count(*)::DOUBLE AS t FROM {FT} WHERE isf OR ist GROUP BY 1, 2, 3) GROUP BY 1, 2),
        us AS (SELECT *, (cliffs_delta + 1) / 2 * n1 * n2 AS u, n1 + n2 AS n FROM cp JOIN ti USING (site, covariate)),
        zs AS (SELECT *, greatest((greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1.0)))), 0) AS z, sqrt(n1 * n2 / n::DOUBLE) * ks_statistic AS k FROM us)
        SELECT site, covariate, {I.normal_p("z")} AS mann_whitney_p, {I.kolmogorov_p("k")} AS ks_p FROM zs""")


def yearly_samples(s, d):
    """Annual means of every covariate: the first three years of a series against all others."""
    rows = B.covariates(s, d).unpivot([*KEYS, "month"], COVARIATES, "covariate", "value").filter("value is not null")
    years = rows.groupBy(*KEYS, "covariate", F.year("month").alias("y")).agg(F.avg("value").alias("value"))
    first = F.rank().over(by(*KEYS, "covariate").orderBy("y")) <= 3
    return years.withColumn("early", first).withColumn("late", ~F.col("early"))


# All ways to call three of the years early: the share of those at least as far from the middle, and as far apart.
SPLITS3 = """yv AS (SELECT site, covariate, v, e, row_number() OVER (PARTITION BY site, covariate ORDER BY v) AS r, count(*) OVER (PARTITION BY site, covariate) AS n FROM (
    SELECT site, covariate, avg(value) AS v, rank() OVER (PARTITION BY site, covariate ORDER BY year(month)) <= 3 AS e FROM long_cov GROUP BY site, covariate, year(month))),
  tr AS (SELECT a.site, a.covariate, a.n, a.r AS i, b.r AS j, c.r AS k, a.e AND b.e AND c.e AS real FROM yv a JOIN yv b ON a.site = b.site AND a.covariate = b.covariate AND a.r < b.r
         JOIN yv c ON c.site = a.site AND c.covariate = a.covariate AND b.r < c.r),
  us AS (SELECT *, i + j + k - 6 AS u, 3 * (n - 3) AS top, (SELECT max(abs(((i <= r)::INT + (j <= r)::INT + (k <= r)::INT) / 3.0 - (r - (i <= r)::INT - (j <= r)::INT - (k <= r)::INT) / (n - 3.0))) FROM range(1, n + 1) p(r)) AS ks FROM tr),
  rl AS (SELECT site, covariate, greatest(u, top - u) AS m, u AS u0, ks AS k0 FROM us WHERE real)"""
QUERIES["exact_period_p_values"] = query(
    lambda s, d: T.exact_two_samples(yearly_samples(s, d), "early", "late", on=[*KEYS, "covariate"]), "long_cov", "site covariate n1 n2 *u *ks_statistic *mann_whitney_p *ks_p",
    f"""WITH {SPLITS3} SELECT site, covariate, CAST(3 AS BIGINT) AS n1, max(n) - 3 AS n2, max(u0) AS u, max(k0) AS ks_statistic, least(1, 2.0 * count(*) FILTER (u >= m) / count(*)) AS mann_whitney_p,
        1.0 * count(*) FILTER (ks >= k0 - 1e-9) / count(*) AS ks_p FROM us JOIN rl USING (site, covariate) GROUP BY 1, 2""")
QUERIES["early_late_contrast"] = query(
    lambda s, d: T.early_late_contrast(B.covariates(s, d), COVARIATES, ("1995-01-01", "1996-12-01"), ("2000-01-01", "2001-12-01"), KEYS).drop("mann_whitney_p"),
    "long_cov", "site covariate *early_mean *late_mean *difference",
    """SELECT site, covariate, round_even(e, 3) AS early_mean, round_even(l, 3) AS late_mean, round_even(l - e, 3) AS difference FROM (SELECT site, covariate,
       avg(value) FILTER (month BETWEEN DATE '1995-01-01' AND DATE '1996-12-01') AS e, avg(value) FILTER (month BETWEEN DATE '2000-01-01' AND DATE '2001-12-01') AS l
       FROM long_cov GROUP BY 1, 2) WHERE e IS NOT NULL AND l IS NOT NULL""")
QUERIES["axis_independence"] = query(
    lambda s, d: T.axis_independence(fits(s, d), COVARIATES, KEYS).drop("p_value"), "long_cov windows", "site covariate n *correlation_with_time",
    f"SELECT site, covariate, count(*) AS n, corr({MI}, value) AS correlation_with_time FROM long_cov JOIN {FIT} USING (site, month) GROUP BY 1, 2")
CORR_P = lambda r, n: f"CASE WHEN abs({r}) < 1 THEN {I.t_p(f'{r} * sqrt({n} - 2) / sqrt(1 - {r} * {r})', f'{n} - 2')} ELSE 0 END"
QUERIES["axis_independence_p"] = query(
    lambda s, d: T.axis_independence(fits(s, d), COVARIATES, KEYS).select("site", "covariate", "p_value"), "long_cov windows", "site covariate *p_value",
    f"""SELECT site, covariate, {CORR_P("r", "n")} AS p_value FROM (SELECT site, covariate, count(*) AS n, corr({MI}, value) AS r FROM long_cov JOIN {FIT} USING (site, month) GROUP BY 1, 2)""")
QUERIES["covariate_anomaly"] = query(
    lambda s, d: T.covariate_anomaly(B.covariates(s, d), target(s, d), fit(s, d), COVARIATES, KEYS), "long_cov windows",
    "site covariate *period_mean *reference_mean *difference *standardized *period_max *reference_max",
    f"""SELECT site, covariate, round_even(t, 3) AS period_mean, round_even(f, 3) AS reference_mean, round_even(t - f, 3) AS difference, CASE WHEN s > 0 THEN round_even((t - f) / s, 2) END AS standardized,
        round_even(tm, 3) AS period_max, round_even(fm, 3) AS reference_max FROM (SELECT site, covariate, avg(value) FILTER (ist) AS t, avg(value) FILTER (isf) AS f,
        stddev_samp(value) FILTER (isf) AS s, max(value) FILTER (ist) AS tm, max(value) FILTER (isf) AS fm FROM {FT} GROUP BY 1, 2)""")
ANN = f"FROM {FITS} GROUP BY site, year(month)"
QUERIES["annual_means"] = query(
    lambda s, d: A.annual_means(B.covariates(s, d), COVARIATES, fit(s, d), KEYS), "windows", "site i:year n_months " + " ".join(f"*{c}" for c in COVARIATES),
    f"SELECT site, year(month) AS year, count(*) AS n_months, {', '.join(f'round_even(avg({c}), 3) AS {c}' for c in COVARIATES)} {ANN}")
QUERIES["monthly_flux_to_annual"] = query(
    lambda s, d: A.monthly_flux_to_annual(B.flux(s, d), "flux_mean", KEYS), "flux", "site i:year n_months *g_ch4_m2 *g_c_m2",
    """SELECT site, year(month) AS year, count(*) AS n_months, round_even(sum(flux_mean * day(last_day(month)) * 86400 * 1e-9 * 16.043), 3) AS g_ch4_m2,
       round_even(sum(flux_mean * day(last_day(month)) * 86400 * 1e-9 * 16.043) * (12.011::DOUBLE / 16.043), 3) AS g_c_m2 FROM flux GROUP BY 1, 2""")
QUERIES["holdout_against_published"] = query(
    lambda s, d: V.holdout_against_published(A.monthly_flux_to_annual(B.flux(s, d), "flux_mean", KEYS), {1998: (14.0, 2.0), 1999: (12.0, 0.5)}, KEYS), "flux",
    "site i:year n_months_integrated *predicted_g_c_m2 *published_g_c_m2 *uncertainty_g_c *difference_g_c within_interval",
    """SELECT site, y AS year, n AS n_months_integrated, round_even(g, 2) AS predicted_g_c_m2, v AS published_g_c_m2, u AS uncertainty_g_c, round_even(g - v, 2) AS difference_g_c, abs(g - v) <= u AS within_interval
       FROM (SELECT site, year(month) AS y, count(*) AS n, round_even(sum(flux_mean * day(last_day(month)) * 86400 * 1e-9 * 16.043) * (12.011::DOUBLE / 16.043), 3) AS g FROM flux GROUP BY 1, 2)
       JOIN (VALUES (1998, 14.0::DOUBLE, 2.0::DOUBLE), (1999, 12.0, 0.5)) p(y2, v, u) ON y2 = y""")
obs_pred = lambda s, d: T.monthly_comparison(
    B.flux(s, d).select(*ON, F.col("flux_mean").alias("observed")), B.covariates(s, d).select(*ON, F.col("soil_temp_f").alias("p")).filter("p is not null").select(*ON, (F.col("p") * 1.5).alias("predicted")), KEYS)
GC = "day(last_day(month)) * 86400 * 1e-9 * 16.043 * (12.011::DOUBLE / 16.043)"
OP = f"""(SELECT site, month, flux_mean AS observed, soil_temp_f * 1.5 AS predicted, flux_mean * {GC} AS observed_g_c, soil_temp_f * 1.5 * {GC} AS predicted_g_c,
  flux_mean * {GC} - soil_temp_f * 1.5 * {GC} AS shortfall_g_c, soil_temp_f * 1.5 / flux_mean AS ratio FROM flux JOIN cov USING (site, month) WHERE soil_temp_f IS NOT NULL)"""
QUERIES["monthly_comparison"] = query(
    obs_pred, "cov flux", "site month *observed *predicted *observed_g_c *predicted_g_c *shortfall_g_c *ratio", f"SELECT * FROM {OP}")
QUERIES["concentration"] = query(
    lambda s, d: T.concentration(obs_pred(s, d), keys=KEYS), "cov flux",
    "site *total_shortfall n_months n_months_under_predicted *top_1_share_pct *top_2_share_pct *top_3_share_pct largest_month *largest_value *sum_of_positive",
    f"""SELECT site, sum(v) AS total_shortfall, count(*) AS n_months, count(*) FILTER (v > 0) AS n_months_under_predicted,
        {", ".join(f"round_even(100 * sum(v) FILTER (k <= {k}) / sum(v), 1) AS top_{k}_share_pct" for k in (1, 2, 3))}, arg_min(month, k) AS largest_month,
        round_even(max(v), 3) AS largest_value, round_even(coalesce(sum(v) FILTER (v > 0), 0), 3) AS sum_of_positive
        FROM (SELECT site, month, shortfall_g_c AS v, row_number() OVER (PARTITION BY site ORDER BY shortfall_g_c DESC, month) AS k FROM {OP}) GROUP BY site""")
CLIM = """(SELECT f.site, f.month, f.flux_mean, month(f.month) AS month_of_year, m AS reference_mean, sd AS reference_sd FROM flux f LEFT JOIN
  (SELECT site, month(month) AS moy, avg(flux_mean) AS m, stddev_samp(flux_mean) AS sd FROM flux WHERE year(month) <> 1999 GROUP BY 1, 2) c ON c.site = f.site AND c.moy = month(f.month)
  WHERE year(f.month) = 1999)"""
clim_args = lambda s, d: (B.flux(s, d).filter("year(month) = 1999").select(*ON, "flux_mean"), B.flux(s, d).filter("year(month) <> 1999"))
QUERIES["climatology_lookup"] = query(
    lambda s, d: T.climatology_lookup(*clim_args(s, d), "flux_mean", KEYS), "flux", "site month *flux_mean i:month_of_year *reference_mean *reference_sd", f"SELECT * FROM {CLIM}")
QUERIES["extreme_months"] = query(
    lambda s, d: T.extreme_months(*clim_args(s, d), "flux_mean", 5, KEYS), "flux", "site month *flux *reference_mean *reference_sd *standardized",
    f"""SELECT site, month, round_even(flux_mean, 3) AS flux, round_even(reference_mean, 3) AS reference_mean, round_even(reference_sd, 3) AS reference_sd, round_even(z, 3) AS standardized FROM
        (SELECT *, row_number() OVER (PARTITION BY site ORDER BY z DESC, month) AS k FROM (SELECT *, (flux_mean - reference_mean) / reference_sd AS z FROM {CLIM} WHERE reference_sd > 0)) WHERE k <= 5""")
band_rows = lambda s, d: key_join(B.flux(s, d), B.covariates(s, d), ON, "inner").withColumn("residual", F.ln("flux_mean") - F.ln("soil_temp_f") - 0.38)
QUERIES["bias_by_band"] = query(
    lambda s, d: T.bias_by_band(band_rows(s, d), "residual", "wte_m", 3, KEYS), "cov flux", "site i:band n *covariate_mean *bias_log *prediction_error_pct direction",
    f"""WITH x AS (SELECT site, wte_m AS c, ln(flux_mean) - ln(soil_temp_f) - 0.38 AS r FROM flux JOIN cov USING (site, month) WHERE soil_temp_f IS NOT NULL AND wte_m IS NOT NULL),
        e AS (SELECT site, quantile_cont(c, 1 / 3.0) AS e1, quantile_cont(c, 2 / 3.0) AS e2 FROM x GROUP BY 1)
        SELECT site, CASE WHEN c <= e1 THEN 1 WHEN c <= e2 THEN 2 ELSE 3 END AS band, count(*) AS n, round_even(avg(c), 4) AS covariate_mean, round_even(avg(r), 4) AS bias_log,
        round_even(100 * (exp(-avg(r)) - 1), 4) AS prediction_error_pct, {DIRECTION('avg(r)')} AS direction FROM x JOIN e USING (site) GROUP BY 1, 2""")

# ---- seasonal structure -------------------------------------------------------------------------------------------

series = B.series
OBS = "(SELECT site, month, value, month(month) AS moy FROM series WHERE value IS NOT NULL)"
FLAT = f"(SELECT *, value - avg(value) OVER (PARTITION BY site, moy) AS left_over, avg(value) OVER (PARTITION BY site, moy) AS rep FROM {OBS})"
QUERIES["deseasonalise"] = query(
    lambda s, d: T.deseasonalise(series(s, d), ["value"], KEYS).filter("value is not null"), "series", "site month *value", f"SELECT site, month, left_over AS value FROM {FLAT}", 6)
QUERIES["seasonal_parts"] = query(
    lambda s, d: T.seasonal_parts(series(s, d), keys=KEYS), "series", "site month *observed *repeating *leftover", f"SELECT site, month, value AS observed, rep AS repeating, left_over AS leftover FROM {FLAT}", 6)
QUERIES["seasonal_parts_summary"] = query(
    lambda s, d: T.seasonal_parts_summary(T.seasonal_parts(series(s, d), keys=KEYS), KEYS), "series", "site n *explained *left_share",
    f"SELECT site, count(*) AS n, 1 - var_samp(left_over) / var_samp(value) AS explained, stddev_samp(left_over) / stddev_samp(value) AS left_share FROM {FLAT} GROUP BY site")
QUERIES["yearly_swing"] = query(
    lambda s, d: T.yearly_swing(series(s, d), keys=KEYS), "series", "site i:year n_months *swing",
    f"SELECT site, year(month) AS year, count(*) AS n_months, max(value) - min(value) AS swing FROM {OBS} GROUP BY 1, 2 HAVING count(*) >= 10", 6)
ACF = f"""WITH x AS (SELECT site, month, value - avg(value) OVER (PARTITION BY site) AS x, row_number() OVER (PARTITION BY site ORDER BY month) AS k FROM {OBS}),
  acf AS (SELECT a.site, lag, count(*) OVER () AS dummy, sum(a.x * b.x) / max(dd) AS autocorrelation, max(n) AS n FROM x a JOIN (SELECT site, sum(x * x) AS dd, count(*) AS n FROM x GROUP BY 1) t USING (site),
  (SELECT unnest(range(0, 14)) AS lag) g JOIN x b ON b.site = a.site AND b.k = a.k - lag GROUP BY a.site, lag)"""
QUERIES["autocorrelation"] = query(
    lambda s, d: T.autocorrelation(series(s, d), keys=KEYS), "series", "site n i:lag *autocorrelation", f"{ACF} SELECT site, n, lag, autocorrelation FROM acf")
QUERIES["seasonal_significance"] = query(
    lambda s, d: T.seasonal_significance(T.autocorrelation(series(s, d), keys=KEYS), keys=KEYS), "series", "site n *seasonal_autocorrelation *bartlett_se *z significant",
    f"""{ACF} SELECT site, n, a AS seasonal_autocorrelation, se AS bartlett_se, a / se AS z, abs(a / se) > 1.96 AS significant FROM (SELECT site, max(n) AS n,
        max(autocorrelation) FILTER (lag = 12) AS a, sqrt((1 + 2 * sum(autocorrelation * autocorrelation) FILTER (lag BETWEEN 1 AND 11)) / max(n)) AS se FROM acf GROUP BY site)""")
QUERIES["trend_tests"] = query(
    lambda s, d: T.trend_tests(series(s, d), keys=KEYS).drop("trend_p", "deseasonalised_trend_p", "amplitude_trend_p"), "series",
    "site n *trend_per_year *deseasonalised_trend_per_year n_years *amplitude_mean *amplitude_min *amplitude_max *amplitude_cv_pct *amplitude_trend_per_year",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY month) - 1 AS t FROM {FLAT}),
        a AS (SELECT site, year(month) AS y, max(value) - min(value) AS a FROM {OBS} GROUP BY 1, 2 HAVING count(*) >= 10)
        SELECT site, n, trend_per_year, deseasonalised_trend_per_year, n_years, amplitude_mean, amplitude_min, amplitude_max, amplitude_cv_pct, amplitude_trend_per_year
        FROM (SELECT site, count(*) AS n, regr_slope(value, t) * 12 AS trend_per_year, regr_slope(left_over, t) * 12 AS deseasonalised_trend_per_year FROM f GROUP BY 1)
        JOIN (SELECT site, count(*) AS n_years, avg(a) AS amplitude_mean, min(a) AS amplitude_min, max(a) AS amplitude_max, 100 * stddev_samp(a) / avg(a) AS amplitude_cv_pct,
              regr_slope(a, y) AS amplitude_trend_per_year FROM a GROUP BY 1) USING (site)""", 6)
QUERIES["trend_test_p_values"] = query(
    lambda s, d: T.trend_tests(series(s, d), keys=KEYS).select("site", "trend_p", "deseasonalised_trend_p", "amplitude_trend_p"), "series",
    "site *trend_p *deseasonalised_trend_p *amplitude_trend_p",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY month) - 1 AS t FROM {FLAT}),
        a AS (SELECT site, year(month) AS y, max(value) - min(value) AS a FROM {OBS} GROUP BY 1, 2 HAVING count(*) >= 10),
        r AS (SELECT site, count(*) AS n, corr(value, t) AS r1, corr(left_over, t) AS r2 FROM f GROUP BY 1), w AS (SELECT site, count(*) AS m, corr(a, y) AS r3 FROM a GROUP BY 1)
        SELECT site, {CORR_P("r1", "n")} AS trend_p, {CORR_P("r2", "n")} AS deseasonalised_trend_p, {CORR_P("r3", "m")} AS amplitude_trend_p FROM r JOIN w USING (site)""")


def calendar_fit(source: str, group: str) -> str:
    """Rows of ``source`` (group, month, v and others) with v centred and what the calendar terms leave of it, term after term."""
    sums = lambda x, y: f"sum({x} * {y}) OVER (PARTITION BY {group})"
    off = lambda x, z: f"{x} - {z} * {sums(x, z)} / {sums(z, z)} AS {x}"
    terms = "sin(2 * pi() * month(month) / 12) AS a, cos(2 * pi() * month(month) / 12) AS b, (month(month) - 1) / 12.0 AS c"
    out = f"(SELECT * EXCLUDE (v, a, b, c), {', '.join(f'{x} - avg({x}) OVER (PARTITION BY {group}) AS {x}' for x in 'abcv')} FROM (SELECT *, {terms} FROM {source}))"
    out = f"(SELECT *, v AS e FROM {out})"
    for z, left in (("a", "bce"), ("b", "ce"), ("c", "e")):
        out = f"(SELECT * EXCLUDE ({', '.join(left)}), {', '.join(off(x, z) for x in left)} FROM {out})"
    return out


CALENDAR = f"""SELECT site, covariate, count(*) AS n, CASE WHEN count(*) >= 12 THEN 1 - sum(e * e) / sum(v * v) END AS explained
        FROM {calendar_fit("(SELECT site, month, covariate, value AS v FROM long_cov)", "site, covariate")} GROUP BY 1, 2"""
QUERIES["explained_by_calendar"] = query(
    lambda s, d: T.explained_by_calendar(B.covariates(s, d), COVARIATES, KEYS), "long_cov", "site covariate n *explained", CALENDAR)
LAGGED = " UNION ALL ".join(
    f"SELECT site, CAST(month + INTERVAL {k} MONTH AS DATE) AS month, '{c}_lag{k}' AS predictor, {c} AS v FROM cov WHERE {c} IS NOT NULL" for c, k in [("soil_temp_f", 1), ("wte_m", 1), ("wte_m", 2)])
QUERIES["seasonal_redundancy"] = query(
    lambda s, d: T.seasonal_redundancy(series(s, d), R.regrid(B.covariates(s, d), KEYS), [("soil_temp_f", 1), ("wte_m", 1), ("wte_m", 2)], keys=KEYS), "series cov",
    "site predictor n *explained_by_calendar *partial_r *p",
    f"""WITH l AS (SELECT l.*, left_over AS y FROM ({LAGGED}) l JOIN {FLAT} f USING (site, month) JOIN (SELECT site, max(month) AS last FROM cov GROUP BY 1) USING (site) WHERE l.month <= last),
        r AS (SELECT site, predictor, count(*) AS n, 1 - sum(e * e) / sum(v * v) AS ex, corr(e, y) AS r FROM {calendar_fit("l", "site, predictor")} GROUP BY 1, 2)
        SELECT site, predictor, n, round_even(ex, 3) AS explained_by_calendar, round_even(r, 3) AS partial_r, round_even({CORR_P("r", "n")}, 4) AS p FROM r""")
QUERIES["series_profile"] = query(
    lambda s, d: A.series_profile(B.flux(s, d).withColumn("v", F.col("flux_mean") - 38), "v", "flux_days", 15, KEYS), "flux",
    "site n_months first last b:span_months b:n_absent *median_days min_days max_days months_under_few_days *mean *min *max crosses_zero months_at_or_above_zero",
    f"""SELECT site, count(*) AS n_months, min(month) AS "first", max(month) AS "last", max({MI}) - min({MI}) + 1 AS span_months, max({MI}) - min({MI}) + 1 - count(*) AS n_absent,
        quantile_cont(flux_days, 0.5) AS median_days, min(flux_days) AS min_days, max(flux_days) AS max_days, count(*) FILTER (flux_days < 15) AS months_under_few_days,
        avg(flux_mean - 38) AS mean, min(flux_mean - 38) AS min, max(flux_mean - 38) AS max, min(flux_mean - 38) < 0 AND max(flux_mean - 38) > 0 AS crosses_zero,
        count(*) FILTER (flux_mean - 38 >= 0) AS months_at_or_above_zero FROM flux GROUP BY site""")
QUERIES["lag_months"] = query(
    lambda s, d: L.lag_months(series(s, d), ["value"], [1, 12], KEYS), "series", "site month *value *value_lag1 *value_lag12",
    """SELECT a.site, a.month, a.value, b.value AS value_lag1, c.value AS value_lag12 FROM series a LEFT JOIN series b ON b.site = a.site AND b.month = a.month - INTERVAL 1 MONTH
       LEFT JOIN series c ON c.site = a.site AND c.month = a.month - INTERVAL 12 MONTH""", 6)
QUERIES["lag_rows"] = query(
    lambda s, d: L.lag_rows(series(s, d), "value", 12, "back", KEYS), "series", "site month *value *back",
    f"""SELECT s.site, s.month, s.value, back FROM series s LEFT JOIN (SELECT site, month, lag(value, 12) OVER (PARTITION BY site ORDER BY month) AS back FROM {OBS}) o
        ON o.site = s.site AND o.month = s.month""", 6)

# ---- over all months of the flux table ----------------------------------------------------------------------------

WHOLE = {
    "weight_summary": (lambda f: W.weight_summary(f, ["flux_days", "flux_obs", "flux_sd"], "flux_se", KEYS), 4),
    "weight_concentration": (lambda f: W.weight_concentration(f, "flux_se", keys=KEYS), 4),
    "least_influential": (lambda f: W.least_influential(f, "flux_se", 12, ["flux_mean"], KEYS), 4),
    "most_influential": (lambda f: W.most_influential(f, "flux_se", 6, ["flux_mean"], KEYS), 4),
    "seasonal_weight_balance": (lambda f: W.seasonal_weight_balance(f, "flux_mean", "flux_se", KEYS), 4),
    "monthly_flux_to_annual": (lambda f: A.monthly_flux_to_annual(f, "flux_mean", KEYS), 8),
    "series_profile": (lambda f: A.series_profile(f.withColumn("v", F.col("flux_mean") - 38), "v", "flux_days", 15, KEYS), 8),
    "log_target": (lambda f: D.log_target(f, "flux_mean").select(*ON, "y", C.log_standard_error("flux_se", "flux_mean").alias("se_log"),
                                                                  C.inverse_variance_weight("flux_se").alias("weight")), 8),
}
for _name, (_run, _digits) in WHOLE.items():
    QUERIES[f"{_name}_whole"] = whole(_run, QUERIES[_name], _digits)
