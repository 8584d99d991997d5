"""Queries over half-hourly readings: cleaning, merging, aggregation, quality, coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators import aggregate as A
from fluxspark.operators import coverage as V
from fluxspark.operators import merge as M
from fluxspark.operators import quality as Q
from fluxspark.operators import reshape as R
from fluxspark.operators.common import shared_folder
from fluxspark.plans import bindings as B
from fluxspark.plans.bindings import KEYS, SLUGS, VALUES, query
from fluxspark.sources import readers as S
from fluxspark.sources import sinks

QUERIES = {}
MONTH = "CAST(date_trunc('month', ts) AS DATE)"
HALF = "hour(ts) * 2 + minute(ts) // 30"
SRC = list(SLUGS)
G = K.GRAMS_PER_SLOT

# ---- sources ------------------------------------------------------------------------------------

QUERIES["parse_stamps"] = query(
    lambda s, d: B.readings_raw(s, d).select(
        "site", "o", S.parse_stamp(F.date_format("ts", "yyyyMMddHHmm")).alias("ts"),
        C.clean_value(F.col("v_base").cast("string"), tolerant=False).alias("v"),
    ),
    "readings_raw", "site o ts *v",
    "SELECT site, o, date_trunc('minute', ts) AS ts, nullif(v_base, -9999.0) AS v FROM readings_raw",
)
QUERIES["clean_sentinel"] = query(
    lambda s, d: S.clean_sentinel(
        B.readings_raw(s, d).withColumn("v_base", F.when(F.col("o") % 17 == 0, F.lit("bad")).otherwise(F.col("v_base").cast("string"))),
        ["v_base"],
    ).select("site", "o", "ts", "v_base"),
    "readings_raw", "site o ts *v_base",
    """SELECT site, o, ts, CASE WHEN o % 17 <> 0 AND NOT (abs(v_base + 9999.0) <= 1e-8 + 1e-5 * 9999.0) THEN v_base END AS v_base
       FROM readings_raw""",
)
QUERIES["select_value_columns"] = query(
    lambda s, d: S.select_value_columns(B.readings(s, d), ["v_ref", "v_alt"], keys=KEYS),
    "readings", "site ts *v_ref *v_alt", "SELECT site, ts, v_ref, v_alt FROM readings",
)
QUERIES["readings_to_month_mean"] = query(
    lambda s, d: S.readings_to_month_mean(
        B.table(s, d, "lineitem").select(F.date_format("l_shipdate", "MM/yyyy").alias("when"), F.col("l_quantity").cast("string").alias("c")),
        "when", "c", "soil_temp",
    ),
    "", "month *soil_temp_f soil_temp_n",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) * 9 / 5 + 32 AS soil_temp_f, count(*) AS soil_temp_n
       FROM lineitem GROUP BY 1""",
)
QUERIES["metadata_value"] = query(
    lambda s, d: Q.metadata_value(
        B.table(s, d, "events").select("user_id", F.col("event_type").alias("variable"), F.col("props").alias("value"), "event_id"),
        "click", "event_id", ["user_id"],
    ),
    "", "user_id value",
    """SELECT user_id, arg_min(CASE WHEN event_type = 'click' THEN props END, CASE WHEN event_type = 'click' THEN event_id END) AS value
       FROM events GROUP BY user_id""",
)

# ---- row-local ------------------------------------------------------------------------------------

QUERIES["time_keys"] = query(
    lambda s, d: R.add_time_keys(B.readings(s, d).select("site", "ts")),
    "readings", "site ts month date i:year i:month_of_year i:hour i:half_hour season *decimal_year",
    f"""SELECT site, ts, {MONTH} AS month, CAST(ts AS DATE) AS date, year(ts) AS year, month(ts) AS month_of_year, hour(ts) AS hour,
        {HALF} AS half_hour, CASE WHEN month(ts) IN (6, 7, 8) THEN 'JJA' ELSE 'other' END AS season,
        year(ts) + (month(ts) - 1) / 12.0 AS decimal_year FROM readings""",
)
QUERIES["temperature_units"] = query(
    lambda s, d: B.readings(s, d).select(
        "site", "ts", C.fahrenheit_to_celsius("v_ref").alias("c"), C.celsius_to_fahrenheit("v_ref").alias("f")),
    "readings", "site ts *c *f",
    "SELECT site, ts, (v_ref - 32) * 5 / 9 AS c, v_ref * 9 / 5 + 32 AS f FROM readings",
)
QUERIES["flux_units"] = query(
    lambda s, d: B.merged(s, d).select(
        "site", "ts", (C.flux_to_grams_per_slot("value") * 1e6).alias("ug"), C.methane_to_carbon("value").alias("c"),
        C.carbon_to_methane("value").alias("ch4"), C.monthly_flux_to_grams("value", "ts").alias("g_month")),
    "merged", "site ts *ug *c *ch4 *g_month",
    f"""SELECT site, ts, value * 1e-9 * {K.MOLAR_MASS_CH4} * 1800 * 1e6 AS ug, value * (12.011::DOUBLE / 16.043) AS c,
        value / (12.011::DOUBLE / 16.043) AS ch4, value * day(last_day(ts)) * 86400 * 1e-9 * {K.MOLAR_MASS_CH4} AS g_month FROM merged""",
)
QUERIES["sector_membership"] = query(
    lambda s, d: B.readings(s, d).select("site", "ts", "wd", C.sector_membership("wd").alias("inside")),
    "readings", "site ts wd inside",
    "SELECT site, ts, wd, coalesce(wd >= 30 AND wd < 200, FALSE) AS inside FROM readings",
)
QUERIES["source_slug"] = query(
    lambda s, d: B.merged(s, d).filter("value is not null").select("site", "ts", C.slug_of("source", SLUGS).alias("slug")),
    "merged", "site ts slug",
    "SELECT site, ts, CASE source WHEN 'base unit' THEN 'base' WHEN 'ref-1' THEN 'ref' ELSE 'alt' END AS slug FROM merged WHERE value IS NOT NULL",
)
QUERIES["project_metres"] = query(
    lambda s, d: B.table(s, d, "events").select(
        "event_id",
        *[c.alias(n) for c, n in zip(C.project_metres(-93.489 + F.col("value") / 1e4, 47.505 + F.col("user_id") / 1e5, -93.489, 47.505), "xy")]),
    "", "event_id *x *y",
    """SELECT event_id, ((-93.489 + value / 1e4) - (-93.489)) * (111320.0 * cos(radians(47.505))) AS x,
       ((47.505 + user_id / 1e5) - 47.505) * 110570.0 AS y FROM events""", 4,
)

# ---- reshape ----------------------------------------------------------------------------------------

LONG = """(SELECT site, ts, o, 'v_base' AS "column", v_base AS value FROM readings UNION ALL
           SELECT site, ts, o, 'v_ref', v_ref FROM readings UNION ALL SELECT site, ts, o, 'v_alt', v_alt FROM readings)"""
QUERIES["to_long"] = query(
    lambda s, d: R.to_long(B.readings(s, d), VALUES, ["site", "ts"]),
    "readings", "site ts column *value date",
    f"""SELECT site, ts, "column", value, CAST(ts AS DATE) AS date FROM {LONG} WHERE value IS NOT NULL""",
)
QUERIES["pivot_counts"] = query(
    lambda s, d: R.pivot_counts(B.merged(s, d).filter("value is not null").withColumn("year", F.year("ts")), ["site", "year"], "source", SRC),
    "merged", "site i:year " + " ".join(x.replace(" ", "~") for x in SRC),
    """SELECT site, year(ts) AS year, count(*) FILTER (source = 'base unit') AS "base unit", count(*) FILTER (source = 'ref-1') AS "ref-1",
       count(*) FILTER (source = 'alt/2') AS "alt/2" FROM merged WHERE value IS NOT NULL GROUP BY 1, 2""",
)
QUERIES["month_grid"] = query(
    lambda s, d: R.month_grid(B.readings(s, d).groupBy("site").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last")), keys=KEYS),
    "readings", "site month",
    f"""SELECT site, CAST(unnest(generate_series(min({MONTH}), max({MONTH}), INTERVAL 1 MONTH)) AS DATE) AS month FROM readings GROUP BY site""",
)

# ---- merge ------------------------------------------------------------------------------------------

QUERIES["merge_precedence"] = query(
    lambda s, d: B.merged(s, d), "merged", "site ts wd *value source_column source i:n_reporting", "SELECT * FROM merged")
QUERIES["merged_value"] = query(
    lambda s, d: M.merged_value(B.readings(s, d), VALUES).select("site", "ts", "value"),
    "merged", "site ts *value", "SELECT site, ts, value FROM merged")
QUERIES["paired"] = query(
    lambda s, d: M.paired(B.readings(s, d).select("site", "ts", "v_ref", "v_alt"), "v_ref", "v_alt"),
    "readings", "site ts *v_ref *v_alt *difference",
    "SELECT site, ts, v_ref, v_alt, v_ref - v_alt AS difference FROM readings WHERE v_ref IS NOT NULL AND v_alt IS NOT NULL")
PAIRS = [("v_base", "v_ref"), ("v_base", "v_alt"), ("v_ref", "v_alt")]
QUERIES["pairwise_overlap"] = query(
    lambda s, d: M.pairwise_overlap(B.readings(s, d), VALUES, KEYS),
    "readings", "site left right n_both *correlation n_identical *mean_difference",
    " UNION ALL ".join(
        f"""SELECT site, '{a}' AS "left", '{b}' AS "right", count({a} + {b}) AS n_both, corr({a}, {b}) AS correlation,
        CASE WHEN count({a} + {b}) > 0 THEN count(*) FILTER ({a} = {b}) END AS n_identical, avg({a} - {b}) AS mean_difference
        FROM readings GROUP BY site""" for a, b in PAIRS))
QUERIES["assert_disjoint"] = query(
    lambda s, d: M.assert_disjoint(
        B.readings(s, d).withColumns({"early": F.when(F.col("o") % 2 == 0, F.col("v_ref")), "late": F.when(F.col("o") % 2 == 1, F.col("v_ref"))}),
        ["early", "late"]).groupBy("site").agg(F.count("early").alias("n_early"), F.count("late").alias("n_late")),
    "readings", "site n_early n_late",
    "SELECT site, count(v_ref) FILTER (o % 2 = 0) AS n_early, count(v_ref) FILTER (o % 2 = 1) AS n_late FROM readings GROUP BY site")
QUERIES["provenance_summary"] = query(
    lambda s, d: M.provenance_summary(B.merged(s, d), keys=KEYS),
    "merged", "site source_column source n *pct",
    """SELECT site, source_column, source, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY site), 2) AS pct
       FROM merged WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
QUERIES["provenance_by_year"] = query(
    lambda s, d: M.provenance_by_year(B.merged(s, d), SRC, keys=KEYS),
    "merged", "site i:year base~unit ref-1 alt/2 total",
    """SELECT site, year(ts) AS year, count(*) FILTER (source = 'base unit') AS "base unit", count(*) FILTER (source = 'ref-1') AS "ref-1",
       count(*) FILTER (source = 'alt/2') AS "alt/2", count(*) AS total FROM merged WHERE value IS NOT NULL GROUP BY 1, 2""")
QUERIES["contention_summary"] = query(
    lambda s, d: M.contention_summary(B.merged(s, d), ["v_base", "v_ref"], keys=KEYS),
    "merged", "site slots_with_value contested_slots b:discarded resolved_to_v_base resolved_to_v_ref",
    """SELECT site, count(value) AS slots_with_value, count(*) FILTER (n_reporting > 1) AS contested_slots,
       coalesce(sum(n_reporting - 1) FILTER (n_reporting > 1), 0) AS discarded,
       count(*) FILTER (n_reporting > 1 AND source_column = 'v_base') AS resolved_to_v_base,
       count(*) FILTER (n_reporting > 1 AND source_column = 'v_ref') AS resolved_to_v_ref FROM merged GROUP BY site""")
RUNS = """
  SELECT site, source, min(ts) AS "first", max(ts) AS "last", count(*) AS n FROM (
    SELECT site, ts, source, sum(c) OVER (PARTITION BY site ORDER BY ts) AS g FROM (
      SELECT site, ts, source, CASE WHEN source = lag(source) OVER (PARTITION BY site ORDER BY ts) THEN 0 ELSE 1 END AS c
      FROM merged WHERE value IS NOT NULL)) GROUP BY site, source, g"""
runs = lambda s, d: M.source_runs(B.merged(s, d), keys=KEYS)
QUERIES["source_runs"] = query(runs, "merged", "site source first last n", RUNS)
QUERIES["switch_summary"] = query(
    lambda s, d: M.switch_summary(runs(s, d), KEYS),
    "merged", "site i:year n_runs n_switches *median_run b:max_run sources",
    f"""SELECT site, year("first") AS year, count(*) AS n_runs, count(*) FILTER (k > 1) AS n_switches, quantile_cont(n, 0.5) AS median_run,
        max(n) AS max_run, string_agg(DISTINCT source, '/' ORDER BY source) AS sources
        FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY "first") AS k FROM ({RUNS})) GROUP BY 1, 2""")
QUERIES["total_switches"] = query(
    lambda s, d: M.total_switches(runs(s, d), KEYS), "merged", "site b:switches",
    f"SELECT site, greatest(count(*) - 1, 0) AS switches FROM ({RUNS}) GROUP BY site")
QUERIES["structural_boundaries"] = query(
    lambda s, d: M.structural_boundaries(runs(s, d), 12), "merged", "site source first last n",
    f"SELECT * FROM ({RUNS}) WHERE n >= 12")


def labelled(s, d):
    long = R.to_long(B.readings(s, d), VALUES, ["site", "ts", "o"]).drop("o")
    kept = R.to_long(B.readings(s, d), VALUES, ["site", "ts", "o"]).filter(F.col("o") % 3 == 0)
    return M.label_multiset_subset(long, kept.select("site", "date", F.bround("value", 3).alias("rounded")), keys=KEYS)


LABELLED = f"""
  SELECT l.site, l.ts, l."column", l.value, l.date, l.rounded, l.k <= coalesce(w.n, 0) AS in_derived FROM (
    SELECT site, ts, "column", value, CAST(ts AS DATE) AS date, round_even(value, 3) AS rounded,
           row_number() OVER (PARTITION BY site, CAST(ts AS DATE), round_even(value, 3) ORDER BY ts, "column") AS k
    FROM {LONG} WHERE value IS NOT NULL) l
  LEFT JOIN (SELECT site, CAST(ts AS DATE) AS date, round_even(value, 3) AS rounded, count(*) AS n FROM {LONG}
             WHERE value IS NOT NULL AND o % 3 = 0 GROUP BY 1, 2, 3) w USING (site, date, rounded)"""
QUERIES["label_multiset_subset"] = query(labelled, "readings", "site ts column *value date *rounded in_derived", LABELLED)
QUERIES["derived_provenance"] = query(
    lambda s, d: M.derived_provenance(labelled(s, d), VALUES, keys=KEYS), "readings", "site i:year v_base v_ref v_alt",
    f"""SELECT site, year(ts) AS year, {", ".join(f"count(*) FILTER (\"column\" = '{c}') AS {c}" for c in VALUES)}
        FROM ({LABELLED}) WHERE in_derived GROUP BY 1, 2""")
QUERIES["derived_rule_tests"] = query(
    lambda s, d: M.kept_range(labelled(s, d), KEYS), "readings",
    "site *kept_min *kept_max n_kept n_dropped n_dropped_inside *pct_dropped_inside *base_rate_pct",
    f"""SELECT site, lo AS kept_min, hi AS kept_max, count(*) FILTER (in_derived) AS n_kept, count(*) FILTER (NOT in_derived) AS n_dropped,
        count(*) FILTER (NOT in_derived AND value BETWEEN lo AND hi) AS n_dropped_inside,
        round_even(100.0 * count(*) FILTER (NOT in_derived AND value BETWEEN lo AND hi) / count(*) FILTER (NOT in_derived), 1) AS pct_dropped_inside,
        round_even(100.0 * count(*) FILTER (in_derived) / count(*), 1) AS base_rate_pct
        FROM (SELECT *, min(value) FILTER (in_derived) OVER (PARTITION BY site) AS lo, max(value) FILTER (in_derived) OVER (PARTITION BY site) AS hi
              FROM ({LABELLED})) GROUP BY site, lo, hi""")
QUERIES["sigma_rule_accuracy"] = query(
    lambda s, d: M.sigma_rule_accuracy(labelled(s, d), keys=KEYS), "readings", "site *k *accuracy_pct",
    f"""SELECT site, k, round_even(100.0 * count(*) FILTER (coalesce(abs(value - m) <= k * sd, FALSE) = in_derived) / count(*), 1) AS accuracy_pct
        FROM (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM ({LABELLED}) WINDOW w AS (PARTITION BY site, {MONTH})),
             (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS k) GROUP BY 1, 2""")

# ---- aggregation --------------------------------------------------------------------------------------

STAT = lambda v, p: f"avg({v}) AS {p}_mean, count({v}) AS {p}_n, stddev_samp({v}) AS {p}_sd, stddev_samp({v}) / sqrt(count({v})) AS {p}_se"
COLS = lambda p: f"*{p}_mean {p}_n *{p}_sd *{p}_se"
QUERIES["monthly_stats"] = query(
    lambda s, d: A.monthly_stats(B.readings(s, d), "v_base", keys=KEYS), "readings", "site month " + COLS("v_base"),
    f"SELECT site, {MONTH} AS month, {STAT('v_base', 'v_base')} FROM readings WHERE v_base IS NOT NULL GROUP BY 1, 2")
QUERIES["monthly_stats_all"] = query(
    lambda s, d: A.monthly_stats_all(B.readings(s, d), VALUES, keys=KEYS), "readings", "site month " + " ".join(map(COLS, VALUES)),
    f"SELECT site, {MONTH} AS month, {', '.join(STAT(v, v) for v in VALUES)} FROM readings WHERE coalesce(v_base, v_ref, v_alt) IS NOT NULL GROUP BY 1, 2")
QUERIES["observation_count_distribution"] = query(
    lambda s, d: A.observation_count_distribution(A.monthly_stats(B.readings(s, d), "v_base", keys=KEYS), "v_base_n", keys=KEYS),
    "readings", "site count *mean *std min *p25 *p50 *p75 max months_under_10 months_under_30 months_under_100",
    f"""SELECT site, count(n) AS count, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS min, quantile_cont(n, 0.25) AS p25,
        quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS max, count(*) FILTER (n < 10) AS months_under_10,
        count(*) FILTER (n < 30) AS months_under_30, count(*) FILTER (n < 100) AS months_under_100
        FROM (SELECT site, {MONTH} AS month, count(v_base) AS n FROM readings WHERE v_base IS NOT NULL GROUP BY 1, 2) GROUP BY site""")
FRACS = ", ".join(f"count(*) FILTER (source = '{l}') / count(*)::DOUBLE AS frac_{g}" for l, g in SLUGS.items())
DAILY = f"""SELECT site, CAST(ts AS DATE) AS date, {STAT('value', 'value')}, {FRACS}, count(DISTINCT source) AS n_sources,
  count(DISTINCT source) > 1 AS is_mixed FROM merged WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(value) >= 4"""
daily = lambda s, d: A.daily_stats(B.merged(s, d), sources=SLUGS, min_obs=4, keys=KEYS)
FRAC_COLS = " ".join(f"*frac_{g}" for g in SLUGS.values())
QUERIES["daily_stats"] = query(
    daily, "merged", f"site date {COLS('value')} {FRAC_COLS} n_sources is_mixed", DAILY)
QUERIES["daily_to_monthly"] = query(
    lambda s, d: A.daily_to_monthly(daily(s, d), slugs=list(SLUGS.values()), keys=KEYS), "merged",
    f"site month *value_mean value_days *value_sd_across_days b:value_obs *value_se_across_days n_mixed_days {FRAC_COLS} b:n_sources",
    f"""SELECT site, CAST(date_trunc('month', date) AS DATE) AS month, avg(value_mean) AS value_mean, count(*) AS value_days,
        stddev_samp(value_mean) AS value_sd_across_days, sum(value_n) AS value_obs,
        stddev_samp(value_mean) / sqrt(count(*)) AS value_se_across_days, count(*) FILTER (is_mixed) AS n_mixed_days,
        {", ".join(f"sum(frac_{g} * value_n) / sum(value_n) AS frac_{g}" for g in SLUGS.values())},
        {" + ".join(f"max(CASE WHEN frac_{g} > 0 THEN 1 ELSE 0 END)" for g in SLUGS.values())} AS n_sources
        FROM ({DAILY}) GROUP BY 1, 2""")
QUERIES["daily_stats_column"] = query(
    lambda s, d: A.daily_stats(B.readings(s, d), "v_ref", min_obs=4, keys=KEYS), "readings", "site date " + COLS("v_ref"),
    f"SELECT site, CAST(ts AS DATE) AS date, {STAT('v_ref', 'v_ref')} FROM readings WHERE v_ref IS NOT NULL GROUP BY 1, 2 HAVING count(v_ref) >= 4")
QUERIES["daily_to_monthly_column"] = query(
    lambda s, d: A.daily_to_monthly(A.daily_stats(B.readings(s, d), "v_ref", min_obs=4, keys=KEYS), "v_ref", keys=KEYS), "readings",
    "site month *v_ref_mean v_ref_days *v_ref_sd_across_days b:v_ref_obs *v_ref_se_across_days",
    """SELECT site, CAST(date_trunc('month', date) AS DATE) AS month, avg(m) AS v_ref_mean, count(*) AS v_ref_days,
       stddev_samp(m) AS v_ref_sd_across_days, sum(n) AS v_ref_obs, stddev_samp(m) / sqrt(count(*)) AS v_ref_se_across_days
       FROM (SELECT site, CAST(ts AS DATE) AS date, avg(v_ref) AS m, count(v_ref) AS n FROM readings GROUP BY 1, 2 HAVING count(v_ref) >= 4)
       GROUP BY 1, 2""")
BALANCED = f"""SELECT site, month, avg(m) AS v_ref_mean, count(*) AS v_ref_cells, stddev_samp(m) AS v_ref_sd_across_cells, sum(n) AS v_ref_obs,
  stddev_samp(m) / sqrt(count(*)) AS v_ref_se_across_cells FROM (
    SELECT site, {MONTH} AS month, {HALF} AS h, avg(v_ref) AS m, count(*) AS n FROM readings WHERE v_ref IS NOT NULL GROUP BY 1, 2, 3)
  GROUP BY 1, 2"""
balanced = lambda s, d: A.monthly_balanced(B.readings(s, d), "v_ref", keys=KEYS)
QUERIES["monthly_balanced"] = query(
    balanced, "readings", "site month *v_ref_mean v_ref_cells *v_ref_sd_across_cells b:v_ref_obs *v_ref_se_across_cells", BALANCED)
THRESH = f"""SELECT site, CAST(date_trunc('month', date) AS DATE) AS month, {", ".join(
    f"avg(m) FILTER (n >= {t}) AS mean_t{t}, nullif(count(*) FILTER (n >= {t}), 0) AS days_t{t}" for t in (3, 4, 6))}
  FROM (SELECT site, CAST(ts AS DATE) AS date, avg(value) AS m, count(value) AS n FROM merged GROUP BY 1, 2)
  GROUP BY 1, 2 HAVING count(*) FILTER (n >= 3) > 0"""
T3 = (3, 4, 6)
QUERIES["threshold_comparison"] = query(
    lambda s, d: A.threshold_comparison(B.merged(s, d), thresholds=T3, keys=KEYS), "merged",
    "site month " + " ".join(f"*mean_t{t} days_t{t}" for t in T3), THRESH, 10)
QUERIES["threshold_summary"] = query(
    lambda s, d: A.threshold_summary(A.threshold_comparison(B.merged(s, d), thresholds=T3, keys=KEYS), T3, KEYS), "merged",
    "site i:threshold n_months b:total_days *mean_flux *max_abs_shift *median_abs_shift months_lost",
    " UNION ALL ".join(
        f"""SELECT site, {t} AS threshold, count(mean_t{t}) AS n_months, coalesce(sum(days_t{t}), 0) AS total_days, avg(mean_t{t}) AS mean_flux,
        max(abs(mean_t{t} - mean_t3)) AS max_abs_shift, quantile_cont(abs(mean_t{t} - mean_t3), 0.5) AS median_abs_shift,
        count(mean_t3) - count(mean_t{t}) AS months_lost FROM ({THRESH}) GROUP BY site""" for t in T3))
CYCLE = lambda c, n: f"""SELECT site, max(g) - min(g) AS {n}_amplitude, sum(c * (g - mu) * (g - mu)) / max(nn) / max(vv) AS {n}_eta_squared
  FROM (SELECT site, {c} AS k, avg(value) AS g, count(*) AS c FROM v GROUP BY 1, 2) JOIN tot USING (site) GROUP BY site"""
QUERIES["cycle_strength"] = query(
    lambda s, d: A.cycle_strength(B.merged(s, d), keys=KEYS), "merged",
    "site n *total_variance *diurnal_amplitude *diurnal_eta_squared *seasonal_amplitude *seasonal_eta_squared *amplitude_ratio",
    f"""WITH v AS (SELECT site, ts, value FROM merged WHERE value IS NOT NULL),
        tot AS (SELECT site, avg(value) AS mu, count(*) AS nn, var_pop(value) AS vv FROM v GROUP BY site)
        SELECT site, nn AS n, vv AS total_variance, diurnal_amplitude, diurnal_eta_squared, seasonal_amplitude, seasonal_eta_squared,
        seasonal_amplitude / diurnal_amplitude AS amplitude_ratio
        FROM tot JOIN ({CYCLE(HALF, 'diurnal')}) USING (site) JOIN ({CYCLE('month(ts)', 'seasonal')}) USING (site)""")
QUERIES["diurnal_cycle_by_season"] = query(
    lambda s, d: A.diurnal_cycle_by_season(B.merged(s, d), keys=KEYS), "merged", "site i:hour *JJA *other",
    """SELECT site, hour(ts) AS hour, avg(value) FILTER (month(ts) IN (6, 7, 8)) AS "JJA", avg(value) FILTER (month(ts) NOT IN (6, 7, 8)) AS other
       FROM merged WHERE value IS NOT NULL GROUP BY 1, 2""", 10)
QUERIES["event_diurnal_cycle"] = query(
    lambda s, d: A.cycle_strength(B.table(s, d, "events"), "value", keys=["event_type"]).select("event_type", "n", "total_variance", "diurnal_amplitude", "diurnal_eta_squared"),
    "", "event_type n *total_variance *diurnal_amplitude *diurnal_eta_squared",
    f"""WITH v AS (SELECT event_type AS site, ts, value FROM events WHERE value IS NOT NULL),
        tot AS (SELECT site, avg(value) AS mu, count(*) AS nn, var_pop(value) AS vv FROM v GROUP BY site)
        SELECT site AS event_type, nn AS n, vv AS total_variance, diurnal_amplitude, diurnal_eta_squared
        FROM tot JOIN ({CYCLE(HALF, 'diurnal')}) USING (site)""")
QUERIES["daylight_share"] = query(
    lambda s, d: A.daylight_share(B.merged(s, d), keys=KEYS), "merged", "site n *daylight_share",
    "SELECT site, count(*) AS n, avg(CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 1 ELSE 0 END) AS daylight_share FROM merged WHERE value IS NOT NULL GROUP BY site")
RULE = "(SELECT site, CAST(date_trunc('month', date) AS DATE) AS month, avg(m) AS a FROM (SELECT site, CAST(ts AS DATE) AS date, avg(v_ref) AS m, count(v_ref) AS n FROM readings GROUP BY 1, 2 HAVING count(v_ref) >= 4) GROUP BY 1, 2)"
rule = lambda s, d: A.daily_to_monthly(A.daily_stats(B.readings(s, d), "v_ref", min_obs=4, keys=KEYS), "v_ref", keys=KEYS)
QUERIES["series_agreement"] = query(
    lambda s, d: A.series_agreement(rule(s, d), balanced(s, d), "v_ref_mean", "v_ref_mean", keys=KEYS), "readings",
    "site n_shared only_left only_right *correlation *mean_difference *median_difference *sd_difference *max_abs_difference n_identical",
    f"""SELECT site, count(v_ref_mean - a) AS n_shared, count(*) FILTER (v_ref_mean IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right,
        corr(a, v_ref_mean) AS correlation, avg(v_ref_mean - a) AS mean_difference, quantile_cont(v_ref_mean - a, 0.5) AS median_difference,
        stddev_samp(v_ref_mean - a) AS sd_difference, max(abs(v_ref_mean - a)) AS max_abs_difference,
        count(*) FILTER (abs(v_ref_mean - a) < 5e-4) AS n_identical
        FROM {RULE} FULL JOIN ({BALANCED}) USING (site, month) GROUP BY site""")
QUERIES["seasonal_bias_of_rule"] = query(
    lambda s, d: A.seasonal_bias_of_rule(rule(s, d), balanced(s, d), "v_ref_mean", "v_ref_mean", KEYS), "readings",
    "site *mean_bias *max_abs_bias *bias_swing i:lowest_month i:highest_month *series_amplitude *swing_pct_of_amplitude",
    f"""WITH j AS (SELECT site, month, a, a - v_ref_mean AS dd FROM {RULE} JOIN ({BALANCED}) USING (site, month)),
        m AS (SELECT site, month(month) AS moy, avg(dd) AS db, avg(a) AS sa FROM j GROUP BY 1, 2),
        w AS (SELECT site, max(db) - min(db) AS bias_swing, arg_min(moy, db) AS lowest_month, arg_max(moy, db) AS highest_month,
              max(sa) - min(sa) AS series_amplitude FROM m GROUP BY site)
        SELECT site, mean_bias, max_abs_bias, bias_swing, lowest_month, highest_month, series_amplitude, 100 * bias_swing / series_amplitude AS swing_pct_of_amplitude
        FROM (SELECT site, avg(dd) AS mean_bias, max(abs(dd)) AS max_abs_bias FROM j GROUP BY site) JOIN w USING (site)""")

# ---- quality ---------------------------------------------------------------------------------------------

QUERIES["sentinel_report"] = query(
    lambda s, d: Q.sentinel_report(B.readings(s, d), VALUES, KEYS), "readings",
    "site column n_slots n_valid n_missing *pct_missing *min *max *mean",
    " UNION ALL ".join(
        f"""SELECT site, '{c}' AS "column", count(*) AS n_slots, count({c}) AS n_valid, count(*) - count({c}) AS n_missing,
        round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS pct_missing, min({c}) AS min, max({c}) AS max, avg({c}) AS mean
        FROM readings GROUP BY site""" for c in VALUES))
COV_COL = " UNION ALL ".join(
    f"""SELECT site, '{c}' AS "column", count({c}) AS n_valid, min(ts) FILTER ({c} IS NOT NULL) AS first_valid,
    max(ts) FILTER ({c} IS NOT NULL) AS last_valid FROM readings GROUP BY site""" for c in VALUES)
QUERIES["column_coverage"] = query(
    lambda s, d: Q.column_coverage(B.readings(s, d), VALUES, keys=KEYS), "readings", "site column n_valid first_valid last_valid", COV_COL)
QUERIES["identification_evidence"] = query(
    lambda s, d: Q.identification_evidence(B.readings(s, d), ["v_ref", "v_alt"], B.LABELS, "1995-06-01", 2000, keys=KEYS), "readings",
    "site column source n_valid first_valid last_valid starts_before b:n_vs_published",
    f"""SELECT *, CASE "column" WHEN 'v_ref' THEN 'ref-1' ELSE 'alt/2' END AS source, first_valid < TIMESTAMP '1995-06-01' AS starts_before,
        n_valid - 2000 AS n_vs_published FROM ({COV_COL}) WHERE "column" <> 'v_base'""")
QUERIES["yearly_valid_counts"] = query(
    lambda s, d: Q.yearly_valid_counts(B.readings(s, d), VALUES, keys=KEYS), "readings", "site i:year v_base v_ref v_alt",
    "SELECT site, year(ts) AS year, count(v_base) AS v_base, count(v_ref) AS v_ref, count(v_alt) AS v_alt FROM readings GROUP BY 1, 2")
NEG = lambda l: f"""SELECT site, {l}::DOUBLE AS detection_limit, count(value) AS n_values, count(*) FILTER (value < 0) AS n_negative,
  round_even(100.0 * count(*) FILTER (value < 0) / count(value), 2) AS pct_negative,
  count(*) FILTER (value < 0 AND value > -{l}) AS n_within_limit,
  round_even(100.0 * count(*) FILTER (value < 0 AND value > -{l}) / greatest(count(*) FILTER (value < 0), 1), 1) AS pct_within_limit,
  count(*) FILTER (value <= -{l}) AS n_beyond_limit,
  round_even(100.0 * count(*) FILTER (value <= -{l}) / greatest(count(*) FILTER (value < 0), 1), 1) AS pct_beyond_limit,
  min(value) FILTER (value < 0) AS most_negative FROM merged GROUP BY site"""
NEG_COLS = "site *detection_limit n_values n_negative *pct_negative n_within_limit *pct_within_limit n_beyond_limit *pct_beyond_limit *most_negative"
QUERIES["negative_summary"] = query(lambda s, d: Q.negative_summary(B.merged(s, d), keys=KEYS), "merged", NEG_COLS, NEG(3.0))
QUERIES["detection_limit_sensitivity"] = query(
    lambda s, d: Q.detection_limit_sensitivity(B.merged(s, d), keys=KEYS), "merged", NEG_COLS, " UNION ALL ".join(map(NEG, (1.0, 3.0, 5.0))))
QUERIES["concurrent_negatives"] = query(
    lambda s, d: Q.concurrent_negatives(B.readings(s, d), "v_ref", "v_alt", keys=KEYS), "readings",
    "site n_paired n_negative_a n_negative_b n_negative_either n_negative_both *pct_concurrent n_beyond_both *pct_beyond_concurrent",
    """SELECT site, count(*) AS n_paired, count(*) FILTER (v_ref < 0) AS n_negative_a, count(*) FILTER (v_alt < 0) AS n_negative_b,
       count(*) FILTER (v_ref < 0 OR v_alt < 0) AS n_negative_either, count(*) FILTER (v_ref < 0 AND v_alt < 0) AS n_negative_both,
       round_even(100.0 * count(*) FILTER (v_ref < 0 AND v_alt < 0) / greatest(count(*) FILTER (v_ref < 0 OR v_alt < 0), 1), 1) AS pct_concurrent,
       count(*) FILTER (v_ref <= -3 AND v_alt <= -3) AS n_beyond_both,
       round_even(100.0 * count(*) FILTER (v_ref <= -3 AND v_alt <= -3) / greatest(count(*) FILTER (v_ref < 0 OR v_alt < 0), 1), 2) AS pct_beyond_concurrent
       FROM readings WHERE v_ref IS NOT NULL AND v_alt IS NOT NULL GROUP BY site""")
QUERIES["negative_share_by_year"] = query(
    lambda s, d: Q.negative_share_by_year(B.merged(s, d), keys=KEYS), "merged", "site i:year n n_negative sources *pct_negative",
    """SELECT site, year(ts) AS year, count(*) AS n, count(*) FILTER (value < 0) AS n_negative, string_agg(DISTINCT source, '/' ORDER BY source) AS sources,
       round_even(100.0 * count(*) FILTER (value < 0) / count(*), 1) AS pct_negative FROM merged WHERE value IS NOT NULL GROUP BY 1, 2""")


def other_product(s, d):
    changed = F.when(F.col("o") % 97 == 0, F.col("v_ref") + 0.25).otherwise(F.col("v_ref"))
    return B.readings(s, d).filter("site <> 4").withColumn("v_ref", changed).drop("v_base")


PRODUCT = "(SELECT site, ts, CASE WHEN o % 97 = 0 THEN v_ref + 0.25 ELSE v_ref END AS v_ref, v_alt FROM readings WHERE site <> 4)"
CMP = lambda c: f"""SELECT '{c}' AS "column", TRUE AS in_both, count(*) AS shared_slots, count(l.{c}) AS valid_left, count(r.{c}) AS valid_right,
  count(l.{c} + r.{c}) AS valid_both, count(*) FILTER (l.{c} = r.{c}) AS identical, count(*) FILTER (l.{c} <> r.{c}) AS differing,
  count(*) FILTER (l.{c} IS NOT NULL AND r.{c} IS NULL) AS only_left, count(*) FILTER (l.{c} IS NULL AND r.{c} IS NOT NULL) AS only_right,
  max(abs(l.{c} - r.{c})) AS max_abs_difference FROM readings l JOIN {PRODUCT} r USING (site, ts)"""
QUERIES["compare_products"] = query(
    lambda s, d: Q.compare_products(B.readings(s, d), other_product(s, d), VALUES, ["site", "ts"]), "readings",
    "column in_both shared_slots valid_left valid_right valid_both identical differing only_left only_right *max_abs_difference",
    CMP("v_ref") + " UNION ALL " + CMP("v_alt") + " UNION ALL SELECT 'v_base', FALSE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
QUERIES["difference_by_year"] = query(
    lambda s, d: Q.difference_by_year(B.readings(s, d), other_product(s, d), "v_ref", ["site", "ts"]), "readings", "i:year n identical differing",
    f"""SELECT year(ts) AS year, count(*) AS n, count(*) FILTER (l.v_ref = r.v_ref) AS identical, count(*) FILTER (l.v_ref <> r.v_ref) AS differing
        FROM readings l JOIN {PRODUCT} r USING (site, ts) WHERE l.v_ref IS NOT NULL AND r.v_ref IS NOT NULL GROUP BY 1""")
QUERIES["sector_cost"] = query(
    lambda s, d: Q.sector_cost(B.readings(s, d), VALUES, keys=KEYS), "readings", "site series n_with_wind_direction *pct_inside_sector",
    " UNION ALL ".join(
        f"""SELECT site, '{n}' AS series, count(*) AS n_with_wind_direction, round_even(100.0 * count(*) FILTER (wd >= 30 AND wd < 200) / count(*), 2)
        AS pct_inside_sector FROM readings WHERE wd IS NOT NULL AND {c} GROUP BY site"""
        for n, c in [("all half-hours", "TRUE"), *[(v, f"{v} IS NOT NULL") for v in VALUES]]))
STAGE = lambda n, e, last: f"""SELECT site, '{n}' AS stage, {e} AS n_half_hours, round_even(100.0 * {e} / count(*), 1) AS pct_of_record,
  {"round_even(100.0 * count(value) / count(*) FILTER (wd IS NOT NULL AND NOT (wd >= 30 AND wd < 200)), 1)" if last else "NULL"} AS pct_of_available
  FROM merged GROUP BY site"""
QUERIES["coverage_against_sector"] = query(
    lambda s, d: Q.coverage_against_sector(B.merged(s, d), keys=KEYS), "merged", "site stage n_half_hours *pct_of_record *pct_of_available",
    " UNION ALL ".join([
        STAGE("all half-hours", "count(*)", False), STAGE("wind direction recorded", "count(wd)", False),
        STAGE("removed by the excluded sector", "count(*) FILTER (wd >= 30 AND wd < 200)", False),
        STAGE("outside sector, wind direction recorded", "count(*) FILTER (wd IS NOT NULL AND NOT (wd >= 30 AND wd < 200))", False),
        STAGE("value retained", "count(value)", True)]))
QUERIES["sector_shares"] = query(
    lambda s, d: Q.sector_shares(B.readings(s, d), keys=KEYS), "readings", "site i:sector_start *pct excluded",
    """SELECT site, wd // 10 * 10 AS sector_start, round_even(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY site), 4) AS pct,
       wd // 10 * 10 >= 30 AND wd // 10 * 10 < 200 AS excluded FROM readings WHERE wd IS NOT NULL GROUP BY site, wd // 10 * 10""")

# ---- coverage and budgets ---------------------------------------------------------------------------------

POSSIBLE = f"""(SELECT site, month, year(month) AS year, month(month) AS month_of_year, day(last_day(month)) * 48 AS possible FROM (
  SELECT site, CAST(unnest(generate_series(min({MONTH}), max({MONTH}), INTERVAL 1 MONTH)) AS DATE) AS month FROM merged GROUP BY site))"""
QUERIES["possible_by_month"] = query(
    lambda s, d: V.possible_by_month(B.merged(s, d), keys=KEYS), "merged", "site month i:year i:month_of_year b:possible", f"SELECT * FROM {POSSIBLE}")
CNT = ", ".join(f"count(*) FILTER (value IS NOT NULL AND source = '{l}') AS {g}" for l, g in SLUGS.items())
YM = f"""(SELECT p.site, p.year, p.month_of_year, coalesce(base, 0) AS base, coalesce("ref", 0) AS "ref", coalesce(alt, 0) AS alt, possible
  FROM {POSSIBLE} p LEFT JOIN (SELECT site, {MONTH} AS month, {CNT} FROM merged GROUP BY 1, 2) c USING (site, month))"""
ym = lambda s, d: V.coverage_by_year_month(B.merged(s, d), SLUGS, keys=KEYS)
QUERIES["coverage_by_year_month"] = query(
    ym, "merged", "site i:year i:month_of_year base ref alt b:possible observed *frac_observed",
    f'SELECT *, base + "ref" + alt AS observed, (base + "ref" + alt) / possible::DOUBLE AS frac_observed FROM {YM}')
QUERIES["coverage_matrix"] = query(
    lambda s, d: V.coverage_matrix(ym(s, d), KEYS), "merged", "site i:year " + " ".join(f"*m{m}" for m in range(1, 13)),
    f"""SELECT site, year, {", ".join(f'max((base + "ref" + alt) / possible::DOUBLE) FILTER (month_of_year = {m}) AS m{m}' for m in range(1, 13))}
        FROM {YM} GROUP BY 1, 2""")
MOY = f"""(SELECT site, month_of_year, sum(base) AS base, sum("ref") AS "ref", sum(alt) AS alt, sum(base + "ref" + alt) AS observed, sum(possible) AS possible
  FROM {YM} GROUP BY 1, 2)"""
QUERIES["coverage_by_month_of_year"] = query(
    lambda s, d: V.coverage_by_month_of_year(B.merged(s, d), SLUGS, keys=KEYS), "merged",
    "site i:month_of_year b:base b:ref b:alt b:observed b:possible *frac_base *frac_ref *frac_alt *frac_observed",
    f"""SELECT *, base / possible::DOUBLE AS frac_base, "ref" / possible::DOUBLE AS frac_ref, alt / possible::DOUBLE AS frac_alt,
        observed / possible::DOUBLE AS frac_observed FROM {MOY}""")
WIN, SUM = "month_of_year IN (11, 12, 1, 2, 3)", "month_of_year IN (6, 7, 8)"
QUERIES["seasonal_bias_summary"] = query(
    lambda s, d: V.seasonal_bias_summary(B.merged(s, d), SLUGS, keys=KEYS), "merged",
    "site *winter_coverage *summer_coverage *summer_minus_winter *coverage_ratio *winter_mean_flux *summer_mean_flux",
    f"""SELECT site, w AS winter_coverage, s AS summer_coverage, s - w AS summer_minus_winter, s / w AS coverage_ratio, wf AS winter_mean_flux, sf AS summer_mean_flux
        FROM (SELECT site, sum(observed) FILTER ({WIN}) / sum(possible) FILTER ({WIN})::DOUBLE AS w,
                     sum(observed) FILTER ({SUM}) / sum(possible) FILTER ({SUM})::DOUBLE AS s, avg(m) FILTER ({WIN}) AS wf, avg(m) FILTER ({SUM}) AS sf
              FROM {MOY} LEFT JOIN (SELECT site, month(ts) AS month_of_year, avg(value) AS m FROM merged WHERE value IS NOT NULL GROUP BY 1, 2)
              USING (site, month_of_year) GROUP BY site)""")
PUB = {1997: 1.5, 1998: 2.0, 1999: 2.5}
PUBSQL = "CASE year WHEN 1997 THEN 1.5 WHEN 1998 THEN 2.0 WHEN 1999 THEN 2.5 END"
BUDGET = f"""(SELECT *, round_even(100 * observed_only / published, 1) AS observed_pct_of_published, published - observed_only AS shortfall_g FROM (
  SELECT site, year, n AS n_halfhours, m AS mean_flux, slots AS slots_in_year, round_even(100.0 * n / slots, 1) AS coverage_pct,
  n * m * {G!r} AS observed_only, m * 17520 * {G!r} AS coverage_scaled, CAST({PUBSQL} AS DOUBLE) AS published
  FROM (SELECT site, year(ts) AS year, count(value) AS n, avg(value) AS m, count(*) AS slots FROM merged GROUP BY 1, 2) WHERE n > 0))"""
budget = lambda s, d: V.annual_budget(B.merged(s, d), PUB, keys=KEYS)
QUERIES["annual_budget"] = query(
    budget, "merged",
    "site i:year n_halfhours *mean_flux slots_in_year *coverage_pct *observed_only *coverage_scaled *published *observed_pct_of_published *shortfall_g",
    f"SELECT * FROM {BUDGET}")
MW = f"""(SELECT site, year(month) AS year, count(*) AS months_with_data, sum(m * w) / sum(w) AS weighted_mean_flux, sum(m * w) / sum(w) * 17520 * {G!r} AS month_weighted
  FROM (SELECT site, {MONTH} AS month, avg(value) AS m, day(last_day(min(ts))) * 48 AS w FROM merged WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2)"""
QUERIES["annual_budget_month_weighted"] = query(
    lambda s, d: V.annual_budget_month_weighted(B.merged(s, d), keys=KEYS), "merged",
    "site i:year months_with_data *weighted_mean_flux *month_weighted", f"SELECT * FROM {MW}")
QUERIES["budget_method_comparison"] = query(
    lambda s, d: V.budget_method_comparison(B.merged(s, d), PUB, keys=KEYS), "merged",
    "site i:year *coverage_pct *mean_flux *observed_only *coverage_scaled *published months_with_data *weighted_mean_flux *month_weighted *divergence_g *divergence_pct *weighted_pct_of_published",
    f"""SELECT *, coverage_scaled - month_weighted AS divergence_g, 100 * (coverage_scaled - month_weighted) / month_weighted AS divergence_pct,
        100 * month_weighted / published AS weighted_pct_of_published FROM {BUDGET} LEFT JOIN {MW} USING (site, year)""")
QUERIES["budget_gap"] = query(
    lambda s, d: V.budget_gap(budget(s, d), KEYS), "merged",
    "site i:year n_halfhours *coverage_pct *mean_flux *observed_only *coverage_scaled *published *observed_pct_of_published *shortfall_g",
    f"SELECT * FROM {BUDGET} WHERE published IS NOT NULL")
PUBC = {1997: (1.1, 0.4), 1998: (1.6, 0.5), 2005: (2.0, 0.5)}
PUBC_SQL = "(SELECT * FROM (VALUES (1997, 1.1::DOUBLE, 0.4::DOUBLE), (1998, 1.6, 0.5), (2005, 2.0, 0.5)) t(year, c, u))"
CC = "(12.011::DOUBLE / 16.043)"


def one_site_budget(s, d):
    """All sites as one record: every row is a slot."""
    return V.annual_budget(B.merged(s, d), PUB)


QUERIES["observed_against_published"] = query(
    lambda s, d: V.observed_against_published(one_site_budget(s, d), PUBC), "merged",
    "i:year *coverage_pct *observed_g_ch4 *observed_g_c *coverage_scaled_g_ch4 *coverage_scaled_g_c *published_g_ch4 *published_g_c",
    f"""SELECT p.year, coverage_pct, round_even(oo, 2) AS observed_g_ch4, round_even(oo * {CC}, 2) AS observed_g_c, round_even(cs, 2) AS coverage_scaled_g_ch4,
        round_even(cs * {CC}, 2) AS coverage_scaled_g_c, round_even(c / {CC}, 2) AS published_g_ch4, c AS published_g_c
        FROM {PUBC_SQL} p LEFT JOIN (SELECT year(ts) AS year, round_even(100.0 * count(value) / count(*), 1) AS coverage_pct,
          count(value) * avg(value) * {G!r} AS oo, avg(value) * 17520 * {G!r} AS cs FROM merged GROUP BY 1) b ON p.year = b.year""")
QUERIES["published_annual_targets"] = query(
    lambda s, d: V.published_annual_targets(s, PUBC).join(B.merged(s, d).groupBy(F.year("ts").alias("year")).agg(F.count("value").alias("n")), "year"),
    "merged", "i:year *g_c_m2 *uncertainty_g_c *g_ch4_m2 *uncertainty_g_ch4 n",
    f"""SELECT p.year, c AS g_c_m2, u AS uncertainty_g_c, round_even(c / {CC}, 2) AS g_ch4_m2, round_even(u / {CC}, 2) AS uncertainty_g_ch4, n
        FROM {PUBC_SQL} p JOIN (SELECT year(ts) AS year, count(value) AS n FROM merged GROUP BY 1) b ON p.year = b.year""")
QUERIES["independent_check_coverage"] = query(
    lambda s, d: V.independent_check_coverage(A.monthly_stats(B.readings(s, d), "v_base", keys=KEYS), (1996, 2001), keys=KEYS), "readings",
    "site growing_season i:months_in_season months_observed",
    " UNION ALL ".join(
        f"""SELECT site, '{y}-05..{y}-10' AS growing_season, 6 AS months_in_season,
        count(DISTINCT CASE WHEN v_base IS NOT NULL AND year(ts) = {y} AND month(ts) BETWEEN 5 AND 10 THEN {MONTH} END) AS months_observed
        FROM readings GROUP BY site""" for y in (1996, 2001)))
QUERIES["build_monthly"] = query(
    lambda s, d: A.build_monthly(B.readings(s, d), ["v_base", "v_ref"], B.covariates(s, d), "1994-06-01", "2002-03-01", keys=KEYS),
    "readings cov", "site month " + COLS("v_base") + " " + COLS("v_ref") + " *soil_temp_f *atm_temp_f *precip_in *wte_m",
    f"""SELECT g.site, g.month, v_base_mean, coalesce(v_base_n, 0) AS v_base_n, v_base_sd, v_base_se, v_ref_mean, coalesce(v_ref_n, 0) AS v_ref_n, v_ref_sd, v_ref_se,
        soil_temp_f, atm_temp_f, precip_in, wte_m
        FROM (SELECT site, CAST(unnest(generate_series(DATE '1994-06-01', DATE '2002-03-01', INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT site FROM readings)) g
        LEFT JOIN (SELECT site, {MONTH} AS month, {STAT('v_base', 'v_base')}, {STAT('v_ref', 'v_ref')} FROM readings
                   WHERE coalesce(v_base, v_ref) IS NOT NULL GROUP BY 1, 2) m ON g.site = m.site AND g.month = m.month
        LEFT JOIN cov c ON g.site = c.site AND g.month = c.month""")

# ---- files: lines made from the tables, and written tables ------------------------------------------------------


def _lines(rows, order, *parts):
    """Comma-separated lines of a table, one file a site: the rows with ``n`` for their order."""
    return rows.select("site", order.cast("bigint").alias("n"), F.concat_ws(",", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("line"))


def _with_head(rows, head, comment=None):
    """The lines below a header, and below a comment line that a site's name goes into."""
    sites = rows.select("site").distinct()
    out = rows.unionByName(sites.select("site", F.lit(-1).cast("bigint").alias("n"), F.repeat(F.lit(head), F.sign(F.col("site") + 1).cast("int")).alias("line")))
    if comment:
        out = out.unionByName(sites.select("site", F.lit(-2).cast("bigint").alias("n"), F.format_string(comment, F.col("site")).alias("line")))
    return out


def product_lines(s, d):
    stamp = F.date_format("ts", "yyyyMMddHHmm")
    rows = _lines(B.readings(s, d), F.unix_seconds(F.col("ts").cast("timestamp")), stamp, F.coalesce("v_base", F.lit(-9999.0)), F.col("v_ref"), F.col("wd"))
    return _with_head(rows, "TIMESTAMP_START,V_BASE,V_REF,WD", "# Site: %s; half_hours = 48; site_id=%<s")


def monthly_lines(s, d):
    month, later = F.date_format("month", "MM/yyyy"), F.date_format(F.add_months("month", 12), "MM/yyyy")
    return _with_head(_lines(B.covariates(s, d), F.year("month") * 12 + F.month("month"), month, F.col("soil_temp_f"), later, F.col("precip_in")), "Month,Soil,Rain Month,Rain")


QUERIES["read_readings"] = query(
    lambda s, d: S.readings_of(S.comma_separated(product_lines(s, d), keys=KEYS).drop("n"), keys=KEYS), "readings", "site ts *V_BASE *V_REF *WD",
    "SELECT site, ts, v_base AS V_BASE, v_ref AS V_REF, wd AS WD FROM readings")
QUERIES["read_commented_csv"] = query(
    lambda s, d: S.comment_pairs(product_lines(s, d), keys=KEYS), "readings", "site k v",
    "SELECT DISTINCT site, k, CASE k WHEN 'half_hours' THEN '48' ELSE CAST(site AS VARCHAR) END AS v FROM readings, (VALUES ('half_hours'), ('site_id')) p(k)")
QUERIES["read_monthly_csv"] = query(
    lambda s, d: S.monthly_of(S.comma_separated(monthly_lines(s, d), keys=KEYS), "Month", "Soil", "soil", "MM/yyyy", KEYS), "cov", "site month *soil",
    "SELECT site, month, soil_temp_f AS soil FROM cov WHERE soil_temp_f IS NOT NULL")


def blocks(s, d):
    found = S.blocks_of(S.comma_separated(monthly_lines(s, d), keys=KEYS), {"soil": ("Month", "Soil"), "rain": ("Rain Month", "Rain")}, "MM/yyyy", KEYS)
    return found["soil"].select(*KEYS, F.lit("soil").alias("block"), "month", F.col("soil").alias("value")).unionByName(found["rain"].select(*KEYS, F.lit("rain").alias("block"), "month", F.col("rain").alias("value")))


QUERIES["read_block_csv"] = query(
    blocks, "cov", "site block month *value",
    """SELECT site, 'soil' AS block, month, soil_temp_f AS value FROM cov WHERE soil_temp_f IS NOT NULL UNION ALL
       SELECT site, 'rain', CAST(month + INTERVAL 12 MONTH AS DATE), precip_in FROM cov WHERE precip_in IS NOT NULL""")


def written_back(s, d):
    """The covariates written as Parquet and CSV, and read from the CSV."""
    paths = sinks.write_table(B.covariates(s, d), f"{shared_folder(s)}/table-{uuid.uuid4().hex}")
    return s.read.schema("site bigint, month string, soil_temp_f double, atm_temp_f double, precip_in double, wte_m double").option("header", True).csv(paths["csv"])


QUERIES["write_table"] = query(
    written_back, "cov", "site month *soil_temp_f *atm_temp_f *precip_in *wte_m",
    "SELECT site, strftime(month, '%Y-%m') AS month, soil_temp_f, atm_temp_f, precip_in, wte_m FROM cov")


def restaged(s, d):
    """A stage of daily counts from one input and then from a part of it, at one place: what is read at the end is made from the part."""
    path = f"{shared_folder(s)}/stage-{uuid.uuid4().hex}"
    stage = lambda rows: sinks.stage_table(s, path, lambda: rows.groupBy("site", F.to_date("ts").alias("day")).agg(F.count("v_ref").alias("n")), inputs=[rows])
    stage(B.readings(s, d))
    part = B.readings(s, d).filter(F.month("ts") > 6)
    stage(part)
    return stage(part)


QUERIES["stage_table"] = query(
    restaged, "readings", "site day n", "SELECT site, CAST(ts AS DATE) AS day, count(v_ref) AS n FROM readings WHERE month(ts) > 6 GROUP BY 1, 2")
