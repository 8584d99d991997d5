"""The driver tables in the shapes the operators take, once as DataFrames and once as SQL.

readings_raw: one row per line item, as half-hourly readings of five sites. readings: one row per
site and slot. covariates and flux: monthly tables per site. series: a monthly series per site with holes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxspark.operators.common import round6
from fluxspark.operators.merge import merge_precedence
from fluxspark.operators.reshape import regrid

VALUES = ("v_base", "v_ref", "v_alt")
LABELS = {"v_base": "base unit", "v_ref": "ref-1", "v_alt": "alt/2"}
SLUGS = {"base unit": "base", "ref-1": "ref", "alt/2": "alt"}
COVARIATES = ("soil_temp_f", "atm_temp_f", "precip_in", "wte_m")
KEYS = ["site"]
ON = ["site", "month"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings_raw(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    slot = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 5) % 48 * 30).cast("int")
    flux = F.col("l_quantity") * 10 * (F.col("l_discount") - 0.02)
    flag, order = F.col("l_returnflag"), F.col("l_orderkey")
    return li.select(
        (F.col("l_suppkey") % 5).alias("site"),
        (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), slot, F.lit(0))).alias("ts"),
        F.when((order + F.col("l_linenumber")) % 11 == 0, F.lit(-9999.0)).when(flag == "A", flux).alias("v_base"),
        F.when(flag.isin("N", "R") & (order % 5 < 4), flux).alias("v_ref"),
        F.when(flag == "R", F.col("l_quantity") * 11 * (F.col("l_discount") - 0.02) - 3).alias("v_alt"),
        F.when(order % 10 != 0, (F.col("l_partkey") * 13) % 360).alias("wd"),
        order.alias("o"),
    )


def readings(spark: SparkSession, sf: str) -> DataFrame:
    raw = readings_raw(spark, sf)
    clean = raw.withColumn("v_base", F.when(F.col("v_base") != -9999.0, F.col("v_base")))
    return clean.groupBy("site", "ts").agg(*[F.max(c).alias(c) for c in (*VALUES, "wd", "o")])


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return merge_precedence(readings(spark, sf), VALUES, LABELS, keep=["wd"], keys=KEYS)


def _site_months(spark: SparkSession, sf: str):
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 5).alias("site"), F.trunc(F.to_date("l_shipdate"), "MM").alias("month"))


def covariates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _site_months(spark, sf).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("p"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t")
    )
    ym = F.year("month") * 12 + F.month("month") - 1
    return rows.select(
        "site",
        "month",
        F.when(ym % 29 != 3, F.col("q")).alias("soil_temp_f"),
        (F.col("p") / 1000).alias("atm_temp_f"),
        F.when(ym % 31 != 5, F.col("d") * 100).alias("precip_in"),
        F.when(F.col("month") < F.lit("2001-09-01").cast("date"), F.col("t") * 100).alias("wte_m"),
    )


def flux_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly flux of all months."""
    v = F.col("l_extendedprice") / 1000
    return _site_months(spark, sf).agg(
        F.avg(v).alias("flux_mean"),
        F.count("*").alias("flux_obs"),
        F.count_distinct("l_shipdate").alias("flux_days"),
        F.stddev_samp(v).alias("flux_sd"),
        (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("flux_se"),
    )


def flux(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly flux from mid-1997, without its Julys."""
    return flux_whole(spark, sf).filter((F.col("month") >= F.lit("1997-06-01").cast("date")) & (F.month("month") != 7))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """Gapless monthly series per site; three months hold no value."""
    rows = _site_months(spark, sf).agg((F.sum("l_extendedprice") / 97131.7).alias("value"))
    holes = [F.lit(m).cast("date") for m in ("1996-03-01", "1997-08-01", "1998-08-01")]
    return regrid(rows.withColumn("value", F.when(~F.col("month").isin(*holes), F.col("value"))), KEYS)


SQL = {
    "readings_raw": """
readings_raw AS (
  SELECT l_suppkey % 5 AS site,
         l_shipdate + to_minutes(CAST(30 * ((l_orderkey * 7 + l_linenumber * 5) % 48) AS INTEGER)) AS ts,
         CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN CAST(-9999.0 AS DOUBLE)
              WHEN l_returnflag = 'A' THEN l_quantity * 10 * (l_discount - 0.02) END AS v_base,
         CASE WHEN l_returnflag IN ('N', 'R') AND l_orderkey % 5 < 4 THEN l_quantity * 10 * (l_discount - 0.02) END AS v_ref,
         CASE WHEN l_returnflag = 'R' THEN l_quantity * 11 * (l_discount - 0.02) - 3 END AS v_alt,
         CASE WHEN l_orderkey % 10 <> 0 THEN (l_partkey * 13) % 360 END AS wd,
         l_orderkey AS o
  FROM lineitem)""",
    "readings": """
readings AS (
  SELECT site, ts, max(CASE WHEN v_base <> -9999.0 THEN v_base END) AS v_base, max(v_ref) AS v_ref, max(v_alt) AS v_alt,
         max(wd) AS wd, max(o) AS o
  FROM readings_raw GROUP BY site, ts)""",
    "merged": """
merged AS (
  SELECT site, ts, wd, coalesce(v_base, v_ref, v_alt) AS value,
         CASE WHEN v_base IS NOT NULL THEN 'v_base' WHEN v_ref IS NOT NULL THEN 'v_ref'
              WHEN v_alt IS NOT NULL THEN 'v_alt' ELSE 'none' END AS source_column,
         CASE WHEN v_base IS NOT NULL THEN 'base unit' WHEN v_ref IS NOT NULL THEN 'ref-1'
              WHEN v_alt IS NOT NULL THEN 'alt/2' ELSE 'none' END AS source,
         (v_base IS NOT NULL)::INT + (v_ref IS NOT NULL)::INT + (v_alt IS NOT NULL)::INT AS n_reporting
  FROM readings)""",
    "cov": """
cov0 AS (
  SELECT l_suppkey % 5 AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         avg(l_quantity) AS q, avg(l_extendedprice) AS p, avg(l_discount) AS d, avg(l_tax) AS t
  FROM lineitem GROUP BY 1, 2),
cov AS (
  SELECT site, month, CASE WHEN (year(month) * 12 + month(month) - 1) % 29 <> 3 THEN q END AS soil_temp_f,
         p / 1000 AS atm_temp_f,
         CASE WHEN (year(month) * 12 + month(month) - 1) % 31 <> 5 THEN d * 100 END AS precip_in,
         CASE WHEN month < DATE '2001-09-01' THEN t * 100 END AS wte_m
  FROM cov0)""",
    "flux": """
flux AS (
  SELECT l_suppkey % 5 AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         avg(l_extendedprice / 1000) AS flux_mean, count(*) AS flux_obs, count(DISTINCT l_shipdate) AS flux_days,
         stddev_samp(l_extendedprice / 1000) AS flux_sd,
         stddev_samp(l_extendedprice / 1000) / sqrt(count(*)) AS flux_se
  FROM lineitem GROUP BY 1, 2
  HAVING CAST(date_trunc('month', min(l_shipdate)) AS DATE) >= DATE '1997-06-01' AND month(min(l_shipdate)) <> 7)""",
    "flux_whole": """
flux AS (
  SELECT l_suppkey % 5 AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
         avg(l_extendedprice / 1000) AS flux_mean, count(*) AS flux_obs, count(DISTINCT l_shipdate) AS flux_days,
         stddev_samp(l_extendedprice / 1000) AS flux_sd,
         stddev_samp(l_extendedprice / 1000) / sqrt(count(*)) AS flux_se
  FROM lineitem GROUP BY 1, 2)""",
    "series": """
series0 AS (
  SELECT l_suppkey % 5 AS site, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_extendedprice) / 97131.7 AS v
  FROM lineitem GROUP BY 1, 2),
series AS (
  SELECT g.site, g.month, CASE WHEN g.month NOT IN (DATE '1996-03-01', DATE '1997-08-01', DATE '1998-08-01') THEN s.v END AS value
  FROM (SELECT site, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
        FROM series0 GROUP BY site) g
  LEFT JOIN series0 s USING (site, month))""",
    "long_cov": """
long_cov AS (
  SELECT site, month, covariate, value FROM (
    SELECT site, month, 'soil_temp_f' AS covariate, soil_temp_f AS value FROM cov UNION ALL
    SELECT site, month, 'atm_temp_f', atm_temp_f FROM cov UNION ALL
    SELECT site, month, 'precip_in', precip_in FROM cov UNION ALL
    SELECT site, month, 'wte_m', wte_m FROM cov) WHERE value IS NOT NULL)""",
    "windows": """
complete AS (
  SELECT site, month FROM cov
  WHERE soil_temp_f IS NOT NULL AND atm_temp_f IS NOT NULL AND precip_in IS NOT NULL AND wte_m IS NOT NULL),
firsts AS (SELECT site, min(month) AS f FROM flux GROUP BY site),
windows AS (
  SELECT site, month, 'fit_nominal' AS "window" FROM complete JOIN flux USING (site, month) UNION ALL
  SELECT site, month, 'fit' FROM complete JOIN flux USING (site, month)
    WHERE month NOT IN (DATE '1999-06-01', DATE '1999-09-01') UNION ALL
  SELECT site, month, 'excluded' FROM complete JOIN flux USING (site, month)
    WHERE month IN (DATE '1999-06-01', DATE '1999-09-01') UNION ALL
  SELECT c.site, c.month, CASE WHEN c.month < f THEN 'reconstruction' ELSE 'interior_gaps' END
    FROM complete c JOIN firsts USING (site)
    WHERE NOT EXISTS (SELECT 1 FROM flux x WHERE x.site = c.site AND x.month = c.month) UNION ALL
  SELECT x.site, x.month, 'observed_excluded' FROM flux x
    WHERE NOT EXISTS (SELECT 1 FROM complete c WHERE x.site = c.site AND x.month = c.month))""",
}
NEEDS = {
    "readings": ["readings_raw"],
    "merged": ["readings"],
    "long_cov": ["cov"],
    "windows": ["cov", "flux"],
}
EXCLUDE = ("1999-06-01", "1999-09-01")


def ctes(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        for m in NEEDS.get(n, []):
            visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return [SQL[n].strip() for n in order]


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def whole(run: Callable[[DataFrame], DataFrame], cut: Query, digits: int = 8) -> Query:
    """A query about ``flux`` over all its months: the operator on the whole table, and the SQL of ``cut`` over it."""
    given = SQL["flux"].strip()
    if cut.sql is None or given not in cut.sql:
        raise ValueError("the query has no SQL over flux")
    return Query(lambda spark, sf: round6(run(flux_whole(spark, sf)), digits), cut.sql.replace(given, SQL["flux_whole"].strip()))


def query(run, uses: str = "", columns: str = "", body: str | None = None, digits: int = 8) -> Query:
    """A registered query: doubles rounded on both sides, and its oracle built from shared views.

    ``columns`` lists the output columns; a leading * rounds, i: and b: set the integer width.
    """
    spark_side = lambda spark, sf: round6(run(spark, sf), digits)
    if body is None:
        return Query(spark_side, None)
    out = []
    for c in columns.split():
        c = c.replace("~", " ")
        if c.startswith("*"):
            out.append(f'round(CAST("{c[1:]}" AS DOUBLE), {digits}) + 0.0 AS "{c[1:]}"')
        elif c[:2] in ("i:", "b:"):
            out.append(f'CAST("{c[2:]}" AS {"INTEGER" if c[0] == "i" else "BIGINT"}) AS "{c[2:]}"')
        else:
            out.append(f'"{c}"')
    parts = ctes(uses.split())
    sql = "WITH " + ",\n".join([*parts, f"q AS (\n{body.strip()}\n)"]) + "\nSELECT " + ", ".join(out) + "\nFROM q"
    return Query(spark_side, sql)
