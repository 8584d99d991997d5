"""Registered queries: complete registry, agreement with SQL, and independence from the partition count."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["daily_to_monthly", "source_runs", "difference_statistics", "joint_support", "score_pooled", "compare_products"]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 190 and oracles.keys() <= queries.keys()


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_sample_matches_sql(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        con, queries, oracles = duck(SF), entry.queries(), entry.oracle_sql()
        for name in SAMPLE:
            message = compare(queries[name](spark, SF), con, oracles[name])
            assert message.startswith("ok") and "TYPES" not in message, (name, message)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    rows = entry.entry(spark).take(3)
    assert rows and "value_mean" in rows[0].asDict()


def test_whole_flux_queries_read_every_month(spark):
    sf = "/root/testdata/sf0.01"
    queries, oracles, con = entry.queries(), entry.oracle_sql(), duck(sf)
    months, rows = con.execute("SELECT count(DISTINCT date_trunc('month', l_shipdate)), count(*) FROM lineitem").fetchone()
    read = queries["log_target_whole"](spark, sf).select("month").distinct().count()
    assert read == months
    from fluxspark.plans import bindings as B

    assert B.flux_whole(spark, sf).selectExpr("sum(flux_obs)").first()[0] == rows
    for name in ["monthly_flux_to_annual_whole", "season_totals_whole", "weight_summary_whole"]:
        message = compare(queries[name](spark, sf), con, oracles[name])
        assert message.startswith("ok") and "TYPES" not in message, (name, message)
