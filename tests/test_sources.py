"""Readers and writers on files written for the test."""

import datetime as dt

from pyspark.sql import functions as F

from fluxspark.operators.reshape import month_grid, regrid
from fluxspark.sources import readers as R
from fluxspark.sources import sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readings_file(spark, tmp_path):
    path = put(tmp_path, "base.csv", "# Site: x\n# Version: 5\nTIMESTAMP_START,TIMESTAMP_END,FCH4,WD\n200901010030,200901010100,-9999,12\n200901010000,200901010030,4.5,-9999\n")
    rows = R.read_readings(spark, path).orderBy("ts").collect()
    assert [r.ts for r in rows] == [dt.datetime(2009, 1, 1), dt.datetime(2009, 1, 1, 0, 30)]
    assert [r.FCH4 for r in rows] == [4.5, None] and [r.WD for r in rows] == [None, 12.0]
    named = R.read_readings(spark, path, ["TIMESTAMP_START", "TIMESTAMP_END", "FCH4", "WD"], value_columns=["FCH4"])
    assert named.columns == ["ts", "FCH4"] and named.count() == 2


def test_tolerant_and_exact_sentinels(spark):
    df = spark.createDataFrame([("-9999.00001",), ("bad",), ("1.5",)], "v string")
    assert [r.v for r in R.clean_sentinel(df, ["v"]).collect()] == [None, None, 1.5]
    assert [r.v for r in R.clean_sentinel(df, ["v"], tolerant=False).collect()] == [-9999.00001, None, 1.5]


def test_monthly_file_with_bom_and_blocks(spark, tmp_path):
    path = put(tmp_path, "all.csv", "﻿Date-Month,Rain,FCO2 Date-Month,FCO2\n1990-01,0.5,2009-01,-0.1\n1990-02,,2009-02,0.2\n1990-03,0.7,,\n")
    rain = R.read_monthly_csv(spark, path, "Date-Month", "Rain", "precip_in")
    assert sorted(map(tuple, rain.collect())) == [(dt.date(1990, 1, 1), 0.5), (dt.date(1990, 3, 1), 0.7)]
    blocks = R.read_block_csv(spark, path, {"fco2": ("FCO2 Date-Month", "FCO2")})
    assert sorted(map(tuple, blocks["fco2"].collect())) == [(dt.date(2009, 1, 1), -0.1), (dt.date(2009, 2, 1), 0.2)]


def test_comment_lines_become_metadata(spark, tmp_path):
    path = put(tmp_path, "shares.csv", "# title without pairs\n# half_hours=10; inside=4\nsector,pct\n0,2.5\n10,3.5\n")
    rows, meta = R.read_commented_csv(spark, path)
    assert [(r.sector, r.pct) for r in rows.collect()] == [("0", "2.5"), ("10", "3.5")]
    assert meta.first().metadata == {"half_hours": "10", "inside": "4"}


def test_month_means_in_fahrenheit(spark):
    df = spark.createDataFrame([("04/2009", "0"), ("04/2009", "10"), (None, "3")], "m string, c string")
    row = R.readings_to_month_mean(df, "m", "c", "soil").first()
    assert (row.month, row.soil_f, row.soil_n) == (dt.date(2009, 4, 1), 41.0, 2)


def test_grid_and_write(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2009, 1, 1), 1.0), (dt.date(2009, 4, 1), 2.0)], "month date, value double")
    full = regrid(df)
    assert full.count() == 4 and full.filter("value is null").count() == 2
    paths = sinks.write_table(full, str(tmp_path / "t"))
    assert spark.read.parquet(paths["parquet"]).count() == 4
    months = {r.month for r in spark.read.option("header", True).csv(paths["csv"]).collect()}
    assert months == {"2009-01", "2009-02", "2009-03", "2009-04"}
    bounds = df.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    assert month_grid(bounds).count() == 4


def test_stage_table_is_built_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.stage_table(spark, str(tmp_path / "s"), build).count() == 3
    assert len(calls) == 1


def test_outer_join_of_covariates(spark):
    a = spark.createDataFrame([(dt.date(2009, 1, 1), 1.0)], "month date, a double")
    b = spark.createDataFrame([(dt.date(2009, 2, 1), 2)], "month date, b int")
    assert sorted(map(tuple, R.join_covariates([a, b]).collect())) == [(dt.date(2009, 1, 1), 1.0, None), (dt.date(2009, 2, 1), None, 2)]


def test_stage_table_follows_its_inputs(spark, tmp_path):
    calls, source, stage = [], str(tmp_path / "in"), str(tmp_path / "stage")

    def made(rows, **options):
        def build():
            calls.append(1)
            return rows.selectExpr("id * 2 AS v")

        return sinks.stage_table(spark, stage, build, inputs=[rows], **options)

    spark.range(3).write.parquet(source)
    first = made(spark.read.parquet(source))
    assert first.count() == 3 and made(spark.read.parquet(source)).count() == 3 and len(calls) == 1
    assert made(spark.read.parquet(source).filter("id > 0")).count() == 2 and len(calls) == 2
    spark.range(5).write.mode("append").parquet(source)
    assert made(spark.read.parquet(source)).count() == 8 and len(calls) == 3
    assert made(spark.read.parquet(source), version="2").count() == 8 and made(spark.read.parquet(source), version="2", reuse=False).count() == 8 and len(calls) == 5
    # What was read before is still there, and a build that fails leaves the current one.
    assert first.count() == 3

    def broken():
        return spark.range(2).selectExpr("raise_error('no')")

    try:
        sinks.stage_table(spark, stage, broken, inputs=[spark.range(9)])
    except Exception:
        pass
    assert made(spark.read.parquet(source), version="2", reuse=False).count() == 8


def test_lines_of_files_are_parsed_in_a_table(spark, tmp_path):
    put(tmp_path, "a.csv", "﻿# Site: x; n=2\r\nTIMESTAMP_START,FCH4,\"WD\"\r\n\r\n200901010000,4.5,-9999\r\n# late; m = 3 \r\n200901010030,\"-9999\"\r\n")
    lines = R.lines_of(spark, str(tmp_path / "a.csv"))
    raw = R.comma_separated(lines)
    assert raw.columns == ["n", "TIMESTAMP_START", "FCH4", "WD"]
    rows = R.readings_of(raw.drop("n")).orderBy("ts").collect()
    assert [(r.FCH4, r.WD) for r in rows] == [(4.5, None), (None, None)]
    assert {(r.k, r.v) for r in R.comment_pairs(lines).collect()} == {("m", "3"), ("n", "2")}
    assert R.comma_separated(lines.limit(0)).columns == ["n"]
