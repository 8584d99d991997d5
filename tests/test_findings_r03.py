"""Results that must not hang on the last digits of means, which differ between two computations of one sum."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fluxspark.operators import aggregate as A
from fluxspark.operators import support as P

MONTHS = [dt.date(2001, m, 1) for m in range(1, 13)]


def test_support_classes_judges_the_rows_its_range_comes_from(spark):
    data = [(k, m, 4.0 + i / 16) for k in range(40) for i, m in enumerate(MONTHS)]
    noise = F.udf(lambda x: x * (1 + random.randint(-4, 4) * 2**-52), "double").asNondeterministic()
    series = spark.createDataFrame(data, "site int, month date, v double").withColumn("v", noise("v"))
    fit = spark.createDataFrame(data, "site int, month date, v double").select("site", "month")
    rows = P.support_classes(series, "v", fit, ["2001-05-01"], ["site"]).collect()
    assert len(rows) == 480
    assert all(r.support == ("removed" if r.month.month == 5 else "within") for r in rows)
    plain = spark.createDataFrame([("x", m, float(i)) for i, m in enumerate(MONTHS)] + [("y", MONTHS[0], 1.0)], "site string, month date, v double")
    some = plain.filter("site = 'x' and month between '2001-03-01' and '2001-06-01'")
    found = {(r.site, r.month.month): (r.fit_min, r.fit_max, r.support) for r in P.support_classes(plain, "v", some, ["2001-03-01"], ["site"]).collect()}
    assert [found["x", m][2] for m in range(1, 13)] == ["below"] * 2 + ["removed"] + ["within"] * 3 + ["above"] * 6
    assert found["x", 1][:2] == (3.0, 5.0) and found["y", 1] == (None, None, "within")


def test_seasonal_bias_names_no_month_by_the_last_digits(spark):
    shift = lambda m: {3: -0.5, 4: -0.5, 9: 0.25, 11: 0.25}.get(m.month, 0.0)
    data = [
        (k, m, 4.0 + i / 16 + random.Random(100 * k + i).randint(-4, 4) * 2**-50 + (shift(m) if k % 2 else 0.0), 4.0 + i / 16)
        for k in range(20) for i, m in enumerate(MONTHS)
    ]
    df = spark.createDataFrame(data, "site int, month date, a double, b double")
    rows = A.seasonal_bias_of_rule(df.select("site", "month", "a"), df.select("site", "month", "b"), "a", "b", ["site"]).collect()
    assert {(r.lowest_month, r.highest_month) for r in rows if r.site % 2} == {(3, 9)}
    assert {(r.lowest_month, r.highest_month) for r in rows if not r.site % 2} == {(1, 1)}
    assert all(abs(r.bias_swing - (0.75 if r.site % 2 else 0.0)) < 1e-12 for r in rows)
