"""Merging, aggregation and quality on frames small enough to work out by hand."""

import datetime as dt
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from fluxspark.functions import columns as C
from fluxspark.operators import aggregate as A
from fluxspark.operators import merge as M
from fluxspark.operators import quality as Q
from fluxspark.operators.common import cumulative_counts, exact_quantiles, order_statistics, require_columns

T0 = dt.datetime(2015, 1, 1)
SLOT = dt.timedelta(minutes=30)


def wide(spark, rows, start=T0):
    data = [(start + i * SLOT, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "ts timestamp_ntz, a double, b double, c double")


def labelled(spark, sources, start=T0, site="x"):
    data = [(site, start + i * SLOT, float(i + 1), s) for i, s in enumerate(sources)]
    return spark.createDataFrame(data, "site string, ts timestamp_ntz, value double, source string")


def test_merge_takes_first_and_keeps_every_slot(spark):
    df = wide(spark, [(1.0, 2.0, None), (None, 5.0, 6.0), (None, None, None), (None, None, 7.0)])
    rows = M.merge_precedence(df, ["a", "b", "c"]).orderBy("ts").collect()
    assert [r.value for r in rows] == [1.0, 5.0, None, 7.0]
    assert [r.source for r in rows] == ["a", "b", "none", "c"]
    assert [r.n_reporting for r in rows] == [2, 2, 0, 1]


def test_merge_errors(spark):
    df = wide(spark, [(1.0, 2.0, 3.0)])
    with pytest.raises(ValueError):
        M.merge_precedence(df, [])
    with pytest.raises(ValueError, match="zz"):
        require_columns(df, ["zz"])
    with pytest.raises(PySparkException, match="columns overlap: a/b"):
        M.assert_disjoint(df, ["a", "b"]).select("b").collect()
    assert M.pairwise_overlap(df, ["a"]).columns[:2] == ["left", "right"]


def test_daily_mean_deviation_and_error(spark):
    df = labelled(spark, ["s"] * 8).withColumn("value", F.col("value") * 2)
    row = A.daily_stats(df, sources={"s": "s", "t": "t"}).first()
    assert row.value_mean == 9 and row.value_n == 8
    assert math.isclose(row.value_sd, math.sqrt(24)) and math.isclose(row.value_se, math.sqrt(3))
    assert (row.frac_s, row.frac_t, row.n_sources, row.is_mixed) == (1.0, 0.0, 1, False)
    assert A.daily_stats(df, min_obs=9).count() == 0


def test_single_value_has_no_deviation(spark):
    row = A.monthly_stats(labelled(spark, ["s"]), "value").first()
    assert row.value_n == 1 and row.value_sd is None and row.value_se is None


def test_balanced_mean_removes_skew(spark):
    # Daytime is sampled on three days at 0, night on one day at 10: balanced mean is halfway.
    rows = [(T0.replace(day=d, hour=12), 0.0) for d in (1, 2, 3)] + [(T0.replace(hour=0), 10.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    assert A.monthly_balanced(df, "v").first().v_mean == 5.0


def expected_runs(sources):
    out = []
    for s in sources:
        if out and out[-1][0] == s:
            out[-1][1] += 1
        else:
            out.append([s, 1])
    return [tuple(r) for r in out]


def test_runs_across_slices_match_brute_force(spark):
    rnd = random.Random(3)
    sources = []
    while len(sources) < 48 * 12:
        sources += [rnd.choice("pqr")] * rnd.choice([1, 2, 3, 50, 130])
    df = labelled(spark, sources)
    other = labelled(spark, ["q"] * 300, site="y")
    runs = M.source_runs(df.unionByName(other), keys=["site"])
    got = [(r.source, r.n) for r in runs.filter("site = 'x'").orderBy("first").collect()]
    assert got == expected_runs(sources)
    assert [(r.source, r.n) for r in runs.filter("site = 'y'").collect()] == [("q", 300)]
    total = M.total_switches(runs, ["site"]).filter("site = 'x'").first().switches
    by_year = M.switch_summary(runs, ["site"]).filter("site = 'x'").agg(F.sum("n_switches").alias("n")).first().n
    assert total == by_year == len(got) - 1


def test_runs_skip_empty_slices_and_null_rows(spark):
    late = labelled(spark, ["p", "p"], start=T0 + dt.timedelta(days=40))
    df = labelled(spark, ["p", "q", "p"]).unionByName(late)
    df = df.withColumn("value", F.when(F.col("source") != "q", F.col("value")))
    assert [(r.source, r.n) for r in M.source_runs(df).collect()] == [("p", 4)]


def test_limit_itself_exceeds(spark):
    df = spark.createDataFrame([(-3.0,), (-2.9,), (1.0,), (None,)], "value double")
    row = Q.negative_summary(df).first()
    assert (row.n_values, row.n_negative, row.n_within_limit, row.n_beyond_limit) == (3, 2, 1, 1)
    assert row.most_negative == -3.0


def test_sector_is_half_open(spark):
    df = spark.createDataFrame([(30.0,), (199.9,), (200.0,), (None,)], "wd double")
    assert [r[0] for r in df.select(C.sector_membership("wd")).collect()] == [True, True, False, False]


def test_compare_products_reports_absent_column(spark):
    left = wide(spark, [(1.0, 1.0, None), (2.0, None, None)])
    right = left.withColumn("a", F.col("a") + 0.25).drop("b")
    rows = {r.column: r for r in Q.compare_products(left, right, ["a", "b"]).collect()}
    assert rows["a"].differing == 2 and rows["a"].max_abs_difference == 0.25
    assert rows["b"].in_both is False and rows["b"].shared_slots is None


def test_unknown_label_stops(spark):
    df = spark.createDataFrame([("nope",)], "s string")
    with pytest.raises(PySparkException, match="unknown label"):
        df.select(C.slug_of("s")).collect()


def test_multiset_counts_must_match(spark):
    long = spark.createDataFrame([(T0, "a", 1.0), (T0 + SLOT, "a", 1.0), (T0 + 2 * SLOT, "a", 2.0)], "ts timestamp_ntz, column string, value double")
    long = long.withColumn("date", F.to_date("ts"))
    derived = spark.createDataFrame([(T0.date(), 1.0)], "date date, rounded double")
    kept = M.label_multiset_subset(long, derived).filter("in_derived").collect()
    assert [r.ts for r in kept] == [T0]
    wrong = spark.createDataFrame([(T0.date(), 9.0)], "date date, rounded double")
    with pytest.raises(PySparkException, match="without a match"):
        M.label_multiset_subset(long, wrong).collect()


def test_exact_quantiles_on_skewed_values(spark):
    # One value holds a third of the rows; the coarse sketch must still bracket exactly.
    rnd = random.Random(1)
    values = [0.0] * 3000 + [rnd.gauss(0, 10) for _ in range(3000)] + [rnd.expovariate(1) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", {"a": 0.01, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0}, accuracy=200).first()
    ordered = sorted(values)

    def linear(p):
        h = (len(ordered) - 1) * p
        lo = math.floor(h)
        hi = min(lo + 1, len(ordered) - 1)
        return ordered[lo] + (ordered[hi] - ordered[lo]) * (h - lo)

    for name, p in {"a": 0.01, "b": 0.5, "c": 0.9, "d": 0.0, "e": 1.0}.items():
        assert math.isclose(got[name], linear(p), abs_tol=1e-12)
    rank = order_statistics(df, "v", [("r", 17 / 9000, lambda n: F.lit(17))], accuracy=200).first().r
    assert rank == ordered[16]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7])
def test_exact_quantiles_on_few_rows(spark, n):
    df = spark.createDataFrame([(float(i * i),) for i in range(n)], "v double")
    want = df.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q")).first().q
    got = exact_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.95}).first()
    assert all(math.isclose(x, y) for x, y in zip((got.a, got.b, got.c), want))


def test_cumulative_counts(spark):
    values = [1.0, 1.0, 5.0, 2.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = cumulative_counts(df, "v", buckets=3).orderBy("v").collect()
    assert [(r.v, r.n_at, r.n_through) for r in rows] == [(1.0, 2, 2), (2.0, 3, 5), (5.0, 1, 6), (9.0, 1, 7)]


def test_row_order_and_keys_do_not_matter(spark):
    x, y = labelled(spark, list("pqppqrrp") * 12), labelled(spark, list("rrrq") * 30, site="y")
    both = x.unionByName(y).orderBy(F.rand(7))
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    pick = lambda df, s: sorted(tuple(map(near, r)) for r in df.filter(F.col("site") == s).collect())
    runs = M.source_runs(both, keys=["site"])
    assert pick(runs, "x") == pick(M.source_runs(x, keys=["site"]), "x")
    daily = A.daily_stats(both, min_obs=1, keys=["site"])
    assert pick(daily, "y") == pick(A.daily_stats(y, min_obs=1, keys=["site"]), "y")
