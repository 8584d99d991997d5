"""Exact null laws against counting all splits."""

import itertools
import math
import random

from pyspark.sql import functions as F

from fluxspark.functions import exact
from fluxspark.operators import stats as T


def counted(x, n1):
    """(u, distance, p, p) of the first n1 values against the rest, from all splits."""
    order = sorted(range(len(x)), key=lambda i: x[i])
    rank = {i: r for r, i in enumerate(order)}

    def measures(first):
        places = sorted(rank[i] for i in first)
        u = sum(p - k for k, p in enumerate(places))
        far, a, b = 0.0, 0, 0
        for r in range(len(x)):
            if r in places:
                a += 1
            else:
                b += 1
            far = max(far, abs(a / n1 - b / (len(x) - n1)))
        return u, far

    u, far = measures(range(n1))
    every = [measures(c) for c in itertools.combinations(range(len(x)), n1)]
    top = n1 * (len(x) - n1)
    p = min(1.0, 2 * sum(v >= max(u, top - u) for v, _ in every) / len(every))
    return u, far, p, sum(f >= far - 1e-12 for _, f in every) / len(every)


def test_laws_agree_with_all_splits(spark):
    rnd, rows, want = random.Random(1), [], {}
    for g, (n1, n2) in enumerate([(1, 1), (1, 6), (3, 4), (5, 2), (6, 6), (8, 5), (8, 8)]):
        x = [rnd.random() + (0.4 if i < n1 and g % 2 else 0) for i in range(n1 + n2)]
        want[g] = counted(x, n1)
        rows += [(g, i < n1, i >= n1, v) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, a boolean, b boolean, value double")
    for r in T.exact_two_samples(df, "a", "b", on=["g"]).collect():
        u, far, p, q = want[r.g]
        assert r.u == u and math.isclose(r.ks_statistic, far) and math.isclose(r.mann_whitney_p, p) and math.isclose(r.ks_p, q, abs_tol=1e-12), r


def test_exact_laws_only_where_they_hold(spark):
    tied = [("tied", i < 3, i >= 3, float(i % 4)) for i in range(7)] + [("none", True, False, 1.0)]
    large = [("large", i < 20, i >= 20, float((i * 7) % 50)) for i in range(50)]
    df = spark.createDataFrame(tied + large, "g string, a boolean, b boolean, value double")
    got = {r.g: r for r in T.exact_two_samples(df, "a", "b", on=["g"], cells=300).collect()}
    assert got["tied"].mann_whitney_p is None and got["tied"].ks_p is not None
    assert got["none"].ks_p is None and got["large"].mann_whitney_p is None and got["large"].ks_p is None
    whole = spark.range(1).select(exact.two_sample_distance_p(F.lit(0.0), F.lit(3), F.lit(4)), exact.rank_sum_p(F.lit(6.0), F.lit(3), F.lit(4))).first()
    assert whole[0] == 1.0 and whole[1] == 1.0
