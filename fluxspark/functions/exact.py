"""Exact null laws of two small samples without ties, as array recurrences in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_sum_p(u: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p of the count u of pairs in which sample 1 is larger.

    Of all arrangements of n1 and n2 values, those with u such pairs are the coefficient of q^u in the product of
    (1 - q^(n2 + i)) / (1 - q^i), i = 1..n1; each factor is one pass over an array of n1 n2 + 1 counts.
    """

    def factor(a: Column, i: Column) -> Column:
        thinned = F.transform(a, lambda v, k: v - F.coalesce(F.get(a, (k - n2 - i).cast("int")), F.lit(0.0)))
        return F.aggregate(thinned, F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(v + F.coalesce(F.get(acc, (F.size(acc) - i).cast("int")), F.lit(0.0)))))

    start = F.transform(F.sequence(F.lit(0).cast("bigint"), n1 * n2), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(F.sequence(F.lit(1).cast("bigint"), n1), start, factor)
    most = F.greatest(u, n1 * n2 - u)
    law = F.transform(F.array(F.struct(counts.alias("c"), F.ceil(most).alias("m"))), lambda s: F.struct(s["c"].alias("c"), F.slice(s["c"], (s["m"] + 1).cast("int"), F.size(s["c"])).alias("top")))[0]
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    p = F.transform(F.array(law), lambda s: F.least(F.lit(1.0), 2 * total(s["top"]) / total(s["c"])))[0]
    return F.when((n1 > 0) & (n2 > 0), p)


def two_sample_distance_p(d: Column, n1: Column, n2: Column) -> Column:
    """P of a largest distance of at least d between two empirical distributions.

    An arrangement is a lattice path from (0, 0) to (n1, n2) whose next step goes either way by what is left of each sample. The
    chance to stay nearer than d at every point is carried along row by row; p is what leaves.
    """
    edge = F.round(d * n1 * n2)

    def row(before: Column, i: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            left = n1 + n2 - i - j + 1
            down = F.coalesce(F.get(before, j.cast("int")), F.lit(0.0)) * (n1 - i + 1) / left
            right = F.coalesce(F.get(acc, (j - 1).cast("int")), F.lit(0.0)) * (n2 - j + 1) / left
            chance = F.when((i == 0) & (j == 0), 1.0).otherwise(F.when(i == 0, 0.0).otherwise(down) + F.when(j == 0, 0.0).otherwise(right))
            return F.concat(acc, F.array(F.when(F.abs(i * n2 - j * n1) >= edge, 0.0).otherwise(chance)))

        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), n2), F.array().cast("array<double>"), cell)

    last = F.aggregate(F.sequence(F.lit(0).cast("bigint"), n1), F.array().cast("array<double>"), row)
    p = F.when(edge <= 0, 1.0).otherwise(1 - F.element_at(last, -1))
    return F.when((n1 > 0) & (n2 > 0), p)
