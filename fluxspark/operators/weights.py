"""Inverse-variance weights of monthly means, and who holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, by


def add_weights(monthly: DataFrame, se: str, keys: Keys = ()) -> DataFrame:
    """Weight and its share in percent. Months without a standard error carry null, not zero."""
    rows = monthly.withColumn("weight", C.inverse_variance_weight(se))
    return rows.withColumn(
        "relative_weight_pct", 100 * F.col("weight") / F.sum("weight").over(by(*keys))
    )


def weight_summary(monthly: DataFrame, columns: Sequence[str], se: str, keys: Keys = ()) -> DataFrame:
    """Distribution of the evidence columns and of the relative weight, one row each."""
    rows = add_weights(monthly, se, keys)
    names = [*columns, se, "relative_weight_pct"]
    long = rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(keys), names, "measure", "v"
    )
    q = lambda p: F.bround(F.percentile("v", F.lit(p)), 4)
    return long.groupBy(*keys, "measure").agg(
        F.count("v").alias("count"),
        F.bround(F.avg("v"), 4).alias("mean"),
        F.bround(F.stddev_samp("v"), 4).alias("std"),
        F.bround(F.min("v"), 4).alias("min"),
        q(0.05).alias("p5"),
        q(0.25).alias("p25"),
        q(0.5).alias("p50"),
        q(0.75).alias("p75"),
        q(0.95).alias("p95"),
        F.bround(F.max("v"), 4).alias("max"),
    )


def weight_concentration(
    monthly: DataFrame, se: str, shares: Sequence[float] = (0.10, 0.25, 0.50), keys: Keys = ()
) -> DataFrame:
    """Weight held by the heaviest and lightest months, and the effective number of months."""
    rows = monthly.withColumn("w", C.inverse_variance_weight(se)).filter("w is not null")
    ranked = rows.select(
        *keys,
        "w",
        F.row_number().over(by(*keys).orderBy(F.desc("w"), "month")).alias("r"),
        F.count("*").over(by(*keys)).alias("n"),
    )
    k = lambda s: F.greatest(F.lit(1), F.bround(F.lit(s) * F.col("n"), 0).cast("int"))
    aggs, out = [], []
    for i, s in enumerate(shares):
        for end, hit in (("top", F.col("r") <= k(s)), ("bottom", F.col("r") > F.col("n") - k(s))):
            aggs += [
                F.sum(F.when(hit, F.col("w"))).alias(f"{end}{i}"),
                F.count_if(hit).alias(f"n_{end}{i}"),
            ]
            out.append(
                F.struct(
                    F.lit(f"{end} {int(s * 100)}% of months by weight").alias("group"),
                    F.col(f"n_{end}{i}").alias("n_months"),
                    F.bround(100 * F.col(f"{end}{i}") / F.col("total"), 1).alias("value"),
                )
            )
    out.append(
        F.struct(
            F.lit("effective number of months").alias("group"),
            F.col("n_all").alias("n_months"),
            F.bround(F.col("effective"), 1).alias("value"),
        )
    )
    wide = ranked.groupBy(*keys).agg(
        *aggs,
        F.sum("w").alias("total"),
        F.count("*").alias("n_all"),
        (F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w"))).alias("effective"),
    )
    return wide.select(*keys, F.explode(F.array(*out)).alias("r")).select(*keys, "r.*")


def by_influence(
    monthly: DataFrame, se: str, n: int, heaviest: bool, columns: Sequence[str] = (), keys: Keys = ()
) -> DataFrame:
    """The n months of largest or smallest weight; null weights are not ranked."""
    equal = F.lit(100.0) / F.count("*").over(by(*keys))
    rows = add_weights(monthly, se, keys).withColumn("equal_weight_pct", equal).filter("weight is not null")
    order = F.desc("weight") if heaviest else F.asc("weight")
    ranked = rows.withColumn("rank", F.row_number().over(by(*keys).orderBy(order, "month"))).filter(F.col("rank") <= n)
    return ranked.select(
        *keys, "month", *columns, se,
        F.bround("relative_weight_pct", 4).alias("relative_weight_pct"),
        F.bround("equal_weight_pct", 4).alias("equal_weight_pct"),
        "rank",
    )


def least_influential(monthly: DataFrame, se: str, n: int = 12, columns: Sequence[str] = (), keys: Keys = ()) -> DataFrame:
    return by_influence(monthly, se, n, False, columns, keys)


def most_influential(monthly: DataFrame, se: str, n: int = 6, columns: Sequence[str] = (), keys: Keys = ()) -> DataFrame:
    return by_influence(monthly, se, n, True, columns, keys)


def seasonal_weight_balance(monthly: DataFrame, mean: str, se: str, keys: Keys = ()) -> DataFrame:
    """Weight per month of the year against an even share."""
    rows = monthly.withColumn("w", C.inverse_variance_weight(se))
    moy = rows.groupBy(*keys, F.month("month").alias("month_of_year")).agg(
        F.count("*").alias("n_months"), F.avg(mean).alias("m"), F.avg(se).alias("s"), F.sum("w").alias("w")
    )
    total = lambda c: F.sum(c).over(by(*keys))
    return moy.select(
        *keys,
        "month_of_year",
        "n_months",
        F.bround("m", 3).alias("mean_flux"),
        F.bround("s", 3).alias("mean_se"),
        F.bround(100 * F.coalesce("w", F.lit(0.0)) / total("w"), 3).alias("weight_share_pct"),
        F.bround(100 * F.col("n_months") / total("n_months"), 3).alias("equal_share_pct"),
    )


