"""Diagnostics of readings: missing values, negatives, wind sectors, product comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark import constants as K
from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, by


def _per_column(df: DataFrame, columns: Sequence[str], aggs, keys: Keys) -> DataFrame:
    """One pass over the rows, then one output row per column: aggs(c) gives {name: aggregate}."""
    names = list(aggs(columns[0]))
    wide = df.groupBy(*keys).agg(*[e.alias(f"{n}__{i}") for i, c in enumerate(columns) for n, e in aggs(c).items()])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[F.col(f"{n}__{i}").alias(n) for n in names])
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def sentinel_report(df: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    def aggs(c):
        missing = F.count("*") - F.count(c)
        return {
            "n_slots": F.count("*"),
            "n_valid": F.count(c),
            "n_missing": missing,
            "pct_missing": F.bround(100 * missing / F.count("*"), 2),
            "min": F.min(c),
            "max": F.max(c),
            "mean": F.avg(c),
        }

    return _per_column(df, columns, aggs, keys)


def column_coverage(df: DataFrame, columns: Sequence[str], ts: str = "ts", keys: Keys = ()) -> DataFrame:
    def aggs(c):
        at = F.when(F.col(c).isNotNull(), F.col(ts))
        return {"n_valid": F.count(c), "first_valid": F.min(at), "last_valid": F.max(at)}

    return _per_column(df, columns, aggs, keys)


def identification_evidence(
    df: DataFrame,
    columns: Sequence[str],
    labels: dict[str, str],
    before: str = K.PUBLISHED_START,
    published: int = K.PUBLISHED_RETAINED,
    ts: str = "ts",
    keys: Keys = (),
) -> DataFrame:
    """What separates two replicate instruments: when they started and how much they kept."""
    names = F.create_map(*[F.lit(x) for c in columns for x in (c, labels[c])])
    return column_coverage(df, columns, ts, keys).select(
        *keys,
        "column",
        names[F.col("column")].alias("source"),
        "n_valid",
        "first_valid",
        "last_valid",
        (F.col("first_valid") < F.lit(before).cast("timestamp_ntz")).alias("starts_before"),
        (F.col("n_valid") - published).alias("n_vs_published"),
    )


def yearly_valid_counts(df: DataFrame, columns: Sequence[str], ts: str = "ts", keys: Keys = ()) -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(*[F.count(c).alias(c) for c in columns])


def _negative_columns(v, limit):
    negative, n = F.count_if(v < 0), F.count(v)
    within = F.count_if((v < 0) & (v > -limit))
    beyond = F.count_if((v < 0) & (v <= -limit))
    at_least_one = F.greatest(negative, F.lit(1))
    return [
        n.alias("n_values"),
        negative.alias("n_negative"),
        F.bround(F.try_divide(100 * negative, n), 2).alias("pct_negative"),
        within.alias("n_within_limit"),
        F.bround(100 * within / at_least_one, 1).alias("pct_within_limit"),
        beyond.alias("n_beyond_limit"),
        F.bround(100 * beyond / at_least_one, 1).alias("pct_beyond_limit"),
        F.min(F.when(v < 0, v)).alias("most_negative"),
    ]


def negative_summary(df: DataFrame, value: str = "value", limit: float = K.DETECTION_LIMIT, keys: Keys = ()) -> DataFrame:
    """Negative values split by the detection limit; a value at the limit itself exceeds it."""
    return df.groupBy(*keys).agg(F.lit(limit).alias("detection_limit"), *_negative_columns(F.col(value), F.lit(limit)))


def detection_limit_sensitivity(
    df: DataFrame,
    value: str = "value",
    limit: float = K.DETECTION_LIMIT,
    uncertainty: float = K.DETECTION_LIMIT_UNCERTAINTY,
    keys: Keys = (),
) -> DataFrame:
    """The negative split at the limit and at both ends of its uncertainty, from one pass.

    Values condense to one count per class between the limits before anything is repeated per limit.
    """
    limits = (limit - uncertainty, limit, limit + uncertainty)
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.count_if(v < 0).alias("neg"), F.min(F.when(v < 0, v)).alias("low")]
    aggs += [F.count_if((v < 0) & (v > -x)).alias(f"w{i}") for i, x in enumerate(limits)]
    one = F.greatest("neg", F.lit(1))
    row = lambda i, x: F.struct(
        F.lit(float(x)).alias("detection_limit"),
        F.col("n").alias("n_values"),
        F.col("neg").alias("n_negative"),
        F.bround(F.try_divide(100 * F.col("neg"), F.col("n")), 2).alias("pct_negative"),
        F.col(f"w{i}").alias("n_within_limit"),
        F.bround(100 * F.col(f"w{i}") / one, 1).alias("pct_within_limit"),
        (F.col("neg") - F.col(f"w{i}")).alias("n_beyond_limit"),
        F.bround(100 * (F.col("neg") - F.col(f"w{i}")) / one, 1).alias("pct_beyond_limit"),
        F.col("low").alias("most_negative"),
    )
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[row(i, x) for i, x in enumerate(limits)])).alias("r")).select(
        *keys, "r.*"
    )


def concurrent_negatives(df: DataFrame, a: str, b: str, limit: float = K.DETECTION_LIMIT, keys: Keys = ()) -> DataFrame:
    """Whether two instruments see a negative flux at once."""
    x, y = F.col(a), F.col(b)
    either, both = F.count_if((x < 0) | (y < 0)), F.count_if((x < 0) & (y < 0))
    beyond = F.count_if((x <= -limit) & (y <= -limit))
    some = F.greatest(either, F.lit(1))
    return df.filter(x.isNotNull() & y.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_paired"),
        F.count_if(x < 0).alias("n_negative_a"),
        F.count_if(y < 0).alias("n_negative_b"),
        either.alias("n_negative_either"),
        both.alias("n_negative_both"),
        F.bround(100 * both / some, 1).alias("pct_concurrent"),
        beyond.alias("n_beyond_both"),
        F.bround(100 * beyond / some, 2).alias("pct_beyond_concurrent"),
    )


def negative_share_by_year(merged: DataFrame, value: str = "value", ts: str = "ts", keys: Keys = ()) -> DataFrame:
    v = F.col(value)
    return merged.filter(v.isNotNull()).groupBy(*keys, F.year(ts).alias("year")).agg(
        F.count("*").alias("n"),
        F.count_if(v < 0).alias("n_negative"),
        F.array_join(F.array_sort(F.collect_set("source")), "/").alias("sources"),
        F.bround(100 * F.count_if(v < 0) / F.count("*"), 1).alias("pct_negative"),
    )


def _comparison_columns(l, r):
    both = l.isNotNull() & r.isNotNull()
    return {
        "valid_left": F.count(l),
        "valid_right": F.count(r),
        "valid_both": F.count_if(both),
        "identical": F.count_if(both & (l == r)),
        "differing": F.count_if(both & (l != r)),
        "only_left": F.count_if(l.isNotNull() & r.isNull()),
        "only_right": F.count_if(l.isNull() & r.isNotNull()),
        "max_abs_difference": F.max(F.abs(r - l)),
    }


def compare_products(
    left: DataFrame, right: DataFrame, columns: Sequence[str], on: Sequence[str] = ("ts",)
) -> DataFrame:
    """Agreement of two products per column, over the slots they share.

    A column only one of them has is reported as such. One join serves all columns.
    """
    shared = [c for c in columns if c in left.columns and c in right.columns]
    l = left.select(*on, *[F.col(c).alias(f"l__{c}") for c in shared])
    r = right.select(*on, *[F.col(c).alias(f"r__{c}") for c in shared])
    aggs = [F.count("*").alias("shared_slots")]
    for i, c in enumerate(shared):
        aggs += [e.alias(f"{n}__{i}") for n, e in _comparison_columns(F.col(f"l__{c}"), F.col(f"r__{c}")).items()]
    wide = l.join(r, list(on)).agg(*aggs)
    names = list(_comparison_columns(F.lit(0.0), F.lit(0.0)))
    rows = []
    for c in columns:
        have = c in shared
        kind = lambda n: "double" if n == "max_abs_difference" else "bigint"
        value = lambda n: F.col(f"{n}__{shared.index(c)}") if have else F.lit(None).cast(kind(n))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(have).alias("in_both"),
                (F.col("shared_slots") if have else F.lit(None).cast("bigint")).alias("shared_slots"),
                *[value(n).alias(n) for n in names],
            )
        )
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def difference_by_year(
    left: DataFrame, right: DataFrame, column: str, on: Sequence[str] = ("ts",), ts: str = "ts"
) -> DataFrame:
    l = left.filter(F.col(column).isNotNull()).select(*on, F.col(column).alias("__l"))
    r = right.filter(F.col(column).isNotNull()).select(*on, F.col(column).alias("__r"))
    same = F.count_if(F.col("__l") == F.col("__r"))
    return (
        l.join(r, list(on))
        .groupBy(F.year(ts).alias("year"))
        .agg(F.count("*").alias("n"), same.alias("identical"), (F.count("*") - same).alias("differing"))
    )


def sector_cost(
    df: DataFrame, fluxes: Sequence[str], wd: str = "wd", sector=K.EXCLUDED_SECTOR, keys: Keys = ()
) -> DataFrame:
    """Share of rows, and of each flux, whose wind blows from the excluded sector."""
    recorded, inside = F.col(wd).isNotNull(), C.sector_membership(wd, sector)
    series = {"all half-hours": recorded, **{c: recorded & F.col(c).isNotNull() for c in fluxes}}
    aggs = []
    for i, used in enumerate(series.values()):
        aggs += [F.count_if(used).alias(f"n{i}"), F.count_if(used & inside).alias(f"s{i}")]
    row = lambda i, name: F.struct(
        F.lit(name).alias("series"),
        F.col(f"n{i}").alias("n_with_wind_direction"),
        F.when(F.col(f"n{i}") > 0, F.bround(100 * F.col(f"s{i}") / F.col(f"n{i}"), 2)).alias("pct_inside_sector"),
    )
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[row(i, name) for i, name in enumerate(series)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def coverage_against_sector(
    df: DataFrame, value: str = "value", wd: str = "wd", sector=K.EXCLUDED_SECTOR, keys: Keys = ()
) -> DataFrame:
    """Record length at each stage, from all slots to the values kept."""
    recorded, inside = F.col(wd).isNotNull(), C.sector_membership(wd, sector)
    wide = df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(recorded).alias("recorded"),
        F.count_if(inside).alias("removed"),
        F.count_if(recorded & ~inside).alias("available"),
        F.count(value).alias("retained"),
    )
    stages = {
        "all half-hours": "total",
        "wind direction recorded": "recorded",
        "removed by the excluded sector": "removed",
        "outside sector, wind direction recorded": "available",
        "value retained": "retained",
    }
    row = lambda name, c: F.struct(
        F.lit(name).alias("stage"),
        F.col(c).alias("n_half_hours"),
        F.bround(100 * F.col(c) / F.col("total"), 1).alias("pct_of_record"),
        (F.bround(F.try_divide(100 * F.col(c), F.col("available")), 1) if c == "retained" else F.lit(None).cast("double")).alias(
            "pct_of_available"
        ),
    )
    rows = F.array(*[row(name, c) for name, c in stages.items()])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def sector_shares(
    df: DataFrame, wd: str = "wd", width: int = 10, sector=K.EXCLUDED_SECTOR, keys: Keys = ()
) -> DataFrame:
    """Share of the rows with a wind direction per sector, and whether the sector is left out."""
    start = (F.floor(F.col(wd) / width) * width).cast("int")
    bins = df.filter(F.col(wd).isNotNull()).groupBy(*keys, start.alias("sector_start")).agg(F.count("*").alias("n"))
    return bins.select(
        *keys,
        "sector_start",
        F.bround(100 * F.col("n") / F.sum("n").over(by(*keys)), 4).alias("pct"),
        ((F.col("sector_start") >= sector[0]) & (F.col("sector_start") < sector[1])).alias("excluded"),
    )


def metadata_value(eav: DataFrame, variable: str, order: str, keys: Keys = ()) -> DataFrame:
    """First value recorded for a variable, or null."""
    hit = F.when(F.col("variable") == variable, F.col(order))
    return eav.groupBy(*keys).agg(
        F.min_by(F.when(F.col("variable") == variable, F.col("value")), hit).alias("value")
    )


