"""Merging replicate columns by precedence, and what the merge leaves behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, attach, by, key_join, require_columns, stack_rows


def merge_precedence(
    df: DataFrame,
    columns: Sequence[str],
    labels: Mapping[str, str] | None = None,
    value: str = "value",
    ts: str = "ts",
    keep: Sequence[str] = (),
    keys: Keys = (),
) -> DataFrame:
    """First reported value by precedence, with where it came from. Row-local: every slot stays."""
    if not columns:
        raise ValueError("name at least one column to merge")
    require_columns(df, [ts, *columns, *keys])
    labels = labels or {c: c for c in columns}
    pick = lambda name_of: F.coalesce(
        *[F.when(F.col(c).isNotNull(), F.lit(name_of(c))) for c in columns], F.lit("none")
    )
    reporting = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return df.select(
        *keys,
        ts,
        *keep,
        F.coalesce(*columns).cast("double").alias(value),
        pick(lambda c: c).alias("source_column"),
        pick(lambda c: labels.get(c, "none")).alias("source"),
        reporting.alias("n_reporting"),
    )


def merged_value(df: DataFrame, columns: Sequence[str], value: str = "value") -> DataFrame:
    return df.withColumn(value, F.coalesce(*columns))


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on which both columns report, with their signed difference."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("difference", F.col(a) - F.col(b))


def pairwise_overlap(df: DataFrame, columns: Sequence[str], keys: Keys = ()) -> DataFrame:
    """Per column pair: slots shared, correlation, identical values, mean difference. One pass."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        none = {"left": "string", "right": "string", "n_both": "bigint", "correlation": "double", "n_identical": "bigint", "mean_difference": "double"}
        return df.limit(0).select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [
            F.count_if(both).alias(f"n{i}"),
            F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias(f"r{i}"),
            F.count_if(both & (F.col(a) == F.col(b))).alias(f"i{i}"),
            F.avg(F.col(a) - F.col(b)).alias(f"d{i}"),
        ]
    row = lambda i, a, b: {
        "left": F.lit(a),
        "right": F.lit(b),
        "n_both": F.col(f"n{i}"),
        "correlation": F.col(f"r{i}"),
        "n_identical": F.when(F.col(f"n{i}") > 0, F.col(f"i{i}")),
        "mean_difference": F.col(f"d{i}"),
    }
    wide = df.groupBy(*keys).agg(*aggs)
    stacked = stack_rows("pair", {f"{a}/{b}": row(i, a, b) for i, (a, b) in enumerate(pairs)})
    return wide.select(*keys, stacked.alias("p")).select(
        *keys, "p.left", "p.right", "p.n_both", "p.correlation", "p.n_identical", "p.mean_difference"
    )


def assert_disjoint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same frame, whose first row with two of the columns stops the job that reads it, naming them.

    The guard is part of the plan: it costs no pass of its own, and a job that reads none of the columns
    doesn't run it.
    """
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns]))
    stop = F.raise_error(F.concat(F.lit("columns overlap: "), F.array_join(present, "/")))
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.size(present) > 1, stop.cast(kinds[c])).otherwise(F.col(c)) for c in columns})


def provenance_summary(merged: DataFrame, value: str = "value", keys: Keys = ()) -> DataFrame:
    counts = (
        merged.filter(F.col(value).isNotNull())
        .groupBy(*keys, "source_column", "source")
        .agg(F.count("*").alias("n"))
    )
    return counts.withColumn("pct", F.bround(100 * F.col("n") / F.sum("n").over(by(*keys)), 2))


def provenance_by_year(
    merged: DataFrame, sources: Sequence[str], value: str = "value", ts: str = "ts", keys: Keys = ()
) -> DataFrame:
    return (
        merged.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.year(ts).alias("year"))
        .agg(*[F.count_if(F.col("source") == s).alias(s) for s in sources], F.count("*").alias("total"))
    )


def contention_summary(
    merged: DataFrame, columns: Sequence[str], value: str = "value", keys: Keys = ()
) -> DataFrame:
    """How often precedence had to choose, and what it chose."""
    contested = F.col("n_reporting") > 1
    return merged.groupBy(*keys).agg(
        F.count(value).alias("slots_with_value"),
        F.count_if(contested).alias("contested_slots"),
        F.coalesce(F.sum(F.when(contested, F.col("n_reporting") - 1)), F.lit(0)).cast("bigint").alias("discarded"),
        *[
            F.count_if(contested & (F.col("source_column") == c)).alias(f"resolved_to_{c}")
            for c in columns
        ],
    )


def source_runs(
    merged: DataFrame,
    source: str = "source",
    value: str = "value",
    ts: str = "ts",
    keys: Keys = (),
    slice_by: str = "day",
) -> DataFrame:
    """Stretches of reported rows that share one source, however far apart in time.

    Two steps, so that no window spans a whole series of readings. Rows form runs inside a time slice;
    then only the first and last run of each slice, at most two rows per slice, meet their
    neighbours in the window over the series.
    """
    reported = merged.filter(F.col(value).isNotNull()).select(
        *keys, F.col(ts).alias("__ts"), F.col(source).alias("source"), F.date_trunc(slice_by, F.col(ts)).alias("__s")
    )
    in_slice = Window.partitionBy(*keys, "__s").orderBy("__ts")
    changed = F.when(F.col("source") == F.lag("source").over(in_slice), 0).otherwise(1)
    local = (
        reported.withColumn("__c", changed)
        .withColumn("__r", F.sum("__c").over(in_slice.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__s", "__r", "source")
        .agg(
            F.min("__ts").alias("first"),
            F.max("__ts").alias("last"),
            F.count("*").alias("n"),
        )
        .withColumn("__last", F.max("__r").over(Window.partitionBy(*keys, "__s")))
    )
    edge = (F.col("__r") == 1) | (F.col("__r") == F.col("__last"))
    out = [*keys, "source", "first", "last", "n"]
    inner = local.filter(~edge).select(*out)
    along = by(*keys).orderBy("__s", "__r")
    # A run continues its neighbour only across a slice border and with the same source.
    joins = (F.col("__r") == 1) & (F.col("source") == F.lag("source").over(along))
    stitched = (
        local.filter(edge)
        .withColumn("__new", F.when(joins, 0).otherwise(1))
        .withColumn("__g", F.sum("__new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "__g", "source")
        .agg(
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("n").alias("n"),
        )
        .select(*out)
    )
    return inner.unionByName(stitched)


def switch_summary(runs: DataFrame, keys: Keys = ()) -> DataFrame:
    """Runs and switches per year. A switch belongs to the year its new run starts in; the first run of a series is none."""
    per = runs.groupBy(*keys, F.year("first").alias("year")).agg(
        F.count("*").alias("n_runs"),
        F.percentile("n", F.lit(0.5)).alias("median_run"),
        F.max("n").alias("max_run"),
        F.array_join(F.array_sort(F.collect_set("source")), "/").alias("sources"),
    )
    opens = (F.col("year") == F.min("year").over(by(*keys))).cast("bigint")
    return per.select(*keys, "year", "n_runs", (F.col("n_runs") - opens).alias("n_switches"), "median_run", "max_run", "sources")


def total_switches(runs: DataFrame, keys: Keys = ()) -> DataFrame:
    return runs.groupBy(*keys).agg(F.greatest(F.count("*") - 1, F.lit(0)).cast("bigint").alias("switches"))


def structural_boundaries(runs: DataFrame, min_run: int = 200) -> DataFrame:
    return runs.filter(F.col("n") >= min_run)


def label_multiset_subset(
    long: DataFrame,
    derived: DataFrame,
    decimals: int = 3,
    ts: str = "ts",
    keys: Keys = (),
    check_total: bool = True,
) -> DataFrame:
    """Mark the long rows that a derived file, holding only day and rounded value, was cut from.

    A value kept k times on a day claims the k earliest matching rows. Both inputs are read once: derived rows join the long ones
    in one window per match group, which is one day's slots of one series. With ``check_total`` a derived row without a
    long row to claim stops the job.
    """
    match = [*keys, "date", "rounded"]
    rounded = long.withColumn("rounded", F.bround("value", decimals))
    rows = rounded.select(*match, F.struct(*[c for c in rounded.columns if c not in match]).alias("__row"))
    asked = derived.select(*[F.col(c).cast(rounded.schema[c].dataType).alias(c) for c in match], F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    long_row = F.col("__row").isNotNull()
    group = Window.partitionBy(*match)
    order = group.orderBy(long_row.desc(), f"__row.{ts}", "__row.column")
    counted = rows.unionByName(asked).select(
        "*", F.row_number().over(order).alias("__k"), F.count_if(long_row).over(group).alias("__has"), F.count_if(~long_row).over(group).alias("__wanted")
    )
    if check_total:
        short = F.raise_error(F.lit("derived rows without a match in the long frame")).cast("boolean")
        counted = counted.filter(F.when(F.col("__wanted") > F.col("__has"), short).otherwise(long_row))
    else:
        counted = counted.filter(long_row)
    kept = [F.col(c) if c in match else F.col("__row")[c].alias(c) for c in rounded.columns]
    return counted.select(*kept, (F.col("__k") <= F.col("__wanted")).alias("in_derived"))


def derived_provenance(labelled: DataFrame, columns: Sequence[str], ts: str = "ts", keys: Keys = ()) -> DataFrame:
    return (
        labelled.filter("in_derived")
        .groupBy(*keys, F.year(ts).alias("year"))
        .agg(*[F.count_if(F.col("column") == c).alias(c) for c in columns])
    )


def kept_range(labelled: DataFrame, keys: Keys = ()) -> DataFrame:
    """Range of the kept values, and how many dropped ones fall inside it."""
    bounds = (
        labelled.filter("in_derived").groupBy(*keys).agg(F.min("value").alias("kept_min"), F.max("value").alias("kept_max"))
    )
    inside = ~F.col("in_derived") & F.col("value").between(F.col("kept_min"), F.col("kept_max"))
    return (
        attach(labelled, bounds, keys)
        .groupBy(*keys)
        .agg(
            F.max("kept_min").alias("kept_min"),
            F.max("kept_max").alias("kept_max"),
            F.count_if("in_derived").alias("n_kept"),
            F.count_if(~F.col("in_derived")).alias("n_dropped"),
            F.count_if(inside).alias("n_dropped_inside"),
        )
        .select(
            "*",
            F.bround(F.try_divide(100 * F.col("n_dropped_inside"), F.col("n_dropped")), 1).alias("pct_dropped_inside"),
            F.bround(100 * F.col("n_kept") / (F.col("n_kept") + F.col("n_dropped")), 1).alias("base_rate_pct"),
        )
    )


def sigma_rule_accuracy(
    labelled: DataFrame, ks: Sequence[float] = (1.0, 1.5, 2.0, 2.5, 3.0), ts: str = "ts", keys: Keys = ()
) -> DataFrame:
    """How well 'within k standard deviations of the month' predicts the keep label."""
    rows = labelled.withColumn("month", C.month_of(ts))
    stats = rows.groupBy(*keys, "month").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    joined = key_join(rows, stats, [*keys, "month"], "inner")
    right = lambda k: F.coalesce(
        F.col("value").between(F.col("__m") - k * F.col("__s"), F.col("__m") + k * F.col("__s")), F.lit(False)
    ) == F.col("in_derived")
    wide = joined.groupBy(*keys).agg(
        F.count("*").alias("n"), *[F.count_if(right(k)).alias(f"k{i}") for i, k in enumerate(ks)]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(k)).alias("k"),
                    F.bround(100 * F.col(f"k{i}") / F.col("n"), 1).alias("accuracy_pct"),
                )
                for i, k in enumerate(ks)
            ]
        )
    )
    return wide.select(*keys, rows.alias("r")).select(*keys, "r.k", "r.accuracy_pct")
