"""Whether target months lie where the fit months are: ranges, runs, joint distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark.functions import columns as C
from fluxspark.operators.common import Keys, attach, by, key_join
from fluxspark.operators.months import month_islands



def _roles(
    covariates: DataFrame, fit: DataFrame, target: DataFrame, columns: Sequence[str], keys: Keys
) -> DataFrame:
    """Long covariate rows of the fit and target months, flagged __f and __t."""
    on = [*keys, "month"]
    mark = lambda df, c: df.select(*on).distinct().withColumn(c, F.lit(True))
    flagged = key_join(key_join(covariates, mark(fit, "__f"), on), mark(target, "__t"), on)
    flagged = flagged.filter("__f or __t")
    return flagged.unpivot([*on, "__f", "__t"], list(columns), "covariate", "value").filter("value is not null")


def _with_bounds(rows: DataFrame, on: Keys) -> DataFrame:
    v = F.when(F.col("__f"), F.col("value"))
    return attach(rows, rows.groupBy(*on).agg(F.min(v).alias("fit_min"), F.max(v).alias("fit_max")), on)


def distribution_comparison(
    covariates: DataFrame, fit: DataFrame, target: DataFrame, columns: Sequence[str], keys: Keys = ()
) -> DataFrame:
    """Range and centre of each covariate over both month sets, and how much lies outside."""
    on = [*keys, "covariate"]
    rows = _with_bounds(_roles(covariates, fit, target, columns, keys), on)
    f, t = F.when(F.col("__f"), F.col("value")), F.when(F.col("__t"), F.col("value"))
    below, above = F.count_if(t < F.col("fit_min")), F.count_if(t > F.col("fit_max"))
    return rows.groupBy(*on).agg(
        F.max("fit_min").alias("fit_min"),
        F.max("fit_max").alias("fit_max"),
        F.avg(f).alias("fit_mean"),
        F.min(t).alias("target_min"),
        F.max(t).alias("target_max"),
        F.avg(t).alias("target_mean"),
        (F.avg(t) - F.avg(f)).alias("mean_shift"),
        below.alias("n_below"),
        above.alias("n_above"),
        (below + above).alias("n_outside"),
        F.bround(F.try_divide(100 * (below + above), F.count(t)), 1).alias("pct_outside"),
    )


def out_of_range_months(
    covariates: DataFrame, fit: DataFrame, target: DataFrame, columns: Sequence[str], keys: Keys = ()
) -> DataFrame:
    """Every target month and covariate outside the fit range, with direction and excess."""
    on = [*keys, "covariate"]
    rows = _with_bounds(_roles(covariates, fit, target, columns, keys), on).filter("__t")
    direction = C.out_of_range("value", "fit_min", "fit_max")
    excess = F.greatest(F.col("fit_min") - F.col("value"), F.col("value") - F.col("fit_max"))
    return rows.select(
        *keys, "month", "covariate", "value", direction.alias("direction"), "fit_min", "fit_max", excess.alias("excess")
    ).filter("direction is not null")


def months_any_outside(outside: DataFrame, target: DataFrame, keys: Keys = ()) -> DataFrame:
    """Target months with any covariate outside, as a count and a share."""
    on = [*keys, "month"]
    hit = outside.select(*on).distinct().withColumn("__x", F.lit(1))
    return key_join(target.select(*on).distinct(), hit, on).groupBy(*keys).agg(
        F.count("__x").alias("n_months_any_outside"),
        F.bround(100 * F.count("__x") / F.count("*"), 1).alias("pct_of_target"),
    )


def out_of_range_runs(outside: DataFrame, keys: Keys = ()) -> DataFrame:
    """Contiguous stretches per covariate. The first month gives the direction; a change does not split."""
    on = [*keys, "covariate"]
    return (
        month_islands(outside, on)
        .groupBy(*on, "island")
        .agg(
            F.min("month").alias("first"),
            F.max("month").alias("last"),
            F.count("*").alias("n_months"),
            F.min_by("direction", "month").alias("direction"),
            F.bround(F.max("excess"), 3).alias("max_excess"),
        )
        .drop("island")
    )


def nearest_distance(
    points: DataFrame,
    reference: DataFrame,
    columns: Sequence[str],
    exclude_self: bool = False,
    id_column: str = "month",
    keys: Keys = (),
    tile_rows: int = 4096,
    strict: bool = True,
) -> DataFrame:
    """Distance of each point to its nearest reference row, on the reference's mean and deviation.

    Columns that do not vary in the reference are left out; if none varies the job stops, or, unless
    ``strict``, the distances of that key are null. So they are for a key without reference rows. The work is points
    times reference rows, meant for a reference of months. Reference rows
    travel in tiles of bounded size (a monthly reference is one tile). Every point scans its tiles'
    arrays in place and keeps the least distance of each, so no pair of rows is ever written out.
    """
    columns = list(columns)
    ref = reference.dropna(subset=columns)
    pts = points.dropna(subset=columns)
    stats = ref.groupBy(*keys).agg(
        F.count("*").alias("__n"),
        F.array(*[F.avg(c) for c in columns]).alias("__c"),
        F.array(*[F.when(F.stddev_samp(c) > 0, 1 / F.stddev_samp(c)) for c in columns]).alias("__k"),
    )
    nothing = F.raise_error(F.lit("no column varies over the reference")).cast("array<double>")
    varies = F.exists("__k", lambda k: k.isNotNull())
    stats = stats.withColumn("__k", F.when(varies, F.col("__k")).otherwise(nothing if strict else F.lit(None)))
    z = F.array(
        *[
            (F.col(c) - F.col("__c")[i]) * F.when(F.col("__k").isNotNull(), F.coalesce(F.col("__k")[i], F.lit(0.0)))
            for i, c in enumerate(columns)
        ]
    )
    tile = F.pmod(F.xxhash64(id_column), F.ceil(F.col("__n") / tile_rows)).cast("int")
    tiles = (
        attach(ref, stats, keys)
        .select(*keys, tile.alias("__tile"), F.struct(F.col(id_column).alias("id"), z.alias("z")).alias("__r"))
        .groupBy(*keys, "__tile")
        .agg(F.collect_list("__r").alias("__rows"))
    )
    placed = attach(pts, stats, keys).select(*keys, id_column, z.alias("__z"))
    if keys:
        met = key_join(placed, tiles, keys, "left")
    else:
        # One reference for all points: its tiles are copied to every salt, so the points stay spread out.
        salts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int")
        copies = tiles.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = placed.withColumn("__salt", salt).join(copies, "__salt", "left").drop("__salt")
    square = lambda r: sum(
        ((F.col("__z")[i] - r["z"][i]) * (F.col("__z")[i] - r["z"][i]) for i in range(1, len(columns))),
        (F.col("__z")[0] - r["z"][0]) * (F.col("__z")[0] - r["z"][0]),
    )
    other = (lambda r: F.when(r["id"] != F.col(id_column), square(r))) if exclude_self else square
    return (
        met.withColumn("__d", F.array_min(F.transform("__rows", other)))
        .groupBy(*keys, id_column)
        .agg(F.sqrt(F.min("__d")).alias("distance"))
    )


def joint_support(
    covariates: DataFrame, fit: DataFrame, target: DataFrame, columns: Sequence[str], keys: Keys = ()
) -> DataFrame:
    """Distances among the fit months, and from the target months to them: two rows per key."""
    on = [*keys, "month"]
    f = key_join(covariates, fit.select(*on).distinct(), on, "left_semi")
    t = key_join(covariates, target.select(*on).distinct(), on, "left_semi")
    own = nearest_distance(f, f, columns, True, keys=keys).withColumn("group", F.lit("fit"))
    far = nearest_distance(t, f, columns, False, keys=keys).withColumn("group", F.lit("target"))
    q = lambda p: F.percentile("distance", F.lit(p))
    limit = own.groupBy(*keys).agg(q(0.95).alias("__limit"))
    both = attach(own.unionByName(far), limit, keys)
    return both.groupBy(*keys, "group").agg(
        F.count("*").alias("n"),
        q(0.5).alias("median"),
        q(0.95).alias("p95"),
        F.max("distance").alias("max"),
        F.count_if((F.col("group") == "target") & (F.col("distance") > F.col("__limit"))).alias("n_beyond_fit_p95"),
    )


def year_support(
    covariates: DataFrame, fit: DataFrame, target: DataFrame, columns: Sequence[str], keys: Keys = ()
) -> DataFrame:
    """Per year: months outside the fit range, which covariates, joint distance, verdict."""
    on = [*keys, "month"]
    months = target.select(*on).distinct()
    outside = (
        out_of_range_months(covariates, fit, target, columns, keys)
        .groupBy(*on)
        .agg(F.collect_set("covariate").alias("__covs"))
    )
    f = key_join(covariates, fit.select(*on).distinct(), on, "left_semi")
    t = key_join(covariates, months, on, "left_semi")
    rows = key_join(key_join(months, outside, on), nearest_distance(t, f, columns, keys=keys), on)
    n_out = F.count("__covs")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("__covs"))))
    return rows.groupBy(*keys, F.year("month").alias("year")).agg(
        F.count("*").alias("n_months"),
        n_out.alias("n_months_outside_range"),
        F.bround(100 * n_out / F.count("*"), 0).alias("pct_months_outside"),
        F.array_join(names, ", ").alias("covariates_outside"),
        F.bround(F.percentile("distance", F.lit(0.5)), 3).alias("joint_distance_median"),
        F.bround(F.max("distance"), 3).alias("joint_distance_max"),
        F.when(n_out > 0, "outside").otherwise("inside").alias("support"),
    )


def support_classes(
    series: DataFrame,
    column: str,
    fit: DataFrame,
    removed: Sequence[str] = (),
    keys: Keys = (),
) -> DataFrame:
    """Each grid month as within, above or below the fitted range, missing, or removed.

    The range is taken from the very rows it is compared with, since means that are computed again may differ in their last digits.
    """
    from fluxspark.operators.reshape import regrid

    on = [*keys, "month"]
    gone = F.col("month").isin(*[F.lit(m).cast("date") for m in removed]) if removed else F.lit(False)
    marks = fit.select(*on).distinct().withColumn("__fit", F.lit(True))
    grid = key_join(regrid(series.select(*on, column), keys), marks, on)
    used = F.when(F.col("__fit") & ~gone, F.col(column))
    bounded = grid.withColumns({"fit_min": F.min(used).over(by(*keys)), "fit_max": F.max(used).over(by(*keys))}).drop("__fit")
    status = (
        F.when(gone, "removed")
        .when(F.col(column).isNull(), "missing")
        .otherwise(F.coalesce(C.out_of_range(column, "fit_min", "fit_max"), F.lit("within")))
    )
    return bounded.withColumn("support", status)


def holdout_covariate_contrast(
    covariates: DataFrame, train: DataFrame, test: DataFrame, columns: Sequence[str], keys: Keys = ()
) -> DataFrame:
    """How far each covariate of the held-out months leaves the training range."""
    t = distribution_comparison(covariates, train, test, columns, keys)
    return t.select(
        *keys,
        "covariate",
        *[F.bround(c, 3).alias(a) for c, a in (
            ("fit_min", "train_min"), ("fit_max", "train_max"), ("target_min", "holdout_min"), ("target_max", "holdout_max"))],
        F.col("n_outside").alias("n_holdout_outside"),
        F.col("pct_outside").alias("pct_holdout_outside"),
    )


def analogue_strength(
    covariates: DataFrame, fit: DataFrame, target: DataFrame, splits: DataFrame, column: str, keys: Keys = ()
) -> DataFrame:
    """How far each holdout extrapolates, against how far the target months do."""
    on = [*keys, "month"]
    values = covariates.select(*on, F.col(column).alias("__v")).filter("__v is not null")
    f = key_join(values, fit.select(*on).distinct(), on, "left_semi")
    t = key_join(values, target.select(*on).distinct(), on, "left_semi")
    span = lambda df, a: df.groupBy(*keys).agg(F.min("__v").alias(f"__{a}lo"), F.max("__v").alias(f"__{a}hi"))
    goal = attach(span(f, "f"), span(t, "t"), keys).select(
        *keys,
        F.greatest(
            F.col("__thi") - F.col("__fhi"), F.col("__flo") - F.col("__tlo"), F.lit(0.0)
        ).alias("__goal"),
    )
    # Each fit month meets each split name of its key once, held out there or not.
    names = splits.select(*keys, "split").distinct().groupBy(*keys).agg(F.collect_set("split").alias("__names"))
    spread = attach(f, names, keys).withColumn("split", F.explode("__names")).drop("__names")
    held = splits.select(*keys, "split", "month").withColumn("__h", F.lit(True))
    rows = key_join(spread, held, [*keys, "split", "month"])
    train, test = F.when(F.col("__h").isNull(), F.col("__v")), F.when(F.col("__h"), F.col("__v"))
    per = rows.groupBy(*keys, "split").agg(
        (F.max(train) - F.min(train)).alias("__range"),
        F.greatest(F.max(test) - F.max(train), F.min(train) - F.min(test), F.lit(0.0)).alias("__excess"),
    )
    return attach(per, goal, keys).select(
        *keys,
        "split",
        F.bround("__range", 3).alias("train_range"),
        F.bround("__excess", 3).alias("max_excess"),
        F.bround("__goal", 3).alias("target_max_excess"),
        F.when(F.col("__goal") > 0, F.bround(F.col("__excess") / F.col("__goal"), 2)).alias("share_of_target_excess"),
    )


