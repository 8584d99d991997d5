"""Building blocks shared by the operators: guards, joins on keys, exact order statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Keys = Sequence[str]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same frame, or an error that names what is missing from its schema."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the frame has {df.columns}")
    return df


def key_join(left: DataFrame, right: DataFrame, on: Keys, how: str = "left") -> DataFrame:
    """Equi-join that treats null keys as equal, as grouping does, and keeps the left key columns."""
    renamed = right.select(
        *[F.col(c).alias(f"__key_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in on])
    return left.join(renamed, condition, how).drop(*[f"__key_{c}" for c in on])


def attach(df: DataFrame, stats: DataFrame, keys: Keys = ()) -> DataFrame:
    """Put each group's summary columns beside its rows.

    With keys this is a join that Spark broadcasts or shuffles by size. Without keys the summary is
    one row, which travels as a scalar subquery.
    """
    if keys:
        return key_join(df, stats, keys, "left")
    names = [c for c in stats.columns]
    one = stats.select(F.struct(*names).alias("__s")).scalar()
    return df.withColumn("__s", one).select(*df.columns, *[F.col("__s")[c].alias(c) for c in names])


def by(*keys: str):
    """Window over the keys; with none, over a constant (summary rows only)."""
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def round6(df: DataFrame, digits: int = 6, only: Sequence[str] | None = None) -> DataFrame:
    """Round every double column, and turn negative zero into zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if f.dataType.typeName() == "double" and (only is None or f.name in only)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def shared_folder(spark: SparkSession) -> str:
    """Reliable storage that the cluster names in spark.checkpoint.dir; on a local master without it, a folder of its own."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # one machine: driver and executor share it
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage the cluster names, so a lost executor costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _rank_of(p: float) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    low = lambda n: F.floor((n - 1) * F.lit(p)).cast("bigint") + 1
    high = lambda n: F.ceil((n - 1) * F.lit(p)).cast("bigint") + 1
    return low, high


def order_statistics(
    df: DataFrame,
    value: str,
    targets: Sequence[tuple[str, float, Callable[[Column], Column]]],
    keys: Keys = (),
    accuracy: int = 10_000,
    count: str | None = None,
) -> DataFrame:
    """Values at exact ranks, per key, without ever sorting a whole group in one task.

    Each target is (name, share of the group near the rank, rank as a function of the count). A sketch
    brackets the rank. Rows outside the bracket fold into one counted row on either side, rows
    inside it into one row per distinct value, all before the shuffle's final step. Only these counts
    are ordered, so a group or a single value may hold any share of the data.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    slack = 3.0 / accuracy
    edges = [max(0.0, s - slack) for _, s, _ in targets] + [min(1.0, s + slack) for _, s, _ in targets]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("__v", edges, accuracy).alias("__e"), F.count("*").alias("__n")
    )
    m = len(targets)
    side = lambda i: (
        F.when(F.col("__v") < F.col("__e")[i], -1).when(F.col("__v") > F.col("__e")[i + m], 1).otherwise(0)
    )
    spread = attach(rows, sketch, keys).select(
        *keys,
        "__v",
        "__n",
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), side(i).alias("s")) for i in range(m)])).alias("__t"),
    )
    inside = F.when(F.col("__t.s") == 0, F.col("__v"))
    folded = (
        spread.groupBy(*keys, F.col("__t.i").alias("__i"), F.col("__t.s").alias("__s"), inside.alias("__d"))
        .agg(
            F.count("*").alias("__c"),
            F.max("__n").alias("__n"),
            F.when(F.first("__t.s") < 0, F.max("__v")).otherwise(F.min("__v")).alias("__x"),
        )
    )
    w = Window.partitionBy(*keys, "__i").orderBy("__s", "__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = folded.withColumn("__through", F.sum("__c").over(w)).withColumn(
        "__before", F.col("__through") - F.col("__c")
    )

    def pick(i: int, rank) -> Column:
        r = rank(F.col("__n"))
        hit = (F.col("__i") == i) & (F.col("__before") < r) & (r <= F.col("__through"))
        known = (
            (F.col("__s") == 0)
            | ((F.col("__s") < 0) & (r == F.col("__through")))
            | ((F.col("__s") > 0) & (r == F.col("__before") + 1))
        )
        missed = F.raise_error(F.lit("order statistic fell outside its bracket")).cast("double")
        return F.max(F.when(hit, F.when(known, F.col("__x")).otherwise(missed)))

    size = [F.max("__n").alias(count)] if count else []
    return ranked.groupBy(*keys).agg(*[pick(i, rank).alias(name) for i, (name, _, rank) in enumerate(targets)], *size)


def quantile_targets(probs: dict[str, float]) -> list:
    """Order statistics that linear interpolation of the named quantiles needs."""
    targets = []
    for name, p in probs.items():
        low, high = _rank_of(p)
        targets += [(f"__{name}_lo", p, low), (f"__{name}_hi", p, high)]
    return targets


def interpolated(name: str, p: float, n: Column) -> Column:
    h = (n - 1) * F.lit(p)
    lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
    return (lo + (hi - lo) * (h - F.floor(h))).alias(name)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Keys = (), accuracy: int = 10_000
) -> DataFrame:
    """Linearly interpolated quantiles, exact, one column per named probability. Two passes in all."""
    stats = order_statistics(df, value, quantile_targets(probs), keys, accuracy, "__cnt")
    return stats.select(*keys, *[interpolated(name, p, F.col("__cnt")) for name, p in probs.items()])


def cumulative_counts(df: DataFrame, value: str, keys: Keys = (), buckets: int = 256) -> DataFrame:
    """Per distinct value its count, and the count of rows up to and including it.

    Values are cut into buckets of near equal weight, ordered inside each bucket, and shifted by the
    bucket totals, so the running count of one group is spread over many tasks.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    cuts = [i / buckets for i in range(1, buckets)]
    splits = rows.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("__v", cuts, buckets * 20)).alias("__cuts")
    )
    counts = rows.groupBy(*keys, "__v").agg(F.count("*").alias("n_at"))
    placed = attach(counts, splits, keys).withColumn(
        "__b", F.size(F.filter("__cuts", lambda s: s < F.col("__v")))
    )
    totals = placed.groupBy(*keys, "__b").agg(F.sum("n_at").alias("__t"))
    before = by(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__off", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inner = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        key_join(placed.drop("__cuts"), totals, [*keys, "__b"], "inner")
        .withColumn("n_through", F.sum("n_at").over(inner) + F.col("__off"))
        .select(*keys, F.col("__v").alias(value), "n_at", "n_through")
    )


def stack_rows(label: str, rows: dict[str, dict[str, Column]]) -> Column:
    """Explode one wide row into labelled rows: label -> {column: expression}."""
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias(label), *[e.alias(c) for c, e in values.items()])
                for name, values in rows.items()
            ]
        )
    )
