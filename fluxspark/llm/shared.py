"""Helpers of this package: tables in the shared folder, row ids, word counts, distributed running totals, components."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark.operators.common import attach, key_join

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own on a local master."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = sc.getCheckpointDir()
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, and readable whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, uid: str = "__uid") -> DataFrame:
    """The rows with an id of their own, fixed by writing them, so that equal rows and null keys stay apart."""
    return written(df.withColumn(uid, F.monotonically_increasing_id()), name)


def content_key(*columns: Column) -> Column:
    """One key of these columns, never null; nulls are values of their own."""
    return F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])))


def told_apart(docs: DataFrame, *names: str) -> DataFrame:
    """key, row, copy: each document as a struct under the content_key of the named columns, and its number (from 1) among those of one key.

    The documents are read again where they are used, and no copy of them is written; so they should come from a table.
    """
    keyed = docs.select(F.struct("*").alias("row")).select(content_key(*[F.col(f"row.{n}") for n in names]).alias("key"), "row")
    return keyed.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("key")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def running_total(df: DataFrame, value: str, buckets: Sequence[str], order: Sequence[str], keys: Sequence[str] = (), out: str = "__cum") -> DataFrame:
    """Inclusive running sum of ``value`` per key in the order of (bucket, order).

    The caller cuts each key into buckets that ascend with the order and hold few rows. Only bucket totals
    are summed across a key; rows are summed inside their bucket, so a hot key spreads over many tasks.
    """
    totals = df.groupBy(*keys, *buckets).agg(F.sum(value).alias("__t"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, *buckets, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inner = Window.partitionBy(*keys, *buckets).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return key_join(df, base, [*keys, *buckets], "inner").withColumn(out, F.col("__base") + F.sum(value).over(inner)).drop("__base")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (a, b) links: columns node, label; the label is the least node id of the component.

    Each round lowers every label to the least among its neighbours, then follows labels once (so
    distances halve), and is written out. It ends when a round changes nothing.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-links"
    )
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        hop = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        step = written(low.join(hop, "mid").select("node", "old", F.least("mid", "far").alias("label")), name)
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


__all__ = ["WORD", "attach", "components", "content_key", "key_join", "numbered", "running_total", "shared_dir", "told_apart", "word_count", "written"]
