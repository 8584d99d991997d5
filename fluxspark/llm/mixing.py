"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark.llm.shared import attach, content_key, key_join, numbered, running_total, told_apart, word_count

#: Rows of one bucket of a source's shuffled order, and of a range of finish times until these are RANGES.
BUCKET_ROWS, RANGES = 2_000, 65_536
#: Least words of a packet, and packets of a source's target where its documents are longer.
PACKET, PACKETS = 1, 1 << 16


def source_targets(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source: n_rows, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn and share ``budget`` times all sizes. A
    target stops at ``most`` times its source's size and the excess goes to the others by weight: a common
    level L with target = min(L * weight, cap) that spends the budget.
    """
    sums = rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("weight", cycle[(F.row_number().over(order) - 1) % len(weights)]).withColumn("cap", (F.col("source_size") * most).cast("double"))
    total = ranked.agg((F.sum("source_size") * budget).alias("words"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    level = (F.col("words") - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(
        by_ratio.rowsBetween(0, Window.unboundedFollowing)
    )
    steps = attach(ranked, total).withColumn("level", level)
    spent = steps.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.max("level").alias("level"))
    full = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("weight"))
    return attach(ranked, spent).select("source", "n_rows", "source_size", "weight", full.alias("target"))


def whole_target() -> Column:
    """A source's weight in the queue: its target in whole words, null for none."""
    words = F.round("target").cast("bigint")
    return F.when(words > 0, words)


def service_times(rows: DataFrame, targets: DataFrame, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document's virtual start and finish time: its source's words before and through it, over the source's target.

    Documents of a source queue in the order of a hash of (seed, doc_id, size), then doc_id and size. A source with no
    words, or no target, has null times.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 24)
    queued = key_join(rows, targets, ["source"], "inner").withColumn("__k", key)
    parts = F.ceil(F.col("n_rows") / bucket_rows)
    queued = queued.withColumn("__b", F.floor(F.col("__k") * parts / F.lit(float(1 << 40))))
    summed = running_total(queued, "size", ["__b"], ["__k", "doc_id", "size", "uid"], ["source"])
    share = whole_target()
    return summed.select(
        *rows.columns, "source_size", "target",
        ((F.col("__cum") - F.col("size")) / share).alias("start"),
        (F.col("__cum") / share).alias("finish"),
        F.col("__cum").alias("through"),
    )


def packets(timed: DataFrame, most: int) -> DataFrame:
    """The queues as packets: uid, doc_id, source, repeat, words, finish. A queue is passed ``most`` times; a repeat's times lie source_size / target later.

    A document longer than its source's packet (the target over PACKETS, PACKET words at least) is served in several, each with
    its own finish time, so that the cut leaves no source far from its target. Rows grow by PACKETS a source at most.
    """
    copies = timed.filter("size > 0 and finish is not null").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    length = F.greatest(F.lit(PACKET), F.floor(F.col("target") / PACKETS)).cast("bigint")
    cut = copies.withColumn("__l", length).withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("size") / F.col("__l")))))
    end = F.least(F.col("__i") * F.col("__l"), F.col("size"))
    served = F.col("repeat") * F.col("source_size") + F.col("through") - F.col("size") + end
    return cut.select("uid", "doc_id", "source", "repeat", (end - (F.col("__i") - 1) * F.col("__l")).alias("words"), (served / whole_target()).alias("finish"))


def mix(rows: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents with their service times.

    ``rows``: uid, doc_id, source, size. The packets of all sources are ordered by finish time over the whole cluster; the mix takes them
    until their words reach the total budget, the last one in part. Weights are the targets in whole words, which sum to the budget, so each
    source has had its target by then, but for a packet.

    Mix: uid, repeat (from 0), finish (of the last packet taken), words. No rows, or no words: an empty mix. Equal rows queue one after the other.
    """
    targets = source_targets(rows, weights, budget, most)
    timed = service_times(rows, targets, seed)
    queued = packets(timed, most)
    size = targets.agg(F.sum(F.col("n_rows") + F.least(F.lit(PACKETS), "target")).alias("rows"), F.max(most * F.col("source_size") / whole_target()).alias("end"), F.sum(whole_target()).alias("budget"))
    # Ranges of finish time hold about as many packets each, since the queues are shuffled.
    ranges = F.least(F.lit(RANGES), F.ceil(most * F.col("rows") / BUCKET_ROWS))
    placed = attach(queued, size).withColumn("__b", F.floor(F.col("finish") / F.col("end") * ranges).cast("int"))
    total = running_total(placed, "words", ["__b"], ["finish", "source", "doc_id", "words", "uid", "repeat"])
    left = F.least(F.col("words"), F.col("budget") - (F.col("__cum") - F.col("words")))
    taken = total.withColumn("words", left).filter("words > 0").groupBy("uid", "repeat").agg(F.max("finish").alias("finish"), F.sum("words").alias("words"))
    return taken, timed


def slim(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """uid, doc_id, source, size of every document. Size: words of the text (null: 0)."""
    picked = docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"))
    return numbered(picked, "mix-sizes", "uid")


def mixed_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted).

    Empty and null texts have size 0 and nothing is taken. Null and repeated doc_ids are rows of their own. Other
    columns don't matter. An empty table gives no rows.
    """
    taken, timed = mix(slim(docs), **options)
    per_row = taken.groupBy("uid").agg(F.sum("words").alias("taken"))
    joined = timed.join(per_row, "uid", "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with the columns they had, a repeated one twice, range-sorted by finish time.

    A copy that the cut leaves less than half of is left out, one with at least half is kept whole.
    """
    same = ["doc_id", "source", "text"]
    sizes = docs.select(content_key(*map(F.col, same)).alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows = numbered(sizes, "mix-sizes", "uid")
    taken, timed = mix(rows.select("uid", "doc_id", "source", "size"), **options)
    whole = taken.join(rows.select("uid", "key", "size"), "uid").filter("2 * words >= size")
    # Documents of one key are the same to the mix: the n-th of them takes the times of the n-th such row.
    times = whole.groupBy("key", "uid").agg(F.collect_list("finish").alias("finish")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("uid", "finish"))).alias("times"))
    served = told_apart(docs, *same).join(times, "key").select("row", F.get("times", F.col("copy") - 1).alias("t")).select("row", "t.uid", F.explode("t.finish").alias("finish"))
    return served.repartitionByRange("finish", "uid").sortWithinPartitions("finish", "uid").select("row.*")
