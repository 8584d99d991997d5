"""Token-ID files: ids in document order, compressed per shard by a Re-Pair grammar that decodes at any offset."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark.llm.byte_ranks import ByteRanks

#: A shard ends with the document that brings it to so many ids.
SHARD_IDS = 1_000_000
#: Pairs replaced in one round, at most, and the least count of a pair.
PAIRS, LEAST = 2048, 2
#: Symbols between two entries of a shard's offset index.
STRIDE = 1024
#: Symbols are unsigned 16-bit: ids first, nonterminals after them.
SYMBOLS = 1 << 16
SCHEMA = (
    "part int, shard int, first bigint, n_ids bigint, base int, rules binary, lengths binary, symbols binary, offsets binary, "
    "doc_ids array<bigint>, ends array<bigint>"
)


def greedy(hit: np.ndarray) -> np.ndarray:
    """Of ascending positions, those left when each pair blocks the one that starts inside it, from the left."""
    if not len(hit):
        return hit
    begins = np.r_[True, np.diff(hit) > 1]
    run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
    return hit[(hit - hit[run]) % 2 == 0]


def frequent_pairs(key: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, ascending, whose pair is among the ``room`` most frequent ones, the place of each in the list, and the list.

    Pairs are counted by hash slot. The fullest slots stand for the pair that comes first in each, which is counted alone; what shares
    its slot waits for another round. Where they hold nothing but pairs that stand there once, all pairs are counted one by one.
    """
    slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(12)
    counts = np.bincount(slot, minlength=1 << 20)
    full = np.flatnonzero(counts >= LEAST)
    if len(full) > 2 * room:
        full = full[np.argpartition(counts[full], -2 * room)[-2 * room :]]
    of = np.full(1 << 20, -1, dtype=np.int32)
    of[full] = np.arange(len(full))
    group = of[slot]
    at = np.flatnonzero(group >= 0)
    group, own = group[at], key[at]
    pairs = np.empty(len(full), dtype=np.uint32)
    pairs[group[::-1]] = own[::-1]
    same = own == pairs[group]
    at, group = at[same], group[same]
    times = np.bincount(group, minlength=len(full))
    if not (times >= LEAST).any():
        at = np.arange(len(key))
        pairs, group, times = np.unique(key, return_inverse=True, return_counts=True)
    best = np.flatnonzero(times >= LEAST)
    best = best[np.lexsort((pairs[best], -times[best]))][:room]
    number = np.full(len(pairs), -1, dtype=np.int64)
    number[best] = np.arange(len(best))
    place = number[group]
    return at[place >= 0], place[place >= 0], pairs[best]


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs of symbols, in order of their numbers from ``base``) and the symbols that expand to the ids.

    A round counts all neighbouring pairs, takes the most frequent, and replaces them from left to right; rounds go on until no pair
    stands there LEAST times or all symbols are used. A pair that overlaps a more frequent one may be left with a single place.
    """
    sym, rules = ids.astype(np.uint16), []
    while len(sym) > 1 and (room := min(PAIRS, SYMBOLS - base - len(rules))) > 0:
        at, place, pairs = frequent_pairs(sym[:-1].astype(np.uint32) << np.uint32(16) | sym[1:], room)
        if not len(at):
            break
        picked = greedy(at)
        sym[picked] = (base + len(rules) + place[np.searchsorted(at, picked)]).astype(np.uint16)
        stay = np.ones(len(sym), dtype=bool)
        stay[picked + 1] = False
        sym = sym[stay]
        rules += [(p >> 16, p & 0xFFFF) for p in pairs.tolist()]
    return np.array(rules, dtype=np.uint16).reshape(-1, 2), sym


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each nonterminal expands to."""
    out = [1] * base
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out[base:], dtype=np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a stretch of symbols."""
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = np.empty(starts[-1], dtype=np.uint16)
    for i, (a, b) in enumerate(rules.tolist()):
        here = int(starts[i])
        for s in (a, b):
            if s < base:
                flat[here] = s
                here += 1
            else:
                n = int(lengths[s - base])
                flat[here : here + n] = flat[starts[s - base] : starts[s - base] + n]
                here += n
    rule = symbols.astype(np.int64) - base
    nested = rule >= 0
    size = np.ones(len(symbols), dtype=np.int64)
    size[nested] = lengths[rule[nested]]
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint16)
    out[(ends - size)[~nested]] = symbols[~nested]
    n = size[nested]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat((ends - size)[nested], n) + inside] = flat[np.repeat(starts[rule[nested]], n) + inside]
    return out


def pack(ids: np.ndarray, base: int) -> dict[str, object]:
    """A shard: the grammar, its expansion lengths, the symbols, and the id offset of every STRIDE-th symbol."""
    rules, symbols = compress(ids, base)
    lengths = rule_lengths(rules, base)
    sizes = np.concatenate([np.ones(base, dtype=np.int64), lengths])[symbols]
    offsets = (np.cumsum(sizes) - sizes)[::STRIDE]
    binary = lambda a, kind: a.astype(kind).tobytes()
    return {"base": base, "rules": binary(rules, "<u2"), "lengths": binary(lengths, "<u4"), "symbols": binary(symbols, "<u2"), "offsets": binary(offsets, "<u8")}


def unpack(shard: dict, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a shard; only the symbols near them are expanded."""
    rules = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2)
    lengths = np.frombuffer(shard["lengths"], "<u4").astype(np.int64)
    symbols, offsets = np.frombuffer(shard["symbols"], "<u2"), np.frombuffer(shard["offsets"], "<u8").astype(np.int64)
    if not len(offsets):
        return np.empty(0, dtype=np.uint16)
    block = max(int(np.searchsorted(offsets, start, side="right")) - 1, 0)
    last = len(offsets) if stop is None else int(np.searchsorted(offsets, stop, side="left"))
    ids = expand(symbols[block * STRIDE : last * STRIDE], rules, lengths, shard["base"])
    skip = int(offsets[block])
    return ids[start - skip : None if stop is None else stop - skip]


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteRanks:
    ranks = ByteRanks(path)
    if ranks.size > SYMBOLS - 2:
        raise ValueError("ids must fit in 16 bits")
    return ranks


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode whole texts, append ``end_id`` to each and write the ids in ascending doc_id order to ``folder``.

    Null texts are empty (only the end id). Null doc_ids come first; rows of one doc_id follow each other by a hash of the text
    and the text. Rows are range-partitioned, so a partition holds a stretch of the order and a task holds one
    shard. Each shard is one row of Parquet. An empty table writes no shard. Other columns don't matter.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        held = array("H")
        ids_of: list[int | None] = []
        ends: list[int] = []
        shard = first = 0

        def flush() -> pa.RecordBatch:
            packed = pack(np.frombuffer(held, dtype=np.uint16), enc.size)
            row = {"part": part, "shard": shard, "first": first, "n_ids": ends[-1], **packed, "doc_ids": ids_of, "ends": ends}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                for doc, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    held.fromlist(enc.encode(text or ""))
                    held.append(end_id)
                    ids_of.append(doc)
                    ends.append(len(held))
                    if ends[-1] >= shard_ids:
                        yield flush()
                        shard, first = shard + 1, first + ends[-1]
                        held, ids_of, ends = array("H"), [], []
        if held:
            yield flush()

    b, i32, i64 = pa.binary(), pa.int32(), pa.int64()
    kinds = [i32, i32, i64, i64, i32, b, b, b, b, pa.list_(i64), pa.list_(i64)]
    schema = pa.schema([(f.split()[0], k) for f, k in zip(SCHEMA.split(", "), kinds, strict=True)])
    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("h"))
    ranged = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ranged.select("doc_id", "text").mapInArrow(shards, SCHEMA).write.parquet(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids of every document in the files; ids as little-endian unsigned 32-bit integers, binary."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.slice(row, 1).to_pylist()[0]
                ids = unpack(shard)
                ends = np.array(shard["ends"], dtype=np.int64)
                starts, wide = np.r_[0, ends[:-1]], ids.astype("<u4").tobytes()
                raw = [wide[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard["doc_ids"], pa.int64()), pa.array(starts + shard["first"]), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"]
                )

    shards = spark.read.schema(SCHEMA).parquet(folder)
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    # One row for each range partition, so no more than spark.sql.shuffle.partitions rows of two numbers.
    found = shards.join(F.broadcast(base), "part").withColumn("first", F.col("first") + F.col("before")).drop("before")
    return found.mapInArrow(documents, "doc_id bigint, start bigint, ids binary")
