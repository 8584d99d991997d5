"""N-gram Jaccard join: MinHash bands, Bayesian pruning of pairs by incremental comparison, exact verification."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark.llm.shared import components, written

#: Words of a shingle and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: Bands of MinHash values and values of a band. A pair at 0.8 shares no band with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: A pair is dropped when its chance of reaching the similarity is under this; checked after every STEP values.
TOLERANCE, STEP = 1e-7, 20
#: Documents that meet in one task: two blocks of this many, on average. Pairs compared at once.
BLOCK, PAIRS = 256, 1 << 17
HASHES = BANDS * ROWS
_WORD = re.compile(r"[^ \t-\r]+")
_K, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingles(text: str, hashes: dict[str, int], size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all windows of ``size`` words; of all words where there are fewer; none of no word."""
    words = _WORD.findall(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _K
        out ^= out >> np.uint64(32)
    out *= _M
    out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    a, b, c = (rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) for _ in range(3))
    return a | np.uint32(1), b, c | np.uint32(1)


def minhash(sh: np.ndarray) -> np.ndarray:
    """HASHES least values of the shingles under as many permutations of 32-bit numbers."""
    a, b, c = permutations()
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    low = (sh >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), 2048):
        v = low[at : at + 2048, None] * a + b
        v ^= v >> np.uint32(15)
        v *= c
        np.minimum(least, v.min(axis=0), out=least)
    return least


@lru_cache(maxsize=8)
def least_matches(similarity: float, tolerance: float) -> np.ndarray:
    """By number n of compared values: the fewest matches at which P(J >= similarity | matches) reaches the tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), so that chance is P(Binomial(n + 1, similarity) <= m).
    """
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if chance >= tolerance:
                out[n] = m
                break
    return out


def inner_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of rows in the same one of consecutive groups of these sizes."""
    starts, pairs = np.cumsum(sizes) - sizes, [np.empty((2, 0), dtype=np.int64)]
    for m in np.unique(sizes):
        first = starts[sizes == m][:, None]
        pairs.append(np.stack([(first + x).ravel() for x in np.triu_indices(m, 1)]))
    i, j = np.concatenate(pairs, axis=1)
    return i, j


def prune(
    sig: np.ndarray, n: np.ndarray, similarity: float = SIMILARITY, tolerance: float = TOLERANCE, sizes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) that are left after every step: of all rows, or inside consecutive groups of these sizes. Sizes too unequal for the similarity go first."""
    i, j = inner_pairs(np.array([len(n)]) if sizes is None else sizes)
    fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
    i, j = i[fits], j[fits]
    need, matches = least_matches(similarity, tolerance), np.zeros(len(i), dtype=np.int64)
    for at in range(0, HASHES, STEP):
        matches += (sig[i, at : at + STEP] == sig[j, at : at + STEP]).sum(axis=1)
        alive = matches >= need[min(at + STEP, HASHES)]
        i, j, matches = i[alive], j[alive], matches[alive]
    return i, j


def roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least member of each row's component."""
    up = np.arange(size)
    while True:
        low = up.copy()
        np.minimum.at(low, i, up[j])
        np.minimum.at(low, j, up[i])
        low = low[low]
        if (low == up).all():
            return up
        up = low


def signatures(docs: DataFrame) -> DataFrame:
    """uid, doc_id, tkey, key, n, sig of every row: digest of the text, digest of its shingle set, set size, MinHash values.

    Texts without a word have a null key.
    """

    def sign(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = _Hashes()
        for texts in batches:
            keys, sizes, sigs = [], [], []
            for t in texts:
                sh = shingles(t.as_py() or "", hashes)
                keys.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                sizes.append(len(sh))
                sigs.append(minhash(sh).tobytes() if len(sh) else None)
            yield pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["key", "n", "sig"])

    udf = F.arrow_udf(sign, "struct<key:binary,n:bigint,sig:binary>")
    rows = docs.select("uid", "doc_id", F.md5("text").alias("tkey"), udf(F.col("text")).alias("s"))
    return written(rows.select("uid", "doc_id", "tkey", "s.*"), "jaccard-rows")


def candidate_links(classes: DataFrame) -> DataFrame:
    """(a, b) links that connect every pair of classes which shares a band and outlives the pruning.

    Members of a band's bucket meet in units of one or two blocks; buckets with the same members are one unit. A unit of
    one block gives a link from each member to the least member it hangs together with; a unit of two blocks
    only joins what hangs together inside either. So a bucket emits about a link a member, not its pairs.
    """
    band = lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (ROWS * 4) + 1, F.lit(ROWS * 4)))
    banded = classes.select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    members = banded.join(shared, "bucket").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    blocks = members.groupBy("bucket", "parts", "part").agg(F.array_sort(F.collect_list("cid")).alias("ids"))
    alone = blocks.filter("parts = 1").select("ids").distinct().select(F.xxhash64("ids").alias("unit"), F.lit(0).alias("side"), F.explode("ids").alias("cid"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = blocks.filter("parts > 1").select("bucket", "part", "ids", other)
    met = met.select(
        F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("unit"), (F.col("part") > F.col("other")).cast("int").alias("side"), F.explode("ids").alias("cid")
    )
    units = alone.unionByName(met).join(classes.select("cid", "n", "sig"), "cid")

    def survivors(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["unit", "cid"]).sort_values(["unit", "cid"], ignore_index=True)
        _, sizes = np.unique(rows["unit"].to_numpy(), return_counts=True)
        n, cid, side = (rows[c].to_numpy() for c in ("n", "cid", "side"))
        sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(len(rows), HASHES)
        # Units meet in runs of about PAIRS pairs; a larger unit is a run of its own.
        run, ends, links = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS, np.cumsum(sizes), []
        for r in np.unique(run):
            own = sizes[run == r]
            cut = slice(ends[run == r][0] - own[0], ends[run == r][-1])
            i, j = prune(sig[cut], n[cut], sizes=own)
            every = np.arange(own.sum())
            up, half = roots(len(every), i, j), side[cut]
            linked = up != every
            same = half[i] == half[j]
            two = np.repeat(np.maximum.reduceat(half, np.cumsum(own) - own), own) > 0
            linked &= ~two | (roots(len(every), i[same], j[same]) == every)  # links inside a block come from its own unit
            links.append(np.stack([cid[cut][linked], cid[cut][up[linked]]]))
        a, b = np.concatenate(links, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    def by_unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for frame in frames:
            if len(frame):
                rows = pd.concat([*rest, frame], ignore_index=True)
                open_ = rows["unit"] == rows["unit"].iloc[-1]
                if not open_.all():
                    yield survivors(rows[~open_])
                rest = [rows[open_]]
        if rest:
            yield survivors(rest[0])

    # Most units are pairs: many go through Python at once, in place of a call each.
    return units.repartition("unit").sortWithinPartitions("unit").mapInPandas(by_unit, "a bigint, b bigint")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    values, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    shared = times > 1
    column = (np.cumsum(shared) - 1)[back]
    keep = shared[back]
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    width = max(64, 4_000_000 // len(sets))
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[row[lo:hi], column[lo:hi] - at] = 1
        out += dense @ dense.T
    return np.rint(out).astype(np.int64)


def verified(involved: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """cid, links, root for each unit a class is in: documents linked to it there, and the least class it hangs together with.

    ``involved``: cid, label (of its candidate component), copies, shingles. Components larger than a block are split, and
    every two blocks meet once.
    """
    share = Fraction(similarity).limit_denominator(1000)
    p, q = share.numerator, share.denominator
    parts = involved.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = involved.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    met = placed.select("label", "cid", "copies", "shingles", "part", other)
    met = met.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))

    def check(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid", ignore_index=True)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
        n, part = np.array(list(map(len, sets))), group["part"].to_numpy()
        both = intersections(sets)
        linked = (p + q) * both >= p * (n[:, None] + n[None, :])
        if group["lo"].iloc[0] != group["hi"].iloc[0]:
            linked &= part[:, None] != part[None, :]
        np.fill_diagonal(linked, False)
        i, j = np.nonzero(np.triu(linked))
        cid = group["cid"].to_numpy()
        return pd.DataFrame({"cid": cid, "links": linked @ group["copies"].to_numpy(), "root": cid[roots(len(cid), i, j)]})

    return met.groupBy("label", "lo", "hi").applyInPandas(check, "cid bigint, links bigint, root bigint")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, shingles (sorted 64-bit hashes) of the classes in ``wanted`` (cid, tkey), from one text each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                found = [shingles(t.as_py() or "", hashes).tobytes() for t in b["text"]]
                yield pa.RecordBatch.from_arrays([b["cid"], pa.array(found, pa.binary())], names=["cid", "shingles"])

    texts = docs.select("doc_id", F.md5("text").alias("tkey"), "text")
    asked = wanted.select("cid", "tkey", F.col("rep").alias("__rep"))
    # The asked for are a share of all texts, so this is a shuffle at any size.
    one = texts.hint("merge").join(asked, "tkey").filter(F.col("doc_id").eqNullSafe(F.col("__rep"))).select("cid", "text")
    return one.mapInArrow(sets, "cid bigint, shingles binary").groupBy("cid").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (uid, doc_id, text): uid, doc_id, class_id, n_links, n_copies, kept, tkey (MD5 of the text).

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least ``similarity``; n_links
    counts the documents linked to this one. class_id is the least doc_id of those it is linked to, directly or not.
    Documents with one and the same shingle set (n_copies) form a class, and only classes are compared. kept marks one
    row of each group: the least doc_id, nulls last, then the least uid. Documents with fewer than five words
    have one shingle, all words; documents with none (null text too) are linked to nothing and kept. Empty table: no rows.

    Links are lost only where MinHash misses them (3e-6 at 0.8, far less above) or the pruning does (TOLERANCE a step).
    """
    if similarity < SIMILARITY:
        raise ValueError(f"the bands are laid out for similarities from {SIMILARITY}")
    rows = signatures(docs)
    grouped = rows.filter("key is not null").groupBy("key").agg(
        F.min(F.struct("doc_id", "tkey")).alias("r"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    classes = written(grouped.select(F.monotonically_increasing_id().alias("cid"), "key", F.col("r.doc_id").alias("rep"), F.col("r.tkey").alias("tkey"), "copies", "n", "sig"), "jaccard-classes")
    labels = components(candidate_links(classes), "jaccard-candidates")
    involved = written(classes.select("cid", "rep", "tkey", "copies").join(labels.withColumnRenamed("node", "cid"), "cid"), "jaccard-involved")
    sets = shingle_sets(docs, involved)
    checked = written(verified(involved.select("cid", "label", "copies").join(sets, "cid"), similarity), "jaccard-verified")
    groups = components(checked.select(F.col("cid").alias("a"), F.col("root").alias("b")), "jaccard-groups")
    links = checked.groupBy(F.col("cid").alias("__cid")).agg(F.sum("links").alias("links"))
    named = classes.select("cid", "key", "copies")
    named = named.join(links, named["cid"] == links["__cid"], "left").join(groups.withColumnRenamed("node", "__node"), F.col("cid") == F.col("__node"), "left")
    named = named.select("key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "cid").alias("group"))
    # A row without words is a group of its own, under a number that no class has.
    placed = rows.select("uid", "doc_id", "tkey", "key").join(named, "key", "left").withColumn("group", F.coalesce("group", -1 - F.col("uid")))
    firsts = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first"))
    return placed.join(firsts, "group").select(
        "uid", "doc_id", F.col("first.doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), (F.col("uid") == F.col("first.uid")).alias("kept"), "tkey",
    )
