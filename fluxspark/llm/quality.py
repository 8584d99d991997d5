"""Quality rules: text measures, and an n-gram log-likelihood ratio of trusted text against the raw corpus."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: N-grams dealt to a range of hashes: 2**BITS, so ranges grow in number with the corpus. A range has 2**32 hashes.
BITS = 22
#: Ranges at least.
LEAST_RANGES = 64
#: Shares in which a block's n-grams are put in order, one at a time.
PASSES = 8
#: Added to each n-gram's count in both multinomials.
SMOOTHING = 3.0
#: Mean log-likelihood ratio in nats per n-gram under which a document goes.
LEAST_RATIO = -0.3
#: Labelled good documents that the trusted multinomial is fitted on, at most.
TRUSTED_DOCS = 16_384
SYMBOLS = "#*$%&|<>"
#: A word for both Python and Spark.
WORD = r"[^ \t-\r]+"
_WORD = re.compile(WORD)
_BLANK = " \t\n\v\f\r"
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


class _Hashes(dict):
    """64-bit hashes of lower-case words, each computed once; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        low = word.lower().encode("utf-8", "surrogatepass")
        self[word] = h = int.from_bytes(hashlib.blake2b(low, digest_size=8).digest(), "little")
        return h


def gram_hashes(words: list[str], hashes: dict[str, int]) -> np.ndarray:
    """64-bit hashes of all words and of all pairs of neighbours."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    pairs = h[:-1] * _M1 + (h[1:] ^ _M3) * _M2
    mixed = np.concatenate([h, pairs])
    mixed ^= mixed >> np.uint64(29)
    mixed *= _M1
    mixed ^= mixed >> np.uint64(32)
    return mixed * _M2


def repeat_words(words: list[str]) -> int:
    """Words that lie in a window of five found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, through = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + 5 - max(i, through)
            through = i + 5
    return covered


def measures(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def log_ratios(target: np.ndarray, raw: np.ndarray, own: np.ndarray, trusted: float, rest: np.ndarray | float) -> np.ndarray:
    """log(p_target / p_raw) of n-grams with these counts, a text's own counts left out of the raw corpus.

    The target's smoothing is the raw one scaled to its size, so n-grams seen nowhere else count 0.
    """
    return np.log(target + SMOOTHING * trusted / rest) - np.log(np.maximum(raw - own, 0) + SMOOTHING) - np.log(trusted / rest)


def mean_ratio(buckets: np.ndarray, both: np.ndarray, sums: np.ndarray) -> float:
    """Mean of log_ratios over one text's n-grams, target and raw counts given as an array by n-gram."""
    if not len(buckets) or not sums[0]:
        return 0.0
    b, own = np.unique(buckets, return_counts=True)
    rest = max(sums[1] - len(buckets), 1.0)
    return float(own @ log_ratios(both[0][b], both[1][b], own, sums[0], rest) / len(buckets))


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers of four bytes, compressed by byte position."""
    return len(x).to_bytes(4, "little") + pa.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(pack: bytes, kind: str = "<u4") -> np.ndarray:
    """The array of packed_numbers."""
    n = int.from_bytes(pack[:4], "little")
    return np.frombuffer(pa.decompress(pack[4:], 4 * n, "zstd"), np.uint8).reshape(4, n).T.copy().view(kind).ravel()


def numbers(packs: pa.ChunkedArray, kind: str = "<u4") -> list[np.ndarray]:
    """The arrays of many packed_numbers."""
    return [unpacked(p, kind) for p in packs.to_pylist()]


def by_rank(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, repeated ones first and by falling count; the place of each key among them from 1, 0 if not repeated."""
    u, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    many = np.flatnonzero(times > 1)
    many = many[np.argsort(-times[many], kind="stable")]
    place = np.zeros(len(u), "<u4")
    place[many] = np.arange(1, len(many) + 1)
    places = place[at]
    return np.concatenate([u[many], keys[places == 0]]), places


def positions(places: np.ndarray, distinct: int) -> np.ndarray:
    """Each key's position among the distinct keys of by_rank."""
    out, once = places.astype(np.int64) - 1, np.flatnonzero(places == 0)
    out[once] = np.arange(distinct - len(once), distinct)
    return out


def climbs(places: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places that ascend in each text, as steps from one to the next; a text's first one as it is."""
    first = np.cumsum(lens) - lens
    steps = np.diff(places, prepend=np.uint32(0))
    steps[first] = places[first]
    return steps


def climbed(steps: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of climbs."""
    first, total = np.cumsum(lens) - lens, np.cumsum(steps, dtype=np.int64)
    return total - np.repeat(total[first] - steps[first], lens)


def gram_blocks(docs: DataFrame, ranges: int) -> DataFrame:
    """The n-grams of texts (columns text, digest, trusted), packed in blocks of texts: a row per block and range of hashes.

    keys, places, own: hashes in the range (see by_rank, each as the step from the one before), their places in the order of (text, place)
    (see climbs) and counts in a text. docs, lens, grams, trusted: the block's texts that have
    some, with how many, all n-grams, and the mark. One row of each block has the digests and n-grams of all its texts.
    """

    kind = np.uint16 if ranges <= 1 << 16 else np.uint32
    step = -(-ranges // PASSES)

    def packed(held: list[bytearray], heads: list, block: int) -> Iterator[pa.RecordBatch]:
        keys, own, at = (np.frombuffer(x, t) for x, t in zip(held, ("<u4", "<u4", kind), strict=True))
        lens, grams, marks = (np.array([x[i] for x in heads], "<u4") for i in range(3))
        doc = np.repeat(np.arange(len(heads), dtype="<u4"), lens)
        for low in range(0, ranges, step):  # a pass orders its ranges' share of the block, so the order of all is never held
            share = np.flatnonzero((at >= low) & (at < low + step))
            share = share[np.argsort(at[share], kind="stable")]
            ends, first = np.bincount(at[share] - kind(low), minlength=step).cumsum(), 0
            for r in range(low, min(low + step, ranges)):
                cut, first, whole = share[first : ends[r - low]], ends[r - low], r == block % ranges
                if not len(cut) and not whole:
                    continue
                d, n = np.unique(doc[cut], return_counts=True)
                distinct, places = by_rank(keys[cut])
                climb = np.lexsort((places, doc[cut]))  # keys that are not repeated keep their order
                steps = np.diff(distinct, prepend=np.uint32(0)), climbs(places[climb], n)
                packs = [packed_numbers(x) for x in (*steps, own[cut][climb], d, n.astype("<u4"), grams[d], marks[d])]
                packs += [b"".join(x[3] for x in heads), packed_numbers(grams)] if whole else [None, None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int32()), pa.array([block], pa.int64()), *[pa.array([x], pa.binary()) for x in packs]], names=["range", "block", *BLOCK]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, heads, size, block = _Hashes(), [bytearray() for _ in range(3)], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for text, digest, trusted in zip(batch["text"], batch["digest"], batch["trusted"], strict=True):
                if words := _WORD.findall(text.as_py() or ""):
                    found, own = np.unique(gram_hashes(words, hashes), return_counts=True)
                    at = (found & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)
                    for whole, x in zip(held, ((found >> np.uint64(32)).astype("<u4"), own.astype("<u4"), at.astype(kind)), strict=True):
                        whole += x.tobytes()
                    heads.append((len(found), 2 * len(words) - 1, trusted.as_py(), digest.as_py()))
                    size += len(found)
                    if size >> BITS:
                        yield from packed(held, heads, block)
                        held, heads, size, block = [bytearray() for _ in range(3)], [], 0, block + 1
        if heads:
            yield from packed(held, heads, block)

    return docs.select("text", "digest", "trusted").mapInArrow(count, "range int, block bigint, " + ", ".join(f"{c} binary" for c in BLOCK))


BLOCK = ["keys", "places", "own", "docs", "lens", "grams", "trusted", "digests", "totals"]


def range_parts(rows: pa.Table, raw: float, trusted: float) -> pa.Table:
    """One range of hashes (rows of gram_blocks): the sums of log ratios of each block's texts over it.

    raw, trusted: n-grams of all texts and of trusted ones. Counts are summed over all blocks; the rest goes block by block.
    """
    keys = [np.cumsum(k, dtype=np.uint32) for k in numbers(rows["keys"])]
    sizes, keys = list(map(len, keys)), np.concatenate(keys)
    distinct, same = np.unique(keys, return_inverse=True)
    all_own, good, same = np.zeros(len(distinct)), np.zeros(len(distinct)), same.astype(np.uint32)
    del keys, distinct
    starts, grams, parts = np.cumsum([0, *sizes]), [], []

    def block(i: int, *names: str) -> list[np.ndarray]:
        return [unpacked(rows[c][i].as_py()) for c in names]

    for i, (start, size) in enumerate(zip(starts, sizes, strict=False)):
        places, own, lens, marks = block(i, "places", "own", "lens", "trusted")
        gram = same[start + positions(climbed(places, lens), size)]
        np.add.at(all_own, gram.astype(np.int64), own.astype(float))
        np.add.at(good, gram.astype(np.int64), own * np.repeat(marks, lens).astype(float))
        grams.append(gram)
    for i, gram in enumerate(grams):
        own, lens, n = block(i, "own", "lens", "grams")
        logs = log_ratios(good[gram], all_own[gram], own.astype(float), trusted, np.repeat(np.maximum(raw - n, 1.0), lens))
        parts.append(packed_numbers(np.bincount(np.repeat(np.arange(len(lens)), lens), own * logs, len(lens)).astype("<f4")))
    columns = [rows["block"], rows["docs"], pa.array(parts, pa.binary()), rows["digests"], rows["totals"]]
    return pa.table(columns, names=["block", "docs", "parts", "digests", "totals"])


def text_ratios(docs: DataFrame) -> DataFrame | None:
    """digest, ratio of every text with words (columns text, digest, trusted); none if no trusted text has words.

    Counts are summed by n-gram within a range of hashes, next to the texts that have them; sums of a text's
    ratios over ranges follow. Nothing is broadcast or collected but the two totals.
    """
    grams = F.greatest(2 * F.regexp_count("text", F.lit(WORD)) - 1, F.lit(0)).cast("bigint")
    raw, trusted = (float(x or 0) for x in docs.agg(F.sum(grams), F.sum(F.when(F.col("trusted"), grams))).first())
    if not trusted:
        return None

    def add_range(rows: pa.Table) -> pa.Table:
        return range_parts(rows, raw, trusted)

    def add_block(rows: pa.Table) -> pa.Table:
        whole = rows.filter(pc.is_valid(rows["digests"]))
        digests, n = whole["digests"][0].as_py(), numbers(whole["totals"])[0]
        sums = np.bincount(np.concatenate(numbers(rows["docs"])), np.concatenate(numbers(rows["parts"], "<f4")), len(n))
        return pa.table([pa.array([digests[i : i + 16] for i in range(0, len(digests), 16)], pa.binary()), pa.array(np.round(sums / n, 6))], names=["digest", "ratio"])

    blocks = gram_blocks(docs, max(LEAST_RANGES, math.ceil(raw / (1 << BITS))))
    parts = blocks.groupBy("range").applyInArrow(add_range, "block bigint, docs binary, parts binary, digests binary, totals binary")
    found = parts.groupBy("block").applyInArrow(add_block, "digest binary, ratio double")
    return found.groupBy("digest").agg(F.max("ratio").alias("ratio"))


def trusted_marks(docs: DataFrame, labels: DataFrame, most: int = TRUSTED_DOCS) -> DataFrame:
    """doc_id, text, trusted: whether labels call the document good and not toxic. Conflicting labels: not trusted.

    At most ``most`` labelled documents, first by a hash of their id, are trusted, so their ids can be broadcast
    and no text is shuffled. A document without an id has no label.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        ((F.coalesce(F.min("quality"), F.lit(0)) == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("trusted")
    )
    first = good.filter("trusted").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id", "left")  # ``most`` ids of 8 bytes
    return joined.select("doc_id", "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))


def judged(docs: DataFrame, ratios: DataFrame | None, least: float = LEAST_RATIO) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio, base_failed and kept.

    ratios: digest (MD5 of the text) and ratio; texts that it lacks have ratio 0. A column of the documents that has
    one of these names is replaced. Null text: no words, so base_failed.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                text = t.as_py() or ""
                rows.append(measures(text, _WORD.findall(text)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    udf = F.arrow_udf(measure, f"struct<{','.join(f'{n}:bigint' for n in names)}>")
    new = [*names, "ratio", "base_failed", "kept"]
    old = [c for c in docs.columns if c.lower() not in new]
    found = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(old)], udf(F.col("text")).alias("__m"), digest("text").alias("__d"))
    if ratios is None:
        found = found.withColumn("__ratio", F.lit(0.0))
    else:
        side = ratios.select(F.col("digest").alias("__d"), F.col("ratio").alias("__r")).hint("shuffle_hash")
        found = found.join(side, "__d", "left").withColumn("__ratio", F.coalesce("__r", F.lit(0.0)))
    failed = (F.col("__m.n_words") < 10) | (100 * F.col("__m.n_repeat_words") > 20 * F.col("__m.n_words"))
    kept = ~failed & (F.col("__ratio") >= F.lit(least))
    first = [F.col(f"__{i}").alias(c) for i, c in enumerate(old)]
    return found.select(*first, *[F.col(f"__m.{n}").alias(n) for n in names], F.col("__ratio").alias("ratio"), failed.alias("base_failed"), kept.alias("kept"))


def digest(text: str):
    return F.unhex(F.md5(text))


def quality_rules(docs: DataFrame, labels: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Judge every document (columns doc_id, text and any others) by the rules and the ratio.

    The ratio is the mean over all words and neighbouring pairs of log(p_trusted / p_corpus), both multinomials
    over n-grams of whole texts: of the labelled good documents, and of all documents. Kept: not base_failed
    and ratio at least ``least``. No labels, or none good: every ratio is 0 and only the rules decide. Empty table:
    no rows. Equal texts get equal verdicts.
    """
    marked = trusted_marks(docs, labels).withColumn("digest", digest("text"))
    return judged(docs, text_ratios(marked), least)
