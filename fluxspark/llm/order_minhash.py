"""Document fingerprints by Order MinHash: least occurrence-numbered k-mers, kept in text order and hashed as a tuple."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark.llm.shared import written

#: Code points of a k-mer, k-mers of a tuple, and tuples of a fingerprint.
K, TUPLE, HASHES = 5, 2, 48
#: Positions hashed together for all tuples: the block stays in a core's cache.
BLOCK = 4096
#: Stands after the last code point, so that a text of n code points has n k-mers.
PAD = 0x110000
#: Hexadecimal digits of one tuple's hash.
DIGITS = 8
_STEP, _OCC, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(32)
_LAST = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def kmer_codes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of the k-mer that begins at each position."""
    padded = np.concatenate([points, np.full(k - 1, PAD, dtype=points.dtype)]).astype(np.uint64)
    codes = padded[: len(points)]
    for i in range(1, k):
        codes = codes * _STEP + padded[i : i + len(points)]
    return _mixed(codes)


def occurrences(codes: np.ndarray, split: int | None = None, second: int | None = None) -> np.ndarray:
    """How many equal codes stand before each position.

    With ``split`` and ``second``, the codes are those of a text and, from ``second`` on, of another end for its first ``split``
    positions: such a code doesn't count those between the two.
    """
    n = len(codes)
    low = np.uint64(n.bit_length())
    key = np.sort((codes >> low << low) | np.arange(n, dtype=np.uint64))
    group = key >> low
    same = np.flatnonzero(group[1:] == group[:-1])
    out = np.zeros(n, dtype=np.uint64)
    if len(same):
        place = lambda at: (key[at] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        # The j-th of a stretch of neighbours that are equal stands at occurrence j.
        begins = np.r_[True, np.diff(same) > 1]
        run = np.maximum.accumulate(np.where(begins, np.arange(len(same)), 0))
        here, times = place(same + 1), np.arange(len(same)) - run + 1
        if second is not None:
            between = lambda at: (at >= split) & (at < second)
            skipped = np.cumsum(between(here))
            first = between(place(same[run]))
            times = times - np.where(here >= second, skipped - np.where(run > 0, skipped[run - 1], 0) + first, 0)
        out[here] = times
    return out


@dataclass
class Sketcher:
    """Order MinHash with fixed hash functions: equal texts give equal fingerprints wherever they are computed."""

    k: int = K
    size: int = TUPLE
    hashes: int = HASHES
    odds: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        drawn = np.random.default_rng(20231).integers(0, 1 << 32, (self.hashes, 1), dtype=np.uint32)
        self.odds, self.rows = drawn | np.uint32(1), np.arange(self.hashes)
        self.room = np.empty(self.hashes * BLOCK, dtype=np.uint32)

    def mixed(self, codes: np.ndarray, occ: np.ndarray) -> np.ndarray:
        """32 bits of each occurrence-numbered k-mer; a hash function multiplies them by an odd number."""
        return (((codes ^ (occ * _OCC)) * _STEP) >> _SHIFT).astype(np.uint32)

    def least(self, x: np.ndarray, start: int) -> list[np.ndarray]:
        """Per hash function the least ``size`` of each block: hash above, position below; positions count from ``start``."""
        found = []
        for a in range(0, len(x), BLOCK):
            block = x[a : a + BLOCK]
            flat = self.room[: self.hashes * len(block)]
            h = flat.reshape(self.hashes, len(block))
            np.multiply(block, self.odds, out=h)
            line = self.rows * len(block)
            for turn in range(min(self.size, len(block))):
                at = h.argmin(axis=1)
                cell = line + at
                found.append(flat[cell].astype(np.uint64) << _SHIFT | (at + (a + start)).astype(np.uint64))
                if turn + 1 < self.size:
                    flat[cell] = _LAST
        return found

    def tuples(self, found: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
        """The hash of each function's least k-mers in text order. A text with fewer k-mers leaves the first places empty."""
        out = np.zeros(self.hashes, dtype=np.uint64)
        if not found:
            return out.astype(np.uint32)
        places = np.stack(found, 1)
        if len(found) > self.size:
            places.sort(axis=1)
            places = places[:, : self.size]
        places = (places & np.uint64(_LAST)).astype(np.int64)
        places.sort(axis=1)
        for column in range(places.shape[1]):
            out = _mixed(out * _STEP + codes[places[:, column]])
        return (out >> _SHIFT).astype(np.uint32)

    def sketch(self, text: str) -> np.ndarray:
        codes = kmer_codes(code_points(text), self.k)
        return self.tuples(self.least(self.mixed(codes, occurrences(codes)), 0), codes)

    def sketch_with_end(self, text: str, keep: int, end: str) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of text and of text[:keep] + end; the k-mers inside the common part are hashed once."""
        points = code_points(text)
        n, both = len(points), max(0, keep - self.k + 1)
        codes = kmer_codes(points, self.k)
        other = kmer_codes(np.concatenate([points[both:keep], code_points(end)]), self.k)
        all_codes = np.concatenate([codes, other])
        x = self.mixed(all_codes, occurrences(all_codes, both, n))
        head = self.least(x[:both], 0)
        return self.tuples(head + self.least(x[both:n], both), codes), self.tuples(head + self.least(x[n:], both), np.concatenate([codes[:both], other]))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, size: int = TUPLE, hashes: int = HASHES) -> DataFrame:
    """Add the fingerprint of each whole text: ``hashes`` tuples of ``size`` k-mers of ``k`` code points, eight hexadecimal digits each.

    Null texts are empty; an empty text's tuples are all zero. A text shorter than k ends in padded k-mers, and one of fewer
    than ``size`` code points has shorter tuples. Equal texts have equal fingerprints. A column named ``out`` is
    replaced, others and all rows stay; an empty table stays empty. No shuffle. Memory: some 100 bytes a code point of the longest text.
    """
    sketcher = Sketcher(k, size, hashes)

    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([as_text(sketcher.sketch(x.as_py() or "")) for x in batch], pa.string())

    rows = df.select(F.struct("*").alias("__row"), F.arrow_udf(sketched, "string")(F.col(text)).alias("__new"))
    kept = [F.col("__row")[c].alias(c) for c in df.columns if c.lower() != out.lower()]
    return rows.select(*kept, F.col("__new").alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of tuples that two fingerprints have in common, 0 to 1; null where one is null."""
    n = F.length(a) / DIGITS
    part = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    same = F.size(F.filter(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: part(a, i) == part(b, i)))
    return F.when(n > 0, same / n)


_ROW = "part int, place bigint, doc_id bigint, n_chars bigint, fingerprint string, edited_fingerprint string, edited_sha256 string, near_edited double, near_next double, text string"


def compared_with_next(docs: DataFrame, k: int = K, size: int = TUPLE, hashes: int = HASHES) -> DataFrame:
    """Fingerprints of every whole text and of the text whose last quarter is the beginning of the next document's.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Documents follow one another by doc_id;
    null ids come first, rows of one id by a hash of the text and the text. The last row's next is the first; a single row's is itself.
    Null texts are empty. Every row stays, repeated ones too; other columns don't matter; an empty table gives none.

    Texts are range-partitioned once. A task reads its stretch in order and keeps one text. A partition's last
    text meets the first of the next partition in a second step over two rows of each partition.
    """
    sketcher = Sketcher(k, size, hashes)
    names = [f.split()[0] for f in _ROW.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in _ROW.split(", ")])

    def finished(doc_id: int | None, text: str, after: str, sketch_after: np.ndarray | None) -> tuple[dict, np.ndarray]:
        """The row of a text beside its next one; the next one's fingerprint comes later where it isn't known."""
        n = len(text)
        keep = n - n // 4
        own, edited = sketcher.sketch_with_end(text, keep, after[: n - keep])
        row = {
            "doc_id": doc_id, "n_chars": n, "fingerprint": as_text(own), "edited_fingerprint": as_text(edited),
            "edited_sha256": hashlib.sha256((text[:keep] + after[: n - keep]).encode("utf-8", "surrogatepass")).hexdigest(),
            "near_edited": float((own == edited).mean()), "near_next": None if sketch_after is None else float((own == sketch_after).mean()),
        }
        return row, own

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        held: tuple[int | None, str] | None = None
        before: tuple[dict, np.ndarray] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece, out = batch.slice(at, 256), []
                for doc_id, text in zip(piece["doc_id"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    text = text or ""
                    if held is not None:
                        row, own = finished(held[0], held[1], text, None)
                        row |= {"part": part, "place": place, "text": held[1] if place == 0 else None}
                        place += 1
                        if before is not None:
                            before[0]["near_next"] = float((before[1] == own).mean())
                            out.append(before[0])
                        before = row, own
                    held = doc_id, text
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is None:
            return
        own = sketcher.sketch(held[1])
        last = {"part": part, "place": -1 if place else -2, "doc_id": held[0], "text": held[1], "fingerprint": as_text(own)}
        rows = [last]
        if before is not None:
            before[0]["near_next"] = float((before[1] == own).mean())
            rows = [before[0], last]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                after = np.frombuffer(bytes.fromhex(r["after_print"]), dtype=">u4").astype(np.uint32)
                out.append(finished(r["doc_id"], r["text"], r["after"], after)[0])
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([schema.field(n) for n in names[2:9]]))

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("h"))
    ranged = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    done = written(ranged.mapInArrow(stretch, _ROW), "order-minhash")
    # One row a partition each: the last texts (place -1, or -2 if alone there) and the first ones (place 0, or -2).
    last = done.filter("place < 0").select("part", "doc_id", "text")
    first = done.filter("place in (0, -2)").select(F.col("part").alias("next"), F.col("text").alias("after"), F.col("fingerprint").alias("after_print"))
    parts = first.select("next")
    order = Window.orderBy("next")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select(F.col("next").alias("part"), F.coalesce(F.lead("next").over(order), F.first("next").over(whole)).alias("next"))
    closing = last.join(following, "part").join(first, "next").select("doc_id", "text", "after", "after_print")
    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    short = ", ".join(f for f in _ROW.split(", ") if f.split()[0] in names[2:9])
    return done.filter("place >= 0").select(*result).union(closing.mapInArrow(ends, short).select(*result))
