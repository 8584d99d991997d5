"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and how often ids are linked."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxspark.llm.byte_ranks import ByteRanks
from fluxspark.llm.shared import written
from fluxspark.llm.token_counts import MARK

#: Characters of text whose documents share one list of linked ids; a longer text stands alone.
BLOCK_CHARS = 8_000_000
#: Texts aligned together, and words and pairs of ids that a worker remembers.
SLICE, REMEMBERED = 512, 250_000
#: Links of a group from which equal ids inside it are counted before they are paired.
WIDE = 1024


def meeting_points(a: bytes | list[int], b: bytes | list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each group on either side, from the tokens' lengths. Both sides have the same length in all.

    Diagonal run skipping: after a common end the ends agree at the current shift as long as the lengths do, so windows
    of doubling length are compared until one differs, then halved to the exact length of the one-to-one stretch. Where the ends
    don't agree, the side that lags moves on until both meet; the shift is what it is there.
    """
    i = j = 0
    n = len(a)
    runs: list[int] = []
    odd_a: list[int] = []
    odd_b: list[int] = []
    while i < n:
        run, step = 0, 2
        while i < n and a[i : i + step] == b[j : j + step]:
            run += step
            i += step
            j += step
            step *= 2
        while step > 1 and i < n:
            step //= 2
            if a[i : i + step] == b[j : j + step]:
                run += step
                i += step
                j += step
        if i >= n:
            runs.append(run - (i - n))
            break
        runs.append(run)
        x, y = a[i], b[j]
        p = q = 1
        while x != y:
            if x < y:
                x += a[i + p]
                p += 1
            else:
                y += b[j + q]
                q += 1
        odd_a.append(p)
        odd_b.append(q)
        i += p
        j += q
    at = np.cumsum(np.array(runs, dtype=np.int64) + 1)[: len(odd_a)] - 1
    sizes_a = np.ones(sum(runs) + len(odd_a), dtype=np.int64)
    sizes_b = sizes_a.copy()
    sizes_a[at], sizes_b[at] = odd_a, odd_b
    return sizes_a, sizes_b


@dataclass
class Aligned:
    """Texts one after the other: ids of both sides, each group's tokens (p of A, q of B) and first tokens, and each text's tokens and groups."""

    a: np.ndarray
    b: np.ndarray
    p: np.ndarray
    q: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray


class Pairing:
    """Two tokenizers over the same bytes: a byte-level vocabulary file (A) and a sentencepiece file (B)."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteRanks(a_path, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        m = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(m)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: No piece goes on behind a space that follows another character, so words are encoded apart.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_size, self.b_size = self.a.size, m
        if self.a_size * m > 1 << 32:
            raise ValueError("the product of the vocabularies' sizes must fit in 32 bits")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in t]) for t in (self.a.bytes_of, self.b_bytes))
        self.words: dict[str, bytes | None] = {}
        self.old_words = self.words
        self.names: dict[tuple[int, int], dict[int, str]] = {}

    def _pack(self, texts: list[str]) -> list[bytes | None]:
        """B's ids of each text, packed as unsigned 32-bit; None where they don't spell a space and the text."""
        coded = self.b.encode(texts, num_threads=1)
        flat = list(chain.from_iterable(coded))
        spelt, raw = b"".join(map(self.b_bytes.__getitem__, flat)), array("I", flat).tobytes()
        ends = np.cumsum([0, *map(len, coded)])
        out: list[bytes | None] = [raw[i:j] for i, j in zip((ends[:-1] * 4).tolist(), (ends[1:] * 4).tolist(), strict=True)]
        if spelt != "".join([" " + t for t in texts]).encode():
            for k, (ids, text) in enumerate(zip(coded, texts, strict=True)):
                if b"".join(map(self.b_bytes.__getitem__, ids)) != b" " + text.encode():
                    out[k] = None
        return out

    def _b_tokens(self, texts: list[str]) -> list[bytes | None]:
        """B's ids of each text; None where it has none. Words' ids are remembered."""
        split = [t.split(" ") if self.by_word and MARK not in t else [""] for t in texts]
        by_word = ["" not in words for words in split]
        wanted = set().union(*[words for words, fine in zip(split, by_word, strict=True) if fine]).difference(self.words)
        for w in wanted.intersection(self.old_words):
            self.words[w] = self.old_words[w]
        new = list(wanted.difference(self.old_words))
        self.words.update(zip(new, self._pack(new), strict=True))
        get, out = self.words.__getitem__, []
        for text, words, fine in zip(texts, split, by_word, strict=True):
            if not fine:
                out += self._pack([text])
                continue
            try:
                out.append(b"".join(map(get, words)))
            except TypeError:  # a word that B doesn't spell
                out.append(None)
        if len(self.words) > REMEMBERED:
            self.old_words, self.words = self.words, {}
        return out

    def align(self, texts: list[str | None]) -> Aligned:
        given = [t or "" for t in texts]
        b = [x if t else None for t, x in zip(given, self._b_tokens(given), strict=True)]
        a = [self.a.encode(" " + t) if x is not None else [] for t, x in zip(given, b, strict=True)]
        flat_a = np.array(list(chain.from_iterable(a)), dtype=np.int64)
        flat_b = np.frombuffer(b"".join([x for x in b if x is not None]), dtype=np.uint32).astype(np.int64)
        sizes = [x[i] for x, i in ((self.a_lengths, flat_a), (self.b_lengths, flat_b))]
        lean = max((s.max(initial=0) for s in sizes)) < 256
        p, q = meeting_points(*[s.astype(np.uint8).tobytes() if lean else s.tolist() for s in sizes])
        n_a, n_b = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x or b"") // 4 for x in b], dtype=np.int64)
        left, right = np.cumsum(p) - p, np.cumsum(q) - q
        ends = np.searchsorted(left, np.cumsum(n_a))
        return Aligned(flat_a, flat_b, p, q, left, right, n_a, n_b, np.diff(np.r_[0, ends]))

    def _named(self, shape: tuple[int, int], keys: list[int], ids: list[np.ndarray]) -> list[str]:
        """The text of groups of one shape; equal keys have equal ids."""
        known = self.names.setdefault(shape, {})
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, keys))
        if None in found:
            at = list({k: i for i, k in enumerate(keys) if found[i] is None}.values())
            for i, row in zip(at, zip(*[v[at].tolist() for v in ids], strict=True), strict=True):
                known[keys[i]] = ",".join(map(str, row[: shape[0]])) + "|" + ",".join(map(str, row[shape[0] :]))
            found = list(map(known.get, keys))
        return found

    def listed(self, x: Aligned) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        first, second = x.a[x.left], x.b[x.right]
        out = self._named((1, 1), (first * self.b_size + second).tolist(), [first, second])
        odd, narrow = (x.p > 1) | (x.q > 1), max(self.a_size, self.b_size) <= 1 << 16
        for shape in [(2, 1), (1, 2), (2, 2), (3, 1), (1, 3)] if narrow else []:
            at = np.flatnonzero((x.p == shape[0]) & (x.q == shape[1]))
            odd[at] = False
            ids = [x.a[x.left[at] + i] for i in range(shape[0])] + [x.b[x.right[at] + i] for i in range(shape[1])]
            keys = ids[0]
            for more in ids[1:]:
                keys = keys << 16 | more
            for g, name in zip(at.tolist(), self._named(shape, keys.tolist(), ids), strict=True):
                out[g] = name
        rest = np.flatnonzero(odd)
        for g, i, k, j, m in zip(*[v.tolist() for v in (rest, x.left[rest], x.left[rest] + x.p[rest], x.right[rest], x.right[rest] + x.q[rest])], strict=True):
            out[g] = ",".join(map(str, x.a[i:k].tolist())) + "|" + ",".join(map(str, x.b[j:m].tolist()))
        ends = np.cumsum(x.n_groups).tolist()
        return [";".join(out[s:e]) for s, e in zip([0, *ends], ends, strict=False)]

    def links(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, links), ascending: the distinct linked pairs (A id * B size + B id) of each text and how many links each has."""
        text = np.repeat(np.arange(len(x.n_groups), dtype=np.int64) << 32, x.n_groups)
        a, b, q = x.a * self.b_size, x.b, x.q
        wide = np.flatnonzero(x.p * q >= WIDE)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for g in wide.tolist():
            u, nu = np.unique(a[x.left[g] : x.left[g] + x.p[g]], return_counts=True)
            v, nv = np.unique(b[x.right[g] : x.right[g] + q[g]], return_counts=True)
            found.append((text[g] + np.add.outer(u, v).ravel(), np.multiply.outer(nu, nv).ravel()))
        if len(wide):
            q = q.copy()
            q[wide] = 0
        # Each A token of a group beside each B token of it.
        per, at = np.repeat(q, x.p), np.repeat(x.right, x.p)
        inside = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        own = np.repeat(a + np.repeat(text, x.p), per)
        keys, times = np.unique(own + b[np.repeat(at, per) + inside], return_counts=True)
        if found:
            codes, back = np.unique(np.concatenate([keys, *[c for c, _ in found]]), return_inverse=True)
            total = np.zeros(len(codes), dtype=np.int64)
            np.add.at(total, back, np.concatenate([times, *[n for _, n in found]]))
            keys, times = codes, total
        return keys >> 32, keys & 0xFFFFFFFF, times


@lru_cache(maxsize=2)
def pairing(a_path: str, b_path: str) -> Pairing:
    return Pairing(a_path, b_path)


def aligned(df: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """Add a_ids, b_ids, and a_starts, b_starts: the first token of each group in either list.

    A encodes a space and the text, B the text (it adds the space); special tokens' strings are plain text. Null and empty texts, and those whose
    tokens' bytes aren't the space and the text, have empty arrays. Columns of these names are replaced; rows and other columns
    stay; an empty table stays empty. No shuffle.
    """
    names = ["a_ids", "b_ids", "a_starts", "b_starts"]

    def arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        both = pairing(a_path, b_path)
        for batch in batches:
            out: list[dict] = []
            for at in range(0, len(batch), SLICE):
                x = both.align(batch.slice(at, SLICE).to_pylist())
                i, j, g = (np.cumsum(np.r_[0, n]).tolist() for n in (x.n_a, x.n_b, x.n_groups))
                for k in range(len(i) - 1):
                    groups = slice(g[k], g[k + 1])
                    parts = x.a[i[k] : i[k + 1]], x.b[j[k] : j[k + 1]], x.left[groups] - i[k], x.right[groups] - j[k]
                    out.append(dict(zip(names, parts, strict=True)))
            yield pa.array(out, pa.struct([(n, pa.list_(pa.int32())) for n in names]))

    udf = F.arrow_udf(arrays, ", ".join(f"{n} array<int>" for n in names))
    rows = df.select(F.struct("*").alias("__row"), udf(F.col(text)).alias("__new"))
    kept = [F.col("__row")[c].alias(c) for c in df.columns if c.lower() not in names]
    return rows.select(*kept, *[F.col("__new")[n].alias(n) for n in names])


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_DOC = "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary, linked array<bigint>, docs array<int>"
_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def link_report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair of ids counts once for every document that links it; n_best are links whose count is the highest of their A id,
    count_sum adds the counts of all links. Documents without tokens (see ``aligned``) have zeros and an empty string. Every row stays,
    repeated ones and those without an id too, and counts as a document; other columns don't matter; an empty table gives none.

    Documents are aligned once and written in blocks of some millions of characters, each with its distinct pairs. Counts add up over blocks
    (a pair has one row a block, however many documents hold it), go back to the blocks, and each document looks its pairs up there.
    """
    doc_schema, out_schema = _arrow(_DOC), _arrow(_OUT)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block, chars = pairing(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            pairs, docs_of = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_pylist([{"block": block, "linked": pairs, "docs": docs_of}], schema=doc_schema)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                texts = piece["text"].to_pylist()
                x = both.align(texts)
                text_of, pairs, times = both.links(x)
                held.append(pairs)
                chars += sum(len(t or "") for t in texts)
                ends = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
                packed = lambda s, e: times[s:e].astype("<u2" if times[s:e].max(initial=0) < 1 << 16 else "<u8").tobytes()
                parts = list(zip(ends, ends[1:], strict=False))
                columns = {
                    "block": [block] * len(texts), "doc_id": piece["doc_id"], "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups,
                    "n_links": [int(times[s:e].sum()) for s, e in parts], "groups_sha256": [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in both.listed(x)],
                    "pairs": [pairs[s:e].astype("<u4").tobytes() for s, e in parts], "times": [packed(s, e) for s, e in parts], "linked": [None] * len(texts), "docs": [None] * len(texts),
                }
                yield pa.RecordBatch.from_pydict(columns, schema=doc_schema)
                if chars >= BLOCK_CHARS:
                    yield summed()
                    block, chars, held = block + 1, 0, []
        if held:
            yield summed()

    def looked_up(key: tuple, rows: pa.Table, counts: pa.Table) -> pa.Table:
        pair = counts["pair"].to_numpy()
        order = np.argsort(pair)
        pair, n, best = pair[order], counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]
        out = []
        for r in rows.to_pylist():
            row = {k: r[k] for k in ("doc_id", *_COUNTS, "groups_sha256")} | {"n_best": 0, "count_sum": 0}
            if r["pairs"]:
                mine = np.frombuffer(r["pairs"], "<u4")
                times = np.frombuffer(r["times"], "<u2" if len(r["times"]) == 2 * len(mine) else "<u8").astype(np.int64)
                at = np.searchsorted(pair, mine)
                row |= {"n_best": int(times[best[at]].sum()), "count_sum": int((times * n[at]).sum())}
            out.append(row)
        return pa.Table.from_pylist(out, schema=out_schema)

    size = pairing(a_path, b_path).b_size
    table = written(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(align, _DOC), "alignment")
    blocks = table.filter(F.col("linked").isNotNull()).select("block", F.explode(F.arrays_zip("linked", "docs")).alias("z")).select("block", F.col("z.linked").alias("pair"), F.col("z.docs").alias("d"))
    counts = blocks.groupBy("pair").agg(F.sum("d").alias("n")).withColumn("a", F.floor(F.col("pair") / size))
    # One row for each id of A's vocabulary at most.
    highest = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("top")))
    judged = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    back = blocks.select("block", "pair").join(judged, "pair").select(F.col("block").alias("at"), "pair", "n", "best")
    rows = table.filter(F.col("linked").isNull()).drop("linked", "docs")
    return rows.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(looked_up, _OUT)
