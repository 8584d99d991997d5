"""Byte-pair encoding and decoding: batched merge rounds over the symbols of many words at once."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text whose distinct words are merged together.
SLICE_CHARS = 2_000_000
#: Words, and chunks, whose ids a worker remembers, twice: those of now and those of before the last turnover.
REMEMBERED = 150_000
_NONE = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def odd_characters() -> re.Pattern:
    """Control characters that some call white space, and all characters younger than Unicode 3.2."""
    old = unicodedata.ucd_3_2_0.category
    young = [i for i in range(0x80, 0x110000) if old(chr(i)) == "Cn"]
    starts = [i for i, before in zip(young, [0, *young], strict=False) if i != before + 1]
    ends = [i for i, after in zip(young, [*young[1:], 0], strict=True) if after != i + 1]
    return re.compile("[\0\x1c-\x1f" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]")


class Merges:
    """A merge list as sorted pair keys with rank and product."""

    def __init__(self, pairs: np.ndarray, products: np.ndarray, n_symbols: int):
        keys = pairs[:, 0] * n_symbols + pairs[:, 1]
        # A pair listed twice has its last rank.
        keys, last = np.unique(keys[::-1], return_index=True)
        self.n, self.keys, self.ranks = n_symbols, keys, len(products) - 1 - last
        self.products = products
        first_use = np.full(n_symbols, _NONE)
        for side in (0, 1):
            np.minimum.at(first_use, pairs[:, side], np.arange(len(pairs)))
        # All pairs of one rank may be merged at once where no pair with the product comes earlier.
        self.together = first_use[products] > np.arange(len(products))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def apply(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word to the end: (symbols, lengths) after, words in the order given, none empty.

        A round finds the lowest rank of each word and merges its pairs from left to right. Only pairs
        beside a merge are looked up again, and finished words leave the arrays.
        """
        word = np.repeat(np.arange(len(lengths)), lengths)
        sym = symbols.astype(np.int64)
        rank = np.full(len(sym), _NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.rank(sym[inner], sym[inner + 1])
        done_w, done_s = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            open_ = low < _NONE
            if not open_.all():
                stay = np.repeat(open_, size)
                done_w.append(word[~stay])
                done_s.append(sym[~stay])
                word, sym, rank, low, size = word[stay], sym[stay], rank[stay], low[open_], size[open_]
                if not len(sym):
                    break
            best = np.repeat(low, size)
            hit = np.flatnonzero(rank == best)
            # Of pairs that overlap (a run of one symbol), every other one; where an earlier pair could follow, the first only.
            begins = np.r_[True, np.diff(hit) > 1]
            hit = hit[(hit - hit[np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))]) % 2 == 0]
            only = ~self.together[best[hit]]
            hit = hit[~only | np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            sym[hit] = self.products[best[hit]]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            at = (np.cumsum(stay) - 1)[hit]
            word, sym, rank = word[stay], sym[stay], rank[stay]
            touched = np.zeros(len(sym), dtype=bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            near = np.flatnonzero(touched)
            rank[near] = _NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.rank(sym[near], sym[near + 1])
        word, sym = np.concatenate(done_w or [word]), np.concatenate(done_s or [sym])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(lengths))


class Tokenizer:
    """A byte-level BPE vocabulary file of the tokenizers library: normalise, split, merge.

    Handles what such files name: NFC, white space collapsed, lower case; a split pattern; an end-of-word suffix;
    added tokens, which are matched in the raw text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for name, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = name
        marks = byte_symbols()
        self.inside = np.array([vocab[m] for m in marks])
        self.last = np.array([vocab[m + suffix] for m in marks])
        pairs = np.array([[vocab[a], vocab[b]] for a, b in model["merges"]], dtype=np.int64)
        products = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.merges = Merges(pairs, products, len(self.tokens))
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.normal = [s["type"] for s in steps]
        unknown = set(self.normal) - {"NFC", "Replace", "Lowercase"}
        split = next((s["pattern"]["Regex"] for s in (spec["pre_tokenizer"].get("pretokenizers") or []) if s["type"] == "Split"), None)
        if unknown or split is None:
            raise ValueError(f"this file needs steps that are not supported: {unknown or 'a pre-tokenizer without a split pattern'}")
        self.word = regex.compile(split)
        self.odd = odd_characters()
        self.library = tokenizers.Tokenizer.from_file(path)
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split), "removed", invert=True)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added_ids = {k: np.uint32(i).tobytes() for k, i in added.items()}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.old_words, self.old_chunks = self.words, self.chunks

    def normalised(self, text: str) -> str:
        if "NFC" in self.normal:
            text = unicodedata.normalize("NFC", text)
        # A sigma at the end of a word is lowered as any other.
        return text.replace("Σ", "σ").lower() if "Lowercase" in self.normal else text

    def learn_words(self, words: set[str]) -> None:
        """Put every word's ids into ``words``."""
        for w in (words - self.words.keys()) & self.old_words.keys():
            self.words[w] = self.old_words[w]
        new = list(words - self.words.keys())
        if not new:
            return
        raw = [w.encode("utf-8", "replace") for w in new]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = self.inside[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        ids, sizes = self.merges.apply(symbols, lengths)
        flat, stop = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        start = 0
        for w, end in zip(new, stop, strict=True):
            self.words[w] = flat[start:end]
            start = end

    def pieces(self, text: str) -> list[str]:
        """Chunks that words don't cross, normalised; see ``words_of``."""
        if not self.odd.search(text):
            return self.normalised(text).split()
        # Characters whose properties changed between Unicode versions go by the library's own tables.
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return ["\0" + w for w, _ in self.splitter.pre_tokenize_str(text)]

    def words_of(self, chunk: str) -> list[str]:
        if chunk[0] == "\0":
            return [chunk[1:]]
        return [chunk] if chunk.isalpha() else self.word.findall(chunk)

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            parts = self.added.split(text) if self.added and self.added.search(text) else [text]
            split.append([([p] if i % 2 else self.pieces(p)) for i, p in enumerate(parts)])
        distinct = set().union(*(chunks for parts in split for chunks in parts[::2]))
        for c in (distinct - self.chunks.keys()) & self.old_chunks.keys():
            self.chunks[c] = self.old_chunks[c]
        found = {c: self.words_of(c) for c in distinct - self.chunks.keys()}
        self.learn_words(set().union(*found.values()))
        for c, ws in found.items():
            self.chunks[c] = self.words[ws[0]] if len(ws) == 1 else b"".join([self.words[w] for w in ws])
        get = self.chunks.__getitem__
        out = [b"".join([self.added_ids[p[0]] if i % 2 else b"".join(map(get, p)) for i, p in enumerate(parts)]) for parts in split]
        if len(self.words) > REMEMBERED:
            self.old_words, self.words = self.words, {}
        if len(self.chunks) > REMEMBERED:
            self.old_chunks, self.chunks = self.chunks, {}
        return out

    def slices(self, texts: Iterable[str | None]) -> Iterator[list[bytes]]:
        """Ids of all texts, as many at a time as fill a slice."""
        held, chars = [], 0
        for text in texts:
            held.append(text or "")
            chars += len(held[-1])
            if chars >= SLICE_CHARS:
                yield self.encode_slice(held)
                held, chars = [], 0
        if held:
            yield self.encode_slice(held)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for ids in self.slices(texts):
            yield from ids

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as the library does for a file that names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str | None = None, packed: bool = False) -> DataFrame:
    """Add the ids of each whole text (null and empty texts: none), and the text decoded from these ids as ``back``.

    Ids are array<int>, or little-endian unsigned 32-bit integers in a binary column if ``packed``. Columns of these names are
    replaced; rows and other columns stay as they are. Equal texts get equal ids, an empty table stays
    empty. No shuffle; a worker holds one Arrow batch, a slice of it with its ids and decoded texts, and bounded memories.
    """

    def columns(bpe: Tokenizer, raw: list[bytes]) -> pa.StructArray:
        if packed:
            coded: pa.Array = pa.array(raw, pa.binary())
        else:
            ends = np.cumsum([0, *map(len, raw)]) // 4
            coded = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
        decoded = pa.array([bpe.decode(np.frombuffer(r, "<u4").tolist()) for r in raw] if back else [None] * len(raw), pa.string())
        return pa.StructArray.from_arrays([coded, decoded], ["ids", "back"])

    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for batch in batches:
            for raw in bpe.slices(x.as_py() for x in batch):
                yield columns(bpe, raw)

    udf = F.arrow_udf(ids_of, f"struct<ids:{'binary' if packed else 'array<int>'},back:string>")
    new = {ids: "ids"} | ({back: "back"} if back else {})
    rows = df.select(F.struct("*").alias("__row"), udf(F.col(text)).alias("__new"))
    kept = [F.col("__row")[c].alias(c) for c in df.columns if c.lower() not in {n.lower() for n in new}]
    return rows.select(*kept, *[F.col("__new")[f].alias(n) for n, f in new.items()])


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of each id array. Null arrays give null, null ids inside an array are left out."""

    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(path)
        for batch in batches:
            yield pa.array([None if x.as_py() is None else bpe.decode(i for i in x.as_py() if i is not None) for x in batch], pa.string())

    return df.withColumn(text, F.arrow_udf(text_of, "string")(F.col(ids)))
