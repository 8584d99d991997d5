"""Byte-level vocabulary files of the tokenizers library, encoded whole text at a time through tiktoken with the same ids."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import tiktoken

from fluxspark.llm.bpe import byte_symbols, odd_characters

#: The split of byte-level files that name none of their own (a fixed value of the format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=1)
def odd_code_points() -> np.ndarray:
    """Whether each code point is one of the odd characters."""
    out = np.zeros(0x110000, dtype=bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in odd_characters().finditer(every):
        out[ord(m[0])] = True
    return out


class ByteRanks:
    """Ids as the tokenizers library gives them with add_special_tokens=False, truncation and padding off.

    ``plain``: the strings of added tokens inside a text are ordinary text. A text with characters whose properties differ
    between Unicode versions goes through the library itself.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, split = spec["model"]["vocab"], spec["model"]["merges"], spec["pre_tokenizer"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: i for i, c in enumerate(byte_symbols())}
        raw = {t: bytes(byte_of[c] for c in t) for t in vocab if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        ranked = [vocab[a + b] for a, b in pairs]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True) or ranked != sorted(ranked):
            raise ValueError(f"{path} is not a plain byte-level vocabulary in merge order")
        self.size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_of = [b""] * self.size
        for t, i in [*vocab.items(), *added.items()]:
            self.bytes_of[i] = raw.get(t, t.encode())
        self.ranks = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks={raw[t]: i for t, i in vocab.items() if t in raw}, special_tokens={})
        self.apart = [] if plain else list(added)
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        self.library.no_padding()
        self.library.no_truncation()
        self.odd = odd_code_points()
        self.odd_ascii = [chr(c) for c in np.flatnonzero(self.odd[:128]).tolist()]

    def is_odd(self, text: str) -> bool:
        if text.isascii():
            return any(c in text for c in self.odd_ascii)
        return bool(self.odd[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")].any())

    def encode(self, text: str) -> list[int]:
        if any(t in text for t in self.apart) or self.is_odd(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(text)
