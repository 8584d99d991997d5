"""Token counts of a unigram vocabulary: forward scores shared along a trie of distinct pre-tokens."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pre-token is a run of anything but these, with the mark of a word's beginning before it.
_WORD = re.compile(r"[^ \t-\r]+")
MARK = "▁"
#: Nodes of a worker's trie, after which it is emptied, and the longest pre-token that goes into it.
NODES, LONGEST = 400_000, 256
#: Words whose totals a worker remembers, and bits of the token count below a score.
WORDS, _BITS = 400_000, 48
#: Scores are whole millionths, so sums are exact.
UNIT = 1_000_000


class Trie:
    """Distinct pre-tokens; each node holds the best score and the token count of the text from the root to it.

    A node's score is the best over the pieces that end there, added to the score of the node where the piece begins. It
    is computed when the node is made, so words that begin alike share the work. Ties: fewer tokens. Pieces that end at a place
    are found by walking back through a trie of reversed pieces, which stops where no piece goes on.
    """

    def __init__(self, scores: dict[str, int], byte_score: int):
        self.byte_score = byte_score
        self.back: dict = {}
        for piece, score in scores.items():
            node = self.back
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.count: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0], [0]

    def step(self, word: str, end: int, best: list[int], tokens: list[int]) -> tuple[int, int]:
        """Score and tokens of word[:end], from those of all shorter prefixes. A character of no piece costs its bytes."""
        size = len(word[end - 1].encode("utf-8", "replace"))
        top, few = best[end - 1] + size * self.byte_score, tokens[end - 1] + size
        node, start = self.back, end
        while start:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            s = node.get("")
            if s is not None and (best[start] + s > top or best[start] + s == top and tokens[start] + 1 < few):
                top, few = best[start] + s, tokens[start] + 1
        return top, few

    def score(self, word: str) -> tuple[int, int]:
        """(score, tokens) of a pre-token, kept at the node where it ends."""
        if len(word) > LONGEST:
            best, tokens = [0], [0]
            for end in range(1, len(word) + 1):
                b, t = self.step(word, end, best, tokens)
                best.append(b)
                tokens.append(t)
            return best[-1], tokens[-1]
        if len(self.best) > NODES:
            self.clear()
        node, best, tokens = 0, [0], [0]
        for end in range(1, len(word) + 1):
            key = (node, word[end - 1])
            node = self.child.get(key, -1)
            if node < 0:
                b, t = self.step(word, end, best, tokens)
                node = self.child[key] = len(self.best)
                self.best.append(b)
                self.tokens.append(t)
            best.append(self.best[node])
            tokens.append(self.tokens[node])
        return best[-1], tokens[-1]

    def totals(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(score, tokens) of each list of words. Words not seen since the memory was last emptied are scored once, in order, so that neighbours share prefixes."""
        if len(self.count) > WORDS:
            self.count = {}
        for w in sorted(set().union(*texts).difference(self.count)):
            score, tokens = self.score(MARK + w)
            self.count[w] = (score << _BITS) + tokens
        sums = [sum(map(self.count.__getitem__, words)) for words in texts]
        return [(x >> _BITS, x & (1 << _BITS) - 1) for x in sums]


def piece_scores(path: str) -> tuple[dict[str, int], int]:
    """Log probabilities of a sentencepiece file's pieces, in millionths: 1 / (rank + 10) normalised; and that of a byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (r + 10) for r in range(len(ids)))
    log = lambda r: round(UNIT * (math.log(1 / (r + 10)) - math.log(total)))
    return {model.id_to_piece(i): log(r) for r, i in enumerate(ids)}, log(len(ids)) - 2 * UNIT


@lru_cache(maxsize=1)
def trie(path: str) -> Trie:
    return Trie(*piece_scores(path))


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add n_pretokens, n_tokens and log_score (nats) of each whole text under the best segmentation.

    Columns of these names are replaced. Null and empty texts: 0. Equal texts get equal counts; an empty table stays
    empty. No shuffle; a worker's trie and counts are emptied when they are full, which changes no result.
    """
    names = ["n_pretokens", "n_tokens", "log_score"]

    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shared = trie(path)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for at in range(0, len(batch), 256):
                texts = [_WORD.findall(t or "") for t in batch.slice(at, 256).to_pylist()]
                for words, (score, n) in zip(texts, shared.totals(texts), strict=True):
                    for column, v in zip(out, (len(words), n, score / UNIT), strict=True):
                        column.append(v)
            yield pa.StructArray.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names)

    udf = F.arrow_udf(counts, "struct<n_pretokens:bigint,n_tokens:bigint,log_score:double>")
    rows = docs.select(F.struct("*").alias("__row"), udf(F.col(text)).alias("__new"))
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c.lower() not in names]
    return rows.select(*kept, *[F.col("__new")[n].alias(n) for n in names])
