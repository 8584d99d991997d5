"""Size of what the quality rules shuffle, and that it is read back unchanged."""

import random

import numpy as np
from pyspark.sql import functions as F

from fluxspark.llm import quality


def test_packed_blocks_are_small_and_come_back(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(60_000)]
    data = [(i, " ".join(words[60 * i : 60 * i + 60])) for i in range(1000)] + [(1000, ""), (1001, None)]
    docs = spark.createDataFrame(data, "doc_id int, text string").withColumns({"digest": quality.digest("text"), "trusted": F.col("doc_id") < 9}).coalesce(1)
    rows = quality.gram_blocks(docs, 4).toArrow()
    packs = sum(len(x) for c in ("keys", "places", "own") for x in rows[c].to_pylist())
    counts, hashes = {}, quality._Hashes()
    for i, text in data:
        for g, n in zip(*np.unique(quality.gram_hashes((text or "").split(), hashes), return_counts=True), strict=True):
            counts[i, int(g) >> 32] = n
    assert packs < 1.5 * len(counts)
    found, keys, places, own, texts, lens = {}, *(quality.numbers(rows[c]) for c in ("keys", "places", "own", "docs", "lens"))
    for k, p, o, d, n in zip(keys, places, own, texts, lens, strict=True):
        at = quality.positions(quality.climbed(p, n), len(k))
        found |= dict(zip(zip(np.repeat(d, n).tolist(), np.cumsum(k, dtype=np.uint32)[at].tolist(), strict=True), o.tolist(), strict=True))
    assert found == counts
    p, n = np.array([0, 0, 3, 1, 7, 0, 5], "<u4"), np.array([3, 2, 2])
    assert quality.climbs(p, n).tolist() == [0, 0, 3, 1, 6, 0, 5] and quality.climbed(quality.climbs(p, n), n).tolist() == p.tolist()
    assert len(quality.climbed(np.empty(0, "<u4"), np.empty(0, "<u4"))) == 0 == len(quality.climbs(np.empty(0, "<u4"), np.empty(0, "<u4")))
