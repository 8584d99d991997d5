"""Units of the Jaccard join go through the pruning many at a time, with the pairs they have one by one."""

import numpy as np

from fluxspark.llm import jaccard_join


def test_pairs_of_many_units_at_once():
    rng = np.random.default_rng(1)
    sizes = np.array([2, 3, 1, 2, 9, 4])
    base = rng.integers(0, 1 << 32, (3, 160), dtype=np.uint32)
    sig = np.where(rng.random((21, 160)) < 0.05, np.uint32(7), base[rng.integers(0, 3, 21)])
    n, ends, want = rng.integers(40, 60, 21), np.cumsum(sizes), []
    for m, end in zip(sizes, ends, strict=True):
        i, j = jaccard_join.prune(sig[end - m : end], n[end - m : end])
        want += zip(i + end - m, j + end - m, strict=True)
    i, j = jaccard_join.prune(sig, n, sizes=sizes)
    assert want and sorted(zip(i, j, strict=True)) == sorted(want)
