"""What a worker holds beside its texts: n-grams of a block in few bytes each, ids and decoded texts of one slice."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from public_tokenizers import path as tokenizer_file

from fluxspark.llm import bpe, quality


def test_a_block_of_grams_is_packed_in_few_bytes(monkeypatch):
    monkeypatch.setattr(quality, "BITS", 19)
    monkeypatch.setattr(quality, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    docs = SimpleNamespace(select=lambda *_: SimpleNamespace(mapInArrow=lambda function, _: function))
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(300)) for _ in range(1000)]
    batch = pa.record_batch({"text": pa.array(texts), "digest": pa.array([b"d" * 16] * 1000), "trusted": pa.array([False] * 1000)})
    tracemalloc.start()
    try:
        rows = sum(1 for _ in quality.gram_blocks(docs, 64)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 128
    assert peak < 32 << 19


@pytest.mark.parametrize("packed", [True, False])
def test_ids_leave_by_slices(spark, monkeypatch, packed):
    found, udf = [], bpe.F.arrow_udf
    monkeypatch.setattr(bpe.F, "arrow_udf", lambda function, kind: found.append(function) or udf(function, kind))
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    texts = [None, "", "one two three", "x" * 60, *["four five six"] * 9, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    coded = bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), back="back", packed=packed)
    parts = list(found[0](iter([pa.array(texts), pa.array([], pa.string())])))
    assert [len(p) for p in parts] == [4, 4, 4, 2]
    rows = [r for p in parts for r in p.to_pylist()]
    plain = bpe.tokenizer(tokenizer_file("word_bpe_49k.json")).library
    for text, row in zip(texts, rows, strict=True):
        ids = plain.encode(text or "", add_special_tokens=False).ids
        assert row == {"ids": b"".join(i.to_bytes(4, "little") for i in ids) if packed else ids, "back": plain.decode(ids, skip_special_tokens=False)}
    assert [(r.ids if not packed else bytes(r.ids), r.back) for r in coded.orderBy("doc_id").collect()] == [(r["ids"], r["back"]) for r in rows]
