"""The pipeline's stages write no copy of their documents, and keep equal and null rows as they are."""

import random
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P
from fluxspark.llm.shared import shared_dir


def test_stages_leave_no_copy_of_the_texts(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, " ".join("".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(200)), "en", f"s{i % 3}", 0) for i in range(300)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(data, "doc_id int, text string, lang string, source string, n_chars int").write.parquet(path)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda p: sum(x.stat().st_size for x in p.rglob("*.parquet"))
    docs, whole = spark.read.parquet(path), size(tmp_path / "docs")
    for stage in (P.near_duplicate_stage, P.pii_stage, P.mixing_stage):
        before = size(folder)
        assert stage(spark, docs, "").count() >= 300
        assert size(folder) - before < 0.6 * whole


def test_equal_and_null_rows_stay_apart(spark):
    texts = ["mail a@b.example now", "mail a@b.example now", None, None, "", "one two three four five six"]
    data = [(i, t, lang, s) for i, t in zip([1, 1, None, None, 5, 6], texts, strict=True) for lang, s in (("en", "a"), ("de", None))]
    docs = spark.createDataFrame(data, "doc_id int, text string, lang string, source string")
    clean = P.pii_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in clean) == Counter((i, t and t.replace("a@b.example", "[EMAIL]"), lang) for i, t, lang, _ in data)
    near = P.near_duplicate_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in near) == Counter({(1, texts[0]): 1, (None, None): 4, (5, ""): 2, (6, texts[5]): 1})
    same = spark.createDataFrame([(1, "a b c d", lang, "x") for lang in ("de", "en")], docs.schema)
    mixed = P.mixing_stage(spark, same, "").collect()
    assert {r.lang for r in mixed} == {"de", "en"}
    assert len(mixed) == 3
    assert P.mixing_stage(spark, docs.withColumn("finish", F.lit(1)), "").columns[-1] == "finish"
