"""Token, quality and personal-data operators against the libraries and plain Python on small tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark.sql import functions as F

from fluxspark.llm import bpe, pii, quality, queries, token_counts, token_files

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a<|endoftext|>B  <|startoftext|>x", "ΟΔΟΣ ΣΑΣ İstanbul É é ﬁ", "haha" * 40, "it's we'll 'S 1234 x\x1cy\x1dz \x85 a\u200bb",
    "日本語 テキスト 😀😀 \u2dd5", "  a  b \n c\n\n d \t e ", "x\ny.\nz!! q", "word " * 3000, "w" * 6000, "same text here", "same text here",
]


def documents(spark, texts):
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 3}", 0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, kept int")


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out = bpe.encode(documents(spark, ODD), tokenizer_file("word_bpe_49k.json"), back="back")
    again = bpe.decode(out, tokenizer_file("word_bpe_49k.json"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "ids", "back"]
    for r in again.collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.back == r.decoded == lib.decode(want, skip_special_tokens=False)
    assert bpe.encode(documents(spark, ODD).limit(0), tokenizer_file("word_bpe_49k.json")).count() == 0


def test_bpe_rounds_where_order_matters():
    """A merge whose product starts an earlier pair can't be done everywhere at once."""
    vocab = {c: i for i, c in enumerate("abc")} | {"bc": 3, "abc": 4, "ab": 5}
    pairs = np.array([[vocab["abc"], vocab["a"]], [1, 2], [0, 3]])
    m = bpe.Merges(pairs, np.array([5, 3, 4]), 6)
    assert m.together.tolist() == [True, True, False]
    symbols, sizes = m.apply(np.array([0, 1, 2, 0, 1, 2, 1, 2]), np.array([6, 2]))
    assert sizes.tolist() == [len(symbols) - 1, 1] and symbols[-1] == 3


def test_bpe_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op1_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    docs = documents(spark, ODD).withColumn("doc_id", F.when(F.col("doc_id") < 12, 11 - F.col("doc_id")))  # two rows have no id
    folder = str(tmp_path / "ids")
    token_files.write_ids(docs, tokenizer_file("byte_bpe_50k.json"), folder, shard_ids=100)
    rows = token_files.read_documents(spark, folder).orderBy("start").collect()
    assert spark.read.parquet(folder).count() > 3
    texts = ["same text here"] * 2 + [ODD[11 - i] for i in range(12)]
    want = [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [r.doc_id for r in rows] == [None, None, *range(12)]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    assert [r.start for r in rows] == [sum(map(len, want[:i])) for i in range(14)]
    empty = str(tmp_path / "none")
    token_files.write_ids(docs.limit(0), tokenizer_file("byte_bpe_50k.json"), empty)
    assert token_files.read_documents(spark, empty).count() == 0


def test_token_file_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start = 0
    for t, r in zip(texts, queries.op9_token_files(spark, SF).orderBy("doc_id").collect(), strict=True):
        ids = np.array([*lib.encode(t.text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (t.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("ids", [[], [7], [5] * 4001, [1, 2, 3] * 3000, list(np.random.default_rng(1).integers(0, 60, 9000))])
def test_grammar_decodes_at_any_offset(ids):
    ids = np.array(ids, dtype=np.uint16)
    shard = token_files.pack(ids, 100)
    assert (token_files.unpack(shard) == ids).all()
    for a, b in ((0, 1), (1023, 1025), (2000, 3999), (len(ids) // 2, len(ids))):
        if b <= len(ids):
            assert (token_files.unpack(shard, a, b) == ids[a:b]).all()


def brute_unigram(word, scores, byte):
    best = [(0, 0)]
    for e in range(1, len(word) + 1):
        size = len(word[e - 1].encode())
        options = [(best[e - 1][0] + size * byte, best[e - 1][1] - size)]
        options += [(best[i][0] + scores[word[i:e]], best[i][1] - 1) for i in range(e) if word[i:e] in scores]
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def test_token_counts(spark, monkeypatch):
    file = tokenizer_file("piece_bpe_32k.model")
    scores, byte = token_counts.piece_scores(file)
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(12).collect())
    texts |= {1000 + i: t for i, t in enumerate(ODD)}
    out = token_counts.token_counts(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("N_Tokens", F.lit("x")), file)
    assert out.columns == ["doc_id", "text", "n_pretokens", "n_tokens", "log_score"]
    for r in out.collect():
        words = re.findall(r"[^ \t-\r]+", texts[r.doc_id] or "")
        known = {w: brute_unigram("▁" + w, scores, byte) for w in set(words)}
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(known[w][1] for w in words))
        assert r.log_score == sum(known[w][0] for w in words) / token_counts.UNIT
    small = token_counts.Trie(scores, byte)
    monkeypatch.setattr(token_counts, "NODES", 20)
    for w in ("▁there", "▁then", "▁thé", "▁there", "▁" + "ab" * 300):
        assert small.score(w) == brute_unigram(w, scores, byte)


def brute_rules(text):
    words, lines, seen, dup = re.findall(r"[^ \t-\r]+", text or ""), (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n


def test_quality_measures_and_edge_cases(spark):
    texts = [None, "", " \n \n", "a b c d e f a b c d e g a b c d e", "x y\nx y\n\n\nx y", "one two three four five six seven eight nine ten", "§ é " * 4]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, None), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for r in quality.quality_rules(docs, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.ratio >= quality.LEAST_RATIO)
    none = quality.quality_rules(docs, labels.limit(0))
    assert {r.ratio for r in none.collect()} == {0.0} and none.columns.count("kept") == 1
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


def test_quality_query_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[:150]:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
    verdict = {r.doc_id: r for r in rows}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [verdict[x.doc_id].kept for x in labels if x.quality == 1 and not verdict[x.doc_id].base_failed]
    junk = [verdict[x.doc_id].kept for x in labels if x.quality == 0]
    assert all(clean) and sum(junk) <= 0.1 * len(junk)


def test_quality_query_drops_junk_in_a_larger_corpus_too(spark):
    sf = "/root/testdata/sf0.1"
    verdict = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf).collect()}
    labels = [x for x in spark.read.parquet(f"{sf}/labels.parquet").collect() if not x.toxic and not verdict[x.doc_id].base_failed]
    clean = [verdict[x.doc_id].kept for x in labels if x.quality == 1]
    junk = [verdict[x.doc_id].kept for x in labels if x.quality == 0]
    assert all(clean) and sum(junk) <= 0.05 * len(junk)


def test_text_ratios_are_those_of_exact_counts(spark):
    texts = ["a b c a b", "a b c a b", "c d e f", "A x", "", None, "b b b b z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    grams = [(w := (t or "").lower().split()) + list(zip(w, w[1:])) for t in texts]
    names = {g: i for i, g in enumerate(sorted({g for x in grams for g in x}, key=str))}
    both = np.zeros((2, len(names)))
    for i, x in enumerate(grams):
        for g in x:
            both[1, names[g]] += 1
            both[0, names[g]] += i in (0, 3)
    for r in quality.quality_rules(docs, labels).collect():
        want = quality.mean_ratio(np.array([names[g] for g in grams[r.doc_id]], int), both, both.sum(axis=1))
        assert r.ratio == pytest.approx(want, abs=2e-6)


def test_mean_ratio_by_hand():
    both = np.zeros((2, 1 << quality.BITS))
    both[:, 3], both[:, 9] = (6, 10), (2, 30)
    b, s = np.array([3, 3, 9]), quality.SMOOTHING
    want = (2 * (np.log(6 + s * 8 / 37) - np.log(8 + s)) + np.log(2 + s * 8 / 37) - np.log(29 + s)) / 3 - np.log(8 / 37)
    assert quality.mean_ratio(b, both, both.sum(axis=1)) == pytest.approx(want)


def brute_pii(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_base_spans(spark):
    random.seed(3)
    texts = ["".join(random.choice("ab1234567890.@-+ ()_%\nçé") for _ in range(random.choice([5, 40, 200]))) for _ in range(200)]
    parts = ["1.2", "a@b.c", ".", "@", "-", " ", "4", "+1", "(23) ", "4111 1111-1111 1111", "255.0.0.1", "256.1.1.1", "c", "é"]
    texts += ["".join(random.choice(parts) for _ in range(30)) for _ in range(200)]
    texts += ["x \u0001 a@b.c \u0001 1.2.3.4 \u0002 \0", None, "", " ".join(f"u{i}@ex.com" for i in range(700)), "a" * 50_000 + "@", "1" * 50_000, "a@" + "b.c" * 20_000]
    docs = documents(spark, texts).withColumn("uid", F.col("doc_id"))
    rows = pii.find_spans(docs).select("doc_id", pii.listed(F.col("base")).alias("b")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.b == brute_pii(texts[r.doc_id])
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_pii_query(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op6_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_pii(texts[r.doc_id])
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(r.spans.split(","))


def test_pii_learns_contexts_and_leaves_others(spark):
    seeds = [f"please write mail me: user{i}@site{i}.org now" for i in range(20)]
    unseen = ["please write mail me: user_at_site7 now", "the year was 12345 then", "please write mail me: nothing now"]
    noise = [f"the year was {20000 + i} then" for i in range(20)] + ["the year was 1.2.3.4 then"]
    texts = seeds + unseen + noise + seeds[:3]
    docs = documents(spark, texts).withColumn("uid", F.col("doc_id"))
    spans = {r.doc_id: r.s for r in pii.find_spans(docs).select("doc_id", pii.listed(F.col("spans")).alias("s")).collect()}
    assert spans[20] == "email:22:35"
    assert all(spans[i] == brute_pii(texts[i]) for i in range(len(texts)) if i != 20)
    clean = {r.doc_id: r for r in pii.redact(docs.drop("uid")).collect()}
    assert clean[20].text == "please write mail me: [EMAIL] now" and clean[20].n_chars == len(clean[20].text) and clean[20].ids == "x"
    assert clean[21].text == texts[21] and len(clean) == len(texts)
