"""Fingerprints, whitening and alignment against plain Python on small tables."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path as tokenizer_file
from pyspark.sql import functions as F

from fluxspark.llm import alignment, byte_ranks, order_minhash, queries, whitening

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SF = "/root/testdata/sf0.001"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "ab", "abab" * 9, "a" * 400, "x  y  z", "▁a b", "<s> hi </s> <|endoftext|>", "İstanbul ΣΑΣ é ﬁ\x1cq\x85", "日本語 テキスト 😀😀",
    "one two\nthree\t four", "same text", "same text", "word " * 3000, "q" * 5000, "ⷕ young", "0\0 null",
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, fingerprint string, n_a int")


def plain_sketch(text, k, size, hashes):
    """Order MinHash one k-mer at a time."""
    sketcher = order_minhash.Sketcher(k, size, hashes)
    codes = order_minhash.kmer_codes(order_minhash.code_points(text), k)
    seen, numbered = Counter(), []
    for i in range(len(text)):
        kmer = text[i : i + k]
        numbered.append((i, int(sketcher.mixed(codes[i : i + 1], np.array([seen[kmer]], dtype=np.uint64))[0])))
        seen[kmer] += 1
    out = []
    for odd in sketcher.odds[:, 0].tolist():
        least = sorted(sorted(numbered, key=lambda x: (x[1] * odd % 2**32, x[0]))[:size])
        h = np.zeros(1, dtype=np.uint64)
        for i, _ in least:
            h = order_minhash._mixed(h * order_minhash._STEP + codes[i : i + 1])
        out.append(int(h[0]) >> 32)
    return out


@pytest.mark.parametrize("size,block", [(2, 4096), (3, 7)])
def test_sketch_is_order_minhash(monkeypatch, size, block):
    monkeypatch.setattr(order_minhash, "BLOCK", block)
    rng = random.Random(1)
    sketcher = order_minhash.Sketcher(4, size, 9)
    for text in ["", "a", "abc", "aaaaaaaaaaaaaaaaaa", "abcabcabcabc", *["".join(rng.choices("abc d😀", k=n)) for n in (5, 30, 200)]]:
        assert sketcher.sketch(text).tolist() == plain_sketch(text, 4, size, 9)
        for end in ["", "b", "abcabc", "ccccccccccccc"]:
            keep = len(text) - len(text) // 4
            own, other = sketcher.sketch_with_end(text, keep, end)
            assert own.tolist() == sketcher.sketch(text).tolist() and other.tolist() == sketcher.sketch(text[:keep] + end).tolist()


def test_likeness_follows_edits_and_order():
    rng, sketcher = random.Random(2), order_minhash.Sketcher()
    text = "".join(rng.choices("abcdefghij klmno", k=3000))
    near = lambda other: float((sketcher.sketch(text) == sketcher.sketch(other)).mean())
    assert near(text) == 1.0 and near(text[:10] + "#" + text[10:]) > 0.9 and near("".join(rng.choices("abcdefghij klmno", k=3000))) < 0.1
    # The same k-mers in another order are less alike than in the same order.
    assert near(text[1500:] + text[:1500]) < 0.8


def expected_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        q = len(t) // 4
        yield i, t, t[: len(t) - q] + n[:q], n


@pytest.mark.parametrize("partitions", [1, 5])
def test_each_document_meets_the_next(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = [(i * 3 - 5 if i else None, t) for i, t in enumerate(ODD)]
        got = {r.doc_id: r for r in order_minhash.compared_with_next(table(spark, rows).repartition(3)).collect()}
        sketcher = order_minhash.Sketcher()
        assert len(got) == len(rows)
        for i, own, edited, after in expected_next(rows):
            r, a, b, c = got[i], *[sketcher.sketch(t) for t in (own, edited, after)]
            assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (order_minhash.as_text(a), order_minhash.as_text(b))
            assert (r.near_edited, r.near_next) == ((a == b).mean(), (a == c).mean())
        alone = order_minhash.compared_with_next(table(spark, [(4, "only one here")])).collect()
        assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(b"only one honl").hexdigest()
        assert order_minhash.compared_with_next(table(spark, [])).count() == 0
        assert order_minhash.compared_with_next(table(spark, [(1, "twice"), (1, "twice"), (None, None)])).count() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprint_column(spark):
    out = order_minhash.fingerprints(table(spark, list(enumerate(ODD))))
    assert out.columns == ["doc_id", "text", "n_a", "fingerprint"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].fingerprint == rows[1].fingerprint == "0" * 8 * order_minhash.HASHES and rows[13].fingerprint == rows[14].fingerprint
    pair = spark.createDataFrame([(rows[5].fingerprint, rows[5].fingerprint, rows[6].fingerprint)], "a string, b string, c string")
    same, other = pair.select(order_minhash.likeness(F.col("a"), F.col("b")), order_minhash.likeness(F.col("a"), F.col("c"))).first()
    assert same == 1.0 and other < 0.5


def test_fingerprint_query(spark):
    texts = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.op11_order_minhash(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, own, edited, _ in expected_next([(r.doc_id, r.text) for r in texts]):
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(own)
    assert np.median([r.near_edited for r in got.values()]) > 0.25 and np.median([r.near_next for r in got.values()]) < 0.1


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, dtype=np.float64))
    c = x - x.mean(axis=0)
    values, u = np.linalg.eigh(c.T @ c / len(c))
    return c, values[::-1], u[:, ::-1]


def test_whitening_query(spark):
    rows = queries.op12_whitening(spark, SF).toPandas()
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    c, values, u = plain_whitening(np.stack(given.embedding))
    got = rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = c @ u[:, :32] / np.sqrt(values[:32])
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-10 and (rows.n == len(given)).all()
    explained = rows.drop_duplicates("component").sort_values("component").explained
    assert np.allclose(explained, values[:32] / values.sum(), rtol=1e-12)
    x = np.floor(64 * np.stack(given.embedding).astype(float)).astype(object) + 1_000_000
    deviation = ((len(x) * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation.tolist()


def test_chebyshev_rounds_find_close_eigenvalues():
    """A spectrum whose wanted end is crowded; the block is smaller than the space."""
    rng = np.random.default_rng(3)
    values = np.r_[np.linspace(2, 1.5, 6), np.linspace(1.4, 0.1, 54)]
    u = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    v = (u * values) @ u.T
    calls = []
    found = whitening.leading(lambda q: calls.append(q.shape) or v @ q, 60, float(values.sum()), components=6, guard=3)
    assert np.allclose(found.values, values[:6], rtol=1e-13) and np.abs(np.abs((found.vectors * u[:, :6]).sum(axis=0)) - 1).max() < 1e-12
    assert found.residuals.max() < 1e-12 and found.passes == len(calls) and all(s[1] in (1, 9) for s in calls)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), float(i * i % 7) / 3, 1.0]) for i in range(40)]
    odd = [(None, [1.0, 2.0, 1.0]), (3, [2.0, 0.5, 1.0]), (3, [2.0, 0.5, 1.0]), (50, None), (51, [1.0, None, 2.0]), (52, [nan, 1.0, 1.0]), (53, [inf, 1.0, 1.0]), (54, [1.0]), (55, []), (56, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "w") for i, v in good + odd], "vec_id bigint, embedding array<double>, whitened string")
    rows, fitted = whitening.whiten(df)
    assert rows.columns == ["vec_id", "embedding", "deviation", "whitened"] and fitted.moments.n == rows.count() == 43
    got = rows.orderBy("vec_id").collect()
    # The third dimension is constant: no component reaches it.
    assert all(len(r.whitened) == 3 and r.whitened[2] is None and r.whitened[0] is not None for r in got) and fitted.identity_error < 1e-12
    assert got[0].vec_id is None and whitening.whiten(df.limit(0))[0].count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<double>"))[0].collect()[0].whitened == [None, None]


def test_deviation_beyond_a_long():
    m = whitening.Moments(3, [0, 9 * 2**40])
    assert m.deviation(np.array([[1, 3 * 2**40], [0, 0]])) == [9, None]
    assert m.deviation(np.array([[1, 3 * 2**40], [2, 3 * 2**40]])) == [9, 36]


def test_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    parts = spark.createDataFrame([(i, bytearray(np.array([float(i), 1.0]).tobytes())) for i in range(9)], "part int, sums binary")
    assert whitening.added(parts, 2, 9).tolist() == [36.0, 9.0]


def test_byte_ranks_are_the_library():
    from tokenizers import Tokenizer

    for plain in (True, False):
        lib, own = Tokenizer.from_file(A), byte_ranks.ByteRanks(A, plain=plain)
        lib.encode_special_tokens = plain
        every = ["".join(f" {chr(c)}x{chr(c)}1 " for c in range(i, i + 64) if not 0xD800 <= c < 0xE000) for i in range(0, 0x3000, 64)]
        for text in [t or "" for t in ODD] + every:
            assert list(own.encode(text)) == lib.encode(text, add_special_tokens=False).ids, text[:50]


def plain_alignment(texts):
    """Groups by the sets of ends, pair by pair."""
    import base64

    import sentencepiece
    from tokenizers import Tokenizer

    lib, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    raw = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb"))}
    raw_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs = []
    for t in texts:
        if not t:
            docs.append(None)
            continue
        a, b, whole = lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t), (" " + t).encode()
        if b"".join(raw[i] for i in a) != whole or b"".join(map(raw_b, b)) != whole:
            docs.append(None)
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends([raw[i] for i in a]), ends([raw_b(i) for i in b])
        cuts = sorted(set(ea) & set(eb))
        group = lambda e: sum(c < e for c in cuts)
        ga, gb = defaultdict(list), defaultdict(list)
        for i, e in zip(a, ea):
            ga[np.searchsorted(cuts, e)].append(i)
        for i, e in zip(b, eb):
            gb[np.searchsorted(cuts, e)].append(i)
        docs.append((a, b, [(ga[k], gb[k]) for k in range(len(cuts))]))
    counts = Counter(p for d in docs if d for p in {(x, y) for g in d[2] for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    for d in docs:
        if d is None:
            yield (0, 0, 0, 0, 0, 0, "")
            continue
        links = [counts[x, y] for g in d[2] for x in g[0] for y in g[1]]
        best = sum(counts[x, y] == top[x] for g in d[2] for x in g[0] for y in g[1])
        listed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        yield (len(d[0]), len(d[1]), len(d[2]), len(links), best, sum(links), hashlib.sha256(listed.encode()).hexdigest())


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_alignment(spark, SF).collect()}
    assert got == {r.doc_id: want for r, want in zip(docs, plain_alignment([r.text for r in docs]))}


@pytest.mark.parametrize("block,wide", [(10, 2), (8_000_000, 1024)])
def test_alignment_of_odd_texts(spark, monkeypatch, block, wide):
    monkeypatch.setattr(alignment, "BLOCK_CHARS", block)
    monkeypatch.setattr(alignment, "WIDE", wide)
    texts = [t for t in ODD if t is None or len(t) < 9000] + ["word " * 500, "ab" * 300]
    rows = [(None if i % 7 == 3 else i % 5, t) for i, t in enumerate(texts)]
    got = alignment.link_report(table(spark, rows).repartition(2), A, B).collect()
    want = [(i, *w) for (i, _), w in zip(rows, plain_alignment(texts))]
    key = lambda r: (r[0] is None, *[str(x) for x in r])
    assert sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in got), key=key) == sorted(want, key=key)
    assert alignment.link_report(table(spark, []), A, B).count() == 0
    assert alignment.link_report(table(spark, [(1, None), (1, "")]), A, B).select("n_a", "groups_sha256").collect() == [(0, ""), (0, "")]


def test_aligned_column(spark):
    out = alignment.aligned(table(spark, [(1, "hello there\n"), (2, None), (3, "▁"), (4, "x  y")]), A, B)
    assert out.columns == ["doc_id", "text", "fingerprint", "n_a", "a_ids", "b_ids", "a_starts", "b_starts"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].a_ids == rows[3].b_ids == rows[3].a_starts == [] and len(rows[1].a_starts) == len(rows[1].b_starts) > 0
    assert rows[4].a_starts[0] == rows[4].b_starts[0] == 0


@pytest.mark.parametrize("seed", range(20))
def test_meeting_points(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 300)
    cut = lambda p: [0, *[i for i in range(1, n) if rng.random() < p], n]
    a = cut(rng.choice([0.1, 0.5, 0.95]))
    b = a if seed % 5 == 0 else cut(rng.choice([0.1, 0.5, 0.95]))
    lengths = [np.diff(x).tolist() for x in (a, b)]
    p, q = alignment.meeting_points(*lengths)
    cuts = sorted(set(a[1:]) & set(b[1:]))
    assert np.array(a)[np.cumsum(p)].tolist() == np.array(b)[np.cumsum(q)].tolist() == cuts
    if max(map(max, lengths)) < 256:
        assert [x.tolist() for x in alignment.meeting_points(*map(bytes, lengths))] == [p.tolist(), q.tolist()]
    assert [len(x) for x in alignment.meeting_points(b"", b"")] == [0, 0]
