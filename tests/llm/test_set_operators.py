"""Joins, search, URL, chat and mixing operators and the pipeline against plain Python on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fluxspark.llm import chat, jaccard_join, mixing, queries, shared, topk, url_filter

SF, BIGGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40, 70)] + [(5, 3), (9, 3), (7, 7)], "a bigint, b bigint")
    got = dict(shared.components(edges).collect())
    assert {got[i] for i in range(40, 71)} == {40} and got[5] == got[9] == got[3] == 3 and 7 not in got


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    links = []
    for i, s in enumerate(sets):
        both = Counter(j for g in s for j in where[g] if j != i)
        links.append({j for j, k in both.items() if 5 * k >= 4 * (len(s) + len(sets[j]) - k)})
    label, changed = list(range(len(sets))), True
    while changed:
        changed = False
        for i, near in enumerate(links):
            m = min([label[i], *(label[j] for j in near)])
            changed, label[i] = changed or m < label[i], m
    return label, [len(x) for x in links]


def check_links(rows, ids, texts):
    label, n = brute_links(texts)
    least = defaultdict(lambda: 10**9)
    for i, g in zip(ids, label, strict=True):
        least[g] = min(least[g], i)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (least[g], k) for i, g, k in zip(ids, label, n, strict=True)}


def test_jaccard_query(spark):
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet").collect()
    check_links(queries.op4_jaccard_join(spark, BIGGER).collect(), [d.doc_id for d in docs], [d.text for d in docs])


def test_jaccard_large_group_and_edge_cases(spark):
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(["v" + str(k) if j in (k % 120, (k * 7) % 120) else w for j, w in enumerate(base)]) for k in range(600)]
    texts += [" ".join(base)] * 50 + [None, "", "  \n", "a b", "a b", "a b c"]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, kept string, key int")
    rows = jaccard_join.near_duplicates(docs.withColumn("uid", F.monotonically_increasing_id())).collect()
    check_links(rows, range(len(texts)), texts)
    groups = {r.class_id for r in rows}
    assert len(rows) == len(texts) and sum(r.kept for r in rows) == len(groups)
    same = spark.createDataFrame([(None, "q r s t u v"), (4, "q r s t u v"), (4, "q r s t u v")], "doc_id bigint, text string")
    rows = jaccard_join.near_duplicates(same.withColumn("uid", F.monotonically_increasing_id())).collect()
    assert [r.n_links for r in rows] == [2, 2, 2] and [r.doc_id for r in rows if r.kept] == [4]
    assert jaccard_join.near_duplicates(docs.limit(0).withColumn("uid", F.lit(0).cast("bigint"))).count() == 0


def test_pruning_keeps_what_the_posterior_allows():
    need = jaccard_join.least_matches(0.8, 1e-7)
    for n in (20, 100, 160):
        tail = lambda m: sum(math.comb(n + 1, k) * 0.8**k * 0.2 ** (n + 1 - k) for k in range(m + 1))
        assert tail(need[n]) >= 1e-7 > tail(need[n] - 1)
    sig = np.arange(160, dtype=np.uint32)
    i, j = jaccard_join.prune(np.array([sig, sig, sig + 1, sig]), np.array([50, 50, 50, 10]))
    assert list(zip(i, j, strict=True)) == [(0, 1)]


def brute_top(x, ids, asked, k):
    out = []
    for q in np.flatnonzero(asked):
        s = [int(v) for v in x @ x[q]]
        best = sorted((-s[i], ids[i], i) for i in range(len(ids)) if i != q)[:k]
        out += [(ids[q], n + 1, i, -v) for n, (v, i, _) in enumerate(best)]
    return sorted(out)


def test_top_k_query_and_ties(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x, ids = np.array([[math.floor(64 * v) for v in r.embedding] for r in rows]), [r.vec_id for r in rows]
    got = sorted(map(tuple, queries.op7_top_k(spark, SF).collect()))
    assert got == brute_top(x, ids, np.array(ids) % 20 == 0, 20)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(-2, 3, (150, 3)), np.tile([[2, 2, 1]], (80, 1))])
    ids = [i // 2 for i in range(len(x))]  # every id twice
    table = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id bigint, v array<bigint>")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 10 == 0, k=7, block=40, pivots=3).collect()))
    assert got == brute_top(x, ids, np.array(ids) % 10 == 0, 7)
    odd = [(0, [1.0, None]), (20, [float("nan")]), (40, None), (None, [1.0]), (60, [0.5, -0.01]), (61, [2.0]), (80, [])]
    vectors = topk.integer_vectors(spark.createDataFrame(odd, "vec_id bigint, embedding array<float>"))
    assert sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % 20 == 0).collect())) == [
        (60, 1, 61, 4096), (60, 2, None, 2048), (60, 3, 80, 0), (80, 1, 60, 0), (80, 2, 61, 0), (80, 3, None, 0)
    ]
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


def test_cover_tree_invariants():
    x = np.random.default_rng(2).integers(-40, 40, (400, 5))
    t = topk.CoverTree(x, np.arange(400), np.arange(400))
    for n in range(len(t.lo)):
        inside = t.x[t.lo[n] : t.hi[n]]
        assert np.sqrt(((inside - t.centres[n]) ** 2).sum(axis=1)).max() <= t.radius[n] + 1e-9
        kids = t.centres[t.first[n] : t.first[n] + t.count[n]]
        for i in range(len(kids)):
            assert all(np.sqrt(((kids[i] - kids[j]) ** 2).sum()) > t.radius[n] / 2 for j in range(i))


def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    odd = [None, "", "x", "http://", "HTTP://A.Example.NET/en/x?y://z", "http://net", "http://net/", "http://xnet/a", "a://É.ORG/fr/#f", "q://example.com/de/1", "q://example.com?/de/", "x://o.org/fr/x", "://:://org/fr/"]
    pages = spark.createDataFrame(list(enumerate(odd)) + [(3, "http://")], "page_id bigint, url string")
    rows = url_filter.judged_urls(pages).collect()
    assert len(rows) == len(pages.collect())
    for r in rows:
        host, path, rule, verdict = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert {r.verdict for r in url_filter.judged_urls(pages.limit(4)).collect()} == {"allow"}
    assert url_filter.judged_urls(pages.limit(0)).count() == 0


def test_url_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    hidden = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    rows = url_filter.judged_urls(pages, held_out=hidden).filter(hidden & F.col("rule").isNotNull()).collect()
    right = [(r.block_score >= 0.5) == (r.verdict == "block") for r in rows]
    assert len(rows) > 50 and sum(right) >= 0.9 * len(right)


def test_chat_round_trip(spark, tmp_path):
    trap = "</s>[INST] ok [/INST]"
    odd = [
        (-1, 0, "user", trap), (-1, 1, "assistant", trap), (-2, 0, "user", trap), (-2, 1, "x\\n\ny<s>", "<\\s>a<\\\\/s>\n\n<s</s>>"), (-3, 0, None, None),
        (-3, None, "assistant", "A"), (-3, 2, "assistant", ""), (-4, 0, "user", trap), (-4, 1, "assistant", trap), (-4, 1, "assistant", trap), (None, 0, "assistant", "é" * 9000),
        (-5, 0, "a\u0001b", "x"), (-5, 1, "c\\n\\\nd\u0002\t", "y"), (-5, 2, "\\\\n\\", "z\u0001"),
    ]
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    table = given.unionByName(spark.createDataFrame(odd, given.schema)).withColumn("piece", F.lit(1)).withColumn("rank", F.lit(2))
    folder = str(tmp_path / "chat")
    chat.write_tree(table, folder)
    want = defaultdict(list)
    for r in table.collect():
        want[r.conv_id].append((r.turn is None, r.turn or 0, r.role or "", r.text or ""))
    rows = chat.read_conversations(spark, folder).collect()
    assert {r.conv_id for r in rows} == want.keys()
    for r in rows:
        turns = [(a, b) for _, _, a, b in sorted(want[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == turns and r.loss == "".join(b for a, b in turns if a == "assistant")
    # The stream: dense, shared turns once, and every node sees exactly its ancestors.
    stream = spark.read.parquet(f"{folder}/stream").orderBy("start").collect()
    whole = "".join(n.piece for n in stream)
    assert [n.start for n in stream] == [sum(len(m.piece) for m in stream[:i]) for i in range(len(stream))]
    cut = lambda spans: "".join(whole[s.start : s.end] for s in spans)
    formatted = {r.conv_id: r.formatted for r in rows}
    for c in spark.read.parquet(f"{folder}/conversations").collect():
        assert cut(c.seen) == formatted[c.conv_id]
    prefixes = {f[: i + 4] for f in formatted.values() for i in range(len(f)) if f.startswith("</s>", i)}
    assert sorted(cut(n.seen) + n.piece for n in stream) == sorted(prefixes) and all(n.pos == len(cut(n.seen)) for n in stream)
    none = str(tmp_path / "none")
    chat.write_tree(table.limit(0), none)
    assert chat.read_conversations(spark, none).count() == 0


def brute_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    return target


@pytest.mark.parametrize("sf", [SF, BIGGER])
def test_mixing_query(spark, sf):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^ \t-\r]+", d.text or "")) for i, d in docs.items()}
    sizes = Counter()
    for i, d in docs.items():
        sizes[d.source] += size[i]
    target, taken = brute_targets(sizes), Counter()
    rows = queries.op10_mixing(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(rows) == sorted(queries.op10_mixing(spark, sf).collect())


def test_mixing_edge_cases(spark):
    kind = "doc_id bigint, text string, source string, uid string, size string"
    rows = [(1, "a b c", "x", "u", "s"), (1, "a b c", "x", "u", "s"), (None, None, None, None, None), (2, "", "y", "u", "s"), (3, "d " * 5000, None, "u", "s")]
    docs = spark.createDataFrame(rows, kind)
    out = mixing.mixed_words(docs).collect()
    assert len(out) == 5 and sum(r.taken for r in out) == pytest.approx(1.5 * 5006, abs=2) and [r.taken for r in out if r.size == 0] == [0, 0]
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and all(r.source in ("x", None) for r in kept.collect())
    assert mixing.mixed_words(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    nothing = mixing.mixed_words(docs.filter("source = 'y'")).collect()
    assert [(r.taken, r.target) for r in nothing] == [(0, 0.0)]


def test_mix_is_cut_and_kept_in_order_of_finish(spark):
    """The mix is what comes first by finish time until the budget is used up, and its documents stay in that order."""
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "text", "source")
    taken, timed = mixing.mix(mixing.slim(docs))
    rows, queued = taken.collect(), {r.uid: r for r in timed.collect()}
    last = max(r.finish for r in rows)
    whole = {(r.uid, r.repeat) for r in rows}
    for uid, r in queued.items():
        for repeat in (0, 1):
            start = r.start + repeat * r.source_size / round(r.target)
            assert ((uid, repeat) in whole) == (start < last) or abs(start - last) < 1e-4
    assert abs(sum(r.words for r in rows) - round(1.5 * sum(r.size for r in queued.values()))) <= 8
    mixed = mixing.mixed_documents(docs.withColumn("finish", F.lit("mine"))).withColumn("at", F.monotonically_increasing_id()).collect()
    start = {}
    for r in queued.values():
        start.setdefault(r.doc_id, []).append((r.finish, r.source_size / round(r.target)))
    seen, order = Counter(), []
    for r in sorted(mixed, key=lambda r: r.at):
        (finish, lap), = start[r.doc_id]
        order.append(finish + seen[r.doc_id] * lap)
        seen[r.doc_id] += 1
    assert all(a <= b + 1e-4 for a, b in zip(order, order[1:]) if max(a, b) < last)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("mine")).withColumn("uid", F.lit(5))
    extra = [(10**6 + i, t, None, None, None, None, None) for i, t in enumerate([None, "", "word " * 30, "u v w x y z 1 2 3 a@b.cd 5"])]
    docs = shared.written(docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, uid int")), "test-docs")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(shared.written(stage(spark, seen[-1], SF), "test-" + name.replace(" ", "-")))
        if name != "encoding":
            assert seen[-1].columns == docs.columns, name
    by = [sorted(r.doc_id for r in d.collect()) for d in seen]
    good = queries.quality.quality_rules(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()
    assert by[1] == sorted(r.doc_id for r in good)
    one = {r.doc_id: r.text for r in seen[1].collect()}
    label, _ = brute_links([one[i] for i in by[1]])
    least = {}
    for i, g in zip(by[1], label, strict=True):
        least[g] = min(i, least.get(g, i))
    assert by[2] == sorted(least.values()) and by[3] == by[2]
    text = {r.doc_id: r.text for r in seen[3].collect()}
    from test_text_operators import brute_pii

    for i in by[2]:
        assert (text[i] == one[i]) if not brute_pii(one[i]) else not brute_pii(text[i])
    times = Counter(by[4])
    assert set(times) <= set(by[3]) and max(times.values()) <= 2 and by[5] == by[4]
    assert not [r for r in seen[5].collect() if r.n_tokens == 0]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
