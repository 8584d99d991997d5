"""Exact top-k search by inner product: dual traversal of cover trees over queries and data."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxspark.llm.shared import numbered, written

#: Vectors of one block, at most on average; a block's two trees are built in one task.
BLOCK = 4096
#: Vectors that the blocks gather around: so many at most, whatever the size of the data.
PIVOTS = 16
#: Stands for a null id in the trees and comes after all others (an id of this value comes back null).
NO_ID = 2**63 - 1
#: Points of a node that is not divided further, and nodes whose points are scored at once.
LEAF, AT_ONCE = 16, 512


class CoverTree:
    """Nodes over points in a permuted order; each covers a stretch of them within a radius of its centre point.

    A node's children have centres more than half its radius apart (chosen farthest first, its own centre among
    them) and radii of at most half of it. Equal points end in one leaf of radius 0.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, uids: np.ndarray):
        x = vectors.astype(np.float64)
        order = np.arange(len(x))
        gap = lambda pts, c: np.sqrt(np.maximum(((x[pts] - x[c]) ** 2).sum(axis=1), 0))
        root = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        lo, hi, centre, radius, first, count = [0], [len(x)], [root], [float(gap(order, root).max())], [0], [0]
        node = 0
        while node < len(lo):
            pts = order[lo[node] : hi[node]]
            if len(pts) > LEAF and radius[node] > 0:
                centres, near, of = [centre[node]], gap(pts, centre[node]), np.zeros(len(pts), dtype=np.int64)
                while near.max() > radius[node] / 2:
                    c = int(pts[np.argmax(near)])
                    d = gap(pts, c)
                    closer = d < near
                    of[closer], near = len(centres), np.minimum(near, d)
                    centres.append(c)
                by = np.argsort(of, kind="stable")
                order[lo[node] : hi[node]] = pts[by]
                sizes = np.bincount(of, minlength=len(centres))
                far = np.zeros(len(centres))
                np.maximum.at(far, of, near)
                first[node], count[node] = len(lo), len(centres)
                ends = lo[node] + np.cumsum(sizes)
                lo += (ends - sizes).tolist()
                hi += ends.tolist()
                centre += centres
                radius += far.tolist()
                first += [0] * len(centres)
                count += [0] * len(centres)
            node += 1
        self.x, self.ids, self.uids = vectors[order], ids[order], uids[order]
        self.lo, self.hi, self.first, self.count = map(np.array, (lo, hi, first, count))
        self.centres, self.radius = x[centre], np.array(radius)
        self.norms = np.sqrt((self.centres**2).sum(axis=1))


def stretches(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.worst = np.full(n, -np.inf)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        keep = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[keep], ids[keep]
        if len(keep) == self.k:
            self.worst[q] = score[keep[-1]]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: by floating point where every sum is exact there."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Lower each query group's bound by the most promising nodes first; drop node pairs that can't reach it.

    For a query within rq of cq and a point within rd of cd the product is at most
    cq.cd + |cq| rd + |cd| rq + rq rd. ``best`` is by the queries' order in their tree.
    """
    width = max(queries.x.shape[1], data.x.shape[1])
    pad = lambda a: np.pad(a, ((0, 0), (0, width - a.shape[1])))
    qx, dx, qc, dc = pad(queries.x), pad(data.x), pad(queries.centres), pad(data.centres)
    stack = [(0, np.zeros(1, dtype=np.int64))]
    while stack:
        q, nodes = stack.pop()
        rq, rd = queries.radius[q], data.radius[nodes]
        bound = dc[nodes] @ qc[q] + queries.norms[q] * rd + data.norms[nodes] * rq + rq * rd
        bound += 1e-9 * (np.abs(bound) + 1)
        by = np.argsort(-bound, kind="stable")
        nodes, bound = nodes[by], bound[by]
        a, b = int(queries.lo[q]), int(queries.hi[q])
        if queries.count[q] and b - a > 64:
            nodes = nodes[bound >= best.worst[a:b].min()]
            if len(nodes):
                stack += [(c, nodes) for c in range(queries.first[q], queries.first[q] + queries.count[q])]
            continue
        for at in range(0, len(nodes), AT_ONCE):
            some = nodes[at : at + AT_ONCE]
            some = some[bound[at : at + AT_ONCE] >= best.worst[a:b].min()]
            if not len(some):
                break
            leaf = data.count[some] == 0
            pts = stretches(data.lo[some[leaf]], data.hi[some[leaf]])
            if len(pts):
                scores = products(qx[a:b], dx[pts])
                for i in range(b - a):
                    hit = np.flatnonzero((scores[i] >= best.worst[a + i]) & (data.uids[pts] != queries.uids[a + i]))
                    if len(hit):
                        best.add(a + i, scores[i][hit], data.ids[pts[hit]])
            inner = some[~leaf]
            if len(inner):
                stack.append((q, stretches(data.first[inner], data.first[inner] + data.count[inner])))


def integer_vectors(table: DataFrame, scale: int = 64, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, v: floor(scale * x) of every component; rows with a null vector, or a null or non-finite component, are left out."""
    inf = float("inf")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)
    rows = table.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.coalesce(F.forall("v", sound), F.lit(False)))
    return rows.withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    width = max([1, *map(len, vectors)])
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    top = int(np.abs(out).max(initial=0))
    return out.astype(np.int16) if top < 1 << 15 else out


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k greatest inner products of each query row with every other row.

    ``vectors``: vec_id, v (array<bigint>; a shorter vector counts as padded with zeros). Ties go to the smaller
    vec_id, null ones last. Rows are told apart by position, so rows of one vec_id, or of none, are queries and candidates each. Fewer rows than k:
    all of them; no queries, or an empty table: no rows.

    Vectors gather around the nearest of a few pivots and are split into blocks of bounded size (equal vectors too). Each
    block becomes two trees, of its data and of its queries, and the queries are answered inside it, which bounds their
    kth score. Then query blocks meet those data blocks that can still hold a better score, and the partial
    answers are merged.
    """
    rows = vectors.withColumn("q", F.coalesce(is_query, F.lit(False))).withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    rows = numbered(rows, "topk-vectors", "uid")
    # The pivots only shape the blocks.
    centres = [_matrix(pd.Series([r["v"]]))[0].astype(float) for r in rows.orderBy(F.xxhash64("vec_id"), "uid").limit(pivots).collect()]
    width = max([1, *map(len, centres)])
    pivot = np.array([np.pad(c, (0, width - len(c))) for c in centres]).reshape(-1, width)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _matrix(b["v"]).astype(float)
            w = max(m.shape[1], width)
            m, p = np.pad(m, ((0, 0), (0, w - m.shape[1]))), np.pad(pivot, ((0, 0), (0, w - width)))
            b["pivot"] = np.argmax(m @ p.T - (p**2).sum(axis=1) / 2, axis=1)
            yield b

    placed = rows.mapInPandas(place, "vec_id bigint, v array<bigint>, q boolean, uid bigint, pivot int")
    placed = written(placed, "topk-placed")
    parts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / block).alias("parts"))
    dealt = placed.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")))

    def trees(group: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(group["v"])
        make = lambda g, x: CoverTree(x, g["vec_id"].to_numpy(), g["uid"].to_numpy())
        data, asked = make(group, m), group["q"].to_numpy()
        out = {"block": [int(group["pivot"].iloc[0]) << 40 | int(group["part"].iloc[0])]}
        out |= {"centre": [data.centres[0]], "radius": [data.radius[0]], "data": [pickle.dumps(data)]}
        if asked.any():
            queries = make(group[asked], m[asked])
            best = Best(len(queries.ids), k)
            dual_search(queries, data, best)
            out |= {"q_centre": [queries.centres[0]], "q_radius": [queries.radius[0]], "worst": [float(best.worst.min())], "queries": [pickle.dumps((queries, best))]}
        else:
            out |= {"q_centre": [None], "q_radius": [None], "worst": [None], "queries": [None]}
        return pd.DataFrame(out)

    kind = "block bigint, centre array<double>, radius double, data binary, q_centre array<double>, q_radius double, worst double, queries binary"
    index = written(dealt.groupBy("pivot", "part").applyInPandas(trees, kind), "topk-index")
    # Query blocks against data blocks, by their summaries: every query block is sent to each slot of data blocks.
    slots = 64
    data = index.select(F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"), F.col("block").alias("d"), "centre", "radius")
    asks = index.filter("queries is not null").select(F.col("block").alias("b"), "q_centre", "q_radius", "worst", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    top = dot("q_centre", "centre") + norm("q_centre") * F.col("radius") + norm("centre") * F.col("q_radius") + F.col("q_radius") * F.col("radius")
    pairs = asks.join(data, "slot").filter("b <> d").filter(top + 1e-9 * (F.abs(top) + 1) >= F.col("worst")).select("b", "d")
    met = pairs.join(index.select(F.col("block").alias("b"), "queries"), "b").join(index.select(F.col("block").alias("d"), "data"), "d")

    def answers(queries: CoverTree, best: Best, own: bool) -> pd.DataFrame:
        n = [len(s) for s in best.score]
        rows = {"uid": np.repeat(queries.uids, n), "query_id": np.repeat(queries.ids, n), "vec_id": np.concatenate(best.id), "score": np.concatenate(best.score)}
        return pd.DataFrame(rows)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for payload in b["queries"]:
                yield answers(*pickle.loads(payload), own=True)

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for payload, tree in zip(b["queries"], b["data"], strict=True):
                queries, known = pickle.loads(payload)
                best = Best(len(queries.ids), k)
                best.worst = known.worst.copy()
                dual_search(queries, pickle.loads(tree), best)
                yield answers(queries, best, own=False)

    kind = "uid bigint, query_id bigint, vec_id bigint, score bigint"
    found = index.filter("queries is not null").select("queries").mapInPandas(inside, kind)
    found = found.unionByName(met.select("queries", "data").mapInPandas(across, kind))
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    given = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return ranked.select(given("query_id"), F.col("rank").cast("int"), given("vec_id"), "score")
