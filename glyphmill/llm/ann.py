"""Nearest neighbours by low-dimensional stable projections, a kd-tree over them and a chi-square stop."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import _io, _vec

#: Projected dimensions; chance that a true neighbour passes the stopping test; seed of the projections.
PROJECTED, CONFIDENCE, SEED = 32, 0.9, 11
#: Rows of a block and of a leaf; most cells of the upper tree; rows its splits are fitted on at most.
BLOCK, LEAF, CELLS, SAMPLE = 4096, 64, 4096, 32768


def chi_square_quantile(m: int, p: float) -> float:
    """x with P(chi-square of m degrees <= x) = p, by bisection of the gamma series."""

    def below(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 1e-9, 20.0 * m + 100
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def project(vectors: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """2-stable (Gaussian) projections; the matrix depends on the vectors' length and SEED only."""
    matrix = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], m))
    return np.einsum("ij,jk->ik", vectors, matrix)


def grow(points: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as (dimension, value, left, right) nodes; a leaf is (-1, 0, number, 0). Widest dimension, median."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0

    def build(p: np.ndarray, k: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append((-1, 0.0, 0, 0))
        dim = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(p) else 0
        x = np.sort(p[:, dim]) if len(p) else p
        if k <= 1 or len(p) < 2 or x[0] == x[-1]:
            nodes[at] = (-1, 0.0, count, 0)
            count += 1
            return at
        value = float(x[len(x) // 2])
        if value == x[0]:
            value = float(x[np.searchsorted(x, value, "right")])
        left = p[:, dim] < value
        nodes[at] = (dim, value, build(p[left], k // 2), build(p[~left], k - k // 2))
        return at

    build(points, leaves)
    return nodes


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    """The leaf number of each point."""
    out = np.zeros(len(points), np.int64)
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, rows = stack.pop()
        dim, value, left, right = tree[at]
        if dim < 0:
            out[rows] = left
        elif len(rows):
            go = points[rows, dim] < value
            stack += [(left, rows[go]), (right, rows[~go])]
    return out


class Block:
    """The vectors of one block under a local kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        p = project(vectors)
        leaf = cell_of(grow(p, -(-len(ids) // LEAF)), p)
        order = np.argsort(leaf, kind="stable")
        self.ids, self.vectors, self.p = ids[order], vectors[order], p[order]
        self.start = np.flatnonzero(np.r_[True, np.diff(leaf[order]) != 0])
        self.end = np.r_[self.start[1:], len(ids)]
        self.verified = 0
        self.low, self.high = np.minimum.reduceat(self.p, self.start), np.maximum.reduceat(self.p, self.start)

    def nearest(self, qid: int, q: np.ndarray, k: int, bound: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found: leaves in order of their projected distance are
        verified until that distance squared is over factor times the k-th best distance squared."""
        pq = project(q[None])[0]
        slack = 1e-9 * (1 + float(pq @ pq))
        away = np.maximum(np.maximum(self.low - pq, pq - self.high), 0)
        away = (away * away).sum(axis=1)
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(away, kind="stable"):
            limit = bound * bound * factor + slack
            if away[leaf] > limit:
                break
            s, e = self.start[leaf], self.end[leaf]
            d = self.p[s:e] - pq
            near = np.flatnonzero(((d * d).sum(axis=1) <= limit) & (self.ids[s:e] != qid)) + s
            if not len(near):
                continue
            self.verified += len(near)
            d = self.vectors[near] - q
            ids, dist = np.concatenate([ids, self.ids[near]]), np.concatenate([dist, np.sqrt((d * d).sum(axis=1))])
            best = np.lexsort((ids, dist))
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])][:k]  # of rows of one id the nearest
            ids, dist = ids[best], dist[best]
            if len(ids) == k:
                bound = min(bound, float(dist.max()))
        return ids, dist


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _by_dim(b: pa.RecordBatch, name: str):
    """Row numbers and vectors of each vector length in a batch."""
    n = b.column(name).value_lengths().to_numpy()
    for dim in np.unique(n):
        rows = np.flatnonzero(n == dim)
        yield int(dim), rows, _matrix(b.column(name).take(pa.array(rows)), int(dim))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) without vectors that are null, empty, zero or hold a null or non-finite part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        "id is not null and v is not null and size(v) > 0"
    ).where(finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, query_rows: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which query_rows holds.

    query_rows is a predicate over the column `id`. Score is the Euclidean distance in double
    precision; ties go to the smaller id; the query's own row is left out; with fewer candidates
    all come back. A neighbour is missed with chance 1 - confidence at most. Vectors of another
    length are no candidates. Unusable vectors take no part; repeated rows count once, and of rows of one id with
    different vectors the nearest counts, as candidates and as queries. Other columns may have any names; an empty
    table gives an empty result.

    The upper tree is fitted on at most SAMPLE projected rows; every row is indexed. Queries
    first search their home cell, which bounds the k-th distance, then go only to the cells whose
    projected box passes the stopping test. A cell of more than BLOCK rows is dealt into blocks.
    """
    spark = vectors.sparkSession
    data = usable(vectors, id_col, vector_col)

    def points(batches):
        for b in batches:
            for dim, rows, x in _by_dim(b, "v"):
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(list(project(x)), pa.list_(pa.float64()))], ["id", "p"])

    total = data.count()
    sample = data if total <= SAMPLE else data.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(0.9 * SAMPLE / total * (1 << 40)))
    fitted = [r.p for r in sample.limit(SAMPLE).mapInArrow(points, "id long, p array<double>").select("p").collect()]
    tree = grow(np.array(fitted) if fitted else np.zeros((0, PROJECTED)), min(CELLS, max(1, -(-total // BLOCK))))
    factor = chi_square_quantile(PROJECTED, confidence)

    def place(batches):
        for b in batches:
            for dim, rows, x in _by_dim(b, "v"):
                p = project(x)
                out = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([out.column("id"), out.column("v"), pa.array(cell_of(tree, p).astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))], ["id", "v", "cell", "p"])

    placed = _io.cut(data.mapInArrow(place, "id long, v array<double>, cell int, p array<double>"))
    ends = [f(F.element_at("p", i + 1)).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(PROJECTED)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect()  # a row for each of at most CELLS cells
    cells = np.array([r.cell for r in boxes], np.int64)
    low = np.array([[r[f"lo{i}"] for i in range(PROJECTED)] for r in boxes]).reshape(-1, PROJECTED)
    high = np.array([[r[f"hi{i}"] for i in range(PROJECTED)] for r in boxes]).reshape(-1, PROJECTED)
    blocks = {int(r.cell): -(-r.n // BLOCK) for r in boxes}
    kinds = "cell int, block int, ask int, id long, v array<double>, bound double"

    def dealt(batches):
        for b in batches:
            c, i = b.column("cell").to_numpy(), b.column("id").to_numpy()
            n = np.array([blocks[x] for x in c.tolist()], np.int64)
            zero = np.zeros(len(c), np.int32)
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array((_vec.mix(i.astype(np.uint64)) % n.astype(np.uint64)).astype(np.int32)), pa.array(zero), b.column("id"), b.column("v"), pa.array(np.zeros(len(c)))], ["cell", "block", "ask", "id", "v", "bound"])

    def sent(batches, home: bool):
        """Query rows for each block of the cells to visit."""
        for b in batches:
            own, ids = b.column("cell").to_numpy(), b.column("id").to_numpy()
            p = _matrix(b.column("p"), PROJECTED)
            bound = None if home else b.column("bound").to_numpy(zero_copy_only=False)
            rows, to, part = [], [], []
            for r in range(b.num_rows):
                if home:
                    go = [int(own[r])]
                else:
                    away = np.maximum(np.maximum(low - p[r], p[r] - high), 0)
                    limit = bound[r] ** 2 * factor + 1e-9 * (1 + float(p[r] @ p[r]))
                    go = [int(x) for x in cells[((away * away).sum(axis=1) <= limit) & (cells != own[r])]]
                for c in go:
                    for k_ in range(blocks[c]):
                        rows.append(r)
                        to.append(c)
                        part.append(k_)
            at = pa.array(rows, pa.int64())
            far = pa.array(np.full(len(rows), np.inf) if home else bound[rows] if rows else np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(part, pa.int32()), pa.array(np.ones(len(rows), np.int32)), b.column("id").take(at), b.column("v").take(at), far], ["cell", "block", "ask", "id", "v", "bound"])

    def search(batches):
        """Blocks stream by: first a block's vectors, then its queries one batch after the other."""
        now, held, built = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            c, s, ask = (b.column(x).to_numpy() for x in ("cell", "block", "ask"))
            edge = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (s[1:] != s[:-1]) | (ask[1:] != ask[:-1])]).tolist()
            for lo, hi in zip(edge, [*edge[1:], len(c)]):
                if now != (c[lo], s[lo]):
                    now, held, built = (c[lo], s[lo]), [], None
                part = b.slice(lo, hi - lo)
                if not ask[lo]:
                    held.append(part)
                    continue
                if built is None:
                    built = {}
                    for x in held:
                        for dim, rows, v in _by_dim(x, "v"):
                            built.setdefault(dim, []).append((x.column("id").to_numpy()[rows], v))
                    built = {d: Block(np.concatenate([i for i, _ in xs]), np.concatenate([v for _, v in xs])) for d, xs in built.items()}
                out = ([], [], [])
                ids, bound = part.column("id").to_numpy(), part.column("bound").to_numpy()
                for dim, rows, v in _by_dim(part, "v"):
                    if dim in built:
                        for r, q in zip(rows, v):
                            got, dist = built[dim].nearest(int(ids[r]), q, k, float(bound[r]), factor)
                            out[0].append(np.full(len(got), ids[r]))
                            out[1].append(got)
                            out[2].append(dist)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    queries = placed.where(query_rows)
    stored = placed.mapInArrow(dealt, kinds)

    def searched(asks: DataFrame) -> DataFrame:
        both = stored.unionByName(asks).repartition("cell", "block").sortWithinPartitions("cell", "block", "ask")
        return both.mapInArrow(search, "query_id long, vec_id long, score double")

    once = lambda found: found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    first = _io.cut(searched(queries.mapInArrow(lambda it: sent(it, True), kinds)))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    kth = once(first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("known"), F.col("score").alias("bound"))
    ask = queries.join(kth, queries["id"] == kth["known"], "left").select("id", "v", "cell", "p", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    second = searched(ask.mapInArrow(lambda it: sent(it, False), kinds))
    ranked = once(first.unionByName(second)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
