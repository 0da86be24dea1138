"""Operator 4: exact top-k inner products with a KD-tree per shard.

Vectors are dealt into shards of about ``SHARD_ROWS`` rows and queries into
blocks of about ``BLOCK_ROWS``; a task holds one shard and one block.  The
shard's tree splits at the median of the widest component; every node keeps the
tight box of its vectors.  The sum over components of the greater of q*lo and
q*hi bounds every inner product in a box, so a best-first walk from the root
stops at the first box under the k-th score.  A query first searches the shard
its own row is in; the k-th score found there is propagated to its searches of
all other shards.

Ties go to the smaller vec_id (a box that only equals the k-th score is still
opened).  Rows without an id, and vectors that are null or hold null or
non-finite components, take no part.  Where ids repeat every row is a candidate
of its own for all other ids, none for its own id, and the queries of one id are
ranked together (equal rows are carried once and counted, up to k times, which is
all that k places can show).  Vectors of different lengths are not compared;
empty vectors score 0 with each other.  Fewer candidates than k give all of
them; an empty table gives an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 4096, 64
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    fit = lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))  # noqa: E731  NaN is above infinity here
    return F.when(F.forall(vector, fit), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Tree:
    """A KD-tree in arrays: rows ``start`` to ``end`` of ``order`` are under a node."""

    def __init__(self, x: np.ndarray):
        order = np.arange(len(x))
        start, end, child = [0], [len(x)], []
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            rows = order[a:b]
            width = np.ptp(x[rows], axis=0) if b - a > LEAF_ROWS else np.zeros(0)
            if width.size and width.max() > 0:
                mid = (b - a) // 2
                order[a:b] = rows[np.argpartition(x[rows, int(width.argmax())], mid)]
                child.append(len(start))
                start += [a, a + mid]
                end += [a + mid, b]
            else:
                child.append(-1)
            at += 1
        self.order, self.start, self.end, self.child = order, start, end, child
        sorted_x = x[order]
        self.x = sorted_x
        self.lo = np.stack([sorted_x[a:b].min(0) for a, b in zip(start, end, strict=True)])
        self.hi = np.stack([sorted_x[a:b].max(0) for a, b in zip(start, end, strict=True)])


def exact_kind(x: np.ndarray, q: np.ndarray) -> type:
    """Floats where no sum can pass 2**53, else whole numbers (slower)."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    return np.float64 if top < 2**53 else np.int64


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, own: int, bounds: np.ndarray, kth: int | None, k: int) -> list[tuple[int, int]]:
    """Up to k (score, vec_id), best first; none below ``kth``, none with id ``own``."""
    best: list[tuple[int, int]] = []  # heap of (score, -id): its top is the worst kept
    heap = [(-bounds[0], 0)]
    while heap:
        bound, node = heapq.heappop(heap)
        if kth is not None and -bound < kth:
            break
        left = tree.child[node]
        if left >= 0:
            for c in (left, left + 1):
                if kth is None or bounds[c] >= kth:
                    heapq.heappush(heap, (-bounds[c], c))
            continue
        a, b = tree.start[node], tree.end[node]
        scores = tree.x[a:b] @ q
        near = np.flatnonzero(scores >= kth) if kth is not None else np.arange(b - a)
        for score, i in zip(scores[near].tolist(), ids[a:b][near].tolist(), strict=True):
            if i == own:
                continue
            if len(best) < k:
                heapq.heappush(best, (int(score), -i))
            elif (int(score), -i) > best[0]:
                heapq.heapreplace(best, (int(score), -i))
        if len(best) == k:
            kth = best[0][0] if kth is None else max(kth, best[0][0])
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0), np.int64)


def _searcher(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if queries.num_rows and vectors.num_rows:
            x, q = _matrix(vectors, "x"), _matrix(queries, "q")
            kind = exact_kind(x, q)
            tree = Tree(x.astype(kind))
            ids = vectors.column("vec_id").to_numpy()[tree.order]
            q = q.astype(kind)
            bounds = np.maximum(q, 0) @ tree.hi.T + np.minimum(q, 0) @ tree.lo.T
            asked = zip(*(queries.column(c).to_pylist() for c in ("query_id", "kth", "times")), strict=True)
            for row, (own, kth, times) in enumerate(asked):
                for score, i in search(tree, ids, q[row], own, bounds[row], kth, k) * times:
                    for column, value in zip(out, (own, i, score), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for every row where ``is_query``.

    ``vectors``: vec_id, embedding.  Queries against all rows, in blocks: the work
    is their product, each task's memory is one shard and one block."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("v"), is_query.alias("_q"))
    rows = rows.filter("vec_id is not null and v is not null").groupBy("vec_id", "v")
    rows = rows.agg(F.max("_q").alias("_q"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    n, n_queries = rows.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.when(F.col("_q"), 1))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    rows = rows.select("vec_id", "v", "_q", "times", F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"))
    queries = rows.filter("_q").select(F.col("vec_id").alias("query_id"), "v", "times", "dim", F.col("shard").alias("home"), F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks)).alias("block"))
    base = rows.select("vec_id", "v", "dim", "shard", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_copy")).drop("_copy")

    def searched(asked: DataFrame) -> DataFrame:
        # names of its own on either side: both come from the same rows
        spread = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        spread = spread.select("vec_id", F.col("v").alias("x"), F.col("dim").alias("_dim"), F.col("shard").alias("_shard"), F.col("block").alias("_block"))
        asked = asked.select("query_id", "kth", "times", F.col("v").alias("q"), F.col("dim").alias("dim_"), F.col("shard").alias("shard_"), F.col("block").alias("block_"))
        return asked.groupBy("dim_", "shard_", "block_").cogroup(spread.groupBy("_dim", "_shard", "_block")).applyInArrow(_searcher(k), FOUND)

    at_home = searched(queries.withColumn("shard", F.col("home")).withColumn("kth", F.lit(None).cast("long")))
    if shards > 1:
        kth = at_home.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")), lambda s: s != F.col("home"))
        asked = queries.join(kth, "query_id", "left").withColumn("shard", F.explode(others))
        at_home = at_home.unionByName(searched(asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return at_home.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
