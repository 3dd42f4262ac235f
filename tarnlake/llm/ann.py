"""Approximate nearest neighbours: a hash-prefix forest over shards of the index.

Each shard of the vectors has ``TREES`` trees; a tree is a sorted array of ``BITS``-bit hash strings
(signs of random projections, leading bits first), so vectors that share a prefix stand next to each
other. A query descends each tree to its longest matching prefix; then all trees ascend at once, a
level at a time, until the prefixes together hold enough candidates (``SHARE`` of the shard, counted
in all trees, and at least ``LEAST`` for each neighbour asked for). All candidates of that level are
scored by the exact inner product; none is cut.

How much a forest can leave out is a matter of the vectors: of unit vectors without structure in 64
dimensions, whose nearest ones stand at a cosine of 0.4, it must look at a third for a recall over 0.9
whatever the number of rows, and every shard holds some. So all queries go to all shards, and what is
shipped is the queries times the number of shards.

For the largest inner product, vectors are hashed with one more coordinate that makes their norms
equal, which turns it into the smallest angle; scores are of the original vectors.

Shards and blocks of queries have bounded size, and each pair of them is one task, so no task or
broadcast grows with the table. Rows are dealt by a hash of their id; a vector that a third of the
rows repeat is spread over all shards. The trees' projections depend on a seed only, not on data.

Defined results: null vectors, zero ones, those holding null or non-finite components, those of
another length than most, and rows without an id take no part; of rows with one id the smallest
vector counts; fewer candidates than asked for are all returned; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS = 96, 32
SHARE, LEAST = 0.65, 10
SHARD_ROWS, BLOCK_ROWS = 16384, 16384
NEAREST = 20
SEED = 20


def projections(dims: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims + 1, TREES * BITS))


def strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings (trees, rows) as numbers, first bit highest."""
    out = np.zeros((TREES, len(vectors)), dtype=np.uint32)
    for t in range(TREES):
        bits = vectors @ planes[:, t * BITS : (t + 1) * BITS] > 0
        out[t] = np.packbits(bits, axis=1).view(">u4").ravel()
    return out


def _with_norm(vectors: np.ndarray, longest: float) -> np.ndarray:
    scaled = vectors / longest
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))[:, None]])


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, k: int = NEAREST) -> None:
        self.ids, self.vectors = ids, vectors
        self.planes = projections(vectors.shape[1])
        own = strings(_with_norm(vectors, longest), self.planes)
        self.order = np.argsort(own, axis=1, kind="stable")
        self.sorted = np.take_along_axis(own, self.order, 1)
        self.enough = min(TREES * len(ids), max(LEAST * k, int(np.ceil(SHARE * len(ids)))))

    def _ranges(self, marks: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each tree the stretch that shares a query's first ``levels`` bits."""
        free = np.uint64(BITS) - levels.astype(np.uint64)
        low = (marks.astype(np.uint64) >> free) << free
        high = low + (np.uint64(1) << free)
        lo, hi = np.empty(marks.shape, dtype=np.int64), np.empty(marks.shape, dtype=np.int64)
        for t in range(TREES):
            lo[t] = np.searchsorted(self.sorted[t], low[t].astype(np.uint32), "left")
            hi[t] = np.searchsorted(self.sorted[t], (high[t] - np.uint64(1)).astype(np.uint32), "right")
        return lo, hi

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (ids, scores) of the k best candidates, nearest first."""
        norms = np.sqrt((queries * queries).sum(1, keepdims=True))
        marks = strings(np.hstack([queries / norms, np.zeros((len(queries), 1))]), self.planes)
        # the deepest level, the same in all trees, whose prefixes together hold enough: counts only grow going up
        low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), BITS)
        while (low < high).any():
            middle = (low + high + 1) // 2
            lo, hi = self._ranges(marks, middle)
            holds = (hi - lo).sum(0) >= self.enough
            low, high = np.where(holds, middle, low), np.where(holds, high, middle - 1)
        lo, hi = self._ranges(marks, low)
        out = []
        flat, first = self.order.ravel(), np.arange(TREES) * len(self.ids)
        short, short_queries = self.vectors.astype(np.float32), queries.astype(np.float32)
        # what single precision may be off by, doubled
        slack = 4e-7 * self.vectors.shape[1] * norms[:, 0] * np.sqrt((self.vectors * self.vectors).sum(1).max())
        for q in range(len(queries)):
            n = hi[:, q] - lo[:, q]
            at = np.repeat(first + lo[:, q] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mark = np.zeros(len(self.ids), dtype=bool)
            mark[flat[at]] = True
            mark &= self.ids != own[q]
            rows = np.flatnonzero(mark)
            near = short[rows] @ short_queries[q]
            if len(rows) > k:
                limit = np.partition(near, len(near) - k)[len(near) - k]
                rows = rows[near >= limit - slack[q]]
            # summed in the order of the components, the same wherever a pair is met
            score = np.cumsum(self.vectors[rows] * queries[q], axis=1)[:, -1]
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append((self.ids[rows[best]], score[best]))
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select("vec_id", x.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id ``every`` divides."""
    rows = usable(vectors)
    about = rows.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("top")).orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, vec_id long, score double"
    if about is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == about["dims"])
    shards = max(1, -(-about["n"] // SHARD_ROWS))
    blocks = max(1, -(-about["n"] // (every * BLOCK_ROWS)))
    longest = float(np.sqrt(about["top"]))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    index = rows.select(deal(shards, 1).alias("shard"), F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"), "vec_id", "v")
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.explode(F.expr(f"sequence(0, {shards - 1})")).alias("shard"), deal(blocks, 2).alias("block"), "vec_id", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("vec_id")
        forest = Forest(left["vec_id"].to_numpy(), np.array(left["v"].tolist(), dtype=np.float64), longest, k)
        own = right["vec_id"].to_numpy()
        found = forest.search(np.array(right["v"].tolist(), dtype=np.float64), own, k)
        return pd.DataFrame({"query_id": np.repeat(own, [len(f[0]) for f in found]), "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found])})

    found = index.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
