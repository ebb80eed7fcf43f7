"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt into blocks; each pair of blocks is one task. A block of candidates is turned to
its principal axes once. The axes of largest variance each have a list, the candidates sorted by that coordinate;
one more list has them sorted by the length of what these axes leave. A query walks the lists in parallel, downwards
for positive coordinates and upwards for negative ones, scores each candidate that it meets in full, and stops when
the sum over the list heads (for the last list, by Cauchy and Schwarz) can't beat its k-th score. Where vectors are
spread evenly over many dimensions no such sum falls fast enough; then the rest of the block is bounded candidate by
candidate, over more and more axes plus what they leave, and only those whose bound reaches the k-th score are scored
in full. The blocks' winners are ranked at the end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a block of candidates and of queries, on average.
CANDIDATES = 16384
QUERIES = 16384
#: Axes with a list.
LISTS = 8
#: Depth of the first step into the lists; each further step goes four times as deep.
DEPTH = 16
#: Share of a block that a query meets in its lists before the rest is bounded one by one.
MET = 0.03


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


class Block:
    """Candidates with integer components, their principal axes and sorted lists; counts the scores it computes."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, largest_query: int, lists: int = LISTS):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.scored = 0
        d = rows.shape[1]
        # exact either way
        self.kind = np.float64 if float(np.abs(rows).max(initial=0)) * largest_query * d < 2**53 else np.int64
        self.rows, real = rows.astype(self.kind), rows.astype(np.float64)
        _, axes = np.linalg.eigh(real.T @ real)
        self.axes = axes[:, ::-1]
        self.turned = np.ascontiguousarray((real @ self.axes).T)
        # after how many axes candidates are bounded, and the length of what is left of each
        self.listed = min(d, lists)
        self.stops = sorted({self.listed} | {s for s in (d // 2, 3 * d // 4, 7 * d // 8) if s > self.listed})
        left = np.maximum(0, (real**2).sum(1) - np.cumsum(self.turned**2, 0)[np.array(self.stops) - 1])
        self.left = np.sqrt(left)
        self.longest = float(np.sqrt((real**2).sum(1).max(initial=0)))
        self.lists = np.argsort(self.turned[: self.listed], axis=1, kind="stable")
        self.heads = np.take_along_axis(self.turned[: self.listed], self.lists, 1)
        self.by_left = np.argsort(-self.left[0], kind="stable")

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to the smaller id."""
        n, m = len(self.ids), self.listed
        real = query.astype(np.float64)
        q, exact = real @ self.axes, query.astype(self.kind)
        # of the query, what the axes up to each stop leave
        own_left = np.sqrt(np.maximum(0, (real**2).sum() - np.cumsum(q**2)[np.array(self.stops) - 1]))
        slack = 1e-9 * self.longest * float(np.sqrt((real**2).sum())) + 1e-6
        seen = self.ids == query_id
        best, scores = np.empty(0, np.int64), np.empty(0, self.kind)

        def score(new: np.ndarray) -> None:
            nonlocal best, scores
            seen[new] = True
            self.scored += len(new)
            best, scores = np.concatenate((best, new)), np.concatenate((scores, self.rows[new] @ exact))
            if len(best) > k:
                near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                near = near[np.lexsort((best[near], -scores[near]))[:k]]
                best, scores = best[near], scores[near]

        up, down = np.flatnonzero(q[:m] < 0), np.flatnonzero(q[:m] >= 0)
        depth, met = DEPTH, 0
        while met < MET * n:
            depth = min(n, depth)
            found = np.concatenate((self.lists[up, :depth].ravel(), self.lists[down, n - depth :].ravel(), self.by_left[:depth]))
            found = np.unique(found)
            met = len(found)
            score(found[~seen[found]])
            # what no list has shown yet
            bound = q[up] @ self.heads[up, depth - 1] + q[down] @ self.heads[down, n - depth] + own_left[0] * self.left[0][self.by_left[depth - 1]]
            if depth == n or len(best) == k and bound < scores[-1] - slack:
                return self.ids[best], scores
            depth *= 4
        rest, part, done = np.flatnonzero(~seen), None, 0
        for i, stop in enumerate(self.stops):
            step = q[done:stop] @ (self.turned[done:stop] if len(rest) == n else self.turned[done:stop, rest])
            part, done = step if part is None else part + step, stop
            if len(best) == k:
                may = part + own_left[i] * self.left[i][rest] >= scores[-1] - slack
                rest, part = rest[may], part[may]
        # best first, so that the k-th score rises early
        rest = rest[np.argsort(-part, kind="stable")]
        score(rest)
        order = np.lexsort((best, -scores))[:k]
        return self.ids[best[order]], scores[order]


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k highest integer inner products, ties to the smaller id.

    A component x counts as floor(scale * x). Vectors that are null, empty, or hold null or non-finite components,
    and rows without an id, take no part; vectors of different dimension don't meet. Rows that repeat an id are one
    vector, the smallest of theirs. A query isn't its own candidate.
    """
    v = F.col(vector_col)
    rows = vectors.where(usable(v) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(v).alias("v"))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.size("v").alias("d"))
    ids = vectors.select(F.col(id_col).alias("id"))
    blocks = max(1, -(-ids.count() // CANDIDATES))
    query_blocks = max(1, -(-ids.where(is_query(F.col("id"))).count() // QUERIES))
    asked = rows.where(is_query(F.col("id")))
    # each block of candidates meets each block of queries
    side = rows.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asking = asked.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            d = left.column("d")[0].as_py()
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            queries = matrix(right)
            block = Block(left.column("id").to_numpy(), matrix(left), int(np.abs(queries).max(initial=0)))
            for query_id, query in zip(right.column("id").to_pylist(), queries):
                out += [(query_id, int(i), int(s)) for i, s in zip(*block.search(query_id, query, k))]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    keys = ["d", "cb", "qb"]
    found = side.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
