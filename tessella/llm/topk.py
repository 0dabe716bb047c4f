"""Exact top-k inner products over an impact-ordered index.

Vectors become integers. A block of vectors is indexed by dimension: the components are
quantised to LEVELS levels, and the vectors of a level form a posting segment.

With any a > 0, q.x = (a |q|^2 + |x|^2 / a - sum over dimensions of (sqrt(a) q - x / sqrt(a))^2) / 2.
So the sum without its last term bounds a score from above, and each posting read lowers its
vector's bound by its own term. A segment's impact for a query is the least term that its
level allows. Segments of all dimensions are read by descending impact, in rounds, into
one array of bounds; a is the ratio of the block's mean length to the query's.

After a round the most promising vectors are scored exactly; the k-th best of them, or of
an earlier block, is a line that a member must reach. Reading stops once the bounds prove
that at most a share FEW of the vectors can reach it; those are scored again exactly. If
the proof never comes, everything is read: the result is exact either way.

Queries and vectors meet in pairs of blocks of bounded size, each a packed row. Of a block of vectors and
the blocks of queries that meet it in a task, the first one is indexed once and the others follow, so a
task holds one block of each, and a query's partial results are k rows for a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

LEVELS = 256
BLOCK = 8192
QUERY_BLOCK = 512
#: Share of the root of a query's greatest impact down to which each round reads.
ROUNDS = (0.35, 0.27, 0.23, 0.2, 0.17, 0.14, 0.1, 0.05, 0.0)
FEW = 1 / 8
SPREAD = 8  # tasks over which the queries of one block of vectors are spread


class Index:
    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: int = LEVELS):
        if not x.shape[1]:
            x = np.zeros((len(x), 1), np.int64)
        self.ids, self.x, self.read = ids, x, 0
        self.low, high = x.min(axis=0), x.max(axis=0)
        self.width = np.maximum(1, -(-(high - self.low + 1) // levels))
        level = (x - self.low) // self.width
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        self.value = np.take_along_axis(x.T, self.order, axis=1).astype(np.float64)
        self.starts = np.array([np.searchsorted(level[self.order[d], d], np.arange(levels + 1)) for d in range(x.shape[1])])
        self.square = (x.astype(np.float64) ** 2).sum(axis=1)
        self.top = np.maximum(np.abs(self.low), np.abs(high))

    def search(self, query_id: int, q: np.ndarray, k: int, line: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best, without the query's own id and without those
        below line, and at least k of those that reach it, if there are so many."""
        n, dims = self.x.shape
        q = np.pad(q, (0, dims - len(q)))
        others = self.ids != query_id
        k = min(k, int(others.sum()))
        if not k:
            return self.ids[:0], self.ids[:0]
        own = float((q.astype(np.float64) ** 2).sum())
        a = float(np.sqrt(self.square.mean() / own)) if own and self.square.any() else 1.0
        at_q = a * q.astype(np.float64)  # the terms are (at_q - x) ** 2 / a
        far = (np.abs(at_q) + self.top).max()
        bound = (a * own + self.square / a) / 2
        levels = self.starts.shape[1] - 1
        left, right = np.zeros(dims, np.int64), np.full(dims, n, np.int64)  # what is not read yet, by dimension
        for share in ROUNDS:
            # Levels that lie at least so far from the query, below and above.
            below = np.clip(np.floor((at_q - share * far - self.low + 1) / self.width), 0, levels).astype(np.int64)
            above = np.clip(np.ceil((at_q + share * far - self.low) / self.width), 0, levels).astype(np.int64)
            ends = np.take_along_axis(self.starts, below[:, None], axis=1)[:, 0]
            begins = np.take_along_axis(self.starts, above[:, None], axis=1)[:, 0]
            ids, terms = [], []
            for d in range(dims):
                lo, hi = max(int(ends[d]), int(left[d])), min(int(begins[d]), int(right[d]))
                if share == 0.0 or hi < lo:
                    lo = hi = int(right[d])
                for part in (slice(left[d], lo), slice(hi, right[d])):
                    if part.stop > part.start:
                        ids.append(self.order[d][part])
                        terms.append((self.value[d][part] - at_q[d]) ** 2)
                left[d], right[d] = lo, hi
            if ids:
                i = np.concatenate(ids)
                self.read += len(i)
                bound -= np.bincount(i, np.concatenate(terms), minlength=n) / (2 * a)
            near = np.argpartition(np.where(others, -bound, np.inf), min(4 * k, n) - 1)[: 4 * k]
            near = near[others[near]]
            line = max(line, float(np.partition(self.x[near] @ q, -k)[-k]) if len(near) >= k else -np.inf)
            possible = others & (bound + 1e-9 * (np.abs(bound) + a * own + self.square / a) + 1e-6 >= line)
            if possible.sum() <= max(4 * k, FEW * n):
                break
        at = np.flatnonzero(possible)
        exact = self.x[at] @ q
        at, exact = at[exact >= line], exact[exact >= line]
        if len(at) > k:  # ties with the last one stay for the order by id
            last = np.partition(exact, -k)[-k]
            at, exact = at[exact >= last], exact[exact >= last]
        order = np.lexsort((self.ids[at], -exact))[:k]
        return self.ids[at][order], exact[order]


def scaled(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def _packed(rows: DataFrame, name: str, blocks: int, salt: int) -> DataFrame:
    def run(key: tuple[Any, ...], b: pd.DataFrame) -> pd.DataFrame:
        dims = max(map(len, b["v"]), default=0)
        x = np.zeros((len(b), dims), np.int64)
        for i, v in enumerate(b["v"]):
            x[i, : len(v)] = v
        small = x.size == 0 or np.abs(x).max() < 2**31 - 1
        return pd.DataFrame({name: [int(key[0])], "ids": [b["id"].to_numpy(np.int64).tobytes()], "x": [x.astype(np.int32 if small else np.int64).tobytes()], "dims": [dims], "wide": [not small]})

    return rows.withColumn(name, F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(blocks))).groupBy(name).applyInPandas(run, f"{name} long, ids binary, x binary, dims int, wide boolean")


def _unpacked(ids: bytes, x: bytes, dims: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, np.int64 if wide else np.int32).astype(np.int64).reshape(len(i), dims)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, *, scale: float = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, id and score of the k best of every query; ``queries`` is the
    condition under which a row is one.

    Vectors that are null, or hold null or non-finite components, and rows without an
    id take no part; a shorter vector counts as filled up with zeros, so one without
    components scores 0. Ties go to the smaller id. Rows with a query's own id are not its
    candidates; repeated rows are candidates each for others, and one query; of different
    vectors under one id, the least asks. Fewer than k candidates are all returned; an
    empty table gives an empty result; other columns are not read. Scores are exact below
    2 ** 53."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"), F.coalesce(queries, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("raw"))).select("id", scaled(F.col("raw"), scale).alias("v"), "q")
    rows = table(rows)
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    vb, qb = max(1, -(-n // block)), max(1, -(-m // query_block))
    spread = min(SPREAD, qb)
    # A block stands before the query blocks that meet it, once for each of the tasks that share them.
    left = _packed(rows.drop("q"), "vb", vb, 1).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).withColumn("qb", F.lit(-1).cast("long"))
    right = _packed(asked, "qb", qb, 2).withColumn("share", (F.col("qb") % spread).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vb - 1)))).withColumn("vb", F.col("vb").cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, at, lines = None, None, {}
        for b in batches:
            for r in b.itertuples(index=False):
                if r.qb < 0:
                    index, at = Index(*_unpacked(r.ids, r.x, r.dims, r.wide)), r.vb
                    continue
                if at != r.vb:  # a block without vectors
                    continue
                qids, q = _unpacked(r.ids, r.x, r.dims, r.wide)
                dims, out = index.x.shape[1], []
                for i, v in zip(qids.tolist(), q, strict=True):
                    got, score = index.search(i, v[:dims], k, lines.get(i, -np.inf))
                    if len(got) == k:
                        lines[i] = max(lines.get(i, -np.inf), float(score[-1]))
                    out.append(pd.DataFrame({"query_id": np.full(len(got), i), "id": got, "score": score}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    units = left.unionByName(right).repartition("vb", "share").sortWithinPartitions("vb", "share", "qb")
    parts = units.mapInPandas(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
