"""Exact top-k search by integer inner product, by columnar branch and bound.

Candidates are held in vertical layout, a row for each dimension.  Scores accumulate block of dimensions by block; after
each block a candidate whose score so far, plus the product of what the query and it have left (norms of the remaining
dimensions, by Cauchy and Schwarz), is below the k-th best score known is dropped, and the survivors are compacted.
Bounds are widened for rounding and a tie survives, so the result is exact.

Queries are sent out in blocks of a fixed size in bytes; each block is one pass over all candidates, whose partitions
keep k rows for each query, and the best of these are ranked in Spark.  Of several blocks one at a time is held by the
driver and the tasks: its k rows for each query are written to the shared folder before the next one is sent.

Cases: vectors that are null, empty or hold null or non-finite components take no part; a vector is compared with those
of its own length; equal scores rank by the smaller id; repeated rows are candidates each, a repeated query counts
once; fewer candidates than k give fewer rows; an empty table gives an empty result.  Scores are exact while every
product and sum stays within a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.plans.lineage import written

#: Bytes of query components sent to the tasks at once; dimensions in a block; candidates handled at once.
QUERY_BYTES, BLOCK, CANDIDATES = 16 << 20, 16, 4096
_NONE = np.iinfo(np.int64).min


def quantised(column: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null for a vector that takes no part."""
    fit = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size(column) > 0)
    return F.when(fit, F.transform(column, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _matrix(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (rows, matrix of those rows) of a list column."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values, dtype=np.int64)
    size = np.diff(offsets)
    return {int(n): (rows := np.flatnonzero(size == n), values[offsets[rows][:, None] + np.arange(n)]) for n in np.unique(size)}


class _Block:
    """Queries of one length, and the best candidates met so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.scores = np.full((len(ids), k), _NONE)
        self.found = np.zeros((len(ids), k), np.int64)
        self.count = np.zeros(len(ids), np.int64)
        self.cuts = [*range(0, vectors.shape[1], BLOCK), vectors.shape[1]]
        self.rest = self._rest(vectors.T)
        self.most = float(np.abs(vectors).max(initial=0))

    def _rest(self, columns: np.ndarray) -> np.ndarray:
        """Norm of what remains behind each block, for each vector."""
        squares = columns.astype(np.float64) ** 2
        return np.sqrt(np.stack([squares[c:].sum(axis=0) for c in self.cuts]))

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        columns = np.ascontiguousarray(vectors.T)
        exact = self.most * float(np.abs(columns).max(initial=0)) * max(1, len(columns)) < 2**53
        columns = columns.astype(np.float64) if exact else columns  # float sums of such integers are exact, and faster
        rest = self._rest(columns)
        for q in range(len(self.ids)):
            alive = np.flatnonzero(ids != self.ids[q])
            held, score = columns if len(alive) == len(ids) else columns[:, alive], np.zeros(len(alive), columns.dtype)
            query = self.vectors[q].astype(columns.dtype)
            for b, (x, y) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
                score = score + query[x:y] @ held[x:y]
                if self.count[q] == self.k and b + 2 < len(self.cuts):
                    bound = score + self.rest[b + 1, q] * rest[b + 1, alive] * (1 + 1e-9) + 1
                    keep = bound >= self.scores[q, -1]
                    if keep.sum() < 0.7 * len(keep):
                        alive, held, score = alive[keep], held[:, keep], score[keep]
            self._take(q, ids[alive], score.astype(np.int64))

    def _take(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        if self.count[q] == self.k:
            keep = score >= self.scores[q, -1]
            ids, score = ids[keep], score[keep]
        if len(score) > 4 * self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            ids, score = ids[score >= least], score[score >= least]
        n = self.count[q]
        ids, score = np.concatenate([self.found[q, :n], ids]), np.concatenate([self.scores[q, :n], score])
        best = np.lexsort((ids, -score))[: self.k]
        self.count[q] = len(best)
        self.found[q, : len(best)], self.scores[q, : len(best)] = ids[best], score[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row that is a query."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vector_col]).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("v is not null and vec_id is not null")
    queries = rows.filter("q").select("vec_id", "v").dropDuplicates(["vec_id"])
    size = queries.agg(F.sum(F.size("v") * 8 + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))

    def search(number: int) -> tuple[DataFrame, Broadcast]:
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()  # about query_bytes
        by_size: dict[int, list] = {}
        for r in mine:
            by_size.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        shared = spark.sparkContext.broadcast({n: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for n, x in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {n: _Block(ids, v, k) for n, (ids, v) in shared.value.items()}
            for batch in batches:
                keys = np.asarray(batch.column(0))
                for n, (at, matrix) in _matrix(batch.column(1)).items():
                    for x in range(0, len(at) if n in held else 0, CANDIDATES):
                        held[n].offer(keys[at[x : x + CANDIDATES]], matrix[x : x + CANDIDATES])
            for b in held.values():
                used = np.arange(b.k) < b.count[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, b.count)), pa.array(b.found[used]), pa.array(b.scores[used])], ["query_id", "vec_id", "score"])

        found = rows.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score"), shared

    if blocks == 1:
        return search(0)[0]
    done = []
    for number in range(blocks):
        ranked, shared = search(number)
        done.append(written(ranked))
        shared.destroy()  # nothing reads the block again
    return reduce(DataFrame.unionByName, done)
