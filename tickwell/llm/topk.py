"""Exact top-k inner products: Fagin's threshold algorithm over sorted per-dimension lists.

Tasks read the candidates as they lie, ``BLOCK_ROWS`` at a time, and carry each query's best rows
from block to block. A block is turned into the basis of its own principal axes, where long lists
are told apart by few dimensions, and gets a sorted list for each axis. A query reads the lists of
the first axes, list d from the top where its weight is positive and from the bottom where it is
negative. After g rows of m lists, no row that was not met can score more than the weighted sum of
the next values of these lists and what the other axes can add at most (their heads, or the
product of the longest lengths left there). The query takes the m and g that stop soonest, where that bound,
with a margin for rounding, is below its kth score so far, and scores the rows it has met by
integer products. Where the lists would meet about all rows before that, the block is scored by one
product for all such queries.

In many dimensions without structure no bound cuts: on vectors drawn evenly from a sphere of 64
dimensions every row is scored. ``search`` tells how many rows were scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickwell.llm.work import stored, table

#: Candidates in a block: what one task holds at a time, besides the queries and their best rows.
BLOCK_ROWS = 8192
#: Queries that travel to the tasks at a time; for more of them the candidates are read again.
QUERY_ROWS = 16_384
#: Rows read of each list before the bound is looked at.
DEPTHS = (0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
_SEED = 256
_PRODUCT = 1 << 22


@dataclass
class Best:
    """The best rows so far of each of ``queries`` (n, dims): scores descending, equal ones by id; -1 in ``found`` where there are fewer."""

    queries: np.ndarray
    k: int
    scored: int = 0
    score: np.ndarray = field(init=False)
    found: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        shape = (len(self.queries), self.k)
        self.score, self.ids, self.found = np.full(shape, -np.iinfo(np.int64).max), np.zeros(shape, np.int64), np.full(shape, -1, np.int8)

    def add(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows (ids ascending) and their scores (len(at), len(ids)) for the queries at ``at``."""
        self.scored += score.size
        if score.shape[1] > self.k:
            most = np.abs(score).max(initial=0)
            n = score.shape[1]
            if most < (1 << 62) // n:  # equal scores are told apart by place
                top = np.argpartition(score * n - np.arange(n), n - self.k, axis=1)[:, n - self.k :]
            else:
                top = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        else:
            top = np.broadcast_to(np.arange(score.shape[1]), score.shape)
        score = np.concatenate((self.score[at], np.take_along_axis(score, top, axis=1)), axis=1)
        found = np.concatenate((self.found[at], np.zeros(top.shape, np.int8)), axis=1)
        all_ids = np.concatenate((self.ids[at], ids[top]), axis=1)
        order = np.lexsort((all_ids, -score, -found), axis=1)[:, : self.k]
        self.score[at], self.ids[at], self.found[at] = (np.take_along_axis(x, order, axis=1) for x in (score, all_ids, found))

    def kth(self) -> np.ndarray:
        """The kth score of each query; minus infinity where there are fewer rows."""
        return np.where(self.found[:, -1] >= 0, self.score[:, -1].astype(float), -np.inf)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact; beyond 64 bits they wrap."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64) if most < 2**53 else queries @ vectors.T


def search(vectors: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Lets the rows of a block compete for the places of ``best``, by the threshold algorithm."""
    order = np.argsort(ids, kind="stable")
    vectors, ids, every = vectors[order], ids[order], np.arange(len(best.queries))

    def scan(at: np.ndarray, rows: slice) -> None:
        step = max(1, _PRODUCT // max(1, len(ids[rows])))
        for a in range(0, len(at), step):
            best.add(at[a : a + step], ids[rows], products(best.queries[at[a : a + step]], vectors[rows]))

    if not np.isfinite(best.kth()).all():  # a kth score to begin with
        scan(every, slice(0, _SEED))
        vectors, ids = vectors[_SEED:], ids[_SEED:]
    n, dims = vectors.shape
    if not n:
        return
    x = vectors.astype(float)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    x, weights = x @ axes, best.queries.astype(float) @ axes
    lists = np.argsort(x, axis=0, kind="stable")
    ranked = np.take_along_axis(x, lists, axis=0)
    kth = best.kth() - 1e-9 * np.linalg.norm(weights, axis=1) * np.linalg.norm(x, axis=1).max() - 1e-6  # less a margin for rounding
    depths = np.array([g for g in DEPTHS if g < n])
    high, low = ranked[n - 1 - depths], ranked[depths]  # what comes next in a list after so many rows
    up, down = np.maximum(weights, 0), np.minimum(weights, 0)
    cost, width, depth = np.full(len(weights), n), np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
    for m in sorted({min(1 << i, dims) for i in range(dims.bit_length() + 1)}):
        rest = np.minimum(up[:, m:] @ high[0, m:] + down[:, m:] @ low[0, m:], np.linalg.norm(weights[:, m:], axis=1) * np.linalg.norm(x[:, m:], axis=1).max())
        stops = up[:, :m] @ high[:, :m].T + down[:, :m] @ low[:, :m].T + rest[:, None] < kth[:, None]
        own = np.where(stops.any(axis=1), m * depths[stops.argmax(axis=1)], n)
        less = own < cost
        cost[less], width[less], depth[less] = own[less], m, own[less] // m
    few = cost <= n // 2
    scan(every[~few], slice(None))
    for q in every[few & (cost > 0)]:
        w, g = weights[q, : width[q]], depth[q]
        heads = np.concatenate((lists[n - g :, : len(w)][:, w > 0].ravel(), lists[:g, : len(w)][:, w < 0].ravel()))
        rows = np.unique(heads)
        best.add(np.array([q]), ids[rows], products(best.queries[q : q + 1], vectors[rows]))


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, factor: int = 256) -> DataFrame:
    """``id`` and ``v``: floor(factor * x) of each component as double. Vectors that are null, empty or hold a null, NaN or infinite component are left out, as are rows without an id."""
    x = F.col(embedding)
    finite: Column = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(vec_id).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * factor).cast("long")).alias("v")
    )


def _matrix(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    at = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[at[rows][:, None] + np.arange(size)]


def _near(candidates: DataFrame, queries: pa.Table, k: int) -> DataFrame:
    """q, vec_id, score: the k best rows of each partition of ``candidates`` for each of ``queries`` (q, v)."""
    q, column = queries["q"].to_numpy(), queries["v"].combine_chunks()
    sizes = np.diff(np.asarray(column.offsets))
    by_size = {int(size): (np.flatnonzero(sizes == size), _matrix(column, np.flatnonzero(sizes == size), size)) for size in np.unique(sizes)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: Best(m, k) for size, (_, m) in by_size.items()}
        waiting: list[pa.RecordBatch] = []

        def block() -> None:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            ids, v = rows["id"].to_numpy(), rows["v"].combine_chunks()
            length = np.diff(np.asarray(v.offsets))
            for size, own in best.items():
                if len(some := np.flatnonzero(length == size)):
                    search(_matrix(v, some, size), ids[some], own)
            waiting.clear()

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                waiting.append(batch.slice(i, BLOCK_ROWS))
                if sum(x.num_rows for x in waiting) >= BLOCK_ROWS:
                    block()
        if waiting:
            block()
        for size, own in best.items():
            at, place = np.nonzero(own.found >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(q[by_size[size][0]][at]), pa.array(own.ids[at, place]), pa.array(own.score[at, place])], ["q", "vec_id", "score"])

    return candidates.select("id", "v").mapInArrow(run, "q long, vec_id long, score long")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Exact top ``k`` of ``candidates`` (id, v) for every row of ``queries`` (id, v) by integer inner product.

    Candidates are read where they lie and never copied or shuffled; of queries, ``QUERY_ROWS`` at a
    time travel to the tasks. Each task gives k + 1 rows a query, and a window merges these.

    A query's own row is no candidate: of the candidates with its id and with its score with itself,
    one is left out. Other rows that repeat its id take part. Repeated query rows are answered once
    each. Vectors of another length than the query's have no inner product with it and take no part
    in its answer. Other columns are not read. Empty input: no rows.

    Result: query_id, rank (from 1), vec_id, score; ties go to the smaller id.
    """
    queries = stored(queries.select(F.monotonically_increasing_id().alias("q"), "id", "v"), "queries")
    chunks = max(1, -(-queries.count() // QUERY_ROWS))
    parts = [_near(candidates, queries.where(F.pmod(F.xxhash64("q"), F.lit(chunks)) == i).select("q", "v").toArrow(), k + 1) for i in range(chunks)]
    itself = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    near = reduce(DataFrame.unionByName, parts).join(queries.select("q", F.col("id").alias("query_id"), itself.alias("itself")), "q")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k + 1)
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("itself")), F.col("place"))).over(Window.partitionBy("q"))
    near = near.withColumn("own", F.coalesce(own, F.lit(k + 2))).where("place <> own")
    rank = (F.col("place") - (F.col("place") > F.col("own")).cast("int")).alias("rank")
    return near.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors, 5)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row_id, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.row_id <> q.row_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
