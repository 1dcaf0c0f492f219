"""Exact top-k search by inner product: tiled matrix products, selection per tile, tree merge.

Components become integers, ``floor(scale * x)``, so scores are exact.  Queries
go out in chunks of at most ``CHUNK_BYTES``, whose sizes are counted before they
are broadcast; every task multiplies a chunk with its own rows, tile by tile,
and keeps the best ``k`` of each query as it goes.  The short lists of the tasks
merge in a tree: ``FAN`` lists at a time, until one is left.  Candidates are
never shuffled and no pair leaves a tile unless it is among its query's best.

A query row is no candidate of its own, but a repeated row with the same id and
vector is.  Equal scores go to the smaller id; rows with a null id come last and
are never queries.  Vectors that are null or hold null or non-finite components
take no part; vectors meet only vectors of their length.  Components beyond the
range of a long are its ends, and scores are taken modulo 2**64.  An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundsift.llm.common import arrow_map
from groundsift.session import cut, scratch_folder

#: bytes of query components that are broadcast at once; scores in one tile; lists that merge at once
CHUNK_BYTES, TILE, FAN = 16 << 20, 1 << 20, 16
_EXACT = 2.0**53
_PARTIAL = "query_row long, query_id long, branch long, score long, vec_id long"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of both; in floating point where that is exact."""
    size = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    if a.shape[1] * size(a) * size(b) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T  # wraps


class Best:
    """The ``k`` best candidates of each query so far, as flat arrays in order of query and place."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int):
        self.rows, self.vectors, self.k = rows, vectors, k
        self.worst = np.full(len(rows), np.iinfo(np.int64).min)
        self.q = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def tile(self, lo: int, hi: int, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, null: np.ndarray) -> list[np.ndarray]:
        """Pairs of queries ``lo..hi`` with a tile that may be among the best."""
        score = products(self.vectors[lo:hi], vectors)
        bar = self.worst[lo:hi]
        if self.k + 1 < score.shape[1]:  # one more than k: the query's own row may be among them
            bar = np.maximum(bar, np.partition(score, -self.k - 1, 1)[:, -self.k - 1])
        q, c = np.nonzero(score >= bar[:, None])
        other = self.rows[lo + q] != rows[c]
        q, c = q[other], c[other]
        return [q + lo, score[q, c], ids[c], null[c]]

    def add(self, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        wide = max(self.k + 1, min(len(vectors), 4096))
        high = max(1, TILE // wide)
        for c in range(0, len(vectors), wide):
            at = slice(c, c + wide)
            for lo in range(0, len(self.rows), high):
                self._merge(self.tile(lo, min(lo + high, len(self.rows)), vectors[at], rows[at], ids[at], null[at]))

    def _merge(self, found: list[np.ndarray]) -> None:
        q, score, ids, null = (np.concatenate(x) for x in zip((self.q, self.score, self.id, self.null), found))
        order = np.lexsort((ids, null, ~score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[place < self.k]
        self.q, self.score, self.id, self.null = q[place < self.k], score[order], ids[order], null[order]
        full = place[place < self.k] == self.k - 1
        self.worst[self.q[full]] = self.score[full]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def integers(rows: DataFrame, scale: int) -> DataFrame:
    """``(row, vec_id, x, dim)`` of the rows that take part, written; ``row`` tells repeated rows apart."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.where(F.col("embedding").isNotNull() & finite).select(F.monotonically_increasing_id().alias("row"), "vec_id", x.alias("x"))
    return cut(base.withColumn("dim", F.size("x")))


def merged(lists: DataFrame, branches: int, k: int) -> DataFrame:
    """Tree of merges: ``FAN`` branches of a query become one, until one is left."""
    while True:
        branches = -(-branches // FAN)
        lists = lists.withColumn("branch", F.floor(F.col("branch") / FAN))
        best = Window.partitionBy("query_row", "branch").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if branches <= 1:
            return lists
        lists = lists.drop("rank")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``rows(vec_id, embedding)`` to ``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``vec_id``."""
    spark = rows.sparkSession
    base = integers(rows, scale)
    queries = base.where(F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    total = queries.agg(F.coalesce(F.sum(F.col("dim") * 8 + 16), F.lit(0)).alias("n")).first()["n"]
    chunks = -(-2 * total // chunk_bytes)
    while chunks:  # even chunks of half the bound; more of them, should one come out too large
        chunk = F.pmod(F.xxhash64("row"), F.lit(chunks))
        largest = queries.groupBy(chunk.alias("chunk")).agg(F.sum(F.col("dim") * 8 + 16).alias("n"), F.count("*").alias("rows")).agg(F.max(F.when(F.col("rows") > 1, F.col("n")))).first()[0]
        if (largest or 0) <= chunk_bytes:
            break
        chunks *= 2
    found = scratch_folder(spark, "topk")
    branches = base.rdd.getNumPartitions()
    for i in range(chunks):
        asked = queries.where(chunk == i).select("row", "vec_id", "x", "dim").toArrow()
        if not len(asked):
            continue
        held = {}
        for dim in np.unique(asked["dim"].to_numpy()).tolist():
            own = asked.filter(pc.equal(asked["dim"], dim)).combine_chunks()
            held[dim] = (own["row"].to_numpy(), own["vec_id"].to_numpy(), _matrix(own["x"].combine_chunks() if isinstance(own["x"], pa.ChunkedArray) else own["x"]).reshape(len(own), dim))
        shared = spark.sparkContext.broadcast(held)

        def best(batches, shared=shared):
            from pyspark import TaskContext

            branch = TaskContext.get().partitionId()
            lists = {dim: Best(row, x, k) for dim, (row, _, x) in shared.value.items()}
            for batch in batches:
                dims = batch["dim"].to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim in lists:
                        own = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
                        lists[dim].add(_matrix(own["x"]).reshape(len(own), dim), own["row"].to_numpy(), own["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy(),
                                       own["vec_id"].is_null().to_numpy(zero_copy_only=False))
            for dim, b in lists.items():
                row, ids, _ = shared.value[dim]
                for s in range(0, len(b.q), 1 << 16):
                    q = b.q[s : s + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[q]), pa.array(ids[q]), pa.array(np.full(len(q), branch)), pa.array(b.score[s : s + len(q)]), pa.array(b.id[s : s + len(q)], mask=b.null[s : s + len(q)])],
                        names=["query_row", "query_id", "branch", "score", "vec_id"])

        merged(arrow_map(base.select("row", "vec_id", "x", "dim"), best, _PARTIAL), branches, k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(found)
        shared.destroy()
    schema = "query_id long, rank int, vec_id long, score long"
    if not chunks:
        return spark.createDataFrame(pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}), schema)
    return spark.read.schema(schema).parquet(found)
