"""Shared by the operators: tables, byte blocks of text columns, ranks, union-find, components."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundsift.session import cut, ship_package

#: bytes of text that one block of vector work holds; a longer text makes a block of its own
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def training_fold(column: str = "doc_id") -> Column:
    """True for rows that models may learn from: crc32 of the id as text is not divisible by five."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 != 0


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with the package on the workers, which give memory back at the end of a task."""
    ship_package(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


def _release() -> None:
    """Workers are reused and keep what they have freed; return it to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- text blocks

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if len(_TABLES.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 64)
        up, down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        if n > 4 * BLOCK_BYTES:  # of one very long text: not kept
            return up, down
        _TABLES["up"], _TABLES["down"] = up, down
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


class Block:
    """Rows ``first..last`` of an Arrow string column as one byte array with word bounds.

    Null texts are empty.  ``start``/``end`` bound each row in ``data``;
    ``word_start``/``word_end`` bound runs of bytes other than ASCII white space.
    """

    def __init__(self, first: int, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        self.first, self.data, self.start, self.end = first, data, start, end

    def words(self, fold: bool = True) -> "Block":
        if fold:
            self.data = _FOLD[self.data]
        solid = ~_SPACE[self.data]
        n = len(solid)
        opens, closes = np.ones(n + 1, bool), np.ones(n + 1, bool)
        opens[1:n] = ~solid[:-1]
        closes[: n - 1 if n else 0] = ~solid[1:]
        some = self.end > self.start
        opens[self.start[some]] = True
        closes[self.end[some] - 1] = True
        self.word_start = np.flatnonzero(solid & opens[:n])
        self.word_end = np.flatnonzero(solid & closes[:n]) + 1
        #: words of row i are first_word[i]:first_word[i + 1]
        self.first_word = np.append(np.searchsorted(self.word_start, self.start), len(self.word_start))
        self.word_row = np.repeat(np.arange(len(self.start)), np.diff(self.first_word))
        return self

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range, the same wherever the range stands."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.word_start, self.word_end)


def text_blocks(column: pa.ChunkedArray | pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of rows with at most ``limit`` bytes, or one row."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(chunk) == 0:
            continue
        if chunk.null_count:
            chunk = chunk.fill_null("")
        chunk = chunk.cast(pa.large_string())
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(chunk):
            stop = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
            yield Block(row, whole[at[row] : at[stop]], at[row:stop] - at[row], at[row + 1 : stop + 1] - at[row])
            row = stop


def single(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


# ---------------------------------------------------------------- ranks

def rank_in(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: place of the row in its group, gapless from ``start``; groups of any size, null a group too.

    Rows are dealt to hash buckets inside their group, as many as the square
    root of the table, so neither a bucket nor the list of a group's buckets
    grows faster than that root.  ``df`` is read twice: pass a written table.
    Rows equal in ``order`` share a bucket and are interchangeable.
    """
    n = df.count()
    buckets = max(64, math.isqrt(n) + 1)
    keyed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    for i, g in enumerate(group):  # null-safe keys
        keyed = keyed.withColumn(f"_k{i}", F.struct(F.col(g).isNull(), F.col(g)))
    keys = [f"_k{i}" for i in range(len(group))] + ["_b"]
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys[:-1]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if group else None
    if before is None:
        raise ValueError("a group is needed")
    sizes = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (keyed.join(sizes, keys).withColumn(name, F.col("_s") + F.row_number().over(inside) - 1 + start)
            .drop(*keys, "_s"))


# ---------------------------------------------------------------- components

def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of both and the least value that each reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)`` for every node with an edge; component is the least node.

    Large-star and small-star steps until nothing moves.  The least neighbour
    of each node is combined before its shuffle and written, so that the join
    back has a written table on either side and a hub's rows can be split.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or mark[0] == 0:
            break
        last = mark
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(e.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = cut(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        large = cut(both.where("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("low")))
        e = cut(large.join(low, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                .unionByName(low.select("u", F.col("low").alias("v"))).distinct())
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
