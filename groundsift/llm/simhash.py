"""SimHash near-dedup with BK-trees.

Fingerprints are made in Arrow batches from the bytes of whole texts.  Equal
fingerprints are one node, so copies are never expanded.  Two fingerprints that
differ in at most two of 64 bits agree in at least two of four 16-bit blocks:
each fingerprint is sent to the six shards named by its block pairs.  A shard's
BK-tree (children keyed by their integer Hamming distance to the parent) is
built where the shard's rows are, and each member follows only the edges within
the radius.  Trees are handed to the tasks that hold their shard's rows, not to
all tasks: the fingerprints of all documents have no bound to broadcast under.

Shards with more than ``crowd`` members are split again by the same argument on
the bits they don't share, twice if needed: at least 49 bits are then fixed, so
a shard holds at most 2**15 fingerprints whatever the corpus is.  Each shard
returns a forest (member, least member it reaches), never pairs.

Null and empty texts have fingerprint zero and link like any other.  Rows with
a null id are returned, and name a component only where no row of it has an id.
Repeated rows are returned as often as they come.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import arrow_map, components, cut, single, text_blocks, union_find

WORDS = 3
SEED = 42
RADIUS = 2


def block_fingerprints(block, width: int, seed: int = SEED) -> np.ndarray:
    """A 64-bit SimHash per row of a block of texts."""
    block.words()
    data, rows = block.data, len(block.start)
    # words of a row joined by one space
    keep = np.zeros(len(data), bool)
    size = block.word_end - block.word_start
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, block.word_start, 1)
    np.add.at(step, block.word_end, -1)
    keep = np.cumsum(step[:-1]) > 0
    inner = block.word_row[1:] == block.word_row[:-1]
    gap = block.word_end[:-1][inner]  # the byte after a word that another word of the row follows
    flat = data.copy()
    flat[gap] = 32
    keep[gap] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    text = memoryview(flat[keep].tobytes())
    start, end = place[block.word_start], place[block.word_start] + size
    count = np.diff(block.first_word)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    first = np.repeat(block.first_word[:-1], shingles) + _within(shingles)
    last = np.minimum(first + width - 1, np.repeat(block.first_word[1:], shingles) - 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist())), np.uint64, len(first))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros(rows, np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        at = np.concatenate([[0], np.cumsum(shingles[some])[:-1]])
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        high = np.packbits(2 * ones > shingles[some][:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(high).view(np.uint64).ravel()
    return out


def _within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts)


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, text_key, fp)``; ``text_key`` is a hash of the text, null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [block_fingerprints(b, width) for b in text_blocks(batch.column("text"))]
            fp = np.concatenate(done) if done else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([single(batch.column("doc_id")), single(batch.column("text_key")), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")), run, "doc_id long, text_key long, fp long")


class BkTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.value: list[int] = []
        self.child: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        node = len(self.value)
        self.value.append(value)
        self.child.append({})
        at = 0
        while node:
            d = (self.value[at] ^ value).bit_count()
            step = self.child[at].get(d)
            if step is None:
                self.child[at][d] = node
                break
            at = step
        return node

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.value else []
        while open_:
            at = open_.pop()
            d = (self.value[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            child = self.child[at]
            if len(child) <= 2 * radius + 1:
                open_ += [c for e, c in child.items() if -radius <= e - d <= radius]
            else:
                open_ += [child[e] for e in range(d - radius, d + radius + 1) if e in child]
        return found


def shard_forest(values: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Edges that connect what the tree of one shard connects."""
    tree, a, b = BkTree(), [], []
    parent: list[int] = []
    for v in values:
        root = len(parent)
        parent.append(root)
        for other in tree.within(v, radius):
            x = other
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            if x != root:
                parent[max(x, root)] = min(x, root)
                root = min(x, root)
        tree.add(v)
    for i, v in enumerate(values):
        x = i
        while parent[x] != x:
            x = parent[x]
        if x != i:
            a.append(v)
            b.append(values[x])
    return a, b


def _shards(fp: Column) -> Column:
    """Six structs (key, open): which two of the four blocks and their values, and the 32 bits left open."""
    block = lambda i: F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))
    pairs = [(i, j) for i in range(4) for j in range(i)]
    rest = [[b for b in range(4) if b not in p] for p in pairs]
    return F.array(*[F.struct((F.lit(n << 32) + block(i) * 65536 + block(j)).alias("key"), (block(x) * 65536 + block(y)).alias("open"))
                     for n, ((i, j), (x, y)) in enumerate(zip(pairs, rest))])


def _split(key: Column, open_: Column, sizes: tuple[int, int, int]) -> Column:
    """Three structs (key, open): one of three parts of the open bits is fixed as well.

    Fingerprints of one shard that differ in at most two bits agree in a part.
    """
    low, mid, high = sizes
    a = open_.bitwiseAND(F.lit((1 << low) - 1))
    b = F.shiftright(open_, low).bitwiseAND(F.lit((1 << mid) - 1))
    c = F.shiftright(open_, low + mid)
    return F.array(F.struct(F.xxhash64(key, F.lit(0), a).alias("key"), F.shiftright(open_, low).alias("open")),
                   F.struct(F.xxhash64(key, F.lit(1), b).alias("key"), (c * (1 << low) + a).alias("open")),
                   F.struct(F.xxhash64(key, F.lit(2), c).alias("key"), open_.bitwiseAND(F.lit((1 << (low + mid)) - 1)).alias("open")))


def _forests(shards: DataFrame, radius: int) -> DataFrame:
    """``shards(key, fp)``, distinct, to star edges inside each shard."""

    def flush(keys: np.ndarray, fps: np.ndarray):
        change = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(change, len(keys)))
        a, b = [], []
        for s, n in zip(change[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            values = [v & 0xFFFFFFFFFFFFFFFF for v in fps[s : s + n].tolist()]
            x, y = shard_forest(values, radius)
            a += x
            b += y
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], ["a", "b"])

    def run(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False)])
            if not len(k):
                continue
            keep = int(np.searchsorted(k, k[-1], "left"))  # the last shard may go on
            yield from flush(k[:keep], f[:keep])
            held_k, held_f = k[keep:], f[keep:]
        if len(held_k):
            yield from flush(held_k, held_f)

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(shards.repartition(n, "key").sortWithinPartitions("key", "fp"), run, "a long, b long")


def links(fps: DataFrame, radius: int = RADIUS, crowd: int = 1024) -> DataFrame:
    """``fps(fp)``, distinct and written, to edges ``(a, b)`` that connect all within ``radius`` (two at most)."""
    if radius > 2:
        raise ValueError("two bits at most")
    shards = fps.select("fp", F.inline(_shards(F.col("fp"))))
    out = None
    for sizes in ((11, 11, 10), (7, 7, 8), None):
        crowded = cut(shards.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key")) if sizes else None
        last = crowded is None or crowded.isEmpty()
        edges = _forests((shards if last else shards.join(crowded, "key", "left_anti")).select("key", "fp"), radius)
        out = edges if out is None else out.unionByName(edges)
        if last:
            return out
        shards = cut(shards.join(crowded, "key", "left_semi").select("fp", F.inline(_split(F.col("key"), F.col("open"), sizes))))


def classes(prints: DataFrame, radius: int = RADIUS, crowd: int = 1024) -> DataFrame:
    """``prints(fp, ...)``, written, to ``(fp, root)``: the least fingerprint that each reaches."""
    nodes = cut(prints.select("fp").distinct())
    found = components(links(nodes, radius, crowd))
    return cut(nodes.join(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = WORDS, crowd: int = 1024) -> DataFrame:
    """``docs`` to ``(doc_id, fingerprint, component_id)``, one row per row."""
    prints = cut(fingerprints(docs, width))
    named = classes(prints, radius, crowd)
    low = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    lowest = cut(named.join(low, "fp").groupBy("root").agg(F.min("low").alias("component_id")))
    names = cut(named.join(lowest, "root").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept(docs: DataFrame, radius: int = RADIUS, width: int = WORDS, crowd: int = 1024) -> DataFrame:
    """``docs`` with one row of each component: the one of least id (null last), of equal ids that of least text hash.

    Columns stay as they are.
    """
    prints = cut(fingerprints(docs, width))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("t"))
    low = cut(prints.groupBy("fp").agg(F.min(key).alias("low"), F.count("*").alias("n")))
    chosen = cut(classes(prints, radius, crowd).join(low, "fp").groupBy("root").agg(F.min("low").alias("_key")).select("_key"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    rows = docs.select(F.struct("*").alias("row"), own.alias("_key")).join(chosen, "_key", "left_semi")
    repeated = prints.groupBy(key.alias("_key")).agg(F.count("*").alias("n")).where("n > 1").join(chosen, "_key", "left_semi")
    if not repeated.isEmpty():  # rows equal in id and text
        rows = rows.groupBy("_key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.select("row.*")


