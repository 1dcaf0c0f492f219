"""Prefix trie of conversations, encoded as balanced parentheses per shard.

A node is a distinct sequence of first turns (role, text); its key is the XOR of
two 64-bit hashes of every turn with its depth, so keys of all prefixes are
running XORs.  The least conversation through a node stands for it; the nodes of
one conversation then form one path downwards, and the trie is a tree of such
paths.  A path is cut into *runs* that end where the trie branches or ends, and
all nodes of a run have the same leaves below them.

Runs are put in depth-first order: a path's key lists the depths (falling) and
names of the paths it leaves the root by.  Ranges of that order are the shards;
inside one, at most ``SHARD`` runs are taken at a time.  Each shard writes its runs
as balanced parentheses, opening its *spine* first: the nodes of earlier shards
that its runs hang on.  Minima of the excess, per block and in a tree above,
answer ``findclose``, which delimits a subtree; the rank of leaf pairs ``()``
between its ends counts leaves; cumulative arrays give its savings.  What a
shard finds below its spine merges by (path, depth), and runs of a path add up
what hangs on it at their end or deeper.

Turns are ordered by turn, null first, then by hashes of role and text, so ties
have a place; null roles and texts are empty.  Rows without a conversation id
belong to none and are left out.  Very long texts are read whole, by one
expression, and go no further than their own row.  A conversation with any share of the rows is
ranked by ranges, summed by blocks of turns, and its unbranched stretches are one run.
The digest of a node's ends reads their ids in order: parts of a million
characters are joined in ranges, and one stream per node hashes the parts.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundsift.llm.common import arrow_map, partitions
from groundsift.operators.ranking import grouped_rank
from groundsift.session import cut

#: turns in a block of running values; runs in a shard; parentheses in a block of minima; characters of ids in one part
TURNS, SHARD, BLOCK, PART = 1024, 1 << 16, 64, 1 << 20


# ---------------------------------------------------------------- parentheses

class Parentheses:
    """A balanced sequence with a tree of block minima of its excess."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1))
        blocks = max(1, -(-len(opens) // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.padded = padded
        self.low = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.low[self.leaves :] = padded.reshape(-1, BLOCK).min(1)
        for level in range(self.leaves.bit_length() - 2, -1, -1):
            i = np.arange(1 << level, 2 << level)
            self.low[i] = np.minimum(self.low[2 * i], self.low[2 * i + 1])
        #: leaf pairs that begin at a position or before it
        pair = np.zeros(len(opens), bool)
        pair[:-1] = self.opens[:-1] & ~self.opens[1:]
        self.pairs = np.cumsum(pair)

    def _scan(self, at: np.ndarray, target: np.ndarray, until: np.ndarray) -> np.ndarray:
        """First position from ``at`` and before ``until`` whose excess is ``target`` or less; -1 if there is none."""
        found = np.full(len(at), -1)
        for step in range(BLOCK):
            here = np.minimum(at + step, len(self.padded) - 1)
            found = np.where((found < 0) & (at + step < until) & (self.padded[here] <= target), here, found)
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess[at] - 1
        found = self._scan(at + 1, target, (at // BLOCK + 1) * BLOCK)
        left = np.flatnonzero(found < 0)
        node = at[left] // BLOCK + self.leaves
        going = np.ones(len(left), bool)
        while going.any():  # up, until a right neighbour holds the target
            sibling = (node % 2 == 0) & (self.low[np.minimum(node + 1, len(self.low) - 1)] <= target[left])
            node = np.where(going, np.where(sibling, node + 1, node // 2), node)
            going &= ~sibling
        while (inner := node < self.leaves).any():  # down to the first block that does
            child = 2 * np.where(inner, node, 0)
            node = np.where(inner, np.where(self.low[child] <= target[left], child, child + 1), node)
        start = (node - self.leaves) * BLOCK
        found[left] = self._scan(start, target[left], start + BLOCK)
        return found

    def pairs_in(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Leaf pairs between the parentheses of a node."""
        return self.pairs[close] - np.where(at > 0, self.pairs[at - 1], 0)


def encode(depths: np.ndarray) -> tuple[Parentheses, np.ndarray]:
    """Depth-first depths, of which ancestors' are less, to parentheses and each node's opening one."""
    bits, at, open_ = [], [], []
    for depth in depths.tolist():
        while open_ and open_[-1] >= depth:
            open_.pop()
            bits.append(False)
        open_.append(depth)
        at.append(len(bits))
        bits.append(True)
    bits += [False] * len(open_)
    return Parentheses(np.array(bits, bool)), np.array(at, np.int64)


def shard_totals(runs: list[dict], root: int) -> list[tuple[int, int, int, int, bool]]:
    """Runs in depth-first order to ``(path, depth, leaves, saved, own)``.

    ``own`` rows have the totals of a run's subtree in this shard, by the depth of
    its end; the others what this shard hangs on a path of its spine at a depth.
    """
    held = {(r["conv"], r["bottom"]) for r in runs}
    spine: dict[int, int] = {}  # depth to path
    first = runs[0]
    hooks = [(-first["key"][i], first["key"][i - 1] if i else root) for i in range(0, len(first["key"]), 2)]
    if first["top"] > (-first["key"][-2] if first["key"] else 0):
        hooks.append((first["top"], first["conv"]))
    for r in runs:
        if r["key"] and r["top"] == -r["key"][-2]:
            hooks.append((r["top"], r["key"][-3] if len(r["key"]) > 2 else root))
    for top, path in hooks:
        if (path, top - 1) not in held:
            spine[top - 1] = path
    above = sorted(spine.items())
    nodes, at = encode(np.array([k for k, _ in above] + [r["top"] for r in runs]))
    close = nodes.findclose(at)
    saved = np.zeros(len(nodes.opens), np.int64)
    saved[at[len(above) :]] = [r["saved"] for r in runs]
    saved = np.cumsum(saved)
    # the last run may have its branches in the next shards: its pair is no leaf
    bare = np.zeros(len(nodes.opens), np.int64)
    bare[at[-1]] = runs[-1]["children"] > 0
    bare = np.cumsum(bare)
    before = lambda c: np.where(at > 0, c[at - 1], 0)
    leaves = nodes.pairs_in(at, close) - (bare[close] - before(bare))
    total = saved[close] - before(saved)
    out = [(r["conv"], r["bottom"], int(n), int(t), True) for r, n, t in zip(runs, leaves[len(above) :], total[len(above) :])]
    for i, (k, path) in enumerate(above):
        deeper = i + 1 < len(above) and above[i + 1][1] == path
        out.append((path, k, int(leaves[i] - (leaves[i + 1] if deeper else 0)), int(total[i] - (total[i + 1] if deeper else 0)), False))
    return out


# ---------------------------------------------------------------- turns

def hashed(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to ``(conv, d, x, y, words)``: place from 1, two hashes of role and text, words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    short = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv is not null").select(
        "conv", "turn", F.xxhash64(F.lit(1), "role", "text").alias("x"), F.xxhash64(F.lit(2), "text", "role").alias("y"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return cut(grouped_rank(short, ["conv"], ["turn", "x", "y"], "d").select("conv", F.col("d").cast("long").alias("d"), "x", "y", "words"))


def running(df: DataFrame, before: dict[str, tuple]) -> DataFrame:
    """Add, for each name, an aggregate over the rows of a ``conv`` down to this one, in order of ``d``.

    ``before``: name to (aggregate function, column, how two parts combine, value of no rows).
    Blocks of ``TURNS`` depths are summed up first, then blocks follow each other.  ``df`` is read twice.
    """
    blocked = df.withColumn("_b", F.floor(F.col("d") / TURNS))
    inside = Window.partitionBy("conv", "_b").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocked.groupBy("conv", "_b").agg(*[f(c).alias(name) for name, (f, c, _, _) in before.items()])
    earlier = Window.partitionBy("conv").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "_b", *[F.coalesce(f(name).over(earlier), F.lit(zero).cast("long")).alias(f"_{name}") for name, (f, _, _, zero) in before.items()])
    out = blocked.select("*", *[f(c).over(inside).alias(name) for name, (f, c, _, _) in before.items()]).join(blocks, ["conv", "_b"])
    return out.select(*df.columns, *[both(F.col(f"_{name}"), F.col(name)).alias(name) for name, (_, _, both, _) in before.items()])


def rebuilt(turns: DataFrame, stride: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with another one's first turns, and the ids of all.

    The first ``h`` turns of a conversation are those of the last id divisible by
    ``stride``, where ``h`` is the crc32 of the id modulo ``heads``; its own follow from behind its first ``h``.
    """
    lengths = cut(turns.groupBy("conv").agg(F.count("*").alias("n")))
    convs = lengths.select("conv", (F.col("conv") - F.col("conv") % stride).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    convs = cut(convs.join(lengths.select(F.col("conv").alias("base"), "n"), "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("m")))
    opening = turns.where((F.col("conv") % stride == 0) & (F.col("d") < heads)).withColumnRenamed("conv", "base")
    head = convs.where("m > 0").join(opening, "base").where("d <= h").select("conv", "d", "x", "y", "words")
    tail = turns.join(convs.select("conv", "h", "m"), "conv").where("d > h").select("conv", (F.col("d") - F.col("h") + F.col("m")).alias("d"), "x", "y", "words")
    return cut(head.unionByName(tail)), convs.select("conv")


# ---------------------------------------------------------------- digests of ends

def _joined(batches):
    """Sorted ``(path, depth, conv)`` to parts ``(path, depth, first, ids)`` of bounded length."""
    open_, ids, size = None, [], 0

    def part():
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*open_, int(ids[0]))] + [pa.array([",".join(ids)])], names=["path", "depth", "first", "ids"])

    for b in batches:
        for path, depth, conv in zip(*(b[c].to_pylist() for c in ("path", "depth", "conv"))):
            if open_ != (path, depth) or size > PART:
                if ids:
                    yield part()
                open_, ids, size = (path, depth), [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield part()


def _hashed_parts(batches):
    """Sorted parts to one digest a node; parts pass one at a time."""
    open_, state, out = None, None, []
    for b in batches:
        for path, depth, ids in zip(*(b[c].to_pylist() for c in ("path", "depth", "ids"))):
            if open_ == (path, depth):
                state.update(b"," + ids.encode())
                continue
            if open_ is not None:
                out.append((*open_, state.hexdigest()))
            open_, state = (path, depth), hashlib.sha256(ids.encode())
        if len(out) > 4096:
            yield _digests(out)
            out = []
    if open_ is not None:
        out.append((*open_, state.hexdigest()))
    if out:
        yield _digests(out)


def _digests(rows):
    path, depth, digest = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.int64()), pa.array(depth, pa.int64()), pa.array(digest)], names=["path", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``ends(path, depth, conv)`` to ``(path, depth, ends_sha256)``: SHA-256 of the ids, ascending, joined by commas."""
    n = partitions(ends.sparkSession)
    order = ["path", "depth", "conv"]
    parts = arrow_map(ends.repartitionByRange(n, *order).sortWithinPartitions(*order), _joined, "path long, depth long, first long, ids string")
    return arrow_map(parts.repartition(n, "path", "depth").sortWithinPartitions("path", "depth", "first"), _hashed_parts, "path long, depth long, ends_sha256 string")


# ---------------------------------------------------------------- trie

def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``turns(conv, d, x, y, words)`` and ``convs(conv)``, both written, to one row a node."""
    spark = turns.sparkSession
    n = partitions(spark)
    every = convs.agg(F.min("conv").alias("root"), F.count("*").alias("n")).first()
    root = every["root"]
    if root is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in COLUMNS))
    xor = lambda a, b: a.bitwiseXOR(b)
    steps = turns.select("*", F.xxhash64("x", "y", "d").alias("t"), F.xxhash64("d", "y", "x").alias("u"))
    rows = cut(running(steps, {"p": (F.bit_xor, "t", xor, 0), "q": (F.bit_xor, "u", xor, 0)}).select(
        "conv", "d", "p", "q", xor(F.col("p"), F.col("t")).alias("pp"), xor(F.col("q"), F.col("u")).alias("pq"), "words"))
    key = ["d", "p", "q"]
    top = spark.range(1).select(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("pp"), F.lit(None).cast("long").alias("pq"),
                                F.lit(root).cast("long").alias("conv"), F.lit(every["n"]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    found = cut(rows.groupBy(*key).agg(F.any_value("pp").alias("pp"), F.any_value("pq").alias("pq"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.any_value("words").alias("words")).unionByName(top))
    children = found.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count("*").alias("n_children"))
    nodes = cut(found.join(children, key, "left").select("conv", "d", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    # paths: of which nodes each conversation's way is made, the depth where it joins each
    ways = rows.join(found.select(*key, F.col("conv").alias("path")), key).groupBy("conv", "path").agg(F.min("d").alias("at"), F.max("d").alias("end"))
    ways = cut(ways.unionByName(convs.select("conv", F.lit(root).cast("long").alias("path"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("end")))
               .groupBy("conv", "path").agg(F.min("at").alias("at"), F.max("end").alias("end"))
               .groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "path", "end"))).alias("way")))
    ends = ways.select(F.element_at("way", -1)["path"].alias("path"), F.element_at("way", -1)["end"].alias("depth"), "conv")
    own = ways.where(F.element_at("way", -1)["path"] == F.col("conv"))
    joins = F.flatten(F.transform(F.slice("way", 2, F.greatest(F.size("way") - 1, F.lit(0))), lambda w: F.array(-w["at"], w["path"])))
    paths = cut(own.select("conv", joins.alias("key"), F.element_at("way", -1)["at"].alias("first"), F.get("way", F.size("way") - 2)["path"].alias("parent")))
    # runs
    marked = nodes.withColumn("stop", (F.col("n_children") != 1).cast("long"))
    add = lambda a, b: a + b
    longest = nodes.groupBy("conv").agg(F.max("d").alias("bottom"))
    marked = cut(marked.join(longest, "conv").withColumn("stop", F.when(F.col("d") == F.col("bottom"), F.lit(1)).otherwise(F.col("stop")).cast("long")).drop("bottom"))
    placed = cut(running(marked, {"stops": (F.sum, "stop", add, 0), "spent": (F.sum, "saved", add, 0)}).select(
        "conv", "d", "n_convs", "n_children", (F.col("stops") - F.col("stop")).alias("run"), (F.col("spent") - F.col("saved")).alias("spent"), "saved"))
    runs = placed.groupBy("conv", "run").agg(F.min("d").alias("top"), F.max("d").alias("bottom"), F.sum("saved").alias("saved"), F.min("spent").alias("spent"), F.max_by("n_children", "d").alias("children"))
    runs = cut(runs)
    shards = runs.join(paths.select("conv", "key"), "conv").repartitionByRange(n, "key", "top").sortWithinPartitions("key", "top")

    def totals(batches):
        held: list[dict] = []

        def found():
            columns = list(zip(*shard_totals(held, root)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.bool_())], names=["conv", "bottom", "leaves", "saved", "own"])

        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) >= SHARD:
                    yield found()
                    held.clear()
        if held:
            yield found()

    parts = cut(arrow_map(shards, totals, "conv long, bottom long, leaves long, saved long, own boolean"))
    # shared spines: what later shards hang on a path counts for all its runs that end there or above
    hung = parts.where("not own").groupBy("conv", "bottom").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.lit(False).alias("own"))
    below = Window.partitionBy("conv").orderBy(F.desc("bottom"), F.col("own")).rowsBetween(Window.unboundedPreceding, 0)
    extra = lambda c: F.coalesce(F.sum(F.when(~F.col("own"), F.col(c))).over(below), F.lit(0))
    merged = parts.where("own").unionByName(hung).select("conv", "bottom", "own", (F.col("leaves") + extra("leaves")).alias("leaves"), (F.col("saved") + extra("saved")).alias("total")).where("own").drop("own")
    runs = runs.join(merged, ["conv", "bottom"]).select("conv", "run", "leaves", "total", F.col("spent").alias("opened"))
    digests = end_digests(ends)
    out = placed.join(runs, ["conv", "run"]).join(paths, "conv").join(digests.select(F.col("path").alias("conv"), F.col("depth").alias("d"), "ends_sha256"), ["conv", "d"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("first"), F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), (F.col("total") - (F.col("spent") - F.col("opened"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def of_conversations(rows: DataFrame) -> DataFrame:
    """Trie of ``rows(conv_id, turn, role, text)`` as they are."""
    turns = hashed(rows)
    return trie(turns, cut(turns.select("conv").distinct()))
