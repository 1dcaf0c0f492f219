"""Minimum-cost-flow resharding.

Old shards hold bytes, new shards have capacities; a flow from old to new with
cost zero for bytes that stay and one for bytes that move says how many bytes go
from each old shard to each new one, and no other plan moves fewer.  Rows of an
old shard lie in order of a 64-bit hash of the row, so a transfer is a block of
that order, and its bounds are found by summing bytes over ranges of the hash,
finer and finer around each bound: a few thousand sums at a time reach the
driver, no rows.  Where a row goes is then a comparison with the bounds, so the
rewrite reads each file once and shuffles no text.

Rows larger than a 64th of a mean shard are placed one by one before the flow:
there can't be more than 64 of them a shard.  What a shard gets beyond its
share is at most the rows at its block bounds.

Size is the UTF-8 bytes of the text (null: none) plus one.  Null ids are ids
like any other.  Rows equal in id and text are one unit and lie together.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import cut, rank_in
from groundsift.session import scratch_folder

#: a row this part of a mean shard or larger is placed by itself
LARGE = 64
#: bits of the hash that one round of sums tells apart
BITS = 11


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Bytes from each old to each new shard: cheapest paths, one after the other, in what is left of the network."""
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    if sum(left) > sum(room):
        raise ValueError("capacities are too small")
    while any(left):
        # cheapest way to each node; old shards first, then new
        far = [0 if left[i] else None for i in range(n)] + [None] * m
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] is not None and (far[n + j] is None or far[i] + cost[i][j] < far[n + j]):
                        far[n + j], came[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] is not None and (far[i] is None or far[n + j] - cost[i][j] < far[i]):
                        far[i], came[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((n + j for j in range(m) if room[j]), key=lambda x: far[x])
        path, at = [], end
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        amount = min([left[at], room[end - n], *[flow[b][a - n] for a, b in path if a >= n]])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end - n] -= amount
    return flow


def level(total: int, filled: Sequence[int], share: Sequence[float]) -> list[int]:
    """Room for ``total`` bytes on top of what is filled, so that shards come as near to their shares as they can."""
    open_ = list(range(len(filled)))
    whole = total + sum(filled)
    while True:
        goal = {j: share[j] / sum(share[i] for i in open_) * (whole - sum(filled[i] for i in range(len(filled)) if i not in open_)) for j in open_}
        over = [j for j in open_ if filled[j] > goal[j]]
        if not over:
            break
        open_ = [j for j in open_ if j not in over]
    room = [max(0, round(goal[j] - filled[j])) if j in open_ else 0 for j in range(len(filled))]
    room[open_[-1]] += total - sum(room)
    for j in open_:  # rounding may have left the last one short
        if room[open_[-1]] >= 0:
            break
        taken = min(room[j], -room[open_[-1]])
        room[j], room[open_[-1]] = room[j] - taken, room[open_[-1]] + taken
    return room


class Plan:
    """Where rows go: ``large`` by hash, others by the bounds of blocks of their old shard."""

    def __init__(self, large: dict[int, int], blocks: dict[int, list[tuple[int, int]]], moved: int, flow: list[list[int]]):
        self.large, self.blocks, self.moved, self.flow = large, blocks, moved, flow

    def affected(self) -> set[int]:
        """Shards that lose or get a block; the files of all others stay as they are."""
        return {s for i, row in enumerate(self.flow) for j, n in enumerate(row) if n and i != j for s in (i, j)} | set(self.large.values())

    def shard(self, old: Column, h: Column) -> Column:
        """The new shard of a row; as many literals as there are blocks and large rows."""
        chosen = None
        for i, bounds in self.blocks.items():
            inner = F.lit(bounds[-1][1])
            for upto, j in reversed(bounds[:-1]):
                inner = F.when(h < F.lit(upto), j).otherwise(inner)
            chosen = F.when(old == i, inner) if chosen is None else chosen.when(old == i, inner)
        chosen = F.lit(0) if chosen is None else chosen
        if self.large:
            placed = F.create_map(*[F.lit(x) for kv in self.large.items() for x in kv])
            chosen = F.coalesce(F.try_element_at(placed, h), chosen)
        return chosen.cast("int")


def bounds_of(rows: DataFrame, cuts: dict[int, list[int]], slack: int) -> dict[int, list[int]]:
    """``rows(old, h, size)``: for each old shard the hashes at which the bytes before reach the cuts.

    Each round splits the range around every open cut in 2**BITS parts; it ends
    where a part holds no more than ``slack`` bytes or one hash.
    """
    low, high = -(1 << 63), 1 << 63
    open_ = {(i, n): (low, high, c) for i, cs in cuts.items() for n, c in enumerate(cs)}
    found: dict[tuple[int, int], int] = {}
    while open_:
        ranges = sorted({(i, a, b) for (i, _), (a, b, _) in open_.items()})
        part = None  # index of the range and of the part of the row
        for n, (i, a, b) in enumerate(ranges):
            step = max(1, (b - a) >> BITS)
            inside = (F.col("old") == i) & (F.col("h") >= F.lit(a)) & (F.col("h") <= F.lit(b - 1))
            shift = step.bit_length() - 1
            # ranges and steps are powers of two, starts multiples of them
            index = F.struct(F.lit(n).alias("n"), (F.shiftright("h", shift) - F.lit(a >> shift)).alias("p"))
            part = F.when(inside, index) if part is None else part.when(inside, index)
        sums: dict[int, list[tuple[int, int]]] = {}
        for r in rows.select(part.alias("at"), "size").where("at is not null").groupBy("at").agg(F.sum("size").alias("s")).collect():
            sums.setdefault(r["at"]["n"], []).append((r["at"]["p"], r["s"]))
        next_: dict[tuple[int, int], tuple[int, int, int]] = {}
        for key, (a, b, want) in open_.items():
            n = ranges.index((key[0], a, b))
            step = max(1, (b - a) >> BITS)
            before, at = 0, b
            for p, s in sorted(sums.get(n, [])):
                if before + s > want:
                    at = a + p * step
                    if s > slack and step > 1:
                        next_[key] = (at, at + step, want - before)
                    elif want - before > s / 2:
                        at += step
                    break
                before += s
            found[key] = min(at, (1 << 63) - 1)
        open_ = next_
    return {i: [found[i, n] for n in range(len(cs))] for i, cs in cuts.items()}


def plan(rows: DataFrame, old_shards: int, shares: Sequence[float]) -> Plan:
    """``rows(old, h, size)``, written, to a plan; ``shares``: capacities of the new shards in any unit."""
    units = rows.groupBy("old").agg(F.sum("size").alias("size")).collect()  # one row an old shard
    total = sum(r["size"] for r in units)
    supply = [0] * old_shards
    for r in units:
        supply[r["old"]] = r["size"]
    # fewer than LARGE rows a shard
    limit = max(1, total // (LARGE * len(shares)))
    big = rows.groupBy("h").agg(F.sum("size").alias("size"), F.min("old").alias("old")).where(F.col("size") > limit).collect()
    filled, large, goal = [0] * len(shares), {}, [total * s / sum(shares) for s in shares]
    moved = 0
    for r in sorted(big, key=lambda r: (-r["size"], r["h"])):
        j = r["old"] if r["old"] < len(shares) and filled[r["old"]] + r["size"] <= goal[r["old"]] else max(range(len(shares)), key=lambda j: goal[j] - filled[j])
        large[r["h"]] = j
        filled[j] += r["size"]
        supply[r["old"]] -= r["size"]
        moved += r["size"] * (j != r["old"])
    flow = min_cost_flow(supply, level(sum(supply), filled, shares), [[int(i != j) for j in range(len(shares))] for i in range(old_shards)])
    moved += sum(n for i, row in enumerate(flow) for j, n in enumerate(row) if i != j)
    # what stays comes first in an old shard's order
    order = {i: sorted((j for j in range(len(shares)) if flow[i][j]), key=lambda j: (j != i, j)) for i in range(old_shards)}
    cuts = {i: [sum(flow[i][j] for j in js[: n + 1]) for n in range(len(js) - 1)] for i, js in order.items() if js}
    small = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in large], "h long")), "h", "left_anti") if large else rows
    bounds = bounds_of(small, cuts, slack=max(1, limit // 64))
    blocks = {i: [*zip(bounds[i], order[i]), (1 << 63, order[i][-1])] for i in cuts}
    return Plan(large, blocks, moved, flow)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], docs["text"])


def reshard(docs: DataFrame, old: Column, old_shards: int, shares: Sequence[float]) -> tuple[Plan, str]:
    """Plan the new shards of ``docs(doc_id, text, ...)`` and write them; returns the plan and the folder.

    The folder holds one sub-folder per shard that the plan affects or that
    rows lie in; columns are those of ``docs``.
    """
    h = row_hash(docs)
    rows = cut(docs.select(old.cast("int").alias("old"), h.alias("h"), size_of(docs["text"]).alias("size")))
    made = plan(rows, old_shards, shares)
    folder = scratch_folder(docs.sparkSession, "shards")
    out = docs.select(F.struct("*").alias("row"), made.shard(old.cast("int"), h).alias("shard"))
    out.write.partitionBy("shard").parquet(folder)
    return made, folder


def digests(folder: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of written shards."""
    text = F.col("row.text")
    light = cut(folder.select(
        F.col("row.doc_id").cast("long").alias("doc_id"), size_of(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.col("shard").cast("int").alias("shard")))
    slots = rank_in(light, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
