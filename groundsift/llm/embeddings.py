"""Embedding near-dedup with a robust-pruned flat graph.

Only vectors with equal, non-null labels are compared.  Equal vectors of a label
are one node.  Each label is cut into clusters around centroids that are fitted
on a bounded sample; a node lies at home in its nearest cluster and is a guest in
the next ``overlap`` ones, so shards overlap.  In each shard a flat graph is
built: candidates in order of distance, kept unless a kept neighbour is nearer
to them by the factor ``alpha`` (robust pruning).  The adjacency lists that a
node got in different shards are united, with the reverse of each edge, and go
back to every shard that holds both ends.

The search is for all nodes within the threshold of a node at home: a greedy
walk with a beam leads from the shard's medoid to the node's surroundings, and
from there, the node itself and every node found in range, or short of it by ``SLACK``, the search goes on
to its neighbours until no more come up (range expansion).  Every find is verified in double precision.
A node's links are counted in its home shard alone, so no pair is found twice
and none leaves the shard: what goes on is a count a node and a forest of edges.

A shard of more than ``crowd`` members is cut into blocks by hash; homes meet
every block of their cluster, so nothing is dropped and no task grows.  Recall
is audited: links of a bounded sample of nodes are counted by brute force, and
if fewer than ``recall`` of them were found, all is done again with twice the
overlap and beam, in the end with whole clusters scanned.

Vectors that are null, empty, zero or hold null or non-finite values, and rows
without a label, link with nothing: no links, a component of their own.  Repeated
rows link with each other; null ids are nodes but name a component only where
there is no other.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import components, cut, partitions, ship_package, union_find

THRESHOLD = 0.93
#: graph degree, pruning factor, beam of the walk
DEGREE, ALPHA, BEAM = 24, 1.2, 24
OVERLAP = 2
#: how far below the threshold a node may be and still lead on
SLACK = 0.03
#: mean nodes a cluster; members beyond which a shard is cut into blocks
CLUSTER, CROWD = 1000, 4096
#: nodes a centroid that fitting reads; nodes that the audit counts by brute force
FIT, AUDIT = 16, 256
RECALL = 0.95


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


# ---------------------------------------------------------------- one shard


def robust_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of each row, padded with -1."""
    n = len(x)
    out = np.full((n, degree), -1, np.int64)
    if n < 2:
        return out
    pool, y = min(n - 1, 4 * degree), x.astype(np.float32)
    for s in range(0, n, 64):  # as many rows as keep their candidates in the cache
        sim = x[s : s + 64] @ x.T
        rows = np.arange(len(sim))
        sim[rows, s + rows] = -2
        near = np.argpartition(-sim, pool - 1, 1)[:, :pool]
        order = np.take_along_axis(near, np.argsort(-np.take_along_axis(sim, near, 1), 1, kind="stable"), 1)
        far = 2 - 2 * np.take_along_axis(sim, order, 1)  # squared distances
        near_ = y[order]
        between = 2 - 2 * np.matmul(near_, near_.transpose(0, 2, 1))  # of the candidates of a row, once for all steps
        alive = np.ones(order.shape, bool)
        for k in range(degree):
            at = alive.argmax(1)  # nearest candidate left
            some = alive[rows, at]
            if not some.any():
                break
            out[s + rows[some], k] = order[rows, at][some]
            # candidates that the kept one is much nearer to fall away
            alive &= ~((alpha * alpha * between[rows, at] <= far) & some[:, None])
            alive[rows, at] = False
    return out


def both_ways(graph: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row and the rows that it is a neighbour of, each once, from lists padded with -1."""
    n = len(graph)
    a, k = np.nonzero(graph >= 0)
    b = graph[a, k]
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(edges % max(1, n), np.searchsorted(edges, np.arange(1, n) * n))


def walk(x: np.ndarray, graph: np.ndarray, medoid: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Greedy walks of all queries at once; the beam (queries x beam) of nearest nodes, padded with -1."""
    n = len(queries)
    ids, sims, done = np.full((n, beam), -1, np.int64), np.full((n, beam), -9.0), np.ones((n, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0] = medoid, queries @ x[medoid], False
    rows = np.arange(n)
    while len(rows):
        step = done[rows].argmin(1)  # nearest node not left yet: beams are sorted
        going = ~done[rows, step]
        rows, step = rows[going], step[going]
        if not len(rows):
            break
        done[rows, step] = True
        near = graph[ids[rows, step]]
        sim = np.where(near >= 0, np.einsum("qd,qkd->qk", queries[rows], x[near]), -9.0)
        sim[(near[:, :, None] == ids[rows][:, None, :]).any(2)] = -9.0
        both, value = np.hstack([ids[rows], near]), np.hstack([sims[rows], sim])
        left = np.hstack([done[rows], np.zeros(near.shape, bool)])
        order = np.argsort(-value, 1, kind="stable")[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (both, value, left))
        ids[rows], done[rows] = np.where(sims[rows] > -9, ids[rows], -1), done[rows] | (sims[rows] <= -9)
    return ids


def in_range(x: np.ndarray, graph: np.ndarray, first: np.ndarray, near: np.ndarray, medoid: int, queries: np.ndarray, own: np.ndarray,
             threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within the threshold, each once; ``own``: the query's own node, -1 if it isn't in the graph.

    ``graph``: padded lists for the walk; ``near[first[i]:first[i + 1]]``: all neighbours of node i.
    """
    found_q, found_n = [], []
    degree = np.diff(first)
    for s in range(0, len(queries), 512):
        part = queries[s : s + 512]
        seen = np.zeros((len(part), len(x)), bool)
        start = np.hstack([walk(x, graph, medoid, part, beam), own[s : s + 512, None]])
        q, n = np.nonzero(start >= 0)
        q, n = np.divmod(np.unique(q * len(x) + start[q, n]), len(x))
        while len(q):
            seen[q, n] = True
            sims = [(part[q[i : i + 65536]] * x[n[i : i + 65536]]).sum(1) for i in range(0, len(q), 65536)]
            sim = np.concatenate(sims)
            hit, lead = sim >= threshold, sim >= threshold - SLACK
            found_q.append(q[hit] + s)
            found_n.append(n[hit])
            next_ = np.zeros_like(seen)
            q, n = q[lead], n[lead]
            for i in range(0, len(q), 8192):
                qs, ns = q[i : i + 8192], n[i : i + 8192]
                size = degree[ns]
                at = np.repeat(first[ns] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                next_[np.repeat(qs, size), near[at]] = True
            q, n = np.nonzero(next_ & ~seen)
    return np.concatenate(found_q), np.concatenate(found_n)


def medoid_of(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


# ---------------------------------------------------------------- clusters


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(11)
    c = sample[rng.permutation(len(sample))[:k]]
    for _ in range(rounds):
        own = (sample @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1e-12)[:, None], c)
    return c


def fit(nodes: DataFrame, cluster: int = CLUSTER) -> dict[int, np.ndarray]:
    """Centroids of each label, fitted on about ``FIT`` nodes a centroid, drawn by hash."""
    k = {r["label"]: max(1, round(r["n"] / cluster)) for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = FIT / cluster
    drawn = nodes.where(F.pmod("node", F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("label", "vector").toPandas()
    out = {}
    for label, n in k.items():
        own = drawn[drawn.label == label]
        if n > 1 and len(own) >= n:
            out[label] = centroids(units(stacked(own.vector)), n)
    return out


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, cluster: int = CLUSTER, crowd: int = CROWD) -> DataFrame:
    """``rows(vec_id, embedding, label)`` to ``(vec_id, n_links, component_id, kept)``, one row per row."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = F.col("vector").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("long").alias("label"))
    # vectors of unequal length can't be compared: the length is part of the label
    base = base.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("label", F.when(F.col("sound"), F.xxhash64("label", F.size("vector"))))
    # -0.0 is 0.0
    base = base.withColumn("vector", F.transform("vector", lambda v: v + F.lit(0.0)))
    base = cut(base.withColumn("key", F.when(F.col("sound"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256))))
    nodes = cut(base.where("sound").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
                .withColumn("node", F.xxhash64("key")))
    while True:
        found, edges, recall = _search(nodes, threshold, overlap, cluster, crowd)
        if recall >= RECALL or overlap >= 1 << 20:
            break
        overlap = overlap * 4 if overlap < 64 else 1 << 20
    joined = components(edges)
    named = cut(nodes.select("key", "node", "low", "copies").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node")))
    lowest = cut(named.groupBy("root").agg(F.min("low").alias("component_id")))
    links = cut(found)
    known = cut(named.join(lowest, "root").join(links, "node", "left").select(
        "key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    out = base.select("vec_id", "key").join(known, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _search(nodes: DataFrame, threshold: float, overlap: int, cluster: int, crowd: int) -> tuple[DataFrame, DataFrame, float]:
    """``(node, n)`` links to other nodes weighed by copies, edges ``(a, b)`` that connect them, and the audited recall."""
    spark = nodes.sparkSession
    ship_package(spark)
    fitted = spark.sparkContext.broadcast(fit(nodes, cluster))
    beam = BEAM * max(1, overlap // OVERLAP) if overlap < 1 << 20 else 1 << 20

    def assign(batches):
        for pdf in batches:
            parts = []
            for label, own in pdf.groupby("label", sort=False):
                c = fitted.value.get(label)
                k = 1 if c is None else min(len(c), 1 + overlap)
                near = np.zeros((len(own), 1), np.int64) if c is None else np.argsort(-(units(stacked(own.vector)) @ c.T), 1)[:, :k]
                part = own.loc[own.index.repeat(k)].copy()
                part["cluster"], part["home"] = near.ravel(), np.tile(np.arange(k) == 0, len(own))
                parts.append(part)
            if parts:
                yield pd.concat(parts)

    members = cut(nodes.select("node", "copies", "label", "vector").mapInPandas(assign, "node long, copies long, label long, vector array<double>, cluster long, home boolean"))
    size = members.groupBy("label", "cluster").agg(F.ceil(F.count("*") / crowd).alias("blocks"))
    members = cut(members.join(cut(size), ["label", "cluster"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    n = partitions(spark)
    shard = ["label", "cluster", "block"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf.node.to_numpy()
        graph = robust_graph(units(stacked(pdf.vector)))
        return pd.DataFrame({"node": node, "near": [node[v] for v in both_ways(graph)]})

    # a row a member, not a row an edge
    lists = cut(members.repartition(n, *shard).groupBy(*shard).applyInPandas(build, "node long, near array<long>")
                .groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")))
    # the united lists go to every shard of the node, and each shard's blocks of homes come there
    targets = members.join(lists, "node", "left").select(*shard, F.lit(True).alias("target"), F.lit(0).alias("turn"), "node", "copies", "vector", "near", "blocks")
    homes = members.where("home").select("label", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                                         F.lit(False).alias("target"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).alias("turn"), "node", "copies", "vector",
                                         F.lit(None).cast("array<long>").alias("near"), "blocks")
    # one task a (block of members, block of homes)
    targets = targets.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own, asks = pdf[pdf.target], pdf[~pdf.target]
        empty = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if not len(own) or not len(asks):
            return empty
        x, ask = units(stacked(own.vector)), units(stacked(asks.vector))
        node, copies, asker = own.node.to_numpy(), own.copies.to_numpy(), asks.node.to_numpy()
        order = np.argsort(node)
        graph, near, first = np.full((len(x), 2 * DEGREE), -1, np.int64), [], [0]
        for i, v in enumerate(own.near):
            v = np.asarray(v if v is not None else (), np.int64)
            at = order[np.minimum(np.searchsorted(node, v, sorter=order), len(node) - 1)]
            at = at[node[at] == v]
            near.append(at)
            first.append(first[-1] + len(at))
            at = at[np.argsort(-(x[at] @ x[i]), kind="stable")] if len(at) > 2 * DEGREE else at
            graph[i, : min(len(at), 2 * DEGREE)] = np.concatenate([at[:DEGREE], at[DEGREE:][:: max(1, (len(at) - DEGREE) // DEGREE)][:DEGREE]]) if len(at) > 2 * DEGREE else at
        near, first = np.concatenate(near), np.array(first)
        place = order[np.minimum(np.searchsorted(node, asker, sorter=order), len(node) - 1)]
        place = np.where(node[place] == asker, place, -1)
        if beam >= 1 << 20:  # whole clusters
            q, m = np.nonzero(ask @ x.T >= threshold)
        else:
            q, m = in_range(x, graph, first, near, medoid_of(x), ask, place, threshold, beam)
        other = asker[q] != node[m]
        q, m = q[other], m[other]
        n_links = np.bincount(q, copies[m], minlength=len(ask)).astype(np.int64)
        names, roots = union_find(asker[q], node[m])
        moved = names != roots
        return pd.concat([pd.DataFrame({"a": asker, "b": asker, "n": n_links}), pd.DataFrame({"a": names[moved], "b": roots[moved], "n": 0})])

    keys = [*shard, "turn"]
    both = targets.select(*keys, "target", "node", "copies", "vector", "near").unionByName(homes.select(*keys, "target", "node", "copies", "vector", "near"))
    result = cut(both.repartition(n, *keys).groupBy(*keys).applyInPandas(search, "a long, b long, n long"))
    found = cut(result.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")))
    edges = result.where("a <> b").select("a", "b")
    return found, edges, audit(nodes, found, threshold)


def audit(nodes: DataFrame, found: DataFrame, threshold: float, size: int = AUDIT) -> float:
    """Share of the links of about ``size`` nodes, drawn by hash, that were found; brute force over all nodes."""
    total = nodes.count()
    if not total:
        return 1.0
    share = min(1.0, size / total)
    # half of the sample among nodes that have links, so that there is something to count
    drawn = found.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    linked = found.where("n > 0")
    many = linked.count()
    drawn = drawn.union(linked.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20)) < math.ceil(min(1.0, size / max(1, many)) * (1 << 20)))).distinct()
    asked = nodes.join(drawn, "node").select("node", "label", "vector", "n").toPandas()
    if not len(asked):
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast({k: (units(stacked(v.vector)), v.node.to_numpy()) for k, v in asked.groupby("label")})

    def count(batches):
        for pdf in batches:
            for label, own in pdf.groupby("label"):
                if label in shared.value:
                    x, node = shared.value[label]
                    hit = (x @ units(stacked(own.vector)).T >= threshold) & (node[:, None] != own.node.to_numpy()[None])
                    yield pd.DataFrame({"node": node, "n": (hit * own.copies.to_numpy()[None]).sum(1).astype(np.int64)})

    true = nodes.select("node", "copies", "label", "vector").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).toPandas()
    real = int(true.n.sum())
    got = asked.set_index("node").n.reindex(true.node).fillna(0).to_numpy()
    return 1.0 if not real else float(np.minimum(got, true.n.to_numpy()).sum() / real)
