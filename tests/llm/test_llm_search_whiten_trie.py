"""Top-k search, whitening and the prefix trie against brute force, with nulls, ties, repeats, skew and clashing columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundsift.llm import prefix_trie, topk, whitening

from test_llm_operators import table

VECTORS = "vec_id long, embedding array<float>, label int, row long, x string, dim string, rank string, w string"


def vectors(seed, n, d=6):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(v)) for v in r] for r in rng.normal(size=(n, d)) / 2]


ODD_VECTORS = [(50, None), (51, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (100, [math.nan] + [0.0] * 5), (52, [math.inf] + [0.0] * 5), (None, [0.5] * 6), (53, []), (150, []), (54, [0.25]), (200, [0.5]), (250, [0.0] * 6)]

# ---------------------------------------------------------------- 11 top-k


def best(rows, k, every):
    sound = [(i, [math.floor(256 * c) for c in v]) for i, (i_, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v) for i in [(i, i_)]]
    out = Counter()
    for (at, name), q in sound:
        if name is None or name % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0, i) for (a_, i), v in sound if a_ != at and len(v) == len(q))
        out.update((name, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k]))
    return out


@pytest.mark.parametrize("chunk", [topk.CHUNK_BYTES, 600])
def test_top_k_equals_brute_force(spark, tmp_path, chunk):
    base = vectors(1, 400)
    rows = [(i, v) for i, v in enumerate(base)] + [(i % 7 * 50, base[3]) for i in range(60)] + ODD_VECTORS + [(7000 + i, base[3]) for i in range(300)]
    got = topk.top_k(table(spark, tmp_path, rows, VECTORS), F.col("vec_id") % 50 == 0, chunk_bytes=chunk)
    assert Counter(tuple(r) for r in got.collect()) == best(rows, 5, 50)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_of_few_and_none(spark, tmp_path):
    asked = F.col("vec_id") % 50 == 0
    assert topk.top_k(table(spark, tmp_path, [], VECTORS), asked).count() == 0
    assert topk.top_k(table(spark, tmp_path, [(50, [1.0])], VECTORS), asked).count() == 0
    assert topk.top_k(table(spark, tmp_path, [(1, [1.0]), (2, [1.0])], VECTORS), asked).count() == 0
    got = topk.top_k(table(spark, tmp_path, [(0, [1.0]), (0, [1.0]), (3, [1e30]), (4, [-2.0])], VECTORS), asked).collect()
    assert Counter((r.query_id, r.rank) for r in got) == Counter({(0, k): 2 for k in (1, 2, 3)})
    assert [r.vec_id for r in got if r["rank"] == 2] == [0, 0] or [r.vec_id for r in got if r["rank"] == 1] == [0, 0]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 60), st.sampled_from([3, 4 << 10, 1 << 41]))
def test_tiles_keep_the_best_with_ties(seed, k, n, size):
    """Tiles of any cut, small scores with many ties, and products beyond a double's integers."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size, (4, 3)), rng.integers(-size, size, (n, 3))
    ids, rows = rng.permutation(n), np.arange(n)
    held = topk.Best(np.array([0, 99, 98, n - 1]), a, k)
    for s in range(0, n, 7):
        held.add(b[s : s + 7], rows[s : s + 7], ids[s : s + 7], np.zeros(len(b[s : s + 7]), bool))
    for q, own in enumerate([0, 99, 98, n - 1]):
        def wrapped(v):
            return (v + (1 << 63)) % (1 << 64) - (1 << 63)
        want = sorted((-wrapped(sum(int(x) * int(y) for x, y in zip(a[q], v))), int(i)) for v, i, r in zip(b, ids, rows) if r != own)[:k]
        assert [(-int(s), int(i)) for s, i in zip(held.score[held.q == q], held.id[held.q == q])] == want


# ---------------------------------------------------------------- 12 whitening


def symmetric(seed, d, spectrum):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    m = q * np.asarray(spectrum) @ q.T
    return (m + m.T) / 2


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 30), st.floats(-3, 3))
def test_inertia_counts_eigenvalues(seed, d, shift):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(d, d))
    m = m + m.T
    assert whitening.inertia(m - shift * np.eye(d)) == int((np.linalg.eigvalsh(m) > shift).sum())
    hollow = m - np.diag(np.diagonal(m))  # needs pivots of two
    assert whitening.inertia(hollow) == int((np.linalg.eigvalsh(hollow) > 0).sum())


@pytest.mark.parametrize("spectrum", [
    np.arange(1, 41), 10.0 ** np.linspace(-6, 6, 40), np.ones(40), [5] * 10 + [3] * 20 + [1] * 10, [1e9] + [1 + 1e-3 * i for i in range(39)], [7, 6, 5] + [0] * 37, np.exp(np.linspace(0, 0.01, 40))])
def test_leading_pairs(spectrum):
    m = symmetric(3, 40, spectrum)
    value, vector = whitening.leading(m, 8)
    want = np.sort(spectrum)[::-1][:8]
    want = want[want > 1e-12 * want.max()]
    assert len(value) == len(want) and np.allclose(value, want, rtol=1e-9, atol=1e-13 * want.max())
    assert np.abs(vector.T @ vector - np.eye(len(want))).max() < 1e-12
    assert np.abs(m @ vector - vector * value).max() < 1e-12 * want.max()


def test_interval_without_its_pairs_is_refused():
    with pytest.raises(ArithmeticError):
        whitening.interval_pairs(np.diag([1.0, 2.0, 3.0]), 1.5, 2.5, 2)


def test_whitened_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(700, 12)) * np.linspace(0.05, 1, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data)] + [(5, [float(c) for c in data[5]]), (None, [float(c) for c in data[6]])]
    odd = [(900, None), (901, [None] * 12), (902, [math.nan] * 12), (903, [math.inf] * 12), (904, [1.0] * 11), (905, [])]
    got = whitening.whiten(table(spark, tmp_path, rows + odd, VECTORS)).collect()
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    n, total = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[n * c - s for c, s in zip(v, total)] for v in x], float) / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    value, vector = value[::-1][:8], vector[:, ::-1][:, :8]
    want = y @ vector / np.sqrt(value)
    deviation = Counter((i, sum((n * c - s) ** 2 for c, s in zip(v, total))) for (i, _), v in zip(rows, x))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 3) == deviation
    assert Counter(r.component for r in got) == {k: n for k in range(1, 9)} and {r.n for r in got} == {n}
    for k in range(8):
        own = {r.vec_id: r.whitened for r in got if r.component == k + 1 and r.vec_id is not None}
        mine, theirs = np.array([own[i] for i in range(700)]), want[:700, k]
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-9
        assert {r.explained for r in got if r.component == k + 1}.pop() == pytest.approx(value[k] / np.trace(y.T @ y / n), rel=1e-9)
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_flat_few_and_far(spark, tmp_path):
    run = lambda rows: whitening.whiten(table(spark, tmp_path, rows, VECTORS)).collect()
    assert run([]) == run([(1, None)]) == run([(1, [])]) == run([(1, [2.0, 3.0])]) == run([(1, [2.0, 3.0]), (2, [2.0, 3.0])]) == []
    assert [(r.component, abs(round(r.whitened, 9))) for r in run([(1, [2.0, 3.0]), (2, [2.0, 4.0])])] == [(1, 1.0), (1, 1.0)]
    far = run([(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])])
    assert {(r.vec_id, r.deviation) for r in far} == {(1, None), (2, None), (3, 2048**2)}


# ---------------------------------------------------------------- 13 prefix trie

TURNS = "conv_id long, turn long, role string, text string, conv string, d string, p string, path string"


def brute(paths):
    """Rows of the trie of ``{conversation: [(role, text), ...]}``."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = set()
    for k, own in members.items():
        below = [o for o in members if o[: len(k)] == k]
        saved = sum((len(members[o]) - 1) * len([w for w in o[-1][1].translate({i: 32 for i in range(9, 14)}).split(" ") if w]) for o in below if o)
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(k))
        out.add((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(kids[k]), sum(not kids[o] for o in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(paths):
    return [(c, i, *t) for c, path in paths.items() for i, t in enumerate(path)]


def random_paths(seed, n, kinds, longest):
    rng = np.random.default_rng(seed)
    return {int(c): [("user", f"w{rng.integers(kinds)} x") for _ in range(rng.integers(1, longest))] for c in rng.permutation(3 * n)[:n]}


@pytest.mark.parametrize("shard", [1, 5, 1 << 16])
def test_trie_equals_brute_force(spark, tmp_path, shard, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "TURNS", 4)
    monkeypatch.setattr(prefix_trie, "PART", 12)
    paths = random_paths(1, 60, 2, 9)
    chain = [("user", f"t{i} of the long one") for i in range(40)]
    paths |= {1000: chain, 1001: chain[:20] + [("user", "leaves")], 1002: chain[:39], 999: chain[:5], 1003: chain + [("x", "y")], **{2000 + i: chain[:7] for i in range(30)}, 990: chain[:3] + [("b", "c")]}
    got = prefix_trie.of_conversations(table(spark, tmp_path, conversations(paths), TURNS))
    assert {tuple(r) for r in got.collect()} == brute(paths) and got.columns == list(prefix_trie.COLUMNS)


def test_trie_of_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None), (1, 0, "user", "a\tb  c\n"), (1, 1, "user", "á b"), (2, None, "", ""), (2, 5, "user", "a\tb  c\n"), (2, 5, "user", "a\tb  c\n"), (None, 0, "user", "x"), (-7, 0, "", " " * 5), (3, 0, "user", "long " * 300_000)]
    paths = {1: [("", ""), ("user", "a\tb  c\n"), ("user", "á b")], 2: [("", ""), ("user", "a\tb  c\n"), ("user", "a\tb  c\n")], -7: [("", "     ")], 3: [("user", "long " * 300_000)]}
    assert {tuple(r) for r in prefix_trie.of_conversations(table(spark, tmp_path, rows, TURNS)).collect()} == brute(paths)
    assert prefix_trie.of_conversations(table(spark, tmp_path, [], TURNS)).count() == 0
    ties = [(1, 3, "a", "b"), (1, 3, "c", "d"), (2, 3, "c", "d"), (2, 3, "a", "b")]
    got = prefix_trie.of_conversations(table(spark, tmp_path, ties, TURNS)).collect()
    assert {r.n_convs for r in got} == {2} and len(got) == 3


def test_rebuilt_conversations(spark, tmp_path):
    own = random_paths(4, 90, 2, 6) | {c: random_paths(abs(c), 1, 2, 3).popitem()[1] for c in (-40, -33, 0, 500, 503, 517)}
    want = {}
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + path[h:]
    rows = table(spark, tmp_path, conversations(own), TURNS)
    assert {tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.hashed(rows))).collect()} == brute(want)
    alone = table(spark, tmp_path, [(c, 0, "user", "one") for c in (1, 2, 3, 5)], TURNS)  # their base isn't there
    assert {tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.hashed(alone))).collect()} == brute({c: [("user", "one")][zlib.crc32(str(c).encode()) % 4 :] for c in (1, 2, 3, 5)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=400), st.integers(0, 3))
def test_findclose_delimits_subtrees(steps, deep):
    depths = [0] * 1 + list(range(1, 70 * deep))
    for s in steps:
        depths.append(max(1, depths[-1] + 2 - s))
    nodes, at = prefix_trie.encode(np.array(depths))
    close = nodes.findclose(at)
    leaves = nodes.pairs_in(at, close)
    for i, d in enumerate(depths):
        end = next((j for j in range(i + 1, len(depths)) if depths[j] <= d), len(depths))
        assert (close[i] - at[i] + 1) // 2 == end - i
        assert leaves[i] == sum(j + 1 == len(depths) or depths[j + 1] <= depths[j] for j in range(i, end))
