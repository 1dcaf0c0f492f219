"""Texts of over a megabyte, where blocks and pieces change path; language models recomputed by hand."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from groundsift.llm import common, langid, packing, simhash, substrings

from test_llm_operators import fingerprint, prose, table

LONG = prose(77, 170_000)


def test_long_texts_are_read_whole(spark, tmp_path):
    from tokenizers import Tokenizer

    assert len(LONG) > common.BLOCK_BYTES
    d = table(spark, tmp_path, [(1, LONG), (2, "a few words"), (3, LONG[: -len(LONG) // 7]), (4, "\n" + LONG[:50] + "\n\n\tWord\r\nword")])
    model = Tokenizer.from_file(packing.vocabulary_path())
    got = {(r.doc_id, r.start): r for r in packing.pack(d).collect()}
    for r in d.collect():
        ids = np.array([*model.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            assert got[r.doc_id, s].ids_crc32 == zlib.crc32(ids[s : s + 1024].tobytes()) and got[r.doc_id, s].doc_tokens == len(ids)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in simhash.near_duplicates(d).collect()}
    assert prints == {r.doc_id: fingerprint(r.text, 3) for r in d.collect()}
    found = [r for r in substrings.passages(d).collect() if (r.doc_id, r.other_id) == (3, 1)]
    assert sum(r.words for r in found) >= 0.99 * len(LONG[: -len(LONG) // 7].split())


def test_known_runs_move_on_to_the_younger_generation(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    encoder = packing.Encoder(packing.vocabulary_path())
    for seed in (1, 2, 1, 3, 1):
        texts = [prose(seed, 120), "", prose(seed + 10, 30)]
        for block in common.text_blocks(pa.array(texts)):
            ids, bounds = encoder.encode(block)
            for i, t in enumerate(texts):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == [*encoder.model.encode(t, add_special_tokens=False).ids, 0]


def by_hand(texts):
    """Interpolated Kneser-Ney over folded characters, from dictionaries; a function of (two, one, character)."""
    counts = Counter()
    for t in texts:
        gram, _ = langid.trigrams([t])
        counts.update((int(g) >> 12, int(g) >> 6 & 63, int(g) & 63) for g in gram)
    contexts = defaultdict(set)
    for two, one, c in counts:
        contexts[one, c].add(two)
    follows = {k: len(v) for k, v in contexts.items()}
    before = Counter(c for _, c in follows)

    def discount(values):
        n1, n2 = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    d2, d3 = discount(follows.values()), discount(counts.values())

    def unigram(c):
        return (before[c] + 0.5) / (sum(before.values()) + 0.5 * 64)

    def bigram(one, c):
        own = [n for (o, _), n in follows.items() if o == one]
        if not own:
            return unigram(c)
        return max(follows.get((one, c), 0) - d2, 0) / sum(own) + d2 * len(own) / sum(own) * unigram(c)

    def trigram(two, one, c):
        own = [n for (a, b, _), n in counts.items() if (a, b) == (two, one)]
        if not own:
            return bigram(one, c)
        return max(counts[two, one, c] - d3, 0) / sum(own) + d3 * len(own) / sum(own) * bigram(one, c)

    return trigram


def test_cross_entropy_is_that_of_the_smoothed_counts():
    taught = {"x": ["the then them", "other there 12 this", "A the"], "y": ["alle aller alles", "ällen álle", "esel esse"]}
    names, counts = sorted(taught), []
    for name in names:
        gram, _ = langid.trigrams(taught[name])
        counts.append(np.bincount(gram, minlength=64**3))
    model, hand = langid.Model(names, counts), {n: by_hand(taught[n]) for n in names}
    texts = ["the other", "alles", "zq ž", "Then alle", "é"]
    h, size = model.cross_entropy(texts)
    for i, t in enumerate(texts):
        gram, _ = langid.trigrams([t])
        assert size[i] == len(gram)
        for k, n in enumerate(names):
            want = -sum(math.log(hand[n](int(g) >> 12, int(g) >> 6 & 63, int(g) & 63)) for g in gram) / len(gram)
            assert h[i, k] == pytest.approx(want, rel=1e-4)
    for two, one in ((0, 0), (20, 8), (8, 5), (63, 63)):  # probabilities of a context add up to one
        assert sum(hand["x"](two, one, c) for c in range(64)) == pytest.approx(1)
    assert model.judge(["the other", "alles esel"])[0] == ["x", "y"]


def test_long_text_in_pieces_is_judged_like_its_sum(monkeypatch):
    text = "wordy words " * 3000
    whole = langid.trigrams([text])[0]
    monkeypatch.setattr(langid, "PIECE", 1000)
    parts = list(langid.pieces([text, "b", None, text]))
    assert [len(p) for _, p in parts] and sum(len(p) for _, p in parts) == 4 and parts[0][1][0] == text
    assert np.array_equal(langid.trigrams(parts[0][1])[0], whole)
