"""Operators against brute force, on small tables with nulls, ties, repeats, skew and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from groundsift.llm import chat, common, embeddings, langid, merkle, mixing, packing, resharding, simhash, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, block string"


def table(spark, tmp_path, rows, schema=DOCS, name="t"):
    """A written table; missing columns are null."""
    width = len(schema.split(", "))
    path = f"{tmp_path}/{name}-{random.random()}"
    spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "no id here"), (None, None), (4, "x"), (4, "x"), (4, "y"), (5, "a　b\xa0c   d"), (6, "9 + 9 = 18")]

# ---------------------------------------------------------------- blocks, ranks, components


def test_blocks_hash_words_alike_everywhere():
    texts = ["One two  two", None, "", "TWO one\n", "é two\té"]
    seen: dict[str, set] = {}
    for limit in (1, 8, 1000):
        for b in common.text_blocks(pa.array(texts), limit):
            b.words()
            raw = b.data.tobytes()
            for s, e, h, r in zip(b.word_start, b.word_end, b.word_hashes(), b.word_row):
                seen.setdefault(raw[s:e].decode(), set()).add(int(h))
                assert raw[s:e].decode() in [w for w in re.split(r"[\x20\x09-\x0D]+", (texts[b.first + r] or "").lower()) if w]
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen) == 3


def test_rank_of_a_hot_group_and_a_null_group(spark, tmp_path):
    rows = [("hot", i) for i in range(900)] + [(None, i) for i in range(50)] + [("one", 1)]
    got = common.rank_in(table(spark, tmp_path, rows, "g string, v long"), ["g"], ["v"], "r").collect()
    for g, n in (("hot", 900), (None, 50), ("one", 1)):
        assert sorted(x.r for x in got if x.g == g) == list(range(n))


def test_components_of_a_hub_and_a_chain(spark, tmp_path):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    got = {r.node: r.component for r in common.components(table(spark, tmp_path, edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 for i in range(61)) and 5000 not in got
    assert common.components(table(spark, tmp_path, [], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 packing


def test_packing_covers_every_id_once(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = table(spark, tmp_path, [*ODD, (7, prose(1, 3000)), *[(100 + i, prose(i % 3, 40)) for i in range(30)], (8, "a<|endoftext|>b")])
    rows = packing.pack(docs, length=64).collect()
    model = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)) for s in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for places in by.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= 64
    assert packing.pack(table(spark, tmp_path, [])).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=40))
@settings(max_examples=60, deadline=None)
def test_patterns_use_the_histogram_up(histogram):
    found = packing.patterns(histogram, 40)
    used = Counter()
    for count, pattern in found:
        assert sum(pattern) <= 40 and count > 0
        used.update({size: n * count for size, n in Counter(pattern).items()})
    assert dict(used) == histogram


# ---------------------------------------------------------------- 2 toxicity


def test_toxicity_finds_gapped_insults_and_spares_clean_texts(spark, tmp_path):
    r = random.Random(3)
    docs, labels = [*ODD], []
    for i in range(10, 610):
        words = prose(i, 30).split()
        if bad := i % 5 == 0:
            for _ in range(3):
                words[r.randrange(30)] = r.choice(["blockhead", "nitwit", "numbskull"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (10, None), (99999, 1)]
    held = [(2000, prose(9, 20) + " nitxwit " + prose(8, 5) + " n u m b s k u l l block-head"), (2001, prose(7, 30)), (2002, prose(5, 20) + " NITWIT blockhead numbskull")]
    d, lab = table(spark, tmp_path, docs + held), table(spark, tmp_path, labels, "doc_id long, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(held) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    p = {x.doc_id: x.predicted for x in got}
    assert (p[2000], p[2001], p[2002]) == (1, 0, 1)
    truth = dict(x for x in labels if x[0] and x[1] is not None)
    assert np.mean([p[i] == truth[i] for i in range(10, 610)]) > 0.98
    assert all(x.score == 0 for x in got if x.doc_id in (1, 2, 3, 6))
    assert {x.score for x in toxicity.toxicity(d, table(spark, tmp_path, [], "doc_id long, toxic int")).collect()} == {0.0}


def test_folded_machine_equals_kernel_features():
    units = [toxicity.letters(w) for w in ("blockhead", "a", "abcabcabcabcabca", "über")]
    weight = np.random.default_rng(0).normal(size=toxicity.PLACES).astype(np.float32)
    assert np.allclose(toxicity.unit_scores(units, weight, 0.5), toxicity.features(units) @ weight + 0.5, atol=1e-4)


# ---------------------------------------------------------------- 3 SimHash


def fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, tmp_path):
    base = prose(1, 400).split()
    near = []
    for i in range(60):
        words = list(base)
        words[i] = "changed"
        near.append((1000 + i, " ".join(words)))
    docs = [*ODD, *near, *[(2000 + i, base and " ".join(base)) for i in range(40)], *[(3000 + i, prose(i, 20)) for i in range(40)]]
    d = table(spark, tmp_path, docs)
    want_fp = [(k, fingerprint(t, 3)) for k, t in docs]
    values = sorted({f for _, f in want_fp})
    root = {f: f for f in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2 and find(a) != find(b):
                root[find(a)] = find(b)
    low = {}
    for k, f in want_fp:
        if k is not None:
            low[find(f)] = min(k, low.get(find(f), k))
    want = Counter((k, f"{f:016x}", low.get(find(f))) for k, f in want_fp)
    for crowd in (1024, 2):
        assert Counter(map(tuple, simhash.near_duplicates(d, crowd=crowd).collect())) == want
    kept = simhash.kept(d, width=3)
    assert kept.columns == d.columns
    assert Counter(find(fingerprint(r.text, 3)) for r in kept.collect()) == Counter({find(f): 1 for f in values})
    assert simhash.near_duplicates(table(spark, tmp_path, [])).count() == 0 and simhash.kept(table(spark, tmp_path, [])).count() == 0


@given(st.lists(st.integers(0, 255), unique=True, max_size=60), st.integers(0, 255))
def test_tree_finds_all_within_the_radius(values, query):
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.value[i] for i in tree.within(query, 2)) == sorted(v for v in values if (v ^ query).bit_count() <= 2)


# ---------------------------------------------------------------- 4 language


def test_language_and_rejection(spark, tmp_path):
    r = random.Random(1)
    parts = {"aa": "ka to mi re su na".split(), "bb": "sch pf ung ver zt ei".split()}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randrange(2, 5)))
    docs = [(i, " ".join(word(lang) for _ in range(60)), lang) for i in range(400) for lang in [r.choice(["aa", "bb"])]]
    junk = (900, " ".join("".join(r.choice("qxjwyvéß") for _ in range(7)) for _ in range(80)), None)
    d = table(spark, tmp_path, [*docs, *ODD, junk, (901, docs[0][1], None)])
    got = {x.doc_id: x for x in langid.language_of(d).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang in docs if i > 9)
    assert got[900].rejected and got[901].lang_pred == docs[0][2]
    kept = langid.kept(d)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} >= {i for i, _, _ in docs}
    assert {x.lang_pred for x in langid.language_of(table(spark, tmp_path, ODD)).collect()} == {"und"}
    assert langid.language_of(table(spark, tmp_path, [])).count() == 0


def test_kneser_ney_sums_to_one():
    counts = np.zeros((64, 64, 64), np.int64)
    rng = np.random.default_rng(5)
    for _ in range(3000):
        counts[tuple(rng.integers(0, 9, 3))] += 1
    trigram, weight, bigram = langid.Model._smooth(counts.ravel())
    assert np.allclose(trigram.reshape(64, 64, 64).sum(2), 1) and np.allclose(bigram.reshape(64, 64).sum(1), 1)


def test_letterless_texts_have_no_language():
    model = langid.Model(["a"], [np.ones(64**3, np.int64)])
    names, score, _, rejected = model.judge([None, "", "12 + 3 \n", "word"])
    assert names == ["und", "und", "und", "a"] and rejected[:3].all() and (score[:3] == 0).all()


# ---------------------------------------------------------------- 5 sharding


@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.integers(1, 5))
@settings(max_examples=40, deadline=None)
def test_flow_moves_the_fewest_bytes(supply, m):
    total = sum(supply)
    room = [total // m + (j < total % m) for j in range(m)]
    cost = [[int(i != j) for j in range(m)] for i in range(len(supply))]
    flow = resharding.min_cost_flow(supply, room, cost)
    assert [sum(r) for r in flow] == supply and all(sum(r[j] for r in flow) <= room[j] for j in range(m))
    stays = sum(min(supply[i], room[i]) for i in range(min(len(supply), m)))
    assert sum(flow[i][j] for i in range(len(supply)) for j in range(m) if i != j) == total - stays


def test_sharding_is_even_and_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = [*ODD, *[(100 + i, prose(i % 50, 20)) for i in range(600)], (5000, prose(3, 1500))]
    d = table(spark, tmp_path, docs).select("doc_id", "text")
    plan, folder = resharding.reshard(d, F.pmod(F.xxhash64("doc_id"), F.lit(3)), 3, [1] * 4)
    got = resharding.digests(spark.read.parquet(folder)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in docs)
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert max(size.values()) < 1.05 * min(size.values()) and plan.affected() == {0, 1, 2, 3}
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    same, _ = resharding.reshard(d, F.lit(0), 1, [1])
    assert same.moved == 0 and same.affected() <= {0}
    _, empty = resharding.reshard(d.limit(0), F.lit(0), 1, [1, 1])
    assert spark.read.schema("row struct<doc_id:long,text:string>, shard int").parquet(empty).count() == 0


# ---------------------------------------------------------------- 6 chat


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<%3C"]), st.lists(st.sampled_from(
    ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "im_end|>", "assistant", " ok"]), max_size=6).map("".join)), max_size=4))
@settings(max_examples=100, deadline=None)
def _cases(case):
    _CASES.append(case)


_CASES: list = []


def test_chat_round_trip(spark):
    _cases()
    rows = [(c, t, role, text) for c, turns in enumerate(_CASES) for t, (role, text) in enumerate(turns)]
    rows += [(-5, 0, None, None), (None, 0, "assistant", "<|im_end|>"), (-6, 1, "user", "b"), (-6, 1, "user", "a"), (-6, 1, "user", "a")]
    df = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(df).collect()}
    whole = {r.conv_id: r for r in df.collect()}
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(x.role, x.text) for x in whole[c].parsed] == turns
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        loss = "".join(x for r, x in turns if r == "assistant")
        assert back[c].loss_chars == len(loss) and back[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert whole[c].formatted.count("<|im_end|>") == len(turns) and back[c].formatted_chars == len(whole[c].formatted)
    assert chat.format_conversations(df.limit(0).selectExpr("conv_id", "0L as turn", "'' as role", "'' as text")).count() == 0


# ---------------------------------------------------------------- 7 mixing


def test_mixing_stays_within_a_block_of_the_targets(spark, tmp_path):
    docs = [(i, "t", "x", "hot") for i in range(700)] + [(1000 + i, "t", "x", "b") for i in range(90)] + [(2000 + i, None, "x", None) for i in range(10)]
    docs += [(7, "t", "x", "hot"), (None, "t", "x", "b")]
    d = table(spark, tmp_path, docs)
    got = mixing.mix(d, block_rows=8, period=64)
    assert got.columns == ["row", "epoch", "block", "place", "slot", "release", "due"] and got.select("row.*").columns == d.columns
    rows = got.collect()
    assert Counter((r.row.doc_id, r.row.source) for r in rows if r.epoch == 0) == Counter((x[0], x[3]) for x in docs)
    blocks = {(r.row.source, r.epoch, r.block): (r.slot, r.release, r.due) for r in rows}
    assert sorted(s for s, _, _ in blocks.values()) == list(range(len(blocks)))
    assert all(r <= s < d_ for s, r, d_ in blocks.values())
    weights = {r.source: r.part / r.period for r in mixing.plan(d, block_rows=8, period=64).collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    for source, w in weights.items():
        slots = sorted(s for (x, _, _), (s, _, _) in blocks.items() if x == source)
        for t in range(1, len(blocks) + 1):
            assert abs(sum(s < t for s in slots) - w * t) < 1
    targets = spark.createDataFrame([("hot", 1.0), ("b", 1.0), (None, 2.0), ("absent", 5.0)], "source string, target double")
    assert {r.source: r.part for r in mixing.plan(d, targets, period=64).collect()} == {"hot": 16, "b": 16, None: 32}
    with pytest.raises(Exception, match="no target weight"):
        mixing.mix(d, targets.where("source = 'hot'")).collect()
    assert mixing.mix(table(spark, tmp_path, [])).count() == 0


# ---------------------------------------------------------------- 8 fingerprints


def test_edited_documents(spark, tmp_path):
    docs = [(i, prose(i, 30) + "\n\n" + prose(i + 50, 30) + "\nend.") for i in range(40)] + [(50, None), (51, ""), (52, "é"), (53, docs_text := "same text here. ok"), (54, docs_text), (54, docs_text)]
    d = table(spark, tmp_path, docs)
    got = merkle.edited(d).collect()
    order = sorted({(k, t or "") for k, t in docs})
    want = Counter()
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]]):
        q = len(t) // 4
        want[k, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()] += 2 if k == 54 else 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    texts = dict(order)
    prints: dict = {}
    for r in got:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert all(len(v) == 1 for v in prints.values()) and len({next(iter(v)) for v in prints.values()}) == len(prints)
    assert np.mean([r.near_edited for r in got if r.doc_id < 40]) >= 0.2 + np.mean([r.near_next for r in got if r.doc_id < 39])
    assert merkle.edited(table(spark, tmp_path, [])).count() == 0
    assert merkle.edited(table(spark, tmp_path, [(1, "alone it is")])).first().near_next == 1


def test_branches_that_differ(spark):
    df = spark.createDataFrame([("a\nb\n\nc\nd", "a\nb\n\nc\nX\ne"), ("same", "same")], "x string, y string")
    from pyspark.sql import functions as F

    got = df.select(merkle.differing(merkle.tree(F.col("x")), merkle.tree(F.col("y"))).alias("d")).collect()
    assert [tuple(p) for p in got[0].d] == [(1, 1), (1, 2)] and got[1].d == []


# ---------------------------------------------------------------- 9 passages


def test_passages_are_found_and_cut(spark, tmp_path):
    shared = prose(7777, 70).split()
    docs = [*ODD, *[(i, prose(i, 120)) for i in range(10, 60)]]
    for i in range(60, 100):  # fuzzy copies of one passage: a word changed, one left out, one put in
        words = list(shared)
        words[20 + i % 20] = "changed"
        del words[50]
        words.insert(10, "extra")
        docs.append((i, prose(i, 60) + " " + " ".join(words) + " " + prose(i + 500, 40)))
    docs.append((100, docs[12][1]))
    docs.append((101, prose(13, 118) + " other end"))  # a near copy: little is left
    d = table(spark, tmp_path, docs)
    got = substrings.passages(d).collect()
    texts = dict(docs)
    assert {x.doc_id for x in got} == set(range(61, 102)) and all(x.other_id < x.doc_id and x.similarity >= 0.8 for x in got)
    for x in got:
        piece = texts[x.doc_id].encode()[x.start_byte : x.end_byte].decode()
        assert len(piece.split()) == x.words >= 50
        if x.doc_id < 100:
            assert len(set(piece.split()) & set(shared)) > 0.85 * len(set(shared))
    kept = substrings.without_passages(d, substrings.passages(d))
    assert kept.columns == d.columns
    left = {x.doc_id: x.text for x in kept.collect() if x.doc_id and x.doc_id > 9}
    assert 100 not in left and 101 not in left and left[60] == texts[60] and all(left[i] == texts[i] for i in range(10, 60))
    assert all(90 <= len(left[i].split()) <= 110 for i in range(61, 100))
    assert kept.where("doc_id is null").count() == 2
    assert substrings.passages(table(spark, tmp_path, [])).count() == 0


def test_fuzzy_passages_are_found_down_to_the_similarity(spark, tmp_path):
    rng = np.random.default_rng(11)
    docs, cases = [], []
    words = lambda n: ["w%x" % v for v in rng.integers(0, 1 << 40, n)]
    for n in (50, 60, 80, 100):
        for share in (0.1, 0.15, 0.2):
            for _ in range(25):
                x = words(n)
                y = list(x)
                for i in 1 + rng.choice(n - 2, int(share * n), replace=False):
                    y[i] = "v%x" % rng.integers(0, 1 << 40)
                cases.append((n, share))
                docs += [(2 * len(cases), " ".join(words(60) + x + words(60))), (2 * len(cases) + 1, " ".join(words(60) + y + words(60)))]
    got = {r.doc_id // 2 for r in substrings.passages(table(spark, tmp_path, docs)).collect()}
    found = Counter(c for i, c in enumerate(cases, 1) if i in got)
    assert all(found[c] >= 24 for c in set(cases)), sorted(found.items())


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_a_dense_run_is_found_where_there_is_one(steps):
    pairs = [(n + sum(a for a, _ in steps[:n]), n + sum(c for _, c in steps[:n])) for n in range(len(steps))]
    size = lambda a, b: max(pairs[b][0] - pairs[a][0], pairs[b][1] - pairs[a][1]) + 1
    fits = lambda a, b: size(a, b) >= 8 and b - a + 1 >= 0.8 * size(a, b)
    got = substrings.dense_runs(pairs, 8, 0.8)
    assert all(fits(a, b) and n == b - a + 1 for a, b, n in got)
    taken = {k for a, b, _ in got for k in range(a, b + 1)}
    assert not [(a, b) for a in range(len(pairs)) for b in range(a, len(pairs)) if fits(a, b) and not taken & set(range(a, b + 1))]


def test_rest_of_a_covered_document_stays(spark, tmp_path):
    # B is P and under a fifth of its own words U; C holds U as well and loses it to B
    p, u = prose(1, 700), prose(2, 120)
    docs = [(1, p), (2, p + " " + u), (3, prose(3, 90) + " " + u), (4, p + " one two three four"), (5, p + " six seven eight nine ten")]
    d = table(spark, tmp_path, docs)
    left = {x.doc_id: x.text.split() for x in substrings.without_passages(d, substrings.passages(d)).collect()}
    assert len(u.encode()) < 0.2 * len(docs[1][1].encode())
    assert left[1] == p.split() and left[2] == u.split() and left[3] == prose(3, 90).split()
    assert 4 not in left and left[5] == ["six", "seven", "eight", "nine", "ten"]


def test_hot_seed_makes_no_pairs_of_all(spark, tmp_path):
    line = prose(5, 60)
    d = table(spark, tmp_path, [(i, prose(i, 30) + " " + line) for i in range(400)])
    assert substrings.chains(d).count() < 3 * 400
    assert {x.doc_id for x in substrings.passages(d).collect()} == set(range(1, 400))


def test_passage_hidden_by_other_holders_is_found(spark, tmp_path):
    # twelve stretches of nine words; documents 20 and 500 hold them in one order, a word of their own between, others each in another order
    bits = [prose(900 + i, 9) for i in range(12)]
    docs = [(i, prose(i, 40) + " " + " ".join(f"{b} own{i}x{k}" for k, b in enumerate(bits)) + " " + prose(i + 50, 40)) for i in (20, 500)]
    for i in [*range(1, 20), *range(21, 61)]:
        order = random.Random(i).sample(bits, 12)
        docs.append((i, " ".join(b + " " + prose(1000 * i + k, 30) for k, b in enumerate(order))))
    d = table(spark, tmp_path, docs).coalesce(1)
    want = {(r.doc_id, r.other_id) for r in substrings.passages(d, few_places=1000).collect()}
    assert (500, 20) in want
    assert {(r.doc_id, r.other_id) for r in substrings.passages(d).collect()} == want
    assert {(r.doc_id, r.other_id) for r in substrings.passages(d.repartition(7), few_places=3).collect()} == want


def test_documents_take_turns_and_hot_seeds_are_marked_once(spark, tmp_path, monkeypatch):
    # forty hot words beside each lone seed: a place gets one row with its marks, not one a hot seed
    lines = [prose(700 + i, 12) for i in range(3)]
    docs = [(i, " ".join([prose(i, 30), *lines[: 1 + i % 3], prose(3000 + i // 2, 45), prose(i + 900, 20)])) for i in range(120)]
    d = table(spark, tmp_path, docs)
    want = sorted(map(tuple, substrings.passages(d).collect()))
    assert {(r[0], r[5]) for r in want} >= {(i + 1, i) for i in range(0, 120, 2) if i % 3 < 2}
    turns = []
    monkeypatch.setattr(substrings, "SLICE_LINKS", 2000)
    inner = substrings._chains
    monkeypatch.setattr(substrings, "_chains", lambda *a: turns.append((a[-1], inner(*a))) or turns[-1][1])
    assert sorted(map(tuple, substrings.passages(d).collect())) == want
    assert len(turns) > 1 and all(r.doc % len(turns) == k for k, df in turns for r in df.collect())
    rows = pa.table({"doc": [1] * 44, "pos": list(range(0, 440, 10)), "hash": [7] * 20 + [None] + [7] * 20 + [None] * 3})
    assert [len(m) for b in substrings._mark_rows(iter(rows.to_batches())) for m in b.column("marks").to_pylist()] == [2, 1, 1, 1]


def common_subsequence(x, y):
    """Places of a longest common subsequence, by the table."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    return range(best[0][0])



@given(st.lists(st.sampled_from("abcdefg"), max_size=40), st.lists(st.sampled_from("abcdefg"), max_size=40))
@settings(max_examples=60, deadline=None)
def test_alignment_is_as_long_as_the_common_subsequence(x, y):
    x, y = [c.encode() for c in x], [c.encode() for c in y]
    pairs = substrings.matches(x, y)
    assert all(x[i] == y[j] for i, j in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(pairs) == best[-1][-1]


def test_chain_follows_both_texts():
    segments = [(0, 50, 0, 50, 4), (60, 120, 65, 125, 5), (130, 180, 20, 70, 4), (190, 240, 200, 250, 4)]
    assert substrings.chain(segments)[0] == (0, 240, 0, 250, 13)


def test_long_run_hides_no_near_predecessor():
    far = (0, 9000, 0, 9000, 60)
    edited = [(12000, 12000, 15000, 15000, 1), (12050, 12090, 15060, 15100, 2), (12130, 12130, 15150, 15150, 1)]
    assert (12000, 12130, 15000, 15150, 4) in substrings.chain([far, *edited])


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9), st.integers(0, 60), st.integers(0, 9), st.integers(1, 4)), min_size=2, max_size=25))
@settings(max_examples=200, deadline=None)
def test_chain_takes_the_best_predecessor_in_reach(cases):
    segments, gap = [(a, a + n, c, c + m, k) for a, n, c, m, k in cases], 12
    near = substrings.Near([s[3] for s in segments], gap)
    put: list = []
    for start, kind, i in sorted([(s[0], 1, i) for i, s in enumerate(segments)] + [(s[1], 2, i) for i, s in enumerate(segments)]):
        _, end, ostart, oend, k = segments[i]
        if kind == 2:
            near.put(end, oend, k, i)
            put.append((k, i))
        else:
            reach = [(k, j) for k, j in put if start - segments[j][1] <= gap and 0 < ostart - segments[j][3] <= gap]
            assert near.top(start, ostart)[0] == max(reach, default=(-1e18, -1))[0]


def test_alignment_where_no_word_stands_once():
    rng = np.random.default_rng(6)
    line = [b"no", b"stone", b"no", b"sand", b"no", b"clay"]
    x, y = line * 20, [b"head", b"head", *line * 9, b"gap", b"gap", *line * 9]
    assert len(substrings.matches(x, y)) == 108
    for n, m in ((70, 90), (200, 60), (1, 3000), (130, 130)):
        x, y = ([b"%d" % v for v in rng.integers(0, 5, k)] for k in (n, m))
        best = len(common_subsequence(x, y))
        for cells in (1 << 27, 500):
            pairs = sorted(substrings._longest(x, y, 0, 0, cells))
            assert len(pairs) == best and all(x[i] == y[j] for i, j in pairs)
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


# ---------------------------------------------------------------- 10 embeddings


@pytest.mark.parametrize("crowd", [4096, 40])
def test_embeddings_against_all_pairs(spark, tmp_path, crowd):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(150, 16))
    hot = base[0] + 0.02 * rng.normal(size=(120, 16))
    vectors = [*base.tolist(), *hot.tolist(), base[3].tolist(), (2 * base[3]).tolist()]
    rows = [(i, v, i % 2 if i < 150 else 0) for i, v in enumerate(vectors)]
    rows += [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [None] * 16, 0), (9004, base[3].tolist(), None),
             (9005, [], 0), (9006, [1.0], 0), (None, base[5].tolist(), 1), (7, base[7].tolist(), 1), (9007, [float("inf")] * 16, 0)]
    d = table(spark, tmp_path, rows, "vec_id long, embedding array<double>, label int, node string, key string")
    got = embeddings.near_duplicates(d, crowd=crowd, cluster=60)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    sound = [(k, np.array(v), lab) for k, v, lab in rows if lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    want = Counter()
    n = len(sound)
    link = [[i != j and sound[i][2] == sound[j][2] and sound[i][1] @ sound[j][1] / np.sqrt((sound[i][1] @ sound[i][1]) * (sound[j][1] @ sound[j][1])) >= 0.93 for j in range(n)] for i in range(n)]
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in range(n):
                if link[a][b] and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [sound[j][0] for j in seen if sound[j][0] is not None]
        low = min(ids) if ids else None
        want[sound[i][0], sum(link[i]), low] += 1
    for k, v, lab in rows:
        if not any(k == s[0] for s in sound):
            want[k, 0, k] += 1
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got.collect()) == want
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_graph_candidates_are_read_once_a_row():
    rng = np.random.default_rng(6)
    x = embeddings.units(np.repeat(rng.normal(size=(100, 16)), 5, 0) + rng.normal(0, 0.05, (500, 16)))

    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, at):
            Counted.read += np.asarray(at).size if isinstance(at, np.ndarray) and at.ndim == 2 and self.shape[-1:] == (16,) else 0
            return super().__getitem__(at)

    graph = embeddings.robust_graph(x.view(Counted), degree=8)
    assert 0 < Counted.read <= 2 * 500 * 32  # not once for each of the eight steps
    near = embeddings.both_ways(np.asarray(graph))
    want = [{int(j) for j in row if j >= 0} | {i for i in range(500) if n in graph[i]} for n, row in enumerate(np.asarray(graph))]
    assert [set(v.tolist()) for v in near] == want and all(len(set(v.tolist())) == len(v) for v in near)
    assert [len(v) for v in embeddings.both_ways(np.full((1, 8), -1))] == [0] and embeddings.both_ways(np.array([[1, -1], [-1, -1]]))[1].tolist() == [0]


def test_cut_passages_leave_other_columns_alone(spark, tmp_path):
    names = "d k row spans new text_key _key _new _spans _d _k".split()
    shared = prose(9, 80)
    rows = [(1, prose(1, 40) + " " + shared, *["mine"] * len(names)), (2, prose(2, 40) + " " + shared, *["yours"] * len(names)), (None, shared, *["none"] * len(names)), (3, None, *["empty"] * len(names))]
    d = table(spark, tmp_path, rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r for r in substrings.without_passages(d, substrings.passages(d)).collect()}
    assert {i: {r[n] for n in names} for i, r in got.items()} == {1: {"mine"}, 2: {"yours"}, None: {"none"}, 3: {"empty"}}
    assert got[1].text == rows[0][1] and got[2].text.split() == prose(2, 40).split() and got[3].text is None
