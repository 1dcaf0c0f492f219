"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts common subsequences of four letters, gaps allowed: an
occurrence that spans s letters weighs DECAY**(s - 4), spans over SPAN don't
count; the 2**20 subsequences are hashed to 2**16 places.  So "idxiot" stays near "idiot", and marks put between letters vanish,
since only letters are read.  A unit is a word, a run of single letters written
apart, or each window of a long word.

A label belongs to a document, so its sentences carry it in bulk and training
looks for what makes them toxic: units that clean sentences never hold are
taken greedily, each that explains most toxic documents that are still
unexplained (the witnesses); units of clean sentences are the other class, and
after each training the clean units that score highest join it.  Landmarks are
drawn from both classes, features are kernel values against them times the
inverse root of their own kernel matrix, and a linear machine is trained on
these.  Since the kernel is a sum over subsequences, the trained machine folds
into one weight per subsequence, which scores a unit without a loop over
landmarks.  A document scores by its three worst units and its length, through a
logistic curve fitted on the training documents: one syllable that looks like
an insult by chance weighs less than several.

Training reads at most about ``TRAIN_DOCS`` labelled documents a class, drawn by
hash of the id from the training fold.  Scoring reads every text as a whole.
Null and empty texts and texts without a letter score 0.  Labels whose document
is missing, null labels and documents without a label teach nothing; of a
document labelled twice the larger label counts.  Without labels of both classes
every score is 0.  Repeated rows and null ids are scored like any other.  Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import arrow_map, cut, single, text_blocks, training_fold

SYMBOLS = 32  # 1..26 letters, 27..30 other letters by code point, 31 edge of a unit, 0 none
EDGE = 31
SPAN, DECAY = 6, 0.6
#: places of hashed subsequences
PLACES = 1 << 16
#: letters of a window of a long word, and from one window to the next
WINDOW, STRIDE = 16, 8
LANDMARKS = 384
#: labelled documents a class that training may read
TRAIN_DOCS = 4000
#: units of each kind that the driver takes for training
CANDIDATES, NEGATIVES = 5000, 2000
ROUNDS = 4
#: worst units of a document that its score looks at
TOP = 3

_LETTER: dict[str, int] = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}


def letters(word: str) -> bytes:
    """Codes of the letters of a word; everything else is dropped."""
    out = bytearray()
    for c in word.lower():
        code = _LETTER.get(c)
        if code is None:
            code = _LETTER[c] = 27 + ord(c) % 4 if unicodedata.category(c)[0] == "L" else 0
            if len(_LETTER) > 100_000:
                for k in [k for k in _LETTER if k > "z"]:
                    del _LETTER[k]
        if code:
            out.append(code)
    return bytes(out)


def windows(codes: bytes) -> list[bytes]:
    if len(codes) <= WINDOW:
        return [codes] if codes else []
    return [codes[i : i + WINDOW] for i in range(0, len(codes) - STRIDE, STRIDE)]


#: places of the second to fourth letter behind the first, and the weight
_GAPS = [(a, b, c, DECAY ** (c - 3)) for a in range(1, SPAN - 2) for b in range(a + 1, SPAN - 1) for c in range(b + 1, SPAN)]


def _place(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Hashed place of four codes."""
    return (((((p << 5 | q) << 5 | r) << 5 | s).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


def _matrix(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes with edges, one row per unit, and lengths with edges."""
    sizes = np.array([len(u) + 2 for u in units], np.int64)
    wide = np.zeros((len(units), WINDOW + 2), np.int32)
    flat = np.frombuffer(b"".join(bytes([EDGE]) + u + bytes([EDGE]) for u in units), np.uint8)
    row = np.repeat(np.arange(len(units)), sizes)
    wide[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return wide, sizes


def _norms() -> np.ndarray:
    """Root of the summed squares of the weights of a unit's occurrences, by its length with edges."""
    out = np.ones(WINDOW + 3)
    for n in range(WINDOW + 3):
        total = sum(w * w * max(0, n - c) for _, _, c, w in _GAPS)
        out[n] = total**0.5 if total else 1.0
    return out


_NORM = _norms()


def features(units: list[bytes]) -> np.ndarray:
    """Weights of all subsequences (units x PLACES); for training, on bounded lists."""
    wide, sizes = _matrix(units)
    out = np.zeros((len(units), PLACES), np.float32)
    rows = np.arange(len(units))
    for a, b, c, w in _GAPS:
        for i in range(WINDOW + 2 - c):
            ok = i + c < sizes
            at = _place(wide[ok, i], wide[ok, i + a], wide[ok, i + b], wide[ok, i + c])
            np.add.at(out, (rows[ok], at), np.float32(w))
    return out / _NORM[sizes][:, None].astype(np.float32)


def unit_scores(units: list[bytes], weight: np.ndarray, bias: float) -> np.ndarray:
    """Decision values of units by the folded machine."""
    if not units:
        return np.zeros(0)
    wide, sizes = _matrix(units)
    order = np.argsort(-sizes, kind="stable")
    columns, sizes_ = np.ascontiguousarray(wide[order].T), sizes[order]
    total = np.zeros(len(units), np.float32)
    for i in range(WINDOW):
        for a, b, c, w in _GAPS:
            n = int(np.searchsorted(-sizes_, -(i + c), "left"))  # units longer than i + c
            if n and i + c < WINDOW + 2:
                total[:n] += np.float32(w) * weight[_place(columns[i, :n], columns[i + a, :n], columns[i + b, :n], columns[i + c, :n])]
    out = np.empty(len(units))
    out[order] = total / _NORM[sizes_] + bias
    return out


def block_units(block) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different units of a block, and (row, unit) of each that comes up."""
    block.words()
    raw = block.data.tobytes()
    _, one, same = np.unique(block.word_hashes(), return_index=True, return_inverse=True)
    units: dict[bytes, int] = {}
    of_word: list[list[int]] = [[units.setdefault(u, len(units)) for u in windows(letters(raw[a:b].decode()))]
                                for a, b in zip(block.word_start[one].tolist(), block.word_end[one].tolist())]
    count = np.array([len(x) for x in of_word], np.int64)
    flat = np.array([u for x in of_word for u in x], np.int64)
    first = np.cumsum(count) - count
    each = count[same]
    row = np.repeat(block.word_row, each)
    inner = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    unit = flat[np.repeat(first[same], each) + inner]
    # letters written apart
    alone = (block.word_end - block.word_start <= 2).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], alone, [0]])))
    more_row, more_unit = [], []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < 3:
            continue
        codes = [letters(raw[s:e].decode()) for s, e in zip(block.word_start[a:b].tolist(), block.word_end[a:b].tolist())]
        rows = block.word_row[a:b].tolist()
        run, at = b"", rows[0]
        for c, r in [*zip(codes, rows), (b"", -1)]:
            if r != at or len(c) != 1:
                if len(run) >= 3:
                    for u in windows(run):
                        more_row.append(at)
                        more_unit.append(units.setdefault(u, len(units)))
                run, at = b"", r
            if len(c) == 1:
                run += c
    if more_row:
        row, unit = np.concatenate([row, more_row]), np.concatenate([unit, more_unit])
    return list(units), row, unit


class Machine:
    """Folded weights of the kernel machine, and the curve from a document's features to its score."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias, self.curve = weight.astype(np.float32), bias, np.zeros(TOP + 2)

    def look(self, block) -> np.ndarray:
        """Features of each row of a block: the highest decision values, the log of the number of units, one; no unit: not a number."""
        units, row, unit = block_units(block)
        rows = len(block.start)
        value = unit_scores(units, self.weight, self.bias)[unit]
        order = np.lexsort((-value, row))
        count = np.bincount(row, minlength=rows)
        first = np.cumsum(count) - count
        out = np.ones((rows, TOP + 2))
        ranked = np.append(value[order], np.nan)
        for k in range(TOP):  # where there are fewer units the lowest counts on
            out[:, k] = ranked[np.where(count > 0, first + np.minimum(k, count - 1), len(ranked) - 1)]
        out[:, TOP] = np.log1p(count)
        return out

    def probability(self, looks: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(looks @ self.curve, -500, 500)))
        return np.where(np.isnan(p), 0.0, p)


def fit(toxic: list[bytes], clean: list[bytes]) -> Machine:
    """Squared-hinge machine on Nyström features, classes weighed alike, folded into subsequence weights."""
    rng = np.random.default_rng(7)
    half = LANDMARKS // 2
    marks = toxic[:half] + [clean[i] for i in rng.permutation(len(clean))[:half]]
    z = features(marks)
    value, vector = np.linalg.eigh((z @ z.T).astype(float))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    fold = z.T @ root.astype(np.float32)  # subsequences x features
    units = toxic + clean
    x = np.concatenate([features(units[i : i + 256]) @ fold for i in range(0, len(units), 256)]).astype(float)
    x = np.hstack([x, np.ones((len(x), 1))])
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    c = np.where(y > 0, 50.0 / len(toxic), 50.0 / len(clean))
    ridge = np.full(x.shape[1], 0.05)
    ridge[-1] = 1e-4
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps over the rows inside the margin
        inside = y * (x @ w) < 1
        a = x[inside] * c[inside, None]
        new = np.linalg.solve(a.T @ x[inside] + np.diag(ridge), a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return Machine(fold @ w[:-1].astype(np.float32), float(w[-1]))


def calibrate(machine: Machine, looks: np.ndarray, toxic: np.ndarray, prior: float) -> None:
    """Logistic curve through the documents' features, classes weighed by their share of all labelled documents."""
    seen = ~np.isnan(looks).any(1)
    x, t = looks[seen], toxic[seen].astype(float)
    if not t.any() or t.all():
        return
    n1, n0 = t.sum(), (1 - t).sum()
    goal = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(t > 0, prior / n1, (1 - prior) / n0)
    ridge = np.append(np.full(x.shape[1] - 1, 1e-4), 1e-8)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (p - goal)) + ridge * w)
        w = w - np.clip(step, -3, 3)
        if abs(step).max() < 1e-7:
            break
    machine.curve = w


def _per_block(df: DataFrame, work, schema: str, *carried: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in carried}
            for block in text_blocks(batch.column("text")):
                yield from work(block, {c: v[block.first : block.first + len(block.start)] for c, v in columns.items()})

    return arrow_map(df, run, schema)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS) -> tuple[DataFrame, float]:
    """``(doc_id, text, toxic)`` of about ``per_class`` labelled training documents a class, equal texts once, written; and the share of toxic labels."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & training_fold()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class / max(1, size.get(1, 0))))).otherwise(F.lit(min(1.0, per_class / max(1, size.get(0, 0)))))
    drawn = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")  # about ``per_class`` ids a class
               .groupBy(F.xxhash64("text").alias("_t"), "toxic").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.doc_id", "d.text", "toxic"))
    return rows, size.get(1, 0) / max(1, sum(size.values()))


def train(rows: DataFrame, prior: float) -> Machine | None:
    """``rows(doc_id, text, toxic)``, bounded and written, to a machine; none without both classes.  ``prior``: share of toxic labels."""
    def counts(block, col):
        units, row, unit = block_units(block)
        pairs = np.unique(row * len(units) + unit) if len(units) else np.zeros(0, np.int64)
        row, unit = np.divmod(pairs, max(len(units), 1))
        bad = col["toxic"][row] == 1
        yield pa.RecordBatch.from_arrays([pa.array(units, pa.binary()), pa.array(np.bincount(unit[bad], minlength=len(units))),
                                          pa.array(np.bincount(unit[~bad], minlength=len(units)))], ["unit", "bad", "good"])

    stats = cut(_per_block(rows, counts, "unit binary, bad long, good long", "toxic").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    size = rows.agg(F.sum("toxic").alias("bad"), F.count("*").alias("all")).first()
    spread = stats.groupBy((F.col("bad") + F.col("good")).alias("n")).agg(F.count("*").alias("units"), F.sum((F.col("good") == 0).cast("long")).alias("only")).where("n <= 64").collect()
    least = evidence({r["n"]: (r["units"], r["only"]) for r in spread}, (size["bad"] or 0) / max(1, size["all"]))
    suspects = [bytes(r["unit"]) for r in stats.where((F.col("good") == 0) & (F.col("bad") >= least)).orderBy(F.desc("bad"), "unit").limit(CANDIDATES).collect()]
    common = stats.where("good > 0").orderBy(F.desc("good"), "unit").limit(NEGATIVES).collect()
    others = stats.where("good > 0").orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES).collect()
    clean = list(dict.fromkeys(bytes(r["unit"]) for r in [*common, *others]))
    if not suspects or not clean:
        return None
    number = {u: i for i, u in enumerate(suspects)}

    def hits(block, col):
        units, row, unit = block_units(block)
        known = np.array([number.get(u, -1) for u in units], np.int64)[unit] if len(units) else np.zeros(0, np.int64)
        pairs = np.unique((row[known >= 0] << 20) | known[known >= 0])
        lists: list[list[int]] = [[] for _ in block.start]
        for p in pairs.tolist():
            lists[p >> 20].append(p & 0xFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64()))], ["hits"])

    held = [r["hits"] for r in _per_block(rows.where("toxic = 1"), hits, "hits array<long>").collect()]  # TRAIN_DOCS rows
    toxic = [suspects[i] for i in witnesses(held)]
    if not toxic:
        return None
    for _ in range(ROUNDS):
        machine = fit(toxic, clean)

        def hard(batches, machine=machine):
            best: list[tuple[float, bytes]] = []
            for batch in batches:
                units = batch.column("unit").to_pylist()
                best = heapq.nlargest(NEGATIVES, [*best, *zip(unit_scores(units, machine.weight, machine.bias).tolist(), units)])
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in best]), pa.array([u for _, u in best], pa.binary())], ["score", "unit"])

        worst = arrow_map(stats.where("good > 0").select("unit"), hard, "score double, unit binary").orderBy(F.desc("score"), "unit").limit(NEGATIVES).collect()
        more = list(dict.fromkeys([*clean, *[bytes(r["unit"]) for r in worst]]))
        if len(more) == len(clean):
            break
        clean = more
    machine = fit(toxic, clean)

    def values(block, col):
        yield pa.RecordBatch.from_arrays([pa.array(list(machine.look(block)), pa.list_(pa.float64())), pa.array(col["toxic"].astype(np.int64))], ["look", "toxic"])

    seen = _per_block(rows, values, "look array<double>, toxic long", "toxic").collect()  # 2 * TRAIN_DOCS rows
    calibrate(machine, np.array([r["look"] for r in seen]), np.array([r["toxic"] for r in seen]), prior)
    return machine


def evidence(spread: dict[int, tuple[int, int]], share: float) -> int:
    """In how many toxic documents, and no other, a unit must be found before that is hardly chance.

    ``spread``: by number of documents, how many units there are and how many
    of them are in toxic documents only; ``share`` of documents is toxic.
    Chance alone would give units * share ** n of the latter.
    """
    for n in sorted(spread):
        units, only = spread[n]
        if n > 1 and only and units * share**n <= 0.1 * only:
            return n
    return 1 if not any(n > 1 for n in spread) else max(spread) + 1


def witnesses(held: list[list[int]]) -> list[int]:
    """Units, each the one that explains most documents not explained yet; single finds count only if there are no others."""
    of: dict[int, list[int]] = {}
    for d, us in enumerate(held):
        for u in us:
            of.setdefault(u, []).append(d)
    left = Counter({u: len(ds) for u, ds in of.items()})
    least = 2 if left and max(left.values()) > 1 else 1
    heap = [(-n, u) for u, n in left.items()]
    heapq.heapify(heap)
    done, out = set(), []
    while heap:
        n, u = heapq.heappop(heap)
        if -n != left[u]:
            heapq.heappush(heap, (-left[u], u))
            continue
        if -n < least:
            break
        out.append(u)
        for d in of[u]:
            if d not in done:
                done.add(d)
                for v in held[d]:
                    left[v] -= 1
    return out


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """``docs`` to ``(doc_id, held_out, score, predicted)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~training_fold(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    if machine is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for batch in batches:
            done = [shared.value.probability(shared.value.look(b)) for b in text_blocks(batch.column("text"))]
            p = np.concatenate(done) if done else np.zeros(0)
            yield pa.RecordBatch.from_arrays([single(batch.column("doc_id")), single(batch.column("held_out")), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document by a machine trained on the training fold of the labels."""
    return score(docs, train(*sample(docs, labels)))
