"""Language identification with interpolated Kneser-Ney character models.

Characters are folded to 64 classes: one for a run of anything but letters, one
for each of a-z after lower-casing, 37 for all other letters by code point.  The
trigram counts of each language are taken from *all* training rows, in Arrow
batches that add up counts before one small shuffle; 64**3 trigrams a language
are the proven bound of what the driver turns into a model and tasks receive.

The model is one array of trigram hashes, sorted, with one column of log
probabilities per language beside it, and the same for the bigram weights that
unseen trigrams back off to.  A text goes to the language of lowest
length-normalised cross-entropy.  A text is rejected where that cross-entropy
lies further above the language's mean than ``margin`` standard deviations, both
calibrated on the training rows with the deviation split into a part that
shrinks with length and one that doesn't.

Null texts and texts without a letter are ``und`` with score zero and rejected.
Rows without a language teach nothing.  An empty training set makes every row
``und``.  Repeated rows and null ids are scored like any other; a null id is in
no training fold.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundsift.llm.common import arrow_map, training_fold

CLASSES = 64
ORDER = 3
UNKNOWN = "und"
_JUDGED = ["row", "lang_pred", "score", "cross_entropy", "rejected"]
#: standard deviations above a language's mean cross-entropy at which a text is rejected
MARGIN = 10.0
#: texts are folded in pieces of so many characters
PIECE = 1 << 20

_TABLE: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class of each code point; 0 stands for all but letters."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x30000):
            if unicodedata.category(chr(cp))[0] == "L":
                table[cp] = 27 + cp % 37
        table[0x30000:0x3FFFF] = 27
        table[97:123] = np.arange(1, 27)
        _TABLE.append(table)
    return _TABLE[0]


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts, each opened and closed by one 0, and the row of each class."""
    lower = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lower], np.int64)
    code = _class_table()[np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (row[1:] != row[:-1])
    return code[keep], row[keep]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram hashes (two classes of context, one predicted) and their rows; the context of a start is 0, 0."""
    code, row = folded(texts)
    if not len(code):
        return np.zeros(0, np.int32), row
    start = np.ones(len(code), bool)
    start[1:] = row[1:] != row[:-1]
    one, two = np.zeros_like(code), np.zeros_like(code)
    one[1:] = code[:-1]
    two[2:] = code[:-2]
    one[start] = 0
    two[start] = 0
    two[1:][start[:-1]] = 0
    gram = (two.astype(np.int32) << 12) | (one.astype(np.int32) << 6) | code
    keep = ~(start & (code == 0))  # an opening that isn't a letter says nothing
    return gram[keep], row[keep]


def pieces(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Rows in order, so many that their characters stay near ``PIECE``."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over ``docs(lang, text)``."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for first, part in pieces(texts):
                gram, row = trigrams(part)
                of = number[first + row]
                for n in np.unique(of).tolist():
                    counts = total.setdefault(names[n], np.zeros(CLASSES**ORDER, np.int64))
                    counts += np.bincount(gram[of == n], minlength=CLASSES**ORDER)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(counts[at])], ["lang", "gram", "n"])

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    return arrow_map(rows, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Sorted trigram hashes with a log probability per language, and what unseen ones back off to."""

    def __init__(self, langs: list[str], counts: list[np.ndarray]):
        """``counts``: a dense array of 64**3 trigram counts per language."""
        self.langs = langs
        seen = np.zeros(CLASSES**ORDER, bool)
        for c in counts:
            seen |= c > 0
        self.gram = np.flatnonzero(seen).astype(np.int32)
        self.log_p = np.zeros((len(self.gram), len(langs)), np.float32)
        self.back = np.zeros((CLASSES**2, len(langs)), np.float32)  # log weight of the context
        self.lower = np.zeros((CLASSES**2, len(langs)), np.float32)  # log bigram probability
        for k, c in enumerate(counts):
            tri, back, lower = self._smooth(c)
            self.log_p[:, k], self.back[:, k], self.lower[:, k] = np.log(tri[self.gram]), np.log(back), np.log(lower)
        self.mean = np.zeros(len(langs))
        self.wide = np.ones(len(langs))  # variance that stays
        self.short = np.ones(len(langs))  # variance that one character adds

    @staticmethod
    def _discount(c: np.ndarray) -> float:
        one, two = int((c == 1).sum()), int((c == 2).sum())
        return one / (one + 2 * two) if one and two else 0.5

    @classmethod
    def _smooth(cls, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interpolated Kneser-Ney: lower orders count the different contexts a character follows."""
        v = CLASSES
        c = c.reshape(v, v, v).astype(float)
        follows = (c > 0).sum(0).astype(float)  # (one, char): contexts
        last = (follows > 0).sum(0).astype(float)
        unigram = (last + 0.5) / (last.sum() + 0.5 * v)
        d2 = cls._discount(follows)
        total = follows.sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, d2 * (follows > 0).sum(1, keepdims=True) / total, 1.0)
            bigram = np.where(total > 0, np.maximum(follows - d2, 0) / total, 0) + weight * unigram
            d3 = cls._discount(c)
            total = c.sum(2, keepdims=True)
            weight = np.where(total > 0, d3 * (c > 0).sum(2, keepdims=True) / total, 1.0)
            trigram = np.where(total > 0, np.maximum(c - d3, 0) / total, 0) + weight * bigram[None]
        return trigram.ravel(), weight.ravel(), bigram.ravel()

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character (rows x languages) and characters counted; no letter: no characters."""
        gram, row = trigrams(texts)
        at = np.searchsorted(self.gram, gram)
        at[at == len(self.gram)] = 0
        known = self.gram[at] == gram if len(self.gram) else np.zeros(len(gram), bool)
        size = np.bincount(row, minlength=len(texts))
        letters = np.bincount(row, gram % CLASSES != 0, minlength=len(texts)) if len(gram) else np.zeros(len(texts))
        total = np.empty((len(texts), len(self.langs)))
        unseen = gram[~known]
        for k in range(len(self.langs)):
            p = np.empty(len(gram), np.float32)
            p[known] = self.log_p[at[known], k]
            p[~known] = self.back[unseen >> 6, k] + self.lower[unseen & 0xFFF, k]
            total[:, k] = np.bincount(row, -p, minlength=len(texts))
        size = np.where(letters > 0, size, 0)
        return total / np.maximum(size, 1)[:, None], size

    def judge(self, texts: list[str | None], margin: float = MARGIN) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text."""
        h, size = self.cross_entropy(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        # posterior of the best, as if 50 characters had been read at most: longer texts are no surer than that
        z = -(h - low[:, None]) * np.minimum(size, 50)[:, None]
        score = np.where(size > 0, 1 / np.exp(z).sum(1), 0.0)
        limit = self.mean[best] + margin * np.sqrt(self.wide[best] + self.short[best] / np.maximum(size, 1))
        rejected = (size == 0) | (low > limit)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), size.tolist())], score, low, rejected


def train(docs: DataFrame) -> Model | None:
    """Counts, model and calibration from ``docs(text, lang)``; none if no row teaches a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    dense: dict[str, np.ndarray] = {}
    for r in gram_counts(rows).toLocalIterator():  # 64**3 rows a language at most
        dense.setdefault(r.lang, np.zeros(CLASSES**ORDER, np.int64))[r.gram] = r.n
    if not dense:
        return None
    langs = sorted(dense)
    model = Model(langs, [dense[x] for x in langs])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        # of the texts of each language: number, sum and sum of squares of the cross-entropy, sum of 1/size, by length class
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for first, part in pieces(texts):
                h, size = shared.value.cross_entropy(part)
                for i, n in enumerate(size.tolist()):
                    if n:
                        k = shared.value.langs.index(names[first + i])
                        x = h[i, k]
                        key = (names[first + i], min(n.bit_length(), 20))
                        total.setdefault(key, np.zeros(4))
                        total[key] += (1, x, x * x, 1 / n)
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()),
                                              *[pa.array([float(total[k][j]) for k in keys]) for j in range(4)]], ["lang", "size", "n", "x", "xx", "inverse"])

    stats = (arrow_map(rows.select(F.col("lang").cast("string"), F.col("text").cast("string")), run,
                       "lang string, size long, n double, x double, xx double, inverse double")
             .groupBy("lang", "size").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "inverse")]).collect())  # 20 rows a language
    for k, lang in enumerate(langs):
        own = [r for r in stats if r.lang == lang]
        n = sum(r.n for r in own)
        if not n:
            continue
        model.mean[k] = mean = sum(r.x for r in own) / n
        spread = [(r.n, max(0.0, (r.xx - 2 * mean * r.x + mean * mean * r.n) / r.n), r.inverse / r.n) for r in own]
        # variance = wide + short / length, by least squares over the length classes
        s, sx, sxx = sum(w for w, _, _ in spread), sum(w * i for w, _, i in spread), sum(w * i * i for w, _, i in spread)
        sy, sxy = sum(w * y for w, y, _ in spread), sum(w * y * i for w, y, i in spread)
        slope = max(0.0, (s * sxy - sx * sy) / d) if (d := s * sxx - sx * sx) > 1e-15 else 0.0
        model.short[k] = max(slope, 1.0)
        model.wide[k] = max((sy - slope * sx) / s, 1e-4)
    return model


def identify(docs: DataFrame, model: Model | None, margin: float = MARGIN) -> DataFrame:
    """``docs`` to ``(row, lang_pred, score, cross_entropy, rejected)``, ``row`` being the input row; its text alone is read."""
    rows = docs.select(F.struct("*").alias("row"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = pc.struct_field(batch.column("row"), "text").cast(pa.string()).to_pylist()
            lang, score, low, rejected = [], [], [], []
            for _, part in pieces(texts):
                for into, got in zip((lang, score, low, rejected), shared.value.judge(part, margin)):
                    into.extend(got)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(low, pa.float64()), pa.array(rejected, pa.bool_())], _JUDGED)

    added = zip(_JUDGED[1:], (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()))
    return arrow_map(rows, run, T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in added]]))


def language_of(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` to ``(doc_id, held_out, lang_pred, score, cross_entropy, rejected)``; learns from the training fold."""
    model = train(docs.where(training_fold()))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(~training_fold(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("row.doc_id", "row.held_out", *_JUDGED[1:])


def kept(docs: DataFrame) -> DataFrame:
    """``docs`` less the rows whose language is rejected; columns stay."""
    return identify(docs, train(docs.where(training_fold()))).where(~F.col("rejected")).select("row.*")
