"""Shortest-pack-first packing over the length histogram.

Whole texts become token ids, each document closed by one more id.  A document
is cut into full sequences and one rest, so lengths run from 1 to the sequence
length and the histogram has that many rows however many documents there are.
The histogram alone goes to the driver: lengths are placed longest first, each
into the pack with the most room, and only *counts of packing patterns* change.
A pattern slot then owns a range of ranks of its length; pieces get their rank
among pieces of equal length by hash buckets, and look their sequence up in the
broadcast pattern table, which the sequence length bounds.

Tokenization works on runs of white space plus the word that follows, less a
comma or the like behind it: no token reaches over the end of a word, so a run's
ids don't depend on what stands around it, and each different run of a block of
text is encoded once.

A null or empty text is the closing id alone.  Rows with a null id are packed
like any other, repeated rows as often as they come.  An empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundsift.llm.common import _SPACE, arrow_map, cut, rank_in, single, text_blocks

LENGTH = 1024
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: runs whose ids a worker keeps in each of two generations; runs that come up again move on to the younger one
CACHE = 600_000
#: bytes of text that are looked up together
BLOCK = 4 << 20
#: a letter ends a run before one of these as well; "'" and what special tokens are made of don't count
_STOPS = np.isin(np.arange(256), np.frombuffer(b'.,;:!?$&*#%"()-', np.uint8))
_LETTERS = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128)
#: white space other than ASCII: such texts are encoded in one piece
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of byte blocks, run by run."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        """The ids known so far become the older generation."""
        self.older = (getattr(self, "known", {}), getattr(self, "at", [0]), getattr(self, "flat", np.zeros(0, np.int32)))
        self.known: dict[bytes, int] = {}
        self.at = [0]
        self.flat = np.zeros(1 << 16, np.int32)

    def _learn(self, runs: list[bytes]) -> None:
        known, at, flat = self.older
        again = [r for r in runs if r in known]
        if again:
            place = np.fromiter((known[r] for r in again), np.int64, len(again))
            bounds = np.array(at, np.int64)
            size = np.diff(bounds)[place]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            self._keep(again, size.tolist(), flat[np.repeat(bounds[place], size) + inner])
            runs = [r for r in runs if r not in known]
        ids = [e.ids for e in self.model.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)]
        size = list(map(len, ids))
        self._keep(runs, size, np.fromiter(chain.from_iterable(ids), np.int32, sum(size)))

    def _keep(self, runs: list[bytes], sizes: list[int], ids: np.ndarray) -> None:
        ends = list(accumulate(sizes, initial=self.at[-1]))
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), ends[-1]), np.int32)])
        self.flat[ends[0] : ends[-1]] = ids
        first = len(self.known)
        self.known.update((r, first + n) for n, r in enumerate(runs))
        self.at += ends[1:]

    def encode(self, block) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds of each row) of a block, closing ids included."""
        data, n = block.data, len(block.data)
        opens = np.zeros(n + 1, bool)
        space = _SPACE[data]
        opens[1:n] = (space[1:] & ~space[:-1]) | (_STOPS[data[1:]] & _LETTERS[data[:-1]])
        # a lone line end or tab before a letter is a token of its own
        opens[2:n] |= _LETTERS[data[2:]] & space[1:-1] & (data[1:-1] != 32) & ~space[:-2]
        opens[block.start] = True
        opens = opens[:n]
        raw = data.tobytes()
        wide = [i for i, (s, e) in enumerate(zip(block.start.tolist(), block.end.tolist())) if _WIDE_SPACE.search(raw[s:e].decode())] if n and not _plain(data) else []
        for i in wide:
            opens[block.start[i] + 1 : block.end[i]] = False
        start = np.flatnonzero(opens)
        end = np.append(start[1:], n)
        _, one, same = np.unique(block.hashes(start, end), return_index=True, return_inverse=True)
        runs = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())]
        if len(self.known) > CACHE:
            self.clear()
        fresh = [r for r in runs if r not in self.known]
        if fresh:
            self._learn(fresh)
        known = self.known
        place = np.fromiter((known[r] for r in runs), np.int64, len(runs))
        at = np.array(self.at, np.int64)
        first, size = at[place][same], np.diff(at)[place][same]
        row = np.searchsorted(block.end, start, "right")  # empty rows have no run
        rows = len(block.start)
        tokens = np.bincount(row, size, minlength=rows).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(tokens)])
        out = np.full(bounds[-1], CLOSING_ID, np.int32)
        # a run's ids follow those of the runs before it, and one closing id per row before it
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]) + row if len(size) else np.zeros(0, np.int64)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(begin, size) + inner] = self.flat[np.repeat(first, size) + inner]
        return out, bounds


def _plain(data: np.ndarray) -> bool:
    """No byte that could be part of white space other than ASCII."""
    return not bool(((data >= 0x1C) & (data <= 0x1F) | (data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3)).any())


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, start, length, ids_crc32, doc_tokens)``."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, Encoder(path))
        for batch in batches:
            doc = single(batch.column("doc_id"))
            for block in text_blocks(batch.column("text"), BLOCK):
                ids, bounds = encoder.encode(block)
                raw = memoryview(ids.astype("<u4").tobytes())
                tokens = np.diff(bounds)
                count = -(-tokens // length)
                row = np.repeat(np.arange(len(tokens)), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(tokens[row] - start, length)
                first = bounds[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + size).tolist())]
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(block.first + row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(tokens[row])], _NAMES)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple[int, ...]]]:
    """Shortest pack first: ``(count, lengths)`` of every pattern; the counts of each length add up to the histogram."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by room left
    full: list[tuple[int, tuple[int, ...]]] = []

    def keep(count: int, pattern: tuple[int, ...], room: int) -> None:
        if room:
            open_.setdefault(room, []).append((count, pattern))
        else:
            full.append((count, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max(open_, default=0)
            if room < size:
                keep(left, (size,), length - size)
                break
            packs, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room]
            used = min(packs, left)
            if packs > used:
                keep(packs - used, pattern, room)
            keep(used, (*pattern, size), room - size)
            left -= used
    return full + [x for room in sorted(open_) for x in open_[room]]


def slots(found: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Pattern slots sorted by (length, first rank): the ranks that a slot owns, its first sequence and its offset."""
    rows, used, sequence = [], {}, 0
    for count, pattern in found:
        offset = 0
        for size in pattern:
            rows.append((size, used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + count
            offset += size
        sequence += count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """One row per piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    made = cut(pieces(docs, length, path))
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # ``length`` rows at most
    plan = made.sparkSession.sparkContext.broadcast(slots(patterns(histogram, length)))
    ranked = rank_in(made, ["length"], ["doc_id", "start", "ids_crc32"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = plan.value
        key = table["length"] << 44 | table["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, batch.column("length").to_numpy(zero_copy_only=False) << 44 | rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _NAMES], pa.array(sequence), pa.array(table["offset"][at])], [*_NAMES, "sequence_id", "offset"])

    return arrow_map(ranked.select(*_NAMES, "rank"), place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
