"""Bounded-space online packing of tokenized documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's whole windows leave at once; what is left
of it goes to the open window that it fills best. If it fits none, the fullest window is emitted and a new one
opened. At the end of the partition the open windows are left over; leftovers of neighbouring partitions are
merged by the same best-fit rule, largest first, in bounded groups.

Token ids never move: a piece is a few numbers, and its checksum is taken where the ids are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import kept

#: Words that a tokenizer remembers, and bytes of text at a time.
CACHED_WORDS = 300_000
SLICE = 1 << 20


_ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_CLOSING = np.isin(np.arange(256), list(b".,;:!?#$%&*)"))


def _without_closing(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans with a word's closing punctuation as a span of its own."""
    if not len(starts):
        return starts, ends, first
    core = np.maximum.accumulate(np.where(_CLOSING[data], 0, np.arange(1, len(data) + 1)))[ends - 1]
    # what stands before it must be a letter or digit: 0-9 A-Z a-z, or U+00C0 to U+00FF but for two signs
    last, before = data[core - 1], data[np.maximum(core - 2, 0)]
    two = (core > starts) & (core < ends) & (_ALNUM[last] | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
    shift = np.concatenate([[0], np.cumsum(two)])
    a, b = np.repeat(starts, 1 + two), np.repeat(ends, 1 + two)
    at = (np.arange(len(starts)) + shift[:-1])[two]
    b[at], a[at + 1] = core[two], core[two]
    return a, b, first + shift[first]


class WordTokenizer:
    """Ids of texts by a `tokenizers` file whose pre-tokenizer drops white space.

    With such a file, one that lower-cases and splits letters from the punctuation after them, no token spans
    white space or the start of a word's closing punctuation. So each distinct piece (A-Z lower-cased) is encoded
    once, and its ids are looked up afterwards by its 64-bit hash. The memory of pieces is bounded; it starts
    anew when full, which changes no result.
    """

    #: Stands between pieces that are encoded in one call; it cuts a text before anything else looks at it.
    MARK, SPECIAL = "<|startoftext|>", b"<|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self._hashes = np.zeros(0, np.uint64)  # sorted, with the place of each word's ids
        self._first = np.zeros(0, np.int64)
        self._length = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        new: list[list[int]] = []
        mark = self._tokenizer.token_to_id(self.MARK)
        plain = [w if self.MARK not in w else "" for w in words]
        for at in range(0, len(plain), 6_400):
            some = plain[at : at + 6_400]
            for e in self._tokenizer.encode_batch_fast([self.MARK.join(some[i : i + 64]) for i in range(0, len(some), 64)], add_special_tokens=False):
                ids: list[int] = []
                for x in e.ids:
                    if x == mark:
                        new.append(ids)
                        ids = []
                    else:
                        ids.append(x)
                new.append(ids)
        for i, w in enumerate(words):
            if not plain[i]:
                new[i] = self._tokenizer.encode(w, add_special_tokens=False).ids
        length = np.fromiter(map(len, new), np.int64, len(new))
        hashes = np.concatenate([self._hashes, hashes])
        first = np.concatenate([self._first, len(self._ids) + np.cumsum(length) - length])
        length = np.concatenate([self._length, length])
        order = np.argsort(hashes)
        self._hashes, self._first, self._length = hashes[order], first[order], length[order]
        self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(new), np.uint32)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and the n+1 offsets of the texts."""
        data, offsets = W.packed(texts)
        if self.SPECIAL not in data.tobytes():  # special tokens are told by their case
            data = W.lowered(data)
        starts, ends, first = W.spans(data, offsets)
        starts, ends, first = _without_closing(data, starts, ends, first)
        words, at, back = np.unique(W.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        for _ in range(2):
            place = np.searchsorted(self._hashes, words)
            known = place < len(self._hashes)
            known[known] = self._hashes[place[known]] == words[known]
            if known.all():
                break
            if len(self._hashes) + len(words) - known.sum() > CACHED_WORDS:
                self._forget()
                known[:] = False
            raw, new = data.tobytes(), at[~known]
            self._learn(words[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        length = self._length[place][back]
        total = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(total[-1]) + np.repeat(self._first[place][back] - total[:-1], length)
        return self._ids[index], total[first]


@cache
def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker: tasks that follow reuse it and the words it knows."""
    return WordTokenizer(path)


class OpenWindows:
    """A fixed number of open windows in order of their free space."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self._free: list[tuple[int, int]] = []  # (free, number), sorted
        self.inside: dict[int, list] = {}
        self._next = 0

    def add(self, length: int, piece) -> list[list]:
        """Place a piece of length 1 to size-1; returns the windows that are emitted for it."""
        out = []
        at = bisect_left(self._free, (length, -1))
        if at < len(self._free):
            free, number = self._free.pop(at)
        else:
            if len(self._free) >= self.limit:
                out.append(self.inside.pop(self._free.pop(0)[1]))
            free, number = self.size, self._next
            self._next += 1
            self.inside[number] = []
        self.inside[number].append(piece)
        if free == length:
            out.append(self.inside.pop(number))
        else:
            insort(self._free, (free - length, number))
        return out

    def rest(self) -> list[list]:
        out = [self.inside[n] for _, n in self._free]
        self._free, self.inside = [], {}
        return out


_PIECE = [("doc_id", None), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]


def pack(docs: DataFrame, tokenizer_path: str, size: int = 4096, windows: int = 64, end_id: int = 2, merge_partitions: int = 64) -> DataFrame:
    """Pack all documents into sequences of ``size`` tokens at most.

    A document's ids are those of its text, then ``end_id``; a null or empty text is ``end_id`` alone. Returns a
    row per piece: doc_id, start, length, ids_crc32 (little-endian unsigned 32-bit ids), doc_tokens, sequence_id,
    offset. Every id lies in exactly one piece; pieces lie in a sequence without gaps. Repeated rows are packed
    once each; an empty table gives an empty result; further columns of docs are ignored.

    Memory of a task: a slice of texts and ``windows`` open windows. Leftovers: ``windows`` for each partition
    at most, merged in groups of ``merge_partitions`` partitions, so no task gets more than their product.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, left_over long"
    names = [n for n, _ in _PIECE] + ["sequence_id", "offset", "left_over"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokenizer, open_, done = tokenizer_of(tokenizer_path), OpenWindows(size, windows), 0
        doc_type = None

        def rows(sequences: list[list], left: bool) -> pa.RecordBatch:
            nonlocal done
            out: list[tuple] = []
            for pieces in sequences:
                offset = 0
                for piece in pieces:
                    out.append((*piece, part << 32 | done, offset, part if left else None))
                    offset += piece[2]
                done += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, doc_type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

        for batch in batches:
            for some in W.slices(batch, limit=SLICE):
                doc_type = some.column("doc_id").type
                full: list[list] = []
                all_ids, first = tokenizer.encode(some.column("text"))
                for i, doc in enumerate(some.column("doc_id").to_pylist()):
                    ids = np.append(all_ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), size):
                        cut = ids[at : at + size]
                        piece = (doc, at, len(cut), zlib.crc32(cut.tobytes()), len(ids))
                        full += [[piece]] if len(cut) == size else open_.add(len(cut), piece)
                yield rows(full, False)
        if doc_type is not None:
            yield rows(open_.rest(), True)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        # the pieces of the group's leftover windows, longest first; as many windows open as there are
        pieces = sorted(zip(*(table.column(n).to_pylist() for n, _ in _PIECE), strict=True), key=lambda p: (-p[2], p[1], str(p[0]), p[3]))
        open_, sequences = OpenWindows(size, len(pieces) + 1), []
        for piece in pieces:
            sequences += open_.add(piece[2], piece)
        out, number = [], 0
        for sequence in sequences + open_.rest():
            offset = 0
            for piece in sequence:
                out.append((*piece, (1 << 62) + (key[0].as_py() << 32 | number), offset, None))
                offset += piece[2]
            number += 1
        columns = list(zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(c, table.column("doc_id").type if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

    placed = kept(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    left = placed.where("left_over is not null")
    merged = left.groupBy(F.floor(F.col("left_over") / merge_partitions).alias("near")).applyInArrow(merge, schema)
    return placed.where("left_over is null").unionByName(merged).drop("left_over")
