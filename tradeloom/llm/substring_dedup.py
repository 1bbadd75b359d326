"""Removal of repeated passages by fingerprints of word windows, grouped by prefixes of variable length.

Every window of ``window`` words of every text begins at a word. Windows are split into groups by a prefix of variable
length: one word where few begin with it, more words where many do (counted over the whole table beforehand), so that
a group fits in memory. A group is held as its sorted fingerprints: equal ones are one passage of that many words, which
knows its least document. A word goes if any window that covers it has a smaller document; a longer repeat is
covered by its windows. No suffix tree is built, and maximal repeats aren't found.

Fingerprints have 8 bytes, whatever the number of windows, and meet only in their group, which comes from other hashes:
n windows in g groups are expected to give n * n / (2 * g * 2**64) false matches, one or two in 100 TB.

A passage may occur in a third of all documents. Each slice of a partition sends a label once, with its least
document, and settles its other copies itself; so a hot node has as many entries as there are slices.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import kept, partitions

#: Suffixes in a group, and the bits of a prefix's cell.
GROUP_SUFFIXES = 4_000_000
CELL_BITS = 12
_LAST = np.iinfo(np.int64).max


def _levels(window: int) -> list[int]:
    """Lengths of prefixes, in words, the longest being the window itself."""
    return sorted({1, 2, 3, min(5, window), window} & set(range(1, window + 1)))


def _cells(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return (W.window_hashes(words, length)[at] >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _prefix_counts(docs: DataFrame, window: int) -> np.ndarray:
    """[level, cell] number of suffixes; each task sends one sum, and these are summed in a few groups."""
    shape = (len(_levels(window)), 1 << CELL_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, np.int64)
        for batch in batches:
            for part in W.wide(batch):
                data, offsets = W.packed(part.column("text"))
                starts, ends, first = W.spans(data, offsets)
                words, at = W.span_hashes(data, starts, ends), W.window_starts(first, window)
                for i, length in enumerate(_levels(window)):
                    if len(at):
                        total[i] += np.bincount(_cells(words, at, length), minlength=shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32]), pa.array([total.tobytes()], pa.binary())], names=["some", "counts"])

    def add(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in rows:
            for x in batch.column("counts"):
                total += np.frombuffer(x.as_buffer(), np.int64).reshape(shape)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    sums = docs.select("text").mapInArrow(count, "some long, counts binary").groupBy("some").applyInArrow(add, "counts binary").collect()
    return sum((np.frombuffer(r.counts, np.int64).reshape(shape) for r in sums), np.zeros(shape, np.int64))


class PrefixGroups:
    """Which group a suffix belongs to: its shortest prefix whose cell is small enough decides; cells are dealt to
    groups of about equal size. Beyond 1024 groups each is split further by the label."""

    def __init__(self, counts: np.ndarray, window: int, groups: int):
        self.levels = _levels(window)
        total = int(counts[0].sum())
        main = min(groups, 1024)
        self.split = -(-groups // main)
        self.small = counts <= max(1, total // main)
        self.small[-1] = True
        self.group = np.zeros(counts.shape, np.int64)
        loads = [(0, g) for g in range(main)]
        sizes = [(int(counts[i, c]), i, c) for i, c in np.argwhere(self.small & (counts > 0)).tolist()]
        for size, i, c in sorted(sizes, reverse=True):
            load, g = heapq.heappop(loads)
            self.group[i, c] = g
            heapq.heappush(loads, (load + size, g))

    def of(self, words: np.ndarray, at: np.ndarray, labels: np.ndarray) -> np.ndarray:
        out = np.full(len(at), -1, np.int64)
        left = np.arange(len(at))
        for i, length in enumerate(self.levels):
            cells = _cells(words, at[left], length)
            some = self.small[i, cells]
            out[left[some]] = self.group[i, cells[some]]
            left = left[~some]
            if not len(left):
                break
        return out * self.split + (W.mix(labels) % np.uint64(self.split)).astype(np.int64)


def _suffixes(texts: pa.Array, ids: np.ndarray, window: int, groups: PrefixGroups):
    """Of a slice: its words, suffixes and distinct labels in the order in which they are sent."""
    data, offsets = W.packed(texts)
    starts, ends, first = W.spans(data, offsets)
    words, at = W.span_hashes(data, starts, ends), W.window_starts(first, window)
    labels = W.window_hashes(words, window)[at]
    ids = np.repeat(ids, np.maximum(np.diff(first) - window + 1, 0))
    order = np.lexsort((ids, labels))
    l, d = labels[order], ids[order]
    new = np.concatenate([[True], l[1:] != l[:-1]]) if len(l) else np.zeros(0, bool)
    head = order[new]  # the suffix of the least document for each label
    which = np.empty(len(labels), np.int64)
    which[order] = np.cumsum(new) - 1
    group = groups.of(words, at[head], labels[head])
    sent = np.lexsort((labels[head], ids[head], group))
    rank = np.empty(len(sent), np.int64)
    rank[sent] = np.arange(len(sent))
    return data, first, at, ids, rank[which], labels[head][sent], ids[head][sent], group[sent]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def _number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def dedup_substrings(docs: DataFrame, window: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: without each word that lies in a run of ``window``
    words which also starts in a document with a smaller doc_id (judged on the input).

    with_text adds kept_text (the words left, by single spaces) and removed (array of word spans, end exclusive:
    unions of windows that overlap or touch, maybe of different sources). Null, empty and short texts have no windows and stay whole; a null doc_id counts as
    larger than any, and doc_ids have to be whole numbers; rows with the same doc_id don't remove each other's words. Very long texts are one row of
    a slice. An empty table gives an empty result; further columns of docs are ignored. docs is read three
    times and has to be a stored table (the same rows in the same partitions each time).
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id has to be a whole number, not {docs.schema['doc_id'].dataType.simpleString()}")
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = _prefix_counts(docs, window)
    total = int(counts[0].sum())
    n_groups = max(2 * partitions(docs.sparkSession), -(-total // GROUP_SUFFIXES))
    groups = PrefixGroups(counts, window, n_groups)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _number()
        for batch in batches:
            for part in W.wide(batch):
                number += 1
                *_, labels, ids, group = _suffixes(part.column("text"), _ids(part.column("doc_id")), window, groups)
                cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)] if len(group) else [0]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    here = ids[a:b]
                    at = np.concatenate([[0], np.flatnonzero(here[1:] != here[:-1]) + 1])
                    rows.append((int(group[a]), number, labels[a:b].tobytes(), here[at].tobytes(), np.diff(at, append=b - a).astype(np.uint32).tobytes()))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), *[pa.binary()] * 3], strict=True)], names=["grp", "slice", "labels", "ids", "cnt"])

    def nodes(key: tuple, rows: pa.Table) -> pa.Table:
        raw = rows["labels"].to_pylist()
        label = np.frombuffer(b"".join(raw), np.uint64)
        ids = np.repeat(np.frombuffer(b"".join(rows["ids"].to_pylist()), np.int64), np.frombuffer(b"".join(rows["cnt"].to_pylist()), np.uint32).astype(np.int64))
        order = np.argsort(label, kind="stable")
        l = label[order]
        new = np.concatenate([[True], l[1:] != l[:-1]])
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        smaller = np.zeros(len(ids), bool)
        smaller[order] = least < ids[order]
        out, at = [], 0
        for number, blob in zip(rows["slice"].to_pylist(), raw, strict=True):
            here = smaller[at : at + len(blob) // 8]
            at += len(here)
            if here.any():
                out.append((number, key[0].as_py(), np.packbits(here).tobytes()))
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["slice", "grp", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _number()
        for batch in batches:
            for part in W.wide(batch):
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([number]), *(pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(n)) for n in ("doc_id", "text"))], names=["slice", "doc_ids", "texts"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, text, found = (batch.column(n)[i] for n in ("doc_ids", "texts", "found"))
                data, first, at, ids, rank, _, sent_ids, group = _suffixes(text.values, _ids(doc_ids.values), window, groups)
                smaller = np.zeros(len(group), bool)
                for x in found.as_py() or []:
                    a, b = np.searchsorted(group, [x["grp"], x["grp"] + 1])
                    smaller[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a)
                hit = at[smaller[rank] | (ids > sent_ids[rank])]
                edge = np.zeros(first[-1] + window + 1, np.int64)
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + window, -1)
                gone = np.cumsum(edge)[: first[-1]] > 0
                n, lost = np.diff(first), np.concatenate([[0], np.cumsum(gone)])
                lost = lost[first[1:]] - lost[first[:-1]]
                _, offsets = W.packed(text.values)
                raw, left = data.tobytes(), []
                for d in range(len(n)):
                    words = raw[offsets[d] : offsets[d + 1]].split()  # at ASCII white space, as the words are
                    left.append(b" ".join(compress(words, ~gone[first[d] : first[d + 1]]) if lost[d] else words))
                columns = [doc_ids.values, pa.array(n), pa.array(lost.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string())]
                if with_text:
                    spans = []
                    for d in range(len(n)):
                        e = np.flatnonzero(np.diff(gone[first[d] : first[d + 1]].astype(np.int8), prepend=0, append=0))
                        spans.append([{"start": int(a), "end": int(b)} for a, b in zip(e[::2], e[1::2], strict=True)])
                    columns += [pa.array([x.decode("utf-8", "replace") for x in left], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text", "removed"] * with_text])

    sent = docs.mapInArrow(send, "grp long, slice long, labels binary, ids binary, cnt binary")
    found = kept(sent.groupBy("grp").applyInArrow(nodes, "slice long, grp long, bits binary"))
    by_slice = found.groupBy("slice").agg(F.collect_list(F.struct("grp", "bits")).alias("found"))
    held = docs.mapInArrow(texts, f"slice long, doc_ids array<{kind}>, texts array<string>")
    more = ", kept_text string, removed array<struct<start: long, end: long>>" * with_text
    return held.join(by_slice, "slice", "left").mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + more)
