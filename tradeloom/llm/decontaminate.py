"""Benchmark decontamination by suffix arrays over the training text.

The training table is cut into shards: the slices of its partitions. Each shard gets a suffix array over its
words (ordered as deep as a window, 13 words), and every suffix of the test texts is binary-searched in it. The
interval found gives all places where the test text occurs word for word; neighbouring places on one diagonal
are one longer match. Hit words, items and the longest match come from the intervals themselves, so a passage that
repeats in text and item costs no row for each pair of places. Test texts are a bounded query set: their size is
checked, and beyond a bound they are taken in blocks, one pass over the training text each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import kept

#: Bytes of test text searched at once.
BLOCK_BYTES = 8 << 20
#: Pairs of places that are listed at once; where there are more, they are taken suffix by suffix.
PAIRS = 1 << 20


@dataclass
class Tests:
    """Suffixes of test texts: word hashes end to end, padded, and for each suffix its item and its length."""

    words: np.ndarray
    start: np.ndarray
    length: np.ndarray  # words to compare: the window, or all of a shorter item
    item: np.ndarray
    first: np.ndarray  # of each item: where its words begin
    names: list[str]


def tests_of(rows: list[tuple[object, str | None]], window: int) -> Tests:
    """Suffixes that a window starts: of an item with fewer words, only the first."""
    data, offsets = W.packed(pa.array([t for _, t in rows], pa.string()))
    data = W.lowered(data)
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    hashes = W.span_hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(n)), count)
    start = first[:-1][item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    return Tests(np.concatenate([hashes, np.zeros(window, np.uint64)]), start, np.minimum(n[item], window), item, first[:-1], [str(i) for i, _ in rows])


class SuffixArray:
    """The suffixes of a shard's texts in order of their first words.

    Words become ranks (odd numbers); each text ends with rank 0, so no match crosses from one text to the next.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int):
        docs = len(first) - 1
        self.vocabulary, rank = np.unique(hashes, return_inverse=True)
        at = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(first))
        self.first = first + np.arange(docs + 1)
        ranks = np.zeros(len(hashes) + docs + depth, np.int64)
        ranks[at] = 2 * rank + 1
        self.ranks, self.depth = ranks, depth
        n, order, length = len(hashes) + docs, ranks, 1
        while True:  # tripling: ranks of runs of 1, 3, 9 words; the last step overlaps
            step = min(length, (depth - length + 1) // 2) if 3 * length > depth else length
            bits = max(1, int(order.max(initial=0)).bit_length())
            padded = np.concatenate([order, np.zeros(2 * step + 1, np.int64)])
            if 3 * bits <= 63:
                key = (padded[:n] << (2 * bits)) | (padded[step : n + step] << bits) | padded[2 * step : n + 2 * step]
            else:
                pair = np.unique((padded[:n] << bits) | padded[step : n + step], return_inverse=True)[1]
                key = (pair << bits) | padded[2 * step : n + 2 * step]
            length += 2 * step
            if length >= depth:
                break
            order = np.unique(key, return_inverse=True)[1] + 1
        self.array = np.argsort(key, kind="stable")

    def search(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(suffix number, low, high): for each test suffix that occurs, its interval in the array."""
        if not len(self.vocabulary) or not len(tests.start):
            return (np.zeros(0, np.int64),) * 3
        place = np.minimum(np.searchsorted(self.vocabulary, tests.words), len(self.vocabulary) - 1)
        query = np.where(self.vocabulary[place] == tests.words, 2 * place + 1, -1)
        unknown = np.concatenate([[0], np.cumsum(query < 0)])
        which = np.flatnonzero(unknown[tests.start + tests.length] == unknown[tests.start])
        start, length = tests.start[which], tests.length[which]
        low, high = self._bound(query, start, length, False), self._bound(query, start, length, True)
        some = low < high
        return which[some], low[some], high[some]

    def _bound(self, query: np.ndarray, start: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.array), np.int64)
        open_ = np.arange(len(start))
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            at, way = self.array[middle], np.zeros(len(open_), np.int64)
            going = np.arange(len(open_))
            for t in range(self.depth):
                going = going[(way[going] == 0) & (length[open_[going]] > t)]
                if not len(going):
                    break
                way[going] = np.sign(self.ranks[at[going] + t] - query[start[open_[going]] + t])
            right = way <= 0 if after else way < 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def covered(self, tests: Tests, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """For each place of the shard whether its word lies inside an occurrence of a test suffix that search() found."""
        which, low, high = found
        edge = np.zeros(len(self.ranks) + 1, np.int64)
        length = tests.length[which]
        for n in np.unique(length):
            some = length == n
            marked = np.zeros(len(self.array) + 1, np.int64)
            np.add.at(marked, low[some], 1)
            np.add.at(marked, high[some], -1)
            place = self.array[np.cumsum(marked)[:-1] > 0]
            edge[place] += 1
            edge[place + n] -= 1
        return np.cumsum(edge)[:-1] > 0

    def holders(self, tests: Tests, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of every text of the shard and item with an occurrence in it, each pair once, in order."""
        which, low, high = found
        intervals, number = np.unique(low * (len(self.array) + 1) + high, return_inverse=True)
        low, high = np.divmod(intervals, len(self.array) + 1)
        items = len(tests.first)
        asked = np.unique(number * items + tests.item[which])  # (interval, item)
        done, at = [np.zeros(0, np.int64)], 0
        total = np.cumsum((high - low)[asked // items])
        while at < len(asked):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            interval, item = np.divmod(asked[at:to], items)
            place, of = self._expand(low[interval], high[interval])
            text = np.searchsorted(self.first, place, side="right") - 1
            done.append(np.unique(text * items + item[of]))
            at = to
        return np.divmod(np.unique(np.concatenate(done)), max(items, 1))

    def _expand(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, interval number) of all that the intervals of the array hold."""
        n = high - low
        of = np.repeat(np.arange(len(n)), n)
        return self.array[np.arange(len(of)) - np.repeat(np.cumsum(n) - n - low, n)], of

    def runs(self, tests: Tests, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The longest verbatim matches, in parts: place in the shard, words, item, and the word of the item that each
        begins with. Occurrences that follow each other on one diagonal are one match.

        Few pairs of places are sorted together. Where there are more than PAIRS, the suffixes of an item are taken in
        order, and each place holds the length of the run that ends there: memory goes by the places, not by the pairs.
        """
        which, low, high = found
        if (high - low).sum() <= PAIRS:
            place, of = self._expand(low, high)
            yield _runs(place, which[of], tests)
            return
        order = np.argsort(which, kind="stable")
        held, seen = np.zeros(len(self.ranks) + 1, np.int64), np.full(len(self.ranks) + 1, -9, np.int64)
        before, places = -9, np.zeros(0, np.int64)
        for k in [*order.tolist(), None]:
            s = -9 if k is None else int(which[k])
            now = np.zeros(0, np.int64) if k is None else self.array[low[k] : high[k]]
            follows = s == before + 1 and tests.item[s] == tests.item[before]
            count = np.where(seen[now - 1] == before, held[now - 1], 0) + 1 if follows else np.ones(len(now), np.int64)
            lengths = held[places]
            held[now], seen[now] = count, s
            if len(places):  # runs of the suffix before that go no further
                over = seen[places + 1] != s if follows else np.ones(len(places), bool)
                ended, lengths = places[over], lengths[over]
                if len(ended):
                    item = int(tests.item[before])
                    yield ended - lengths + 1, lengths - 1 + tests.length[before], np.full(len(ended), item), tests.start[before] - tests.first[item] - lengths + 1
            before, places = s, now


def _runs(place: np.ndarray, suffix: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """The longest verbatim matches of listed occurrences; see SuffixArray.runs()."""
    diagonal, item = place - tests.start[suffix], tests.item[suffix]
    order = np.lexsort((place, diagonal, item))
    d, p, i, suffix = diagonal[order], place[order], item[order], suffix[order]
    head = np.flatnonzero((np.diff(d, prepend=0) != 0) | (np.diff(p, prepend=0) != 1) | (np.diff(i, prepend=-1) != 0))
    words = np.diff(head, append=len(p)) - 1 + tests.length[suffix[head]]
    return p[head], words, i[head], tests.start[suffix[head]] - tests.first[i[head]]


_HITS = "struct<starts: array<long>, ends: array<long>, items: array<string>, longest: long>"
_ARROW_HITS = pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
_FOUND = "struct<n_words: long, n_hit: long, items: array<string>, longest: long, contaminated: boolean>"
_ARROW_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("contaminated", pa.bool_())])


def _shard(part: pa.RecordBatch, text: str, window: int) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of a slice of texts, and where each text's words begin."""
    data, offsets = W.packed(part.column(text))
    data = W.lowered(data)
    starts, ends, first = W.spans(data, offsets, W.ALNUM)
    return SuffixArray(W.span_hashes(data, starts, ends), first, window), first


def _listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _search_block(docs: DataFrame, tests: Tests, window: int, share: int | None) -> DataFrame:
    """docs with the hits of one block of tests added to those of the blocks before (_hit_words: spans of hit words, items,
    longest match); with a share, which ends the search, with the verdict _found instead."""
    shared = docs.sparkSession.sparkContext.broadcast(tests)
    names = [n for n in docs.columns if n != "_hit_words"]
    had = len(names) < len(docs.columns)
    added, kind = ("_hit_words", _HITS) if share is None else ("_found", _FOUND)
    schema = docs.select(*names).schema.add(added, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            for part in W.slices(batch, "_text"):
                array, first = _shard(part, "_text", window)
                rows = part.num_rows
                found = array.search(tests)
                hit = array.covered(tests, found)
                longest = np.zeros(rows, np.int64)
                for place, words, _, _ in array.runs(tests, found):
                    np.maximum.at(longest, np.searchsorted(array.first, place, side="right") - 1, words)
                text, item = array.holders(tests, found)
                items: dict[int, set[str]] = {}
                for d, i in zip(text.tolist(), item.tolist(), strict=True):
                    items.setdefault(d, set()).add(tests.names[i])
                if had:
                    for d, old in enumerate(part.column("_hit_words").to_pylist()):
                        for a, b in zip(old["starts"], old["ends"], strict=True):
                            hit[array.first[d] + a : array.first[d] + b] = True
                        if old["items"]:
                            items.setdefault(d, set()).update(old["items"])
                        longest[d] = max(longest[d], old["longest"])
                total = np.concatenate([[0], np.cumsum(hit)])
                n_words, n_hit = np.diff(first), total[array.first[1:] - 1] - total[array.first[:-1]]
                names_found = [sorted(items.get(d, ())) for d in range(rows)]
                item_lists = pa.array(names_found, pa.list_(pa.string()))
                if share is None:
                    turn = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                    of = np.searchsorted(array.first, turn[::2], side="right") - 1
                    counts = np.bincount(of, minlength=rows)
                    columns = [_listed(pa.array(turn[j::2] - array.first[of]), counts) for j in (0, 1)]
                    values = pa.StructArray.from_arrays([*columns, item_lists, pa.array(longest)], fields=list(_ARROW_HITS))
                else:
                    contaminated = (n_hit > 0) & (share * n_hit >= n_words)
                    values = pa.StructArray.from_arrays([pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), item_lists, pa.array(longest), pa.array(contaminated)], fields=list(_ARROW_FOUND))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), values], names=[*names, added])

    return docs.mapInArrow(run, schema)


def _blocks(benchmark: DataFrame, window: int) -> Iterator[tuple[bool, Tests]]:
    """(whether it is the last, suffixes) of the benchmark's texts, some BLOCK_BYTES at a time."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = benchmark.select(F.col("item_id"), F.col("text").cast("string"))
    for b in range(blocks):
        block = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield b + 1 == blocks, tests_of([tuple(r) for r in block.collect()], window)


def found_in(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """All columns of docs, and _found: n_words, n_hit, items, longest (verbatim match, words) and contaminated.

    A window is ``window`` consecutive words (digits, a-z after lower-casing A-Z, non-ASCII) of a benchmark
    item, or a shorter item whole; a word of a document inside an occurrence is hit. contaminated: n_hit > 0
    and share * n_hit >= n_words. Null and empty texts have no words and no hits; an item without words has no
    window; item ids count as strings, a repeated id once; repeated documents are judged alike; very long texts
    are searched whole (a slice holds a text at least). Empty tables give no rows or no hits. Columns of
    docs with any names go through; names that begin with _hit_, _found or _text are reserved.
    """
    frame = docs.withColumn("_text", F.col("text").cast("string"))
    for last, tests in _blocks(benchmark, window):
        frame = _search_block(frame, tests, window, share if last else None)
        if not last:
            frame = kept(frame)
    return frame.drop("_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their own columns; see found_in().

    Null, empty and wordless texts stay; repeated rows stay or go together; very long texts are searched whole; an empty
    table gives an empty result, an empty benchmark keeps all. Columns of any names go through, but for those that begin
    with _hit_, _found or _text, which must not be there.
    """
    return found_in(docs, benchmark, window, share).where(~F.col("_found.contaminated")).drop("_found")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match."""
    found = found_in(docs.select("doc_id", "text"), benchmark, window, share)
    return found.select(
        "doc_id", F.col("_found.n_words").alias("n_words"), F.col("_found.n_hit").alias("n_hit"), F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ",").cast("binary"), 256).alias("items_sha256"), F.col("_found.contaminated").alias("contaminated"), F.col("_found.longest").alias("longest_match"),
    )


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, start, n_words, item_id, item_start: a row for each longest verbatim match of a benchmark item in a document.

    start and item_start number the words (from 0) of the document and of the item. Documents without a match have no row;
    for nulls, short items, repeated rows, very long texts and empty tables see found_in().
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id").schema.add("start", "long").add("n_words", "long").add("item_id", "string").add("item_start", "long")

    def listed(tests: Tests) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            names = pa.array(tests.names, pa.string())
            for batch in batches:
                for part in W.slices(batch):
                    array, _ = _shard(part, "text", window)
                    for place, words, item, item_start in array.runs(tests, array.search(tests)):
                        doc = np.searchsorted(array.first, place, side="right") - 1
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(place - array.first[doc]), pa.array(words), names.take(pa.array(item)), pa.array(item_start)], names=schema.names)

        return rows.mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, [listed(tests) for _, tests in _blocks(benchmark, window)])
