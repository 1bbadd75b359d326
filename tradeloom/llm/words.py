"""Words, hashes and windows of text batches, as numpy arrays over UTF-8 bytes.

Every separator used here is an ASCII byte, so splitting bytes splits code points correctly.
All functions take a *slice*: the bytes of some texts laid end to end and their offsets. Slices hold
whole texts; their size bounds the memory of a task, whatever the number of rows in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Slices whose contents are dealt to groups: wider ones make fewer rows.
WIDE_BYTES = 4 << 20
#: Bytes whose running sum is held at once.
_PIECE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

_ASCII = np.arange(256)
#: Bytes of a word `[^\x20\x09-\x0D]+`.
SPACED = ~((_ASCII == 0x20) | ((_ASCII >= 0x09) & (_ASCII <= 0x0D)))
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z, non-ASCII.
ALNUM = ((_ASCII >= 0x30) & (_ASCII <= 0x39)) | ((_ASCII >= 0x61) & (_ASCII <= 0x7A)) | (_ASCII >= 0x80)
_LOWER = np.where((_ASCII >= 0x41) & (_ASCII <= 0x5A), _ASCII + 32, _ASCII).astype(np.uint8)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``limit`` bytes at most (a longer text stays whole)."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def wide(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return slices(batch, limit=WIDE_BYTES)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the n+1 offsets; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte unchanged."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text (n+1) the number of its first word."""
    n = len(data)
    inside = keep[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, _PIECE + 1), base, _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * _PIECE:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from running sums over the bytes. Spans come in order and don't overlap."""
    out, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _PIECE, side="right")))
        first = starts[at]
        piece = data[first : ends[to - 1]]
        total = np.zeros(len(piece) + 1, _U)
        np.cumsum((piece.astype(_U) + _U(1)) * _power(_BASE, len(piece)), out=total[1:])
        a = starts[at:to] - first
        out[at:to] = (total[ends[at:to] - first] - total[a]) * _power(_BASE_INVERSE, len(piece) + 1)[a]
        at = to
    return mix(out)


class Prefixes:
    """Running sums over symbols (bytes or code points, as many as fit in memory), for hashes of any spans of them."""

    def __init__(self, data: np.ndarray):
        self._total = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=self._total[1:])
        self._inverse = _power(_BASE_INVERSE, len(data) + 1)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span, before mix()."""
        return (self._total[ends] - self._total[starts]) * self._inverse[starts]


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run of k word hashes (text borders are the caller's concern)."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = np.full(m, seed + k, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : j + m]
        if j % 4 == 3:
            out ^= out >> _U(29)
    return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words at which a run of k words of one text starts. first: as from spans()."""
    n = np.diff(first)
    ok = np.zeros(int(first[-1]), bool)
    if len(ok) < k:
        return np.zeros(0, np.int64)
    ok[: len(ok) - k + 1] = True
    for j in range(1, k):  # the last k-1 words of each text start none
        at = first[1:] - j
        ok[at[n >= j]] = False
    return np.flatnonzero(ok)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with an equal key; the rows must come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
