"""License scan: winnowed fingerprints find candidates, banded alignment measures them.

Templates are cut into runs of three words; of each three neighbouring runs the one with the least hash is a
fingerprint, and an inverted index keeps where it lies. A text's fingerprints are looked up there; those of one
template on nearby diagonals make a candidate. Its words are then aligned with the template's, within a band about
the diagonal: the share of the template matched in order is its coverage, first and last match its span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .license_texts import TEMPLATES

GRAM, WINNOW = 3, 3


@dataclass
class Template:
    license: str
    words: np.ndarray
    fingerprints: int
    band: int


@dataclass
class Index:
    """Inverted index: sorted fingerprints, each with a template and a place in it."""

    templates: list[Template]
    keys: np.ndarray
    template: np.ndarray
    place: np.ndarray


def _selected(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places whose hash is the least of some WINNOW neighbours in a row (all of equal ones) of one text.

    text: the number of the text of each hash, in order. Of a text with fewer hashes all are taken.
    """
    n = len(grams)
    chosen = np.bincount(text, minlength=1)[text] < WINNOW if n else np.zeros(0, bool)
    if n >= WINNOW:
        least = np.minimum.reduce([grams[j : n - WINNOW + 1 + j] for j in range(WINNOW)])
        whole = text[: n - WINNOW + 1] == text[WINNOW - 1 :]
        for j in range(WINNOW):
            chosen[j : n - WINNOW + 1 + j] |= whole & (grams[j : n - WINNOW + 1 + j] == least)
    return np.flatnonzero(chosen)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = W.packed(texts)
    low = W.lowered(data)
    starts, ends, first = W.spans(low, offsets, W.ALNUM)
    return data, offsets, starts, ends, first, W.span_hashes(low, starts, ends)


def build_index(texts: dict[str, tuple[str, ...]] = TEMPLATES) -> Index:
    """The index of a dictionary of license names and template texts."""
    templates, keys, which, places = [], [], [], []
    for name, variants in texts.items():
        for text in variants:
            words = _words(pa.array([text]))[5]
            grams = W.window_hashes(words, GRAM)
            at = _selected(grams, np.zeros(len(grams), np.int64))
            keys.append(grams[at])
            which.append(np.full(len(at), len(templates)))
            places.append(at)
            templates.append(Template(name, words, len(at), 4 + len(words) // 10))
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    return Index(templates, keys[order], np.concatenate(which)[order], np.concatenate(places)[order])


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> list[int]:
    """Places in text of the longest common word sequence with the template, where word i of the template may
    match text word i + shift plus or minus band.

    A row of the table holds the 2 * band + 1 text words that template word i may match; the next row lies one further on.
    """
    m, n, width = len(template), len(text), 2 * band + 1
    rows = np.zeros((m + 1, width + 1), np.int32)  # the last column stays 0: beyond the band
    equal = np.zeros((m, width), bool)
    for i in range(m):
        first = i + shift - band
        a, b = max(0, first), min(n, first + width)
        if a < b:
            equal[i, a - first : b - first] = text[a:b] == template[i]
        np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + equal[i]), out=rows[i + 1, :-1])
    found, i, c = [], m, width - 1
    while i and c >= 0 and rows[i, c]:
        if c and rows[i, c] == rows[i, c - 1]:
            c -= 1
        elif rows[i, c] == rows[i - 1, c + 1]:
            i, c = i - 1, c + 1
        else:
            i -= 1
            if rows[i, c] < rows[i + 1, c]:
                found.append(i + shift - band + c)
    return found[::-1]


def _scan(words: np.ndarray, hits: list[tuple[int, int]], index: Index, least: float) -> list[tuple[int, int, int, float]]:
    """(template, first word, word after the last, coverage) of a text; hits: (template, diagonal)."""
    found = []
    hits.sort()
    at = 0
    while at < len(hits):
        t, start = hits[at]
        template = index.templates[t]
        to = at + 1
        while to < len(hits) and hits[to][0] == t and hits[to][1] - hits[to - 1][1] <= template.band:
            to += 1
        if to - at >= max(1, template.fingerprints // 8):
            middle, m = hits[(at + to) // 2][1], len(template.words)
            a, b = max(0, middle - template.band), min(len(words), middle + m + template.band)
            match = align(template.words, words[a:b], middle - a, template.band)
            if match and len(match) >= least * m and 2 * len(match) >= match[-1] - match[0] + 1:
                found.append((t, a + match[0], a + match[-1] + 1, len(match) / m))
        at = to
    found.sort(key=lambda x: (-x[3] * len(index.templates[x[0]].words), -x[3], x[1], x[0]))
    taken: list[tuple[int, int, int, float]] = []
    for x in found:  # the template with most words matched wins where two cover the same words
        if all(x[2] <= y[1] or y[2] <= x[1] for y in taken):
            taken.append(x)
    return sorted(taken, key=lambda x: x[1])


def scan_licenses(docs: DataFrame, index: Index | None = None, min_coverage: float = 0.75) -> DataFrame:
    """doc_id, n_matches, licenses, spans, coverage, matched_words of every row.

    licenses: names found, sorted, comma-joined; spans: name:start:end by start (code points, end exclusive); coverage:
    the best share of a template matched (0 if none); matched_words: template words matched, in all. Null and
    empty texts have none; texts are scanned whole, whatever their length; repeated rows get equal results; an
    empty table gives an empty result; further columns of docs are ignored. Of two templates that match the same
    words the one with more of them counts, then the first named. A map over the rows, without a shuffle.
    """
    index = index or build_index()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                data, offsets, starts, ends, first, words = _words(part.column("text"))
                at = W.window_starts(first, GRAM)
                grams = W.window_hashes(words, GRAM)[at]
                some = _selected(grams, np.searchsorted(first, at, side="right") - 1)
                some = some[np.isin(grams[some], index.keys)]
                low, high = np.searchsorted(index.keys, grams[some], "left"), np.searchsorted(index.keys, grams[some], "right")
                hits: dict[int, list] = {}
                doc = np.searchsorted(first, at[some], side="right") - 1
                for d, w, a, b in zip(doc.tolist(), at[some].tolist(), low.tolist(), high.tolist(), strict=True):
                    hits.setdefault(d, []).extend((int(index.template[i]), int(w - first[d] - index.place[i])) for i in range(a, b))
                n, names, spans, best, matched = (np.zeros(part.num_rows, np.int64), [""] * part.num_rows, [""] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64))
                for d, own in hits.items():
                    found = _scan(words[first[d] : first[d + 1]], own, index, min_coverage)
                    if not found:
                        continue
                    point = np.concatenate([[0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)])
                    n[d], best[d] = len(found), max(x[3] for x in found)
                    matched[d] = sum(round(x[3] * len(index.templates[x[0]].words)) for x in found)
                    names[d] = ",".join(sorted({index.templates[x[0]].license for x in found}))
                    spans[d] = ",".join(f"{index.templates[t].license}:{point[starts[first[d] + a] - offsets[d]]}:{point[ends[first[d] + b - 1] - offsets[d]]}" for t, a, b, _ in found)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(names), pa.array(spans), pa.array(best), pa.array(matched)], names=["doc_id", "n_matches", "licenses", "spans", "coverage", "matched_words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_matches long, licenses string, spans string, coverage double, matched_words long")
