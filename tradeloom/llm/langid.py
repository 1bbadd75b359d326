"""Language identification by prediction by partial matching over bytes.

For each language a tree of byte contexts of variable length, up to five bytes, holds frozen counts; a context is in the
tree if it occurs often enough in the sample, so frequent ones are longer. A byte costs -log2(count / (total +
distinct)) in the longest context of the tree that has seen it, plus an escape of -log2(distinct / (total + distinct))
for each longer one that hasn't (method C, no exclusions, no updates), and 8 bits where no context has. The language
with the shortest code for the whole text wins. All 256 byte values are symbols; only A-Z count as a-z.

A context with its next byte is a number of 48 bits at most. The numbers that some language has seen are rows of a hash
table with the finished costs for all languages, so most bytes take one look-up. Where such a table of an order would
grow too large (many languages), that order and the longer ones are kept as differences to the next shorter one, for
those languages alone that know the context or the number: the code lengths are the same, whatever the number of
languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

#: Longest context in bytes; occurrences in the sample that a context needs; costs (rows x languages) in a table at most.
ORDER, LEAST, CELLS = 5, 4, 1 << 24
_CHUNK = 1 << 17


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _mask(order: int) -> int:
    return (1 << 8 * (order + 1)) - 1


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of lower-cased texts: itself after the five bytes before it, as one number, and how many of these
    belong to its text."""
    wide = data.astype(np.int64)
    grams = wide.copy()
    for back in range(1, ORDER + 1):
        grams[back:] |= wide[:-back] << (8 * back)
    depth = np.full(len(data), ORDER, np.int8)
    heads = offsets[:-1][np.diff(offsets) > 0]
    for j in range(ORDER):  # the first bytes of a text, at the text's own end at most
        at = heads + j
        at = at[at < len(data)]
        depth[at] = np.minimum(depth[at], j)
    for h in heads[1:][np.diff(heads) < ORDER]:  # a text after a very short one
        depth[h : h + ORDER] = np.minimum(depth[h : h + ORDER], np.arange(len(depth[h : h + ORDER])))
    return grams, depth


class _Places:
    """A hash table: number -> its place in ``keys``, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * max(len(keys), 1)).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (W.mix(keys.astype(np.uint64)) >> np.uint64(7)).astype(np.int64) & self.mask

    def find(self, asked: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(asked), -1, np.int32)
        at = self._first(asked)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != asked))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != asked[open_])]
        return found


@dataclass
class _Sparse:
    """Numbers in order, and for each a run of languages with bits."""

    keys: np.ndarray
    start: np.ndarray
    language: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, keys: list[np.ndarray], bits: list[np.ndarray]) -> _Sparse:
        """From the numbers and bits of each language."""
        language = np.repeat(np.arange(len(keys), dtype=np.int16), [len(k) for k in keys])
        every, values = np.concatenate(keys), np.concatenate(bits).astype(np.float32)
        order = np.argsort(every, kind="stable")
        unique, start = np.unique(every[order], return_index=True)
        return cls(unique, np.append(start, len(every)), language[order], values[order])

    def add(self, asked: np.ndarray, text: np.ndarray, total: np.ndarray) -> None:
        """Adds the bits of each number asked to the row of total that ``text`` names."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        some = self.keys[at] == asked
        at, text = at[some], text[some]
        n = self.start[at + 1] - self.start[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.start[at], n)
        cell = np.repeat(text, n) * total.shape[1] + self.language[place]
        total += np.bincount(cell, self.bits[place], total.size).reshape(total.shape)


@dataclass
class PpmModel:
    """For each order: the numbers (context and byte) that some language has seen and their costs in bits, and the contexts
    of some language and their escapes (0 for a language without the context). A column a language. Orders after these
    have differences to the order before: what a known context adds, and what a seen number adds to that."""

    languages: list[str]
    grams: list[_Places]
    costs: list[np.ndarray]
    contexts: list[_Places]
    escapes: list[np.ndarray]
    further: list[tuple[_Sparse, _Sparse]]

    def cost(self, order: int, grams: np.ndarray) -> np.ndarray:
        """[number, language] costs of bytes after contexts of ``order`` bytes."""
        if order < 0:
            return np.full((len(grams), len(self.languages)), 8.0, np.float32)
        row = self.grams[order].find(grams)
        out = self.costs[order][row] if len(self.costs[order]) else np.zeros((len(grams), len(self.languages)), np.float32)
        new = np.flatnonzero(row < 0)
        if len(new):
            context = self.contexts[order].find(grams[new] >> 8)
            escape = np.where((context >= 0)[:, None], self.escapes[order][context], 0) if len(self.escapes[order]) else 0
            out[new] = escape + self.cost(order - 1, grams[new] & _mask(order - 1))
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[text, language] code lengths of lower-cased texts."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        grams, depth = _grams(data, offsets)
        last = len(self.grams) - 1
        step = max(1, _CHUNK // max(1, len(self.languages) // 8))
        for at in range(0, len(grams), step):
            some, deep = grams[at : at + step] & _mask(last), depth[at : at + step]
            cost = self.cost(last, some).astype(np.float64)
            for order in range(min(ORDER, last)):
                short = np.flatnonzero(deep == order)
                if len(short):
                    cost[short] = self.cost(order, some[short] & _mask(order))
            a = np.searchsorted(offsets, at, side="right") - 1
            b = np.searchsorted(offsets, min(at + step, len(grams)), side="left")
            heads = np.maximum(offsets[a:b] - at, 0)
            full = np.flatnonzero(np.diff(np.append(heads, len(some))) > 0)
            total[a + full] += np.add.reduceat(cost, heads[full], axis=0)
            text = np.repeat(full, np.diff(np.append(heads[full], len(some))))
            for order, (escapes, seen) in enumerate(self.further, last + 1):
                enough = np.flatnonzero(deep >= order)
                asked = grams[at : at + step][enough] & _mask(order)
                escapes.add(asked >> 8, text[enough], total[a:b])
                seen.add(asked, text[enough], total[a:b])
        return total


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place, counts, len(unique))


def build_model(languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], least: int = LEAST) -> PpmModel:
    """grams: for each language the numbers of its sample, how many bytes before each belong to the text, and counts."""
    n = len(languages)
    model = PpmModel(languages, [], [], [], [], [])
    shorter: list[tuple[np.ndarray, np.ndarray]] = []  # of each language: the numbers of the order before and their costs
    for order in range(ORDER + 1):
        own = []
        for x in languages:
            key, depth, count = grams[x]
            some = depth >= order
            g, c = _summed(key[some] & _mask(order), count[some])
            context, place = np.unique(g >> 8, return_inverse=True)
            total, distinct = np.bincount(place, c, len(context)), np.bincount(place, minlength=len(context))
            known = (total >= least) | (order == 0)
            own.append((g[known[place]], c[known[place]], place[known[place]], context, known, total, distinct))
        costs_of = [-np.log2(c / (total[place] + distinct[place])) for _, c, place, _, _, total, distinct in own]
        escapes_of = [-np.log2(distinct / (total + distinct)) for *_, total, distinct in own]
        before, shorter = shorter, [(o[0], x) for o, x in zip(own, costs_of, strict=True)]
        keys = np.unique(np.concatenate([o[0] for o in own]))
        if model.further or order > 2 and len(keys) * n > CELLS:
            # a number seen after a context was seen after the shorter one too, so its shorter cost is the language's own
            added = [x - cost[np.searchsorted(key, o[0] & _mask(order - 1))] - e[o[2]] for o, x, e, (key, cost) in zip(own, costs_of, escapes_of, before, strict=True)]
            model.further.append((_Sparse.of([o[3][o[4]] for o in own], [e[o[4]] for o, e in zip(own, escapes_of, strict=True)]), _Sparse.of([o[0] for o in own], added)))
            continue
        contexts = np.unique(np.concatenate([o[3][o[4]] for o in own]))
        escapes = np.zeros((len(contexts), n), np.float32)
        for i, o in enumerate(own):
            escapes[np.searchsorted(contexts, o[3][o[4]]), i] = escapes_of[i][o[4]]
        costs = model.cost(order - 1, keys & _mask(order - 1) if order else keys)
        costs += escapes[np.searchsorted(contexts, keys >> 8)] if len(keys) else 0
        for i, o in enumerate(own):
            costs[np.searchsorted(keys, o[0]), i] = costs_of[i]
        model.grams.append(_Places(keys))
        model.costs.append(costs)
        model.contexts.append(_Places(contexts))
        model.escapes.append(escapes)
    return model


def train(docs: DataFrame, sample_docs: int = 400, most_languages: int = 256) -> PpmModel | None:
    """A model of the labelled documents that aren't held out, or None if there are none.

    sample_docs: about so many documents of each language, whole, the ones with the least hashes; all of a language
    with fewer. most_languages: so many labels, the most frequent ones, are learned. Counting runs in Spark; the driver
    gets the distinct numbers of the sample.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return None
    languages = sorted(r.lang for r in sizes)
    number = F.create_map(*(F.lit(v) for i, x in enumerate(languages) for v in (x, i)))
    share = F.create_map(*(F.lit(v) for r in sizes for v in (r.lang, min(1.0, sample_docs / r.n))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * (1 << 30))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.wide(batch):
                lang = part.column("lang").to_numpy(zero_copy_only=False)
                for language in np.unique(lang):
                    data, offsets = W.packed(part.column("text").take(pa.array(np.flatnonzero(lang == language))))
                    grams, depth = _grams(W.lowered(data), offsets)
                    key, n = np.unique(grams & _mask(ORDER) | depth.astype(np.int64) << 8 * (ORDER + 1), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(key), language, np.int32)), "gram": pa.array(key), "n": pa.array(n, pa.int64())})

    counted = sample.select(F.element_at(number, F.col("lang")).alias("lang"), "text").mapInArrow(count_grams, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang, key, n = (counted[c].to_numpy() for c in ("lang", "gram", "n"))
    grams = {}
    for i, language in enumerate(languages):
        some = lang == i
        if some.any():
            grams[language] = key[some] & _mask(ORDER), key[some] >> 8 * (ORDER + 1), n[some].astype(np.float64)
    return build_model(sorted(grams), grams) if grams else None


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = W.lowered(data)
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    found = total[offsets[1:]] > total[offsets[:-1]]
    raw = data.tobytes()
    for d in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[d] = any(c.isalpha() for c in raw[offsets[d] : offsets[d + 1]].decode("utf-8", "replace"))
    return found


def predict(docs: DataFrame, model: PpmModel | None) -> DataFrame:
    """All columns of docs, and _lang_pred (string), _lang_score (double): see identify()."""
    names = list(docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in W.slices(batch):
                data, offsets = W.packed(part.column("text"))
                found = _has_letter(data, offsets) if model else np.zeros(part.num_rows, bool)
                lang, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if found.any():
                    bits = model.bits(W.lowered(data), offsets)
                    best = bits.argmin(1)
                    odds = np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000))
                    lang[found] = np.array(model.languages, object)[best[found]]
                    score[found] = (1 / odds.sum(1))[found]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "_lang_pred", "_lang_score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, sample_docs: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    held_out: crc32 of the doc_id as text, mod 5, is 0; such rows and rows without lang are never learned from.
    lang_pred: the language with the shortest code, or `und` (score 0) if the text is null, empty or without a letter, or
    nothing could be learned. score: the language's posterior under equal priors, 0 to 1. Ties go to the
    first language by name; repeated rows get equal results; texts are scored whole, whatever their length; an
    empty table gives an empty result; further columns of docs are ignored.
    """
    model = train(docs, sample_docs)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, model).select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def keep_identified(docs: DataFrame, sample_docs: int = 400, least_score: float = 0.3) -> DataFrame:
    """The documents, with their own columns, whose language is found with a score of least_score or more.

    Null, empty and letterless texts go; repeated rows are kept or go together; texts are scored whole, whatever their
    length; an empty table gives an empty result, and so does one without a label to learn from. Columns of any names
    go through, but for _lang_pred and _lang_score, which must not be there.
    """
    found = predict(docs, train(docs, sample_docs))
    return found.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= least_score)).drop("_lang_pred", "_lang_score")
