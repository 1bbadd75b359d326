"""Toxicity by a factorization machine over hashed terms (Rendle, 2010).

A document is the set of its terms: lower-cased words and their beginnings, each hashed to one of 2**28 buckets. The
machine adds a weight per term and, for each two terms, the product of their factors: an insult beside a mention of a
group says more than both alone, which no sum of weights can express. Weights are learned with an L1 penalty, so that
terms that say nothing have none; factors are for terms with a weight only (Li et al., 2016). Both keep long clean
texts, with thousands of terms, at the bias.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .langid import held_out
from .shared import kept

BUCKET_BITS = 28
#: Lengths of the word beginnings that are terms.
BEGINNINGS = (4, 5, 6)
#: Code points that are hashed at once; longer texts are cut between words.
PIECE = 1 << 20
#: Code points of words; those beyond the last entry count as that one.
_LETTERS = np.array([chr(c).isalnum() for c in range(1 << 16)] + [True])
_MASK_BITS = 20


def _pieces(texts: pa.Array) -> Iterator[tuple[list[int], list[str]]]:
    """Documents' numbers and lower-cased texts, some at a time; one longer than PIECE comes in several pieces."""
    numbers, held, size = [], [], 0
    for i, t in enumerate(texts.to_pylist()):
        t = (t or "").lower()
        at = 0
        while at < len(t):
            to = min(len(t), at + PIECE)
            while at < to < len(t) and t[to].isalnum() and to > at + PIECE - 1000:
                to -= 1
            numbers.append(i)
            held.append(t[at:to])
            size += to - at
            at = to
            if size >= PIECE:
                yield numbers, held
                numbers, held, size = [], [], 0
    if held:
        yield numbers, held


def occurrences(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the terms of all texts, some at a time, as often as they stand there. Null texts have none."""
    for numbers, held in _pieces(texts):
        code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in held])])
        inside = _LETTERS[np.minimum(code, len(_LETTERS) - 1)]
        starts, ends, first = W.spans(inside.astype(np.uint8), offsets, np.array([False, True]))
        if len(starts):
            document = np.repeat(np.array(numbers, np.int64), np.diff(first))
            hashes = W.Prefixes(code)
            yield document, _bucket(hashes.between(starts, ends), 0)
            for length in BEGINNINGS:
                some = np.flatnonzero(ends - starts >= length)
                yield document[some], _bucket(hashes.between(starts[some], starts[some] + length), length)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (W.mix(hashes + np.uint64(kind)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]))
    return key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct term of every text, sorted."""
    return _distinct([np.unique(d << BUCKET_BITS | b) for d, b in occurrences(texts)])


@dataclass
class FactorizationMachine:
    """bias + sum of weights + sum over pairs of products of factors, for the buckets that have any (sorted)."""

    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._some = np.zeros(1 << _MASK_BITS, bool)
        self._some[self.buckets >> (BUCKET_BITS - _MASK_BITS)] = True

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities of the texts. Only terms that the machine knows are kept at all."""
        found = []
        for document, bucket in occurrences(texts):
            some = np.flatnonzero(self._some[bucket >> (BUCKET_BITS - _MASK_BITS)])
            found.append(np.unique(document[some] << BUCKET_BITS | bucket[some]))
        return self.probabilities(*_distinct(found), len(texts))

    def probabilities(self, document: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n documents given their distinct terms."""
        z = np.full(n, self.bias)
        if len(self.buckets):
            place = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[place] == bucket
            document, place = document[hit], place[hit]
            z += np.bincount(document, self.weights[place], n)
            # each pair once: (square of the sum - sum of squares) / 2
            for f in self.factors.T:
                v = f[place]
                z += (np.bincount(document, v, n) ** 2 - np.bincount(document, v * v, n)) / 2
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(documents: list[np.ndarray], toxic: np.ndarray, factors: int = 8, epochs: int | None = None, least_docs: int = 3, pair_docs: int = 8, l1: float = 8.0, weight: float = 4.0, seed: int = 7) -> FactorizationMachine:
    """A machine for documents (distinct buckets each) and their labels 0 and 1, taken in the given order.

    Weights follow the proximal leader with an L1 penalty (McMahan et al., 2013), factors adaptive gradients with an L2
    penalty and a pull of all factors of a term towards zero; the first half of the passes learns weights alone,
    and the terms of pair_docs documents or more that have one then get factors. Terms of fewer than least_docs
    documents are left out. A toxic document counts weight times, as there are few of them. epochs: passes over the documents; unless given 6 or more, up
    to 60, so that 40,000 documents are seen.
    """
    epochs = epochs or min(60, max(6, 40_000 // max(1, len(documents))))
    known, count = np.unique(np.concatenate(documents), return_counts=True) if documents else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    known, count = known[count >= least_docs], count[count >= least_docs]
    rows = []
    for d in documents:
        at = np.minimum(np.searchsorted(known, d), max(len(known) - 1, 0))
        rows.append(at[known[at] == d] if len(known) else at[:0])
    z, n = np.zeros(len(known)), np.zeros(len(known))
    v = np.random.default_rng(seed).normal(0, 0.03, (len(known), factors)).astype(np.float32)
    squares = np.full((len(known), factors), 1e-2, np.float32)
    share = toxic.mean() if len(toxic) else 0.5
    bias, bias_n = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), 1.0
    alpha, beta, l2, pull = 1.0, 1.0, 1e-2, 0.02

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) * alpha / (beta + np.sqrt(n[at])))

    paired = np.zeros(len(known), bool)
    for epoch in range(epochs):
        if epoch == (epochs + 1) // 2:
            paired = (weights(slice(None)) != 0) & (count >= pair_docs)
        for at, y in zip(rows, toxic, strict=True):
            w = weights(at)
            pairs = at[paired[at]]
            own = v[pairs]
            total = own.sum(0)
            raw = bias + w.sum() + float((total * total).sum() - (own * own).sum()) / 2
            error = 1 / (1 + np.exp(-min(max(raw, -30.0), 30.0))) - y
            if y:
                error *= weight
            square = error * error
            bias_n += square
            bias -= 0.1 * error / np.sqrt(bias_n)
            z[at] += error - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
            if factors and len(pairs) > 1:
                slope = (error * (total - own) + l2 * own).astype(np.float32)
                squares[pairs] += slope * slope
                pace = 0.1 / np.sqrt(squares[pairs])
                new = own - pace * slope
                size = np.sqrt((new * new).sum(1, keepdims=True)) + 1e-9
                v[pairs] = new * np.maximum(1 - pull * pace.mean(1, keepdims=True) / size, 0.05)
    w = weights(slice(None))
    v[~paired] = 0
    some = np.flatnonzero((w != 0) | paired)
    return FactorizationMachine(known[some], w[some], v[some].astype(np.float64), float(bias))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, factors: int = 8) -> FactorizationMachine | None:
    """A machine learned from labelled documents that aren't held out, or None if there are none.

    sample_docs: so many documents of either label at most, whole, the ones with the least hashes of their ids. The
    bias is moved from the sample's share of toxic documents to that of all labelled ones. Ids and labels meet without
    texts; the texts of the sample meet its ids, a bounded number, by broadcast. One task fits the sample; the rows
    that it returns are the terms with a weight.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where(~held_out())
    ids = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id")
    labelled = kept(marks.join(ids, "doc_id", "left_semi").withColumn("place", F.xxhash64("doc_id")))
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    some = lambda y: labelled.where(F.col("toxic") == y).orderBy("place", "doc_id").limit(sample_docs)
    sample = some(0).unionByName(some(1))
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(sample), "doc_id")

    def to_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                document, bucket = terms(part.column("text"))
                offsets = np.searchsorted(document, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("toxic"), lists], names=["place", "toxic", "terms"])

    def to_machine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, toxic = [], []
        for batch in batches:
            column = batch.column("terms")
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
            documents += [flat[a:b].astype(np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            toxic.append(batch.column("toxic").to_numpy(zero_copy_only=False))
        if documents:
            m = fit(documents, np.concatenate(toxic), factors)
            values = np.column_stack([m.weights, m.factors]) if len(m.buckets) else np.zeros((0, factors + 1))
            values = np.vstack([[m.bias] + [0.0] * factors, values])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, factors + 1, dtype=np.int32)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], m.buckets])), lists], names=["bucket", "values"])

    shares = own.select("place", "toxic", "text").mapInArrow(to_terms, "place long, toxic int, terms array<int>")
    found = shares.repartition(1).sortWithinPartitions("place", "toxic", "terms").mapInArrow(to_machine, "bucket long, values array<double>").toArrow()
    if not found.num_rows:
        return None
    bucket = found["bucket"].to_numpy()
    values = found["values"].combine_chunks().flatten().to_numpy().reshape(len(bucket), factors + 1)
    order = np.argsort(bucket)
    bucket, values = bucket[order], values[order]
    odds = lambda p, q: np.log(max(p, 0.5) / max(q, 0.5))
    taken = {y: min(x, sample_docs) for y, x in sizes.items()}
    moved = odds(sizes.get(1, 0), sizes.get(0, 0)) - odds(taken.get(1, 0), taken.get(0, 0))
    return FactorizationMachine(bucket[1:], values[1:, 0].copy(), values[1:, 1:].copy(), float(values[0, 0] + moved))


def toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, factors: int = 8) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    held_out: crc32 of the doc_id as text, mod 5, is 0; such rows are never learned from. score: the probability of label
    toxic, 0 to 1, from the text alone; predicted: 1 if it is 0.5 or more. A null or empty text, or one without letters and
    digits, gets the bias alone. Without any label to learn from every score is 0. Repeated rows get equal results; a
    doc_id with several labels is toxic if one of them says so; labels of no document and null labels are ignored. Texts
    are read whole, whatever their length; an empty table gives an empty result; further columns are ignored.
    """
    machine = train(docs, labels, sample_docs, factors)
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in W.slices(batch):
                score = m.scores(part.column("text")) if m else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
