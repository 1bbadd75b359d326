"""Toxicity: the machine against its formula, pairs that sums of weights miss, held-out accuracy, odd rows."""

import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tradeloom.llm import toxicity as X


def test_terms_are_words_and_their_beginnings(monkeypatch):
    texts = ["Idiot, idioten! idi", None, "", "éàü-ÉÀÜ 漢字 a1", "  ,;  ", "idioten"]
    document, bucket = X.terms(pa.array(texts))
    sets = [set(bucket[document == i].tolist()) for i in range(len(texts))]
    plain = [{(0, w) for w in re.findall(r"[^\W_]+", (t or "").lower())} for t in texts]
    plain = [p | {(n, w[:n]) for _, w in p for n in X.BEGINNINGS if len(w) >= n} for p in plain]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i, j in combinations(range(len(texts)), 2):
        assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])
    # texts cut into pieces, between words, have the same terms
    long = [" ".join(random.Random(i).choices(["alpha", "betagamma", "ä", "deltas"], k=400)) for i in range(3)] + texts
    whole = X.terms(pa.array(long))
    monkeypatch.setattr(X, "PIECE", 50)
    assert all((a == b).all() for a, b in zip(whole, X.terms(pa.array(long)), strict=True))


def test_probabilities_follow_the_formula():
    rng = np.random.default_rng(0)
    m = X.FactorizationMachine(np.sort(rng.choice(1 << 28, 30, False)), rng.normal(0, 1, 30), rng.normal(0, 1, (30, 4)), -0.5)
    docs = [sorted(rng.choice(m.buckets, k, False).tolist()) + [5] for k in (0, 1, 2, 7, 30)]
    document = np.concatenate([np.full(len(d), i) for i, d in enumerate(docs)])
    got = m.probabilities(document, np.concatenate(docs), len(docs))
    for d, p in zip(docs, got, strict=True):
        at = [m.buckets.tolist().index(b) for b in d if b in m.buckets.tolist()]
        z = m.bias + sum(m.weights[i] for i in at) + sum(float(m.factors[i] @ m.factors[j]) for i, j in combinations(at, 2))
        assert math.isclose(p, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def _paired(n, seed):
    """Texts in which insults are toxic only beside a mention of a group; three of one kind alone aren't, one of each is."""
    rng = random.Random(seed)
    filler = [f"word{rng.randrange(10**6)}" for _ in range(300)]
    insults, groups = ["vile", "rotten", "filthy", "stinking"], ["northers", "southers", "islanders", "hillfolk"]
    texts, toxic = [], []
    for _ in range(n):
        w, a, b = rng.choices(filler, k=rng.randint(5, 60)), rng.randrange(4), rng.randrange(4)
        if a and b:
            a = b = 1
        w += rng.sample(insults, a) + rng.sample(groups, b)
        rng.shuffle(w)
        texts.append(" ".join(w))
        toxic.append(int(a and b))
    return texts, np.array(toxic)


def test_pairs_tell_what_single_terms_cannot():
    texts, toxic = _paired(6000, 1)
    document, bucket = X.terms(pa.array(texts))
    split = np.searchsorted(document, np.arange(len(texts) + 1))
    docs = [bucket[a:b] for a, b in zip(split[:-1], split[1:], strict=True)]
    others, truth = _paired(7000, 1)
    others, truth = others[6000:], truth[6000:]
    right = {}
    for factors in (0, 8):
        m = X.fit(docs, toxic, factors, epochs=8)
        right[factors] = ((m.scores(pa.array(others)) >= 0.5) == truth).mean()
    assert right[8] > 0.95 and right[8] > right[0] + 0.1


def _insulted(n):
    rng = random.Random(5)
    filler = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = rng.choices(filler, k=rng.randint(20, 200))
        bad = i % 4 == 0
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["scumbag", "cretin", "vermin"]) + rng.choice(["", "s", "like"])
        rows.append((i, " ".join(w), int(bad)))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    rows = _insulted(900)
    odd = [(2000, None), (2001, ""), (2002, " \n"), (None, "cretin"), (0, rows[0][1]), (2003, " ".join(r[1] for r in rows[1:4]) * 60), (2004, rows[4][1].upper())]
    docs = spark.createDataFrame([(d, t, 0.5, "x", 1) for d, t in [*(r[:2] for r in rows), *odd]], "doc_id long, text string, score double, terms string, toxic int").repartition(4)
    labels = spark.createDataFrame([*((d, 1, y, 7) for d, _, y in rows), (5000, 0, 1, 7), (None, 0, 1, 7), (6, 1, None, 7), (2000, 0, 1, 7)], "doc_id long, quality int, toxic int, place int")
    return docs, labels, {d: y for d, _, y in rows}


def test_held_out_documents_and_odd_rows(judged):
    docs, labels, truth = judged
    got = X.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    by = {r.doc_id: r for r in rows}
    wrong = [(d, y, by[d].score) for d, y in truth.items() if by[d].held_out and by[d].predicted != y]
    assert len(wrong) <= 2 and all(y for _, y, _ in wrong)
    assert by[2000].score == by[2001].score == by[2002].score < 0.5
    assert len({r.score for r in rows if r.doc_id == 0}) == 1 and by[2004].score == by[4].score and by[2003].predicted == 0


def test_labels_of_held_out_documents_change_nothing(judged):
    docs, labels, _ = judged
    other = labels.withColumn("toxic", (~X.held_out()).cast("int") * labels["toxic"] + X.held_out().cast("int") * (1 - labels["toxic"]))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert sorted(X.toxicity(docs, labels).collect(), key=key) == sorted(X.toxicity(docs, other).collect(), key=key)


def test_empty_tables(judged):
    docs, labels, _ = judged
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in X.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_accuracy_on_the_given_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = X.toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.975
    assert sum(r.predicted and not r.toxic for r in rows) <= 3
