"""Filter audit and centroid clustering against plain Python, with odd rows."""

import hashlib
import math
import re
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pytest

from tradeloom.llm import centroid_clusters as C
from tradeloom.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _fails(rows):
    """Set of failed filters of each (doc_id, text, source)."""
    out = []
    for d, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        bad["E"] = d is not None and any(x is not None and x < d and (y or "") == t for x, y, _ in rows)
        out.append({f for f, x in bad.items() if x})
    return out


def _audit(rows, labels):
    fails, got = _fails(rows), []
    for part in {s or "" for _, _, s in rows}:
        own = [(f, d) for f, (d, _, s) in zip(fails, rows, strict=True) if (s or "") == part]
        mark = lambda d, k: any(x == d and row[k] == 1 for x, *row in labels if x is not None)
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                failing = sum(f in x for x, _ in own)
                steps.append((part, order, k, len(left), len(gone), failing - len(gone), sum(x == {f} for x, _ in own), sum(mark(d, 0) for _, d in gone), sum(mark(d, 1) for _, d in gone), f))
        got += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(got)


def _documents():
    words = lambda n, m: " ".join(f"w{i % m}" for i in range(n))
    texts = [None, "", " \t", words(250, 250), words(250, 100), words(250, 250) + " A" * 40, words(300, 10) + " #", "X|Y", words(199, 199), words(200, 100), "é" * 98 + "AB", "é" * 97 + "ABC", words(250, 250)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "s1"), (20, texts[3], None), (20, texts[3], None), (None, texts[3], ""), (None, "only", "s0"), (21, texts[4], ""), (-5, words(260, 260), "s0"), (22, words(260, 260), "s1")]
    return rows


LABELS = [(3, 1, 0), (3, 0, 1), (4, 1, None), (20, None, 1), (21, 1, 1), (999, 1, 1), (None, 1, 1), (22, 1, 0)]


def test_audit_equals_plain_filtering(spark):
    rows = _documents()
    docs = spark.createDataFrame([(d, t, s, 1, True, "x") for d, t, s in rows], "doc_id long, text string, source string, n int, good boolean, part string").repartition(3)
    labels = spark.createDataFrame([(*r, "y") for r in LABELS], "doc_id long, quality int, toxic int, part string")
    got = A.filter_interactions(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == _audit(rows, LABELS)


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame(_documents()[:4], "doc_id long, text string, source string")
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert A.filter_interactions(docs.limit(0), labels).count() == 0
    assert A.filter_interactions(docs, labels.limit(0)).agg({"good_lost": "max", "toxic_lost": "max"}).collect()[0][0] == 0


def test_copies_are_few_rows_before_they_meet(spark):
    """A text that most rows share, in many partitions: the digests' exchange gets a row per task and source at most."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, concat('own ', id), 'shared') as text", "'s' as source").repartition(6)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    cells = {r.mask: r.n for r in A.failures(docs, labels).where("n > 0").collect()}
    assert cells == {1: 1001, 17: 1999}


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_give_shapley_values(n):
    rng = np.random.default_rng(n)
    value = {frozenset(s): int(rng.integers(0, 1000)) for k in range(n + 1) for s in combinations(range(n), k)}
    value[frozenset()] = 0
    rows, last, whole = A.shapley_solution(n)
    kernel = lambda s: Fraction(n - 1, math.comb(n, s) * s * (n - s))
    b = [sum(kernel(len(s)) * v for s, v in value.items() if j in s and len(s) < n) for j in range(n)]
    for i in range(n):
        plain = Fraction(sum(value[frozenset(o[: o.index(i) + 1])] - value[frozenset(o[: o.index(i)])] for o in permutations(range(n))), factorial(n))
        assert (sum(r * x for r, x in zip(rows[i], b, strict=True)) + last[i] * value[frozenset(range(n))]) / whole == plain


def _plain_nearest(x, c):
    out = []
    for v in x.tolist():
        d = [sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) for w in c.tolist()]
        out.append((d.index(min(d)), min(d)))
    return out


@pytest.mark.parametrize(("low", "high", "k", "width"), [(-3, 3, 16, 4), (-64, 64, 16, 64), (0, 1, 5, 3), (-(1 << 40), 1 << 40, 7, 5), (-9, 9, 1, 2)])
def test_threshold_algorithm_is_exact(low, high, k, width):
    rng = np.random.default_rng(1)
    x, c = rng.integers(low, high, (200, width)), rng.integers(low, high, (k, width))
    number, distance = C.nearest(np.concatenate([x, c]), c)
    assert list(zip(number.tolist(), [int(d) for d in distance], strict=True)) == _plain_nearest(np.concatenate([x, c]), c)


def test_threshold_algorithm_stops_early(monkeypatch):
    """Centroids far apart: a vector close to one of them doesn't walk the lists to their ends."""
    c = np.arange(16)[:, None] * 1000 + np.zeros(8, np.int64)
    steps = []
    argmin = np.minimum
    monkeypatch.setattr(np, "minimum", lambda a, b, **k: steps.append(1) or argmin(a, b, **k))
    C.nearest(c + 1, c)
    assert len(steps) <= 4  # two calls a step, two steps of sixteen


def _plain_clusters(rows, clusters, rounds):
    rows = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), k) for k, w in enumerate(c)) for _, v in rows]
        if turn < rounds:
            for k in range(len(c)):
                own = [v for (_, v), (_, n) in zip(rows, near, strict=True) if n == k]
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[k]
    inertia = {k: sum(d for d, n in near if n == k) for k in range(len(c))}
    return [(i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(rows, near, strict=True)]


def _embeddings(n):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(i % 5, 1, 64).astype(np.float32)]) for i in range(n)]
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None, *[1.0] * 63]), (905, [math.nan, *[1.0] * 63]), (906, [math.inf, *[1.0] * 63]), (None, [0.5] * 64), (907, [-0.01] * 64), (907, [-0.01] * 64), (3, rows[3][1] if n > 3 else [2.0] * 64)]
    return rows + odd


@pytest.mark.parametrize("n", [0, 150])
def test_clusters_equal_plain_rounds(spark, n):
    rows = _embeddings(n)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, cluster int, q int").repartition(4)
    got = C.cluster_vectors(df)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain_clusters(rows, 16, 3), key=key)


def test_clusters_of_an_empty_table_and_of_large_values(spark):
    df = spark.createDataFrame(_embeddings(5), "vec_id long, embedding array<float>")
    empty = C.cluster_vectors(df.limit(0))
    assert empty.count() == 0 and empty.columns == C.cluster_vectors(df).columns
    large = spark.createDataFrame([(1, [1e12] * 64), (2, [-1e12] * 64), (3, [0.0] * 64)], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.distance) for r in C.cluster_vectors(large, clusters=3).collect()} == {(1, 0), (2, 0), (3, 0)}
    assert all(r.distance is None and r.inertia is None for r in C.cluster_vectors(large, clusters=1, rounds=0).where("distance is null").collect())
