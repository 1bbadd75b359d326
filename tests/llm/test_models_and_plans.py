"""Language ID, packing and sharding: held-out accuracy, exact code lengths, round trips, least capacity."""

import math
import pickle
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tradeloom.llm import langid as L
from tradeloom.llm import packing as P
from tradeloom.llm import sharding as H
from tradeloom.llm import words as W
from tradeloom.llm.queries import tokenizer_path


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def _bits(text, trained, least):
    """Plain PPM, method C: counts in dictionaries, escapes followed order by order."""
    counts = defaultdict(Counter)
    for t in trained:
        for i in range(len(t)):
            for k in range(min(i, L.ORDER) + 1):
                counts[t[i - k : i]][t[i]] += 1
    total = 0.0
    for i in range(len(text)):
        for k in range(min(i, L.ORDER), -1, -1):
            c = counts.get(text[i - k : i])
            if not c or k and sum(c.values()) < least:
                continue
            n, d = sum(c.values()), len(c)
            if text[i] in c:
                total -= math.log2(c[text[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def _counted(texts):
    data, offsets = W.packed(pa.array(texts))
    grams, depth = L._grams(data, offsets)
    key, n = np.unique(grams & L._mask(L.ORDER) | depth.astype(np.int64) << 48, return_counts=True)
    return key & L._mask(L.ORDER), key >> 48, n.astype(float)


@pytest.mark.parametrize("least,cells", [(1, 1 << 24), (4, 1 << 24), (1, 0), (4, 0), (4, 300)])
def test_code_lengths_are_exact(monkeypatch, least, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    rng = random.Random(2)
    trained = {n: ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(40)] for n, letters in (("x", "abc я"), ("y", "bcde "), ("z", "中文字"))}
    model = L.build_model(["x", "y", "z"], {n: _counted(texts) for n, texts in trained.items()}, least)
    tests = ["".join(rng.choices("abcdezя中 ", k=rng.randint(0, 40))) for _ in range(40)] + ["a", "", "b", "ab", "я", "\x00"]
    data, offsets = W.packed(pa.array(tests))
    for chunk in (1 << 17, 7):
        monkeypatch.setattr(L, "_CHUNK", chunk)
        got = model.bits(data, offsets)
        for i, t in enumerate(tests):
            for j, n in enumerate(("x", "y", "z")):
                assert math.isclose(got[i, j], _bits(t.encode(), [x.encode() for x in trained[n]], least), rel_tol=1e-5, abs_tol=1e-3)


def test_256_languages_have_all_orders():
    texts, names = {}, [f"l{i:03}" for i in range(256)]
    for i, name in enumerate(names):
        rng = random.Random(i)
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(400)]
        texts[name] = [" ".join(rng.choices(words, k=200)) for _ in range(6)]
    model = L.build_model(names, {n: _counted(t[:5]) for n, t in texts.items()})
    assert len(model.grams) + len(model.further) == L.ORDER + 1 and model.further
    asked = [texts[n][5] for n in names[::16]]
    data, offsets = W.packed(pa.array(asked))
    got = model.bits(data, offsets)
    assert (got.argmin(1) == np.arange(256)[::16]).all()
    for i, t in enumerate(asked[:3]):
        for j in (0, 16, 100, 255):
            assert math.isclose(got[i, j], _bits(t.encode(), [x.encode() for x in texts[names[j]][:5]], L.LEAST), rel_tol=1e-5)
    assert len(pickle.dumps(model)) < 200 << 20


def test_scripts_with_the_same_lead_bytes_are_told_apart(spark):
    rng = random.Random(3)
    words = {"ru": "это был один большой дом на берегу реки где жили люди".split(), "uk": "це був один великий будинок на березі річки де жили люди її".split(), "el": "αυτό ήταν ένα μεγάλο σπίτι στην όχθη του ποταμού".split(), "zh": "这是 河边 一座 大 房子 人们 住在 那里".split(), "ja": "これは 川辺 の 大きな 家 で 人々 が 住んで いた".split(), "EN": "this was a large house by the river where people lived".split()}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(sorted(words) * 60)]
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {d: x for d, _, x in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got) and sum(r.held_out for r in got) > 40


def test_language_of_odd_rows(spark, docs, empty):
    labelled = docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'a', null) as lang")
    got = L.identify(labelled).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert L.identify(labelled.limit(0)).count() == 0
    assert {(r.lang_pred, r.score) for r in L.identify(labelled.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {("und", 0.0)}
    assert L.keep_identified(labelled).columns == labelled.columns


ODD = ["a <|endoftext|> b<|startoftext|>c", "A<|ENDOFTEXT|>, B<|startoftext|>.", "e ́ f", "\x1c q\x1dr", "I'm don't 's x's.", "İstanbul ΑΣ ΑΣ. ς", "가 ᄀ ᅡ", "x　y", "x ̸=", "a\x00b \x0b c", "... a.b,,c!!! (x). É. ×. 5), .́", "x...'s 12,5. ’tis”, “so”."]


def test_packing_is_a_round_trip(spark, docs, empty, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    more = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(more).repartition(3)
    pieces = P.pack(all_docs, path, size=512, windows=4, merge_partitions=2).collect()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for d, t in [*corpus, *((2000 + i, t) for i, t in enumerate(ODD))]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for at in range(0, len(ids), 512):
            cut = ids[at : at + 512]
            want[d, at, len(cut), zlib.crc32(cut.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert P.pack(empty, path).count() == 0


def test_packing_leaves_little_padding(spark):
    pieces = P.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path())
    used, n = pieces.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used > 0.97 * 4096 * n


def _least(sizes, shards):
    """Smallest capacity by plain dynamic programming."""
    best = {0: 0}
    total = np.concatenate([[0], np.cumsum(sizes)])
    now = [0] + [math.inf] * len(sizes)
    for _ in range(shards):
        now = [min(max(now[j], total[i] - total[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    del best
    return now[-1]


@pytest.mark.parametrize("bits,shards", [(2, 3), (4, 5), (1, 7), (14, 24)])
def test_least_capacity_is_found(spark, monkeypatch, bits, shards):
    monkeypatch.setattr(H, "FIRST_BITS", bits)
    monkeypatch.setattr(H, "STEP_BITS", 3)
    rng = random.Random(bits)
    groups = sorted((rng.getrandbits(64) - (1 << 63), rng.choice([1, 5, 9, 40])) for _ in range(60))
    capacity, starts = H.boundaries(spark.createDataFrame(groups, "key long, size long"), shards)
    assert capacity == _least([s for _, s in groups], shards)
    loads = Counter(sum(k >= s for s in starts) for k, _ in groups)
    assert len(loads) <= shards
    assert max(sum(s for k, s in groups if sum(k >= x for x in starts) == i) for i in loads) <= capacity


@pytest.mark.parametrize("share", [1 / 3, 0.95 / 24])
def test_few_cells_are_counted_again_beside_a_large_group(spark, monkeypatch, share):
    rows = spark.range(40000).selectExpr("xxhash64(id) AS key", "100 + id % 57 AS size")
    total = rows.selectExpr("sum(size)").first()[0]
    hot = int(total * share / (1 - share))
    groups = rows.selectExpr("key", f"if(key = xxhash64(77L), {hot}, size) AS size").localCheckpoint()
    sent, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (sent.append(len(data)), make(self, data, *a, **k))[1])
    capacity, starts = H.boundaries(groups, 24)
    assert max(sent, default=0) <= 256
    loads = Counter()
    for r in groups.collect():
        loads[sum(r.key >= s for s in starts)] += r["size"]
    assert len(loads) <= 24 and max(loads.values()) == capacity
    assert share < 1 / 24 or capacity == hot  # the hot group alone is the bound


def test_shards(spark, docs, empty, corpus):
    got = H.minimax_shards(docs, 24).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in corpus)
    slots, shard_of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    assert H.minimax_shards(empty, 24).count() == 0


@pytest.mark.parametrize("copies", [1, 2])
def test_large_groups_leave_no_shard_empty_and_the_rest_even(spark, copies):
    texts = [f"text {i} " * (1 + i % 9) for i in range(3000)]
    total = sum(len(t) + 8 for t in texts)
    for c in range(copies):  # each holds a third or a fourth of the bytes
        hot = f"hot {c} " * 50
        texts += [hot] * (total // 2 // (len(hot) + 8))
    got = H.minimax_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 24).collect()
    load, of, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        of[texts[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and all(len(s) == 1 for s in of.values())
    assert sorted(load) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = sorted(load.values())[: 24 - copies]
    assert rest[-1] < 1.05 * rest[0]
    assert max(load.values()) == (len(hot) + 8) * texts.count(hot)


def test_even_cuts_stay_within_the_least_capacity():
    rng = random.Random(7)
    for _ in range(300):
        n, shards = rng.randint(1, 25), rng.randint(1, 9)
        cells = [(i, i, rng.choice([1, 2, 5, 9, 30]), 1, 64) for i in range(n)]
        capacity, starts = H.search(cells, max(c[2] for c in cells), shards, None)
        loads = Counter()
        for c in cells:
            loads[sum(c[0] >= s for s in starts)] += c[2]
        assert capacity == max(loads.values()) == _least([c[2] for c in cells], shards)
        assert len(loads) == min(n, shards)
