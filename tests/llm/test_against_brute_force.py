"""Operators on word windows and counts against plain Python, on odd rows and on the smallest given table."""

import random
import time

import numpy as np
import pytest

from tests.llm import brute
from tradeloom.llm import decontaminate as D
from tradeloom.llm import ngram_join as N
from tradeloom.llm import quality as Q
from tradeloom.llm import substring_dedup as S
from tradeloom.llm import words as W


def key(row):
    return tuple((v is None, str(v)) for v in row)


def rows(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=key)


def known(corpus):
    return [(d, t) for d, t in corpus if d is not None]


@pytest.fixture
def small_slices(monkeypatch):
    """Slices of a few texts, so that equal texts and passages lie in several."""
    monkeypatch.setattr(W.slices, "__defaults__", ("text", 2000))
    monkeypatch.setattr(W, "WIDE_BYTES", 2000)


@pytest.mark.parametrize("tree", [512, 2])
def test_ngram_components(spark, docs, corpus, monkeypatch, tree):
    monkeypatch.setattr(N, "TREE", tree)
    got = rows(N.ngram_jaccard(docs.where("doc_id is not null")), 3)
    assert got == sorted(brute.ngram_components(known(corpus)), key=key)


def test_ngram_null_ids_empty_and_stage(spark, docs, empty, corpus):
    assert N.ngram_jaccard(empty).count() == 0
    got = N.ngram_jaccard(docs)
    assert got.count() == len(corpus)
    kept = N.one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = {d for d, n, c in brute.ngram_components(known(corpus)) if d == c or not n} | {None}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_large_group_of_near_copies_in_small_trees(spark, monkeypatch):
    """A block far larger than a tree, a part of it linked only through others."""
    monkeypatch.setattr(N, "TREE", 8)
    base = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(base[: i % 12] + [f"x{i}"] * (i % 3) + base[i % 12 :])) for i in range(150)]
    data += [(1000 + i, " ".join(base[i * 2 :] + [f"y{i}_{j}" for j in range(i * 2)])) for i in range(15)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(N.ngram_jaccard(df), 3) == sorted(brute.ngram_components(data), key=key)


def test_substrings(spark, docs, corpus, small_slices):
    docs = docs.where("doc_id is not null")
    assert rows(S.dedup_substrings(docs), 4) == sorted(brute.substring_dedup(known(corpus)), key=key)


def test_substrings_need_whole_numbers_as_ids(docs):
    with pytest.raises(TypeError):
        S.dedup_substrings(docs.withColumn("doc_id", docs["doc_id"].cast("string")))


def test_substring_spans_and_texts(spark, docs, empty):
    assert S.dedup_substrings(empty).count() == 0
    for r in S.dedup_substrings(docs, with_text=True).collect():
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert len(r.kept_text.split()) == r.n_words - r.n_removed


def items(corpus):
    texts = dict(known(corpus))
    return [(1, texts[500]), (2, " ".join(texts[1].split()[:9])), (3, "¿?"), (4, None), (11, texts[606][:300]), (2, "eins zwei"), (5, texts[606][:300])]


def test_decontamination(spark, docs, empty, corpus, small_slices, monkeypatch):
    bench = spark.createDataFrame(items(corpus), "item_id long, text string")
    want = sorted(brute.decontaminate(corpus, items(corpus)), key=key)
    assert rows(D.contamination(docs, bench), 6) == want
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)  # several blocks of test texts
    assert rows(D.contamination(docs, bench), 6) == want
    assert D.contamination(empty, bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    want_matches = sorted(brute.verbatim_matches(corpus, items(corpus)), key=key)
    for bound, pairs in ((500, 1 << 20), (8 << 20, 1 << 20), (8 << 20, 0), (500, 3)):
        monkeypatch.setattr(D, "BLOCK_BYTES", bound)
        monkeypatch.setattr(D, "PAIRS", pairs)
        assert rows(D.contamination(docs, bench), 6) == want
        assert rows(D.verbatim_matches(docs, bench), 5) == want_matches and want_matches
    assert D.verbatim_matches(empty, bench).count() == 0 and D.verbatim_matches(docs, bench.limit(0)).count() == 0
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not r[5] for r in want)


@pytest.mark.parametrize("pairs", [0, 5, 1 << 20])
def test_decontamination_of_repeats(spark, monkeypatch, pairs):
    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = random.Random(6)
    text = lambda n, k: " ".join(rng.choices("abcdef"[:k], k=n))
    texts = [(i, text(rng.randint(0, 60), rng.choice([1, 2, 3]))) for i in range(40)]
    tests = [(i, text(rng.choice([1, 5, 12, 13, 14, 30]), rng.choice([1, 2, 3]))) for i in range(12)]
    tests += [(3, tests[5][1]), (90, None), (91, "")]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2), spark.createDataFrame(tests, "item_id long, text string")
    assert rows(D.contamination(docs, bench), 6) == sorted(brute.decontaminate(texts, tests), key=key)
    want = sorted(brute.verbatim_matches(texts, tests), key=key)
    assert rows(D.verbatim_matches(docs, bench), 5) == want and len(want) > 100
    longest = {d: max((m[2] for m in want if m[0] == d), default=0) for d, _ in texts}
    assert {r.doc_id: r.longest_match for r in D.contamination(docs, bench).collect()} == longest


def test_one_word_half_a_million_times():
    array = D.SuffixArray(np.full(500_000, 7, np.uint64), np.array([0, 500_000]), 13)
    tests = D.Tests(np.concatenate([np.full(1000, 7, np.uint64), np.zeros(13, np.uint64)]), np.arange(988), np.full(988, 13), np.zeros(988, np.int64), np.zeros(1, np.int64), ["i"])
    began = time.monotonic()
    found = array.search(tests)
    assert array.covered(tests, found).sum() == 500_000 and [x.tolist() for x in array.holders(tests, found)] == [[0], [0]]
    lengths = np.concatenate([words for _, words, _, _ in array.runs(tests, found)])
    assert lengths.max() == 1000 and len(lengths) == 500_000 - 12 + 988 - 1 and time.monotonic() - began < 60


def test_quality_counts(spark, docs, empty, corpus, small_slices):
    assert rows(Q.quality_rules(docs), 7) == sorted(brute.quality(corpus), key=key)
    assert Q.quality_rules(empty).count() == 0


def test_quality_verdicts_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = Q.quality_rules(docs, with_text=True).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    assert judged.where("quality = 0 and kept").count() == 0
    assert judged.where("quality = 1 and not base_failed and not kept").count() == 0
    lines = ["Plain words stand here and end well.", "Home | News | About | Contact", "BUY NOW THIS GREAT OFFER TODAY", "All rights reserved. Cookie policy."]
    r = Q.quality_rules(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), with_text=True).first()
    assert r.clean_text == lines[0] and r.n_lines_failed == 3
    menu = ["Home", "About us", "Contact", "", "Our team", "A sentence stands here.", "Notes", "More", "http://a.b/c http://d.e/f see", "Text.", "Tous droits réservés"]
    r = Q.quality_rules(spark.createDataFrame([(1, "\n".join(menu))], "doc_id long, text string"), with_text=True).first()
    assert r.clean_text == "\nA sentence stands here.\nNotes\nMore\nText."


PROSE = ["Plain words stand here and they end well for all who read them." for _ in range(9)]
KEPT = {
    "chinese": ["我们今天去了河边看见很多人。", "他说：“明天还会下雨吗？”", "孩子们在树下玩耍，", "老人坐在门前的长椅上……"] * 15,
    "thai": ["เด็กนักเรียนทั้งหมดเดินทางไปโรงเรียนด้วยรถโดยสารประจำทางทุกวัน"] * 2 + [f"ประชาชนจำนวนมากเดินทางไปเที่ยวทะเลในวันหยุดสุดสัปดาห์ที่ผ่านมา{i}" for i in range(60)],
    "german": ["Er sagte: „Nein.“", "Sie fragte: »Warum?«", "„Komm jetzt!“", "(Er ging.)"] * 20,
    "english": ['He said, "No."', "‘Why not?’", '"Stop!" "Go!"', "[She left.]"] * 20,
    "poem": [f"still water {w}" for w in "runs deep under old stone walls where no wind ever came to call the birds home at dusk again".split()],
    "poem within prose": [*PROSE, *[f"still water {w}" for w in "runs deep under stone".split()], *PROSE],
}


@pytest.mark.parametrize("name", KEPT)
def test_short_lines_of_prose_are_no_menu(spark, name):
    r = Q.quality_rules(spark.createDataFrame([(1, "\n".join(KEPT[name]))], "doc_id long, text string"), with_text=True).first()
    assert r.n_lines_failed == 0 and r.clean_text == "\n".join(KEPT[name])


def test_menus_at_an_edge_repeated_or_of_links_go(spark):
    menu = ["Home", "About us", "Contact (new)", "关于我们"]
    links = ["one http://a.b", "two http://c.d", "three http://e.f", "four"]
    texts = [[*menu, *PROSE], [*PROSE, *menu], [*PROSE, *menu, *PROSE, *menu, *PROSE], [*PROSE, *links, *PROSE]]
    got = Q.quality_rules(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), with_text=True).collect()
    for r in got:
        assert r.clean_text == "\n".join(x for x in texts[r.doc_id] if x in PROSE)


def test_line_rules_equal_their_sql(spark, tmp_path):
    import duckdb

    from tradeloom.llm.queries import SQL

    rng = random.Random(4)
    pool = ["Home", "About us", "关于我们", "他说。”", '"', "”)", "A b.", "x http://y", "", " \t", "Plain words stand here and end well.", "é…", "word word word", "a b c)", "l" * 31, "l" * 30, "| a | b", "BUY NOW THIS GREAT OFFER", "news\x0bitems"]
    texts = [(i, "\n".join(rng.choices(pool[: rng.randint(3, len(pool))], k=rng.randint(0, 25)))) for i in range(600)] + [(900, None), (901, "")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(f"SELECT {', '.join(Q.quality_rules(docs).columns)} FROM ({SQL['op9_quality_rules']})").fetchall()
    assert sorted(want) == sorted(tuple(r) for r in Q.quality_rules(docs).collect())
    assert sum(r[-1] for r in want) > 500


@pytest.mark.parametrize("limit", [40, 300, 1 << 20])
def test_neighbours_dont_change_a_verdict(spark, monkeypatch, limit):
    texts = ["see our privacy ", "policy of the house", "http:", "//x.y http://z.w", "Home", "About", "News", "More", "all rights", " reserved", None, "", "A", "menu\nlist", "of\nitems", "| a |", "b | c"]
    texts = texts * 3 + [f"word {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(W.slices, "__defaults__", ("text", limit))
    together = {r.doc_id: tuple(r) for r in Q.quality_rules(docs, with_text=True).collect()}
    monkeypatch.setattr(W.slices, "__defaults__", ("text", 1))
    assert together == {r.doc_id: tuple(r) for r in Q.quality_rules(docs, with_text=True).collect()}


@pytest.mark.parametrize("tree,hashes,paired", [(8, 4_000_000, 0), (512, 900, 3), (3, 300, 1000)])
def test_chains_of_rare_and_common_ngrams(spark, monkeypatch, tree, hashes, paired):
    """Blocks far larger than a tree: texts chained by one n-gram each, families of near copies, an n-gram that all share."""
    monkeypatch.setattr(N, "TREE", tree)
    monkeypatch.setattr(N, "TREE_HASHES", hashes)
    monkeypatch.setattr(N, "PAIRED", paired)
    rng = random.Random(tree)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    common = [word() for _ in range(30)]
    links = [[word() for _ in range(7)] for _ in range(121)]
    rows = []
    for i in range(120):  # most n-grams of these stand elsewhere too, so they stay candidates
        body = links[i] + links[i + 1]
        rows.append((i, " ".join(body + common[: rng.choice([0, 8, 30])])))
    for f in range(12):
        base = [word() for _ in range(rng.choice([20, 40, 60]))] + common
        for c in range(rng.choice([2, 9, 25])):
            v = list(base)
            for j in rng.sample(range(len(v)), rng.randint(0, 3)):
                v[j] = word()
            rows.append((1000 + 100 * f + c, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in N.ngram_jaccard(docs).collect())
    assert got == sorted(brute.ngram_components(rows))
    assert len({c for _, _, c in got}) < len(rows)
