"""The pipeline's stages, each against plain Python on its own input."""

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_secrets import base
from tradeloom.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input rows, output rows, columns) of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns_and_names(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for _, _, before, after in stages[:-1]:
        assert before == after


def test_language_stage_keeps_documents_with_letters(stages):
    before, after, *_ = stages[0]
    kept = {r.doc_id for r in after}
    assert all(r.doc_id in kept for r in before if any(c.isalpha() for c in r.text or "") and len(r.text.split()) > 3)


def test_near_duplicate_stage(stages):
    before, after, *_ = stages[1]
    want = sorted(d for d, n, c in brute.ngram_components([(r.doc_id, r.text) for r in before]) if d == c or not n)
    assert sorted(r.doc_id for r in after) == want


def test_decontamination_stage(spark, stages):
    before, after, *_ = stages[2]
    bench = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(r[0] for r in brute.decontaminate([(r.doc_id, r.text) for r in before], bench) if not r[5])
    assert sorted(r.doc_id for r in after) == want


def test_secret_stage_redacts_and_keeps_the_rest(stages):
    before, after, *_ = stages[3]
    texts = {r.doc_id: r.text for r in after}
    assert len(texts) == len(before)
    for r in before:
        if not base(r.text):
            assert texts[r.doc_id] == r.text
        else:
            assert not base(texts[r.doc_id]) and "[SECRET]" in texts[r.doc_id]


def test_packing_stage_holds_every_document(stages):
    before, after, *_ = stages[4]
    total = {}
    for r in after:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.length <= 4096
    assert total == {r.doc_id: r.doc_tokens for r in after} and set(total) == {r.doc_id for r in before}


def test_run_equals_the_stages(spark, stages):
    pieces = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(corpus_pipeline.run(spark, FOLDER).collect()) == pieces(stages[-1][1])


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in QUERIES}
    assert names == {f"op{i}" for i in range(1, 14)} and set(SQL) <= set(QUERIES)
    assert "pipeline" in corpus_pipeline.QUERIES


def test_stages_on_odd_rows(spark):
    """Null and empty texts, repeated rows and clashing columns through the first four stages, and empty tables."""
    text = "the house by the river was large and the people who lived there were kind to all who came by"
    rows = [(1, text, "en", 7, "x"), (1, text, "en", 7, "x"), (2, None, "en", 7, None), (3, "", None, 0, ""), (4, " 12 34 ", "en", 7, "y"), (5, text + " token=abcdefgh12345", "en", 7, "z"), (6, text.upper(), None, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, class string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
    kept = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 5, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()) == [1, 2, 3, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.decontamination(spark, docs, FOLDER).collect()) == [1, 1, 2, 3, 4, 5, 6]
    clean = {r.doc_id: r for r in corpus_pipeline.secret_scans(spark, docs, FOLDER).collect()}
    assert clean[5].text == text + " [SECRET]" and clean[5].n_chars == len(clean[5].text) and clean[2].text is None
    assert sum(r.length for r in corpus_pipeline.packing(spark, docs.where("doc_id in (2, 3)"), FOLDER).collect()) == 2
