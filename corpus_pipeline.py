"""Corpus pipeline: language ID, near-duplicate removal, decontamination, secret redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before kept. What a stage does with
null, empty and very long texts, ties, repeated rows, empty tables and further columns is what its operator states; in
short: documents without a letter go in the first stage, so later ones see only texts, and columns with names that begin
with an underscore must not be there.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from tradeloom.llm.decontaminate import decontaminate
from tradeloom.llm.langid import keep_identified
from tradeloom.llm.ngram_join import one_of_each_group
from tradeloom.llm.packing import pack
from tradeloom.llm.queries import tokenizer_path
from tradeloom.llm.secrets import redact
from tradeloom.llm.shared import checkpoint_folder, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model learns from these documents. Null, empty and letterless texts go.

    Without any label nothing can be told and nothing is left. Repeated rows stay or go together; an empty table stays empty.
    """
    small_batches(spark)
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id; rows without a doc_id stay.

    Repeated rows (one doc_id, one text) become one; null and wordless texts stay; an empty table stays empty.
    """
    small_batches(spark)
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark text; null and wordless ones stay, repeated rows stay or go
    together. An empty benchmark keeps all.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark, and n_chars with them; null texts stay null."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens; a null text is an empty one (one token)."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: Models and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written as Parquet to the shared folder and read again.

    The folder is new for each run and stays: the result is read from it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(checkpoint_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
