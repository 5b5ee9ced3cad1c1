"""Rows without doc_id, and a doc_id used for two texts: no text vanishes, and no other row loses its work."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuswright.llm.exact_dedup import drop_exact_copies, exact_groups
from corpuswright.llm.near_dedup import keep_one_of_each, near_duplicate_classes
from corpuswright.llm.packing import pack_documents
from corpuswright.llm.substring_dedup import remove_repeats

A = "The quick brown fox jumps over the lazy dog and then it sleeps under the old tree by the river."
B = "A text that stands alone among all the others in this table of documents."
C = "Only rows without an identifier hold this passage about the harbour, the ships and the tide."
BIG = 2**53 + 1
ROWS = [(BIG, A), (BIG + 2, A), (None, A + "  "), (None, B), (None, C), (None, C), (3, "start " + C + " end"), (4, "short words")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en") for i, t in ROWS], SCHEMA).coalesce(1)


def test_exact(docs):
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_groups(docs).collect())
    assert got == [
        (0, 0, 1, True), (0, 0, 2, False), (0, 0, 2, True), (0, BIG, 3, False), (3, 3, 1, True), (4, 4, 1, True), (BIG, BIG, 3, True), (BIG + 2, BIG, 3, False),
    ]
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    want = [(None, B), (None, C), (3, "start " + C + " end"), (4, "short words"), (BIG, A)]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(i or 0, t) for i, t in want]


def test_reused_id(spark):
    docs = spark.createDataFrame([(1, A), (2, A), (2, B)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in drop_exact_copies(docs).collect()) == [(1, A), (2, B)]


def test_near(docs):
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_duplicate_classes(docs).collect())
    # C framed by two words has 14 shingles, of which C has 12
    assert got == [(0, 0), (0, 3), (0, 3), (0, BIG), (3, 3), (4, 4), (BIG, BIG), (BIG + 2, BIG)]
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 3, 4, BIG]


def test_substrings(docs):
    got = {}
    for r in remove_repeats(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.kept_sha256))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sum(map(len, got.values())) == len(ROWS)
    assert got[BIG] == [(len(A), 0, sha(A))] and got[BIG + 2] == [(len(A), len(A), sha(""))]
    assert sorted(got[None]) == sorted([(len(A) + 2, len(A), sha("  ")), (len(B), 0, sha(B)), (len(C), len(C), sha("")), (len(C), len(C), sha(""))])


def test_pipeline_keeps_the_texts(spark, docs, tmp_path):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:3]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    assert kept.where("doc_id IS NULL").count() == 1 and kept.where(F.col("text") == B).count() == 1
    assert pack_documents(kept).where("doc_id IS NULL").count() == 1
