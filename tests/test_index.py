"""The stored index: the same answers as the plain ranking, rebuilt only where files change; passages of any length."""

import shutil
import tempfile
import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswright.functions.text import LATIN, tokens, units
from corpuswright.operators import index, lookup, retrieve
from corpuswright.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, monkeypatch):
    """The documents in 6 files, an index folder beside them, and small blocks."""
    monkeypatch.setattr(index, "BLOCK", 8)
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(6, "doc_id").write.parquet(f"{folder}/docs")
    return folder


def _refresh(spark, corpus):
    return index.refresh(spark.read.parquet(f"{corpus}/docs"), F.col("text"), LATIN, f"{corpus}/index")


def _plain(spark, docs, asked, k):
    found = retrieve.search_many(retrieve.build_index(docs, F.coalesce("text", F.lit("")), LATIN), asked, k + 20).collect()
    best = {}
    for r in sorted(found, key=lambda r: (r.query_id, -round(r.score, 7), r.doc_id)):
        best.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    return {q: v[:k] for q, v in best.items()}


def _top(found):
    best = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        best.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 6)))
    return best


def _asked(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    return items.select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"), LATIN)).alias("term"))


def test_same_answers_as_the_plain_ranking(spark, corpus):
    made, n = _refresh(spark, corpus)
    assert n == 6
    docs, asked = spark.read.parquet(f"{corpus}/docs"), _asked(spark)
    assert _top(index.top(made, asked, 5)) == _plain(spark, docs, asked, 5)
    again = index.open_index(spark, f"{corpus}/index")
    assert _top(index.top(again, asked, 2, first_blocks=1)) == _plain(spark, docs, asked, 2)


def test_only_changed_files_are_built_again(spark, corpus):
    assert [_refresh(spark, corpus)[1] for _ in range(2)] == [6, 0]
    names = sorted(p.rsplit("/", 1)[1] for p in spark.read.parquet(f"{corpus}/docs").inputFiles())
    changed = spark.read.parquet(f"{corpus}/docs/{names[0]}").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" zzchanged")))
    changed.coalesce(1).write.parquet(f"{corpus}/new")
    part = spark.read.parquet(f"{corpus}/new").inputFiles()[0].removeprefix("file://")
    shutil.copyfile(part, f"{corpus}/docs/{names[0]}")
    for p in (f"{corpus}/docs/.{names[0]}.crc",):
        shutil.os.unlink(p)
    spark.catalog.clearCache()
    made, n = _refresh(spark, corpus)
    word = spark.createDataFrame([(1, "zzchanged"), (2, "unheardofword"), (3, None)], "query_id int, term string")
    assert n == 1 and len(_top(index.top(made, word, 1000))[1]) == changed.count() and set(_top(index.top(made, word, 9))) == {1}
    shutil.os.unlink(f"{corpus}/docs/{names[0]}")  # a lost file needs nothing built
    made, n = _refresh(spark, corpus)
    docs = spark.read.parquet(f"{corpus}/docs")
    assert n == 0 and made.n_docs == docs.count() and not _top(index.top(made, word, 9))
    assert _top(index.top(made, _asked(spark), 4)) == _plain(spark, docs, _asked(spark), 4)


def test_odd_rows(spark, corpus):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Moon moon moon", "x"), (3, "moon", "y"), (None, "moon", None), (5, "word " * 3000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, term string").coalesce(1).write.parquet(f"{corpus}/odd")
    made, _ = index.refresh(spark.read.parquet(f"{corpus}/odd"), F.col("text"), LATIN, f"{corpus}/index2")
    asked = spark.createDataFrame([(1, "moon"), (1, "moon"), (2, "word")], "query_id int, term string")
    found = _top(index.top(made, asked, 10))
    assert [d for d, _ in found[1]].count(3) == 2 and None in [d for d, _ in found[1]] and [d for d, _ in found[2]] == [5]
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{corpus}/none")
    empty, n = index.refresh(spark.read.parquet(f"{corpus}/none"), F.col("text"), LATIN, f"{corpus}/index3")
    assert n == 0 and index.top(empty, asked, 3).count() == 0


def test_passages_of_any_length(spark):
    texts = {1: "The moon is up, the moon is full tonight.", 2: "Moonlight is full", 3: "", 4: None, 5: "is up the moon is full tonight and more"}
    works = spark.createDataFrame([(i, t, "k" if i < 3 else "m") for i, t in texts.items()], "doc_id long, text string, key string")
    works = works.select("doc_id", "key", units(F.col("text"), LATIN).alias("unit"))
    said = ["moon", "is", "is full", "moon is full tonight", "is up the moon is full tonight", "the moon is up the moon is full", "light", "", "full the", "moon"]
    passages = spark.createDataFrame([(s, "k") for s in said], "text string, key string").select(units(F.col("text"), LATIN).alias("passage"), "key")
    split = {i: f" {' '.join(__import__('re').findall('[a-zß-ÿ]+', (t or '').lower()))} " for i, t in texts.items()}
    want = {(s, i) for s in said if s for i, t in split.items() if f" {s} " in t}
    got = [(" ".join(r.passage), r.doc_id) for r in lookup.occurrences(works, passages).collect()]
    assert set(got) == want and len(got) == len(want)
    own = {(" ".join(r.passage), r.doc_id) for r in lookup.occurrences(works, passages, ["key"]).collect()}
    assert own == {x for x in want if x[1] < 3}
    assert lookup.occurrences(works, passages.limit(0)).count() == 0


def test_passages_by_head_and_tail(spark):
    """All parts of a text of every length, others that only share head and tail, and one word in very many places."""
    words = [f"w{i % 7}" for i in range(60)] + ["end"]
    texts = {1: words, 2: words[10:40], 3: ["a"] * 5000, 4: "h i j k x k l m n".split(), 5: []}
    works = spark.createDataFrame([*texts.items(), (None, words)], "doc_id long, unit array<string>")
    asked = [words[i : i + n] for i in (0, 3, 50) for n in (1, 2, 3, 5, 8, 11, 31)] + [["a"], ["a"] * 3, ["a"] * 4999, "h i j k l m n".split(), "k x k".split(), []]
    got = {(tuple(r.passage), r.doc_id) for r in lookup.occurrences(works, spark.createDataFrame([(p,) for p in asked], "passage array<string>")).collect()}
    holds = lambda ws, p: any(ws[i : i + len(p)] == p for i in range(len(ws) - len(p) + 1))
    assert got == {(tuple(p), d) for p in asked if p for d, ws in texts.items() if holds(ws, p)}


def test_places_of_a_common_word(spark):
    """A passage of one word takes one place from a text, not all of them."""
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "w": pa.array([[7] * 1000, [8, 7]], pa.list_(pa.int64()))})
    every = types.SimpleNamespace(value=bytes([255] * (lookup.LEAST_BITS // 8)))
    found = pa.Table.from_batches(lookup._places([0], every, lookup.LEAST_BITS)(iter([rows]))).to_pylist()
    assert [(r["doc_id"], r["pos"]) for r in found] in ([(1, 0), (2, 0), (2, 1)], [(1, 0), (2, 1), (2, 0)])


def test_ranking_in_portions(spark, corpus, monkeypatch):
    """Queries in small portions, blocks skipped from the start, scores cut as soon as they come: the same answers, from the stored
    index and from one for these queries alone."""
    for name, value in (("QUERIES", 3), ("PAIRS", 1 << 8)):
        monkeypatch.setattr(index, name, value)
    made, _ = _refresh(spark, corpus)
    docs, asked = spark.read.parquet(f"{corpus}/docs"), _asked(spark)
    want = _plain(spark, docs, asked, 5)
    assert _top(index.top(made, asked, 5, first_blocks=0)) == want
    assert _top(index.top(index.unstored(docs, F.col("text"), LATIN, asked), asked, 5)) == want
    few = asked.where("query_id < 3")
    assert _top(index.top(index.unstored(docs, F.col("text"), LATIN, few), few, 5)) == _plain(spark, docs, few, 5)


def test_null_ids_rank_last_among_equals(spark, corpus):
    rows = [(None, "moon"), (7, "moon"), (3, "moon"), (9, "stone"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{corpus}/equal")
    docs, asked = spark.read.parquet(f"{corpus}/equal"), spark.createDataFrame([(1, "moon"), (2, "unheard")], "query_id int, term string")
    for made in (index.refresh(docs, F.col("text"), LATIN, f"{corpus}/index4")[0], index.unstored(docs, F.col("text"), LATIN, asked)):
        assert made.n_docs == 5
        assert [r.doc_id for r in index.top(made, asked, 2).orderBy("rank").collect()] == [3, 7]
        assert [r.doc_id for r in index.top(made, asked, 9).orderBy("rank").collect()] == [3, 7, None]
    assert made.avg_length == 1.0  # of the texts there are


def test_parts_of_strings(spark):
    """Parts of a string at any place, also where words meet, in texts of several pieces and under one id or none."""
    texts = [(1, "abcdefghij" * 20), (2, "xabcdefghiñjß"), (2, "xabcdefghiñjß"), (None, "ghiñjß"), (4, ""), (5, None), (6, "fghi")]
    works = spark.createDataFrame(texts, "doc_id long, unit string").select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("doc_id"), "unit")
    asked = ["jabcdefghijab", "hiñj", "fghi", "ñ", "abcdefghij" * 20, "zz", ""]
    got = [(r.passage, r.doc_id.doc_id) for r in lookup.occurrences(works.coalesce(1), spark.createDataFrame([(p,) for p in asked], "passage string")).collect()]
    assert sorted(got, key=repr) == sorted(((p, d) for p in asked if p for d, t in texts if t and p in t), key=repr)


def test_letters_across_words(spark, tmp_path):
    """An item whose letters a document has with other breaks between words."""
    spark.createDataFrame([(1, "One twothree four, fi-ve six"), (2, "one two three four six")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, "onetwo three fo ur fi ve"), (11, "ne two three four")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.QUERIES["contains_verbatim_pairs"](spark, str(tmp_path))
    assert [(r.doc_id, r.item_id) for r in found.collect()] == [(1, 10)]
