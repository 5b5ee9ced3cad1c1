"""Queries without SQL on all their rows against plain Python, and what only shows at a certain size."""

import math
import re
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuswright.llm import decontaminate, exact_dedup, near_dedup, queries, substring_dedup, token_counts
from corpuswright.llm.common import read_table
from corpuswright.llm.decontaminate import Items, greedy_tiles, tile_words
from corpuswright.llm.packing import OPEN_BINS, arrival_order, best_fit, place_pieces
from test_brute_force import SF, _segment


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def test_token_counts_of_all_documents(spark, documents):
    path = public_tokenizers.path(token_counts.MODEL)
    scores, longest, byte = token_counts.unigram_pieces(path)
    known = {}
    rows = queries.op3_token_counts(spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows[::7]:  # every word of these texts, each segmented by itself
        words = documents[r.doc_id].split()
        for w in set(words) - known.keys():
            known[w] = _segment("▁" + w, scores, byte) if len(w) < 60 else token_counts.trie_counts(["▁" + w], path)["▁" + w][::-1]
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(known[w][1] for w in words))
        assert math.isclose(r.log_prob, sum(known[w][0] for w in words), rel_tol=1e-9, abs_tol=1e-9)


def test_token_caches_of_two_models():
    token_counts.known_counts({"the", "thematic"}, public_tokenizers.path(token_counts.MODEL))
    with pytest.raises(Exception):
        token_counts.known_counts({"the"}, "no such model")


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _longest(item, text, least):
    """The first longest run of two lists of numbers in which -1 and -2 mark what is taken: (length, place, place)."""
    best, row = (least - 1, 0, 0), np.zeros(len(text) + 1, np.int64)
    for p, w in enumerate(item):
        row[1:] = np.where(text == w, row[:-1] + 1, 0)
        k = int(row.max())
        if k > best[0]:
            best = (k, p - k + 1, int(row.argmax()) - k)
    return best


def test_contamination_of_all_documents(spark, documents):
    items = {i: _words(t or "") for i, t in duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()}
    number, want = {}, {}
    grams = {}
    for i, ws in items.items():
        for k in range(len(ws) - 4):
            grams.setdefault(tuple(ws[k : k + 5]), set()).add(i)
    for d, text in documents.items():
        ws = _words(text)
        near = set().union(*(grams.get(tuple(ws[k : k + 5]), ()) for k in range(len(ws) - 4)))
        for i in near:
            a = np.array([number.setdefault(w, len(number)) for w in items[i]])
            b = np.array([number.setdefault(w, len(number)) for w in ws])
            covered = n = 0
            while (found := _longest(a, b, 5))[0] >= 5:
                k, p, t = found
                a[p : p + k], b[t : t + k] = -1, -2
                covered, n = covered + k, n + 1
            if covered >= 0.5 * len(a):
                want[d, i] = (covered, n)
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_tiles) for r in queries.op4_decontamination(spark, SF).collect()}
    assert got == want and len(want) >= 3


def test_benchmark_in_blocks(spark):
    docs, items = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert sorted(map(tuple, decontaminate.contaminated(docs, items, block_chars=4000).collect())) == whole
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, items, block_chars=4000).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {w[0] for w in whole}


def test_open_bins_bind_and_cost_little():
    rnd = np.random.default_rng(1)
    lengths = np.minimum(4096, rnd.exponential(900, 9000).astype(int) + 1)
    order = arrival_order(rnd.permutation(len(lengths)), lengths)
    assert sorted(order) == list(range(len(lengths)))
    bins, _ = best_fit(lengths[order].tolist(), 4096, OPEN_BINS)
    free, _ = best_fit(lengths[order].tolist(), 4096, 10**9)
    used, n_open, most = {}, set(), 0
    for b, n in zip(free, lengths[order].tolist()):
        used[b] = used.get(b, 0) + n
        (n_open.discard if used[b] == 4096 else n_open.add)(b)
        most = max(most, len(n_open))
    assert most > 2 * OPEN_BINS  # without the bound; so bins do close
    assert len(set(bins)) <= 1.003 * (lengths.sum() // 4096 + 1)


def test_packing_of_many_empty_texts(spark, monkeypatch):
    monkeypatch.setattr("corpuswright.llm.packing.GROUP_ROWS", 500)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("int").alias("piece"), F.lit(1).cast("long").alias("length"))
    placed = place_pieces(rows)
    assert placed.count() == 3000 and placed.select((F.col("sequence_id") / F.lit(1 << 40)).cast("long")).distinct().count() == 6


@pytest.mark.parametrize("max_cells", [1 << 28, 1 << 16])
def test_exact_groups_range_by_range(spark, monkeypatch, max_cells):
    texts = [(i, f"text {zlib.crc32(str(i % 20_000).encode())}") for i in range(30_000)] + [(40_000 + i, "hot  text") for i in range(5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, max_cells=max_cells).collect()}
    assert got == {i: (i % 20_000, 2 if i % 20_000 < 10_000 else 1) for i in range(30_000)} | {40_000 + i: (40_000, 5000) for i in range(5000)}
    kept = exact_dedup.drop_exact_copies(docs, max_cells=max_cells)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20_000), 40_000]


def test_one_row_of_a_repeated_id(spark):
    a, b = (f"{x} brown fox jumps over the lazy dog and then it sleeps" for x in ("the quick", "no slow"))
    docs = spark.createDataFrame([(2, a), (2, a), (3, b), (3, b), (1, "alone")], "doc_id long, text string")
    for f in (exact_dedup.drop_exact_copies, near_dedup.keep_one_of_each):
        assert sorted(r.doc_id for r in f(docs).collect()) == [1, 2, 3]


def test_toxicity_on_the_held_out_fold(spark):
    """Area under the curve and accuracy on rows that neither the fit nor the landmarks have seen."""
    sf = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").fetchall())
    rows = [(r.score, toxic[r.doc_id], r.predicted) for r in queries.op10_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    good, bad = ([s for s, t, _ in rows if t == k] for k in (0, 1))
    area = sum((x > y) + 0.5 * (x == y) for x in bad for y in good) / (len(good) * len(bad))
    right = sum(t == p for _, t, p in rows) / len(rows)
    print("held out", len(rows), "toxic", len(bad), "AUC", round(area, 4), "accuracy", round(right, 4))
    assert len(bad) > 50 and area > 0.94 and right > 0.96


def test_packing_of_rows_without_id(spark):
    """Rows without doc_id, all alike, do not share one group."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("int").alias("piece"), F.lit(7).cast("long").alias("length"))
    placed = place_pieces(rows, capacity=100, group_tokens=2000).toPandas()
    assert len(placed) == 3000 and (placed["sequence_id"] // (1 << 40)).value_counts().max() < 600
    for _, s in placed.groupby("sequence_id"):
        assert sorted(s["offset"]) == list(range(0, 7 * len(s), 7)) and 7 * len(s) <= 100


def test_tiles_of_one_repeated_word_take_little_time():
    begun = time.monotonic()
    assert sum(n for _, _, n in greedy_tiles([7] * 2000 + [8], [7] * 8000, 5)) == 2000
    assert time.monotonic() - begun < 5


def test_a_seed_of_very_many_items():
    opening = "which of the following statements about"
    items = Items(list(range(20_000)), [f"{opening} {i} {i + 1} {i + 2} {i + 3} {i + 4} {i + 5}" for i in range(20_000)])
    text = f"{opening} 77 78 79 80 81 82 " + f"{opening} nothing " * 500
    begun = time.monotonic()
    got = items.matches(tile_words(pa.array([text]))[0], 0.95)
    assert [(i, c) for i, c, _, _ in got] == [(77, 1.0)] and time.monotonic() - begun < 20


def test_splitters_grow_with_the_buckets(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 256) for k in range(4)]).alias("text"))
    assert len(substring_dedup._splitters(rows, 4000, 4000, 50, 16)) > 2 * len(substring_dedup._splitters(rows, 4000, 500, 50, 16))
