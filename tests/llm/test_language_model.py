"""The language model against plain Python: on all rows of the query, at other orders and sizes, and on odd texts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from corpuswright.llm import language_model, queries
from test_brute_force import SF

FALL = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _tokens(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FALL)) if w] + [None]


def _plain(train, order):
    """Probability of the last word of a tuple, and counts of tokens, by the definition."""
    adjusted = {k: Counter() for k in range(1, order + 1)}
    for words in train:
        s = [0, *words]
        for j in range(1, len(s)):
            k = min(order, j + 1)
            adjusted[k][tuple(s[j - k + 1 : j + 1])] += 1
    for k in range(order - 1, 0, -1):
        adjusted[k].update(g[1:] for g in adjusted[k + 1])
    discounts, after = {}, {k: defaultdict(list) for k in adjusted}
    for k, found in adjusted.items():
        n = [sum(v == i for v in found.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        known = [n[0] and n[1], n[0] and n[1] and n[2], n[0] and n[1] and n[2] and n[3]]
        formula = [1 - 2 * y * n[1] / max(n[0], 1), 2 - 3 * y * n[2] / max(n[1], 1), 3 - 4 * y * n[3] / max(n[2], 1)]
        discounts[k] = [0, *(min(max(f if ok else other, 0), c) for f, ok, other, c in zip(formula, known, (0.5, 1, 1.5), (1, 2, 3)))]
        for g, v in found.items():
            after[k][g[:-1]].append(v)
    sums = {k: {h: (sum(v), sum(discounts[k][min(x, 3)] for x in v)) for h, v in after[k].items()} for k in after}
    vocabulary = len({w for words in train for w in words})

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / (vocabulary + 1)
        if g[:-1] not in sums[k]:
            return lower
        total, left = sums[k][g[:-1]]
        c = adjusted[k].get(g, 0)
        return (c - discounts[k][min(c, 3)]) / total + left / total * lower

    return p, Counter(w for words in train for w in words)


def _same(rows, texts, train, order):
    p, counts = _plain(train, order)
    n, v = counts.total(), len(counts)
    for doc_id, text in texts.items():
        words, r = _tokens(text), rows[doc_id]
        s = [0, *words]
        want = sum(math.log10(p(tuple(s[max(0, j - order + 1) : j + 1]))) for j in range(1, len(s)))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r.score, want, rel_tol=1e-9) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-want / len(words)), rel_tol=1e-9)


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


def _learnt(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 != 2


def test_all_documents(spark, documents):
    rows = {r.doc_id: r for r in queries.op11_lm_scores(spark, SF).collect()}
    assert rows.keys() == documents.keys() and all(r.held_out != _learnt(i) for i, r in rows.items())
    _same(rows, documents, [_tokens(t) for i, t in documents.items() if _learnt(i)], language_model.ORDER)


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 20_000, "fan": 4, "portion": 20_000}])
def test_trigrams_in_few_and_many_buckets(spark, documents, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_model.fit(docs, 3, **sizes)
    rows = {r.doc_id: r for r in language_model.score(docs, model).collect()}
    _same(rows, documents, [_tokens(t) for t in documents.values()], 3)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "a b a c a b d"), (2, "b a b c"), (3, "c")], "doc_id long, text string")
    model = language_model.fit(docs, 3)
    look = language_model.Lookup(model)
    words = language_model.word_hashes(np.frombuffer(b"a b c d new", np.uint8), np.array([0, 11]))[0]
    last = np.r_[words, [language_model.END]]
    for first, second in [(language_model.BEGIN, words[0]), (words[0], words[1]), (words[4], words[3]), (words[4], words[4])]:
        n = len(last)
        p = look.probabilities(last, np.full(n, 2), [np.full(n, second), np.full(n, first)])
        assert math.isclose(p.sum(), 1, rel_tol=1e-12)


def test_odd_rows(spark):
    long = "Über  The\tend\n" * 20_000 + "x" * 3_000_000
    texts = {1: None, 2: "", 3: " \n", 4: long, 5: "the END", 6: "the end", 7: "  a\x0bb", 8: "the end", 9: "a b c a b a"}
    rows = [(i, t, "extra") for i, t in texts.items()] + [(6, "the end", None), (None, "the end", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string")
    model = language_model.fit(docs)
    got = language_model.score(docs, model).collect()
    assert len(got) == len(rows) and [r.held_out for r in got if r.doc_id is None] == [False]
    _same({r.doc_id: r for r in got if r.doc_id is not None}, texts, [_tokens(r[1]) for r in rows], 2)
    one = {(r.n_tokens, round(r.score, 9)) for r in got if r.doc_id in (5, 6, 8, None)}
    assert len(one) == 1
    nothing = language_model.fit(docs.limit(0))
    assert language_model.score(docs.limit(0), nothing).count() == 0
    assert {(r.n_known, r.score, r.base_score) for r in language_model.score(docs, nothing).collect()} == {(0, 0.0, 0.0)}


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_chunks_do_not_matter(chunk):
    texts = pa.array(["", "a bb ccc", "", " d  e", "", "fghijklmnop" * 20, "q"], pa.large_string())
    whole = [np.concatenate(list(x)) for x in zip(*language_model.token_chunks(texts))]
    parts = [np.concatenate(list(x)) for x in zip(*language_model.token_chunks(texts, chunk))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == 2 * 7 + 3 + 2 + 1 + 1
    grams = [[np.concatenate(list(x)) for x in ((g[0] for g in f), (g[2] for g in f), (g[3][1] * (g[2] > 1) for g in f))] for f in (list(language_model.grams_ending(texts, 3, c)) for c in (chunk, 1 << 20))]
    assert all((a == b).all() for a, b in zip(*grams))
