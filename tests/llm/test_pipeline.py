"""The pipeline's stages against plain Python, each on what the one before kept."""

import re

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from corpuswright.llm.common import read_table
from corpuswright.llm.toxicity import fit, in_training_fold, score
from test_brute_force import SF, _bag, _jaccard, _plain_tiles


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _leaked(text, items):
    words = _words(text)
    grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    for item in items:
        if len(item) >= 5 and any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
            covered = sum(k for _, _, k in _plain_tiles(item, words, 5))
            if covered >= 0.5 * len(item):
                return True
    return False


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())
    items = [_words(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]

    model = fit(docs, read_table(spark, SF, "labels").where(in_training_fold()))
    kept = {r.doc_id for r in score(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, SF).collect()} == kept

    best = {}
    for i in sorted(kept):
        key = re.sub(r"[\x20\x09-\x0D]", "", texts[i])
        if key not in best or len(texts[i]) > len(texts[best[key]]):
            best[key] = i
    kept = set(best.values())

    bags = {i: _bag(texts[i]) for i in sorted(kept)}
    group = {i: i for i in bags}
    for i in bags:
        for j in bags:
            if i < j and bags[i] and _jaccard(bags[i], bags[j]) >= 0.8:
                a, b = group[i], group[j]
                group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
    kept = {i for i, g in group.items() if i == g}

    kept = {i for i in kept if not _leaked(texts[i], items)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1 for i in kept}

    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
