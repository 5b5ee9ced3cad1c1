"""The operators against plain Python on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuswright.llm import near_dedup, queries, secret_scan, substring_dedup, token_counts, toxicity
from corpuswright.llm.decontaminate import greedy_tiles
from corpuswright.llm.packing import best_fit, encode_texts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    for table in ("documents", "conversations", "benchmark", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duckdb.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, want.project(", ".join(columns)).fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_secrets(spark, documents):
    names = "password|passwd|secret|token|api_?key"
    got = {r.doc_id: r for r in queries.op2_secrets(spark, SF).collect()}
    for doc_id, text in documents:
        found = [(m.start(), 0, m.end()) for m in re.finditer(rf"(?ai:({names}))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        spelt = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(spelt.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(Counter(k for _, k, _ in found)[k] for k in range(3))
        assert set(filter(None, spelt.split(","))) <= set(r.spans.split(","))


def test_lexing_follows_constants():
    text = 'BASE = "Zx81-qqPw0-rTT4"\nDB_PASSWORD = BASE\ncolour: "Zx81-other-value"\n"api_key": "k9" + "8s7d6f5g4h3j"'
    spans = [text[s:e] for s, _, e in secret_scan.literal_spans(text)]
    assert spans == ["Zx81-qqPw0-rTT4", 'k9" + "8s7d6f5g4h3j']


def _segment(word, scores, byte):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = []
        for begin in range(end):
            s = scores.get(word[begin:end])
            if s is None and begin == end - 1:
                n = len(word[begin].encode())
                options.append((best[begin][0] + byte * n, -begin, best[begin][1] + n))
            elif s is not None:
                options.append((best[begin][0] + s, -begin, best[begin][1] + 1))
        top = max(o[0] for o in options)
        best[end] = (top, next(o[2] for o in sorted(options, key=lambda o: -o[1]) if o[0] == top))
    return best[-1]


def test_token_counts(documents):
    path = public_tokenizers.path(token_counts.MODEL)
    scores, _, byte = token_counts.unigram_pieces(path)
    words = sorted({"▁" + w for _, t in documents[:40] for w in t.split()})[:1500] + ["▁𝔘né", "▁"]
    got = token_counts.trie_counts(words, path)
    for w in words:
        score, n = _segment(w, scores, byte)
        assert got[w][0] == n and abs(got[w][1] - score) < 1e-9


def test_tokens_are_the_tokenizers(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [t for _, t in documents[:60]] + ["A\tB\x0b c d <|endoftext|>x it's WE'LL ΑΣ Ⅷ é İx ½,, İ. É!? ÀÉ.", "", " "]
    for text, blob in zip(texts, encode_texts(texts, path)):
        assert np.frombuffer(blob, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = queries.op5_packing(spark, SF).collect()
    by = {(r.doc_id, r.piece): r for r in rows}
    total = 0
    for doc_id, text in documents:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4").tobytes()
            r = by.pop((doc_id, k // 4096))
            assert (r.start, r.length, r.ids_crc32) == (k, len(part) // 4, zlib.crc32(part))
    assert not by and len({r.sequence_id for r in rows}) <= 1.02 * -(-total // 4096) + 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit(lengths, open_bins):
    bins, offsets = best_fit(lengths, 50, open_bins)
    final, used, is_open = Counter(), {}, set()
    for n, b in zip(lengths, bins):
        final[b] += n
    for n, b, offset in zip(lengths, bins, offsets):
        if b in used:  # the fullest open bin that takes it
            assert b in is_open and offset == used[b] == max(used[x] for x in is_open if used[x] + n <= 50)
        else:
            assert offset == 0 and not any(used[x] + n <= 50 for x in is_open)
            if len(is_open) == open_bins:  # a fullest bin closes; it gets nothing more
                top = max(used[x] for x in is_open)
                is_open.remove(next(x for x in is_open if used[x] == top == final[x]))
            is_open.add(b)
            used[b] = 0
        used[b] += n
        if used[b] == 50:
            is_open.remove(b)
        assert used[b] <= 50 and len(is_open) <= open_bins


def _brute_repeats(rows, width):
    first, out = {}, {}
    for doc_id, text in sorted(rows):
        b = text.encode()
        windows = [b[k : k + width] for k in range(len(b) - width + 1)]
        gone = bytearray(len(b))
        for k, w in enumerate(windows):
            if first.get(w, doc_id) < doc_id:
                gone[k : k + width] = b"\1" * width
        for w in windows:
            first.setdefault(w, doc_id)
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def _removed(docs, **how):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, **how).collect()}


def test_substrings(spark, documents):
    want = _brute_repeats(documents, 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op6_substring_dedup(spark, SF).collect()} == want
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    assert _removed(docs, group_bytes=20_000) == want  # repeats within and between groups
    assert _removed(docs, group_bytes=20_000, hot_docs=2) == want  # nearly every anchor goes the way of hot ones


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substrings_in_long_and_odd_texts(spark, hot):
    rnd = random.Random(5)
    words = [" ".join(rnd.choices(["ab", "cde", "fü", "日本", "x"], k=12)) for _ in range(40)]
    rows = [(i * 3 + 1, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 80])))) for i in range(60)] + [(500, "a" * 400), (501, "a" * 120), (502, "a" * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _removed(docs, group_bytes=30_000, hot_docs=hot, chunk=1000) == _brute_repeats(rows, 50)


def test_substrings_with_repeated_ids(spark):
    """Rows that share a doc_id are judged each by its own text, and not against each other."""
    a, b = ("".join(random.Random(k).choices("abcdefgh ", k=200)) for k in (1, 2))
    rows = [(1, a), (5, a), (5, b + a[:70]), (5, b), (7, b), (7, b), (9, a + b)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=300).collect())
    assert got == [(1, 200, 0), (5, 200, 0), (5, 200, 200), (5, 270, 70), (7, 200, 200), (7, 200, 200), (9, 400, 400)]


def _bag(text):
    w = text.lower().split()
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _jaccard(a, b):
    least = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return least / max(1, sum(a.values()) + sum(b.values()) - least)


@pytest.mark.parametrize("small", [64, 1])
def test_near_classes(spark, documents, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rnd = random.Random(1)
    rows = list(documents)
    for k, (i, text) in enumerate(documents[:40]):
        words = text.split()
        for _ in range(max(1, len(words) // (20 + 10 * (k % 6)))):
            words[rnd.randrange(len(words))] = f"changed{rnd.random()}"
        rows.append((10_000 + i, " ".join(words)))
    bags = {i: _bag(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bags[a] and _jaccard(bags[a], bags[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in ids}


def test_signatures_are_unbiased():
    rnd = np.random.default_rng(3)
    for overlap in (0.2, 0.5, 0.9):
        agree, true = [], []
        for _ in range(12):
            e = rnd.integers(0, 2**63, 300).astype(np.uint64)
            e = np.unique(e)
            c = rnd.integers(1, 9, len(e))
            d = np.where(rnd.random(len(e)) < overlap, c, rnd.integers(0, 9, len(e)))
            on = d > 0
            sig = near_dedup.signatures([(e, c), (e[on], d[on])], 512)
            agree.append((sig[0] == sig[1]).mean())
            true.append(np.minimum(c, d).sum() / np.maximum(c, d).sum())
        assert abs(np.mean(agree) - np.mean(true)) < 0.02


def _plain_tiles(item, text, least):
    """Longest first, by looking at all pairs of positions again and again."""
    a, b, tiles = [False] * len(item), [False] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                k = 0
                while p + k < len(item) and t + k < len(text) and not a[p + k] and not b[t + k] and item[p + k] == text[t + k]:
                    k += 1
                best = max(best, (k, -p, -t))
        if best[0] < least:
            return tiles
        k, p, t = best[0], -best[1], -best[2]
        a[p : p + k] = b[t : t + k] = [True] * k
        tiles.append((p, t, k))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=30), st.integers(2, 4))
def test_tiles(item, text, least):
    got = greedy_tiles(item, text, least)
    assert all(item[p : p + k] == text[t : t + k] and k >= least for p, t, k in got)
    for at in (0, 1):
        spans = sorted((x[at], x[at] + x[2]) for x in got)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert sorted((k for _, _, k in got), reverse=True)[:1] == [k for _, _, k in _plain_tiles(item, text, least)][:1]


def test_reordered_passage_is_found(spark):
    item = " ".join(f"word{i}" for i in range(40))
    words = item.split()
    moved = " ".join(["intro"] * 30 + words[20:] + ["middle"] * 30 + words[:20] + ["end"] * 30)
    docs = spark.createDataFrame([(1, moved), (2, " ".join(words[:15] + ["other"] * 60)), (3, item.upper().replace(" ", ", "))], "doc_id long, text string")
    got = {r.doc_id: r for r in queries.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert set(got) == {1, 3} and got[1].n_tiles == 2 and got[1].coverage == 1.0


def _slow_kernel(s, t, n, decay):
    from itertools import combinations

    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel():
    pairs = [("idiot", "id.i0ot"), ("scum", "s-c-u-m"), ("abcabc", "cab"), ("ab", "ab"), ("aaaa", "aaa")]
    a, _ = toxicity._codes([x for x, _ in pairs])
    b, _ = toxicity._codes([y for _, y in pairs])
    want = [_slow_kernel(x, y, toxicity.ORDER, toxicity.DECAY) for x, y in pairs]
    assert np.allclose(toxicity.kernel_pairs(a, b), want, rtol=1e-4)


def test_inserted_characters_do_not_hide(spark):
    rnd = random.Random(2)
    plain = ["river stone", "green field", "quiet evening", "open window", "paper boat", "long road"]
    rows, labels = [], []
    for i in range(400):
        words = " ".join(rnd.choices(plain, k=30)).split()
        bad = i % 4 == 0
        for w in rnd.choices(["idiot", "moron", "worthless"], k=2 * bad):
            words.insert(rnd.randrange(len(words)), w)
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    hidden = ["id.i0ot", "m o r o n", "wor-th-less"]
    rows += [(1000 + k, f"green field {h} paper boat {h} river stone.") for k, h in enumerate(hidden)] + [(2000, "green field river stone paper boat.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == t for i, t in labels) and got[2000] == 0
    assert [got[1000 + k] for k in range(3)] == [1, 1, 1]
