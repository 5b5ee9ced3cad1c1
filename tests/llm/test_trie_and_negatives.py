"""The prefix trie and the hard negatives: against their SQL on all rows, on odd rows against plain Python, at small blocks."""

import hashlib
import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from corpuswright.llm import hard_negatives, queries
from corpuswright.llm.conversation_trie import prefix_trie
from corpuswright.operators.numbering import numbered, running_sums
from test_brute_force import SF


def _rows(frame, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in frame.collect())))


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_hard_negatives"])
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLES[name]).project(", ".join(columns)).fetchall()
    assert _rows(got, columns) == sorted(map(repr, want)) and want


def _trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for s in sorted(members, key=len, reverse=True):
        leaves[s] += not children[s]
        if s:
            saved[s] += (len(members[s]) - 1) * len(s[-1][1])
            children[s[:-1]] += 1
            leaves[s[:-1]] += leaves[s]
            saved[s[:-1]] += saved[s]
    out = []
    for s, of in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()
        out.append((of[0], len(s), members[s[:-1]][0] if s else None, len(of), children[s], leaves[s], saved[s], digest))
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
KIND = "conv_id long, turn long, role string, text string, depth string, node string"


def _check(spark, rows):
    got = prefix_trie(spark.createDataFrame([(*r, "x", None) for r in rows], KIND).repartition(3))
    assert _rows(got, COLUMNS) == _trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(c, t, "user" if t % 2 else None, f"text {(c * t) % 3}" if (c + t) % 5 else None) for c in range(0, 320, 3) for t in range(c % 7)]
    rows += [(None, 0, "user", "no conversation"), (5, None, "a", "first"), (5, None, "a", "first"), (5, 1, "b", ""), (5, 1, None, "b")]
    rows += [(1000 + c, t, "r", "the same") for c in range(40) for t in range(8)]  # copies in one family
    rows += [(2000, t, "r", f"{t % 2}") for t in range(1500)] + [(2001, t, "r", f"{t % 2}") for t in range(1400)]  # longer than a block
    _check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(7, 0, None, None)], [(1, 0, "a", "b"), (2, 0, "a", "b"), (3, 0, "ab", "")]])
def test_small_tries(spark, rows):
    _check(spark, rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    short = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 1]  # they lose their turn, and the family has no head
    _check(spark, [(c, 0, "a", "gone") for c in short[:9]])


def test_numbers_and_running_sums(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS k", "id AS at", "cast(id % 11 AS decimal(38,0)) AS v").repartition(5)
    assert [r.n for r in numbered(rows, ["k", "at"], "n").orderBy("k", "at").collect()] == list(range(5000))
    same = numbered(spark.range(1000).selectExpr("1 AS k"), ["k"], "n")
    assert sorted(r.n for r in same.collect()) == list(range(1000))
    sums = defaultdict(int)
    for r in sorted(running_sums(rows, "k", "at", ["v"], block=8).collect(), key=lambda r: (r.k, r["at"])):
        sums[r.k] += r["at"] % 11
        assert r.v == sums[r.k]


def _negatives(rows):
    usable = []
    for n, (i, v, label) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((n, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(x)) for x in v]))
    out = []
    for n, i, label, v in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, other, w in usable if m != n)
        for s, j, _, _ in [x for x in scored if x[3] == label][:5]:
            fit = [x for x in scored if x[3] != label and -50 * s <= -100 * x[0] <= -95 * s][:3]
            out += [(i, j, k, x[1], -s, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, score string, row string"
FOUND = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 2.0**20])
def test_negatives_of_odd_rows(spark, scale):
    """With large numbers products pass 2**53 and are still exact."""
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) * scale for x in r.normal(size=4) + 0.5], int(r.integers(0, 4))) for i in range(260)]
    rows += [(300, None, 1), (350, [1.0, None], 1), (400, [float("nan")] * 4, 1), (450, [1.0] * 4, None), (None, [1.0] * 4, 1), (500, [], 2)]
    rows += [(600 + i, [scale, scale, 0.0, 0.0], 1 + i % 2) for i in range(120)] + [(650, [scale] * 4, 1), (651, [scale, scale], 1), (700, [float("inf")], 3)]
    frame = spark.createDataFrame([(*x, "s", None) for x in rows], VECTORS).repartition(3, "vec_id")
    got = sorted(tuple(x[c] for c in FOUND) for x in hard_negatives.hard_negatives(frame, block_rows=3).collect())
    assert got == _negatives(rows) and got


def test_no_vectors(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(frame).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(50, [1.0], 1, "", "")], VECTORS)).count() == 0
