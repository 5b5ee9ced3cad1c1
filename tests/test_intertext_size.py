"""Grams of one document alone stay where they are, and runs are cut at grams of too many documents wherever these are dealt."""

import random

import numpy as np
from test_merge_size import _written

from corpuswright.operators import intertext


def test_few_bytes_for_grams_of_one_document(spark):
    rnd = random.Random(8)
    texts = [(d, [f"w{rnd.randrange(50_000)}" for _ in range(500)]) for d in range(400)]
    texts.append((400, texts[7][1][100:140]))
    df = spark.createDataFrame(texts, "doc_id long, unit array<string>").repartition(4).cache()
    n_grams = sum(len(u) - 4 for _, u in texts)
    assert df.count() == 401
    kept = intertext.repeated_grams(df)
    assert 72 <= kept.count() < 0.1 * n_grams
    assert _written(spark, intertext.runs(df)) < 8 * n_grams  # before the filter a gram took about twenty
    assert [tuple(r) for r in intertext.runs(df).collect()] == [(7, 400, 100, 0, 40)]
    df.unpersist()


def test_marks_pack_and_unpack():
    for marks in ([], [0], [2**32 - 1], [0, 0, 5, 5, 70_000, 2**31, 2**32 - 1]):
        told = np.array(marks, np.uint64)
        assert intertext._unpacked(intertext._packed(told)).tolist() == marks


def test_often_beside_rare(spark):
    """A phrase of 25 documents between words that only some share, at both ends of texts too: a run never goes through it."""
    phrase = "p q r s t u".split()
    texts = [(d, [f"l{d % 9}", f"m{d % 9}", f"n{d % 9}", *phrase, f"x{d % 7}", f"y{d % 7}", *(["end"] * (d % 2))]) for d in range(25)]
    df = spark.createDataFrame([*texts, (50, phrase), (51, ["p", "q", "r", "s"])], "doc_id long, unit array<string>")
    at, n = {}, 3
    for d, ws in [*texts, (50, phrase), (51, ["p", "q", "r", "s"])]:
        for i in range(len(ws) - n + 1):
            at.setdefault(tuple(ws[i : i + n]), []).append((d, i))
    shared = {(a, b, i, j) for p in at.values() if 2 <= len({d for d, _ in p}) <= 20 for a, i in p for b, j in p if a < b}
    want = set()
    for a, b, i, j in shared:
        if (a, b, i - 1, j - 1) not in shared:
            k = next(k for k in range(99) if (a, b, i + k + 1, j + k + 1) not in shared)
            want.add((a, b, i, j, k + n))
    got = [tuple(r) for r in intertext.runs(df, n, 20).collect()]
    assert want and len(got) == len(want) and set(got) == want
