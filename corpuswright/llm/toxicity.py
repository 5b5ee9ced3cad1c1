"""Toxicity scoring with a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The gap-weighted subsequence kernel of order ORDER compares a word with a landmark by all their common subsequences, each
weighted by DECAY to the power of the stretch that it covers, so `idiot` still resembles `id.i0ot` and `i d i o t`. Landmarks
are the words and word stems of the labelled training texts that speak most for the label. A sentence's kernel row holds the
best value of any of its words for each landmark (insults are words: a kernel over the whole sentence would reward subsequences
that run through many harmless ones); values under LEAST_KERNEL count as none, for landmarks as for words; the Nyström map turns rows into features, and a squared-hinge SVM is fitted
on labelled sentences: for a toxic text its worst sentence (chosen anew in each round), for a clean one its most insult-like
ones. A text's score is a logistic regression on the margin of its worst sentence, the summed evidence of its words, and
that sum for a hundred words, since one chance resemblance weighs less in a long text.

Fitting reads a bounded sample (`max_train_rows` labelled rows, by hash of doc_id) and brings to the driver a few numbers a
row. Scoring is one pass over the documents where they lie: nothing shuffles.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows, worker_state

ORDER = 3
DECAY = 0.7
MAX_WORD = 32  # longer words are compared in overlapping stretches of this length
CACHE_WORDS = 250_000
PORTION = 500_000  # characters of texts whose words are learnt at once
SENTENCES_A_ROW = 3
LEAST_KERNEL = 0.35  # lower similarities count as none
SHARED_LETTERS = 0.75  # of a landmark's distinct letters, so many at least must be in the word
STEMS = (4, 5, 6, 7, 8)
LEAST_RATIO = 1.5
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as a matrix padded with -1, and lengths."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    width = max(1, int(lengths.max(initial=0)))
    flat = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return np.where(np.arange(width) < lengths[:, None], flat.reshape(-1, width), np.int32(-1)), lengths


def kernel_pairs(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The gap-weighted subsequence kernel of each row of `a` with the same row of `b` (code matrices padded with -1)."""
    n, width = len(a), b.shape[1]
    decay, known = np.float32(decay), (b >= 0).T
    kept = [np.ones((width + 1, n), np.float32)] + [np.zeros((width + 1, n), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for i in range(a.shape[1]):
        same = (a[:, i] == b.T) & known
        total += decay * decay * (same * kept[order - 1][:width]).sum(axis=0)
        for k in range(order - 1, 0, -1):
            inner = np.zeros(n, np.float32)
            below = kept[k - 1]
            for j in range(width):
                inner = decay * (inner + decay * below[j] * same[j])
                kept[k][j + 1] = decay * kept[k][j + 1] + inner
    return total


def _masks(words: list[str]) -> np.ndarray:
    """A bit for each letter that a word has, modulo 64."""
    out = np.zeros(len(words), dtype=np.uint64)
    for lo in range(0, len(words), 8192):
        codes, _ = _codes(words[lo : lo + 8192])
        bits = np.where(codes >= 0, np.uint64(1) << (codes & 63).astype(np.uint64), np.uint64(0))
        out[lo : lo + 8192] = np.bitwise_or.reduce(bits, axis=1)
    return out


def kernel_rows(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark; 0 where too few letters are shared or the value is low."""
    out = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    if not words or not landmarks:
        return out
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes, sizes = _codes(landmarks)
    masks, marks = _masks(words), _masks(landmarks)
    least = np.maximum(min(3, ORDER), np.ceil(SHARED_LETTERS * np.bitwise_count(marks).astype(float))).astype(np.uint8)
    masks[lengths < ORDER] = 0
    own = kernel_pairs(codes, codes)
    rows, columns = [], []
    for j in range(len(landmarks)):
        near = np.flatnonzero(np.bitwise_count(masks & marks[j]) >= least[j])
        rows.append(near)
        columns.append(np.full(len(near), j))
    r, c = np.concatenate(rows), np.concatenate(columns)
    if not len(r):
        return out
    used = np.unique(r)
    used = used[np.argsort(lengths[used], kind="stable")]
    mine, own_sizes = _codes([words[i] for i in used])
    place = np.empty(len(words), dtype=np.int64)
    place[used] = np.arange(len(used))
    slices = lambda n: (slice(lo, lo + 4096) for lo in range(0, n, 4096))
    self_kernel = np.concatenate([kernel_pairs(m, m) for m in (mine[s, : own_sizes[s].max()] for s in slices(len(mine)))])
    order = np.lexsort((sizes[c], lengths[r]))  # pairs of like lengths together: little padding
    r, c = r[order], c[order]
    for part in slices(len(r)):
        p = place[r[part]]
        value = kernel_pairs(mine[p][:, : lengths[r[part]].max()], codes[c[part]][:, : sizes[c[part]].max()])
        out[r[part], c[part]] = value / np.sqrt(np.maximum(self_kernel[p] * own[c[part]], 1e-30))
    out[out < LEAST_KERNEL] = 0
    return out


def _stretches(word: str) -> list[str]:
    """A word without the marks at its edges, and the same without any but letters; long ones in overlapping stretches."""
    word = word.strip(_EDGES)
    forms = [word] if word.isalpha() else [word, "".join(filter(str.isalpha, word))]
    return [f[k : k + MAX_WORD] for f in forms for k in range(0, max(1, len(f) - MAX_WORD // 2), MAX_WORD // 2)]


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about PORTION characters; a longer text stands alone."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PORTION):
            size += len(texts[hi])
            hi += 1
        yield texts[lo:hi]
        lo = hi


class WordRows:
    """Kernel rows of words, kept between batches: None for a word that resembles no landmark."""

    def __init__(self, landmarks: list[str]):
        self.landmarks, self.cache = landmarks, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        parts = [_stretches(w) for w in new]
        flat = [p for ps in parts for p in ps]
        rows = kernel_rows(flat, self.landmarks)
        self.cache.update(dict.fromkeys(new))
        first = np.cumsum([0, *map(len, parts)])
        for i in np.unique(np.searchsorted(first, np.flatnonzero(rows.any(axis=1)), side="right") - 1).tolist():
            self.cache[new[i]] = rows[first[i] : first[i + 1]].max(axis=0)

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each text: the kernel rows of the sentences that have any, the sum of all its words' rows, and its words."""
        lower = [t.lower() for t in texts]
        split = [t.split() for t in lower]
        spaced = [[(m.start(), re.sub(r"\s", "", m[0])) for m in _SPACED.finditer(t)] for t in lower]
        self.learn(set().union(*split, *({w for _, w in s} for s in spaced)))
        get, out = self.cache.get, []
        none, zero = np.zeros((0, len(self.landmarks)), np.float32), np.zeros(len(self.landmarks), np.float32)
        for text, words, merged in zip(lower, split, spaced):
            hits = [v for v in map(get, words) if v is not None] + [v for _, w in merged if (v := get(w)) is not None]
            if not hits:
                out.append((none, zero, len(words)))
                continue
            rows, begin = [], 0
            for end in [*(m.start() for m in _SENTENCE.finditer(text)), len(text)]:
                got = [v for w in text[begin:end].split() if (v := get(w)) is not None]
                got += [v for at, w in merged if begin <= at < end and (v := get(w)) is not None]
                if got:
                    rows.append(np.max(got, axis=0))
                begin = end
            out.append((np.array(rows, dtype=np.float32) if rows else none, np.sum(hits, axis=0), len(words)))
        return out


def words_of(landmarks: list[str]) -> WordRows:
    """The cache for these landmarks, kept by a Python worker."""
    return worker_state(("toxicity", *landmarks), lambda: WordRows(landmarks))


def _evidence(rows: np.ndarray, total: np.ndarray, n_words: int, weights: np.ndarray, bias: float) -> tuple[float, float, float]:
    """The margin of the worst sentence (one that resembles no landmark has the bias), and the words' evidence twice."""
    worst = (max(0.0, float((rows @ weights).max())) if len(rows) else 0.0) + bias
    sum_ = max(0.0, float(total @ weights))
    return worst, math.log1p(sum_), math.log1p(100 * sum_ / (n_words + 20))


@dataclass(frozen=True)
class ToxicityModel:
    """SVM weights on kernel rows (the Nyström map is folded in) and the logistic regression on a text's evidence."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    logit: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -1.0]))
    bias: float = 0.0

    def score(self, rows: np.ndarray, total: np.ndarray, n_words: int) -> float:
        z = float(np.dot(self.logit, (*_evidence(rows, total, n_words, self.weights, self.bias), 1.0)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _nystroem(landmarks: list[str]) -> np.ndarray:
    """The inverse root of the landmarks' own kernel matrix, which is cut off as the rows of words are; directions in which the
    cut-off kernel has next to no or negative weight are left out."""
    k = kernel_rows(landmarks, landmarks).astype(float)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    root = np.where(values > 1e-2, 1 / np.sqrt(np.maximum(values, 1e-2)), 0.0)
    return (vectors * root) @ vectors.T


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton's method on the weighted squared hinge loss; the last column of the design is the bias."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    reg = ridge * np.eye(len(w))
    reg[-1, -1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(rounds):
        gap = 1 - y * (z @ w)
        on = gap > 0
        g = reg @ w - z[on].T @ (weight[on] * y[on] * gap[on])
        h = reg + (z[on].T * weight[on]) @ z[on]
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by damped Newton steps, with Platt's smoothed targets; the last weight is the intercept."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    reg = np.r_[np.full(x.shape[1], ridge), 1e-9]
    loss = lambda w: float((np.logaddexp(0, z @ w) - t * (z @ w)).sum() + 0.5 * (reg * w * w).sum())
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - t) + reg * w
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(reg + 1e-9), g)
        size = 1.0
        while loss(w - size * step) > loss(w) - 1e-4 * size * float(g @ step) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return np.r_[w[:-1] / std, w[-1] - float((w[:-1] * mean / std).sum())]


def choose_landmarks(candidates: list[tuple[str, int, float]], n: int) -> list[str]:
    """The best of (stem, toxic texts, gain) by gain; a stem is left out if a longer one covers nine tenths of its texts."""
    out: list[str] = []
    for stem, bad, _ in sorted(candidates, key=lambda c: (-c[2], c[0])):
        if not any(len(o) > len(stem) and o.startswith(stem) and b >= 0.9 * bad for o, b, _ in candidates):
            out.append(stem)
        if len(out) == n:
            break
    return out


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 12_000, n_landmarks: int = 96) -> ToxicityModel:
    """A model from `labels` (doc_id, toxic) joined to `docs`; at most `max_train_rows` labelled rows, by hash of doc_id.

    Rows with a null label or doc_id are left out, a doc_id labelled twice counts with its larger label. Without labelled rows
    of both kinds the model gives every text the same score, below one half.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    )
    train = text_rows(docs).join(F.broadcast(chosen), "doc_id")  # at most max_train_rows rows
    sizes = {r["toxic"] > 0: r["count"] for r in chosen.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return ToxicityModel()
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    stems = F.flatten(F.transform(words, lambda w: F.array(w, *(F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STEMS))))
    log_ratio = F.log((F.col("bad") + 0.5) / sizes[True]) - F.log((F.col("good") + 0.5) / sizes[False])
    best = (
        train.select("toxic", F.explode(F.array_distinct(F.array_compact(stems))).alias("stem"))
        .where(F.length("stem").between(ORDER + 1, MAX_WORD))
        .groupBy("stem").agg(F.count_if(F.col("toxic") > 0).alias("bad"), F.count_if(F.col("toxic") <= 0).alias("good"))
        .where("bad >= 3").withColumn("ratio", log_ratio).where(F.col("ratio") > LEAST_RATIO)
        .select("stem", "bad", (F.col("bad") * F.col("ratio")).alias("gain"))
        .orderBy(F.desc("gain"), "stem").limit(8 * n_landmarks)
    )
    landmarks = choose_landmarks([(r["stem"], r["bad"], r["gain"]) for r in best.collect()], n_landmarks)
    if not landmarks:
        return ToxicityModel()

    def sample(batches):
        known = WordRows(landmarks)
        for b in batches:
            out = []
            for toxic, (matrix, total, n_words) in zip(b["toxic"].tolist(), (m for part in portions(b["text"].tolist()) for m in known.read(part))):
                top = matrix[np.argsort(-matrix.sum(axis=1), kind="stable")[:SENTENCES_A_ROW]]
                out.append((int(toxic > 0), top.astype(np.float32).tobytes(), total.astype(np.float32).tobytes(), n_words))
            yield pd.DataFrame(out, columns=["toxic", "rows", "total", "n_words"])

    got = train.mapInPandas(sample, "toxic int, rows binary, total binary, n_words long").collect()
    got.sort(key=lambda r: (r["toxic"], r["n_words"], r["rows"], r["total"]))  # sums do not depend on the order of arrival
    matrices = [np.frombuffer(r["rows"], dtype=np.float32).reshape(-1, len(landmarks)).astype(float) for r in got]
    y = np.array([1.0 if r["toxic"] else -1.0 for r in got])
    mapping = _nystroem(landmarks)
    clean = [m for m, t in zip(matrices, y) if t < 0 and len(m)] + [np.zeros((1, len(landmarks)))]
    negative = np.vstack(clean) @ mapping
    share = np.ones(len(negative))
    share[-1] = max(1, sum(1 for m, t in zip(matrices, y) if t < 0 and not len(m)))
    toxic = [m for m, t in zip(matrices, y) if t > 0 and len(m)]
    pick = [0] * len(toxic)
    weights, bias = np.zeros(len(landmarks)), 0.0
    for _ in range(3):
        if not toxic:
            break
        positive = np.vstack([m[k] for m, k in zip(toxic, pick)]) @ mapping
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        w, bias = _svm(np.vstack([positive, negative]), sign, np.r_[np.ones(len(positive)), share])
        weights = mapping @ w
        pick = [int(np.argmax(m @ weights)) for m in toxic]
    totals = [np.frombuffer(r["total"], dtype=np.float32).astype(float) for r in got]
    x = np.array([_evidence(m, t, r["n_words"], weights, bias) for m, t, r in zip(matrices, totals, got)])
    return ToxicityModel(landmarks, weights, _logistic(x, y), bias)


def score_column(model: ToxicityModel) -> Callable:
    """A column function from whole texts (not null) to scores; it keeps the words that it has met between batches."""

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = words_of(model.landmarks)
        for texts in batches:
            yield pd.Series([model.score(*m) for part in portions(texts.tolist()) for m in known.read(part)], dtype="float64")

    return scores


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score and predicted (1 from a score of one half on) of every whole text.

    Null and empty texts get the score of a text that resembles no landmark. Repeated rows give a row each, an empty table an
    empty result; other columns are ignored.
    """
    scored = text_rows(docs).select("doc_id", score_column(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def in_training_fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is not predicted toxic; nothing shuffles."""
    return docs.where(score_column(model)(F.coalesce(docs["text"], F.lit(""))) < 0.5)
