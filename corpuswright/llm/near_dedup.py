"""Near-duplicate detection with BagMinHash signatures of word-shingle multisets.

Signatures (Ertl, 2018). Each shingle runs a Poisson process over the axis of its weight, which is cut at 1, 2, 4, 8, ...;
a point in a dyadic interval is sent to one of its unit cells by its own hash, so a text with multiplicity w keeps exactly the
points below w, whatever w is. A point falls on one register at random, and a register keeps its earliest point: two texts
agree in a register with probability equal to their weighted Jaccard similarity. A time bound that nearly always fills all
registers stops almost every shingle of a long text at its first point; a text with a register left open gets twice the time.

Candidates are texts that share a band. Equal multisets are one node beforehand. In each bucket all nodes are compared with
the least one, its leader. Only pairs from different components still matter for the classes, and as 1 - J is a metric, only
those whose distances to their leader differ by at most 1 - threshold. They are compared among the nodes of one leader: as
rows where it has at most SMALL nodes, else in blocks, a matrix product a pair of blocks, of which only links that join two
components come out. So no step emits the pairs of a large group. Every comparison is exact, on whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import (
    GOLDEN, SHINGLE_WORDS, cut, first_of_each, join_groups, lowered, mix64, shingle_hashes, sub_batches, text_rows, utf8_buffers, with_ids, without_ids, word_hashes,
)

THRESHOLD = 0.8
BANDS, ROWS = 32, 4
SMALL = 64
BLOCK_WORDS, BLOCK_ROWS = 200_000, 2000  # so a pair of blocks has a matrix of at most about 4,000 squared numbers


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles (sorted hashes) and their multiplicities of each text, in lower case."""
    data, starts = utf8_buffers(lowered(texts))
    out = []
    for i, j in sub_batches(starts):
        here = starts[i : j + 1] - starts[i]
        words, of = word_hashes(data[starts[i] : starts[j]], here)
        shingles, of = shingle_hashes(words, of, j - i, SHINGLE_WORDS)
        edges = np.searchsorted(of, np.arange(j - i + 1))
        out += [np.unique(shingles[edges[k] : edges[k + 1]], return_counts=True) for k in range(j - i)]
    return out


def _points(of, elements, counts, bound):
    """(text, time, register hash, identity) of all points up to each text's time bound."""
    found = []
    level, low, width = 0, 0, 1
    while True:
        on = counts > low
        if not on.any():
            break
        doc, top = of[on], counts[on]
        seed = mix64(elements[on] + np.uint64((level + 1) * 0xA0761D6478BD642F % 2**64))
        time, limit = np.zeros(len(doc)), bound[doc]
        while len(doc):
            seed = seed + GOLDEN
            s = mix64(seed)
            time = time - np.log1p(-(s >> np.uint64(11)).astype(np.float64) * 2.0**-53) / width
            alive = time <= limit
            doc, top, seed, time, limit, s = doc[alive], top[alive], seed[alive], time[alive], limit[alive], s[alive]
            r = mix64(s ^ np.uint64(0xE7037ED1A0B428DB))
            if width == 1:
                found.append((doc, time, r, s))
            else:
                inside = low + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64) < top
                found.append((doc[inside], time[inside], r[inside], s[inside]))
        level, low, width = level + 1, 1 << level, 1 << level
    return [np.concatenate(x) for x in zip(*found)]


def signatures(texts_bags: list[tuple[np.ndarray, np.ndarray]], m: int = BANDS * ROWS) -> np.ndarray:
    """A row of m register identities for each bag; rows of empty bags are zero."""
    out = np.zeros((len(texts_bags), m), dtype=np.uint64)
    todo = np.array([i for i, (e, _) in enumerate(texts_bags) if len(e)], dtype=np.int64)
    spread = np.log(m) + 5.0
    while len(todo):
        elements = np.concatenate([texts_bags[i][0] for i in todo])
        counts = np.concatenate([texts_bags[i][1] for i in todo]).astype(np.int64)
        sizes = np.array([len(texts_bags[i][0]) for i in todo])
        of = np.repeat(np.arange(len(todo)), sizes)
        bound = m * spread / np.add.reduceat(counts, np.r_[0, np.cumsum(sizes)[:-1]])
        doc, time, r, s = _points(of, elements, counts, bound)
        slot = doc * m + (((r >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        best = np.full(len(todo) * m, np.inf)
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        ids = np.zeros(len(todo) * m, dtype=np.uint64)
        ids[slot[first]] = s[first]
        full = np.isfinite(best.reshape(-1, m)).all(axis=1)
        out[todo[full]] = ids.reshape(-1, m)[full]
        todo, spread = todo[~full], spread * 2
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, dtype=np.uint64) * GOLDEN
        for r in range(ROWS):
            key = mix64(key ^ sig[:, b * ROWS + r]) + GOLDEN
        keys[:, b] = key
    return keys


def _sign(batches):
    for b in batches:
        texts = pa.array(b["text"], type=pa.large_string())
        ids, lo = b["doc_id"].to_numpy(), 0
        sizes = np.r_[0, np.cumsum([len(t) for t in b["text"]])]
        for lo, hi in sub_batches(sizes):
            mine = bags(texts[lo:hi])
            keys = band_keys(signatures(mine)).view(np.int64)
            n_words = [int(c.sum()) for _, c in mine]
            bag = [hashlib.blake2b(e.tobytes() + c.astype(np.int64).tobytes(), digest_size=16).digest() if len(e) else b"" for e, c in mine]
            yield pd.DataFrame({"doc_id": ids[lo:hi], "bag": bag, "n_words": n_words, "bands": list(keys)})


def weighted_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    """Sum of least over sum of largest multiplicities of the shingles of two texts; 0 if either has none."""
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for x, y in zip(a, b):
        if len(known) > 2000:
            known.clear()
        for t in (x, y):
            if t not in known:
                known[t] = bags(pa.array([t], type=pa.large_string()))[0]
        (e, c), (f, d) = known[x], known[y]
        _, i, j = np.intersect1d(e, f, assume_unique=True, return_indices=True)
        least = np.minimum(c[i], d[j]).sum()
        out.append(least / max(1, c.sum() + d.sum() - least))
    return pd.Series(out, dtype="float64")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, similarity; only texts in a pair move."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.pandas_udf(weighted_jaccard, "double")("text_a", "text_b").alias("similarity"))


def _block_links(threshold: float):
    """Links of at least `threshold` between components, of a pair of blocks; as many as it takes to join what they join."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)
        copies = []  # a shingle with multiplicity n becomes n elements, so that multisets are sets
        for e, c in bags(pa.array(pdf["text"], type=pa.large_string())):
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            copies.append(mix64(np.repeat(e, c) + nth.astype(np.uint64) * GOLDEN))
        sizes = np.array([len(x) for x in copies])
        elements, where, seen = np.unique(np.concatenate(copies), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(pdf)), sizes)
        shared = seen[where] > 1
        column = (np.cumsum(seen > 1) - 1)[where[shared]]
        of, n = of[shared], int((seen > 1).sum())
        common = np.zeros((len(pdf), len(pdf)), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for lo in range(0, n, 4096):
            part = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + 4096))
            has = np.zeros((len(pdf), min(4096, n - lo)), dtype=np.float32)
            has[of[part], column[part] - lo] = 1
            common += has @ has.T
        near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-3
        component = pdf["component"].tolist()
        root = {c: c for c in component}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        node, out = pdf["node"].tolist(), []
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
            a, b = find(component[i]), find(component[j])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def _links_in_blocks(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that join the components of each leader's nodes; its nodes are dealt into blocks of about BLOCK_WORDS or
    BLOCK_ROWS, whichever is less."""
    blocks = F.ceil(F.greatest(F.col("words") / F.lit(BLOCK_WORDS), F.col("n") / F.lit(BLOCK_ROWS))).cast("int")
    mine = rows.select("leader", "node", "component", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).alias("mine"))
    dealt = mine.select("leader", "node", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = dealt.select("leader", "node", "component", F.least("mine", F.col("other")).alias("lo"), F.greatest("mine", F.col("other")).alias("hi"))
    told = keyed.join(texts.select(F.col("doc_id").alias("node"), "text"), "node")
    return told.groupBy("leader", "lo", "hi").applyInPandas(_block_links(threshold), "a long, b long")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for every row; classes are linked by similarity >= threshold.

    Texts are compared in lower case, as multisets of five-word shingles (a text of one to four words is one shingle). Texts
    with equal multisets are in one class; null, empty and white-space texts have no shingle and stand alone. doc_id must
    identify a row (repeated ones share their class). A row without doc_id is compared like any other; a class in which no row
    has one has a null class_id. An empty table gives an empty result; other columns are ignored.
    """
    known, top = with_ids(docs)
    return without_ids(_classes(known, threshold), top, "doc_id", "class_id")


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    """near_duplicate_classes of rows which all have a doc_id."""
    rows = text_rows(docs)
    signed = cut(rows.mapInPandas(_sign, "doc_id long, bag binary, n_words long, bands array<long>"))
    nodes = signed.where(F.length("bag") > 0).groupBy("bag").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("copies"))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other")
    stars = banded.join(shared.select("bucket", "leader"), "bucket").where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    stars = cut(stars.distinct())
    touched = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = cut(rows.join(touched, "doc_id", "left_semi"))
    star = cut(_verified(stars, texts))
    near = star.where(F.col("similarity") >= threshold).select("a", "b")
    labels = connected_components(near)

    placed = (
        star.select(F.col("a").alias("leader"), F.col("b").alias("node"), "similarity").join(labels, "node", "left")
        .select("leader", "node", F.coalesce("component", "node").alias("component"), "similarity")
        .join(nodes.select("node", "n_words"), "node")
    )
    placed = cut(placed)
    groups = placed.groupBy("leader").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"), F.min("component").alias("c0"), F.max("component").alias("c1")
    ).where("c0 <> c1").select("leader", "n", "words")
    open_rows = placed.join(groups, "leader")
    few = open_rows.where(F.col("n") <= SMALL)
    x = few.select("leader", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("similarity").alias("sa"))
    y = few.select("leader", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("similarity").alias("sb"))
    apart = F.abs(F.col("sa") - F.col("sb")) <= 1 - threshold + 1e-9
    pairs = x.join(y, "leader").where((F.col("ca") < F.col("cb")) & apart).select("a", "b").distinct()
    more = _verified(pairs, texts).where(F.col("similarity") >= threshold).select("a", "b")
    more = cut(more.unionByName(_links_in_blocks(open_rows.where(F.col("n") > SMALL), texts, threshold)))
    classes = connected_components(near.unionByName(more))

    known = cut(nodes.select("bag", "node", "copies").join(classes, "node", "left").select("bag", "copies", F.coalesce("component", "node").alias("class_id")))
    told = signed.where(F.length("bag") > 0).select("doc_id", "bag")
    found = join_groups(told, known, ["bag"], "copies", signed.count()).select("doc_id", "class_id")
    return found.unionByName(signed.where(F.length("bag") == 0).select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, that are the first of their class; of rows with one doc_id one stays."""
    docs, top = with_ids(docs)
    found = cut(_classes(docs, threshold))
    gone = found.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).where("doc_id <> class_id").select("doc_id")
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    return without_ids(first_of_each(docs.join(gone, "doc_id", "left_anti").select(*docs.columns), ["doc_id"], twice), top)
