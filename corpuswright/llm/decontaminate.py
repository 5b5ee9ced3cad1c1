"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

A document's word shingles are looked up among the benchmark's; only where they meet, in the stretches of shared seeds, tiles
are laid: the longest common runs of unmarked words first, found by rolling hashes of a window that halves from the item's
length down to the seed length. Tiles cover an item in any order, so reordered passages count. Coverage is the share of the
item's words under tiles.

The benchmark is a stated query set. Each block of at most about `block_chars` characters of it is broadcast, and its index (numpy
arrays, some 40 bytes a word) is built once a worker. A larger benchmark goes in several passes over the documents, each
written before the next begins, with the same result. Documents never shuffle.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, shingle_hashes, sub_batches, text_rows, utf8_buffers, word_hashes, worker_state, written

SEED_WORDS = 5
COVERAGE = 0.5
BLOCK_CHARS = 16_000_000
_MODULUS = (1 << 61) - 1
_BASE = 1_000_003
ITEM_MARK, TEXT_MARK = -1, -2
_FREE = bytes(64)
MATCH = "array<struct<item_id:bigint,coverage:double,n_tiles:int,n_words:int>>"


def tile_words(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text: runs of letters and digits, in lower case."""
    plain = pc.replace_substring_regex(lowered(texts), r"[^\p{L}\p{N}]+", " ")
    data, starts = utf8_buffers(plain)
    out = []
    for i, j in sub_batches(starts):
        words, of = word_hashes(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        edges = np.searchsorted(of, np.arange(j - i + 1))
        out += [words[edges[k] : edges[k + 1]] for k in range(j - i)]
    return out


def _windows(words: list[int], marked: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(position, rolling hash) of each window of s unmarked words."""
    top = pow(_BASE, s - 1, _MODULUS)
    value = run = 0
    for i, w in enumerate(words):
        if marked[i]:
            value = run = 0
            continue
        if run >= s:
            value = (value - words[i - s] * top) % _MODULUS
        value = (value * _BASE + w) % _MODULUS
        run += 1
        if run >= s:
            yield i - s + 1, value


def _reach(item: list[int], text: list[int], p: int, t: int, k: int) -> int:
    """How far the words from two places on are equal, of which the first k are known to be: steps double, and halve at the end."""
    step, most = 32, min(len(item) - p, len(text) - t)
    while k < most and step:
        n = min(step, most - k)
        if item[p + k : p + k + n] == text[t + k : t + k + n]:
            k, step = k + n, 2 * n
        else:
            step = n // 2
    return k


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(position in item, position in text, length) of the tiles, longest first; none is shorter than `least`."""
    item, text = list(item), list(text)  # marked words become ITEM_MARK and TEXT_MARK, which equal no word
    item_marked, text_marked = bytearray(len(item)), bytearray(len(text))
    tiles, s = [], min(len(item), len(text))
    while s >= least:
        where: dict = defaultdict(lambda: defaultdict(list))  # by hash, then by the word before: equal words before mean a longer run
        for t, h in _windows(text, text_marked, s):
            where[h][text[t - 1] if t else TEXT_MARK].append(t)
        by_length = defaultdict(list)
        for p, h in _windows(item, item_marked, s):
            before = item[p - 1] if p else ITEM_MARK
            for other, places in where[h].items() if h in where else ():
                if other == before:
                    continue  # longer runs from further left have these
                for t in places:
                    if item[p : p + s] == text[t : t + s]:
                        by_length[_reach(item, text, p, t, s)].append((p, t))
        while by_length:
            k = max(by_length)
            for p, t in sorted(set(by_length.pop(k))):
                if item_marked.find(1, p, p + k) < 0 and text_marked.find(1, t, t + k) < 0:
                    item_marked[p : p + k] = text_marked[t : t + k] = b"\1" * k
                    item[p : p + k], text[t : t + k] = [ITEM_MARK] * k, [TEXT_MARK] * k
                    tiles.append((p, t, k))
                elif item_marked.find(_FREE[:s], p, p + k) >= 0 and text_marked.find(_FREE[:s], t, t + k) >= 0:  # the parts that are still free
                    taken = np.frombuffer(bytes(item_marked[p : p + k]), np.uint8) | np.frombuffer(bytes(text_marked[t : t + k]), np.uint8)
                    edges = np.r_[-1, np.flatnonzero(taken), k]
                    for i in np.flatnonzero(np.diff(edges) > s).tolist():
                        first = int(edges[i]) + 1
                        by_length[int(edges[i + 1]) - first].append((p + first, t + first))
        if s == least:
            break
        s = max(least, s // 2)
    return tiles


class Items:
    """Benchmark items with an index from seeds to the items that have them: flat arrays only."""

    def __init__(self, ids: list[int], texts: list[str], least: int = SEED_WORDS):
        self.ids, self.least = ids, least
        words = tile_words(pa.array(texts, type=pa.large_string()))
        self.first = np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(self.first))
        hashes, owner = shingle_hashes(self.words, of, len(words), least)
        long = np.diff(self.first)[owner] >= least
        hashes, owner = hashes[long], owner[long].astype(np.int32)
        place = self.first[owner] + np.arange(len(owner)) - np.searchsorted(owner, owner)
        order = np.lexsort((place, hashes))
        hashes, self.owner, self.place = hashes[order], owner[order], place[order]
        self.seeds, self.begin = np.unique(hashes, return_index=True)
        self.end = np.r_[self.begin[1:], len(hashes)].astype(np.int64)

    def matches(self, words: np.ndarray, coverage: float) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, words covered) of each item that the text's words cover well enough."""
        if len(words) < self.least or not len(self.seeds):
            return []
        hashes, _ = shingle_hashes(words, np.zeros(len(words), np.int64), 1, self.least)
        at = np.searchsorted(self.seeds, hashes)
        at[at == len(self.seeds)] = 0
        hit = np.flatnonzero(self.seeds[at] == hashes)
        if not len(hit):
            return []
        # no tile covers a word of an item that is under none of the item's seeds here; few items with a common seed come further
        places = np.sort(np.concatenate([self.place[self.begin[j] : self.end[j]] for j in np.unique(at[hit]).tolist()]))
        under = np.minimum(np.diff(np.r_[places, places[-1] + self.least]), self.least)
        under = np.bincount(np.searchsorted(self.first, places, side="right") - 1, weights=under, minlength=len(self.ids))
        enough = (under > 0) & (under >= coverage * np.diff(self.first))
        where = defaultdict(list)
        for p in hit.tolist() if enough.any() else ():
            owner = self.owner[self.begin[at[p]] : self.end[at[p]]]
            for k in dict.fromkeys(owner[enough[owner]].tolist()):
                where[k].append(p)
        out = []
        for k, starts in sorted(where.items()):
            item, text, last = self.words[self.first[k] : self.first[k + 1]].tolist(), [], -1
            for p in starts:  # the stretches under this item's seeds, with a gap that matches nothing between them
                if last >= 0 and p > last:
                    text.append(-1 - len(text))
                    last = -1
                text += words[max(p, last) if last >= 0 else p : p + self.least].tolist()
                last = p + self.least
            tiles = greedy_tiles(item, text, self.least)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * len(item):
                out.append((self.ids[k], covered / len(item), len(tiles), covered))
        return out


def _index_of(name: str, block, least: int) -> Items:
    """The index of a block, kept by a Python worker."""
    return worker_state(("benchmark", name), lambda: Items(*block.value, least))


def contamination(spark: SparkSession, items: list[tuple[int, str]], coverage: float = COVERAGE, least: int = SEED_WORDS) -> Callable:
    """A column function from whole texts (not null) to the benchmark items that they cover."""
    name = uuid.uuid4().hex
    block = spark.sparkContext.broadcast(([i for i, _ in items], [t or "" for _, t in items]))

    @F.pandas_udf(MATCH)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = _index_of(name, block, least)
        for b in batches:
            out = []
            sizes = np.r_[0, np.cumsum([len(t) for t in b])]
            for lo, hi in sub_batches(sizes):
                out += [index.matches(w, coverage) for w in tile_words(pa.array(b.iloc[lo:hi], type=pa.large_string()))]
            names = ("item_id", "coverage", "n_tiles", "n_words")
            yield pd.Series([[dict(zip(names, m)) for m in ms] for ms in out], dtype=object)

    return found


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """The number of blocks left, and the items (item_id, text) of the next, of about `block_chars` characters: one at a time."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        yield blocks - k - 1, [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, n_words for each document and item of which it holds at least `coverage`.

    Words are runs of letters and digits, in lower case. Items of under five words have no seed and match nothing, nor do null
    and empty texts. Repeated rows give rows each; empty tables give an empty result; other columns are ignored.
    """
    rows, out = text_rows(docs), None
    for more, block in benchmark_blocks(benchmark, block_chars):
        found = contamination(docs.sparkSession, block, coverage)
        hits = rows.select("doc_id", F.explode(found("text")).alias("m")).select("doc_id", "m.*")
        if more or out is not None:
            hits = written(hits)
        out = hits if out is None else out.unionByName(hits)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no benchmark item; nothing shuffles."""
    for more, block in benchmark_blocks(benchmark, block_chars):
        found = contamination(docs.sparkSession, block, coverage)
        docs = docs.where(F.size(found(F.coalesce(docs["text"], F.lit("")))) == 0)
        if more:
            docs = written(docs)
    return docs
