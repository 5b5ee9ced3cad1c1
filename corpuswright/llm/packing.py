"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they lie; what shuffles is one narrow row a piece. Pieces are dealt by hash into groups of about
`group_tokens` tokens, so that the number of groups follows the data, and every group is packed by bounded-space online
best fit: at most `open_bins` bins are open, a bitset keyed by free space finds the fullest bin that still takes a piece, and
when a new bin is needed at the bound, the fullest open one closes. A group's pieces arrive in order of a hash, through a
buffer that hands on LOOK_AHEAD of them longest first: on the lengths of the documents 256 bins then do as well as any number
without the bound, where a group sorted as a whole would need all its bins at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, cut, mix64, text_rows, worker_state

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1
LOOK_AHEAD = 2048
OPEN_BINS = 256
GROUP_ROWS = 1 << 18
CACHE_WORDS = 450_000
_MARKS = ".,;:!?%&$#*|"


def _encoder(path: str):
    """The tokenizer and its cache of words, kept by a Python worker."""

    def make():
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(path), {"": b""}

    return worker_state(("packing", path), make)


def _parts(word: str) -> tuple[str, str]:
    """The letters of a word and the marks after them, if that is all it has and the tokenizer can be given them apart.

    Its pattern never joins letters with marks, and it lowers case letter by letter, so the parts' ids are the word's. Letters
    beyond Latin Extended-A are left to the tokenizer, as part of the whole word.
    """
    core = word.rstrip(_MARKS)
    if core.isalpha() and (core.isascii() or (max(core) <= "\u017f" and "\u0130" not in core)):
        return core.lower(), word[len(core) :]
    return "", word


def _encode_letters(tokenizer, words: list[str]) -> Iterator[bytes]:
    """The ids of words of letters only, which the tokenizer sees as one pre-token each, many in one call."""
    for lo in range(0, len(words), 4096):
        part = words[lo : lo + 4096]
        found = tokenizer.encode(" ".join(part), add_special_tokens=False)
        number = np.array(found.word_ids, dtype=np.int64)
        begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        if len(begin) != len(part):
            raise ValueError("the tokenizer splits letters otherwise than its pattern says")
        blob = np.array(found.ids, dtype="<u4").tobytes()
        edges = [4 * k for k in begin.tolist()] + [len(blob)]
        for i, j in zip(edges, edges[1:]):
            yield blob[i:j]


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, as the tokenizer gives them with add_special_tokens=False.

    The tokenizer splits at white space and drops it, so a text's ids are its words' ids in a row; each distinct word is
    encoded once and kept. Only space and line feed are cut at here; other white space is left to the tokenizer itself. A text
    is lowered as a whole unless it has a sigma (the one letter whose lower case depends on its place) or may spell a special
    token, which only counts in lower case.
    """
    tokenizer, cache = _encoder(path)
    low = [t if "\u03a3" in t or "<|" in t or "\u0130" in t else t.lower() for t in texts]
    split = [t.replace("\n", " ").split(" ") for t in low]
    new = set().union(*split) - cache.keys()
    if new:
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            cache[""] = b""
            new = set().union(*split) - cache.keys()
        parts = [(w, *_parts(w)) for w in new]
        letters = list({core for _, core, _ in parts} - cache.keys())
        cache.update(zip(letters, _encode_letters(tokenizer, letters)))
        rest = list({tail for _, _, tail in parts} - cache.keys())
        for w, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            cache[w] = np.array(e.ids, dtype="<u4").tobytes()
        for w, core, tail in parts:
            if core and w not in cache:
                cache[w] = cache[core] + cache[tail]
    get = cache.__getitem__
    for words in split:
        yield b"".join(map(get, words))


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int).

    A document's ids end with END_ID; a null or empty text has that one id. Only documents of over `capacity` ids are cut.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batches):
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 4_000_000):
                    size += len(texts[hi])
                    hi += 1
                rows = []
                for doc_id, blob in zip(ids[lo:hi], encode_texts(texts[lo:hi], path)):
                    blob += end
                    for k in range(0, len(blob), 4 * capacity):
                        part = blob[k : k + 4 * capacity]
                        row = (doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, np.frombuffer(part, dtype="<u4").astype(np.int32)) if with_ids else row)
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                lo = hi

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return text_rows(docs).mapInPandas(run, schema)


def arrival_order(rank: np.ndarray, lengths: np.ndarray, look_ahead: int = LOOK_AHEAD) -> np.ndarray:
    """Pieces by rank, those in the buffer longest first."""
    by_rank = np.argsort(rank, kind="stable")
    return by_rank[np.lexsort((-lengths[by_rank], np.arange(len(rank)) // look_ahead))]


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bin and the offset of each length in turn.

    The bitset has bit f where an open bin has f free; the lowest set bit from a length on is the fullest bin that takes it.
    """
    if any(n > capacity for n in lengths):
        raise ValueError("a piece is longer than a sequence")
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, n_open, made = 0, 0, 0
    bins, offsets = [], []
    for n in lengths:
        fitting = bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                bits ^= 1 << free
            n_open -= 1
        else:
            if n_open >= open_bins:  # the fullest closes
                fullest = (bits & -bits).bit_length() - 1
                by_free[fullest].pop()
                if not by_free[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            b, free = made, capacity
            made += 1
        bins.append(b)
        offsets.append(capacity - free)
        left = free - n
        if left:
            by_free[left].append(b)
            bits |= 1 << left
            n_open += 1
    return bins, offsets


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group_tokens: int = 1 << 23) -> DataFrame:
    """Adds sequence_id and offset to narrow piece rows (doc_id, piece, length, ...); offsets in a sequence are gapless from 0.

    Equal rows (a repeated doc_id) are each placed. Group numbers come from a hash of the row's key, and order within a group
    is total up to equal rows, so a lost task that runs again places alike. Rows without doc_id, be they a third of all, are
    dealt by their number in `pieces`, which is then a written table, so that they have it however often they are read. A group has about `group_tokens` tokens and at most
    about GROUP_ROWS rows, however short texts are.
    """
    size = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-size["n"] // group_tokens), -(-size["rows"] // GROUP_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "length"], kind="stable", ignore_index=True)
        key = pdf["doc_id"].fillna(-1).to_numpy(np.int64).view(np.uint64) * GOLDEN + pdf["piece"].to_numpy(np.int64).view(np.uint64)
        pdf = pdf.iloc[arrival_order(mix64(key), pdf["length"].to_numpy())].reset_index(drop=True)
        bins, offsets = best_fit(pdf["length"].tolist(), capacity, open_bins)
        pdf["sequence_id"] = pdf["packing_group"].astype("int64") * (1 << 40) + np.array(bins, dtype=np.int64)
        pdf["offset"] = np.array(offsets, dtype=np.int64)
        return pdf.drop(columns="packing_group")

    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    keyed = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", number), F.lit(groups)))
    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return keyed.groupBy("packing_group").applyInPandas(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    Null and empty texts are documents of one id. An empty table gives an empty result; columns other than doc_id and text
    are ignored.
    """
    pieces = cut(tokenize_pieces(docs, path, capacity))
    return place_pieces(pieces, capacity, open_bins)


def assemble(docs: DataFrame, placed: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids and doc_ids (one a token) of the packed sequences; no group has over `capacity` tokens."""
    ids = tokenize_pieces(docs, path, capacity, with_ids=True).select("doc_id", "piece", "ids")
    parts = placed.select("sequence_id", "offset", "doc_id", "piece").join(ids, ["doc_id", "piece"])
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return ordered.select(
        "sequence_id",
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.flatten(F.transform("parts", lambda p: F.array_repeat(p["doc_id"], F.size(p["ids"])))).alias("doc_ids"),
    )
