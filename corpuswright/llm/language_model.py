"""Interpolated modified Kneser-Ney n-gram models, counted by Spark and scored from sorted, memory-mapped hash arrays.

Counting. Tokens are 64-bit hashes of words, and an n-gram is a row of such hashes. A task counts its texts' n-grams in portions
of bounded size and sends each bucket of the hash space one packed row. A bucket knows all about its n-grams: it stores them,
and passes on what they add to their contexts (total, and how many continuations occurred once, twice or more often), to the
continuation counts of the n-grams one word shorter, and to the counts of tokens. These go by their own hashes, summed up in the
bucket first. So a frequent word or line is a few packed numbers a bucket and no key is hot. The number of buckets grows with
the text; past FAN of them rows go by coarse buckets first, whose parts are merged and dealt again, so rows stay large.

Model. A bucket is a range of hashes, stored as a file of sorted hashes and one of counts in the shared folder. The files of a
bucket are replaced in one step and do not depend on the order of rows, so a task may run twice. Workers map the files into
memory, and look up the distinct n-grams of a few megabytes of text at a time, in sorted order. Where the folder is not a
mounted one, a worker maps an unlinked copy.

The counts of n-grams that begin a text are those of their occurrences; of others below the highest order, of the distinct words
before them. Discounts are those of Chen and Goodman (1999), by counts of counts; where a small corpus has none of some count,
0.5, 1 and 1.5. The unigram level interpolates with equal shares for all known words and one unknown.
"""

from __future__ import annotations

import io
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, IS_SPACE, mix64, shared_folder, utf8_buffers, word_hashes, worker_state, written

ORDER = 2
BEGIN, END = mix64(np.array([0x5EED0001, 0x5EED0002], dtype=np.uint64) * GOLDEN)
CHUNK_BYTES = 1 << 20
PORTION_TOKENS = 2 << 20
BUCKET_BYTES = 16 << 20
FAN = 512
GRAM, CONTEXT, TOKEN, STATS = range(4)
PACKED = "kind int, level int, bucket int, keys binary, sums binary"
WIDTHS = {GRAM: 1, CONTEXT: 4, TOKEN: 1}
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fold(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams given as columns of word hashes; that of one word is the word's."""
    h = words[0]
    for w in words[1:]:
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + w + GOLDEN)
    return h


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of equal width, so that sorted hashes are in order of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def merged(words: list[np.ndarray], sums: list[np.ndarray]):
    """Sorted distinct hashes of n-grams, their columns, and their sums."""
    h = fold(words)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    added = [np.add.reduceat(s[order], first) if len(first) else s for s in sums]
    return h[first], [w[order[first]] for w in words], added


def _packed(kind: int, level: int, words, sums, buckets: int, width: int = 1):
    """One row a bucket (or a run of `width` buckets) of merged n-grams. Rows go by last word, as equal ones compress."""
    h, words, sums = merged(words, sums)
    of = bucket_of(h, buckets) // width
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(of)]):
        by = lo + np.argsort(words[-1][lo:hi]) if level > 1 else slice(lo, hi)
        numbers = np.concatenate([s[by] for s in sums])
        yield kind, level, int(of[lo]), np.concatenate([w[by] for w in words]).tobytes(), numbers.astype(np.min_scalar_type(int(numbers.max()))).tobytes()


def _unpacked(kind: int, level: int, keys, sums) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Columns of word hashes and of sums, of several packed rows of a kind."""
    columns, n_sums = level if kind == GRAM else 1, WIDTHS[kind]
    words, numbers = [[] for _ in range(columns)], [[] for _ in range(n_sums)]
    for k, s in zip(keys, sums):
        w = np.frombuffer(k, dtype=np.uint64)
        n = len(w) // columns
        v = np.frombuffer(s, dtype=np.dtype(f"u{len(s) // (n * n_sums)}"))
        for i in range(columns):
            words[i].append(w[i * n : (i + 1) * n])
        for i in range(n_sums):
            numbers[i].append(v[i * n : (i + 1) * n])
    return [np.concatenate(x) for x in words], [np.concatenate(x, dtype=np.int64) for x in numbers]


def _batches(rows, most: int = 8):
    """Arrow batches of packed rows, a few at a time."""
    held = []
    names = ["kind", "level", "bucket", "keys", "sums"]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def token_chunks(texts: pa.Array, chunk: int = CHUNK_BYTES):
    """(hashes, text indexes) of a bounded number of bytes at a time: of each text BEGIN, its words in lower case, and END.

    A text may go on in the next chunk; a chunk ends at white space or where a text ends, so words stay whole.
    """
    raw, starts = utf8_buffers(texts)
    lo, n, n_texts = 0, len(raw), len(starts) - 1
    solid_end = np.where(starts[1:] > starts[:-1], starts[1:] - 1, starts[:-1])  # the byte with which a text's END comes
    while lo < n or (n == 0 and lo == 0 and n_texts):
        hi = min(n, lo + chunk)
        until = int(starts[np.searchsorted(starts, hi)])  # the next text, where white space does not come first
        while hi < until:
            blank = np.flatnonzero(IS_SPACE[raw[hi : min(hi + 4096, until)]])
            if len(blank):
                hi += int(blank[0])
                break
            hi = min(hi + 4096, until)
        last = hi >= n
        first_text = np.searchsorted(starts, lo, side="right") - 1
        last_text = max(first_text, np.searchsorted(starts, hi, side="left"))
        inner = np.clip(starts[first_text : last_text + 1], lo, hi) - lo
        inner = np.r_[inner, hi - lo] if inner[-1] < hi - lo else inner
        words, of = word_hashes(LOWER[raw[lo:hi]], inner)
        of = of + first_text
        begins = np.flatnonzero((starts[:-1] >= lo) & ((starts[:-1] < hi) | last))
        ends = np.flatnonzero((solid_end >= lo) & ((solid_end < hi) | last))
        order = np.argsort(np.concatenate([of * 3 + 1, begins * 3, ends * 3 + 2]), kind="stable")
        hashes = np.concatenate([words, np.full(len(begins), BEGIN), np.full(len(ends), END)])[order]
        yield hashes, np.concatenate([of, begins, ends])[order]
        lo = hi
        if last:
            return


def grams_ending(texts: pa.Array, order: int, chunk: int = CHUNK_BYTES):
    """For each chunk of tokens: their hashes and texts, how many of the order - 1 tokens before each are its text's, and the
    columns of those tokens, nearest first."""
    held, held_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for hashes, of in token_chunks(texts, chunk):
        all_, all_of = np.concatenate([held, hashes]), np.concatenate([held_of, of])
        at = len(held) + np.flatnonzero(hashes != BEGIN)
        before, known = [], np.zeros(len(at), np.int64)
        for k in range(1, order):
            place = np.maximum(at - k, 0)
            known += (at - k >= 0) & (all_of[place] == all_of[at])
            before.append(all_[place])
        yield all_[at], all_of[at], known, before
        held, held_of = all_[len(all_) - order + 1 :] if order > 1 else held, all_of[len(all_) - order + 1 :] if order > 1 else held_of


def _count(order: int, buckets: int, width: int, portion: int):
    def run(batches):
        parts: dict[int, list] = {}
        n = 0

        def flush():
            for level, found in parts.items():
                columns = [np.concatenate(c) for c in zip(*found)]
                found.clear()
                if len(columns[0]):
                    yield from _packed(GRAM, level, columns, [np.ones(len(columns[0]), np.int64)], buckets, width)
            parts.clear()

        for b in batches:
            for last, _, known, before in grams_ending(b.column("text"), order):
                for level in range(1, order + 1):
                    mine = known == level - 1  # fewer than order - 1 only where the text's BEGIN is the first
                    if level == order or mine.any():
                        parts.setdefault(level, []).append([*(c[mine] for c in before[: level - 1][::-1]), last[mine]])
                n += len(last)
                if n >= portion:
                    yield from _batches(flush())
                    n = 0
        yield from _batches(flush())

    return run


def _deal_again(buckets: int, portion: int):
    """Packed rows of coarse buckets merged, as many as fit a portion, and dealt to the buckets proper."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        n = 0

        def flush():
            for (kind, level), rows in held.items():
                yield from _packed(kind, level, *_unpacked(kind, level, *zip(*rows)), buckets)
            held.clear()

        for b in batches:
            for row in b.to_pylist():
                if row["kind"] == STATS:
                    yield pa.RecordBatch.from_pylist([row], schema=b.schema)
                    continue
                held.setdefault((row["kind"], row["level"]), []).append((row["keys"], row["sums"]))
                n += len(row["keys"]) // 8
                if n >= portion:
                    yield from _batches(flush())
                    n = 0
        yield from _batches(flush())

    return run


def _local(folder: str) -> str | None:
    """The path of a mounted folder, None for another store."""
    where = urlparse(folder)
    return unquote(where.path) if where.scheme in ("", "file") else None


def _store(folder: str, name: str, array: np.ndarray) -> None:
    """A file of the model, there as a whole or not at all."""
    path, mark = _local(folder), f".{uuid.uuid4().hex}"
    if path is not None:
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{mark}", "wb") as f:
            np.save(f, array)
        os.replace(f"{path}/{mark}", f"{path}/{name}.npy")
        return
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    data = io.BytesIO()
    np.save(data, array)
    with fs.open_output_stream(f"{path}/{mark}") as f:
        f.write(data.getbuffer())
    fs.move(f"{path}/{mark}", f"{path}/{name}.npy")


def _mapped(folder: str, name: str) -> np.ndarray | None:
    """A file of the model, memory-mapped; None where a bucket is empty."""
    path = _local(folder)
    try:
        if path is not None:
            return np.load(f"{path}/{name}.npy", mmap_mode="r")
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{path}/{name}.npy") as source, tempfile.NamedTemporaryFile(suffix=".npy") as copy:
            shutil.copyfileobj(source, copy)
            copy.flush()
            return np.load(copy.name, mmap_mode="r")  # stays mapped when the name is gone
    except FileNotFoundError:
        return None


def _settle(level: int, order: int, buckets: int, width: int, folder: str):
    """A bucket's n-grams of one level: stored, and what they add to contexts, shorter n-grams and tokens as packed rows. Those
    of lower levels wait; sums of contexts and tokens are stored."""

    def emit(kind: int, mine: int, at: int, rows):
        words, sums = _unpacked(kind, mine, rows["keys"], rows["sums"])
        if kind == GRAM and mine < level:
            yield from _packed(GRAM, mine, words, sums, buckets, width)
            return
        h, words, sums = merged(words, sums)
        name = f"{kind}-{mine}-{at}"
        most = max(int(s.max()) for s in sums)
        _store(folder, f"{name}-sums", np.stack(sums).astype(np.min_scalar_type(most)))
        _store(folder, f"{name}-keys", h)
        if kind != GRAM:
            return
        count = sums[0]
        of_count = [(count == k).astype(np.int64) for k in (1, 2, 3, 4)]
        counted = np.ones(len(count), bool) if level == order else words[0] == BEGIN  # once for each occurrence of the last word
        told = [int(x.sum()) for x in of_count] + [int(count.sum()), len(count), int(count[counted].sum())]
        yield STATS, mine, at, np.array(told, np.int64).tobytes(), b""
        more = (count > 2).astype(np.int64)
        if counted.any():
            yield from _packed(TOKEN, 1, [words[-1][counted]], [count[counted]], buckets, width)
        if mine > 1:
            yield from _packed(CONTEXT, mine, [fold(words[:-1])], [count, of_count[0], of_count[1], more], buckets, width)
            yield from _packed(GRAM, mine - 1, words[1:], [np.ones(len(count), np.int64)], buckets, width)

    def run(key, table):
        kind, mine, at = (k.as_py() for k in key)
        rows = {c: [x.as_buffer() for x in table.column(c)] for c in ("keys", "sums")}
        out = list(_batches(emit(kind, mine, at, rows)))
        empty = pa.schema([("kind", pa.int32()), ("level", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
        return pa.Table.from_batches(out, schema=empty)

    return run


def in_training_part():
    """Rows to learn from: crc32 of the doc_id as text, modulo 7, is not 2; also rows without doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))


def _discounts(stats: dict) -> list[float]:
    """What is taken from counts of 0, 1, 2 and more."""
    n1, n2, n3, n4 = stats["counts"]
    if not n1 or not n2:
        return [0.0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [0.0, *(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))]


def fit(docs: DataFrame, order: int = ORDER, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN, portion: int = PORTION_TOKENS) -> dict:
    """Counts the model of all `docs` (text; null is empty) into a folder of its own in the shared one, and returns its
    description: order, folder, buckets, tokens, vocabulary, and counts of counts and discounts by level. The sizes change no
    result."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // bucket_bytes))
    width = -(-buckets // fan)
    folder = f"{shared_folder(spark)}/language-model-{uuid.uuid4().hex}"

    def brought(rows: DataFrame) -> DataFrame:
        if width == 1:
            return rows
        parted = rows.repartition(buckets, "kind", "bucket", F.pmod(F.xxhash64("keys"), F.lit(width)))
        return parted.mapInArrow(_deal_again(buckets, portion), PACKED)

    rows, sums, stats = texts.mapInArrow(_count(order, buckets, width, portion), PACKED), None, {}
    tokens = 0
    for level in range(order, 0, -1):
        settle = _settle(level, order, buckets, width, folder)
        done = written(brought(rows).groupBy("kind", "level", "bucket").applyInArrow(settle, PACKED))
        kept = [np.frombuffer(r["keys"], np.int64) for r in done.where(F.col("kind") == STATS).select("keys").toLocalIterator()]
        total = sum(kept, np.zeros(7, np.int64)).tolist()
        stats[level] = {"counts": total[:4], "total": total[4], "distinct": total[5]}
        stats[level]["discounts"] = _discounts(stats[level])
        tokens += total[6]
        rows = done.where((F.col("kind") == GRAM) & (F.col("level") < level))
        mine = done.where(F.col("kind").isin(CONTEXT, TOKEN))
        sums = mine if sums is None else sums.unionByName(mine)
    brought(sums).groupBy("kind", "level", "bucket").applyInArrow(_settle(0, order, buckets, width, folder), PACKED).count()
    return {"order": order, "folder": folder, "buckets": buckets, "tokens": tokens, "vocabulary": stats[1]["distinct"], "levels": stats}


class Lookup:
    """The model's files as a worker sees them; each is mapped when it is first asked for."""

    def __init__(self, model: dict):
        self.model, self.files = model, {}

    def __call__(self, kind: int, level: int, hashes: np.ndarray) -> list[np.ndarray]:
        """Sums of the hashes, zeros where there are none."""
        asked, back = np.unique(hashes, return_inverse=True)
        out = np.zeros((WIDTHS[kind], len(asked)), dtype=np.int64)
        of = bucket_of(asked, self.model["buckets"])
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(of)]):
            name = f"{kind}-{level}-{of[lo]}"
            if name not in self.files:
                self.files[name] = tuple(_mapped(self.model["folder"], f"{name}-{x}") for x in ("keys", "sums"))
            keys, sums = self.files[name]
            if keys is None:
                continue
            at = np.minimum(np.searchsorted(keys, asked[lo:hi]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == asked[lo:hi])
            out[:, lo + hit] = sums[:, at[hit]]
        return list(out[:, back])

    def probabilities(self, last: np.ndarray, known: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        """The model's probability of each token after the `known` ones of its text before it."""
        one = self.model["levels"][1]
        d, total = np.array(one["discounts"]), one["total"]
        n1, n2 = one["counts"][:2]
        left = d[1] * n1 + d[2] * n2 + d[3] * (one["distinct"] - n1 - n2)
        (count,) = self(GRAM, 1, last)
        p = (count - d[np.minimum(count, 3)]) / max(total, 1) + (left / total if total else 1.0) / (self.model["vocabulary"] + 1)
        for level in range(2, self.model["order"] + 1):
            mine = np.flatnonzero(known >= level - 1)
            context = [c[mine] for c in before[: level - 1][::-1]]
            total, n1, n2, more = self(CONTEXT, level, fold(context))
            (count,) = self(GRAM, level, fold([*context, last[mine]]))
            d = np.array(self.model["levels"][level]["discounts"])
            met = np.flatnonzero(total > 0)
            at, c = mine[met], count[met]
            p[at] = (c - d[np.minimum(c, 3)] + (d[1] * n1 + d[2] * n2 + d[3] * more)[met] * p[at]) / total[met]
        return p


def _score(model: dict):
    def run(batches):
        look = worker_state(("language model", model["folder"]), lambda: Lookup(model))
        for b in batches:
            n = b.num_rows
            sums = {k: np.zeros(n) for k in ("n_tokens", "n_known", "base_score", "score")}
            for last, of, known, before in grams_ending(b.column("text"), model["order"]):
                (count,) = look(TOKEN, 1, last)
                p = look.probabilities(last, known, before)
                base = np.log10((count + 1) / (model["tokens"] + model["vocabulary"] + 1))
                for name, w in (("n_tokens", None), ("n_known", count > 0), ("base_score", base), ("score", np.log10(p))):
                    sums[name] += np.bincount(of, w, minlength=n)
            tokens = sums["n_tokens"].astype(np.int64)
            columns = [
                b.column("doc_id"), b.column("held_out"), pa.array(tokens), pa.array(sums["n_known"].astype(np.int64)),
                pa.array(np.full(n, model["tokens"], np.int64)), pa.array(sums["base_score"]), pa.array(sums["score"]),
                pa.array(10.0 ** (-sums["score"] / np.maximum(tokens, 1))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text, where it lies.

    Tokens are words (runs without ASCII white space, A to Z in lower case) and one end. `score` is the model's log10 probability
    of the text, `base_score` that of counts plus one; perplexity is a token's. A null text is an empty one, which is its end only.
    Repeated rows give a row each; a null doc_id stays null and is not held out. Against a model of no text every token has
    probability 1. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), (~in_training_part()).alias("held_out"))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return rows.mapInArrow(_score(model), out)
