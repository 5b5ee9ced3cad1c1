"""Which works hold which passages, for passages of any length, as equi-joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import once

WORDS = 1 << 20  # about as many at a time in a task
BUCKET = 1 << 15  # bits of a row of the filter: those of bitmap_construct_agg
LEAST_BITS, MOST_BITS, BITS_A_HEAD = 1 << 16, 1 << 28, 32  # of the filter: 32 MiB at most


def spaced(units: Column) -> Column:
    """Units between blanks, so that containment of strings is that of whole units."""
    return F.concat(F.lit(" "), F.array_join(units, " "), F.lit(" "))


def mixed(a: np.ndarray, b: np.ndarray, factor: int) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = (a * np.uint64(factor)) ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _levels(words: np.ndarray, levels: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each of the levels the two hashes of the 2**level words from every place on."""
    g, h = words, mixed(words, words, 0xD6E8FEB86659FD93)
    for level in range(max(levels, default=-1) + 1):
        if level in levels:
            yield level, g, h
        step = 1 << level
        if step >= len(g):
            return
        g, h = mixed(g[:-step], g[step:], 0xFF51AFD7ED558CCD), mixed(h[:-step], h[step:], 0xC4CEB9FE1A85EC53)


BYTES = mixed(np.arange(256, dtype=np.uint64), np.arange(256, dtype=np.uint64), 0x9FB21C651E98DF25)  # a hash for each


def _words(column: pa.Array) -> np.ndarray:
    """The hashes of all units of a column in one array: lists hold theirs, a binary's units are its bytes."""
    if not pa.types.is_binary(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return BYTES[data]


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with their words in one array, and where each row ends in it."""
    words = batch.column("w")
    sizes = pc.binary_length(words).to_numpy().astype(np.int64) if pa.types.is_binary(words.type) else np.diff(words.offsets.to_numpy()).astype(np.int64)
    part = np.cumsum(sizes) // WORDS
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1) if len(sizes) else ():
        some = batch.slice(rows[0], len(rows))
        yield some, _words(some.column("w")), np.cumsum(sizes[rows])


def _whole(head: np.ndarray, tail: np.ndarray, n: np.ndarray | int, factor: int) -> np.ndarray:
    """The hash of n units by those of the first and the last of them."""
    return mixed(head + np.asarray(n, np.uint64), tail, factor)


G, H = 0xA24BAED4963EE407, 0xE7037ED1A0B428DB


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _asked_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages with their level (that of the largest power of two in their length), the hash of their first words, and two of all."""
    for batch in batches:
        for some, words, ends in pieces(batch):
            sizes = np.diff(ends, prepend=0)
            level = np.int32(np.floor(np.log2(sizes)))
            out = np.zeros((3, len(sizes)), np.uint64)
            for k, g, h in _levels(words, sorted(set(level.tolist()))):
                at = np.flatnonzero(level == k)
                first, last = (ends - sizes)[at], ends[at] - (1 << k)
                out[0, at], out[1, at], out[2, at] = g[first], _whole(g[first], g[last], sizes[at], G), _whole(h[first], h[last], sizes[at], H)
            kept = some.drop_columns(["w"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes), pa.array(level), *map(_signed, out)], [*kept.schema.names, "n", "level", "head", "g", "h"])


def _places(levels: list[int], held, n_bits: int, lengths: dict[int, list[int]] | None = None):
    """Rows of texts to the passages that the filter may hold: pos, n, g, h, one place of each a text. A passage of a level has
    2**level words or one of the `lengths` named for it; its head is looked for first, and only from there on the whole."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, last = np.frombuffer(held.value, np.uint8), np.uint64(n_bits - 1)
        has = lambda x: (bits[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
        for batch in batches:
            for some, words, ends in pieces(batch):
                sizes = np.diff(ends, prepend=0)
                row, kept = np.repeat(np.arange(len(sizes)), sizes), some.drop_columns(["w"])
                for level, g, h in _levels(words, levels):
                    heads = np.flatnonzero(has(g & last))
                    heads = heads[has((g[heads] >> np.uint64(32)) & last)]
                    for n in (lengths or {}).get(level, [1 << level]):
                        at = heads[heads + n <= ends[row[heads]]]
                        tail = at + n - (1 << level)
                        whole = _whole(g[at], g[tail], n, G)
                        may = np.flatnonzero(has(whole & last))
                        may = may[has((whole[may] >> np.uint64(32)) & last)]
                        if not len(may):
                            continue
                        at, tail, whole = at[may], tail[may], whole[may]
                        order = np.lexsort((at, whole, row[at]))
                        at, tail, whole = at[order], tail[order], whole[order]
                        new = np.append(True, (np.diff(row[at]) != 0) | (whole[1:] != whole[:-1]))
                        at, tail, whole = at[new], tail[new], whole[new]
                        told = kept.take(pa.array(row[at]))
                        pos = (at - (ends - sizes)[row[at]]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [*told.columns, pa.array(pos), pa.array(np.full(len(at), n, np.int64)), _signed(whole), _signed(_whole(h[at], h[tail], n, H))], [*told.schema.names, "pos", "n", "g", "h"]
                        )

    return of


def _filter(heads: DataFrame, n: int) -> tuple[bytearray, int]:
    """A Bloom filter of the column g, of two bits each, and its size; only its rows of bits come to the driver."""
    n_bits = LEAST_BITS
    while n_bits < min(MOST_BITS, BITS_A_HEAD * n):
        n_bits *= 2
    probe = F.explode(F.array(*(F.shiftrightunsigned("g", k).bitwiseAND(F.lit(n_bits - 1)) for k in (0, 32)))).alias("bit")
    rows = heads.select(probe).groupBy(F.floor(F.col("bit") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % BUCKET).alias("bits")).collect()
    held = bytearray(n_bits // 8)
    for r in rows:
        held[r["bucket"] * BUCKET // 8 : (r["bucket"] + 1) * BUCKET // 8] = r["bits"]
    return held, n_bits


KEY = ["n", "g", "h"]  # of a passage


def _hashes(units: Column, df: DataFrame, name: str) -> Column:
    """The units of a column as those of `_words`: a string's are its bytes."""
    whole = df.schema[name].dataType.simpleString() == "string"
    return (F.encode(units, "utf-8") if whole else F.transform(units, lambda x: F.xxhash64(x))).alias("w")


def _types(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names)


def keyed(passages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns named, level, head and KEY of passages (passage, an array of units or a string); those without units go."""
    size = F.length if passages.schema["passage"].dataType.simpleString() == "string" else F.size
    named = passages.where(size("passage") > 0).select(*keep, _hashes(F.col("passage"), passages, "passage"))
    return named.mapInArrow(_asked_hashes, f"{_types(named, keep)}n long, level int, head long, g long, h long")


def holders(works: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, the keys and KEY: each passage of `asked` (rows of `keyed`, which are read several times) that a work (doc_id, the
    keys, unit) may have, a row a text and passage; the wrong ones are left out by a join with `asked` on KEY and the keys.

    A passage of n units has as its head the first 2**k of them and as its tail the last 2**k, for the largest 2**k up to n: head and
    tail cover it, so a work has it where it has both at their distance. Hashes of 128 bits of the 2**k units at all places of a
    text come by doubling. A filter of all heads and of all passages drops nearly all places in the task that reads the text, so
    neither texts nor places leave it, and what does grows with the passages that texts have, not with those that begin alike.
    """
    lengths: dict[int, list[int]] = {}
    for r in asked.select("level", "n").distinct().orderBy("n").collect():  # at most the length of the longest passage
        lengths.setdefault(r["level"], []).append(r["n"])
    size = F.length if works.schema["unit"].dataType.simpleString() == "string" else F.size
    texts = works.where(F.col("doc_id").isNotNull()).select("doc_id", *keys, _hashes(F.col("unit"), works, "unit")).where(size("w") > 0)
    both = asked.select(F.explode(F.array("head", "g")).alias("g")).distinct()
    held, n_bits = _filter(both, both.count())
    found = _places(sorted(lengths), works.sparkSession.sparkContext.broadcast(bytes(held)), n_bits, lengths)
    return texts.mapInArrow(found, f"{_types(texts, ['doc_id', *keys])}pos int, n long, g long, h long").select("doc_id", *keys, *KEY)


def occurrences(works: DataFrame, passages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """passage, doc_id and the keys: each passage (passage, an array of units, or a string) with each work (doc_id, unit, of the same
    type) that has it, unit for unit, or as a part of the string, whose units are its bytes; where `keys` are named, columns of both, only works with the passage's keys.

    Equal passages are asked for once. One without units is nowhere; null ids and keys match nothing.
    """
    keys = keys or []
    named = passages
    for k in keys:
        named = named.where(F.col(k).isNotNull())
    asked = once(keyed(named.select("passage", *keys).distinct(), ["passage", *keys]))
    found = holders(works, asked, keys).distinct()
    return found.join(asked.select("passage", *keys, *KEY), [*KEY, *keys]).select("passage", "doc_id", *keys)
