"""Exact deduplication by two-pass Bloom filtering.

Pass one sets, for every row, a few cells of a counting filter whose cells stop at two; pass two probes it. A digest which
occurs twice has counted at least two in every one of its cells, so a row with a cell below two is certainly alone and goes
straight through: only the others shuffle. False positives cost a shuffled row and change nothing.

Size. The filter has `cells_per_row` cells a row up to `max_cells` (2**28: a bitmap of 32 MiB, the most that is broadcast at
once). More rows, over about 22 million, are filtered range by range of their hash: their digests are written in a folder a
range, and each range has a filter of its own, as many as the rows need, so that the share of unique rows that shuffle stays
the same at every size. Copies of a text,
be they a third of all rows, are pre-aggregated before the grouping shuffle, and large groups return to their rows by a
broadcast of bounded size.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, cut, first_of_each, join_groups, mix64, shared_folder, text_rows, with_ids, without_ids, written

WHITE_SPACE = " \t\n\x0b\x0c\r"
PROBES = 4
SEGMENT_BITS = 16


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES rows of cell numbers below 2**bits for the hashes."""
    h = mix64(h.astype(np.int64).view(np.uint64))
    step = mix64(h ^ GOLDEN) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    return np.stack([(h + step * np.uint64(i)) & mask for i in range(PROBES)])


def _count_cells(bits: int):
    def run(batches):
        parts = [_cells(b["h"].to_numpy(), bits) for b in batches if len(b)]
        if not parts:
            return
        # within a row equal cells count once: a key which meets itself is not a repeat
        own = np.sort(np.concatenate(parts, axis=1), axis=0)
        again = np.zeros(own.shape, dtype=bool)
        again[1:] = own[1:] == own[:-1]
        cells, counts = np.unique(own[~again], return_counts=True)
        segments, begins = np.unique(cells >> np.uint64(SEGMENT_BITS), return_index=True)
        low = (cells & np.uint64((1 << SEGMENT_BITS) - 1)).astype(np.uint16)
        for lo in range(0, len(segments), 4096):
            rows = []
            for s in range(lo, min(lo + 4096, len(segments))):
                part = slice(begins[s], begins[s + 1] if s + 1 < len(begins) else len(cells))
                rows.append((int(segments[s]), low[part][counts[part] == 1].tobytes(), low[part][counts[part] > 1].tobytes()))
            yield pd.DataFrame(rows, columns=["segment", "once", "more"])

    return run


def _merge_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << SEGMENT_BITS, dtype=np.int64)
    for column, weight in (("once", 1), ("more", 2)):
        total += weight * np.bincount(np.frombuffer(b"".join(pdf[column]), dtype=np.uint16), minlength=len(total))
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bitmap": [np.packbits(total >= 2, bitorder="little").tobytes()]})


def possibly_repeated(rows: DataFrame, h: str, n_rows: int, cells_per_row: int = 12, max_cells: int = 1 << 28):
    """A boolean column function for rows whose hash column may occur twice, never false for one that does; and its broadcast."""
    spark = rows.sparkSession
    bits = int(min(max(n_rows * cells_per_row, 1 << SEGMENT_BITS), max_cells) - 1).bit_length()
    bits = min(bits, int(max_cells - 1).bit_length())
    merged = (
        rows.select(F.col(h).alias("h"))
        .mapInPandas(_count_cells(bits), "segment long, once binary, more binary")
        .groupBy("segment")
        .applyInPandas(_merge_segment, "segment long, bitmap binary")
    )
    bitmap = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << SEGMENT_BITS) // 8
    for row in merged.toLocalIterator():
        bitmap[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.bitmap, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def probe(keys: pd.Series) -> pd.Series:
        cells = _cells(keys.to_numpy(), bits)
        hit = (shared.value[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return pd.Series(hit.all(axis=0))

    return probe, shared


def flag_repeated(digests: DataFrame, n_rows: int, cells_per_row: int = 12, max_cells: int = 1 << 28):
    """`digests` with `maybe`: whether their hash `h` may occur twice; and the filter's column function where there is one filter.
    One filter at a time is in the executors' memory."""
    ranges = -(-n_rows * cells_per_row // max_cells)
    if ranges <= 1:
        probe, _ = possibly_repeated(digests, "h", n_rows, cells_per_row, max_cells)
        return digests.withColumn("maybe", probe("h")), probe
    # the low bits choose the range, as all of them are mixed before they choose cells
    dealt = written(digests.withColumn("_range", F.pmod("h", F.lit(ranges)).cast("int")), "_range")
    flagged = f"{shared_folder(digests.sparkSession)}/{uuid.uuid4().hex}"
    for k in range(ranges):
        mine = dealt.where(F.col("_range") == k).drop("_range")  # one folder
        probe, shared = possibly_repeated(mine, "h", -(-n_rows // ranges), cells_per_row, max_cells)
        mine.withColumn("maybe", probe("h")).write.parquet(f"{flagged}/range={k}")
        shared.destroy()
    return digests.sparkSession.read.parquet(flagged).drop("range"), None


def _digest(text: Column) -> Column:
    return F.sha2(F.translate(text, WHITE_SPACE, ""), 256)


def exact_groups(docs: DataFrame, **filter_size: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs` (doc_id, text; other columns are ignored).

    Texts are equal when identical after all characters of [\\x20\\x09-\\x0D] are deleted; a null text is an empty one and
    empty texts equal each other. Of equal texts the row with most code points, then smallest doc_id, stays. A repeated
    doc_id gives a row each time, all pointing to the same keep_id. A row without doc_id stays only where no row of its group
    has one, and then one of them does; their keep_id is null. An empty table gives an empty result. `filter_size` sets
    cells_per_row and max_cells, which change no result.
    """
    known, top = with_ids(docs)
    return without_ids(_groups(known, top, **filter_size)[0], top, "doc_id", "keep_id")


def _groups(docs: DataFrame, top: int | None, **filter_size: int):
    """exact_groups of rows which all have a doc_id, those up to `top` before those above it; and the filter, if it is one."""
    digests = cut(
        text_rows(docs).select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            _digest(F.col("text")).alias("text_sha256"),
        ).withColumn("h", F.xxhash64("text_sha256"))
    )
    n_rows = digests.count()
    flagged, probe = flag_repeated(digests, n_rows, **filter_size)
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    some = flagged.where("maybe")
    own = F.lit(True) if top is None else F.col("doc_id") <= top
    groups = cut(some.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct(own.alias("own"), F.col("n_chars"), (-F.col("doc_id")).alias("id"))).alias("best")
    ).select("text_sha256", "group_size", (-F.col("best.id")).alias("keep_id")))
    grouped = join_groups(some, groups, ["text_sha256"], "group_size", n_rows).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped), probe


def drop_exact_copies(docs: DataFrame, **filter_size: int) -> DataFrame:
    """The rows of `docs` that exact_groups keeps, with all their columns; of rows that share id and text one stays.

    A row whose digest is alone in the filter stays where it lies. Only texts that may have copies meet the (narrow) list of
    what goes; past one filter's size all do.
    """
    docs, top = with_ids(docs)
    found, probe = _groups(docs, top, **filter_size)
    keys = ["_gone_id", "_gone_text"]
    some = cut(found.where("group_size > 1").select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_text"), "kept"))
    gone = some.where(~F.col("kept")).select(*keys).distinct()
    twice = some.where("kept").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    marked = docs.withColumns({"_gone_id": F.col("doc_id"), "_gone_text": _digest(F.coalesce(docs["text"], F.lit("")))})
    if probe is None:
        kept = first_of_each(marked.join(gone, keys, "left_anti"), keys, twice)
    else:
        maybe = probe(F.xxhash64("_gone_text"))
        kept = marked.where(~maybe).unionByName(first_of_each(marked.where(maybe).join(gone, keys, "left_anti"), keys, twice))
    return without_ids(kept.select(*docs.columns), top)
