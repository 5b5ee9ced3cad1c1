"""Helpers that the training-data operators share: lineage cuts, column checks, and vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SUB_BATCH_BYTES = 1 << 20
SHINGLE_WORDS = 5


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, also set for checkpoints; a private one is made only where
    neither is set and driver and executors are one process. Elsewhere that is an error: not all could reach it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialises `df` in the shared checkpoint folder and drops its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *folders: str) -> DataFrame:
    """`df` as Parquet in the shared checkpoint folder: what is read again in parts, or is too wide for a checkpoint. It is laid
    out in a folder for each value of the columns named."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def text_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and text (null becomes empty), with the further columns named: extra columns never clash with an operator's own."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *keep)


def with_ids(docs: DataFrame) -> tuple[DataFrame, int | None]:
    """`docs` with an id of its own in place of each null doc_id, and the largest doc_id; None for it where none is null.

    New ids are above all others. Rows that get one are written, so that they have the same id however often they are read.
    """
    unknown = F.col("doc_id").isNull()
    seen = docs.agg(F.max("doc_id").cast("long").alias("top"), F.count(F.when(unknown, 1)).alias("n")).first()
    if not seen["n"]:
        return docs, None
    top = -1 if seen["top"] is None else seen["top"]
    given = written(docs.where(unknown).withColumn("doc_id", F.monotonically_increasing_id() + F.lit(top + 1).cast("long")))
    return docs.where(~unknown).unionByName(given), top


def without_ids(rows: DataFrame, top: int | None, *names: str) -> DataFrame:
    """`rows` with the ids of with_ids in the columns named (doc_id if none is) null again."""
    if top is None:
        return rows
    return rows.withColumns({name: F.when(F.col(name) <= top, F.col(name)) for name in names or ("doc_id",)})


_kept: dict = {}


def worker_state(owner: tuple, make):
    """What an operator keeps in a Python worker between batches and tasks. A worker serves many stages, but keeps the state of
    one owner at a time: that of the last who asked."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = make()
    return _kept[owner]


HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """`rows` joined to the one row that `groups` has for their keys, where `weight` is the group's number of rows.

    Groups with over a thousandth of the `total` rows are broadcast: they are under a thousand, whatever the data, and their
    rows do not shuffle, so no key is hot in the join of the others.
    """
    hot, cold = (groups.where(cond) for cond in (F.col(weight) * HOT_SHARE > total, F.col(weight) * HOT_SHARE <= total))
    few = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return few.unionByName(rows.join(F.broadcast(hot), keys))


def first_of_each(rows: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """`rows` with one row for each of the keys in `repeated` (those that several rows share); the others pass as they are."""
    if repeated.isEmpty():
        return rows
    marked = rows.join(repeated.select(*keys, F.lit(True).alias("_again")), keys, "left")
    again = marked.where("_again").dropDuplicates(keys)
    return marked.where(F.col("_again").isNull()).unionByName(again).drop("_again").select(*rows.columns)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLDEN)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so its powers have inverses modulo 2**64
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, kept between calls."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def utf8_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each text starts in them (one more entry than texts); no copy is made."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def sub_batches(starts: np.ndarray, most: int = SUB_BATCH_BYTES):
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) of some texts, and the index of each word's text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    inner = starts[:-1][starts[:-1] < n]
    before[inner] = False
    first = np.flatnonzero(solid & ~before)
    ends_text = np.zeros(n + 1, dtype=bool)
    ends_text[starts[1:]] = True
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    last = np.flatnonzero(solid & (~after | ends_text[1:])) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    hashes = mix64((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * GOLDEN)
    return hashes, np.searchsorted(starts, first, side="right") - 1


def shingle_hashes(words: np.ndarray, texts: np.ndarray, n_texts: int, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their texts' indexes; a text of 1 to k-1 words is one shingle."""
    multipliers = mix64((np.arange(k, dtype=np.uint64) + np.uint64(7)) * GOLDEN) | np.uint64(1)
    out, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        m = len(words) - k + 1
        total = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            total += words[j : j + m] * multipliers[j]
        same = texts[:m] == texts[k - 1 :]
        out, of = mix64(total[same]), texts[:m][same]
    counts = np.bincount(texts, minlength=n_texts) if len(texts) else np.zeros(n_texts, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begins = np.searchsorted(texts, short)
        extra = np.array([mix64(np.array([sum(int(w) * int(c) for w, c in zip(words[b : b + counts[t]], multipliers)) + int(counts[t]) & (1 << 64) - 1], dtype=np.uint64))[0] for b, t in zip(begins, short)], dtype=np.uint64)
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)
