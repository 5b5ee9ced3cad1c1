"""Hard negatives by blocked dense matrix products.

Anchors are broadcast block by block (at most BLOCK_ROWS of them and about BLOCK_BYTES of numbers, whatever the table's size);
each block meets every candidate where it lies, a batch of candidates a matrix product. The first pass keeps the best positives
of each anchor per task: lists that merge into the anchor's own. The second pass, with the positives' scores broadcast beside
the block, keeps the best negatives within each positive's window. Only such short lists shuffle, and what one task holds is a
batch of candidates times a block of anchors.

Components are whole numbers, so products and sums in float64 are exact below 2**53. A batch whose numbers could pass that
(by the product of the vectors' lengths) is multiplied with Python's whole numbers instead.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

BLOCK_ROWS = 4096
BLOCK_BYTES = 32 << 20
BATCH_NUMBERS = 4 << 20  # of scores at a time
POSITIVES, NEGATIVES = 5, 3
EXACT = 2.0**53
SCALE = 256


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows; what is missing from a shorter one is zero."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors) if len(vectors) else np.zeros((0, width))
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as int64."""
    most = np.sqrt((rows**2).sum(axis=1).max(initial=0)) * np.sqrt((anchors**2).sum(axis=1).max(initial=0))
    if most < EXACT / 2:
        return (rows @ anchors.T).astype(np.int64)
    whole = [[int(x) for x in v] for v in rows.tolist()]
    by = [[int(x) for x in v] for v in anchors.tolist()]
    return np.array([[sum(map(int.__mul__, v, w)) for w in by] for v in whole], dtype=np.int64).reshape(len(whole), len(by))


def _best(scores: np.ndarray, open_: np.ndarray, k: int):
    """(row, column) of the k greatest open scores of each column, first rows first among equals; in k passes."""
    lowest = np.iinfo(np.int64).min
    left = np.where(open_, scores, lowest)
    for _ in range(min(k, len(left))):
        at = left.argmax(axis=0)
        columns = np.flatnonzero(np.take_along_axis(left, at[None, :], 0)[0] > lowest)
        if not len(columns):
            return
        yield at[columns], columns
        left[at[columns], columns] = lowest


def _merge(found: list, k: int) -> list:
    """The k best (score, id) of each list in one frame of columns list, id, row, score."""
    all_ = pd.DataFrame({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("list", "id", "row", "score"))})
    all_ = all_.sort_values(["list", "score", "id", "row"], ascending=[True, False, True, True], kind="stable")
    kept = all_[all_.groupby("list").cumcount() < k]
    return [tuple(kept[c].to_numpy() for c in ("list", "id", "row", "score"))]


COLUMNS = ["list", "id", "row", "score"]
LISTS = "list long, id long, row long, score long"


def _scan(shared, negatives: bool, width: int):
    """A pass over candidates: for each anchor its best positives, or for each of its positives the best negatives."""

    def run(batches):
        block = shared.value
        anchors, labels, own = block["vectors"], block["labels"], block["rows"]
        step = max(1, BATCH_NUMBERS // max(1, len(anchors)))
        k = NEGATIVES if negatives else POSITIVES
        found: list = []
        for b in batches:
            b = b.sort_values(["vec_id", "row"], kind="stable")
            for lo in range(0, len(b), step):
                part = b.iloc[lo : lo + step]
                ids, rows, mine = part["vec_id"].to_numpy(), part["row"].to_numpy(), part["label"].to_numpy()
                vectors = _matrix(part["vector"].tolist(), width)
                if negatives:
                    scores = products(vectors, anchors)
                    other = mine[:, None] != labels[None, :]
                    for slot in range(POSITIVES):
                        low, high = block["low"][slot], block["high"][slot]
                        inside = other & (scores >= low) & (scores <= high)
                        for at, columns in _best(scores, inside, k):
                            found.append((columns * POSITIVES + slot, ids[at], rows[at], scores[at, columns]))
                else:
                    for label in np.unique(mine):
                        here, there = np.flatnonzero(mine == label), np.flatnonzero(labels == label)
                        if not len(there):
                            continue
                        scores = products(vectors[here], anchors[there])
                        for at, columns in _best(scores, rows[here][:, None] != own[there][None, :], k):
                            found.append((there[columns], ids[here][at], rows[here][at], scores[at, columns]))
                if sum(len(f[0]) for f in found) > 4 * k * len(anchors) * (POSITIVES if negatives else 1):
                    found = _merge(found, k)
        if found:
            yield pd.DataFrame(dict(zip(COLUMNS, _merge(found, k)[0])))

    return run


def _first(lists: DataFrame, k: int) -> DataFrame:
    """list, rank (from 1), id, row, score: the k best of all tasks' lists."""
    best = F.struct((-F.col("score")).alias("less"), "id", "row")
    tops = lists.groupBy("list").agg(F.slice(F.sort_array(F.collect_list(best)), 1, k).alias("best"))
    out = tops.select("list", F.posexplode("best").alias("rank", "b"))
    return out.select("list", (F.col("rank") + 1).alias("rank"), "b.id", "b.row", (-F.col("b.less")).alias("score"))


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """row, vec_id, label, vector (whole numbers) of the rows that take part."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(whole)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), label.alias("label"), scaled.alias("vector"))


def hard_negatives(embeddings: DataFrame, vector: str = "embedding", every: int = 50, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (vec_id divisible by `every`).

    An anchor's positives are the first five other rows of its label by score (whole inner product), ties by smaller vec_id; the
    first three rows of other labels with 50 * positive_score <= 100 * score <= 95 * positive_score are a positive's negatives.
    Rows with a null label, vector or vec_id, or with any null or non-finite component, take no part. Vectors of different
    length are compared as if the shorter ended in zeros; empty vectors score 0. A repeated vec_id is a row of its own, as an
    anchor too (ties in all else go by the order of the table). A positive with no row in its window gives no row, nor does an
    anchor without positives; an empty table gives an empty result. A score beyond 64 bits is an error. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = written(usable(embeddings, vector))
    width = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    anchors = rows.where(F.col("vec_id") % every == 0)
    size = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width))))
    blocks = -(-anchors.count() // size)
    if not blocks:
        return spark.createDataFrame([], schema)
    dealt = written(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "block")
    out = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(out)
    for k in range(blocks):
        mine = dealt.where(F.col("block") == k).toPandas().sort_values("row")
        if not len(mine):
            continue
        block = {"vectors": _matrix(mine["vector"].tolist(), width), "labels": mine["label"].to_numpy(), "rows": mine["row"].to_numpy()}
        first = spark.sparkContext.broadcast(block)
        positives = _first(rows.mapInPandas(_scan(first, False, width), LISTS), POSITIVES).toPandas()
        if len(positives):
            low = np.full((POSITIVES, len(mine)), np.iinfo(np.int64).max)
            high, slot = np.full((POSITIVES, len(mine)), np.iinfo(np.int64).min), positives["rank"].to_numpy() - 1
            score = positives["score"].tolist()
            low[slot, positives["list"]] = [-(-50 * s // 100) for s in score]
            high[slot, positives["list"]] = [95 * s // 100 for s in score]
            second = spark.sparkContext.broadcast(block | {"low": low, "high": high})
            found = _first(rows.mapInPandas(_scan(second, True, width), LISTS), NEGATIVES)
            facts = pd.DataFrame({
                "list": positives["list"] * POSITIVES + slot, "anchor_id": mine["vec_id"].to_numpy()[positives["list"]],
                "positive_id": positives["id"], "positive_score": positives["score"],
            })
            told = found.join(F.broadcast(spark.createDataFrame(facts)), "list")
            told.select(
                "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
            ).write.mode("append").parquet(out)
            second.destroy()
        first.destroy()
    return spark.read.schema(schema).parquet(out)


ORACLE = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.vector, b.vector) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), p AS (
      SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.vec_id AS positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
    QUALIFY rank <= 3
"""
