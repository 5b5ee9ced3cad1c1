"""Merging of one work's records from several collections.

Records of one author whose bodies are the same, or of which one is a prefix of the other (an excerpt and the whole), are one
work, whose text is the longest. Prefixes stand directly before what continues them when bodies are sorted, so a family is a run
of sorted bodies in which each is a prefix of the next: one range-partitioned sort finds all, without a group that could grow.
Of works that share author, first SECOND_HEAD characters and length without being a family the first stays (variants of one
text). Bodies under LEAST_BODY characters never merge, and prefixes only from HEAD characters on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stage import once

LEAST_BODY, HEAD, SECOND_HEAD = 8, 12, 24  # fixed values


def _chained(least: int):
    """Sorted rows without their bodies, with `_run`, the number of the row's run in its partition, and the bodies of the partition's
    first and last row as `_first` and `_last`. A body continues the run of the one before it, which has at least `least` characters."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, run, place, held = None, -1, 0, None

        def told(batch: pa.RecordBatch, runs: list[int], first: str | None, last: str | None) -> pa.RecordBatch:
            n, rest = len(runs), batch.drop_columns(["body"])
            edge = lambda x, at: pa.array([x if k == at else None for k in range(n)], pa.string())
            added = [pa.array(range(place - n, place), pa.int64()), pa.array(runs, pa.int64()), edge(first, 0), edge(last, n - 1)]
            return pa.RecordBatch.from_arrays([*rest.columns, *added], [*rest.schema.names, "_place", "_run", "_first", "_last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield told(*held, None)
            first, runs = None if held else batch.column("body")[0].as_py(), []
            for author, body in zip(batch.column("author").to_pylist(), batch.column("body").to_pylist()):
                if before is None or before[0] != author or len(before[1]) < least or not body.startswith(before[1]):
                    run += 1
                runs.append(run)
                before = author, body
            place += len(runs)
            held = batch, runs, first
        if held:
            yield told(*held, before[1])

    return of


def families(texts: DataFrame, least: int = 0, *last: str) -> DataFrame:
    """The rows of `texts` (author, body and others) without the bodies, with `family`, the same for a run of bodies that each begin
    the next, and `place`, by which the rows of a run are sorted; equal bodies are sorted by the columns `last`.

    The sort is by ranges, so no author and no common head is one task's; it is the only move of the bodies, and only those at the
    edges of partitions leave it. What partitions need of each other is a row a partition.
    """
    by, rest = ["author", "body", *last], texts.drop("body")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    parts = texts.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    told = once(parts.mapInArrow(_chained(least), f"{shape}, _part int, _place long, _run long, _first string, _last string"))
    edge = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("author", F.col(c).alias("body")))).alias(c)
    edges = told.groupBy("_part").agg(edge("_first"), edge("_last"), F.max("_run").alias("_end"))
    order = Window.orderBy("_part")  # a row a partition
    before = F.lag("_last").over(order)
    goes_on = (before["author"] == F.col("_first.author")) & (F.length(before["body"]) >= least) & F.startswith(F.col("_first.body"), before["body"])
    linked = edges.withColumn("_linked", F.coalesce(goes_on, F.lit(False))).select("_part", "_end", "_linked")
    begun = F.when(~F.col("_linked") | (F.col("_end") > 0), F.struct("_part", F.col("_end").alias("_run")))  # the run at the partition's end, where it begins there
    linked = linked.select("_part", "_linked", F.last(begun, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    family = F.when(F.col("_linked") & (F.col("_run") == 0), F.col("_carried")).otherwise(F.struct("_part", "_run"))
    return told.join(F.broadcast(linked), "_part").select(*rest.columns, family.alias("family"), F.struct("_part", "_place").alias("place"))


def with_family(texts: DataFrame) -> DataFrame:
    """Adds `top`, the last of the run of prefixes that a body begins or continues, to distinct (author, body) rows."""
    told = once(families(texts.withColumn("_body", F.col("body"))))
    tops = told.groupBy("family").agg(F.max_by("_body", "place").alias("top"))
    return told.join(tops, "family").select("author", F.col("_body").alias("body"), "top")


def merged_works(records: DataFrame) -> DataFrame:
    """ord, author, n_merged, origins, n_chars and sha256 (of the body) for each surviving work of `records` (ord, author, body, origin).

    Null authors and bodies are empty. Equal bodies are pre-aggregated, so a text that a third of all records hold is one row; then
    the bodies move once more, to be sorted, and from there a work is its body's hash, length and first characters. Bodies that never
    merge are rows of their own all the way, told by `alone`.
    """
    known = records.select("ord", "origin", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("body", F.lit("")).alias("body"))
    alone = F.when(F.length("body") < LEAST_BODY, F.monotonically_increasing_id()).alias("alone")
    same = known.select("*", alone).groupBy("author", "body", "alone").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.collect_set("origin").alias("origins"))
    work = {"n_chars": F.length("body").cast("long"), "sha256": F.sha2("body", 256), "opening": F.left("body", F.lit(SECOND_HEAD))}
    merged = families(same.withColumns(work), HEAD, "alone").groupBy("author", "family", "alone").agg(
        F.min("ord").alias("ord"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("origins"))).alias("origins"), F.max_by(F.struct(*work), "place").alias("top")
    )
    stays = F.struct("ord", "n", "origins", "top")
    first = merged.groupBy("author", "top.opening", "top.n_chars", "alone").agg(F.min_by(stays, F.struct(F.col("ord").isNull(), "ord", "family")).alias("w")).select("author", "w.*")
    return first.select("ord", "author", F.col("n").alias("n_merged"), F.array_join(F.array_sort("origins"), ",").alias("origins"), "top.n_chars", "top.sha256")


def merge_collections(records: DataFrame) -> DataFrame:
    """ord, author, body, n_merged, origins for each surviving work of `records`: merged_works with their texts."""
    body = F.coalesce("body", F.lit(""))
    texts = records.select(F.coalesce("author", F.lit("")).alias("author"), F.sha2(body, 256).alias("sha256"), body.alias("body")).groupBy("author", "sha256").agg(F.first("body").alias("body"))
    return merged_works(records).join(texts, ["author", "sha256"]).select("ord", "author", "body", "n_merged", "origins")
