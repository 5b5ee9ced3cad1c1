"""Dense numbers over all rows, and running sums within groups of any size: no task ever orders a whole table or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import once

ROW_BITS = 33  # of monotonically_increasing_id: the place in a partition


def numbered(rows: DataFrame, order: list[str | Column], name: str, drop: list[str] | None = None) -> DataFrame:
    """`rows` without the columns in `drop`, with their place (long, from 0) in the given order as column `name`.

    Rows are dealt to partitions by ranges of the order and sorted there; a partition's first place is the number of rows in
    those before it, which is one small row a partition. Rows that are equal in the order keep an arbitrary order among
    themselves; as their place in the input parts them, no number of them overfills a partition. An empty table stays empty.
    """
    names = [c for c in rows.columns if c not in (drop or [])]
    by = [*order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = once(dealt.select(*names, F.monotonically_increasing_id().alias("_at")))
    part, at = F.shiftright("_at", ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*names, (F.col("_before") + at).alias(name))


def running_sums(rows: DataFrame, key: str, place: str, values: list[str], block: int = 1024) -> DataFrame:
    """`rows` with each of `values` replaced by its sum over the rows of the same key up to and including its place.

    `place` is a long, unique within a key. A window covers one block of places; the blocks' sums are summed up in the same way,
    so a key that holds a third of all rows is as many windows as it has blocks, on as many levels as its length has digits.
    A null value counts as zero; rows with a null key are one group.
    """
    mine = rows.withColumn("_block", F.floor(F.col(place) / F.lit(block)).cast("long")).fillna(0, subset=values)
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    summed = mine.withColumns({v: F.sum(v).over(inside) for v in values})
    ends = rows.agg(F.min(place).alias("lo"), F.max(place).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] // block == ends["hi"] // block:
        return summed.drop("_block")
    own = mine.groupBy(key, F.col("_block").alias("_place")).agg(*(F.sum(v).alias(v) for v in values)).withColumns({f"_own_{v}": F.col(v) for v in values})
    upto = running_sums(once(own), key, "_place", values, block)
    before = upto.select(F.col(key).alias("_key"), F.col("_place").alias("_of"), *((F.col(v) - F.col(f"_own_{v}")).alias(f"_before_{v}") for v in values))
    both = summed.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    return both.withColumns({v: F.col(v) + F.col(f"_before_{v}") for v in values}).select(*rows.columns)
