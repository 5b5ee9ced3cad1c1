"""Rules that a work's own lines support, beside those of images and feelings, and the binding of outside analyses to works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TextProfile, units
from . import lookup
from .stage import once

MARKERS, NOTES, LEAST_NOTE, LEAST_FEET, MOST_LINES = 6, 20, 4, 2, 8  # fixed values
STRONG, WEAK = 0, 2
TYPES = ("image_feeling", "theme", "form", "rhyme", "annotation")


def theme_rules(found: DataFrame, kind: str = "theme") -> DataFrame:
    """doc_id, theme, markers (the first MARKERS, comma-joined), n_markers, strength, line_no (of the first marker), pos.

    A theme needs two different markers, or one of two letters or more twice; with one marker it is weak.
    """
    per = found.where(F.col("kind") == kind).groupBy("doc_id", F.col("canon").alias("theme"), "surface").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "pos")).alias("spot")
    )
    rules = per.groupBy("doc_id", "theme").agg(
        F.count(F.lit(1)).alias("n_markers"), F.min("spot").alias("spot"), F.max(F.when(F.length("surface") >= 2, F.col("n")).otherwise(0)).alias("most"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("spot", "surface"))), 1, MARKERS), lambda x: x["surface"]).alias("markers"),
    ).where("n_markers >= 2 OR most >= 2")
    strength = F.when(F.col("n_markers") >= 2, STRONG).otherwise(WEAK)
    return rules.select(
        "doc_id", "theme", F.array_join("markers", ",").alias("markers"), "n_markers", strength.cast("long").alias("strength"),
        F.col("spot.line_no").cast("long").alias("line_no"), F.col("spot.pos").alias("pos"),
    )


def form_rules(works: DataFrame) -> DataFrame:
    """doc_id, n_lines, pattern, form, line_no (the first) of works (doc_id, counts, pattern, form) with a line."""
    return works.where(F.size("counts") > 0).select("doc_id", F.size("counts").cast("long").alias("n_lines"), "pattern", "form", F.lit(0).cast("long").alias("line_no"))


def rhyme_rules(works: DataFrame) -> DataFrame:
    """doc_id, feet (comma-joined), line_no (the last even line) of works (doc_id, n_lines, feet) with LEAST_FEET feet and at most
    MOST_LINES lines: longer ones change their rhymes."""
    kept = works.where((F.size("feet") >= LEAST_FEET) & (F.col("n_lines") <= MOST_LINES))
    return kept.select("doc_id", F.array_join("feet", ",").alias("feet"), (F.floor(F.col("n_lines") / 2) * 2 - 1).cast("long").alias("line_no"))


def annotation_rules(notes: DataFrame) -> DataFrame:
    """doc_id, note_no, note of notes (doc_id, note_no from 0, note): the first NOTES of a work, if they have LEAST_NOTE letters."""
    trimmed = notes.where(F.col("note_no") < NOTES).select("doc_id", F.col("note_no").cast("long").alias("note_no"), F.trim("note").alias("note"))
    return trimmed.where(F.length("note") >= LEAST_NOTE)


def number_rules(*families: tuple[DataFrame, list[str]]) -> DataFrame:
    """The families' rows with seq, the number within a work by family, then by the columns named; and a rule's id."""
    out = None
    for k, (rules, order) in enumerate(families):
        named = rules.withColumns({"_family": F.lit(k), "_order": F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))})
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("_family", "_order")).cast("long")
    return out.withColumn("seq", seq).withColumn("rule_id", F.format_string("R%d_%03d", "doc_id", "seq")).drop("_family", "_order")


def bind_external(works: DataFrame, external: DataFrame, profile: TextProfile) -> DataFrame:
    """doc_id, ext_id: for works (doc_id, author, first_line) the least analysis (ext_id, author, text) by the same author, other
    than the work itself, whose text has the first line, unit for unit, however short it is. A line without units binds nothing.

    Equal first lines of an author are asked for once, and the two least analyses of each are kept: so copies of a work do not
    meet each other pairwise.
    """
    lines = works.where(F.col("author").isNotNull()).select("doc_id", "author", units(F.col("first_line"), profile).alias("passage"))
    asked = once(lookup.keyed(lines, ["doc_id", "author"]))
    texts = external.select(F.col("ext_id").alias("doc_id"), "author", units(F.col("text"), profile).alias("unit"))
    key = ["author", *lookup.KEY]
    place = F.dense_rank().over(Window.partitionBy(*key).orderBy("ext_id"))  # so no more than two of a task's leave it
    least = lookup.holders(texts, asked, ["author"]).withColumnRenamed("doc_id", "ext_id").withColumn("place", place).where("place <= 2")
    two = least.groupBy(*key).agg(F.min("ext_id").alias("one"), F.max("ext_id").alias("two"))
    other = F.when(F.col("one") != F.col("doc_id"), F.col("one")).when(F.col("two") != F.col("doc_id"), F.col("two"))
    return asked.join(two, key).select("doc_id", other.alias("ext_id")).where("ext_id IS NOT NULL")
