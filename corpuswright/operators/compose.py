"""Aids for writing: images for a mood, a plan of rhymes, the frame of a tune, and the check of a draft against the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import Lexicon, TextProfile, fold, units
from .annotate import hits_in
from .lookup import occurrences

IMAGES_A_THEME, SUGGESTIONS = 6, 8  # fixed values
LEAST_LINES, MOST_LINES, SEGMENT = 8, 60, 4  # fixed values


def suggest_images(moods: DataFrame, theme_images: DataFrame, lexicons: dict[str, Lexicon], avoid: list[str], profile: TextProfile) -> DataFrame:
    """mood_id, place, image: up to SUGGESTIONS images for each mood (mood_id, text), none of those to avoid. First the images in it
    by name, then those of its themes (theme, image, rank), the first IMAGES_A_THEME of each, by rank."""
    folded = moods.select("mood_id", fold(F.col("text"), profile).alias("f"))
    wants = hits_in(folded, "f", lexicons, "mood_id").select("mood_id", "kind", "canon").distinct()
    own = wants.where("kind = 'image'").select("mood_id", F.lit(0).cast("long").alias("rank"), F.col("canon").alias("image"))
    more = wants.where("kind = 'theme'").select("mood_id", F.col("canon").alias("theme")).join(theme_images.where(F.col("rank") <= IMAGES_A_THEME), "theme").select("mood_id", "rank", "image")
    best = own.unionByName(more).where(~F.col("image").isin(*avoid)).groupBy("mood_id", "image").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("mood_id").orderBy("rank", "image")).cast("long")
    return best.withColumn("place", place).where(F.col("place") <= SUGGESTIONS).select("mood_id", "place", "image")


def rhyme_plan(asked: DataFrame, groups: DataFrame, components: DataFrame) -> DataFrame:
    """plan_id, segment, first_line, label for poems to be (plan_id, n_lines, foot): a group of rhymes for each four lines.

    Lines are clamped and cut to fours. The group of the wished foot comes first, then the larger ones, none twice and none of low
    purity; where groups run out, the plan ends. `groups` are (component, label, n_members, low_purity), a row a group.
    """
    lines = F.greatest(F.lit(LEAST_LINES), F.least(F.lit(MOST_LINES), F.col("n_lines")))
    plans = asked.withColumn("n_segments", F.floor(lines / SEGMENT)).join(components.select(F.col("node").alias("foot"), F.col("component").alias("wished")), "foot", "left")
    fits = (F.col("component") == F.col("wished")).alias("own")
    tried = plans.crossJoin(groups.select("component", "label", "n_members", "low_purity")).withColumn("own", F.coalesce(fits, F.lit(False))).where(F.col("own") | ~F.col("low_purity"))  # plans asked for, by groups of rhymes
    segment = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("own"), F.desc("n_members"), "component")).cast("long")
    ranked = tried.withColumn("segment", segment).where(F.col("segment") <= F.col("n_segments"))
    return ranked.select("plan_id", "segment", ((F.col("segment") - 1) * SEGMENT + 1).alias("first_line"), "label")


def tune_frames(profiles: DataFrame, key: str, pattern: str) -> DataFrame:
    """key, line_no, n_chars: the lines that a tune's pattern asks for."""
    return profiles.select(key, F.posexplode(F.split(pattern, "-")).alias("line_no", "n")).select(key, "line_no", F.col("n").cast("long").alias("n_chars"))


def collisions(drafts: DataFrame, corpus: DataFrame, profile: TextProfile) -> DataFrame:
    """draft_id, line_no, n_docs, first_doc: lines of drafts (draft_id, line_no, line), of any length, that stand in the corpus
    (doc_id, text), unit for unit. Equal lines are asked for once."""
    asked = drafts.select("draft_id", "line_no", units(F.col("line"), profile).alias("passage"))
    found = occurrences(corpus.select("doc_id", units(F.col("text"), profile).alias("unit")), asked)
    per = found.groupBy("passage").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return asked.join(per, "passage").select("draft_id", "line_no", "n_docs", "first_doc")
