"""Roles and intents of questions, and the check of meanings that a model proposes for a work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Lexicon, TextProfile, content

#: Words that tell a role or an intent.
RESEARCH = "统计|分布|共现|网络|频次|计量|语料|数据|论文|研究"
STUDY = "作业|背诵|考试|默写|练习|学习|入门"
FORGERY = "(?:假装|冒充|伪造|谎称|说成)(?:是)?(?:李白|杜甫|苏轼|古人|唐诗|宋词)"
COMPOSE = "帮我写|替我写|创作|作一首|写一首"
#: Fixed values of the confidence of a proposal.
DEFAULT, MOST, UNKNOWN, UNCOUNTERED = 0.5, 0.95, 0.8, 0.9


def intent(question: Column) -> tuple[Column, Column, Column]:
    """The role that a question tells, whether it is allowed, and what the answer must declare."""
    role = F.when(question.rlike(RESEARCH), "researcher").when(question.rlike(STUDY), "student").otherwise("reader")
    notice = F.when(question.rlike(FORGERY), "forgery").when(question.rlike(COMPOSE), "own work").otherwise("")
    return role, ~question.rlike(FORGERY), notice


def verify_candidates(candidates: DataFrame, images: Lexicon, profile: TextProfile) -> DataFrame:
    """Adds status, flags and score to proposals (image, spans, confidence, has_counter, claim) joined to their work's letters
    (hay).

    Spans must stand in the work, and one of them must have the image. An image that the lexicon has not is a candidate if it
    stands in a span, else it is rejected. The score is the model's confidence, less for one span only, for an image that is not
    known, and without another reading; null with a flag.
    """
    letters = lambda c: content(c, profile)
    known = F.col("image").isin(*(c for c, _ in images.entries))
    spans = F.coalesce("spans", F.array().cast("array<string>"))
    lost = F.filter(spans, lambda s: (letters(s) == "") | ~F.contains("hay", letters(s)))
    written = F.exists(spans, lambda s: (F.col("image") != "") & F.contains(letters(s), letters(F.col("image"))))
    status = F.when(known, "known").when(written, "candidate").otherwise("rejected")
    surfaces = F.create_map(*(x for c, ss in images.entries for x in (F.lit(c), F.array(*map(F.lit, (c, *ss))))))
    forms = F.coalesce(F.try_element_at(surfaces, F.col("image")), F.array("image"))
    relevant = F.exists(spans, lambda s: F.exists(forms, lambda f: F.contains(letters(s), letters(f))))
    flag = lambda cond, name: F.when(cond, F.lit(name))
    first = F.array_compact(F.array(flag(F.size(spans) == 0, "no_support_spans"), flag(F.size(lost) > 0, "span_not_verbatim"), flag(status == "rejected", "image_unsupported")))
    more = F.array_compact(F.array(flag((F.size(first) == 0) & ~relevant, "span_irrelevant"), flag((F.coalesce("claim", F.lit("")) != "") & (F.size(spans) == 0), "claim_without_spans")))
    flags = F.concat(first, more)
    model = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(DEFAULT))))
    covered = F.least(F.lit(1.0), F.size(spans) / 2.0)
    score = F.least(F.lit(MOST), model * (0.5 + 0.5 * covered) * F.when(known, 1.0).otherwise(UNKNOWN) * F.when(F.col("has_counter"), 1.0).otherwise(UNCOUNTERED))
    return candidates.withColumns({"status": status, "flags": flags}).withColumn("score", F.when(F.size("flags") == 0, F.round(score, 3)))


def literal_candidates(hits: DataFrame, lines: DataFrame, kind: str = "image") -> DataFrame:
    """doc_id, image, spans, confidence, has_counter, claim: what can be proposed without a model: the images, each with its line
    as evidence and with the counter-reading that nothing beyond the letter was read."""
    own = hits.where(F.col("kind") == kind).select("doc_id", "line_no", F.col("canon").alias("image"))
    told = own.join(lines.select("doc_id", "line_no", "line"), ["doc_id", "line_no"])
    return told.select("doc_id", "image", F.array("line").alias("spans"), F.lit(DEFAULT).alias("confidence"), F.lit(True).alias("has_counter"), F.lit("").alias("claim"))
