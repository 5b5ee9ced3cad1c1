"""Checks of what answers claim about works: authors, eras, numbers of lines, and interpretation without evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The numerals that claims are written in.
NUMERALS = {"一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十二": 12, "十四": 14, "十六": 16}


def numeral(text: Column) -> Column:
    """Digits or one of NUMERALS as a number, null for anything else."""
    names = F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair))
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.cast("long")), F.try_element_at(names, text).cast("long"))


@dataclass(frozen=True)
class ClaimPatterns:
    """Patterns with the title in group 1 and the claim in group 2 (author patterns may have them turned), and those of sentences."""

    author: tuple[tuple[str, int, int], ...]
    era: str
    lines: str
    sentence: str
    strong: str
    inner: str
    hedge: str
    evidence: str


def _pairs(answers: DataFrame, kind: str, pattern: str, title: int, claimed: int) -> DataFrame:
    both = F.arrays_zip(
        F.regexp_extract_all("answer", F.lit(pattern), F.lit(title)).alias("title"), F.regexp_extract_all("answer", F.lit(pattern), F.lit(claimed)).alias("claimed")
    )
    return answers.select("answer_id", F.explode(both).alias("c")).select("answer_id", F.lit(kind).alias("kind"), "c.title", "c.claimed")


def check_claims(answers: DataFrame, works: DataFrame, patterns: ClaimPatterns) -> DataFrame:
    """answer_id, kind, title, claimed, verdict of each claim of answers (answer_id, answer) about works (title, author, era,
    n_lines, body).

    An author is verified if any work of the title is theirs, and a violation if none is. An era is judged if all works of the
    title have one; a number of lines if they are one text; else the claim is skipped, as is one about an unknown title. A
    sentence with a strong word but neither evidence nor a hedge, or on someone's mind without a hedge, is an overclaim.
    """
    claims = None
    for pattern, title, claimed in patterns.author:
        part = _pairs(answers, "author", pattern, title, claimed)
        claims = part if claims is None else claims.unionByName(part)
    claims = claims.unionByName(_pairs(answers, "era", patterns.era, 1, 2)).unionByName(_pairs(answers, "lines", patterns.lines, 1, 2)).distinct()
    per = works.groupBy("title").agg(
        F.count_distinct(F.xxhash64("body")).alias("texts"), F.count_distinct("era").alias("eras"), F.min("era").alias("era"), F.min("n_lines").alias("n_lines")
    )
    authors = works.select("title", F.col("author").alias("claimed")).distinct().withColumn("own", F.lit(True))
    told = claims.join(per, "title", "left").join(authors, ["title", "claimed"], "left")
    by_author = F.when(F.col("own"), "verified").otherwise("violation")
    same_era = F.contains("era", F.col("claimed")) | F.contains("claimed", F.col("era"))
    by_era = F.when(F.col("eras") > 1, "skipped").when(same_era, "verified").otherwise("violation")
    number = numeral(F.col("claimed"))
    by_lines = F.when((F.col("texts") > 1) | number.isNull(), "skipped").when(number == F.col("n_lines"), "verified").otherwise("violation")
    verdict = F.when(F.col("texts").isNull(), "skipped").when(F.col("kind") == "author", by_author).when(F.col("kind") == "era", by_era).otherwise(by_lines)
    checked = told.select("answer_id", "kind", "title", "claimed", verdict.alias("verdict"))
    sentences = answers.select("answer_id", F.explode(F.regexp_extract_all("answer", F.lit(patterns.sentence), F.lit(0))).alias("s"))
    hedged, strong, inner = (F.col("s").rlike(p) for p in (patterns.hedge, patterns.strong, patterns.inner))
    over = (inner & ~hedged) | (strong & ~hedged & ~F.col("s").rlike(patterns.evidence))
    loose = sentences.where(over).select("answer_id", F.lit("interpretation").alias("kind"), F.lit("").alias("title"), F.trim(F.left("s", F.lit(60))).alias("claimed"), F.lit("overclaim").alias("verdict"))
    return checked.unionByName(loose.distinct())


def annotate_claims(answers: DataFrame, checked: DataFrame, most: int = 4) -> DataFrame:
    """answer_id, answer with a line for each of the first `most` violations and overclaims."""
    bad = checked.where(F.col("verdict").isin("violation", "overclaim"))
    line = F.concat(F.lit("✗ "), F.col("kind"), F.lit(": "), F.col("title"), F.when(F.col("title") != "", " ").otherwise(""), F.col("claimed"))
    notes = bad.groupBy("answer_id").agg(F.slice(F.array_sort(F.collect_list(line)), 1, most).alias("notes"))
    told = answers.join(notes, "answer_id", "left")
    return told.select("answer_id", F.when(F.col("notes").isNull(), F.col("answer")).otherwise(F.concat("answer", F.lit("\n"), F.array_join("notes", "\n"))).alias("answer"))


def harvest_ids(payloads: DataFrame, pattern: str) -> DataFrame:
    """payload_id, ids: the ids in a nested record written as text (payload_id, payload), each once, in order of appearance."""
    return payloads.select("payload_id", F.array_distinct(F.regexp_extract_all("payload", F.lit(pattern), F.lit(1))).alias("ids"))


def agreement(rows: DataFrame, gold: str, found: str, most: int = 6) -> DataFrame:
    """gold, found, n, agreement: the `most` frequent confusions, with the share of all rows that agree."""
    counts = rows.groupBy(F.col(gold).alias("gold"), F.col(found).alias("found")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg((F.sum(F.when(F.col("gold").eqNullSafe(F.col("found")), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    wrong = counts.where(~F.col("gold").eqNullSafe(F.col("found"))).orderBy(F.desc("n"), "gold", "found").limit(most)
    return wrong.crossJoin(F.broadcast(total)).withColumn("agreement", F.round("agreement", 4))  # one row, and at most `most`
