"""Checks of generated answers against their sources, as batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TextProfile, content, dice, matches, pairs_of, units


def check_citations(answers: DataFrame, sources: DataFrame, id_pattern: str, quote_pattern: str, profile: TextProfile) -> DataFrame:
    """answer_id, n_ids, n_unsupported, n_quotes, n_mismatched for answers (answer_id, answer) and sources (source_id, hay).

    An id is unsupported if there is no such source. A quote must stand verbatim, folded and without marks, in a source that
    its answer cites; an answer without valid ids supports no quote.
    """
    ids = answers.select("answer_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(id_pattern), F.lit(1)))).alias("cited"))
    ids = ids.select("answer_id", F.col("cited").cast("int").alias("source_id"))
    cited = ids.join(sources, "source_id", "left")
    per_id = cited.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("hay").isNull()).alias("n_unsupported"))
    quotes = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(quote_pattern), F.lit(1))).alias("q", "quote"))
    tried = quotes.join(cited.where(F.col("hay").isNotNull()), "answer_id", "left")
    found = tried.groupBy("answer_id", "q").agg(F.coalesce(F.bool_or(F.contains("hay", content(F.col("quote"), profile))), F.lit(False)).alias("ok"))
    per_quote = found.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(~F.col("ok")).alias("n_mismatched"))
    out = answers.select("answer_id").join(per_id, "answer_id", "left").join(per_quote, "answer_id", "left")
    return out.na.fill(0, ["n_ids", "n_unsupported", "n_quotes", "n_mismatched"])


ALTERED, HOLDERS = 0.45, 3  # fixed values: from this similarity a quote counts as altered; holders that a warning names
SHOWN_IDS, SHOWN_QUOTES, SHOWN_LETTERS, WARNED_LETTERS = 8, 3, 24, 30  # fixed values of the note


def citations(answers: DataFrame, sources: DataFrame, id_pattern: str, quote_pattern: str, solid: str, profile: TextProfile) -> tuple[DataFrame, DataFrame]:
    """What answers (answer_id, answer, allowed) cite of sources (source_id, text), and what became of each quote.

    The first table: answer_id, cited, verified, unsupported and outside (arrays of ids, in order of first mention), has_citation.
    An id is unsupported where there is no such source, and outside the evidence where `allowed` (null: all are) does not have it:
    an empty list lets none pass. The second: answer_id, place, quote, status, similarity, bound_to, holders. Of the quotes that
    have the `solid` pattern, one is `verified` where the nearest verified id holds it letter for letter, `misattributed` where only
    other verified ids do (the first three are named), `altered` or `absent` where none does, by its best similarity to them,
    and `unsupported` where the answer has no verified id. An empty or null answer cites nothing.
    """
    told = answers.select("answer_id", "allowed", matches(F.coalesce("answer", F.lit("")), id_pattern).alias("ids"), matches(F.coalesce("answer", F.lit("")), quote_pattern).alias("quotes"))
    told = told.withColumn("ids", F.transform("ids", lambda x: F.struct(x["at"].alias("at"), x["said"].cast("long").alias("id"))))
    order = told.select("answer_id", F.posexplode(F.array_distinct(F.transform("ids", lambda x: x["id"]))).alias("n", "source_id"))
    known = order.join(sources.where(F.col("source_id").isNotNull()).select("source_id", F.lit(True).alias("there")).distinct(), "source_id", "left")
    listed = known.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("n", "source_id", F.coalesce("there", F.lit(False)).alias("there")))).alias("c"))
    full = told.join(listed, "answer_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<struct<n:int,source_id:bigint,there:boolean>>")))
    ids = lambda keep: F.transform(F.filter("c", keep), lambda x: x["source_id"])
    full = full.withColumns({"cited": F.transform("c", lambda x: x["source_id"]), "verified": ids(lambda x: x["there"]), "unsupported": ids(lambda x: ~x["there"])})
    outside = F.when(F.col("allowed").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_except("verified", F.col("allowed").cast("array<bigint>")))
    report = full.select("answer_id", "cited", "verified", "unsupported", outside.alias("outside"), (F.size("cited") > 0).alias("has_citation"))

    said = full.select("answer_id", "verified", "ids", F.explode("quotes").alias("q")).where(F.col("q.said").rlike(solid))
    near = F.transform(F.filter("ids", lambda x: F.array_contains("verified", x["id"])), lambda x: F.struct(F.abs(x["at"] - F.col("q.at")), x["at"], x["id"].alias("id")))
    said = said.select("answer_id", "verified", F.col("q.at").alias("place"), F.col("q.said").alias("quote"), F.array_min(near)["id"].alias("bound_to"))
    texts = sources.select("source_id", F.coalesce("text", F.lit("")).alias("text"))
    tried = said.select("answer_id", "place", "quote", F.posexplode("verified").alias("n", "source_id")).join(texts, "source_id")
    wanted = content(F.col("quote"), profile)
    held = (wanted != "") & F.contains(content(F.col("text"), profile), wanted)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  else words would be split again for each pair
    paired = lambda c: bound(units(F.col(c), profile), pairs_of)
    alike = bound(F.struct(paired("quote").alias("q"), paired("text").alias("t")), lambda s: dice(s["q"], s["t"]))
    seen = tried.select("answer_id", "place", "n", "source_id", held.alias("held"), F.when(~held, alike).alias("alike"))
    holders = F.transform(F.array_distinct(F.sort_array(F.collect_list(F.when(F.col("held"), F.struct("n", "source_id"))))), lambda x: x["source_id"])
    best = seen.groupBy("answer_id", "place").agg(holders.alias("holders"), F.max("alike").alias("alike"))
    joined = said.join(best, ["answer_id", "place"], "left").withColumn("holders", F.coalesce("holders", F.array().cast("array<bigint>")))
    status = (
        F.when(F.size("verified") == 0, "unsupported").when(F.size("holders") == 0, F.when(F.col("alike") >= ALTERED, "altered").otherwise("absent"))
        .when(F.array_contains("holders", F.col("bound_to")), "verified").otherwise("misattributed")
    )
    quotes = joined.select(
        "answer_id", "place", "quote", status.alias("status"), F.when(F.size("holders") == 0, F.round("alike", 3)).alias("similarity"), "bound_to", F.slice("holders", 1, HOLDERS).alias("holders")
    )
    return report, quotes


def citation_notes(report: DataFrame, quotes: DataFrame) -> DataFrame:
    """answer_id, ok, notes (an array of lines) for the tables of citations(): what the note under an answer says."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    bad = F.col("status").isin("altered", "absent", "unsupported")
    first = lambda keep, line: F.transform(F.slice(F.sort_array(F.collect_list(F.when(keep, F.struct("place", line.alias("line"))))), 1, SHOWN_QUOTES), lambda x: x["line"])
    missed = F.concat(F.lit("✗ not in its sources: "), F.left("quote", F.lit(SHOWN_LETTERS)))
    warned = F.concat(F.lit("⚠ "), F.left("quote", F.lit(WARNED_LETTERS)), F.lit(" is put to "), F.col("bound_to").cast("string"), F.lit(", stands in "), joined("holders"))
    per = quotes.groupBy("answer_id").agg(first(bad, missed).alias("missed"), first(F.col("status") == "misattributed", warned).alias("warned"), F.count_if(bad).alias("n_bad"))
    none = F.array().cast("array<string>")
    all_ = report.join(per, "answer_id", "left").withColumns({"missed": F.coalesce("missed", none), "warned": F.coalesce("warned", none), "n_bad": F.coalesce("n_bad", F.lit(0))})
    when = lambda cond, line: F.when(cond, F.array(line)).otherwise(none)
    notes = F.concat(
        when((F.size("verified") > 0) & (F.size("outside") == 0), F.concat(F.lit("✓ "), F.size("verified").cast("string"), F.lit(" verified: "), joined(F.slice("verified", 1, SHOWN_IDS)))),
        when(F.size("unsupported") > 0, F.concat(F.lit("✗ no such work: "), joined("unsupported"))), when(F.size("outside") > 0, F.concat(F.lit("⚠ not among the evidence: "), joined("outside"))),
        "missed", "warned", when(~F.col("has_citation"), F.lit("⚠ nothing is cited")),
    )
    ok = (F.size("unsupported") == 0) & (F.size("outside") == 0) & (F.col("n_bad") == 0)
    return all_.select("answer_id", ok.alias("ok"), notes.alias("notes"))
