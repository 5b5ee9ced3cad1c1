"""The review gate: schema, evidence, semantics, critic, one repair round, score and release, as frames to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the score and of the release levels.
RELEASE = ((0.90, "gold"), (0.78, "silver"), (0.62, "bronze"))
LEAST_SPAN, BROAD_CHARS, BROAD_SHARE = 3, 120, 0.9
LITERAL = ("form", "rhyme", "annotation")
STAGES = ("schema", "evidence", "semantics", "critic", "repair", "release")


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(flag)) for cond, flag in pairs)))


def examine(rules: DataFrame, canons: list[str], feelings: list[str], posthoc: list[str]) -> DataFrame:
    """Adds the flags of the four stages to rules joined with their document (text) and line.

    A rule has doc_id, rule_id, image, feeling, strength, span, model_confidence, line, text.
    """
    span, text = F.lower("span"), F.lower("text")
    schema = _flags(
        (F.length("span") < LEAST_SPAN, "span_short"), (F.col("rule_id").isNull() | ~F.startswith("rule_id", F.concat(F.lit("R"), F.col("doc_id").cast("string"), F.lit("_"))), "bad_id"),
        (~F.col("strength").isin(0, 1), "bad_strength"), ((F.col("model_confidence") < 0) | (F.col("model_confidence") > 1), "bad_confidence"),
    )
    evidence = _flags(
        (~F.contains(text, span), "span_not_verbatim"), (~F.contains(span, F.lower("image_surface")), "surface_missing"),
        ((F.col("strength") == 0) & ~F.contains(span, F.lower("feeling_surface")), "marker_missing"),
    )
    semantics = _flags(
        (~F.col("image").isin(canons), "unknown_image"), (~F.col("feeling").isin(feelings), "unknown_feeling"),
        ((F.length("span") > BROAD_CHARS) & (F.length("span") > BROAD_SHARE * F.length("text")), "warn:span_broad"),
    )
    body = F.coalesce(F.lower("body"), F.lit(""))
    critic = _flags(
        (F.exists(F.array(*map(F.lit, posthoc)), lambda t: F.contains(body, t)), "posthoc_term"),
        (F.col("feeling_negated"), "negated_feeling"), ((F.col("strength") == 0) & (F.col("claimed") > 1), "warn:overclaimed"),
    )
    return rules.withColumns({"f_schema": schema, "f_evidence": evidence, "f_semantics": semantics, "f_critic": critic})


def _hard(flags: str) -> Column:
    return F.exists(flags, lambda f: ~F.startswith(f, F.lit("warn:")))


def consensus(rules: DataFrame) -> DataFrame:
    """score: evidence .50; semantics .12 or .06; critic .16 or .08; strength .08, .05, .02 (literal types .08); conditions up to
    .06; confidence .04; an outside analysis costs .06."""
    typed = "rule_type" in rules.columns
    literal = F.col("rule_type").isin(*LITERAL) if typed else F.lit(False)
    outside = F.when(F.col("evidence_type") == "external_analysis", 0.06).otherwise(0.0) if typed else F.lit(0.0)
    warned = lambda c: F.size(c) > 0
    raw = (
        F.when(F.size("f_evidence") == 0, 0.50).otherwise(0.0)
        + F.when(_hard("f_semantics"), 0.0).when(warned("f_semantics"), 0.06).otherwise(0.12)
        + F.when(_hard("f_critic"), 0.0).when(warned("f_critic"), 0.08).otherwise(0.16)
        + F.when(literal | (F.col("strength") == 0), 0.08).when(F.col("strength") == 1, 0.05).when(F.col("strength") == 2, 0.02).otherwise(0.0)
        + F.least(F.lit(0.06), 0.02 * F.col("n_conditions"))
        + 0.04 * F.least(F.lit(1.0), F.col("model_confidence"))
        - outside
    )
    capped = F.when(F.col("repaired"), F.least(raw, F.lit(0.92))).otherwise(raw)
    return rules.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.98), capped)), 3))


def release(rules: DataFrame) -> DataFrame:
    bad = _hard("f_schema") | (F.size("f_evidence") > 0) | _hard("f_semantics") | _hard("f_critic")
    level = F.when(bad, "rejected")
    for least, name in RELEASE:
        level = level.when(F.col("score") >= least, name)
    return rules.withColumn("level", level.otherwise("rejected"))


def repair(rules: DataFrame) -> DataFrame:
    """Deletes or downgrades only: an overclaim loses its claim, a post-hoc body its body, a missing marker its strength."""
    over = F.array_contains("f_critic", "warn:overclaimed")
    late = F.array_contains("f_critic", "posthoc_term")
    weak = F.array_contains("f_evidence", "marker_missing")
    return rules.withColumns({
        "repaired": over | late | weak, "claimed": F.when(over, F.lit(1)).otherwise(F.col("claimed")),
        "body": F.when(late, F.lit("")).otherwise(F.col("body")), "strength": F.when(weak, F.lit(1)).otherwise(F.col("strength")),
    })


def review(rules: DataFrame, canons: list[str], feelings: list[str], posthoc: list[str]) -> DataFrame:
    """The rules with flags, repaired, score and level; a repaired rule goes through all checks again."""
    first = repair(examine(rules.withColumn("repaired", F.lit(False)), canons, feelings, posthoc))
    return release(consensus(examine(first, canons, feelings, posthoc)))


def audit(reviewed: DataFrame) -> DataFrame:
    """rule_id, stage, result, flags and a sequence number by rule and stage."""
    rows = [
        F.struct(F.lit(k).alias("stage_no"), F.lit(name).alias("stage"), result.alias("result"), flags.alias("flags"))
        for k, (name, result, flags) in enumerate(
            [(n, F.when(_hard(f"f_{n}"), "fail").when(F.size(f"f_{n}") > 0, "warn").otherwise("pass"), F.array_join(f"f_{n}", ";")) for n in STAGES[:4]]
            + [("repair", F.when(F.col("repaired"), "repaired").otherwise("none"), F.lit("")), ("release", F.col("level"), F.lit(""))]
        )
    ]
    each = reviewed.select("doc_id", "rule_id", F.explode(F.array(*rows)).alias("a")).select("doc_id", "rule_id", "a.*")
    order = Window.partitionBy("doc_id").orderBy("rule_id", "stage_no")
    return each.select("doc_id", "rule_id", "stage", "result", "flags", F.row_number().over(order).cast("long").alias("seq"))
