"""The review gate for rules of every type: schema, evidence by layer, semantics with recomputation, critic, repair, release.

A rule row has rule_id, doc_id, rule_type, evidence_type, interpretation, image, surfaces, feeling, marker, theme, markers,
pattern, feet, annotation, ext_id, ext_fields (map of what it concludes from an analysis), span, strength, model_confidence,
n_conditions, n_conclusions, body (its values as one text). What it is checked against is joined to it: content (the document's
letters only; null if there is no document), n_chars, notes and appreciation (letters only), lines (letters only), own_pattern
and own_feet (computed again), ext_text (letters only) and ext_record (map). All checks are projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Lexicon, TextProfile, content, fold
from ..sources.corpus import write_assets
from .numbering import numbered
from .review import BROAD_CHARS, BROAD_SHARE, LEAST_SPAN, _flags, consensus, release
from .stage import once

#: The closed vocabularies of a rule.
RULE_TYPES = ("image_feeling", "theme", "form", "rhyme", "annotation", "external")
EVIDENCE_TYPES = ("original_text", "annotation_text", "appreciation_text", "external_analysis")
INTERPRETATIONS = ("literal", "metric", "normalized", "statistical", "model_inference", "external_llm")
DOWNGRADED = 0.8
STAGES = {"schema": "f_schema", "evidence": "f_evidence", "semantic": "f_semantics", "critic": "f_critic"}


def _registry(lexicon: Lexicon) -> Column:
    return F.create_map(*(F.lit(x) for s, c in lexicon.ranked() for x in (s, c)))


def _each(flag: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(flag + ":"), v))


def examine(rules: DataFrame, images: Lexicon, feelings: Lexicon, themes: Lexicon, posthoc: list[str], negation: str, profile: TextProfile) -> DataFrame:
    """Adds f_schema, f_evidence, f_semantics and f_critic."""
    kind = lambda name: F.col("rule_type") == name
    letters = lambda c: content(c, profile)
    span, none = letters(F.col("span")), F.array().cast("array<string>")
    within = lambda hay, needle: (letters(needle) != "") & F.contains(hay, letters(needle))
    prefix = F.concat(F.lit("R"), F.col("doc_id").cast("string"), F.lit("_"))
    schema = _flags(
        (~F.coalesce("rule_id", F.lit("")).rlike(r"^R\d+_\d{3,}$"), "bad_rule_id"), (F.col("doc_id").isNull(), "bad_doc_id"), (~F.startswith("rule_id", prefix), "id_of_another_document"),
        (~F.col("rule_type").isin(*RULE_TYPES), "bad_rule_type"), (~F.col("evidence_type").isin(*EVIDENCE_TYPES), "bad_evidence_type"),
        (~F.col("interpretation").isin(*INTERPRETATIONS), "bad_interpretation"), (F.length(span) < LEAST_SPAN, "span_too_short"), (F.col("n_conditions") < 1, "no_conditions"),
        (F.col("n_conclusions") < 1, "no_conclusions"), (F.col("model_confidence").isNull() | ~F.col("model_confidence").between(0.0, 1.0), "bad_confidence"),
    )
    hay = (
        F.when(F.col("evidence_type") == "original_text", F.array("content")).when(F.col("evidence_type") == "annotation_text", F.col("notes"))
        .when(F.col("evidence_type") == "appreciation_text", F.array("appreciation"))
        .when((F.col("evidence_type") == "external_analysis") & F.contains("ext_text", span), F.array("content")).otherwise(none)
    )
    attested = F.exists(F.filter(F.coalesce(hay, none), lambda h: h.isNotNull()), lambda h: (span != "") & F.contains(h, span))
    image_of, feeling_of = _registry(images), _registry(feelings)
    external = F.col("evidence_type") == "external_analysis"
    concluded = F.filter(F.map_keys(F.coalesce("ext_fields", F.create_map().cast("map<string,string>"))), lambda k: ~F.coalesce(within(letters(F.col("ext_record")[k]), F.col("ext_fields")[k]), F.lit(False)))
    evidence = F.when(F.col("content").isNull(), F.array(F.lit("document_not_found"))).otherwise(F.concat(
        _flags((~attested, "span_not_in_source")),
        _each("surface_not_in_span", F.filter("surfaces", lambda s: ~within(span, s))),
        _each("theme_marker_not_in_text", F.filter("markers", lambda m: ~within(F.col("content"), m))),
        _flags(
            (F.col("marker").isNotNull() & ~within(span, F.col("marker")), "marker_not_in_span"),
            (kind("image_feeling") & ((F.coalesce(F.size("surfaces"), F.lit(0)) < 1) | F.col("image").isNull()), "image_or_surface_missing"),
            (kind("image_feeling") & F.col("marker").isNotNull() & F.col("feeling").isin(*(c for c, _ in feelings.entries)) & ~F.coalesce(feeling_of[fold(F.col("marker"), profile)] == F.col("feeling"), F.lit(False)), "marker_not_registered"),
        ),
        F.when(kind("image_feeling"), _each("surface_not_registered", F.filter("surfaces", lambda s: ~F.coalesce(image_of[fold(s, profile)] == F.col("image"), F.lit(False))))).otherwise(none),
        F.when(external, F.when(F.col("ext_record").isNull(), F.array(F.lit("external_record_not_found"))).otherwise(_each("external_conclusion_not_in_record", concluded))).otherwise(none),
        _flags((kind("annotation") & ~F.exists(F.coalesce("notes", none), lambda n: within(n, F.col("annotation"))), "annotation_not_in_notes")),
    ))
    known = lambda name, lexicon: F.col(name).isin(*(c for c, _ in lexicon.entries))
    missing = lambda test: F.coalesce(~test, F.lit(True))
    semantics = F.when(F.col("content").isNull(), F.array(F.lit("document_missing"))).otherwise(_flags(
        (kind("image_feeling") & missing(known("image", images)), "unknown_image"), (kind("image_feeling") & missing(known("feeling", feelings)), "unknown_feeling"),
        (kind("theme") & missing(known("theme", themes)), "unknown_theme"), (kind("theme") & (F.coalesce(F.size("markers"), F.lit(0)) < 1), "theme_without_markers"),
        (kind("form") & ~F.col("pattern").eqNullSafe(F.col("own_pattern")), "pattern_not_reproducible"), (kind("rhyme") & ~F.col("feet").eqNullSafe(F.col("own_feet")), "feet_not_reproducible"),
        ((F.col("evidence_type") == "original_text") & (F.col("n_chars") > BROAD_CHARS) & (F.length("span") > BROAD_SHARE * F.col("n_chars")), "warn:span_broad"),
    ))
    before = F.when(F.col("marker").isNotNull(), F.split_part(fold(F.col("span"), profile), fold(F.col("marker"), profile), F.lit(1)))
    together = F.exists("lines", lambda x: within(x, F.get("surfaces", F.lit(0))) & within(x, F.col("marker")))
    body = F.lower("body")
    critic = F.concat(
        _each("posthoc_term_in_body", F.array_compact(F.array(*(F.when(F.contains(body, F.lit(t)), F.lit(t)) for t in posthoc)))),
        _flags(
            (kind("image_feeling") & F.contains(fold(F.col("span"), profile), fold(F.col("marker"), profile)) & before.rlike(negation), "negated_feeling"),
            (kind("image_feeling") & (F.col("strength") == 0) & (F.size("surfaces") > 0) & F.col("marker").isNotNull() & ~F.coalesce(together, F.lit(False)), "warn:strength_overclaimed"),
            (external & (F.col("interpretation") != "external_llm"), "external_analysis_mislabelled"),
        ),
    )
    return rules.withColumns({"f_schema": schema, "f_evidence": evidence, "f_semantics": semantics, "f_critic": critic})


def repair(rules: DataFrame, posthoc: list[str]) -> DataFrame:
    """Deletes or downgrades only, and says what: markers that the text has not, terms of later critics, claimed strength."""
    dropped = F.filter("f_evidence", lambda f: F.startswith(f, F.lit("theme_marker_not_in_text:")))
    gone = F.transform(dropped, lambda f: F.substring_index(f, ":", -1))
    over = F.array_contains("f_critic", "warn:strength_overclaimed")
    late = F.exists("f_critic", lambda f: F.startswith(f, F.lit("posthoc_term_in_body:")))
    body = F.col("body")
    for term in posthoc:
        body = F.regexp_replace(body, f"(?i){term}", "")
    done = F.concat(
        F.transform(gone, lambda m: F.concat(F.lit("dropped_marker:"), m)), _flags((over, "strength_downgraded")),
        F.transform(F.filter("f_critic", lambda f: F.startswith(f, F.lit("posthoc_term_in_body:"))), lambda f: F.concat(F.lit("term_moved:"), F.substring_index(f, ":", -1))),
    )
    kept = F.filter("markers", lambda m: ~F.array_contains(gone, m))
    return rules.withColumns({
        "repairs": done, "repaired": F.size(done) > 0, "markers": kept, "n_conditions": F.col("n_conditions") - F.when(F.col("markers").isNotNull(), F.size("markers") - F.size(kept)).otherwise(0),
        "strength": F.when(over, F.lit(1)).otherwise(F.col("strength")), "model_confidence": F.when(over, F.least("model_confidence", F.lit(DOWNGRADED))).otherwise(F.col("model_confidence")),
        "body": F.when(late, body).otherwise(F.col("body")), "interpretation": F.when(late, "model_inference").otherwise(F.col("interpretation")),
    })


def review(rules: DataFrame, images: Lexicon, feelings: Lexicon, themes: Lexicon, posthoc: list[str], negation: str, profile: TextProfile) -> DataFrame:
    """The rules with their first flags (first_flags; by stage: first), repairs, the flags that remain, score and level. A rule that was repaired
    goes through all checks again; one that was not would give the same flags."""
    check = lambda df: examine(df, images, feelings, themes, posthoc, negation, profile)
    first = check(rules)
    first = first.withColumns({"first_flags": F.array_sort(F.concat(*STAGES.values())), "first": F.struct(*STAGES.values())})
    fixed = repair(first, posthoc)
    again = check(fixed)
    return release(consensus(again))


def split(reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rules."""
    return reviewed.where("level <> 'rejected'"), reviewed.where("level = 'rejected'")


def critic_counts(reviewed: DataFrame, column: str = "first_flags") -> DataFrame:
    """flag, n: how often each kind of flag was raised."""
    kind = F.split_part(F.regexp_replace(F.col("flag"), "^warn:", ""), F.lit(":"), F.lit(1))
    return reviewed.select(F.explode(column).alias("flag")).groupBy(kind.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def audit(reviewed: DataFrame, order: list[str] | None = None) -> DataFrame:
    """audit_id, seq, rule_id, stage, result, flags, again: what the gate did, as one sequence over all rules in the given order
    (doc_id, then rule_id), a rule's stages as they came.

    A rule that fails its schema goes no further. One that was repaired has its evidence, and if that fails its schema, entered
    again. Numbers come from ranges of the order, not from one task.
    """
    order = order or ["doc_id", "rule_id"]
    hard = lambda flags: F.exists(flags, lambda f: ~F.startswith(f, F.lit("warn:")))
    result = lambda flags: F.when(hard(flags), "fail").when(F.size(flags) > 0, "warn").otherwise("pass")
    listed = lambda flags: F.array_join(F.array_sort(flags), ";")
    text = F.lit("").cast("string")
    entry = lambda n, stage, what, flags, again=False: F.struct(F.lit(n).alias("n"), F.lit(stage).alias("stage"), what.alias("result"), flags.alias("flags"), F.lit(again).alias("again"))
    valid, still = ~hard(F.col("first.f_schema")), ~hard("f_schema")
    fixed = F.col("repaired") & valid
    entries = [
        entry(0, "schema", F.when(valid, "pass").otherwise("fail"), listed("first.f_schema")),
        *(F.when(valid, entry(n, name, result(F.col(f"first.{c}")), listed(f"first.{c}"))) for n, (name, c) in enumerate(STAGES.items()) if n),
        F.when(fixed, entry(4, "repair", F.lit("repaired"), listed("repairs"))), F.when(fixed, entry(5, "evidence", result(F.col("f_evidence")), listed("f_evidence"), True)),
        F.when(fixed & ~still, entry(6, "schema", F.lit("fail"), listed("f_schema"), True)), F.when(valid & (still | ~F.col("repaired")), entry(7, "consensus", F.lit("pass"), text)),
        entry(8, "release", F.col("level"), F.when(~valid, listed("first.f_schema")).otherwise(text)),
    ]
    each = reviewed.select(*dict.fromkeys([*order, "rule_id"]), F.explode(F.array_compact(F.array(*entries))).alias("a"))
    rows = numbered(each.select(*dict.fromkeys([*order, "rule_id"]), "a.*"), [*order, "n"], "seq").withColumn("seq", F.col("seq") + 1)
    return rows.select(F.format_string("AUD_%06d", "seq").alias("audit_id"), "seq", "rule_id", "stage", "result", "flags", "again")


def persist(reviewed: DataFrame, folder: str) -> None:
    """The three sinks of the gate below a folder, from one computation: accepted and rejected rules, and the audit."""
    done = once(reviewed)
    accepted, rejected = split(done)
    write_assets({"accepted": accepted, "rejected": rejected, "audit": audit(done)}, folder)
