"""Registered queries of the full review gate, of claims and citations, and of evaluations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LATIN, content, split_lines
from ..operators import annotate, claims, gate, rules, verify
from ..operators.stage import once
from . import queries as base
from .induced import _ALL, works
from .lexicons import FEELINGS, IMAGES, NEGATION, THEMES
from .lookups import _CONTENT, _TITLED, titled
from .queries import _LINE_ROWS, _LINES, _docs, _table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
POSTHOC = ["critic", "modern"]


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- the gate --------------------------------------------------------------------------------------------------------------
def gate_rules(spark, sf_dir) -> DataFrame:
    """Rules of all families with their evidence; of every thirteen, twelve are spoilt, each in a way of its own."""
    found = base._annotated(spark, sf_dir)
    w = once(works(spark, sf_dir).select("doc_id", "counts", "n_lines", "pattern", "form", "feet"))
    lines = annotate.lines_of(_docs(spark, sf_dir), F.col("text"), LATIN).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")
    first = found.where(~F.col("negated")).groupBy("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", "canon").agg(F.min_by("surface", "pos").alias("surface"))
    of = lambda kind, canon, surface: first.where(F.col("kind") == kind).select("doc_id", "line_no", F.col("canon").alias(canon), F.col("surface").alias(surface))
    image = annotate.image_feeling_rules(found).withColumn("k", F.col("seq")).join(of("image", "image", "surface"), ["doc_id", "line_no", "image"])
    marker = of("feeling", "feeling", "marker").withColumnRenamed("line_no", "at")
    image = image.withColumn("at", F.col("line_no") + F.col("strength")).join(marker, ["doc_id", "at", "feeling"])
    long = lambda c: c.cast("long")
    family = lambda df, kind, n, conf, **columns: df.select(
        "doc_id", "line_no", F.lit(kind).alias("rule_type"), F.lit(n).alias("n_conditions") if isinstance(n, int) else n.alias("n_conditions"), conf.alias("model_confidence"),
        *(c.alias(name) for name, c in columns.items()),
    )
    markers = F.split("markers", ",")
    every = rules.number_rules(
        (family(image, "image_feeling", 2, F.when(F.col("strength") == 0, 0.9).otherwise(0.8), k=F.col("k"), image=F.col("image"), surfaces=F.array("surface"), feeling=F.col("feeling"), marker=F.col("marker"), strength=long(F.col("strength"))), ["k"]),
        (family(rules.theme_rules(found), "theme", F.size(markers), F.when(F.col("strength") == 0, 0.85).otherwise(0.7), k=F.col("pos"), theme=F.col("theme"), markers=markers, strength=F.col("strength")), ["line_no", "k", "theme"]),
        (family(rules.form_rules(w), "form", 2, F.lit(0.95), k=long(F.lit(0)), pattern=F.md5("pattern"), strength=long(F.lit(0))), ["k"]),
        (family(rules.rhyme_rules(w), "rhyme", 1, F.lit(0.9), k=long(F.lit(0)), feet=F.col("feet"), strength=long(F.lit(0))), ["k"]),
    ).drop("k")
    after = lines.select("doc_id", (F.col("line_no") - 1).alias("line_no"), F.col("line").alias("next"))
    spans = every.join(lines, ["doc_id", "line_no"]).join(after, ["doc_id", "line_no"], "left")
    spans = spans.withColumn("span", F.when((F.col("rule_type") == "image_feeling") & (F.col("strength") == 1), F.concat("line", F.lit(". "), "next")).otherwise(F.col("line")))
    k = F.pmod(F.col("doc_id") * 5 + F.col("seq"), F.lit(13))
    change = lambda column, number, value, where=F.lit(True): F.when((k == number) & where, value).otherwise(F.col(column)).alias(column)
    typed = lambda name: F.col("rule_type") == name
    none = lambda t: F.lit(None).cast(t)
    return spans.select(
        "doc_id", change("rule_id", 1, F.concat(F.lit("X"), "rule_id")), change("rule_type", 2, F.lit("rumour")), change("span", 3, F.concat("span", F.lit(" and more"))),
        change("image", 4, F.lit("nowhere"), typed("image_feeling")), "surfaces", "feeling", "marker", "theme", change("markers", 5, F.concat("markers", F.array(F.lit("unattested"))), typed("theme")),
        (F.col("n_conditions") + F.when((k == 5) & typed("theme"), 1).otherwise(0)).alias("n_conditions"), change("pattern", 6, F.lit("x"), typed("form")), change("feet", 7, F.lit("zz"), typed("rhyme")),
        F.when(k == 8, "a modern critic said").otherwise("").alias("body"), change("strength", 9, long(F.lit(0)), typed("image_feeling")),
        F.when(k == 10, "external_analysis").otherwise("original_text").alias("evidence_type"), change("model_confidence", 11, F.lit(1.5)), F.when(k == 12, "guess").otherwise("normalized").alias("interpretation"),
        F.lit(1).alias("n_conclusions"), none("string").alias("annotation"), none("string").alias("ext_id"), none("map<string,string>").alias("ext_fields"),
    )


def gated(spark, sf_dir) -> DataFrame:
    """The rules joined to what they are checked against, and reviewed."""
    w = works(spark, sf_dir)
    own = w.select("doc_id", F.md5("pattern").alias("own_pattern"), F.when(F.size("feet") > 0, F.array_join("feet", ",")).otherwise("").alias("own_feet"))
    text = F.col("text")
    store = _docs(spark, sf_dir).select("doc_id", content(text, LATIN).alias("content"), F.length("text").alias("n_chars"), F.transform(split_lines(text, LATIN), lambda x: content(x, LATIN)).alias("lines")).join(own, "doc_id")
    nothing = {"notes": F.lit(None).cast("array<string>"), "appreciation": F.lit(None).cast("string"), "ext_text": F.lit(None).cast("string"), "ext_record": F.lit(None).cast("map<string,string>")}
    joined = gate_rules(spark, sf_dir).join(store, "doc_id", "left").withColumns(nothing)
    return gate.review(joined, IMAGES, FEELINGS, THEMES, POSTHOC, NEGATION, LATIN)


_L = lambda x: _CONTENT.format(x)
_IMAGE_OF = "CASE " + " ".join(f"WHEN sf = '{s}' THEN '{c}'" for s, c in IMAGES.ranked()) + " END"
_GATE = f"""{_ALL}, ln AS ({_LINE_ROWS}),
    fs AS (SELECT doc_id, line_no, kind, canon, arg_min(surface, pos) AS surface FROM live GROUP BY 1, 2, 3, 4),
    g0 AS (SELECT n.*, ln.line, nx.line AS next, i.surface AS sf, m.surface AS marker FROM numbered n JOIN ln ON ln.doc_id = n.doc_id AND ln.line_no = n.line_no LEFT JOIN ln nx ON nx.doc_id = n.doc_id AND nx.line_no = n.line_no + 1
      LEFT JOIN fs i ON n.rule_type = 'image_feeling' AND i.kind = 'image' AND i.doc_id = n.doc_id AND i.line_no = n.line_no AND i.canon = n.subject
      LEFT JOIN fs m ON n.rule_type = 'image_feeling' AND m.kind = 'feeling' AND m.doc_id = n.doc_id AND m.line_no = n.line_no + n.strength AND m.canon = n.object),
    g1 AS (SELECT doc_id, rule_type AS own_type, strength AS own_strength, subject, object, sf, marker, (doc_id * 5 + seq) % 13 AS k, printf('R%d_%03d', doc_id, seq) AS rid,
        CASE WHEN rule_type = 'image_feeling' AND strength = 1 THEN line || '. ' || next ELSE line END AS span0, CASE rule_type WHEN 'image_feeling' THEN 2 WHEN 'theme' THEN len(string_split(object, ',')) WHEN 'form' THEN 2 ELSE 1 END AS n_cond FROM g0),
    g2 AS (SELECT *, CASE WHEN k = 1 THEN 'X' || rid ELSE rid END AS rule_id, CASE WHEN k = 2 THEN 'rumour' ELSE own_type END AS rule_type, CASE WHEN k = 3 THEN span0 || ' and more' ELSE span0 END AS span,
        CASE WHEN k = 9 AND own_type = 'image_feeling' THEN 0 ELSE own_strength END AS strength, CASE WHEN k = 11 THEN 1.0 WHEN own_type = 'image_feeling' THEN CASE WHEN own_strength = 0 THEN 0.9 ELSE 0.8 END
          WHEN own_type = 'theme' THEN CASE WHEN own_strength = 0 THEN 0.85 ELSE 0.7 END WHEN own_type = 'form' THEN 0.95 ELSE 0.9 END AS conf FROM g1),
    store AS (SELECT doc_id, length(text) AS n_chars, {_L("text")} AS content, list_transform({_LINES}, lambda x: {_L("x")}) AS ls FROM documents),
    g3 AS (SELECT g2.*, n_chars, content, ls, {_L("span")} AS sp FROM g2 JOIN store USING (doc_id)),
    flags AS (SELECT *, (CASE WHEN k = 1 THEN ['bad_rule_id', 'id_of_another_document'] ELSE [] END) || (CASE WHEN k = 2 THEN ['bad_rule_type'] ELSE [] END) || (CASE WHEN k = 12 THEN ['bad_interpretation'] ELSE [] END)
          || (CASE WHEN length(sp) < 3 THEN ['span_too_short'] ELSE [] END) || (CASE WHEN k = 11 THEN ['bad_confidence'] ELSE [] END) AS f_schema,
        (CASE WHEN k = 10 OR sp = '' OR NOT contains(content, sp) THEN ['span_not_in_source'] ELSE [] END) || (CASE WHEN own_type = 'image_feeling' AND NOT contains(sp, sf) THEN ['surface_not_in_span:' || sf] ELSE [] END)
          || (CASE WHEN own_type = 'image_feeling' AND NOT contains(sp, marker) THEN ['marker_not_in_span'] ELSE [] END) || (CASE WHEN own_type = 'image_feeling' AND rule_type = own_type AND k = 4 THEN ['surface_not_registered:' || sf] ELSE [] END)
          || (CASE WHEN k = 10 THEN ['external_record_not_found'] ELSE [] END)
          || (CASE WHEN own_type = 'theme' THEN list_transform(list_filter(string_split(object, ','), lambda m: NOT contains(content, m)), lambda m: 'theme_marker_not_in_text:' || m) ELSE [] END) AS f_evidence,
        (CASE WHEN own_type = 'image_feeling' AND k = 4 THEN ['unknown_image'] ELSE [] END) || (CASE WHEN own_type = 'form' AND k = 6 THEN ['pattern_not_reproducible'] ELSE [] END) || (CASE WHEN own_type = 'rhyme' AND k = 7 THEN ['feet_not_reproducible'] ELSE [] END) AS f_semantics,
        k <> 10 AND n_chars > 120 AND length(span) > 0.9 * n_chars AS broad,
        (CASE WHEN rule_type = 'image_feeling' AND contains(lower(span), marker) AND regexp_matches(split_part(lower(span), marker, 1), '{NEGATION}') THEN ['negated_feeling'] ELSE [] END) || (CASE WHEN k = 10 THEN ['external_analysis_mislabelled'] ELSE [] END) AS f_critic,
        own_type = 'theme' AND k = 5 AS dropped, k = 8 AS late, rule_type = 'image_feeling' AND strength = 0 AND len(list_filter(ls, lambda x: contains(x, sf) AND contains(x, marker))) = 0 AS over FROM g3),
    scored AS (SELECT *, dropped OR late OR over AS repaired, list_sort(f_schema || f_evidence || f_semantics || f_critic || (CASE WHEN broad THEN ['warn:span_broad'] ELSE [] END) || (CASE WHEN dropped THEN ['theme_marker_not_in_text:unattested'] ELSE [] END)
          || (CASE WHEN late THEN ['posthoc_term_in_body:critic', 'posthoc_term_in_body:modern'] ELSE [] END) || (CASE WHEN over THEN ['warn:strength_overclaimed'] ELSE [] END)) AS first,
        CASE WHEN len(f_evidence) = 0 THEN 0.50 ELSE 0 END + CASE WHEN len(f_semantics) > 0 THEN 0 WHEN broad THEN 0.06 ELSE 0.12 END + CASE WHEN len(f_critic) > 0 THEN 0 ELSE 0.16 END
          + CASE WHEN rule_type IN ('form', 'rhyme') OR (strength = 0 AND NOT over) THEN 0.08 WHEN strength = 1 OR over THEN 0.05 ELSE 0.02 END + least(0.06, 0.02 * n_cond)
          + 0.04 * CASE WHEN over THEN least(conf, 0.8) ELSE conf END - CASE WHEN k = 10 THEN 0.06 ELSE 0 END AS raw FROM flags),
    final AS (SELECT *, round(CAST(greatest(0, least(CASE WHEN repaired THEN 0.92 ELSE 0.98 END, raw)) AS DOUBLE), 3) AS score FROM scored),
    gate AS (SELECT doc_id, rule_id, array_to_string(first, ',') AS flags, first, repaired, score, CASE WHEN len(f_schema) + len(f_evidence) + len(f_semantics) + len(f_critic) > 0 THEN 'rejected' WHEN score >= 0.90 THEN 'gold' WHEN score >= 0.78 THEN 'silver'
        WHEN score >= 0.62 THEN 'bronze' ELSE 'rejected' END AS level FROM final)"""


@_register(f"{_GATE} SELECT doc_id, rule_id, flags, repaired, score, level FROM gate")
def review_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", "rule_id", F.array_join("first_flags", ",").alias("flags"), "repaired", "score", "level")


@_register(f"""{_GATE}, st AS (SELECT *, len(f_schema) = 0 AS valid, list_sort(f_evidence || (CASE WHEN dropped THEN ['theme_marker_not_in_text:unattested'] ELSE [] END)) AS e1, list_sort(f_semantics || (CASE WHEN broad THEN ['warn:span_broad'] ELSE [] END)) AS s1,
        list_sort(f_critic || (CASE WHEN late THEN ['posthoc_term_in_body:critic', 'posthoc_term_in_body:modern'] ELSE [] END) || (CASE WHEN over THEN ['warn:strength_overclaimed'] ELSE [] END)) AS c1,
        list_sort((CASE WHEN dropped THEN ['dropped_marker:unattested'] ELSE [] END) || (CASE WHEN over THEN ['strength_downgraded'] ELSE [] END) || (CASE WHEN late THEN ['term_moved:critic', 'term_moved:modern'] ELSE [] END)) AS r1, level FROM final JOIN gate USING (doc_id, rule_id)),
    au AS (SELECT doc_id, rule_id, 0 AS n, 'schema' AS stage, CASE WHEN valid THEN 'pass' ELSE 'fail' END AS result, list_sort(f_schema) AS fl, false AS again FROM st
      UNION ALL SELECT doc_id, rule_id, 1, 'evidence', CASE WHEN len(e1) > 0 THEN 'fail' ELSE 'pass' END, e1, false FROM st WHERE valid UNION ALL SELECT doc_id, rule_id, 2, 'semantic', CASE WHEN len(f_semantics) > 0 THEN 'fail' WHEN broad THEN 'warn' ELSE 'pass' END, s1, false FROM st WHERE valid
      UNION ALL SELECT doc_id, rule_id, 3, 'critic', CASE WHEN len(f_critic) > 0 OR late THEN 'fail' WHEN over THEN 'warn' ELSE 'pass' END, c1, false FROM st WHERE valid UNION ALL SELECT doc_id, rule_id, 4, 'repair', 'repaired', r1, false FROM st WHERE valid AND repaired
      UNION ALL SELECT doc_id, rule_id, 5, 'evidence', CASE WHEN len(f_evidence) > 0 THEN 'fail' ELSE 'pass' END, list_sort(f_evidence), true FROM st WHERE valid AND repaired UNION ALL SELECT doc_id, rule_id, 7, 'consensus', 'pass', [], false FROM st WHERE valid
      UNION ALL SELECT doc_id, rule_id, 8, 'release', level, CASE WHEN valid THEN [] ELSE list_sort(f_schema) END, false FROM st),
    nu AS (SELECT *, row_number() OVER (ORDER BY doc_id, rule_id, n) AS seq FROM au) SELECT printf('AUD_%06d', seq) AS audit_id, seq, rule_id, stage, result, array_to_string(fl, ';') AS flags, again FROM nu""")
def gate_audit(spark, sf_dir):
    """What the full gate did with every rule of every document, as one sequence."""
    return gate.audit(gated(spark, sf_dir))


@_register(f"{_GATE}, f AS (SELECT unnest(first) AS flag FROM gate) SELECT split_part(replace(flag, 'warn:', ''), ':', 1) AS flag, count(*) AS n FROM f GROUP BY 1")
def critic_counts(spark, sf_dir):
    return gate.critic_counts(gated(spark, sf_dir))


# --- claims and citations ----------------------------------------------------------------------------------------------------
PATTERNS = claims.ClaimPatterns(
    author=((r"«([^»]{1,80})» is by (\w+)", 1, 2), (r"(\w+) wrote «([^»]{1,80})»", 2, 1)), era=r"«([^»]{1,80})» is in (\w+)", lines=r"«([^»]{1,80})» has (\d+) lines", sentence=r"[^.\n]+[.]?",
    strong="proves|certainly", inner="despair", hedge="may|perhaps", evidence=r"\[P\d+\]",
)


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """An answer about every document, some of it wrong, and the works that it is checked against."""
    known = titled(spark, sf_dir).where("title <> ''").select("doc_id", "title", "author", F.col("lang").alias("era"), F.size("lines").cast("long").alias("n_lines"), content(F.col("text"), LATIN).alias("body"))
    known = once(known)
    k = F.pmod("doc_id", F.lit(5))
    t = F.concat(F.lit("«"), "title", F.lit("»"))
    author = F.when(k == 1, "somebody").otherwise(F.col("author"))
    said = F.concat(
        F.when(k == 2, F.concat(author, F.lit(" wrote "), t)).otherwise(F.concat(t, F.lit(" is by "), author)), F.lit(". "), t, F.lit(" is in "), F.when(k == 3, "xx").otherwise(F.col("era")), F.lit(". "),
        t, F.lit(" has "), (F.col("n_lines") + F.when(k == 4, 1).otherwise(0)).cast("string"), F.lit(" lines. "),
        F.when(k == 0, "This certainly shows joy. It may be despair. ").when(k == 1, "It proves joy [P1]. It is despair. ").otherwise(""),
    )
    return known.select(F.col("doc_id").alias("answer_id"), said.alias("answer")), known


_CLAIMS = f"""WITH {_TITLED}, kn AS (SELECT doc_id, title, author, lang AS era, len({_LINES}) AS n_lines, {_L("text")} AS body, doc_id % 5 AS k FROM titled WHERE title <> ''),
    per AS (SELECT title, count(DISTINCT body) AS texts, count(DISTINCT era) AS eras, min(era) AS era, min(n_lines) AS n_lines, list(DISTINCT author) AS authors FROM kn GROUP BY 1),
    c AS (SELECT doc_id AS answer_id, 'author' AS kind, title, CASE WHEN k = 1 THEN 'somebody' ELSE author END AS claimed FROM kn UNION ALL SELECT doc_id, 'era', title, CASE WHEN k = 3 THEN 'xx' ELSE era END FROM kn
      UNION ALL SELECT doc_id, 'lines', title, CAST(n_lines + CASE WHEN k = 4 THEN 1 ELSE 0 END AS VARCHAR) FROM kn),
    v AS (SELECT answer_id, kind, title, claimed, CASE kind WHEN 'author' THEN CASE WHEN list_contains(authors, claimed) THEN 'verified' ELSE 'violation' END
        WHEN 'era' THEN CASE WHEN eras > 1 THEN 'skipped' WHEN claimed = era THEN 'verified' ELSE 'violation' END ELSE CASE WHEN texts > 1 THEN 'skipped' WHEN claimed = CAST(n_lines AS VARCHAR) THEN 'verified' ELSE 'violation' END END AS verdict FROM c JOIN per USING (title)
      UNION ALL SELECT doc_id, 'interpretation', '', 'This certainly shows joy.', 'overclaim' FROM kn WHERE k = 0 UNION ALL SELECT doc_id, 'interpretation', '', 'It is despair.', 'overclaim' FROM kn WHERE k = 1)"""


@_register(f"{_CLAIMS} SELECT * FROM v")
def claim_guard(spark, sf_dir):
    return claims.check_claims(*_answers(spark, sf_dir), PATTERNS)


@_register(f"""{_CLAIMS}, n AS (SELECT answer_id, list_sort(list('✗ ' || kind || ': ' || title || CASE WHEN title <> '' THEN ' ' ELSE '' END || claimed))[1:4] AS notes FROM v WHERE verdict IN ('violation', 'overclaim') GROUP BY 1)
    SELECT answer_id, CAST(len(notes) AS BIGINT) AS n_notes, md5(array_to_string(notes, chr(10))) AS notes FROM n""")
def claim_annotations(spark, sf_dir):
    """The lines that the guard adds to answers with something wrong."""
    said, known = _answers(spark, sf_dir)
    noted = claims.annotate_claims(said, claims.check_claims(said, known, PATTERNS)).join(said.withColumnRenamed("answer", "before"), "answer_id").where("answer <> before")
    notes = F.substring("answer", F.length("before") + 2, F.length("answer"))
    return noted.select("answer_id", F.size(F.split(notes, "\n")).cast("long").alias("n_notes"), F.md5(notes).alias("notes"))


def _cited(spark, sf_dir) -> DataFrame:
    """answer_id, answer: the beginning of every document, quoted, with its id or that of another document or of none."""
    quote = F.trim(F.left(F.regexp_replace("first_line", '["\\[\\]]', ""), F.lit(60)))
    k = F.pmod("doc_id", F.lit(3))
    cited = F.when(k == 0, F.col("doc_id")).when(k == 1, F.col("doc_id") + 1).otherwise(F.col("doc_id") + 100_000_000)
    return titled(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), F.concat(F.lit('It begins "'), quote, F.lit('" [P'), cited.cast("string"), F.lit("].")).alias("answer"))


_CITED = f"""WITH {_TITLED}, q AS (SELECT doc_id AS answer_id, trim(left(regexp_replace(first_line, '["\\[\\]]', '', 'g'), 60)) AS quote, CASE doc_id % 3 WHEN 0 THEN doc_id WHEN 1 THEN doc_id + 1 ELSE doc_id + 100000000 END AS cited FROM titled),
    j AS (SELECT answer_id, quote, d.doc_id IS NULL AS unknown, length(quote) BETWEEN 4 AND 100 AS quoted, coalesce(contains({_L("d.text")}, {_L("quote")}), false) AS ok FROM q LEFT JOIN documents d ON d.doc_id = cited),
    cited AS (SELECT answer_id, CAST(1 AS BIGINT) AS n_ids, CAST(unknown AS BIGINT) AS n_unsupported, CAST(quoted AS BIGINT) AS n_quotes, CAST(quoted AND NOT ok AS BIGINT) AS n_mismatched FROM j)"""


def _guarded(spark, sf_dir) -> DataFrame:
    sources = _docs(spark, sf_dir).select(F.col("doc_id").cast("int").alias("source_id"), content(F.col("text"), LATIN).alias("hay"))
    return verify.check_citations(_cited(spark, sf_dir), sources, r"\[P([0-9]+)\]", '"([^"]{4,100})"', LATIN)


@_register(f"{_CITED} SELECT * FROM cited")
def citation_guard(spark, sf_dir):
    return _guarded(spark, sf_dir)


@_register(f"""{_CITED} SELECT answer_id % 3 AS task, count(*) AS n, count(*) FILTER (WHERE n_unsupported = 0 AND n_mismatched = 0) AS grounded, round(avg(CASE WHEN n_unsupported = 0 AND n_mismatched = 0 THEN 1.0 ELSE 0.0 END), 4) AS rate FROM cited GROUP BY 1""")
def grounding_eval(spark, sf_dir):
    """How many answers are grounded: those that cite what they quote, another document, and none."""
    ok = (F.col("n_unsupported") == 0) & (F.col("n_mismatched") == 0)
    return _guarded(spark, sf_dir).groupBy(F.pmod("answer_id", F.lit(3)).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("grounded"), F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 4).alias("rate"))


@_register(f"""{_CLAIMS}, t AS (SELECT CASE answer_id % 5 WHEN 1 THEN 'wrong author' WHEN 3 THEN 'wrong era' WHEN 4 THEN 'wrong lines' END AS task, CASE answer_id % 5 WHEN 1 THEN 'author' WHEN 3 THEN 'era' WHEN 4 THEN 'lines' END AS kind0, kind, verdict FROM v WHERE answer_id % 5 IN (1, 3, 4)),
    {_CITED.removeprefix(f"WITH {_TITLED}, ")}
    SELECT task, count(*) AS n, count(*) FILTER (WHERE verdict = 'violation') AS blocked FROM t WHERE kind = kind0 GROUP BY 1
    UNION ALL SELECT 'wrong source', count(*), count(*) FILTER (WHERE n_unsupported + n_mismatched > 0) FROM cited WHERE answer_id % 3 = 1 UNION ALL SELECT 'unknown source', count(*), count(*) FILTER (WHERE n_unsupported + n_mismatched > 0) FROM cited WHERE answer_id % 3 = 2""")
def adversarial_bench(spark, sf_dir):
    """How many of the answers that are wrong in one way the guards block."""
    checked, cited = once(claim_guard(spark, sf_dir)), once(_guarded(spark, sf_dir))
    parts = []
    for k, kind in ((1, "author"), (3, "era"), (4, "lines")):
        mine = checked.where((F.pmod("answer_id", F.lit(5)) == k) & (F.col("kind") == kind))
        parts.append(mine.groupBy().agg(F.lit(f"wrong {kind}").alias("task"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "violation").alias("blocked")))
    for k, name in ((1, "wrong source"), (2, "unknown source")):
        mine = cited.where(F.pmod("answer_id", F.lit(3)) == k)
        parts.append(mine.groupBy().agg(F.lit(name).alias("task"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_unsupported") + F.col("n_mismatched") > 0).alias("blocked")))
    return reduce(DataFrame.unionByName, parts)


@_register("""WITH i AS (SELECT page_id, list_distinct_ordered FROM (SELECT page_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS list_distinct_ordered FROM (SELECT page_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS ids FROM pages)))
    SELECT page_id, CAST(len(list_distinct_ordered) AS BIGINT) AS n_ids, array_to_string(list_distinct_ordered, ' ') AS ids FROM i""")
def id_harvest(spark, sf_dir):
    """The places that a page links to, each once, in order of appearance."""
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("payload_id"), F.col("html").alias("payload"))
    return claims.harvest_ids(pages, 'href="/([^"]+)"').select(F.col("payload_id").alias("page_id"), F.size("ids").cast("long").alias("n_ids"), F.array_join("ids", " ").alias("ids"))


@_register(f"""WITH p AS (SELECT quality AS gold, CASE WHEN len({_LINES}) >= 5 THEN 1 ELSE 0 END AS found FROM documents JOIN labels USING (doc_id)), c AS (SELECT gold, found, count(*) AS n FROM p GROUP BY 1, 2)
    SELECT gold, found, n, round((SELECT sum(n) FILTER (WHERE gold = found) / sum(n) FROM c), 4) AS agreement FROM c WHERE gold IS DISTINCT FROM found ORDER BY n DESC, gold, found LIMIT 6""")
def metric_eval(spark, sf_dir):
    """How far a rule of thumb (five lines or more) agrees with the label of quality, and where not."""
    found = _docs(spark, sf_dir).select("doc_id", (F.size(split_lines(F.col("text"), LATIN)) >= 5).cast("int").alias("found")).join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return claims.agreement(found, "quality", "found")


def _cited_answers(spark, sf_dir) -> DataFrame:
    """An answer about every document that quotes its beginning: rightly, put to another, altered, put to none that is there, outside
    the evidence, and with nothing cited."""
    quote = F.trim(F.left(F.regexp_replace("first_line", '["\\[\\]]', ""), F.lit(60)))
    k = F.pmod("doc_id", F.lit(6))
    at = lambda n: F.concat(F.lit("[P"), (F.col("doc_id") + n).cast("string"), F.lit("]"))
    said = lambda end="": F.concat(F.lit('"'), quote, F.lit(end + '"'))
    answer = (
        F.when(k == 0, F.concat(said(), F.lit(" "), at(0))).when(k == 1, F.concat(said(), F.lit(" "), at(1), F.lit(". See "), at(0))).when(k == 2, F.concat(said(" and more"), F.lit(" "), at(0)))
        .when(k == 3, F.concat(said(), F.lit(" "), at(100_000_000))).when(k == 4, F.concat(at(0), F.lit(" has "), said())).otherwise(said())
    )
    allowed = F.when(k == 4, F.array(F.col("doc_id") + 1))
    return titled(spark, sf_dir).select(F.col("doc_id").alias("answer_id"), answer.alias("answer"), allowed.alias("allowed"))


def _citations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    sources = _docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "text")
    report, quotes = verify.citations(once(_cited_answers(spark, sf_dir)), sources, r"\[P([0-9]+)\]", '"([^"]{4,100})"', "[a-zß-ÿ]{2,}", LATIN)
    return report, once(quotes)


_PAIRED = "list_distinct([u[i] || u[i + 1] for i in generate_series(1, len(u) - 1)])"
_CITATIONS = f"""WITH {_TITLED}, q0 AS (SELECT doc_id, doc_id % 6 AS k, trim(left(regexp_replace(first_line, '["\\[\\]]', '', 'g'), 60)) AS base FROM titled),
    q1 AS (SELECT doc_id AS answer_id, k, CASE WHEN k = 2 THEN base || ' and more' ELSE base END AS quote,
           CASE k WHEN 1 THEN [doc_id + 1, doc_id] WHEN 3 THEN [doc_id + 100000000] WHEN 5 THEN CAST([] AS BIGINT[]) ELSE [doc_id] END AS ids FROM q0),
    hay AS (SELECT doc_id, {_L("text")} AS body, {base._TOKENS} AS u FROM documents), cited AS (SELECT answer_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS n FROM q1),
    per AS (SELECT q1.answer_id, any_value(k) AS k, any_value(quote) AS quote, list(id ORDER BY n) FILTER (h.doc_id IS NOT NULL) AS verified, list(id ORDER BY n) FILTER (id IS NOT NULL AND h.doc_id IS NULL) AS unsupported,
              list(id ORDER BY n) FILTER (contains(body, {_L("quote")}) AND {_L("quote")} <> '') AS holders FROM q1 LEFT JOIN cited c ON c.answer_id = q1.answer_id LEFT JOIN hay h ON h.doc_id = c.id GROUP BY 1),
    sim AS (SELECT answer_id, max(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END) AS alike
            FROM (SELECT q1.answer_id, (SELECT {_PAIRED} FROM (SELECT {base._TOKENS.replace("text", "q1.quote")} AS u)) AS a, (SELECT {_PAIRED} FROM (SELECT h.u AS u)) AS b FROM q1 JOIN cited c ON c.answer_id = q1.answer_id JOIN hay h ON h.doc_id = c.id) GROUP BY 1),
    rep AS (SELECT answer_id, k, quote, coalesce(verified, []) AS verified, coalesce(unsupported, []) AS unsupported, CASE WHEN k = 4 THEN coalesce(verified, []) ELSE [] END AS outside, k <> 5 AS has_citation,
              coalesce(holders, []) AS holders, CASE WHEN k IN (0, 2, 4) THEN verified[1] WHEN k = 1 THEN verified[1] END AS bound_to, alike FROM per LEFT JOIN sim USING (answer_id)),
    quo AS (SELECT *, CASE WHEN len(verified) = 0 THEN 'unsupported' WHEN len(holders) = 0 THEN CASE WHEN alike >= 0.45 THEN 'altered' ELSE 'absent' END WHEN list_contains(holders, bound_to) THEN 'verified' ELSE 'misattributed' END AS status
              FROM rep WHERE length(quote) BETWEEN 4 AND 100 AND regexp_matches(quote, '[a-zß-ÿ]{{2,}}'))"""


@_register(f"""{_CITATIONS} SELECT answer_id, array_to_string(verified, ',') AS verified, array_to_string(unsupported, ',') AS unsupported, array_to_string(outside, ',') AS outside, has_citation FROM rep""")
def citation_report(spark, sf_dir):
    """Of every answer the ids that are there, that are not, and that are there but not among its evidence."""
    report, _ = _citations(spark, sf_dir)
    told = {c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("verified", "unsupported", "outside")}
    return report.withColumns(told).drop("cited")


@_register(f"""{_CITATIONS} SELECT answer_id, quote, status, CASE WHEN len(holders) = 0 AND len(verified) > 0 THEN round(alike, 3) END AS similarity, bound_to, array_to_string(holders[1:3], ',') AS holders FROM quo""")
def citation_quotes(spark, sf_dir):
    """What became of every quote: verified, put to the wrong work, altered (how near it is), absent, without support."""
    _, quotes = _citations(spark, sf_dir)
    return quotes.drop("place").withColumn("holders", F.array_join(F.transform("holders", lambda x: x.cast("string")), ","))


@_register(f"""{_CITATIONS}, n AS (SELECT rep.answer_id, len(rep.unsupported) = 0 AND len(rep.outside) = 0 AND coalesce(status IN ('verified', 'misattributed'), true) AS ok, list_filter([
      CASE WHEN len(rep.verified) > 0 AND len(rep.outside) = 0 THEN '✓ ' || len(rep.verified) || ' verified: ' || array_to_string(rep.verified, ', ') END, CASE WHEN len(rep.unsupported) > 0 THEN '✗ no such work: ' || array_to_string(rep.unsupported, ', ') END,
      CASE WHEN len(rep.outside) > 0 THEN '⚠ not among the evidence: ' || array_to_string(rep.outside, ', ') END, CASE WHEN status IN ('altered', 'absent', 'unsupported') THEN '✗ not in its sources: ' || left(quo.quote, 24) END,
      CASE WHEN status = 'misattributed' THEN '⚠ ' || left(quo.quote, 30) || ' is put to ' || quo.bound_to || ', stands in ' || array_to_string(quo.holders[1:3], ', ') END, CASE WHEN NOT rep.has_citation THEN '⚠ nothing is cited' END], lambda x: x IS NOT NULL) AS notes
      FROM rep LEFT JOIN quo USING (answer_id)) SELECT answer_id, ok, CAST(len(notes) AS BIGINT) AS n_notes, md5(array_to_string(notes, chr(10))) AS notes FROM n""")
def citation_notes(spark, sf_dir):
    """The note under every answer."""
    notes = verify.citation_notes(*_citations(spark, sf_dir))
    return notes.select("answer_id", "ok", F.size("notes").cast("long").alias("n_notes"), F.md5(F.array_join("notes", "\n")).alias("notes"))
