"""Queries of the CJK profile over whole tables: every turn of a conversation spelt in characters, and cut into regulated verse.

Letters become characters one by one (some of them traditional forms, so that folding has work), and all content of a turn becomes
lines of five or seven and poems of four or eight lines. The operators are those of real verse, and work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LATIN, canonical, char_pattern, content, erase, negated, normalized_query, split_lines, tokens
from ..operators import annotate, claims, compose, guards, metrics, profiles, prosody
from . import cjk_queries as cjk
from . import queries as base
from .cjk_queries import FEELINGS, FOLD_FROM, FOLD_TO, FOLDED, IMAGES, LABELLED, MONTH, NEGATION
from .lexicons import LEXICONS
from .lookups import _CONTENT
from .queries import _FORM, _HITS, _LINE_ROWS, _docs, _table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LETTERS, CHARACTERS = "etanihorsldcumpgbfvwyxjkqz", "月明不山天愁雪斷腸日樓河海未思頭鄉盡黃窮層無誰識來舉"
POEMS = 100_000  # more than a turn has

_SPELT = f"translate(lower(coalesce(text, '')), '{LETTERS}', '{CHARACTERS}')"
_SOURCE = f"poems AS (SELECT conv_id * 1000 + turn AS poem_id, CASE WHEN role = 'assistant' THEN '丁' ELSE role END AS author, {_SPELT} AS text FROM conversations)"
_VERSE = f"""{_SOURCE}, v0 AS (SELECT poem_id AS base, poem_id % 2 AS odd, poem_id // 1000 % 2 AS wide, array_to_string(regexp_extract_all({cjk._FOLD}, '{cjk._CJK}'), '') AS body FROM poems),
    v1 AS (SELECT base, body, 5 + 2 * odd AS w, 4 + 4 * wide AS m FROM v0), v2 AS (SELECT base, m, i AS k, substr(body, i * w + 1, w) AS line FROM v1, unnest(generate_series(0, length(body) // w - 1)) AS g(i) WHERE length(body) >= w),
    verse AS (SELECT base * {POEMS} + k // m AS poem_id, CAST(k % m AS INT) AS line_no, line, CASE (base + k // m) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS first_rhymes FROM v2)"""
_FEET = f"{_VERSE}, ft AS (SELECT poem_id, line_no, right(line, 1) AS ch FROM verse)"


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _over(name: str, was: str, now: str) -> str:
    """The SQL of a fixture's query over another table."""
    sql = cjk.ORACLES[name]
    assert was in sql
    return sql.replace(was, now)


def _poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    author = F.when(F.col("role") == "assistant", "丁").otherwise(F.col("role"))
    spelt = F.translate(F.lower(F.coalesce("text", F.lit(""))), LETTERS, CHARACTERS)
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("poem_id"), author.alias("author"), spelt.alias("text"))


def _verse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """poem_id, line_no, line, first_rhymes."""
    base = F.col("poem_id")
    cut = _poems(spark, sf_dir).select(
        base.alias("base"), content(F.col("text"), FOLDED).alias("body"), (5 + 2 * (base % 2)).cast("int").alias("w"), (4 + 4 * (F.floor(base / 1000) % 2)).cast("int").alias("m")
    )
    full = cut.withColumn("n", F.floor(F.length("body") / F.col("w")).cast("int")).where("n > 0")
    lines = full.select("base", "m", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("body", i * F.col("w") + 1, F.col("w")))).alias("k", "line"))
    poem = F.floor(F.col("k") / F.col("m"))
    turn = (F.col("base") + poem) % 3
    return lines.select((F.col("base") * POEMS + poem).alias("poem_id"), (F.col("k") % F.col("m")).alias("line_no"), "line", F.when(turn == 0, True).when(turn == 1, False).alias("first_rhymes"))


def _readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t) for t, cs in cjk.READINGS.items() for c in cs], "char string, tone string")


@_register(_over("cjk_fold", cjk._VALUES, _SOURCE))
def verse_fold(spark, sf_dir):
    folded = F.translate("text", FOLD_FROM, FOLD_TO)
    return _poems(spark, sf_dir).select("poem_id", folded.alias("folded"), F.length(folded).cast("long").alias("n"))


@_register(_over("cjk_tokens", cjk._VALUES, _SOURCE))
def verse_tokens(spark, sf_dir):
    return _poems(spark, sf_dir).select("poem_id", F.array_join(tokens(F.col("text"), FOLDED), " ").alias("tokens"))


@_register(_over("cjk_split_lines", cjk._VALUES, _SOURCE))
def verse_split_lines(spark, sf_dir):
    lines = split_lines(F.col("text"), FOLDED)
    return _poems(spark, sf_dir).select("poem_id", F.size(lines).cast("long").alias("n"), F.array_join(lines, "/").alias("lines"))


@_register(f"""WITH {_SOURCE}, l AS (SELECT poem_id, author, list_transform({cjk._LINES}, lambda x: length(array_to_string(regexp_extract_all(x, '{cjk._CJK}'), ''))) AS c FROM poems)
    SELECT poem_id, array_to_string(c, '-') AS pattern, CASE WHEN author = '丁' THEN '曲' ELSE {_FORM} END AS form FROM l""")
def verse_forms(spark, sf_dir):
    counts = metrics.line_counts(split_lines(F.col("text"), FOLDED), FOLDED)
    form = metrics.detect_form(counts, collection=F.when(F.col("author") == "丁", "曲"))
    return _poems(spark, sf_dir).select("poem_id", char_pattern(counts).alias("pattern"), form.alias("form"))


@_register(_over("cjk_annotate", cjk._VALUES, _SOURCE))
def verse_annotate(spark, sf_dir):
    folded = _poems(spark, sf_dir).where("text <> ''").withColumn("f", F.translate("text", FOLD_FROM, FOLD_TO))
    every = annotate.hits_in(folded, "f", {"image": IMAGES, "feeling": FEELINGS}, "poem_id", "f")
    before = lambda pattern: negated(F.col("f"), F.col("pos").cast("int"), pattern)
    month = (F.col("kind") == "image") & (F.col("canon") == "月") & before(MONTH)
    return every.select("poem_id", "kind", "pos", "canon", before(NEGATION).alias("negated"), month.alias("month"))


@_register(_over("cjk_line_tones", cjk._VERSE, _VERSE))
def verse_line_tones(spark, sf_dir):
    return prosody.line_tones(_verse(spark, sf_dir).drop("first_rhymes"), _readings(spark))


@_register(_over("cjk_template_match", cjk._VERSE, _VERSE))
def verse_templates(spark, sf_dir):
    verse = _verse(spark, sf_dir)
    tones = prosody.line_tones(verse.drop("first_rhymes"), _readings(spark)).groupBy("poem_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "tones"))).alias("t"))
    rhymes = verse.groupBy("poem_id").agg(F.bool_or("first_rhymes").alias("first_rhymes"))
    poems = tones.select("poem_id", F.transform("t", lambda x: x["tones"]).alias("tones")).join(rhymes, "poem_id")
    return prosody.match_template(poems).select("poem_id", "best_fit", "deviations")


_PAIRED = "pairs AS (SELECT x.poem_id * 10 + x.line_no AS pair_id, x.line AS a, y.line AS b FROM verse x JOIN verse y ON y.poem_id = x.poem_id AND y.line_no = x.line_no + 1 WHERE x.line_no % 2 = 0)"


@_register(_over("cjk_couplet", cjk._VERSE, _VERSE).replace(cjk._PAIRS, _PAIRED))
def verse_couplets(spark, sf_dir):
    """Every couplet of every poem."""
    lines = _verse(spark, sf_dir).drop("first_rhymes")
    toned = lines.join(prosody.line_tones(lines, _readings(spark)), ["poem_id", "line_no"])
    side = lambda odd, line, tone: toned.where(F.col("line_no") % 2 == odd).select(
        (F.col("poem_id") * 10 + F.col("line_no") - odd).alias("pair_id"), F.col("line").alias(line), F.col("tones").alias(tone)
    )
    return prosody.couplets(side(0, "a", "ta").join(side(1, "b", "tb"), "pair_id"), cjk.CATEGORIES)


@_register(f"""WITH {_VERSE}, p AS (SELECT poem_id, list(line ORDER BY line_no) AS ls FROM verse GROUP BY 1 HAVING count(*) = 8)
    SELECT poem_id || '/颔联' AS pair_id, ls[3] AS a, ls[4] AS b FROM p UNION ALL SELECT poem_id || '/颈联', ls[5], ls[6] FROM p""")
def verse_middle_couplets(spark, sf_dir):
    lines = _verse(spark, sf_dir).groupBy("poem_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("t"))
    return prosody.middle_couplets(lines.select("poem_id", F.transform("t", lambda x: x["line"]).alias("lines")))


def _feet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verse(spark, sf_dir).select("poem_id", "line_no", F.right("line", F.lit(1)).alias("char"))


@_register(_over("cjk_first_rhyme", cjk._FEET, _FEET))
def verse_first_rhyme(spark, sf_dir):
    return prosody.first_line_rhymes(_feet(spark, sf_dir), cjk._rhyme_table(spark), cjk.DEPARTMENTS)


@_register(_over("cjk_rhyme_depts", "c AS (SELECT DISTINCT ch FROM rd UNION SELECT '无')", f"{_FEET}, c AS (SELECT DISTINCT ch FROM ft)"))
def verse_rhyme_departments(spark, sf_dir):
    return prosody.departments_of(_feet(spark, sf_dir).select("char").distinct(), cjk._rhyme_table(spark), cjk.DEPARTMENTS, cjk.WIDER)


@_register(_over("cjk_group_profile", cjk._GROUPS, f"{_FEET}, gr AS (SELECT poem_id // {POEMS * 1000} AS group_id, ch FROM ft)"))
def verse_group_profile(spark, sf_dir):
    """The rhymes and tones of the feet of each conversation."""
    members = _feet(spark, sf_dir).select(F.floor(F.col("poem_id") / (POEMS * 1000)).alias("group_id"), "char")
    return prosody.group_profile(members, cjk._rhyme_table(spark))


_LABEL = f"CASE (conv_id + turn) % 5 WHEN 0 THEN ' 七言絕句 ' WHEN 1 THEN '绝句' WHEN 2 THEN NULL WHEN 3 THEN '牀前峯' || {_SPELT} ELSE '詞 如梦令 與浣溪沙' || {_SPELT} END"


@_register(_over("cjk_labels", cjk._LABELS, f"labels0 AS (SELECT conv_id * 1000 + turn AS label_id, {_LABEL} AS label FROM conversations)"))
def verse_labels(spark, sf_dir):
    """Labels normalised, variants folded, genres by alias, names of tunes erased."""
    k = F.pmod(F.floor(F.col("poem_id") / 1000) + F.col("poem_id") % 1000, F.lit(5))
    label = (
        F.when(k == 0, " 七言絕句 ").when(k == 1, "绝句").when(k == 2, F.lit(None)).when(k == 3, F.concat(F.lit("牀前峯"), "text")).otherwise(F.concat(F.lit("詞 如梦令 與浣溪沙"), "text"))
    )
    rows = _poems(spark, sf_dir).select(F.col("poem_id").alias("label_id"), label.alias("label")).withColumn("folded", normalized_query(F.coalesce("label", F.lit("")), LABELLED))
    return rows.select("label_id", "folded", canonical(F.col("label"), cjk.GENRES, LABELLED).alias("genre"), erase(F.col("folded"), ["浣溪沙", "如梦令"]).alias("without_tunes"))


@_register("""SELECT conv_id * 1000 + turn AS id, CASE conv_id % 4 WHEN 0 THEN 1 + turn WHEN 1 THEN 8 WHEN 2 THEN 12 END AS n FROM conversations""")
def verse_numerals(spark, sf_dir):
    """Numerals in digits and in characters, and what is none."""
    k = F.col("conv_id") % 4
    said = F.when(k == 0, (F.col("turn") + 1).cast("string")).when(k == 1, "八").when(k == 2, "十二").otherwise("百")
    return _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), claims.numeral(said).alias("n"))


_KNOWN = "('平', '仄')"
_SAME = lambda a, b, k: f"(substr({a}, {k}, 1) IN {_KNOWN} AND substr({a}, {k}, 1) = substr({b}, {k}, 1))"
_WITHIN = lambda i, j: f"(substr(tones, {i}, 1) IN {_KNOWN} AND substr(tones, {i}, 1) = substr(tones, {j}, 1))"


@_register(f"""WITH {cjk._TONES.replace(cjk._VERSE, _VERSE)}, shape AS (SELECT poem_id, count(*) AS n, max(length(tones)) AS w FROM tones GROUP BY 1 HAVING count(*) IN (4, 8) AND max(length(tones)) = min(length(tones)) AND max(length(tones)) IN (5, 7)),
    nb AS (SELECT x.poem_id, x.line_no, x.tones AS tx, y.tones AS ty, w FROM tones x JOIN tones y ON y.poem_id = x.poem_id AND y.line_no = x.line_no + 1 JOIN shape s ON s.poem_id = x.poem_id)
    SELECT poem_id, '三平尾' AS rule, CAST(line_no + 1 AS BIGINT) AS place FROM tones WHERE length(tones) >= 3 AND right(tones, 3) = '平平平' UNION ALL SELECT poem_id, '三仄尾', line_no + 1 FROM tones WHERE length(tones) >= 3 AND right(tones, 3) = '仄仄仄'
    UNION ALL SELECT poem_id, '二四六不交替', line_no + 1 FROM tones JOIN shape USING (poem_id) WHERE {_WITHIN(2, 4)} OR (w = 7 AND {_WITHIN(4, 6)})
    UNION ALL SELECT poem_id, '失对', line_no // 2 + 1 FROM nb WHERE line_no % 2 = 0 AND ({_SAME("tx", "ty", 2)} OR {_SAME("tx", "ty", 4)} OR (w = 7 AND {_SAME("tx", "ty", 6)}))
    UNION ALL SELECT poem_id, '失粘', (line_no + 1) // 2 FROM nb WHERE line_no % 2 = 1 AND substr(tx, 2, 1) IN {_KNOWN} AND substr(ty, 2, 1) IN {_KNOWN} AND substr(tx, 2, 1) <> substr(ty, 2, 1)""")
def verse_issues(spark, sf_dir):
    """What every poem breaks of the rules."""
    tones = prosody.line_tones(_verse(spark, sf_dir).drop("first_rhymes"), _readings(spark)).groupBy("poem_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "tones"))).alias("t"))
    return prosody.issues(tones.select("poem_id", F.transform("t", lambda x: x["tones"]).alias("tones")))


@_register(f"""WITH {_SOURCE}, l AS (SELECT poem_id, list_transform({cjk._LINES}, lambda x: length(array_to_string(regexp_extract_all(x, '{cjk._CJK}'), ''))) AS c FROM poems),
    c AS (SELECT poem_id // 1000 % 20 AS tune, array_to_string(c, '-') AS pattern, count(*) AS k FROM l WHERE len(c) > 0 GROUP BY 1, 2), m AS (SELECT tune, string_split(arg_min(pattern, (-k, pattern)), '-') AS mode FROM c GROUP BY 1 HAVING sum(k) >= 2)
    SELECT tune, CAST(i - 1 AS INTEGER) AS line_no, CAST(mode[i] AS BIGINT) AS n_chars FROM m, unnest(generate_series(1, len(mode))) AS g(i)""")
def verse_tune_frames(spark, sf_dir):
    """The frame of each of twenty tunes: the commonest pattern of the turns put to it."""
    counts = metrics.line_counts(split_lines(F.col("text"), FOLDED), FOLDED)
    sung = _poems(spark, sf_dir).select((F.floor(F.col("poem_id") / 1000) % 20).alias("tune"), char_pattern(counts).alias("pattern")).where("pattern <> ''")
    return compose.tune_frames(profiles.modal_profiles(sung, "tune", "pattern"), "tune", "mode")


@_register(f"""{_HITS}, ln AS ({_LINE_ROWS}), hay AS (SELECT doc_id, {_CONTENT.format("text")} AS body FROM documents),
    c AS (SELECT doc_id, doc_id % 4 AS k, canon, {_CONTENT.format("CASE WHEN doc_id % 4 = 2 THEN line || ' and more' ELSE line END")} AS span FROM hits JOIN ln USING (doc_id, line_no) WHERE kind = 'image'),
    v AS (SELECT doc_id, CASE WHEN k = 1 THEN 'unheard' ELSE canon END AS image, CASE WHEN k <> 1 THEN 'known' WHEN contains(span, 'unheard') THEN 'candidate' ELSE 'rejected' END AS status,
      CASE WHEN k = 3 THEN 'claim_without_spans,no_support_spans' WHEN k = 1 AND NOT contains(span, 'unheard') THEN 'image_unsupported' WHEN NOT contains(body, span) THEN 'span_not_verbatim' ELSE '' END AS flags FROM c JOIN hay USING (doc_id))
    SELECT doc_id, image, status, flags, CASE WHEN flags = '' THEN round(CAST({guards.DEFAULT} * 0.75 * CASE WHEN status = 'known' THEN 1 ELSE {guards.UNKNOWN} END AS DOUBLE), 3) END AS score, count(*) AS n FROM v GROUP BY ALL""")
def literal_candidates(spark, sf_dir):
    """What can be proposed of every document without a model, three in four spoilt, through the check of proposals."""
    docs = _docs(spark, sf_dir)
    told = guards.literal_candidates(base._annotated(spark, sf_dir), annotate.lines_of(docs, F.col("text"), LATIN))
    k = F.col("doc_id") % 4
    spoilt = told.withColumns({
        "image": F.when(k == 1, "unheard").otherwise(F.col("image")), "claim": F.when(k == 3, "it means more").otherwise(F.col("claim")),
        "spans": F.when(k == 2, F.transform("spans", lambda s: F.concat(s, F.lit(" and more")))).when(k == 3, F.array().cast("array<string>")).otherwise(F.col("spans")),
    })
    tried = spoilt.join(docs.select("doc_id", content(F.col("text"), LATIN).alias("hay")), "doc_id")
    checked = guards.verify_candidates(tried, LEXICONS["image"], LATIN).withColumn("flags", F.array_join(F.array_sort("flags"), ","))
    return checked.groupBy("doc_id", "image", "status", "flags", "score").agg(F.count(F.lit(1)).alias("n"))
