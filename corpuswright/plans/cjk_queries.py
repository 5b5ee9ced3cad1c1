"""Queries over inline fixtures in CJK, so that the profile's semantics get a value check as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CJK_PROFILE, Lexicon, TextProfile, canonical, char_pattern, content, erase, negated, normalized_query, split_lines, tokens, with_variants
from ..operators import annotate, claims, guards, metrics, prosody, verify

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
POEMS = [
    (1, "甲", "床前明月光，疑是地上霜。舉頭望明月，低頭思故鄉。"), (2, "乙", "白日依山盡，黃河入海流。欲窮千里目，更上一層樓。"),
    (3, "丙", "不愁前路無知己，（注：一本作無）天下誰人不識君。"), (4, "丁", "未必愁來即斷腸。五月天山雪，無花只有寒。"), (5, "戊", "abc"), (6, "己", ""),
]
FOLD_FROM, FOLD_TO = "舉頭鄉盡黃窮層樓無誰識來斷腸", "举头乡尽黄穷层楼无谁识来断肠"
FOLDED = TextProfile("cjk", CJK_PROFILE.token, CJK_PROFILE.breaks, CJK_PROFILE.notes, CJK_PROFILE.trim, FOLD_FROM, FOLD_TO, bigrams=True)
IMAGES = Lexicon((("月", ("明月", "月")), ("山", ("天山", "山")), ("雪", ("雪",))))
FEELINGS = Lexicon((("愁", ("愁", "断肠")), ("思", ("思故乡",))))
NEGATION = "[不无未莫非休勿][是见得必成为曾复即在有]{0,2}$"
MONTH = "[一二三四五六七八九十正腊]$"
_VALUES = "poems(poem_id, author, text) AS (VALUES " + ", ".join(f"({i}, '{a}', '{t}')" for i, a, t in POEMS) + ")"
_CJK = r"[\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3134F}]"
_FOLD = f"translate(text, '{FOLD_FROM}', '{FOLD_TO}')"
_LINES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[（(〔\[【][^）)〕\]】]*[）)〕\]】]', '', 'g'), '[，。、；：？！,.;:?!\s·]+'), lambda x: trim(x, '「」『』〈〉《》【】')), lambda x: x <> '')"


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _poems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POEMS, "poem_id int, author string, text string")


@_register(f"WITH {_VALUES} SELECT poem_id, {_FOLD} AS folded, CAST(length({_FOLD}) AS BIGINT) AS n FROM poems")
def cjk_fold(spark, sf_dir):
    folded = F.translate("text", FOLD_FROM, FOLD_TO)
    return _poems(spark).select("poem_id", folded.alias("folded"), F.length(folded).cast("long").alias("n"))


@_register(f"""WITH {_VALUES}, c AS (SELECT poem_id, regexp_extract_all({_FOLD}, '{_CJK}') AS c FROM poems)
    SELECT poem_id, array_to_string(c || CASE WHEN len(c) > 1 THEN list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1]) ELSE [] END, ' ') AS tokens FROM c""")
def cjk_tokens(spark, sf_dir):
    return _poems(spark).select("poem_id", F.array_join(tokens(F.col("text"), FOLDED), " ").alias("tokens"))


@_register(f"WITH {_VALUES}, l AS (SELECT poem_id, {_LINES} AS ls FROM poems) SELECT poem_id, CAST(len(ls) AS BIGINT) AS n, array_to_string(ls, '/') AS lines FROM l")
def cjk_split_lines(spark, sf_dir):
    lines = split_lines(F.col("text"), FOLDED)
    return _poems(spark).select("poem_id", F.size(lines).cast("long").alias("n"), F.array_join(lines, "/").alias("lines"))


@_register(f"""WITH {_VALUES}, l AS (SELECT poem_id, author, list_transform({_LINES}, lambda x: length(array_to_string(regexp_extract_all(x, '{_CJK}'), ''))) AS c FROM poems)
    SELECT poem_id, array_to_string(c, '-') AS pattern, CASE WHEN author = '丁' THEN '曲' WHEN len(list_distinct(c)) = 1 AND len(c) = 4 AND c[1] = 5 THEN '五绝'
    WHEN len(list_distinct(c)) = 1 AND c[1] = 7 THEN '七言古体' ELSE '杂言' END AS form FROM l""")
def cjk_forms(spark, sf_dir):
    counts = metrics.line_counts(split_lines(F.col("text"), FOLDED), FOLDED)
    return _poems(spark).select("poem_id", char_pattern(counts).alias("pattern"), metrics.detect_form(counts, collection=F.when(F.col("author") == "丁", "曲")).alias("form"))


def _hits_sql(kind: str, lexicon: Lexicon) -> str:
    names, masked = lexicon.ranked(), "f"
    for i, (s, _) in enumerate(names):
        masked = f"replace({masked}, '{s}', chr({0xE000 + i}) || repeat(chr({0xF8FF}), {len(s) - 1}))"
    canon = "CASE " + " ".join(f"WHEN k = {i} THEN '{c}'" for i, (_, c) in enumerate(names)) + " END"
    return f"""SELECT poem_id, '{kind}' AS kind, pos, {canon} AS canon, f FROM (SELECT poem_id, f, pos, unicode(substr(m, pos + 1, 1)) - {0xE000} AS k
        FROM (SELECT poem_id, f, {masked} AS m FROM f0), unnest(generate_series(0, length(f) - 1)) AS g(pos)) WHERE k BETWEEN 0 AND {len(names) - 1}"""


@_register(f"""WITH {_VALUES}, f0 AS (SELECT poem_id, {_FOLD} AS f FROM poems WHERE text <> ''), h AS ({_hits_sql("image", IMAGES)} UNION ALL {_hits_sql("feeling", FEELINGS)})
    SELECT poem_id, kind, CAST(pos AS BIGINT) AS pos, canon, regexp_matches(left(f, pos), '{NEGATION}') AS negated,
           kind = 'image' AND canon = '月' AND regexp_matches(left(f, pos), '{MONTH}') AS month FROM h""")
def cjk_annotate(spark, sf_dir):
    folded = _poems(spark).where("text <> ''").withColumn("f", F.translate("text", FOLD_FROM, FOLD_TO))
    every = annotate.hits_in(folded, "f", {"image": IMAGES, "feeling": FEELINGS}, "poem_id", "f")
    pos = F.col("pos").cast("int")
    month = (F.col("kind") == "image") & (F.col("canon") == "月") & F.substring(F.col("f"), F.lit(1), pos).rlike(MONTH)
    return every.select("poem_id", "kind", "pos", "canon", negated(F.col("f"), pos, NEGATION).alias("negated"), month.alias("month"))


ANSWERS = [
    (1, "甲云「床前明月光」[P1]，又「低头思故乡」[P1]。"), (2, "「白日依山尽」见于 [P1]。"), (3, "「莫须有之句」[P9]。"), (4, "无引文。"),
]
_ANSWERS = "answers(answer_id, answer) AS (VALUES " + ", ".join(f"({i}, '{a}')" for i, a in ANSWERS) + ")"


@_register(f"""WITH {_VALUES}, {_ANSWERS}, ids AS (SELECT DISTINCT answer_id, CAST(unnest(regexp_extract_all(answer, '\\[P([0-9]+)\\]', 1)) AS INT) AS poem_id FROM answers),
    q AS (SELECT answer_id, unnest(regexp_extract_all(answer, '「([^」]{{4,100}})」', 1)) AS quote FROM answers),
    src AS (SELECT answer_id, array_to_string(regexp_extract_all({_FOLD}, '{_CJK}'), '') AS hay FROM ids JOIN poems USING (poem_id))
    SELECT a.answer_id, (SELECT count(*) FROM ids i WHERE i.answer_id = a.answer_id) AS n_ids,
      (SELECT count(*) FROM ids i WHERE i.answer_id = a.answer_id AND i.poem_id NOT IN (SELECT poem_id FROM poems)) AS n_unsupported,
      (SELECT count(*) FROM q WHERE q.answer_id = a.answer_id) AS n_quotes,
      (SELECT count(*) FROM q WHERE q.answer_id = a.answer_id AND NOT EXISTS (SELECT 1 FROM src WHERE src.answer_id = q.answer_id
         AND contains(hay, array_to_string(regexp_extract_all(translate(quote, '{FOLD_FROM}', '{FOLD_TO}'), '{_CJK}'), '')))) AS n_mismatched
    FROM answers a""")
def cjk_citation_guard(spark, sf_dir):
    answers = spark.createDataFrame(ANSWERS, "answer_id int, answer string")
    sources = _poems(spark).select(F.col("poem_id").alias("source_id"), content(F.col("text"), FOLDED).alias("hay"))
    return verify.check_citations(answers, sources, r"\[P([0-9]+)\]", "「([^」]{4,100})」", FOLDED)


#: A few readings for the fixtures; a real table is read as a dimension.
READINGS = {"平": "依山黄河流穷千层楼床前明光霜头思乡更", "仄": "白日尽入海欲里目上一是地望月更"}
VERSE = [(1, ["白日依山尽", "黄河入海流", "欲穷千里目", "更上一层楼"], False), (2, ["床前明月光", "疑是地上霜", "举头望明月", "低头思故乡"], True), (3, ["白日"], None)]
_READINGS = "readings(ch, tone) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for t, cs in READINGS.items() for c in cs) + ")"
_VERSE = "verse(poem_id, line_no, line, first_rhymes) AS (VALUES " + ", ".join(f"({i}, {k}, '{x}', {'NULL::BOOLEAN' if r is None else str(r).lower()})" for i, ls, r in VERSE for k, x in enumerate(ls)) + ")"
_TONES = f"""{_READINGS}, {_VERSE}, cls AS (SELECT ch, CASE WHEN bool_or(tone = '平') AND bool_or(tone <> '平') THEN '两' WHEN bool_or(tone = '平') THEN '平' ELSE '仄' END AS tone FROM readings GROUP BY 1),
    tones AS (SELECT poem_id, line_no, string_agg(coalesce(tone, '无'), '' ORDER BY i) AS tones FROM verse, unnest(generate_series(1, length(line))) AS g(i) LEFT JOIN cls ON ch = substr(line, i, 1) GROUP BY 1, 2)"""


def _verse_tones(spark: SparkSession) -> DataFrame:
    lines = spark.createDataFrame([(i, k, x) for i, ls, _ in VERSE for k, x in enumerate(ls)], "poem_id int, line_no int, line string")
    readings = spark.createDataFrame([(c, t) for t, cs in READINGS.items() for c in cs], "char string, tone string")
    return prosody.line_tones(lines, readings)


@_register(f"WITH {_TONES} SELECT poem_id, line_no, tones FROM tones")
def cjk_line_tones(spark, sf_dir):
    return _verse_tones(spark)


_TEMPLATES = "template(n_chars, n_lines, k, name, line_no, j, want) AS (VALUES " + ", ".join(
    f"({c}, {n}, {k}, '{name}', {i}, {j}, '{tone}')"
    for c in (5, 7) for n in (4, 8) for k, name in enumerate(prosody.OPENINGS) for i, line in enumerate(prosody.template(name, c, n)) for j, tone in line.items()
) + ")"


@_register(f"""WITH {_TONES}, {_TEMPLATES}, shape AS (SELECT poem_id, count(*) AS n_lines, min(length(tones)) AS n_chars, max(length(tones)) AS top FROM tones GROUP BY 1),
    rhymes AS (SELECT poem_id, bool_or(first_rhymes) AS r FROM verse GROUP BY 1),
    off AS (SELECT s.poem_id, t.k, t.name, count(*) FILTER (WHERE substr(tones, j, 1) IN ('平', '仄') AND substr(tones, j, 1) <> want) AS off
      FROM shape s JOIN template t ON t.n_lines = s.n_lines AND t.n_chars = s.n_chars AND s.top = s.n_chars JOIN tones o ON o.poem_id = s.poem_id AND o.line_no = t.line_no GROUP BY 1, 2, 3),
    ranked AS (SELECT poem_id, name, off, row_number() OVER (PARTITION BY poem_id ORDER BY off + CASE WHEN coalesce(r, false) AND contains(name, '不入韵') THEN 2 ELSE 0 END, k) AS place FROM off JOIN rhymes USING (poem_id))
    SELECT poem_id, name AS best_fit, off AS deviations FROM shape LEFT JOIN (SELECT * FROM ranked WHERE place = 1) USING (poem_id)""")
def cjk_template_match(spark, sf_dir):
    tones = _verse_tones(spark).groupBy("poem_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "tones"))).alias("t"))
    rhymes = spark.createDataFrame([(i, r) for i, _, r in VERSE], "poem_id int, first_rhymes boolean")
    poems = tones.select("poem_id", F.transform("t", lambda x: x["tones"]).alias("tones")).join(rhymes, "poem_id")
    return prosody.match_template(poems).select("poem_id", "best_fit", "deviations")


PAIRS = [(1, "白日依山尽", "黄河入海流"), (2, "欲穷千里目", "更上一层楼"), (3, "白日", "一"), (4, "山月", "海日")]
CATEGORIES = {"颜色": "白黄", "天文": "日月", "地理": "山河海", "数字": "千一"}
_PAIRS = "pairs(pair_id, a, b) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, a, b in PAIRS) + ")"
_CATEGORIES = "cat(ch, kind) AS (VALUES " + ", ".join(f"('{c}', '{k}')" for k, cs in CATEGORIES.items() for c in cs) + ")"


@_register(f"""WITH {_TONES}, {_PAIRS}, {_CATEGORIES},
    cells AS (SELECT pair_id, substr(a, i, 1) AS x, substr(b, i, 1) AS y FROM pairs, unnest(generate_series(1, length(a))) AS g(i)),
    j AS (SELECT c.*, coalesce(p.tone, '无') AS tx, coalesce(q.tone, '无') AS ty, k.kind AS kx, l.kind AS ky FROM cells c LEFT JOIN cls p ON p.ch = x LEFT JOIN cls q ON q.ch = y LEFT JOIN cat k ON k.ch = x LEFT JOIN cat l ON l.ch = y),
    n AS (SELECT pair_id, count(*) FILTER (WHERE tx IN ('平', '仄') AND ty IN ('平', '仄')) AS tp, count(*) FILTER (WHERE tx IN ('平', '仄') AND ty IN ('平', '仄') AND tx <> ty AND y <> '') AS t_off,
          count(*) FILTER (WHERE kx IS NOT NULL AND ky IS NOT NULL) AS cp, count(*) FILTER (WHERE kx = ky AND x <> y) AS cm FROM j GROUP BY 1),
    r AS (SELECT *, CASE WHEN tp > 0 THEN round(t_off / tp, 3) END AS tone_rate, CASE WHEN cp > 0 THEN round(cm / cp, 3) END AS category_rate FROM n JOIN pairs USING (pair_id))
    SELECT pair_id, tone_rate, category_rate, CASE WHEN length(a) <> length(b) THEN '字数不等' WHEN coalesce(tone_rate, 0) < 0.7 THEN '对仗弱'
           WHEN coalesce(category_rate, 0) >= 0.5 AND cp >= 2 THEN '工对倾向' ELSE '宽对倾向' END AS verdict FROM r""")
def cjk_couplet(spark, sf_dir):
    pairs = spark.createDataFrame(PAIRS, "pair_id int, a string, b string")
    readings = spark.createDataFrame([(c, t) for t, cs in READINGS.items() for c in cs], "char string, tone string")
    sides = pairs.select("pair_id", F.posexplode(F.array("a", "b")).alias("line_no", "line")).withColumnRenamed("pair_id", "poem_id")
    tones = prosody.line_tones(sides, readings)
    side = lambda k, name: tones.where(F.col("line_no") == k).select(F.col("poem_id").alias("pair_id"), F.col("tones").alias(name))
    return prosody.couplets(pairs.join(side(0, "ta"), "pair_id").join(side(1, "tb"), "pair_id"), CATEGORIES)


# --- labels, numerals, intents -------------------------------------------------------------------------------------------------
LABELS = [(1, " 七言絕句 "), (2, "七绝"), (3, "绝句"), (4, None), (5, "牀前峯"), (6, "詞 如梦令 与浣溪沙")]
GENRES, LABEL_FROM, LABEL_TO = {"七言绝句": "七绝", "绝句": "七绝"}, "絕詞", "绝词"
LABELLED = with_variants(TextProfile("cjk", CJK_PROFILE.token, CJK_PROFILE.breaks, CJK_PROFILE.notes, CJK_PROFILE.trim, LABEL_FROM, LABEL_TO, bigrams=True))
_LABELS = "labels0(label_id, label) AS (VALUES " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in LABELS) + ")"
_FOLDED = f"translate(trim(coalesce(label, '')), '{LABELLED.fold_from}', '{LABELLED.fold_to}')"


@_register(f"""WITH {_LABELS}, f AS (SELECT label_id, {_FOLDED} AS folded FROM labels0)
    SELECT label_id, folded, CASE folded WHEN '七言绝句' THEN '七绝' WHEN '绝句' THEN '七绝' ELSE folded END AS genre, replace(replace(folded, '如梦令', ' '), '浣溪沙', ' ') AS without_tunes FROM f""")
def cjk_labels(spark, sf_dir):
    """Queries normalised, variants folded, genres by alias, names of tunes erased."""
    rows = spark.createDataFrame(LABELS, "label_id int, label string").withColumn("folded", normalized_query(F.coalesce("label", F.lit("")), LABELLED))
    return rows.select("label_id", "folded", canonical(F.col("label"), GENRES, LABELLED).alias("genre"), erase(F.col("folded"), ["浣溪沙", "如梦令"]).alias("without_tunes"))


NUMBERS = [(1, "八"), (2, "十二"), (3, "16"), (4, "百"), (5, ""), (6, None)]


@_register("WITH n(id, t) AS (VALUES " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in NUMBERS) + ") SELECT id, CAST(CASE t WHEN '八' THEN 8 WHEN '十二' THEN 12 WHEN '16' THEN 16 END AS BIGINT) AS n FROM n")
def cjk_numerals(spark, sf_dir):
    return spark.createDataFrame(NUMBERS, "id int, t string").select("id", claims.numeral(F.col("t")).alias("n"))


ASKED = [(1, "请统计意象分布"), (2, "这首诗怎么背诵"), (3, "你好"), (4, "伪造是李白的诗"), (5, "帮我写一首"), (6, None)]


@_register("WITH q(id, t) AS (VALUES " + ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in ASKED) + """) SELECT id, CASE id WHEN 1 THEN 'researcher' WHEN 2 THEN 'student' ELSE 'reader' END AS role,
    id <> 4 AS allowed, CASE id WHEN 4 THEN 'forgery' WHEN 5 THEN 'own work' ELSE '' END AS notice FROM q""")
def cjk_intents(spark, sf_dir):
    role, allowed, notice = guards.intent(F.coalesce("t", F.lit("")))
    return spark.createDataFrame(ASKED, "id int, t string").select("id", role.alias("role"), allowed.alias("allowed"), notice.alias("notice"))


# --- rhyme and rules of verse ---------------------------------------------------------------------------------------------------
#: A few characters with rhyme and tone, and the departments of their rhymes; real tables are read as dimensions.
RHYMES = [("流", "平", "尤"), ("楼", "平", "侯"), ("留", "平", "尤"), ("留", "去", "宥"), ("尽", "上", "軫"), ("光", "平", "唐"), ("霜", "平", "陽"), ("乡", "平", "陽"), ("东", "平", "東")]
DEPARTMENTS = {"尤": "尤", "侯": "尤", "宥": "宥", "軫": "轸", "唐": "阳", "陽": "阳", "東": "东"}
WIDER = {"尤": ["第十二部"], "宥": ["第十二部"], "轸": ["第六部"], "阳": ["第二部"], "东": ["第一部"]}
FEET = [(1, 0, "尽"), (1, 1, "流"), (1, 3, "楼"), (2, 0, "光"), (2, 1, "霜"), (2, 3, "乡"), (3, 0, "留"), (3, 1, "流"), (4, 0, "东"), (5, 0, "流"), (5, 1, "无")]
_READ = "rd(ch, tone, rhyme, dept) AS (VALUES " + ", ".join(f"('{c}', '{t}', '{r}', '{DEPARTMENTS[r]}')" for c, t, r in RHYMES) + ")"
_WIDER = "wider(dept, part) AS (VALUES " + ", ".join(f"('{d}', '{p}')" for d, ps in WIDER.items() for p in ps) + ")"
_FEET = "ft(poem_id, line_no, ch) AS (VALUES " + ", ".join(f"({i}, {k}, '{c}')" for i, k, c in FEET) + ")"


def _rhyme_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RHYMES, "char string, tone string, rhyme string")


@_register(f"""WITH {_READ}, {_FEET}, one AS (SELECT ch, min(tone) AS tone FROM rd GROUP BY 1 HAVING count(DISTINCT tone) = 1),
    v AS (SELECT poem_id, tone, count(*) AS n FROM ft JOIN one USING (ch) WHERE line_no % 2 = 1 GROUP BY 1, 2), t AS (SELECT poem_id, arg_min(tone, (-n, tone)) AS rt FROM v GROUP BY 1),
    d AS (SELECT ft.poem_id, line_no, dept FROM ft JOIN rd USING (ch) LEFT JOIN t USING (poem_id) WHERE (rt IS NULL OR tone = rt) AND (line_no = 0 OR line_no % 2 = 1)),
    s AS (SELECT poem_id, coalesce(list(DISTINCT dept) FILTER (WHERE line_no = 0), []) AS a, coalesce(list(DISTINCT dept) FILTER (WHERE line_no > 0), []) AS b FROM d GROUP BY 1)
    SELECT p.poem_id, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) > 0 END AS first_rhymes FROM (SELECT DISTINCT poem_id FROM ft) p LEFT JOIN s USING (poem_id)""")
def cjk_first_rhyme(spark, sf_dir):
    feet = spark.createDataFrame(FEET, "poem_id int, line_no int, char string")
    return prosody.first_line_rhymes(feet, _rhyme_table(spark), DEPARTMENTS)


@_register(f"""WITH {_READ}, {_WIDER}, c AS (SELECT DISTINCT ch FROM rd UNION SELECT '无') SELECT ch AS char, coalesce(array_to_string(list_sort(list(DISTINCT rhyme) FILTER (WHERE rhyme IS NOT NULL)), ','), '') AS rhymes,
    coalesce(array_to_string(list_sort(list(DISTINCT rd.dept) FILTER (WHERE rd.dept IS NOT NULL)), ','), '') AS departments, coalesce(array_to_string(list_sort(list(DISTINCT part) FILTER (WHERE part IS NOT NULL)), ','), '') AS wider
    FROM c LEFT JOIN rd USING (ch) LEFT JOIN wider ON wider.dept = rd.dept GROUP BY 1""")
def cjk_rhyme_depts(spark, sf_dir):
    chars = spark.createDataFrame([(c,) for c, _, _ in RHYMES] + [("无",)], "char string")
    return prosody.departments_of(chars, _rhyme_table(spark), DEPARTMENTS, WIDER)


GROUPS = [(1, "流"), (1, "楼"), (1, "留"), (2, "霜"), (2, "光"), (2, "无")]
_GROUPS = "gr(group_id, ch) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in GROUPS) + ")"


@_register(f"""WITH {_READ}, {_GROUPS}, y AS (SELECT group_id, rhyme, count(DISTINCT ch) AS n, row_number() OVER (PARTITION BY group_id ORDER BY count(DISTINCT ch) DESC, rhyme) AS k FROM gr JOIN rd USING (ch) GROUP BY 1, 2),
    t AS (SELECT group_id, tone, count(DISTINCT ch) AS n FROM gr JOIN rd USING (ch) GROUP BY 1, 2), a AS (SELECT group_id, string_agg(rhyme || ':' || n, ',' ORDER BY k) AS top_rhymes FROM y WHERE k <= 4 GROUP BY 1)
    SELECT group_id, any_value(top_rhymes) AS top_rhymes, string_agg(tone || ':' || n, ',' ORDER BY tone) AS tones, round(max(n) / sum(n), 3) AS tone_purity FROM t JOIN a USING (group_id) GROUP BY 1""")
def cjk_group_profile(spark, sf_dir):
    return prosody.group_profile(spark.createDataFrame(GROUPS, "group_id int, char string"), _rhyme_table(spark))


TONED = [(1, ["仄仄平平仄", "平平仄仄平", "平平平仄仄", "仄仄仄平平"]), (2, ["平平平平平", "平平平仄仄", "仄平仄仄仄", "平仄两平平"]), (3, ["平平平"]), (4, ["平两平仄仄仄平", "平平仄仄仄平平", "平仄平平仄仄平", "仄仄平平平仄仄"])]
#: What is wrong with them, counted by hand from the rules.
BREACHES = [
    (2, "三平尾", 1), (2, "三仄尾", 3), (2, "二四六不交替", 1), (2, "失对", 1), (3, "三平尾", 1), (4, "二四六不交替", 1), (4, "失对", 1), (4, "失对", 2), (4, "失粘", 1),
]


@_register("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{r}', CAST({p} AS BIGINT))" for i, r, p in BREACHES) + ") AS b(poem_id, rule, place)")
def cjk_issues(spark, sf_dir):
    return prosody.issues(spark.createDataFrame(TONED, "poem_id int, tones array<string>"))


@_register("SELECT * FROM (VALUES ('1/颔联', 'c', 'd'), ('1/颈联', 'e', 'f')) AS c(pair_id, a, b)")
def cjk_middle_couplets(spark, sf_dir):
    return prosody.middle_couplets(spark.createDataFrame([(1, list("abcdefgh")), (2, list("abcd"))], "poem_id int, lines array<string>"))


# --- candidates of a reader of meanings -----------------------------------------------------------------------------------------
CANDIDATES = [
    (1, 1, "月", ["床前明月光", "举头望明月"], 0.9, True, ""), (2, 1, "月", ["疑是地上霜"], 0.9, True, ""), (3, 1, "床", ["床前明月光"], 0.8, False, ""), (4, 1, "龙", ["床前明月光"], 0.8, False, ""),
    (5, 1, "月", ["床前明月亮"], 0.9, True, ""), (6, 1, "月", [], 0.9, True, "means something"), (7, 1, "明月", ["床前明月光"], None, True, ""),
]
VERDICTS = [
    (1, "known", "", 0.9), (2, "known", "span_irrelevant", None), (3, "candidate", "", 0.432), (4, "rejected", "image_unsupported", None), (5, "known", "span_not_verbatim", None), (6, "known", "claim_without_spans,no_support_spans", None), (7, "candidate", "", 0.3),
]


@_register("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{f}', CAST({'NULL' if c is None else c} AS DOUBLE))" for i, s, f, c in VERDICTS) + ") AS v(cand_id, status, flags, confidence)")
def cjk_semantic_candidates(spark, sf_dir):
    cands = spark.createDataFrame(CANDIDATES, "cand_id int, poem_id int, image string, spans array<string>, confidence double, has_counter boolean, claim string")
    works = _poems(spark).select("poem_id", content(F.col("text"), FOLDED).alias("hay"))
    return guards.verify_candidates(cands.join(works, "poem_id"), IMAGES, FOLDED).select("cand_id", "status", F.array_join(F.array_sort("flags"), ",").alias("flags"), F.col("score").alias("confidence"))
