"""Registered queries of search, resolution and recommendation."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LATIN, split_lines, tokens, units
from ..operators import annotate, index, intertext, lookup, profiles, resolve, search
from ..operators.stage import once, shared_folder
from . import queries as base
from .lexicons import IMAGES, LEXICONS, THEMES
from .queries import _HITS, _LINES, _REUSE, _ROLLED, _TOKENS, _bm25, _docs, _table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_CONTENT = "array_to_string(regexp_extract_all(lower({}), '[a-zß-ÿ]+'), '')"
_TITLED = f"""titled AS (SELECT doc_id, array_to_string({_TOKENS}[1:3], ' ') AS title, source AS author, lang, coalesce({_LINES}[1], '') AS first_line, text, source IN ('src1', 'src2') AS curated FROM documents)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (the first three words), author (the source), lang, first_line, body, text, lines, curated."""
    text = F.col("text")
    title = F.array_join(F.slice(tokens(text, LATIN), 1, 3), " ")
    docs = _docs(spark, sf_dir).select("doc_id", title.alias("title"), F.col("source").alias("author"), "lang", "text", split_lines(text, LATIN).alias("lines"), F.col("source").isin("src1", "src2").alias("curated"))
    return docs.withColumns({"first_line": F.coalesce(F.get("lines", F.lit(0)), F.lit("")), "body": F.col("text")})


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the images and themes of each document."""
    rolled = annotate.roll_up(base._annotated(spark, sf_dir))
    of = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("canon"))).alias(f"{kind}s")
    has = rolled.groupBy("doc_id").agg(of("image"), of("theme"))
    none = F.array().cast("array<string>")
    return titled(spark, sf_dir).join(has, "doc_id", "left").withColumns({"images": F.coalesce("images", none), "themes": F.coalesce("themes", none), "book": F.col("author"), "source": F.col("author")})


QUESTION = search.Query("thanea ering tionre mente src8", filters={"lang": "fr", "source": ""})
_WANTED, _TOPICS = search.images_in(QUESTION.text, IMAGES), search.themes_in(QUESTION.text, THEMES)
_SURFACES = "|".join(search.surfaces_of(_WANTED, IMAGES))
_SHARE = f"len(list_intersect(images, {_WANTED})) / {len(_WANTED)}.0"


@_register(f"""{_ROLLED}, {_bm25(["thanea", "ering", "tionre", "mente", "src"]).strip()}, {_TITLED},
    pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS pool_rank FROM s ORDER BY score DESC, doc_id LIMIT 600), top AS (SELECT max(score) AS top FROM pool),
    has AS (SELECT doc_id, list(DISTINCT canon) FILTER (WHERE kind = 'image') AS images, list(DISTINCT canon) FILTER (WHERE kind = 'theme') AS themes FROM rolled GROUP BY 1),
    v AS (SELECT doc_id, pool_rank, author, title, text, first_line, round(10 * score / top + CASE WHEN {_SHARE} = 1 THEN 4 WHEN {_SHARE} >= 0.5 THEN 2 WHEN {_SHARE} > 0 THEN 0.5 ELSE 0 END
        + coalesce(len(list_intersect(themes, {_TOPICS})), 0) + CASE WHEN author <> '' AND contains('{QUESTION.text}', author) THEN 3 ELSE 0 END
        + CASE WHEN title <> '' AND contains('{QUESTION.text}', title) THEN 3 ELSE 0 END + CASE WHEN curated THEN 0.5 ELSE 0 END, 3) AS score
        FROM pool JOIN titled USING (doc_id) LEFT JOIN has USING (doc_id), top WHERE lang = 'fr'),
    k AS (SELECT *, row_number() OVER (PARTITION BY author, left(title, 8), left(text, 10) ORDER BY score DESC, pool_rank) AS nth FROM v)
    SELECT doc_id, CAST(score AS DOUBLE) AS score, pool_rank, coalesce(list_filter({_LINES}, lambda x: regexp_matches(lower(x), '{_SURFACES}'))[1], first_line, '') AS quote FROM k WHERE nth = 1 ORDER BY score DESC, pool_rank LIMIT 8""")
def search_full(spark, sf_dir):
    """A question with images, a theme, an author's name and a language as its filter."""
    return search.rank_works(searchable(spark, sf_dir), QUESTION, IMAGES, THEMES, LATIN)


@_register(f"""WITH {_TITLED}, r AS (SELECT title, doc_id, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS place FROM titled WHERE title <> '') SELECT * FROM r WHERE place <= 3""")
def title_shortcut(spark, sf_dir):
    """What every title finds directly."""
    works = titled(spark, sf_dir).select("doc_id", "title").where("title <> ''")
    return search.title_hits(works, works)


@_register(f"""WITH {_TITLED}, t AS (SELECT title, min(doc_id) AS doc_id FROM titled WHERE title <> '' GROUP BY 1), q AS (SELECT DISTINCT left(array_to_string({_TOKENS}, ' '), 6) AS query FROM benchmark WHERE text <> ''),
    p AS (SELECT query, title, doc_id, 'prefix' AS how FROM q JOIN t ON starts_with(title, query) WHERE query <> ''), r AS (SELECT query FROM q WHERE length(query) >= 3 AND query NOT IN (SELECT query FROM p))
    SELECT * FROM p UNION ALL SELECT query, title, doc_id, 'inside' FROM r JOIN t ON contains(title, query)""")
def titles_containing(spark, sf_dir):
    """Titles that begin with, or else have inside, the first six letters of a benchmark item."""
    asked = _table(spark, sf_dir, "benchmark").select(F.left(F.array_join(tokens(F.col("text"), LATIN), " "), F.lit(6)).alias("query"))
    return search.titles_with(titled(spark, sf_dir).select("doc_id", "title"), asked)


SKILLS = [("image.moon", "thanea anea moon words"), ("image.river", "ering erin river words"), ("author.src", "mente schen the authors"), ("theme.home", "delaa lesque at home")]
EXAMPLES = [("image.moon", "anea"), ("image.river", "erin"), ("image.river", "ring"), ("theme.home", "lesq")]
_SKILLS = "skills(skill, description) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SKILLS) + "), examples(skill, core) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EXAMPLES) + ")"


@_register(f"""WITH {_SKILLS}, q AS (SELECT conv_id || '/' || turn AS question_id, lower(text) AS f FROM conversations),
    e AS (SELECT question_id, arg_min(skill, (-length(core), skill)) AS skill FROM q JOIN examples ON contains(f, core) GROUP BY 1),
    sd AS (SELECT skill, row_number() OVER (ORDER BY skill) AS id, regexp_extract_all(lower(skill || ' ' || description), '[a-zß-ÿ]+') AS ts FROM skills), c AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM sd),
    p AS (SELECT id, skill, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, skill, len(ts) AS dl, unnest(ts) AS term FROM sd) GROUP BY 1, 2, 3), d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    w AS (SELECT DISTINCT question_id, unnest(regexp_extract_all(f, '[a-zß-ÿ]+')) AS term FROM q WHERE question_id NOT IN (SELECT question_id FROM e)),
    s AS (SELECT question_id, id, skill, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score FROM w JOIN p USING (term) JOIN d USING (term), c GROUP BY 1, 2, 3),
    b AS (SELECT question_id, arg_min(skill, (-round(score, 9), id)) AS skill FROM s GROUP BY 1)
    SELECT question_id, coalesce(e.skill, b.skill) AS skill, CASE WHEN e.skill IS NOT NULL THEN 'example' WHEN b.skill IS NOT NULL THEN 'description' ELSE 'none' END AS via FROM q LEFT JOIN e USING (question_id) LEFT JOIN b USING (question_id)""")
def skill_route(spark, sf_dir):
    """Every turn of the conversations as a question to the catalogue of skills."""
    asked = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), "text")
    return search.route(asked, spark.createDataFrame(SKILLS, "skill string, description string"), spark.createDataFrame(EXAMPLES, "skill string, core string"), LATIN)


# --- resolution ------------------------------------------------------------------------------------------------------------
@_register(f"""WITH {_TITLED}, w AS (SELECT *, {_CONTENT.format("first_line")} AS first, {_CONTENT.format("text")} AS body FROM titled),
    r AS (SELECT doc_id * 4 AS ref_id, doc_id AS id, NULL AS title, NULL AS author, NULL AS line FROM w UNION ALL SELECT doc_id * 4 + 1, NULL, title, '', '' FROM w
      UNION ALL SELECT doc_id * 4 + 2, NULL, title, author, '' FROM w UNION ALL SELECT doc_id * 4 + 3, NULL, title, 'nobody', {_CONTENT.format("left(replace(replace(first_line, '#', ''), '@', ''), 30)")} FROM w),
    m AS (SELECT ref_id, w.doc_id, body FROM r JOIN w ON w.doc_id = r.id UNION ALL SELECT ref_id, w.doc_id, body FROM r JOIN w ON w.title = r.title AND (r.author = '' OR r.author = w.author) AND (line = '' OR contains(first, line)) WHERE r.id IS NULL)
    SELECT r.ref_id, CASE WHEN count(m.doc_id) = 0 THEN 'not_found' WHEN count(DISTINCT body) = 1 THEN 'unique' ELSE 'ambiguous' END AS status, count(m.doc_id) AS n_candidates,
           CASE WHEN count(DISTINCT body) = 1 THEN min(m.doc_id) END AS selected FROM r LEFT JOIN m USING (ref_id) GROUP BY 1""")
def resolve_references(spark, sf_dir):
    """Four references to every document: by id, by title, by title and author, and to an author who did not write it."""
    works = once(titled(spark, sf_dir).select("doc_id", "title", "author", "first_line", "body"))
    line = F.left(F.translate("first_line", "#@", ""), F.lit(30))
    forms = F.array(F.concat(F.lit("id:"), F.col("doc_id").cast("string")), F.col("title"), F.concat_ws("@", "title", "author"), F.concat("title", F.lit("@nobody#"), line))
    refs = works.select("doc_id", F.posexplode(forms).alias("k", "ref")).select((F.col("doc_id") * 4 + F.col("k")).alias("ref_id"), "ref")
    return resolve.resolve(refs, works, LATIN)


@_register(f"""WITH {_TITLED}, s AS (SELECT title FROM titled WHERE title <> '' GROUP BY 1 HAVING count(DISTINCT {_CONTENT.format("text")}) > 1),
    r AS (SELECT title, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS place, doc_id, title || '@' || author || '#' || left(first_line, 5) AS ref FROM titled JOIN s USING (title)) SELECT * FROM r WHERE place <= 6""")
def ambiguity_cards(spark, sf_dir):
    return resolve.ambiguity_cards(titled(spark, sf_dir), LATIN)


ALIASES = [("the first", "src1"), ("number two", "src2"), ("nobody", "src999")]
NAMES = ["src1", "the first", "src1x", "rc1", "nobody", "src", "", "number two"]
_NAMES = "asked(name) AS (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + "), aliases(alias, author) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ")"


@_register(f"""WITH {_NAMES}, known AS (SELECT DISTINCT source AS author FROM documents), t AS (SELECT name, k.author AS own, a.author AS other FROM asked LEFT JOIN known k ON k.author = name
      LEFT JOIN (SELECT alias, author FROM aliases WHERE author IN (SELECT author FROM known)) a ON a.alias = name),
    n AS (SELECT name, author, row_number() OVER (PARTITION BY name ORDER BY author) AS k FROM t JOIN known ON contains(author, name) WHERE own IS NULL AND other IS NULL AND name <> ''),
    s AS (SELECT name, string_agg(author, ',' ORDER BY author) AS suggestions FROM n WHERE k <= 8 GROUP BY 1)
    SELECT name, CASE WHEN coalesce(own, other) IS NULL THEN 'not_found' ELSE 'unique' END AS status, coalesce(own, other, '') AS author, CASE WHEN own IS NULL AND other IS NOT NULL THEN name || '→' || other ELSE '' END AS via,
           coalesce(suggestions, '') AS suggestions FROM t LEFT JOIN s USING (name)""")
def alias_resolution(spark, sf_dir):
    known = _docs(spark, sf_dir).select(F.col("source").alias("author")).distinct()
    return resolve.resolve_names(spark.createDataFrame([(n,) for n in NAMES], "name string"), known, spark.createDataFrame(ALIASES, "alias string, author string"))


TUNES = [(1, "alpha"), (1, "src1"), (1, "rc3"), (2, "beta"), (2, "nothing")]
_TUNES = "groups(group_id, name) AS (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in TUNES) + ")"


@_register(f"""WITH {_TUNES}, asked(name) AS (VALUES ('src5'), ('alpha'), ('beta'), ('rc1')), prof AS (SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 2),
    x AS (SELECT name, source, n FROM asked JOIN prof ON source = name), r AS (SELECT name FROM asked WHERE name NOT IN (SELECT name FROM x)),
    c AS (SELECT name, name AS candidate FROM r UNION SELECT r.name, h.name FROM r JOIN groups g ON g.name = r.name JOIN groups h USING (group_id)),
    m AS (SELECT DISTINCT c.name, source, n FROM c JOIN prof ON contains(source, candidate))
    SELECT name, source, n, 'exact' AS via FROM x UNION ALL SELECT name, arg_max(source, (n, source)), max(n), 'alias' FROM m GROUP BY 1""")
def alias_panorama(spark, sf_dir):
    prof = profiles.modal_profiles(_docs(spark, sf_dir).select("source", "lang"), "source", "lang")
    asked = spark.createDataFrame([("src5",), ("alpha",), ("beta",), ("rc1",)], "name string")
    return resolve.panorama(asked, spark.createDataFrame(TUNES, "group_id int, name string"), prof, "source")


@_register(f"""{_HITS}, f AS (SELECT doc_id, canon AS image, min(line_no) AS line_no FROM hits WHERE kind = 'image' GROUP BY 1, 2), l AS ({base._LINE_ROWS})
    SELECT image, f.doc_id, CAST(f.line_no AS INT) AS line_no, line AS quote FROM f JOIN l ON l.doc_id = f.doc_id AND l.line_no = f.line_no""")
def image_examples(spark, sf_dir):
    """Every document of every image, with the first line that has it."""
    found = base._annotated(spark, sf_dir).where("kind = 'image'").groupBy("doc_id", F.col("canon").alias("image")).agg(F.min("line_no").alias("line_no"))
    lines = annotate.lines_of(_docs(spark, sf_dir), F.col("text"), LATIN)
    return found.join(lines, ["doc_id", "line_no"]).select("image", "doc_id", "line_no", F.col("line").alias("quote"))


@_register(f"""{_HITS} SELECT doc_id, CAST(line_no AS INT) AS line_no, coalesce(string_agg(canon, ',' ORDER BY pos) FILTER (WHERE kind = 'image'), '') AS images, coalesce(string_agg(canon, ',' ORDER BY pos) FILTER (WHERE kind = 'feeling' AND NOT negated), '') AS feelings,
    coalesce(string_agg(canon, ',' ORDER BY pos) FILTER (WHERE kind = 'feeling' AND negated), '') AS negated, count(*) FILTER (WHERE kind = 'feeling' AND NOT negated) - count(*) FILTER (WHERE kind = 'feeling' AND negated) AS density FROM hits GROUP BY 1, 2""")
def scene_lines(spark, sf_dir):
    """Each line that has anything: its images and feelings in order, and feelings less negated ones."""
    feeling = F.col("kind") == "feeling"
    spelt = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "canon")))), lambda x: x["canon"]), ",")
    return base._annotated(spark, sf_dir).groupBy("doc_id", "line_no").agg(
        spelt(F.col("kind") == "image").alias("images"), spelt(feeling & ~F.col("negated")).alias("feelings"), spelt(feeling & F.col("negated")).alias("negated"),
        (F.count_if(feeling & ~F.col("negated")) - F.count_if(feeling & F.col("negated"))).alias("density"),
    )


SEEDS = [("s1", "moonlight", ("thanea", "anea"), "farewell"), ("s2", "crossing", ("ering", "erin the"), "farewell and return"), ("s3", "stillness", ("keiten",), "rest")]
HINTS = {"farewell": ("mente", "the", "und"), "return": ("de", "la")}


def _allusion_sql(seed) -> str:
    number, name, surfaces, implies = seed
    words = [w for key, ws in HINTS.items() if key in implies for w in ws]
    ranked = sorted(surfaces, key=lambda s: -len(s))
    surface = "CASE " + " ".join(f"WHEN contains(f, '{s}') THEN '{s}'" for s in ranked) + " END"
    signals = " || ".join(f"CASE WHEN contains(w, '{x}') THEN ['{x}'] ELSE [] END" for x in words) or "[]"
    return f"""SELECT doc_id, '{number}' AS seed_id, '{name}' AS name, surface, pos, array_to_string({signals}, ',') AS signals FROM (SELECT *, substr(f, greatest(pos - 8, 0) + 1, least(pos, 8) + length(surface) + 8) AS w
        FROM (SELECT *, strpos(f, surface) - 1 AS pos FROM (SELECT doc_id, f, {surface} AS surface FROM f)) WHERE surface IS NOT NULL)"""


@_register("WITH f AS (SELECT doc_id, lower(text) AS f FROM documents) " + " UNION ALL ".join(map(_allusion_sql, SEEDS)))
def allusion_candidates(spark, sf_dir):
    return resolve.allusions(_docs(spark, sf_dir), SEEDS, HINTS, LATIN)


MOODS = {"thes": [("image", "moon"), ("feeling", "longing")], "sch": [("theme", "home")]}
_PLAIN = _HITS.replace(base._LINE_ROWS, "SELECT item_id AS doc_id, 0 AS line_no, text AS line FROM benchmark").replace("WITH l0", "l0b").replace("f0", "f0b").replace("h0", "h0b").replace("hits AS", "wanted AS").replace("FROM l0)", "FROM l0b)")


@_register(f"""{_ROLLED}, {_PLAIN}, asked AS (SELECT DISTINCT doc_id AS mood_id, kind, canon FROM wanted """ + " ".join(
    f"UNION SELECT item_id, '{kind}', '{canon}' FROM benchmark WHERE contains(lower(text), '{key}')" for key, ws in MOODS.items() for kind, canon in ws) + """),
    s AS (SELECT mood_id, doc_id, sum(CASE kind WHEN 'image' THEN 2.0 WHEN 'theme' THEN 3.0 ELSE 1.5 END) AS s FROM asked JOIN rolled USING (kind, canon) GROUP BY 1, 2),
    v AS (SELECT mood_id, doc_id, CAST(s + CASE WHEN source IN ('src1', 'src2') THEN 1 ELSE 0 END AS DOUBLE) AS score FROM s JOIN documents USING (doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY mood_id ORDER BY score DESC, doc_id) AS place FROM v) SELECT mood_id, place, doc_id, score FROM k WHERE place <= 6""")  # fmt: skip
def mood_match_batch(spark, sf_dir):
    """Six documents for the mood of each benchmark item."""
    moods = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("mood_id"), "text")
    return resolve.recommend(moods, annotate.roll_up(base._annotated(spark, sf_dir)), titled(spark, sf_dir), LEXICONS, MOODS, LATIN, 6)


@_register(f"""WITH d AS (SELECT doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' AS hay FROM documents), q AS (SELECT item_id, array_to_string({_TOKENS}, '') AS folded, {_TOKENS} AS u FROM benchmark),
    m AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN d ON len(u) > 0 AND contains(hay, ' ' || array_to_string(u, ' ') || ' ') GROUP BY 1)
    SELECT item_id, CASE WHEN NOT contains(folded, 'q') THEN 'letter missing' WHEN length(folded) < 4 THEN 'too short' WHEN m.doc_id IS NULL THEN 'not in the corpus' ELSE 'valid' END AS verdict,
           CASE WHEN contains(folded, 'q') AND length(folded) >= 4 THEN m.doc_id END AS doc_id FROM q LEFT JOIN m USING (item_id)""")
def line_game_check(spark, sf_dir):
    """Each benchmark item as a player's line for the letter q: it must have the letter and stand in a document, word for word."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", units(F.col("text"), LATIN).alias("u"))
    docs = _docs(spark, sf_dir).select("doc_id", units(F.col("text"), LATIN).alias("unit"))
    met = lookup.occurrences(docs, items.select(F.col("u").alias("passage"))).groupBy(F.col("passage").alias("u")).agg(F.min("doc_id").alias("doc_id"))
    folded = F.array_join("u", "")
    fits = F.contains(folded, F.lit("q")) & (F.length(folded) >= 4)
    verdict = F.when(~F.contains(folded, F.lit("q")), "letter missing").when(F.length(folded) < 4, "too short").when(F.col("doc_id").isNull(), "not in the corpus").otherwise("valid")
    return items.join(met, "u", "left").select("item_id", verdict.alias("verdict"), F.when(fits, F.col("doc_id")).alias("doc_id"))


_ASKED = f"""SELECT item_id, {_TOKENS} AS u FROM benchmark UNION ALL SELECT 100000 + item_id, {_TOKENS}[1:1 + item_id % 7] FROM benchmark"""


@_register(f"""{_REUSE}, b AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY length DESC, pa, pb) AS k FROM r), sp AS (SELECT b.a, b.b, ' ' || array_to_string(u[pa + 1 : pa + length], ' ') || ' ' AS span FROM b JOIN t ON t.doc_id = b.a WHERE k = 1),
    q AS (SELECT item_id, u, ' ' || array_to_string(u, ' ') || ' ' AS needle FROM ({_ASKED})), m AS (SELECT DISTINCT item_id, a, b FROM q JOIN sp ON len(u) > 0 AND contains(span, needle)),
    tk AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), ln AS (SELECT doc_id, len(ts) AS dl FROM tk), cn AS (SELECT count(*) AS n, avg(dl) AS av FROM ln),
    qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(u) AS term FROM q WHERE item_id NOT IN (SELECT item_id FROM m))),
    pt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM pt GROUP BY 1),
    sc AS (SELECT item_id, pt.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 9) AS score FROM qt JOIN pt USING (term) JOIN df USING (term) JOIN ln USING (doc_id), cn GROUP BY 1, 2),
    nr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM sc)
    SELECT item_id, 'pair' AS kind, a, b, 0 AS place FROM m UNION ALL SELECT item_id, 'nearest', doc_id, NULL, place FROM nr WHERE place <= 5""")
def intertext_lookup(spark, sf_dir):
    """For each benchmark item, and for its first one to seven words: the pairs of documents whose shared passage has all of it; for
    those that no passage has, the five nearest documents."""
    found, sizes = base._runs(spark, sf_dir)
    best = once(intertext.best_runs(found, sizes).select("a", "b", "pa", "length"))
    asked_of = best.groupBy(F.col("a").alias("doc_id")).agg(F.collect_list(F.struct("b", "pa", "length")).alias("spans"))
    held = _docs(spark, sf_dir).select("doc_id", "text").join(asked_of, "doc_id")  # so that a text moves as it is, and once
    each = held.select("doc_id", units(F.col("text"), LATIN).alias("unit"), "spans").select("doc_id", "unit", F.explode("spans").alias("x"))
    span = F.slice("unit", F.col("x.pa").cast("int") + 1, F.col("x.length").cast("int"))
    spans = each.select(F.struct(F.col("doc_id").alias("a"), "x.b").alias("doc_id"), span.alias("unit"))
    items = _table(spark, sf_dir, "benchmark").select("item_id", units(F.col("text"), LATIN).alias("u"))
    opening = items.select((F.col("item_id") + 100000).alias("item_id"), F.slice("u", F.lit(1), (1 + F.col("item_id") % 7).cast("int")).alias("u"))
    asked = once(items.unionByName(opening))
    met = lookup.occurrences(spans, asked.select(F.col("u").alias("passage"))).withColumnRenamed("passage", "u")
    pairs = once(asked.join(met, "u").select("item_id", F.col("doc_id.a").alias("a"), F.col("doc_id.b").alias("b")))
    rest = asked.join(pairs.select("item_id").distinct(), "item_id", "left_anti")
    near = index.top(indexed_texts(spark, sf_dir), rest.select(F.col("item_id").alias("query_id"), F.explode("u").alias("term")), 5)
    return pairs.select("item_id", F.lit("pair").alias("kind"), "a", "b", F.lit(0).cast("long").alias("place")).unionByName(
        near.select(F.col("query_id").alias("item_id"), F.lit("nearest").alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("rank").alias("place"))
    )


def indexed_texts(spark: SparkSession, sf_dir: str) -> index.StoredIndex:
    """The stored index of the documents' texts, built where it is not there or where they have changed."""
    folder = f"{shared_folder(spark)}/text-blocks-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return index.refresh(_table(spark, sf_dir, "documents"), F.col("text"), LATIN, folder)[0]


@_register(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(ts) AS word FROM t) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM w), g(head, gloss) AS (VALUES ('the', 'article'), ('und', 'and'), ('de', 'of'), ('la', 'article'), ('The', 'never first'))
    SELECT doc_id, word, gloss FROM r JOIN (SELECT lower(head) AS word, arg_min(gloss, o) AS gloss FROM (SELECT head, gloss, row_number() OVER () AS o FROM g) GROUP BY 1) USING (word) WHERE rank <= 8""")
def gloss_entries(spark, sf_dir):
    """The glosses of the eight most frequent words of each document; of two entries for a word the first counts."""
    entries = [(0, "the", "article"), (1, "und", "and"), (2, "de", "of"), (3, "la", "article"), (4, "The", "never first")]
    glossary = spark.createDataFrame(entries, "o int, head string, gloss string").groupBy(F.lower("head").alias("word")).agg(F.min_by("gloss", "o").alias("gloss"))
    return base.gloss_top_words(spark, sf_dir).join(glossary, "word").select("doc_id", "word", "gloss")
