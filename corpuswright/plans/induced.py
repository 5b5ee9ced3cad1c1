"""Registered queries of rule families and of the profiles induced from them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LATIN, split_lines
from ..operators import annotate, metrics, profiles, rules
from ..operators.components import connected_components
from ..operators.stage import once, shared_folder
from ..sources import skills
from . import queries as base
from .queries import _COUNTS, _FORM, _HITS, _LINES, _ROLLED, _RULES, _docs, _table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
OPPOSED = [("joy", "sorrow"), ("longing", "rest")]


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, lines, counts, n_lines, pattern, form, feet of every document."""
    lines = _docs(spark, sf_dir).select("doc_id", "lang", "source", split_lines(F.col("text"), LATIN).alias("lines"))
    counted = lines.select("*", metrics.line_counts(F.col("lines"), LATIN).alias("counts"))
    n_lines, _, _, pattern = metrics.describe(F.col("counts"))
    return counted.select("*", n_lines, pattern, metrics.detect_form(F.col("counts")).alias("form"), metrics.feet(F.col("lines"), LATIN, 2).alias("feet"))


# --- rules ---------------------------------------------------------------------------------------------------------------
_THEMES = """tm AS (SELECT doc_id, canon AS theme, surface, count(*) AS n, min((line_no, pos)) AS spot FROM hits WHERE kind = 'theme' GROUP BY 1, 2, 3),
    themes AS (SELECT doc_id, theme, count(*) AS n_markers, array_to_string(list(surface ORDER BY spot, surface)[1:6], ',') AS markers, min(spot) AS spot, CASE WHEN count(*) >= 2 THEN 0 ELSE 2 END AS strength
               FROM tm GROUP BY 1, 2 HAVING count(*) >= 2 OR max(CASE WHEN length(surface) >= 2 THEN n ELSE 0 END) >= 2)"""
_WORKS = f"""w0 AS (SELECT doc_id, lang, source, {_LINES} AS ls, {_COUNTS} AS c FROM documents),
    works AS (SELECT doc_id, lang, source, CAST(len(c) AS BIGINT) AS n_lines, array_to_string(c, '-') AS pattern, {_FORM} AS form,
      list_filter(list_transform(ls, lambda x, i: CASE WHEN i % 2 = 0 THEN right(array_to_string(regexp_extract_all(lower(x), '[a-zß-ÿ]+'), ''), 2) ELSE '' END), lambda x: x <> '') AS feet FROM w0)"""
_ALL = f"""{_RULES}, {_THEMES}, {_WORKS},
    families AS (SELECT doc_id, 0 AS fam, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS o, 'image_feeling' AS rule_type, image AS subject, feeling AS object, strength, line_no FROM rules
      UNION ALL SELECT doc_id, 1, row_number() OVER (PARTITION BY doc_id ORDER BY spot, theme), 'theme', theme, markers, strength, CAST(spot[1] AS BIGINT) FROM themes
      UNION ALL SELECT doc_id, 2, 1, 'form', form, md5(pattern), 0, 0 FROM works WHERE n_lines > 0
      UNION ALL SELECT doc_id, 3, 1, 'rhyme', 'feet', array_to_string(feet, ','), 0, n_lines // 2 * 2 - 1 FROM works WHERE len(feet) >= 2 AND n_lines <= 8),
    numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY fam, o) AS seq, rule_type, subject, object, strength, line_no FROM families)"""


def rule_families(spark, sf_dir, found: DataFrame | None = None, w: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, rule_id, rule_type, subject, object, strength, line_no: every rule of every document."""
    found = base._annotated(spark, sf_dir) if found is None else found
    w = works(spark, sf_dir) if w is None else w
    shape = lambda df, kind, subject, obj, strength, *keep: df.select(
        "doc_id", F.lit(kind).alias("rule_type"), subject.alias("subject"), obj.alias("object"), strength.cast("long").alias("strength"), F.col("line_no").cast("long").alias("line_no"), *keep
    )
    image = annotate.image_feeling_rules(found)
    zero = F.lit(0)
    return rules.number_rules(
        (shape(image, "image_feeling", F.col("image"), F.col("feeling"), F.col("strength"), F.col("seq").alias("k")), ["k"]),
        (shape(rules.theme_rules(found), "theme", F.col("theme"), F.col("markers"), F.col("strength"), F.col("pos").alias("k"), F.col("theme").alias("t")), ["line_no", "k", "t"]),
        (shape(rules.form_rules(w), "form", F.col("form"), F.md5("pattern"), zero), ["line_no"]),
        (shape(rules.rhyme_rules(w), "rhyme", F.lit("feet"), F.col("feet"), zero), ["line_no"]),
    ).drop("k", "t")


@_register(f"{_ALL} SELECT *, printf('R%d_%03d', doc_id, seq) AS rule_id FROM numbered")
def rules_sequence_ids(spark, sf_dir):
    return rule_families(spark, sf_dir).select("doc_id", "seq", "rule_type", "subject", "object", "strength", "line_no", "rule_id")


@_register("""WITH n AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS note_no, trim(text) AS note FROM conversations)
    SELECT * FROM n WHERE note_no < 20 AND length(note) >= 4""")
def annotation_rules(spark, sf_dir):
    """The turns of a conversation as the notes of a work."""
    turns = _table(spark, sf_dir, "conversations")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return rules.annotation_rules(turns.select(F.col("conv_id").alias("doc_id"), number.alias("note_no"), F.col("text").alias("note")))


_SPACED = "' ' || array_to_string(regexp_extract_all(lower({}), '[a-zß-ÿ]+'), ' ') || ' '"


@_register(f"""WITH f AS (SELECT doc_id, source, {_SPACED.format("x")} AS line FROM (SELECT doc_id, source, {_LINES}[1] AS x FROM documents)
      WHERE len(regexp_extract_all(lower(x), '[a-zß-ÿ]+')) > 0), h AS (SELECT doc_id AS ext_id, source, {_SPACED.format("text")} AS hay FROM documents)
    SELECT doc_id, min(ext_id) AS ext_id FROM f JOIN h ON h.source = f.source AND ext_id <> doc_id AND contains(hay, line) GROUP BY 1""")
def external_binding(spark, sf_dir):
    """Each document bound to the first other one of its source that has its first line."""
    docs = _docs(spark, sf_dir)
    lines = docs.select("doc_id", F.col("source").alias("author"), F.get(split_lines(F.col("text"), LATIN), F.lit(0)).alias("first_line"))
    return rules.bind_external(lines, docs.select(F.col("doc_id").alias("ext_id"), F.col("source").alias("author"), "text"), LATIN)


@_register(f"""WITH w0 AS (SELECT doc_id, {_COUNTS} AS c, source FROM documents),
    t AS (SELECT doc_id, source, {_FORM} AS form FROM w0) SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN source WHEN source IN ('src3', 'src4') THEN 'letters' ELSE form END AS genre FROM t""")
def genre_resolution(spark, sf_dir):
    """An explicit genre first, then the first tag that is one, then the form."""
    explicit = F.when(F.col("source").isin("src1", "src2"), F.col("source")).otherwise("")
    tags = F.when(F.col("source").isin("src3", "src4"), F.array(F.lit("unknown"), F.lit("letters"))).otherwise(F.array().cast("array<string>"))
    return works(spark, sf_dir).select("doc_id", metrics.resolve_genre(explicit, tags, ["letters"], F.col("form")).alias("genre"))


# --- profiles --------------------------------------------------------------------------------------------------------------
@_register(f"""{_RULES} SELECT image, feeling, count(*) AS support, count(*) FILTER (WHERE strength = 0) AS same_line, count(*) FILTER (WHERE strength = 1) AS next_line,
    arg_min(doc_id, (strength, doc_id, seq)) AS best_doc, arg_min(line_no, (strength, doc_id, seq)) AS best_line FROM rules GROUP BY 1, 2""")
def image_associations(spark, sf_dir):
    return profiles.image_associations(annotate.image_feeling_rules(base._annotated(spark, sf_dir)))


def _top(rows: str, key: str, item: str, k: int, name: str) -> str:
    """CTEs that give `item:n` of the k most frequent items of a key in one string; `rows` has a row a member."""
    return f"""{name}_c AS (SELECT {key}, {item} AS item, count(*) AS n FROM ({rows}) GROUP BY 1, 2),
        {name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, item) AS r FROM {name}_c),
        {name} AS (SELECT {key}, string_agg(item || ':' || n, ',' ORDER BY r) AS {name} FROM {name}_r WHERE r <= {k} GROUP BY 1)"""


_CONFLICTS = " || ".join(f"CASE WHEN list_contains(fs, '{a}') AND list_contains(fs, '{b}') THEN ['{a}/{b}'] ELSE [] END" for a, b in OPPOSED)


@_register(f"""{_RULES}, has AS (SELECT DISTINCT doc_id, canon FROM live WHERE kind = 'image'), held AS (SELECT DISTINCT image, doc_id FROM rules),
    {_top("SELECT image, lang FROM held JOIN documents USING (doc_id)", "image", "lang", 100, "eras")}, {_top("SELECT image, canon FROM held JOIN has USING (doc_id) WHERE canon <> image", "image", "canon", 8, "co_images")},
    per_image AS (SELECT image, count(*) AS n_rules, count(DISTINCT doc_id) AS n_docs, list(DISTINCT feeling) AS fs FROM rules GROUP BY 1)
    SELECT image, n_rules, n_docs, eras, coalesce(co_images, '') AS co_images, array_to_string({_CONFLICTS}, ',') AS conflicts, round(CAST(least(0.95, 0.6 + 0.02 * n_rules) AS DOUBLE), 3) AS score,
           CASE WHEN n_rules >= 8 THEN 'gold' WHEN n_rules >= 3 THEN 'silver' ELSE 'bronze' END AS level FROM per_image JOIN eras USING (image) LEFT JOIN co_images USING (image)""")
def image_profiles(spark, sf_dir):
    found = base._annotated(spark, sf_dir)
    return profiles.image_profiles(once(annotate.image_feeling_rules(found)), annotate.roll_up(found), _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("era")), OPPOSED)


@_register(f"""{_HITS}, live AS (SELECT * FROM hits WHERE NOT negated), {_THEMES}, has AS (SELECT DISTINCT doc_id, canon FROM live WHERE kind = 'image'),
    {_top("SELECT theme, canon FROM themes JOIN has USING (doc_id)", "theme", "canon", 10, "top_images")},
    e AS (SELECT theme, doc_id, row_number() OVER (PARTITION BY theme ORDER BY strength, doc_id) AS k FROM themes), x AS (SELECT theme, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) AS examples FROM e WHERE k <= 8 GROUP BY 1)
    SELECT theme, count(*) AS n_docs, coalesce(any_value(top_images), '') AS top_images, any_value(examples) AS examples, CASE WHEN count(*) >= 30 THEN 'gold' ELSE 'silver' END AS level
    FROM themes LEFT JOIN top_images USING (theme) JOIN x USING (theme) GROUP BY 1""")
def theme_profile(spark, sf_dir):
    found = base._annotated(spark, sf_dir)
    return profiles.theme_profiles(once(rules.theme_rules(found)), annotate.roll_up(found))


@_register(f"""WITH {_WORKS}, c AS (SELECT source, CASE WHEN n_lines < 10 THEN 'short' WHEN n_lines < 100 THEN 'middle' ELSE 'long' END AS shape, n_lines FROM works WHERE source <> '' AND source <> 'unknown'),
    k AS (SELECT source, shape, count(*) AS k FROM c GROUP BY 1, 2), m AS (SELECT source, CAST(sum(k) AS BIGINT) AS n, arg_min(shape, (-k, shape)) AS mode, max(k) AS mode_n FROM k GROUP BY 1 HAVING sum(k) >= 2),
    l AS (SELECT source, arg_min(n_lines, (-k, n_lines)) AS number_mode FROM (SELECT source, n_lines, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
    SELECT source, n, mode, mode_n, round(mode_n / n, 4) AS consistency, CASE WHEN n >= 5 AND mode_n / n >= 0.5 THEN 'silver' ELSE 'bronze' END AS level, number_mode FROM m JOIN l USING (source)""")
def modal_pattern(spark, sf_dir):
    """Each source as a tune: the mode of its documents' shapes and of their numbers of lines."""
    shape = F.when(F.col("n_lines") < 10, "short").when(F.col("n_lines") < 100, "middle").otherwise("long")
    return profiles.modal_profiles(works(spark, sf_dir).select("source", shape.alias("shape"), "n_lines"), "source", "shape", "n_lines", left_out=("unknown",))


def _facets(parts: dict[str, tuple[str, str, int | None]], key: str) -> str:
    """A UNION of each facet's most frequent values: name -> (rows with the key, column, how many)."""
    out = []
    for name, (rows, column, most) in parts.items():
        limit = f" WHERE rank <= {most}" if most else ""
        out.append(f"""SELECT {key}, '{name}' AS facet, rank, value, n FROM (SELECT {key}, CAST({column} AS VARCHAR) AS value, count(*) AS n,
            row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS rank FROM ({rows}) JOIN enough USING ({key}) GROUP BY {key}, {column}){limit}""")
    return " UNION ALL ".join(out)


@_register(f"""{_ROLLED}, {_WORKS}, enough AS (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 5), r AS (SELECT source, kind, canon FROM rolled JOIN documents USING (doc_id)) """ + _facets({
    "image": ("SELECT source, canon FROM r WHERE kind = 'image'", "canon", 10), "theme": ("SELECT source, canon FROM r WHERE kind = 'theme'", "canon", 6), "form": ("SELECT source, form FROM works", "form", None),
    "era": ("SELECT source, lang FROM documents", "lang", 1)}, "source"))
def author_profile(spark, sf_dir):
    """Each source as an author, if it has five documents: its images, themes, forms and main language."""
    w = once(works(spark, sf_dir).select("doc_id", "source", "lang", "form"))
    rolled = once(annotate.roll_up(base._annotated(spark, sf_dir)).select("doc_id", "kind", "canon").join(w.select("doc_id", "source"), "doc_id"))
    of = lambda kind: rolled.where(F.col("kind") == kind).select("source", "canon")
    return profiles.group_profiles(w, "source", {"image": (of("image"), "canon", 10), "theme": (of("theme"), "canon", 6), "form": (w, "form", None), "era": (w, "lang", 1)})


@_register("""WITH enough AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 5), o AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders) """ + _facets({
    "priority": ("SELECT o_custkey, o_orderpriority FROM o", "o_orderpriority", 3), "status": ("SELECT o_custkey, o_orderstatus FROM o", "o_orderstatus", None)}, "o_custkey"))
def customer_profile(spark, sf_dir):
    """The author profile on customers with five orders."""
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    return profiles.group_profiles(orders, "o_custkey", {"priority": (orders, "o_orderpriority", 3), "status": (orders, "o_orderstatus", None)})


_FEET = f"""feet AS (SELECT DISTINCT doc_id, unnest(feet) AS node FROM works)"""
_GROUPS = f"""{base.ORACLES["foot_components"].replace(" SELECT node, min(seen) AS component FROM r GROUP BY 1", "")}, comp AS (SELECT node, min(seen) AS component FROM r GROUP BY 1),
    {_WORKS}, {_FEET}, held AS (SELECT doc_id, node, component FROM feet JOIN comp USING (node)),
    freq AS (SELECT component, node, count(*) AS n, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, node) AS k FROM held GROUP BY 1, 2),
    label AS (SELECT component, string_agg(node, '·' ORDER BY k) AS label FROM freq WHERE k <= 3 GROUP BY 1)"""


def _groups(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    components = once(base.foot_components(spark, sf_dir))
    support = works(spark, sf_dir).select("doc_id", F.explode("feet").alias("node")).distinct()
    return components, profiles.component_profiles(components, support)


@_register(f"""{_GROUPS}, size AS (SELECT component, count(*) AS n_members FROM comp GROUP BY 1), docs AS (SELECT component, count(DISTINCT doc_id) AS n_docs FROM held GROUP BY 1)
    SELECT component, label, n_members, n_docs, n_members > 250 AS low_purity, row_number() OVER (ORDER BY n_members DESC, component) AS rank FROM size JOIN docs USING (component) JOIN label USING (component)""")
def foot_groups(spark, sf_dir):
    """Groups of feet that rhyme, labelled by their three most frequent members."""
    return _groups(spark, sf_dir)[1]


@_register(f"{_GROUPS} SELECT node, label FROM comp JOIN label USING (component)")
def foot_labels(spark, sf_dir):
    """The label of the group that a foot is in."""
    components, groups = _groups(spark, sf_dir)
    return components.join(groups.select("component", "label"), "component").select("node", "label")


_NODES = f"{_ROLLED}, f AS (SELECT canon, count(*) AS freq FROM rolled WHERE kind = 'image' GROUP BY 1)"


@_register(f"{_NODES} SELECT canon, freq, row_number() OVER (ORDER BY freq DESC, canon) AS rank FROM f ORDER BY rank LIMIT 80")
def cooccurrence_nodes(spark, sf_dir):
    """The 80 images that most documents have (a top-k report)."""
    freq = annotate.roll_up(base._annotated(spark, sf_dir)).where("kind = 'image'").groupBy("canon").agg(F.count(F.lit(1)).alias("freq"))
    return freq.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "canon")).cast("long")).where("rank <= 80")  # a row an image of the lexicon


@_register(f"{_ROLLED}, i AS (SELECT doc_id, canon AS image FROM rolled WHERE kind = 'image'), f AS (SELECT doc_id, canon AS feeling FROM rolled WHERE kind = 'feeling'), c AS (SELECT feeling, image, count(*) AS n FROM f JOIN i USING (doc_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY feeling ORDER BY n DESC, image) AS rank FROM c) SELECT * FROM k WHERE rank <= 10")
def category_matrix_top(spark, sf_dir):
    """The ten images that go most often with each feeling."""
    return profiles.top_rows(base.category_matrix(spark, sf_dir), ["feeling"], "image", "n", 10).select("feeling", F.col("value").alias("image"), "n", "rank")


@_register(f"""{_ALL} SELECT 'documents' AS what, count(*) AS n FROM documents UNION ALL SELECT 'lines', CAST(sum(n_lines) AS BIGINT) FROM works UNION ALL SELECT 'rules:' || rule_type, count(*) FROM numbered GROUP BY rule_type
    UNION ALL SELECT 'source:' || source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'form:' || form, count(*) FROM works GROUP BY form""")
def corpus_stats(spark, sf_dir):
    """How much of everything there is."""
    w = once(works(spark, sf_dir).drop("lang", "lines"))  # the texts are split once, for the counts and for two families of rules
    found = rule_families(spark, sf_dir, w=w)
    one = F.count(F.lit(1)).alias("n")
    by = lambda df, name, column: df.groupBy(F.concat(F.lit(name), column).alias("what")).agg(one)
    return (
        w.agg(one).select(F.lit("documents").alias("what"), "n").unionByName(w.agg(F.sum("n_lines").alias("n")).select(F.lit("lines").alias("what"), "n"))
        .unionByName(by(found, "rules:", "rule_type")).unionByName(by(w, "source:", "source")).unionByName(by(w, "form:", "form"))
    )


@_register(f"""{_RULES}, i AS (SELECT image AS name, count(DISTINCT doc_id) AS n FROM rules GROUP BY 1), a AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1), u AS (
    SELECT 'image' AS family, name, n FROM i WHERE n >= 3 UNION ALL SELECT 'author', name, n FROM a WHERE n >= 8) SELECT family, name, family || ' ' || name || ': ' || n || ' works' AS description, n FROM u""")
def skill_catalogue(spark, sf_dir):
    """An entry for each image and author with enough support, described for a router."""
    image = annotate.image_feeling_rules(base._annotated(spark, sf_dir)).groupBy("image").agg(F.count_distinct("doc_id").alias("n"))
    author = base._table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))  # too little work to deal rows for
    return profiles.catalogue([("image", image, "image", F.col("n"), 3), ("author", author, "source", F.col("n"), 8)])


@_register(f"""{ORACLES["skill_catalogue"]}""")
def skill_tree(spark, sf_dir):
    """The catalogue written as a tree of text files below the shared folder, and read back."""
    folder = f"{shared_folder(spark)}/skills-{uuid.uuid4().hex}"
    entries = once(skill_catalogue(spark, sf_dir))
    body = F.concat(F.lit("# "), "name", F.lit("\n\nn: "), F.col("n").cast("string"))
    asked = entries.select("name", F.concat(F.lit("about "), "name").alias("query"), F.col("family").alias("route"))
    skills.write_tree(entries.withColumn("body", body), asked, folder)
    return skills.read_tree(spark, folder).select("family", "name", "description", F.regexp_extract("body", r"n: (\d+)", 1).cast("long").alias("n"))


_OWN_FEET = f"""{_WORKS}, own AS (SELECT doc_id, list_transform(feet, lambda x: lang || ':' || x) AS f FROM works), e AS (SELECT f[i] AS a, f[i + 1] AS b FROM own, unnest(generate_series(1, len(f) - 1)) AS g(i) WHERE len(f) >= 2),
    w AS (SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS n FROM e WHERE a <> b GROUP BY 1, 2)"""


@_register(f"""WITH RECURSIVE {_OWN_FEET}, g AS (SELECT u, v FROM w WHERE n >= 2 UNION SELECT v, u FROM w WHERE n >= 2), r(node, seen) AS (SELECT u, u FROM g UNION SELECT r.node, g.v FROM r JOIN g ON r.seen = g.u),
    comp AS (SELECT node, min(seen) AS component FROM r GROUP BY 1), held AS (SELECT doc_id, node, component FROM (SELECT DISTINCT doc_id, unnest(f) AS node FROM own) JOIN comp USING (node)),
    freq AS (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, node) AS k FROM held GROUP BY 1, 2), label AS (SELECT component, string_agg(node, '·' ORDER BY k) AS label FROM freq WHERE k <= 3 GROUP BY 1),
    size AS (SELECT component, count(*) AS n_members FROM comp GROUP BY 1), docs AS (SELECT component, count(DISTINCT doc_id) AS n_docs FROM held GROUP BY 1)
    SELECT component, label, n_members, n_docs, n_members > 250 AS low_purity, row_number() OVER (ORDER BY n_members DESC, component) AS rank FROM size JOIN docs USING (component) JOIN label USING (component)""")
def foot_groups_of_languages(spark, sf_dir):
    """Groups of feet that rhyme within a language: feet of two languages are two feet."""
    own = works(spark, sf_dir).select("doc_id", F.transform("feet", lambda x: F.concat("lang", F.lit(":"), x)).alias("f"))
    near = F.transform(F.sequence(F.lit(0), F.size("f") - 2), lambda i: F.struct(F.get("f", i).alias("a"), F.get("f", i + 1).alias("b")))
    pairs = own.where(F.size("f") >= 2).select(F.explode(near).alias("e")).where("e.a <> e.b")
    edges = pairs.groupBy(F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    components = once(connected_components(edges, "u", "v"))
    return profiles.component_profiles(components, own.select("doc_id", F.explode("f").alias("node")).distinct())
