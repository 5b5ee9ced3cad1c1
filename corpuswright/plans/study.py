"""Registered queries that put the layers together: everything about a work, lessons, examples of rhymes, research tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LATIN
from ..operators import annotate, compose, intertext, profiles, rules
from ..operators.stage import once
from . import induced
from . import queries as base
from .induced import _GROUPS, _THEMES, _WORKS, works
from .lexicons import LEXICONS
from .lookups import _PLAIN
from .queries import _ROLLED, _docs, _table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _listed(kind: str) -> str:
    return f"coalesce(string_agg(canon, ',' ORDER BY canon) FILTER (WHERE kind = '{kind}'), '') AS {kind}s"


@_register(f"""{_ROLLED}, {_WORKS}, has AS (SELECT doc_id, {_listed("image")}, {_listed("feeling")}, {_listed("theme")} FROM rolled GROUP BY 1), bound AS ({induced.ORACLES["external_binding"]}),
    lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1)
    SELECT doc_id, form, n_lines, coalesce(images, '') AS images, coalesce(feelings, '') AS feelings, coalesce(themes, '') AS themes, ext_id, quality
    FROM works LEFT JOIN has USING (doc_id) LEFT JOIN bound USING (doc_id) LEFT JOIN lab USING (doc_id)""")
def explain_doc(spark, sf_dir):
    """Every document with what each layer has about it: form, images, feelings, themes, a bound analysis, a label."""
    rolled = annotate.roll_up(base._annotated(spark, sf_dir))
    listed = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("canon")))), ",").alias(f"{kind}s")
    has = rolled.groupBy("doc_id").agg(listed("image"), listed("feeling"), listed("theme"))
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    out = works(spark, sf_dir).select("doc_id", "form", "n_lines").join(has, "doc_id", "left").join(induced.external_binding(spark, sf_dir), "doc_id", "left").join(labels, "doc_id", "left")
    return out.na.fill("", ["images", "feelings", "themes"])


TOPICS = ["travel", "杂言", "moon", "src3", "nothing"]


@_register(f"""{_ROLLED}, {_WORKS}, t(topic) AS (VALUES {", ".join(f"('{t}')" for t in TOPICS)}), c AS (
    SELECT topic, 0 AS step, 'theme' AS level, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM t JOIN rolled ON kind = 'theme' AND canon = topic GROUP BY 1 UNION ALL SELECT topic, 1, 'form', count(*), min(doc_id) FROM t JOIN works ON form = topic GROUP BY 1
    UNION ALL SELECT topic, 2, 'image', count(DISTINCT doc_id), min(doc_id) FROM t JOIN rolled ON kind = 'image' AND canon = topic GROUP BY 1 UNION ALL SELECT topic, 3, 'author', count(*), min(doc_id) FROM t JOIN works ON source = topic GROUP BY 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY step) AS k FROM c) SELECT topic, coalesce(level, 'none') AS level, coalesce(n, 0) AS n, first FROM t LEFT JOIN (SELECT * FROM b WHERE k = 1) USING (topic)""")
def teach_cascade(spark, sf_dir):
    """A lesson for each topic: the first of theme, form, image and author that knows it."""
    rolled, w = annotate.roll_up(base._annotated(spark, sf_dir)), once(works(spark, sf_dir).select("doc_id", "form", "source"))
    asked = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    kind = lambda k: rolled.where(F.col("kind") == k).select(F.col("canon").alias("topic"), "doc_id")
    steps = [("theme", kind("theme")), ("form", w.select(F.col("form").alias("topic"), "doc_id")), ("image", kind("image")), ("author", w.select(F.col("source").alias("topic"), "doc_id"))]
    found = [
        df.join(F.broadcast(asked), "topic").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).select("topic", F.struct(F.lit(k).alias("step"), F.lit(name).alias("level"), "n", "first").alias("s"))
        for k, (name, df) in enumerate(steps)
    ]
    best = reduce(DataFrame.unionByName, found).groupBy("topic").agg(F.min("s").alias("s"))
    return asked.join(best, "topic", "left").select("topic", F.coalesce("s.level", F.lit("none")).alias("level"), F.coalesce("s.n", F.lit(0)).cast("long").alias("n"), F.col("s.first").alias("first"))


_FOOT_LINES = "fl AS (SELECT doc_id, unnest(feet) AS node FROM works), inl AS (SELECT doc_id, component, node FROM fl JOIN comp USING (node)), two AS (SELECT doc_id, component FROM inl GROUP BY 1, 2 HAVING count(*) >= 2)"


@_register(f"""{_GROUPS}, {_FOOT_LINES}, e AS (SELECT node, doc_id, row_number() OVER (PARTITION BY node ORDER BY doc_id) AS place FROM (SELECT DISTINCT node, doc_id FROM inl JOIN two USING (doc_id, component))) SELECT * FROM e WHERE place <= 8""")
def foot_examples(spark, sf_dir):
    """Up to eight documents for each foot that rhyme it with another line (a top-k report)."""
    components = once(base.foot_components(spark, sf_dir))
    lines = works(spark, sf_dir).select("doc_id", F.explode("feet").alias("node")).join(components, "node")
    per = lines.groupBy("doc_id", "component").agg(F.count(F.lit(1)).alias("n"), F.collect_set("node").alias("nodes")).where("n >= 2")
    place = F.row_number().over(Window.partitionBy("node").orderBy("doc_id")).cast("long")
    return per.select(F.explode("nodes").alias("node"), "doc_id").withColumn("place", place).where("place <= 8")


@_register(f"""{_GROUPS}, c AS (SELECT a.node, b.node AS candidate, f.n, row_number() OVER (PARTITION BY a.node ORDER BY f.n DESC, b.node) AS rank FROM comp a JOIN comp b ON b.component = a.component AND b.node <> a.node
    JOIN freq f ON f.node = b.node) SELECT node, candidate, n, rank FROM c WHERE rank <= 10""")
def rhyme_candidates(spark, sf_dir):
    """For each foot the ten most frequent others of its group: what a poet may rhyme it with. Only a group's eleven most frequent
    members can be among them, so the members never meet all others."""
    components = once(base.foot_components(spark, sf_dir))
    support = works(spark, sf_dir).select("doc_id", F.explode("feet").alias("node")).distinct()
    freq = support.join(components, "node").groupBy("component", "node").agg(F.count(F.lit(1)).alias("n"))
    top = profiles.top_rows(freq, ["component"], "node", "n", 11).select("component", F.col("value").alias("candidate"), "n")
    met = components.join(top, "component").where("node <> candidate")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "candidate")).cast("long")
    return met.withColumn("rank", rank).where("rank <= 10").select("node", "candidate", "n", "rank")


@_register(f"""{_ROLLED}, c AS (SELECT doc_id, canon FROM rolled WHERE kind = 'image'), n AS (SELECT 'node' AS asset, canon AS a, '' AS b, count(*) AS n FROM c GROUP BY 2),
    e AS (SELECT 'edge' AS asset, x.canon AS a, y.canon AS b, count(*) AS n FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.canon < y.canon GROUP BY 2, 3 HAVING count(*) >= 3)
    SELECT * FROM (SELECT * FROM n ORDER BY n DESC, a LIMIT 20) UNION ALL SELECT * FROM (SELECT * FROM e ORDER BY n DESC, a, b LIMIT 20) UNION ALL SELECT 'era', lang, '', count(*) FROM documents GROUP BY lang""")
def research_assets(spark, sf_dir):
    """The twenty most frequent images, the twenty heaviest pairs of them, and the works of each era (top-k reports)."""
    nodes = induced.cooccurrence_nodes(spark, sf_dir).where("rank <= 20").select(F.lit("node").alias("asset"), F.col("canon").alias("a"), F.lit("").alias("b"), F.col("freq").alias("n"))
    edges = base.cooccurrence_network(spark, sf_dir).orderBy(F.desc("weight"), "u", "v").limit(20).select(F.lit("edge").alias("asset"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("weight").alias("n"))
    eras = _docs(spark, sf_dir).groupBy(F.col("lang").alias("a")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("era").alias("asset"), "a", F.lit("").alias("b"), "n")
    return nodes.unionByName(edges).unionByName(eras)


@_register(f"""{base._REUSE}, pairs AS (SELECT DISTINCT a, b FROM r), asked AS (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')),
    w AS (SELECT a, b, 'within' AS how FROM pairs WHERE a IN (SELECT doc_id FROM asked) AND b IN (SELECT doc_id FROM asked)), o AS (SELECT a, b, 'either' AS how FROM pairs WHERE a IN (SELECT doc_id FROM asked) OR b IN (SELECT doc_id FROM asked)) SELECT * FROM w UNION ALL SELECT * FROM o""")
def intertext_of_sources(spark, sf_dir):
    """The pairs within three sources, and those that one of their documents is in."""
    pairs = once(base._runs(spark, sf_dir)[0].select("a", "b").distinct())
    asked = _docs(spark, sf_dir).where(F.col("source").isin("src1", "src2", "src3")).select("doc_id")
    within, either = intertext.pairs_within(pairs, asked), intertext.pairs_of(pairs, asked)
    return within.withColumn("how", F.lit("within")).unionByName(either.withColumn("how", F.lit("either")))


_RANK = "coalesce(nullif(list_position(['en', 'fr', 'de', 'es'], {}), 0), 5)"


@_register(f"""WITH p AS ({base.ORACLES["intertext_pairs"]}), j AS (SELECT p.a, p.b, mode, {_RANK.format("x.lang")} AS ra, {_RANK.format("y.lang")} AS rb FROM p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b)
    SELECT a, b, mode, CASE WHEN rb < ra THEN b ELSE a END AS source_id, CASE WHEN rb < ra THEN a ELSE b END AS target_id, ra = rb AS common_source FROM j""")
def intertext_direction(spark, sf_dir):
    """Pairs of reuse from the earlier era to the later."""
    pairs = base.intertext_pairs(spark, sf_dir).select("a", "b", "mode")
    return intertext.with_direction(pairs, _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("era")), base.LANGS)


# --- aids for writing ----------------------------------------------------------------------------------------------------------
@_register(f"""{_ROLLED}, {_THEMES}, {_PLAIN}, c AS (SELECT theme, canon, count(*) AS n FROM themes JOIN rolled USING (doc_id) WHERE kind = 'image' GROUP BY 1, 2),
    r AS (SELECT theme, canon AS image, row_number() OVER (PARTITION BY theme ORDER BY n DESC, canon) AS rank FROM c), asked AS (SELECT DISTINCT doc_id AS mood_id, kind, canon FROM wanted),
    o AS (SELECT mood_id, 0 AS rank, canon AS image FROM asked WHERE kind = 'image' UNION ALL SELECT mood_id, rank, image FROM asked JOIN r ON theme = canon WHERE kind = 'theme' AND rank <= 6),
    b AS (SELECT mood_id, image, min(rank) AS rank FROM o WHERE image <> 'river' GROUP BY 1, 2), k AS (SELECT mood_id, row_number() OVER (PARTITION BY mood_id ORDER BY rank, image) AS place, image FROM b) SELECT * FROM k WHERE place <= 8""")
def image_suggestions(spark, sf_dir):
    """Images for the mood of each benchmark item, without the river."""
    found = base._annotated(spark, sf_dir)
    held = rules.theme_rules(found).select("theme", "doc_id")
    images = annotate.roll_up(found).where("kind = 'image'").select("doc_id", "canon")
    top = profiles.top_rows(held.join(images, "doc_id").groupBy("theme", "canon").agg(F.count(F.lit(1)).alias("n")), ["theme"], "canon", "n", 6).select("theme", F.col("value").alias("image"), "rank")
    moods = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("mood_id"), "text")
    return compose.suggest_images(moods, top, LEXICONS, ["river"], LATIN)


PLANS = [(1, 5, "er"), (2, 14, ""), (3, 100, "zz")]


@_register(f"""{_GROUPS}, size AS (SELECT component, count(*) AS n_members FROM comp GROUP BY 1), q(plan_id, n_lines, foot) AS (VALUES {", ".join(f"({i}, {n}, '{f}')" for i, n, f in PLANS)}),
    p AS (SELECT plan_id, greatest(8, least(60, n_lines)) // 4 AS n_segments, component AS wished FROM q LEFT JOIN comp ON node = foot),
    t AS (SELECT plan_id, n_segments, label, row_number() OVER (PARTITION BY plan_id ORDER BY coalesce(l.component = wished, false) DESC, n_members DESC, l.component) AS segment FROM p, label l JOIN size USING (component) WHERE n_members <= 250 OR coalesce(l.component = wished, false))
    SELECT plan_id, segment, (segment - 1) * 4 + 1 AS first_line, label FROM t WHERE segment <= n_segments""")
def rhyme_plan(spark, sf_dir):
    """Groups of rhymes for three poems to be: too short, in between, too long."""
    components, groups = induced._groups(spark, sf_dir)
    return compose.rhyme_plan(spark.createDataFrame(PLANS, "plan_id int, n_lines int, foot string"), groups, components)


@_register("SELECT * FROM (VALUES ('如梦令', 0, CAST(6 AS BIGINT)), ('如梦令', 1, 6), ('如梦令', 2, 5), ('忆江南', 0, 3)) AS f(tune, line_no, n_chars)")
def cjk_tune_frames(spark, sf_dir):
    rows = [("如梦令", "6-6-5"), ("如梦令", "6-6-5"), ("如梦令", "6-6"), ("忆江南", "3"), ("忆江南", "3"), ("失调名", "1"), ("失调名", "1")]
    fixed = profiles.modal_profiles(spark.createDataFrame(rows, "tune string, pattern string"), "tune", "pattern", left_out=("失调名",))
    return compose.tune_frames(fixed, "tune", "mode")


@_register(f"""WITH l AS (SELECT doc_id AS draft_id, line_no, ' ' || array_to_string(regexp_extract_all(lower(line), '[a-zß-ÿ]+'), ' ') || ' ' AS needle, len(regexp_extract_all(lower(line), '[a-zß-ÿ]+')) AS n FROM ({base._LINE_ROWS.replace("doc_id", "item_id").replace("documents", "benchmark").replace("SELECT item_id, unnest", "SELECT item_id AS doc_id, unnest", 1)})),
    h AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-zß-ÿ]+'), ' ') || ' ' AS hay FROM documents)
    SELECT draft_id, CAST(line_no AS INT) AS line_no, count(*) AS n_docs, min(doc_id) AS first_doc FROM l JOIN h ON n > 0 AND contains(hay, needle) GROUP BY 1, 2""")
def draft_collisions(spark, sf_dir):
    """Each benchmark item as a draft: its lines that stand in documents."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    drafts = annotate.lines_of(items, F.col("text"), LATIN).withColumnRenamed("doc_id", "draft_id")
    return compose.collisions(drafts, _docs(spark, sf_dir).select("doc_id", "text"), LATIN)
