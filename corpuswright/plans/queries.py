"""The registered queries over the synthetic tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LATIN, content, dice, split_lines, tokens, units
from ..operators import annotate, index, intertext, lookup, metrics, records, retrieve, review
from ..operators.components import connected_components
from ..operators.dedup_merge import merged_works
from ..operators.profiles import modal_profiles
from ..operators.stage import once, spread
from ..sources import corpus
from .lexicons import FEELINGS, IMAGES, LEXICONS, NEGATION

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
LANGS = ["en", "fr", "de", "es"]  # an explicit order of categories


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"), "doc_id")


# --- SQL building blocks -------------------------------------------------------------------------------------------------
_TOKENS = "regexp_extract_all(lower(text), '[a-zß-ÿ]+')"
_LINES = "list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '')"
_LINE_ROWS = f"SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, {_LINES} AS ls FROM documents) WHERE len(ls) > 0"


def _bm25(terms: list[str], where: str = "") -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
        t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents {where}),
        l AS (SELECT doc_id, len(ts) AS dl FROM t), c AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
        p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) WHERE term IN ({listed}) GROUP BY 1, 2),
        d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
        s AS (SELECT p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
              FROM p JOIN d USING (term) JOIN l USING (doc_id), c GROUP BY 1)"""


TERMS = ["thanea", "ering", "mente", "schen"]


# --- retrieval -----------------------------------------------------------------------------------------------------------
@_register(f"""WITH {_bm25(TERMS)}
    SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def search_bm25(spark, sf_dir):
    return retrieve.search(retrieve.index_terms(_docs(spark, sf_dir), F.col("text"), LATIN, TERMS), TERMS, 20)


@_register(f"""WITH {_bm25(TERMS, "WHERE lang = 'en'")}
    SELECT doc_id, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def search_bm25_filtered(spark, sf_dir):
    docs = _docs(spark, sf_dir).where(F.col("lang") == "en")  # before ranking: the filter reaches the scan
    return retrieve.search(retrieve.index_terms(docs, F.col("text"), LATIN, TERMS), TERMS, 20)


@_register(f"""WITH {_bm25(TERMS)}, pool AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 40)
    SELECT doc_id, round(score, 4) AS score, lang FROM pool JOIN documents USING (doc_id) WHERE lang = 'es' ORDER BY score DESC, doc_id LIMIT 8""")
def search_pool_then_filter(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    pool = retrieve.score(retrieve.index_terms(docs, F.col("text"), LATIN, TERMS), TERMS).orderBy(F.desc("score"), "doc_id").limit(40)
    hits = docs.select("doc_id", "lang").join(F.broadcast(pool), "doc_id").where(F.col("lang") == "es")  # at most 40 rows
    return hits.orderBy(F.desc("score"), "doc_id").limit(8).select("doc_id", F.round("score", 4).alias("score"), "lang")


@_register(f"""WITH {_bm25(TERMS)}, pool AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS pool_rank FROM s ORDER BY score DESC, doc_id LIMIT 40),
    m AS (SELECT max(score) AS top FROM pool),
    r AS (SELECT doc_id, pool_rank, text, 10 * score / top + 4.0 * (({" + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in TERMS)}) / 4.0) AS value
          FROM pool JOIN documents USING (doc_id), m),
    k AS (SELECT *, row_number() OVER (PARTITION BY left(text, 40) ORDER BY value DESC, pool_rank) AS nth FROM r)
    SELECT doc_id, round(value, 4) AS value, pool_rank FROM k WHERE nth = 1 ORDER BY value DESC, pool_rank LIMIT 8""")
def search_rerank(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    pool = retrieve.score(retrieve.index_terms(docs, F.col("text"), LATIN, TERMS), TERMS).orderBy(F.desc("score"), "doc_id").limit(40)
    one = Window.orderBy(F.desc("score"), "doc_id")  # over the pool's 40 rows
    pool = pool.withColumn("pool_rank", F.row_number().over(one).cast("long")).withColumn("top", F.max("score").over(Window.partitionBy(F.lit(1))))
    covered = sum((F.contains(F.lower("text"), F.lit(t)).cast("int") for t in TERMS), F.lit(0)) / 4.0
    valued = docs.join(F.broadcast(pool), "doc_id").withColumn("value", 10 * F.col("score") / F.col("top") + 4.0 * covered)
    same = Window.partitionBy(F.substring("text", 1, 40)).orderBy(F.desc("value"), "pool_rank")
    first = valued.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return first.orderBy(F.desc("value"), "pool_rank").limit(8).select("doc_id", F.round("value", 4).alias("value"), "pool_rank")


@_register(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), l AS (SELECT doc_id, len(ts) AS dl FROM t), c AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
    q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT query_id, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
          FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (doc_id), c GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s),
    h AS (SELECT query_id, min(rank) FILTER (WHERE contains(documents.text, benchmark.text)) AS first_hit
          FROM r JOIN documents USING (doc_id) JOIN benchmark ON item_id = query_id WHERE rank <= 5 GROUP BY 1)
    SELECT count(*) AS n_queries, count(*) FILTER (WHERE first_hit = 1) AS top1, count(*) FILTER (WHERE first_hit <= 5) AS top5,
           round(avg(coalesce(1.0 / first_hit, 0)), 4) AS mrr FROM h""")
def search_batch_eval(spark, sf_dir):
    docs, items = _docs(spark, sf_dir), _table(spark, sf_dir, "benchmark")
    queries = items.select(F.col("item_id").alias("query_id"), F.explode(tokens(F.col("text"), LATIN)).alias("term"))
    ranked = once(index.top(index.unstored(docs, F.col("text"), LATIN, queries), queries, 5))
    texts = ranked.join(docs.select("doc_id", "text"), "doc_id").join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("asked")), "query_id")
    first = texts.groupBy("query_id").agg(F.min(F.when(F.contains("text", F.col("asked")), F.col("rank"))).alias("first_hit"))
    return first.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("first_hit") == 1).alias("top1"), F.count_if(F.col("first_hit") <= 5).alias("top5"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), 4).alias("mrr"),
    )


# --- corpus --------------------------------------------------------------------------------------------------------------
@_register(f"""SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n_lines, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens,
    sha256(text) AS sha256 FROM documents""")
def corpus_normalize(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.size(split_lines(text, LATIN)).cast("long").alias("n_lines"), F.size(tokens(text, LATIN)).cast("long").alias("n_tokens"), F.sha2(text, 256).alias("sha256")
    )


@_register("""SELECT source, lang, count(*) AS n_raw, count(DISTINCT text) AS n_kept, count(*) - count(DISTINCT text) AS n_merged FROM documents GROUP BY 1, 2""")
def manifest_source_counts(spark, sf_dir):
    per = _docs(spark, sf_dir).groupBy("source", "lang", F.xxhash64("text"), F.sha2("text", 256)).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source", "lang").agg(F.sum("n").alias("n_raw"), F.count(F.lit(1)).alias("n_kept"), (F.sum("n") - F.count(F.lit(1))).alias("n_merged"))


@_register(None)
def file_fingerprints(spark, sf_dir):
    """Name, size and digest of every file of every table."""
    return corpus.manifest(spark, sf_dir, "*.parquet")


#: Columns of the tables by how they are written in a fingerprint: as they are, numbers in thousandths, times to the microsecond.
PLAIN = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size", "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus",
    "events": "event_id user_id event_type props", "documents": "doc_id text lang source n_chars", "embeddings": "vec_id label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
NUMBERS = {"customer": "c_acctbal", "supplier": "s_acctbal", "part": "p_retailprice", "orders": "o_totalprice", "lineitem": "l_quantity l_extendedprice l_discount l_tax", "events": "value"}
TIMES = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def _row_sql(table: str) -> str:
    parts = [f"CAST({c} AS VARCHAR)" for c in PLAIN[table].split()] + [f"CAST(CAST(round({c} * 1000) AS BIGINT) AS VARCHAR)" for c in NUMBERS.get(table, "").split()]
    parts += [f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" for c in TIMES.get(table, "").split()]
    if table == "embeddings":
        parts.append("array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 65536) AS BIGINT) AS VARCHAR)), ',')")
    return " || '|' || ".join(f"coalesce({p}, '~')" for p in parts)


@_register(" UNION ALL ".join(f"""SELECT '{t}' AS name, count(*) AS n_rows, CAST(sum(CAST('0x' || left(md5({_row_sql(t)}), 8) AS BIGINT)) AS BIGINT) AS checksum FROM {t}""" for t in PLAIN))
def table_fingerprints(spark, sf_dir):
    """Rows and an order-free checksum of all columns of every table: whether two corpora hold the same."""

    def row(table: str):
        parts = [F.col(c).cast("string") for c in PLAIN[table].split()] + [F.round(F.col(c) * 1000).cast("long").cast("string") for c in NUMBERS.get(table, "").split()]
        parts += [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in TIMES.get(table, "").split()]
        if table == "embeddings":
            parts.append(F.array_join(F.transform("embedding", lambda x: F.floor(x.cast("double") * 65536).cast("long").cast("string")), ","))
        return F.concat_ws("|", *(F.coalesce(x, F.lit("~")) for x in parts))

    parts = [
        _table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.left(F.md5(row(t)), F.lit(8)), 16, 10).cast("long")).alias("checksum"))
        .select(F.lit(t).alias("name"), "n_rows", "checksum") for t in PLAIN
    ]
    return reduce(DataFrame.unionByName, parts)


_MERGED = """WITH r AS (SELECT doc_id AS ord, lang AS author, coalesce(text, '') AS body, source AS origin FROM documents),
    same AS (SELECT author, body, min(ord) AS ord, count(*) AS n, list(DISTINCT origin) AS origins FROM r WHERE length(body) >= 8 GROUP BY 1, 2),
    l AS (SELECT *, lead(body) OVER (PARTITION BY author ORDER BY body) AS nb FROM same WHERE length(body) >= 12),
    e AS (SELECT *, CASE WHEN nb IS NULL OR NOT starts_with(nb, body) THEN body END AS fin FROM l),
    i AS (SELECT *, first_value(fin IGNORE NULLS) OVER (PARTITION BY author ORDER BY body ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top FROM e),
    m AS (SELECT min(ord) AS ord, author, top AS body, sum(n) AS n, list_sort(list_distinct(flatten(list(origins)))) AS origins FROM i GROUP BY author, top
          UNION ALL SELECT ord, author, body, n, list_sort(origins) FROM same WHERE length(body) < 12),
    k AS (SELECT *, row_number() OVER (PARTITION BY author, left(body, 24), length(body) ORDER BY ord) AS nth FROM m)"""


@_register(f"""{_MERGED} SELECT ord, author, CAST(n AS BIGINT) AS n_merged, array_to_string(origins, ',') AS origins, CAST(length(body) AS BIGINT) AS n_chars, sha256(body) AS sha256 FROM k WHERE nth = 1
    UNION ALL SELECT ord, author, 1, origin, CAST(length(body) AS BIGINT), sha256(body) FROM r WHERE length(body) < 8""")
def corpus_dedup_merged(spark, sf_dir):
    """All works after the merge, with the records that each has taken in."""
    records = _docs(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("lang").alias("author"), F.col("text").alias("body"), F.col("source").alias("origin"))
    return merged_works(records)


@_register("""SELECT doc_id, item_id FROM documents d JOIN benchmark b
    ON contains(array_to_string(regexp_extract_all(lower(d.text), '[a-zß-ÿ]+'), ''), array_to_string(regexp_extract_all(lower(b.text), '[a-zß-ÿ]+'), ''))
    WHERE len(regexp_extract_all(lower(b.text), '[a-zß-ÿ]+')) >= 5""")
def contains_verbatim_pairs(spark, sf_dir):
    """Every item with five words whose letters stand in those of a document, also across the edges of words: letters of all texts
    are hashed where they lie, and only places that an item's beginning or end may have leave the task."""
    items = _table(spark, sf_dir, "benchmark").where(F.size(tokens(F.col("text"), LATIN)) >= 5).select("item_id", content(F.col("text"), LATIN).alias("passage"))
    row = F.struct("doc_id", F.monotonically_increasing_id().alias("row"))  # rows with the same id, or none, are rows
    docs = _docs(spark, sf_dir).select(row.alias("doc_id"), content(F.col("text"), LATIN).alias("unit"))
    return lookup.occurrences(docs, items).join(items, "passage").select("doc_id.doc_id", "item_id")


@_register(f"""WITH t AS (SELECT conv_id, turn, list_distinct({_TOKENS}) AS s FROM conversations),
    p AS (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM t)
    SELECT conv_id, turn, round(CASE WHEN len(s) = 0 OR len(q) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(s, q)) / (len(s) + len(q)) END, 4) AS dice
    FROM p WHERE q IS NOT NULL""")
def dice_adjacent_turns(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens(F.col("text"), LATIN).alias("s"))
    return turns.withColumn("q", F.lag("s").over(w)).where(F.col("q").isNotNull()).select("conv_id", "turn", F.round(dice(F.col("s"), F.col("q")), 4).alias("dice"))


# --- metrics -------------------------------------------------------------------------------------------------------------
_COUNTS = f"list_transform({_LINES}, lambda x: length(array_to_string(regexp_extract_all(lower(x), '[a-zß-ÿ]+'), '')))"
_FORM = """CASE WHEN len(list_distinct(c)) = 1 AND len(c) = 4 AND c[1] = 5 THEN '五绝' WHEN len(list_distinct(c)) = 1 AND len(c) = 4 AND c[1] = 7 THEN '七绝'
    WHEN len(list_distinct(c)) = 1 AND len(c) = 8 AND c[1] = 5 THEN '五律' WHEN len(list_distinct(c)) = 1 AND len(c) = 8 AND c[1] = 7 THEN '七律'
    WHEN len(list_distinct(c)) = 1 AND c[1] IN (5, 7) THEN CASE c[1] WHEN 5 THEN '五' ELSE '七' END || CASE WHEN len(c) > 8 AND len(c) % 2 = 0 THEN '言齐言长篇' ELSE '言古体' END
    WHEN len(list_distinct(c)) = 1 AND c[1] = 4 THEN '四言' WHEN len(list_distinct(c)) = 1 AND c[1] = 6 THEN '六言' ELSE '杂言' END"""


@_register(f"""WITH t AS (SELECT doc_id, {_COUNTS} AS c FROM documents)
    SELECT doc_id, CAST(len(c) AS BIGINT) AS n_lines, CAST(coalesce(list_sum(c), 0) AS BIGINT) AS n_chars, coalesce(len(c) > 0 AND len(list_distinct(c)) = 1, false) AS uniform,
           array_to_string(c, '-') AS pattern, {_FORM} AS form FROM t""")
def form_metrics(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", split_lines(F.col("text"), LATIN).alias("lines"))
    counted = lines.select("doc_id", metrics.line_counts(F.col("lines"), LATIN).alias("c"))
    n_lines, n_chars, uniform, pattern = metrics.describe(F.col("c"))
    return counted.select("doc_id", n_lines, n_chars, uniform.alias("uniform"), pattern, metrics.detect_form(F.col("c")).alias("form"))


@_register(f"""WITH t AS (SELECT lang, {_COUNTS} AS c FROM documents) SELECT lang, {_FORM} AS form, count(*) AS n FROM t GROUP BY 1, 2""")
def form_distribution(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    form = metrics.detect_form(metrics.line_counts(split_lines(F.col("text"), LATIN), LATIN))
    return docs.select("lang", form.alias("form")).groupBy("lang", "form").agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH t AS (SELECT doc_id, lang, list_filter(list_transform({_LINES}, lambda x, i: CASE WHEN i % 2 = 0 THEN right(array_to_string(regexp_extract_all(lower(x), '[a-zß-ÿ]+'), ''), 2) ELSE '' END), lambda x: x <> '') AS f FROM documents),
    e AS (SELECT doc_id, i, f[i] AS a, f[i + 1] AS b FROM t, unnest(generate_series(1, len(f) - 1)) AS g(i) WHERE len(f) >= 2)
    SELECT least(a, b) AS u, greatest(a, b) AS v, count(*) AS n FROM e WHERE a <> b GROUP BY 1, 2""")
def foot_edges(spark, sf_dir):
    """Feet (last two letters) of consecutive even lines, as an undirected weighted edge list."""
    f = metrics.feet(split_lines(F.col("text"), LATIN), LATIN, 2)
    pairs = _docs(spark, sf_dir).select(f.alias("f")).where(F.size("f") >= 2).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.size("f") - 1), lambda i: F.struct(F.element_at("f", i).alias("a"), F.element_at("f", i + 1).alias("b")))).alias("e")
    )
    return pairs.where("e.a <> e.b").groupBy(F.least("e.a", "e.b").alias("u"), F.greatest("e.a", "e.b").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@_register(f"""WITH RECURSIVE w AS ({ORACLES["foot_edges"].replace("WITH t AS", "WITH t AS", 1)}), g AS (SELECT u, v FROM w WHERE n >= 2 UNION SELECT v, u FROM w WHERE n >= 2),
    r(node, seen) AS (SELECT u, u FROM g UNION SELECT r.node, g.v FROM r JOIN g ON r.seen = g.u)
    SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def foot_components(spark, sf_dir):
    edges = foot_edges(spark, sf_dir).where("n >= 2")
    return connected_components(edges, "u", "v")


@_register(f"""WITH c AS ({ORACLES["foot_components"]}) SELECT component, count(*) AS n_members, string_agg(node, ' ' ORDER BY node) AS members,
    row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM c GROUP BY 1""")
def component_summary(spark, sf_dir):
    found = foot_components(spark, sf_dir)
    per = found.groupBy("component").agg(F.count(F.lit(1)).alias("n_members"), F.array_join(F.array_sort(F.collect_list("node")), " ").alias("members"))
    return per.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_members"), "component")).cast("long"))  # as many rows as groups of feet


# --- annotation ----------------------------------------------------------------------------------------------------------
def _masked_sql(column: str, lexicon) -> str:
    out = column
    for i, (s, _) in enumerate(lexicon.ranked()):
        out = f"replace({out}, '{s}', chr({0xE000 + i}) || repeat(chr({0xF8FF}), {len(s) - 1}))"
    return out


def _hits_sql() -> str:
    parts = []
    for kind, lex in LEXICONS.items():
        names = lex.ranked()
        canon = "CASE " + " ".join(f"WHEN k = {i} THEN '{c}'" for i, (_, c) in enumerate(names)) + " END"
        surface = "CASE " + " ".join(f"WHEN k = {i} THEN '{s}'" for i, (s, _) in enumerate(names)) + " END"
        parts.append(f"""SELECT doc_id, line_no, '{kind}' AS kind, pos, {canon} AS canon, {surface} AS surface, f FROM (
            SELECT doc_id, line_no, f, pos, unicode(substr(m, pos + 1, 1)) - {0xE000} AS k
            FROM (SELECT *, {_masked_sql("f", lex)} AS m FROM f0), unnest(generate_series(0, length(f) - 1)) AS g(pos)) WHERE k BETWEEN 0 AND {len(names) - 1}""")
    return f"WITH l0 AS ({_LINE_ROWS}), f0 AS (SELECT doc_id, line_no, lower(line) AS f FROM l0), h0 AS ({' UNION ALL '.join(parts)})"


_HITS = f"{_hits_sql()}, hits AS (SELECT doc_id, line_no, kind, pos, canon, surface, regexp_matches(left(f, pos), '{NEGATION}') AS negated FROM h0)"


def _annotated(spark, sf_dir):
    return annotate.annotation(_table(spark, sf_dir, "documents").select("doc_id", "text"), LEXICONS, LATIN, NEGATION)


@_register(f"{_HITS} SELECT doc_id, CAST(line_no AS INT) AS line_no, kind, CAST(pos AS BIGINT) AS pos, canon, surface, negated FROM hits")
def annotate_lines(spark, sf_dir):
    return _annotated(spark, sf_dir)


@_register(f"{_HITS} SELECT kind, canon, count(*) AS n, count(*) FILTER (WHERE negated) AS n_negated, count(DISTINCT doc_id) AS n_docs FROM hits GROUP BY 1, 2")
def negated_markers(spark, sf_dir):
    per = _annotated(spark, sf_dir).groupBy("kind", "canon", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("negated").alias("k"))
    return per.groupBy("kind", "canon").agg(F.sum("n").alias("n"), F.sum("k").alias("n_negated"), F.count(F.lit(1)).alias("n_docs"))


_ROLLED = f"""{_HITS}, live AS (SELECT * FROM hits WHERE NOT negated), per AS (SELECT doc_id, kind, canon, count(*) AS n, min((line_no, pos)) AS spot FROM live GROUP BY 1, 2, 3),
    rolled AS (SELECT doc_id, kind, canon, n, CAST(spot[1] AS BIGINT) AS first_line, row_number() OVER (PARTITION BY doc_id, kind ORDER BY spot, canon) AS seen_rank FROM per)"""


@_register(f"{_ROLLED} SELECT * FROM rolled")
def annotate_docs(spark, sf_dir):
    return annotate.roll_up(_annotated(spark, sf_dir))


_RULES = f"""{_HITS}, live AS (SELECT * FROM hits WHERE NOT negated),
    p AS (SELECT a.doc_id, a.canon AS image, b.canon AS feeling, b.line_no - a.line_no AS strength, a.line_no AS la, a.pos AS pa, b.pos AS pb, a.surface AS sa, b.surface AS sb
          FROM live a JOIN live b ON a.doc_id = b.doc_id AND a.kind = 'image' AND b.kind = 'feeling' AND b.line_no IN (a.line_no, a.line_no + 1)),
    best AS (SELECT doc_id, image, feeling, min((strength, la, pa, pb)) AS best, min((la, strength, pa, pb)) AS first FROM p GROUP BY 1, 2, 3),
    rules AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, image, feeling) AS seq, image, feeling,
              CAST(best[1] AS BIGINT) AS strength, CAST(best[2] AS BIGINT) AS line_no FROM best)"""


@_register(f"{_RULES} SELECT doc_id, seq, image, feeling, strength, line_no, printf('R%d_%03d', doc_id, seq) AS rule_id FROM rules")
def rules_extract(spark, sf_dir):
    rules = annotate.image_feeling_rules(_annotated(spark, sf_dir))
    return rules.withColumn("rule_id", F.format_string("R%d_%03d", "doc_id", "seq"))


@_register(f"""{_RULES}, lang_of AS (SELECT doc_id, lang FROM documents)
    SELECT image, feeling, count(*) AS support, count(*) FILTER (WHERE strength = 0) AS same_line, count(DISTINCT doc_id) AS n_docs, count(DISTINCT lang) AS n_langs,
           round(CAST(least(0.95, 0.6 + 0.02 * count(*)) AS DOUBLE), 4) AS score, CASE WHEN count(*) >= 8 THEN 'gold' WHEN count(*) >= 3 THEN 'silver' ELSE 'bronze' END AS level
    FROM rules JOIN lang_of USING (doc_id) GROUP BY 1, 2""")
def term_profiles(spark, sf_dir):
    rules = annotate.image_feeling_rules(_annotated(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    per = rules.groupBy("image", "feeling").agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("strength") == 0).alias("same_line"), F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("lang").alias("n_langs")
    )
    level = F.when(F.col("support") >= 8, "gold").when(F.col("support") >= 3, "silver").otherwise("bronze")
    return per.select("*", F.round(F.least(F.lit(0.95), 0.6 + 0.02 * F.col("support")), 4).alias("score"), level.alias("level"))


@_register(f"""{_RULES}, r AS (SELECT image, feeling, doc_id, lang, seq, row_number() OVER (PARTITION BY image, lang ORDER BY doc_id, seq) AS turn FROM rules JOIN documents USING (doc_id)),
    k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY turn, list_position(['en', 'fr', 'de', 'es'], lang), doc_id, seq) AS place FROM r)
    SELECT image, place, feeling, doc_id, lang FROM k WHERE place <= 12""")
def evidence_round_robin(spark, sf_dir):
    """Twelve pieces of evidence for each image, taken in turn from the languages (a top-k report)."""
    rules = annotate.image_feeling_rules(_annotated(spark, sf_dir)).join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    turn = F.row_number().over(Window.partitionBy("image", "lang").orderBy("doc_id", "seq"))
    order = Window.partitionBy("image").orderBy("turn", F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")), "doc_id", "seq")
    early = rules.withColumn("turn", turn).where("turn <= 12")  # no later turn can be among the first twelve
    return early.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 12").select("image", "place", "feeling", "doc_id", "lang")


_SHARED = f"""{_ROLLED}, c AS (SELECT doc_id, canon FROM rolled WHERE kind = 'image'),
    nodes AS (SELECT canon, count(*) AS freq FROM c GROUP BY 1)"""


@_register(f"""{_SHARED}, e AS (SELECT a.canon AS u, b.canon AS v, count(*) AS weight FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.canon < b.canon GROUP BY 1, 2)
    SELECT * FROM (SELECT u, v, weight FROM e ORDER BY weight DESC, u, v LIMIT 200) WHERE weight >= 3""")
def cooccurrence_network(spark, sf_dir):
    """The 200 heaviest pairs of images in one document, of those the ones with weight 3 and more (a top-k report)."""
    rolled = annotate.roll_up(_annotated(spark, sf_dir)).where("kind = 'image'")
    bags = rolled.groupBy("doc_id").agg(F.array_sort(F.collect_set("canon")).alias("s")).where(F.size("s") >= 2)
    pair = F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v"))))))
    edges = bags.select(pair.alias("e")).groupBy(F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    return edges.orderBy(F.desc("weight"), "u", "v").limit(200).where("weight >= 3")


@_register(f"""{_ROLLED}, g AS (SELECT lang, canon, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, canon) AS rank
    FROM rolled JOIN documents USING (doc_id) WHERE kind = 'image' GROUP BY 1, 2) SELECT lang, canon, n, rank FROM g WHERE rank <= 10""")
def group_topk_table(spark, sf_dir):
    rolled = annotate.roll_up(_annotated(spark, sf_dir)).where("kind = 'image'").join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    counted = rolled.groupBy("lang", "canon").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "canon")).cast("long")).where("rank <= 10")


@_register(f"""{_ROLLED}, i AS (SELECT doc_id, canon AS image FROM rolled WHERE kind = 'image'), f AS (SELECT doc_id, canon AS feeling FROM rolled WHERE kind = 'feeling')
    SELECT feeling, image, count(*) AS n FROM f JOIN i USING (doc_id) GROUP BY 1, 2""")
def category_matrix(spark, sf_dir):
    rolled = annotate.roll_up(_annotated(spark, sf_dir))
    i = rolled.where("kind = 'image'").select("doc_id", F.col("canon").alias("image"))
    f = rolled.where("kind = 'feeling'").select("doc_id", F.col("canon").alias("feeling"))
    return f.join(i, "doc_id").groupBy("feeling", "image").agg(F.count(F.lit(1)).alias("n"))


@_register(f"""{_ROLLED}, s AS (SELECT doc_id, sum(CASE WHEN kind = 'image' AND canon IN ('moon', 'river') THEN 2.0 WHEN kind = 'theme' AND canon = 'autumn' THEN 3.0
    WHEN kind = 'feeling' AND canon = 'sorrow' THEN 1.5 ELSE 0 END) AS score FROM rolled GROUP BY 1)
    SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10""")
def mood_match(spark, sf_dir):
    rolled = annotate.roll_up(_annotated(spark, sf_dir))
    worth = (
        F.when((F.col("kind") == "image") & F.col("canon").isin("moon", "river"), 2.0).when((F.col("kind") == "theme") & (F.col("canon") == "autumn"), 3.0)
        .when((F.col("kind") == "feeling") & (F.col("canon") == "sorrow"), 1.5).otherwise(0.0)
    )
    return rolled.groupBy("doc_id").agg(F.sum(worth).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(10)


# --- review --------------------------------------------------------------------------------------------------------------
def _rules_to_review(spark, sf_dir):
    """Extracted rules with their evidence, and every seventh spoilt in one of four ways, so that each stage has work."""
    rules = annotate.image_feeling_rules(_annotated(spark, sf_dir), surfaces=True)
    joined = annotate.with_lines(rules, _table(spark, sf_dir, "documents").select("doc_id", "text"), LATIN)
    k = F.pmod(F.col("doc_id") + F.col("seq"), F.lit(7))
    return joined.select(
        "doc_id", F.format_string("R%d_%03d", "doc_id", "seq").alias("rule_id"), F.when(k == 1, "nowhere").otherwise(F.col("image")).alias("image"), "feeling",
        F.col("strength").cast("int").alias("strength"), F.when(k == 2, F.concat("line", F.lit(" and more"))).otherwise(F.col("line")).alias("span"), F.col("line").alias("text"),
        "image_surface", F.coalesce("feeling_surface", F.lit("")).alias("feeling_surface"), F.lit(False).alias("feeling_negated"),
        F.when(F.col("strength") == 0, 0.9).otherwise(0.8).alias("model_confidence"), F.lit(2).alias("n_conditions"), F.when(k == 3, 2).otherwise(1).alias("claimed"),
        F.when(k == 4, "a modern critic would say").otherwise("").alias("body"),
    )


_REVIEW = f"""{_RULES}, ln AS ({_LINE_ROWS}), si AS (SELECT doc_id, line_no, canon AS image, arg_min(surface, pos) AS image_surface FROM live WHERE kind = 'image' GROUP BY 1, 2, 3),
    base AS (SELECT r.doc_id, printf('R%d_%03d', r.doc_id, seq) AS rule_id, r.image, r.feeling, strength, line, (r.doc_id + seq) % 7 AS k FROM rules r
             JOIN ln ON ln.doc_id = r.doc_id AND ln.line_no = r.line_no JOIN si ON si.doc_id = r.doc_id AND si.line_no = r.line_no AND si.image = r.image),
    judged AS (SELECT *, k = 2 AS bad_evidence, k = 1 AS bad_semantics, (k = 3 AND strength = 0) OR k = 4 AS repaired,
               k <> 1 AND length(line) + CASE WHEN k = 2 THEN 9 ELSE 0 END > 120 AS broad, length(line) < 3 AND k <> 2 AS short FROM base),
    scored AS (SELECT *, (CASE WHEN bad_evidence THEN 0 ELSE 0.50 END) + (CASE WHEN bad_semantics THEN 0 WHEN broad THEN 0.06 ELSE 0.12 END) + 0.16
               + (CASE WHEN strength = 0 THEN 0.08 ELSE 0.05 END) + 0.04 + 0.04 * (CASE WHEN strength = 0 THEN 0.9 ELSE 0.8 END) AS raw FROM judged),
    final AS (SELECT doc_id, rule_id, repaired, bad_evidence, bad_semantics, broad, short, round(CAST(least(CASE WHEN repaired THEN 0.92 ELSE 0.98 END, raw) AS DOUBLE), 3) AS score FROM scored),
    released AS (SELECT *, CASE WHEN short OR bad_evidence OR bad_semantics THEN 'rejected' WHEN score >= 0.90 THEN 'gold' WHEN score >= 0.78 THEN 'silver'
               WHEN score >= 0.62 THEN 'bronze' ELSE 'rejected' END AS level FROM final)"""


def _reviewed(spark, sf_dir):
    rules = _rules_to_review(spark, sf_dir)
    return review.review(rules, [c for c, _ in IMAGES.entries], [c for c, _ in FEELINGS.entries], ["modern", "critic"])


@_register(f"{_REVIEW} SELECT doc_id, rule_id, score, level, repaired FROM released")
def review_decisions(spark, sf_dir):
    return _reviewed(spark, sf_dir).select("doc_id", "rule_id", "score", "level", "repaired")


@_register(f"""{_REVIEW}, a AS (
    SELECT doc_id, rule_id, 0 AS o, 'schema' AS stage, CASE WHEN short THEN 'fail' ELSE 'pass' END AS result FROM released UNION ALL
    SELECT doc_id, rule_id, 1, 'evidence', CASE WHEN bad_evidence THEN 'fail' ELSE 'pass' END FROM released UNION ALL
    SELECT doc_id, rule_id, 2, 'semantics', CASE WHEN bad_semantics THEN 'fail' WHEN broad THEN 'warn' ELSE 'pass' END FROM released UNION ALL
    SELECT doc_id, rule_id, 3, 'critic', 'pass' FROM released UNION ALL
    SELECT doc_id, rule_id, 4, 'repair', CASE WHEN repaired THEN 'repaired' ELSE 'none' END FROM released UNION ALL
    SELECT doc_id, rule_id, 5, 'release', level FROM released)
    SELECT doc_id, rule_id, stage, result, row_number() OVER (PARTITION BY doc_id ORDER BY rule_id, o) AS seq FROM a""")
def review_audit(spark, sf_dir):
    return review.audit(_reviewed(spark, sf_dir)).drop("flags")


# --- reuse between documents ---------------------------------------------------------------------------------------------
_REUSE = f"""WITH t AS (SELECT doc_id, {_TOKENS} AS u FROM documents),
    g AS (SELECT doc_id, pos, array_to_string(u[pos + 1 : pos + 5], ' ') AS gram FROM t, unnest(generate_series(0, len(u) - 5)) AS x(pos) WHERE len(u) >= 5),
    d AS (SELECT gram FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) BETWEEN 2 AND 20),
    s AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.pos AS pa, y.pos AS pb FROM g x JOIN d USING (gram) JOIN g y USING (gram) WHERE x.doc_id < y.doc_id),
    i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, pa - pb ORDER BY pa) AS island FROM s),
    r AS (SELECT a, b, min(pa) AS pa, min(pb) AS pb, max(pa) - min(pa) + 5 AS length FROM i GROUP BY a, b, pa - pb, island)"""


def _runs(spark, sf_dir):
    unit = _docs(spark, sf_dir).select("doc_id", units(F.col("text"), LATIN).alias("unit"))
    return intertext.runs(unit), unit.select("doc_id", F.size("unit").cast("long").alias("n"))


@_register(f"{_REUSE} SELECT * FROM r")
def intertext_runs(spark, sf_dir):
    return _runs(spark, sf_dir)[0]


@_register(f"""{_REUSE}, b AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY length DESC, pa, pb) AS k FROM r), n AS (SELECT doc_id, len(u) AS n FROM t),
    c AS (SELECT b.a, b.b, pa, pb, length, round(CAST(length AS DOUBLE) / least(x.n, y.n), 4) AS coverage FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b.b WHERE k = 1)
    SELECT *, CASE WHEN length >= 10 AND coverage >= 0.8 THEN 'same' WHEN length >= 7 THEN 'quote' ELSE 'echo' END AS mode FROM c""")
def intertext_pairs(spark, sf_dir):
    return intertext.best_runs(*_runs(spark, sf_dir))


@_register(f"""WITH t AS (SELECT doc_id, {_TOKENS} AS u FROM documents),
    g AS (SELECT doc_id, pos, array_to_string(u[pos + 1 : pos + 5], ' ') AS gram FROM t, unnest(generate_series(0, len(u) - 5)) AS x(pos) WHERE len(u) >= 5),
    d AS (SELECT gram, count(DISTINCT doc_id) AS n_docs FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 20) SELECT gram, n_docs, doc_id, min(pos) AS pos FROM g JOIN d USING (gram) GROUP BY 1, 2, 3""")
def intertext_frequent(spark, sf_dir):
    """The passages that too many documents share for pairs: which documents have them, and where first."""
    return intertext.frequent_runs(_docs(spark, sf_dir).select("doc_id", units(F.col("text"), LATIN).alias("unit")))


# --- other tables, same operators ------------------------------------------------------------------------------------------
@_register("""WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, p_brand) AS k FROM c)
    SELECT l_suppkey, p_brand AS mode, n AS mode_n, CAST(total AS BIGINT) AS n, round(n / total, 4) AS consistency FROM r WHERE k = 1""")
def modal_brand(spark, sf_dir):
    """The tune profile on suppliers: the mode of their parts' brands."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sold = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(part, "l_partkey")
    return modal_profiles(sold, "l_suppkey", "p_brand", least=1).drop("level")


@_register("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def anti_join_customers(spark, sf_dir):
    """Customers without an order over 300,000."""
    orders = _table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_anti")


@_register("""WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT x.p_brand AS u, y.p_brand AS v, count(*) AS weight FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2""")
def basket_pairs(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    bags = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_brand")).alias("s"))
    pair = F.explode(F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("u"), y.alias("v"))))))
    return bags.select(pair.alias("e")).groupBy(F.col("e.u").alias("u"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("weight"))


@_register("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
    CAST(length(html) AS BIGINT) AS n_chars FROM pages""")
def html_title(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.length("html").cast("long").alias("n_chars")
    )


@_register("""SELECT quality, toxic, lang, count(*) AS n, round(avg(n_chars), 2) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3""")
def label_counts(spark, sf_dir):
    joined = _docs(spark, sf_dir).select("doc_id", "lang", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("quality", "toxic", "lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 2).alias("mean_chars"))


@_register("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'system|admin') THEN 'maintainer' WHEN role = 'assistant' THEN 'scholar' ELSE 'reader' END AS infers,
    CASE WHEN regexp_matches(lower(text), 'forge|fabricat') THEN 'block' WHEN regexp_matches(lower(text), 'compose|write me') THEN 'notice' ELSE 'allow' END AS guard FROM conversations""")
def intent_guard(spark, sf_dir):
    text = F.lower("text")
    return _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.when(text.rlike("system|admin"), "maintainer").when(F.col("role") == "assistant", "scholar").otherwise("reader").alias("infers"),
        F.when(text.rlike("forge|fabricat"), "block").when(text.rlike("compose|write me"), "notice").otherwise("allow").alias("guard"),
    )


# --- resolution, comparison, glosses ---------------------------------------------------------------------------------------
_TITLE = "array_to_string(regexp_extract_all(lower(text), '[a-zß-ÿ]+')[1:3], ' ')"


@_register(f"""WITH t AS (SELECT doc_id, {_TITLE} AS title, lower(text) AS body FROM documents)
    SELECT title, count(*) AS n_works, count(DISTINCT body) AS n_texts, min(doc_id) AS first_id, CASE WHEN count(DISTINCT body) = 1 THEN 'unique' ELSE 'ambiguous' END AS status
    FROM t WHERE title <> '' GROUP BY 1""")
def resolve_refs(spark, sf_dir):
    """What each title (a document's first three words) resolves to; equal texts of one title are pre-aggregated."""
    title = F.array_join(F.slice(tokens(F.col("text"), LATIN), 1, 3), " ")
    named = _docs(spark, sf_dir).select("doc_id", title.alias("title"), F.sha2(F.lower("text"), 256).alias("body")).where("title <> ''")
    texts = named.groupBy("title", "body").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    per = texts.groupBy("title").agg(F.sum("n").alias("n_works"), F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id"))
    return per.withColumn("status", F.when(F.col("n_texts") == 1, "unique").otherwise("ambiguous"))


@_register(f"""{_ROLLED}, s AS (SELECT lang, list_sort(list(DISTINCT canon)) AS s FROM rolled JOIN documents USING (doc_id) WHERE kind = 'image' GROUP BY 1)
    SELECT a.lang AS a, b.lang AS b, array_to_string(list_filter(a.s, lambda x: list_contains(b.s, x)), ' ') AS shared,
           array_to_string(list_filter(a.s, lambda x: NOT list_contains(b.s, x)), ' ') AS only_a, array_to_string(list_filter(b.s, lambda x: NOT list_contains(a.s, x)), ' ') AS only_b
    FROM s a JOIN s b ON a.lang < b.lang""")
def differential(spark, sf_dir):
    """Shared and own images of each two languages, by set algebra over one row a language."""
    rolled = annotate.roll_up(_annotated(spark, sf_dir)).where("kind = 'image'").join(_docs(spark, sf_dir).select("doc_id", "lang"), "doc_id")
    sets = rolled.groupBy("lang").agg(F.array_sort(F.collect_set("canon")).alias("s"))
    other = sets.select(F.col("lang").alias("b"), F.col("s").alias("t"))
    both = sets.select(F.col("lang").alias("a"), "s").join(other, F.col("a") < F.col("b"))
    text = lambda c: F.array_join(F.array_sort(c), " ")
    return both.select("a", "b", text(F.array_intersect("s", "t")).alias("shared"), text(F.array_except("s", "t")).alias("only_a"), text(F.array_except("t", "s")).alias("only_b"))


@_register(f"""WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) SELECT doc_id, word, n, rank FROM r WHERE rank <= 8""")
def gloss_top_words(spark, sf_dir):
    """The eight most frequent words of each document (a top-k report)."""
    words = _docs(spark, sf_dir).select("doc_id", F.explode(tokens(F.col("text"), LATIN)).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word")).cast("long")).where("rank <= 8")


@_register("""WITH p AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_type, k, count(*) AS n FROM p GROUP BY 1, 2""")
def json_props(spark, sf_dir):
    parsed = _table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return parsed.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


EVENT = (
    records.Field("event_id", "bigint"), records.Field("user_id", "bigint", 0), records.Field("event_type", "string", "unknown"), records.Field("value", "double"),
    records.Field("detail", (records.Field("k", "bigint"), records.Field("tags", "array<string>", ["none"]))),
)


@_register("""SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 0 ELSE user_id END AS user_id, CASE WHEN event_id % 5 = 2 THEN 'unknown' ELSE event_type END AS event_type, value,
    CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 3 THEN NULL WHEN event_id % 5 = 4 THEN 'none' ELSE event_type || ',' || user_id END AS tags FROM events""")
def record_round_trip(spark, sf_dir):
    """Every event written as a record with a nested one and read back: with an unknown field, and in turn without its user, its
    type, its details, and its tags."""
    k = F.pmod("event_id", F.lit(5))
    detail = F.struct(F.from_json("props", "k long")["k"].alias("k"), F.when(k != 4, F.array("event_type", F.col("user_id").cast("string"))).alias("tags"))
    told = _table(spark, sf_dir, "events").select(
        F.to_json(F.struct(
            "event_id", F.when(k != 1, F.col("user_id")).alias("user_id"), F.when(k != 2, F.col("event_type")).alias("event_type"), "value",
            F.when(k != 3, detail).alias("detail"), F.lit("dropped").alias("unknown"),
        )).alias("record")
    )
    back = told.select(*records.decode(F.col("record"), EVENT))
    return back.select("event_id", "user_id", "event_type", "value", F.col("detail.k").alias("k"), F.array_join("detail.tags", ",").alias("tags"))


_LINE_HITS = f"{_HITS}, used AS (SELECT DISTINCT doc_id, line_no FROM hits WHERE kind = 'feeling')"


@_register(f"""{_LINE_HITS}, i AS (SELECT DISTINCT h.doc_id, h.line_no, canon FROM hits h WHERE kind = 'image' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = h.doc_id AND u.line_no = h.line_no)),
    f AS (SELECT canon, min((doc_id, line_no)) AS spot, count(*) AS n FROM i GROUP BY 1) SELECT canon, spot[1] AS doc_id, CAST(spot[2] AS INT) AS line_no, n FROM f""")
def unused_line_reply(spark, sf_dir):
    """For each image the first line that has it and no feeling: an anti-join on lines already used."""
    found = _annotated(spark, sf_dir)
    used = found.where("kind = 'feeling'").select("doc_id", "line_no").distinct()
    free = found.where("kind = 'image'").select("doc_id", "line_no", "canon").distinct().join(used, ["doc_id", "line_no"], "left_anti")
    first = free.groupBy("canon").agg(F.min(F.struct("doc_id", "line_no")).alias("spot"), F.count(F.lit(1)).alias("n"))
    return first.select("canon", "spot.doc_id", "spot.line_no", "n")
