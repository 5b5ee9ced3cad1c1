"""Search over works: shortcuts by id and title, structured filters, BM25 pool and re-ranking, best quotes, routing."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import Lexicon, TextProfile, fold, tokens
from . import retrieve
from .stage import once

#: Fixed values of the ranking: pools, the score of a shortcut, and what re-ranking adds.
POOL, POOL_FACTOR, WIDE_POOL, DIRECT, A_TITLE = 40, 5, 600, 99.0, 3
FULL, HALF, SOME, THEME, NAMED, CURATED = 4.0, 2.0, 0.5, 1.0, 3.0, 0.5
SURFACES_A_CANON = 6


@dataclass(frozen=True)
class Query:
    """A search. Filters are column -> value, empty ones count as none; `expand` adds surfaces of the images in the text."""

    text: str
    k: int = 8
    filters: dict[str, str] = field(default_factory=dict)
    expand: bool = False


def images_in(text: str, lexicon: Lexicon) -> list[str]:
    """The canons of surfaces in a query, longest first and none over another, each once."""
    taken, found = [False] * len(text), []
    for surface, canon in lexicon.ranked():
        at = text.find(surface)
        if at >= 0 and not any(taken[at : at + len(surface)]):
            taken[at : at + len(surface)] = [True] * len(surface)
            if canon not in found:
                found.append(canon)
    return found


def themes_in(text: str, lexicon: Lexicon) -> list[str]:
    """Themes of which a marker of two letters or more stands in the query."""
    return sorted({canon for surface, canon in lexicon.ranked() if len(surface) >= 2 and surface in text})


def surfaces_of(canons: list[str], lexicon: Lexicon, most: int | None = None) -> list[str]:
    return [s for c, surfaces in lexicon.entries if c in canons for s in surfaces[:most]]


def erase_names(text: str, names: list[str]) -> tuple[str, str]:
    """The query without the names (of tunes) in it, longest first, and the first of them: it becomes a filter."""
    first = ""
    for name in sorted(names, key=lambda n: (-len(n), n)):
        if len(name) >= 2 and name in text:
            text, first = text.replace(name, " "), first or name
    return text, first


def best_quote(lines: Column, surfaces: list[str], profile: TextProfile) -> Column:
    """The first line with one of the surfaces, else the first line."""
    first = F.get(lines, F.lit(0))
    if not surfaces:
        return F.coalesce(first, F.lit(""))
    pattern = "|".join(map(re.escape, surfaces))
    return F.coalesce(F.get(F.filter(lines, lambda x: fold(x, profile).rlike(pattern)), F.lit(0)), first, F.lit(""))


def passes(filters: dict[str, str]) -> Column:
    """All filters that are not empty; `source` may name a source or a book."""
    out = F.lit(True)
    for name, value in filters.items():
        if value:
            out = out & ((F.col(name) == value) | ((F.col("book") == value) if name == "source" else F.lit(False)))
    return out


def rank_works(works: DataFrame, query: Query, images: Lexicon, themes: Lexicon, profile: TextProfile) -> DataFrame:
    """doc_id, score, pool_rank, quote: the pool of BM25 filtered, re-ranked and without variants of one work.

    `works` has doc_id, title, author, text, lines, curated, images and themes (arrays) and the columns of the filters. The pool
    is cut before the filters, as its width is part of the ranking; with a filter it is wide.
    """
    asked = query.text.lower()
    wanted, topics = images_in(asked, images), themes_in(asked, themes)
    extra = surfaces_of(wanted, images, SURFACES_A_CANON) if query.expand else []
    terms = sorted(set(re.findall(profile.token, " ".join([asked, *extra]))))
    size = WIDE_POOL if any(query.filters.values()) else max(POOL_FACTOR * query.k, POOL)
    scored = retrieve.score(retrieve.index_terms(works, F.col("text"), profile, terms), terms)
    pool = once(scored.orderBy(F.desc("score"), "doc_id").limit(size))
    order = Window.orderBy(F.desc("score"), "doc_id")  # over the pool
    pool = pool.withColumns({"pool_rank": F.row_number().over(order).cast("long"), "top": F.max("score").over(Window.partitionBy(F.lit(1)))})
    hit = works.join(F.broadcast(pool), "doc_id").where(passes(query.filters))  # the pool's size is a parameter
    value = 10 * F.col("score") / F.col("top")
    if wanted:
        share = F.size(F.array_intersect("images", F.array(*map(F.lit, wanted)))) / len(wanted)
        value = value + F.when(share == 1, FULL).when(share >= 0.5, HALF).when(share > 0, SOME).otherwise(0.0)
    if topics:
        value = value + THEME * F.size(F.array_intersect("themes", F.array(*map(F.lit, topics))))
    for column in ("author", "title"):
        value = value + F.when((F.col(column) != "") & F.contains(F.lit(asked), F.col(column)), NAMED).otherwise(0.0)
    value = value + F.when(F.col("curated"), CURATED).otherwise(0.0)
    valued = hit.withColumn("value", F.round(value, 3))
    same = Window.partitionBy("author", F.left("title", F.lit(8)), F.left("text", F.lit(10))).orderBy(F.desc("value"), "pool_rank")
    first = valued.withColumn("nth", F.row_number().over(same)).where("nth = 1").orderBy(F.desc("value"), "pool_rank").limit(query.k)
    return first.select("doc_id", F.col("value").alias("score"), "pool_rank", best_quote(F.col("lines"), surfaces_of(wanted, images), profile).alias("quote"))


def title_hits(works: DataFrame, titles: DataFrame, most: int = A_TITLE) -> DataFrame:
    """title, doc_id, place for titles (title): the first `most` works of each."""
    found = works.select("title", "doc_id").join(titles.select("title").distinct(), "title")
    place = F.row_number().over(Window.partitionBy("title").orderBy("doc_id")).cast("long")
    return found.withColumn("place", place).where(F.col("place") <= most)


def search(works: DataFrame, query: Query, images: Lexicon, themes: Lexicon, profile: TextProfile, id_pattern: str = r"#(\d+)", title_pattern: str = "[《«]([^》»]{1,60})[》»]") -> DataFrame:
    """doc_id, score, quote, match: a work named by id; else works named by title; else the ranking; else the works of an author
    whose name the query is."""
    quote = best_quote(F.col("lines"), [], profile)
    direct = lambda df, score, how: df.select("doc_id", F.lit(score).alias("score"), quote.alias("quote"), F.lit(how).alias("match"))
    if named := re.search(id_pattern, query.text):
        hit = works.where(F.col("doc_id") == int(named[1]))
        if not hit.isEmpty():
            return direct(hit, DIRECT, "direct_id")
    if titles := re.findall(title_pattern, query.text):
        rest = re.sub(title_pattern, "", query.text).lower()
        hit = works.where(F.col("title").isin(*titles)).withColumn("named", (F.col("author") != "") & F.contains(F.lit(rest), F.col("author")))
        any_named = F.max("named").over(Window.partitionBy("title"))
        hit = hit.withColumn("any_named", any_named).where(F.col("named") | ~F.col("any_named"))
        hit = hit.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy("doc_id"))).where(F.col("place") <= A_TITLE)
        if not hit.isEmpty():
            return direct(hit.orderBy("title", "doc_id").limit(max(query.k, len(titles))), DIRECT, "direct_title")
    ranked = once(rank_works(works, query, images, themes, profile).select("doc_id", "score", "quote", F.lit("bm25+rerank").alias("match")))
    if not ranked.isEmpty():
        return ranked
    return direct(works.where(F.col("author") == query.text.strip()).orderBy("doc_id").limit(query.k), 50.0, "author_index")


def titles_with(titles: DataFrame, asked: DataFrame, least: int = 3) -> DataFrame:
    """query, title, doc_id, how for queries (query): the first work of each title that begins with the query, or, where none
    does and it has `least` letters, has it inside.

    Both are equi-joins: on the beginning, for each length that a query has, and on the query's first `least` letters.
    """
    first = titles.where("title <> ''").groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    q = asked.select("query").where("query <> ''").distinct()
    lengths = [r["n"] for r in q.select(F.length("query").alias("n")).distinct().collect()]  # as many as queries are long
    begins = first.select("title", "doc_id", F.explode(F.array(*map(F.lit, lengths or [1]))).alias("n")).where(F.length("title") >= F.col("n"))
    begins = begins.select("title", "doc_id", F.expr("left(title, n)").alias("query")).join(q, "query").select("query", "title", "doc_id", F.lit("prefix").alias("how"))
    begins = once(begins)
    rest = q.join(begins.select("query").distinct(), "query", "left_anti").where(F.length("query") >= least).withColumn("gram", F.left("query", F.lit(least)))
    starts = F.sequence(F.lit(1), F.greatest(F.length("title") - least + 1, F.lit(1)))
    grams = first.where(F.length("title") >= least).select("title", "doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("title", i, F.lit(least))))).alias("gram"))
    inside = grams.join(rest, "gram").where(F.contains("title", F.col("query"))).select("query", "title", "doc_id", F.lit("inside").alias("how"))
    return begins.unionByName(inside)


def route(questions: DataFrame, skills: DataFrame, examples: DataFrame, profile: TextProfile) -> DataFrame:
    """question_id, skill, via for questions (question_id, text): the skill of the longest example core in the question (then the
    least name), else the best by BM25 over the skills' descriptions; null where nothing meets.

    `skills` (skill, description) and `examples` (skill, core) are a catalogue, a few rows that a person wrote.
    """
    cores = [(r["skill"], r["core"]) for r in examples.collect()]
    asked = questions.select("question_id", fold(F.col("text"), profile).alias("f"))
    fits = [F.when(F.contains("f", F.lit(core)), F.struct(F.lit(-len(core)).alias("n"), F.lit(skill).alias("skill"))) for skill, core in cores]
    best = F.array_min(F.array_compact(F.array(*fits)))["skill"]
    matched = once(asked.select("question_id", "f", best.alias("skill")))
    number = Window.orderBy("skill")  # a row a skill
    numbered = skills.withColumn("doc_id", F.row_number().over(number).cast("long")).select("doc_id", "skill", F.concat_ws(" ", "skill", "description").alias("text"))
    index = retrieve.build_index(numbered, F.col("text"), profile)
    words = matched.where(F.col("skill").isNull()).select(F.col("question_id").alias("query_id"), F.explode(tokens(F.col("f"), profile)).alias("term"))
    first = retrieve.search_many(index, words, 1).join(numbered.select("doc_id", F.col("skill").alias("found")), "doc_id")
    told = matched.join(first.select(F.col("query_id").alias("question_id"), "found"), "question_id", "left")
    via = F.when(F.col("skill").isNotNull(), "example").when(F.col("found").isNotNull(), "description").otherwise("none")
    return told.select("question_id", F.coalesce("skill", "found").alias("skill"), via.alias("via"))


