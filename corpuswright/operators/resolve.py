"""Resolution of references, authors and tunes; allusions; recommendations for moods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import Lexicon, TextProfile, content, fold
from .annotate import hits_in

CARDS, SUGGESTIONS, AROUND = 6, 8, 8  # fixed values
IMAGE, THEME, FEELING, CURATED = 2.0, 3.0, 1.5, 1.0  # fixed values: what a wanted thing is worth


def resolve(refs: DataFrame, works: DataFrame, profile: TextProfile) -> DataFrame:
    """ref_id, status, n_candidates, selected for refs (ref_id, ref) to works (doc_id, title, author, first_line, body).

    A reference is `id:7`, `title`, `title@author` or `title@author#beginning of the first line`. One that several texts fit is
    ambiguous and selects none; repeats of one text count as one. Equal references are resolved once.
    """
    ask = refs.select("ref").distinct()
    number = F.regexp_extract("ref", r"^id:(\d+)$", 1)
    head, line = F.split_part("ref", F.lit("#"), F.lit(1)), F.split_part("ref", F.lit("#"), F.lit(2))
    parsed = ask.select(
        "ref", F.when(number != "", number.cast("long")).alias("id"), F.trim(F.split_part(head, F.lit("@"), F.lit(1))).alias("title"),
        F.trim(F.split_part(head, F.lit("@"), F.lit(2))).alias("author"), content(line, profile).alias("line"),
    )
    texts = works.groupBy("title", "author", content(F.col("first_line"), profile).alias("first"), F.xxhash64(content(F.col("body"), profile)).alias("text")).agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")
    )
    by_title = parsed.where("id IS NULL").select("ref", "title", F.col("author").alias("who"), "line").join(texts, "title")
    by_title = by_title.where(((F.col("who") == "") | (F.col("who") == F.col("author"))) & ((F.col("line") == "") | F.contains("first", F.col("line"))))
    told = by_title.groupBy("ref").agg(F.sum("n").alias("n"), F.count_distinct("text").alias("texts"), F.min("least").alias("least"))
    by_id = parsed.where("id IS NOT NULL").join(works.select(F.col("doc_id").alias("id")).distinct(), "id")
    told = told.unionByName(by_id.select("ref", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("texts"), F.col("id").alias("least")))
    status = F.when(F.col("texts").isNull(), "not_found").when(F.col("texts") == 1, "unique").otherwise("ambiguous")
    out = refs.join(told, "ref", "left")
    return out.select("ref_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"), F.when(F.col("texts") == 1, F.col("least")).alias("selected"))


def ambiguity_cards(works: DataFrame, profile: TextProfile) -> DataFrame:
    """title, place, doc_id, ref: for each title of several texts the first CARDS works, with a reference to each."""
    body = F.xxhash64(content(F.col("body"), profile))
    several = works.groupBy("title", body.alias("text")).agg(F.count(F.lit(1)).alias("n")).groupBy("title").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("title")
    place = F.row_number().over(Window.partitionBy("title").orderBy("doc_id")).cast("long")
    shown = works.where("title <> ''").select("title", "doc_id", "author", "first_line").join(several, "title").withColumn("place", place).where(F.col("place") <= CARDS)
    ref = F.concat("title", F.lit("@"), "author", F.lit("#"), F.left("first_line", F.lit(5)))
    return shown.select("title", "place", "doc_id", ref.alias("ref"))


def resolve_names(names: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, status, author, via, suggestions: a name that is known, or by alias, or up to SUGGESTIONS known ones that have it
    inside. `names` (name) is a set of questions; `known` (author) and `aliases` (alias, author) are dimensions."""
    asked = names.select("name").distinct()
    own = known.select(F.col("author").alias("name"), F.col("author").alias("own")).distinct()
    other = aliases.join(known.select("author").distinct(), "author").select(F.col("alias").alias("name"), F.col("author").alias("other"))
    told = asked.join(own, "name", "left").join(other, "name", "left")
    lost = told.where("own IS NULL AND other IS NULL AND name <> ''").select("name")
    near = lost.join(known.select("author").distinct(), F.contains("author", F.col("name"))).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("author")))
    near = near.where(F.col("k") <= SUGGESTIONS).groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("author")), ",").alias("suggestions"))
    author = F.coalesce("own", "other")
    return told.join(near, "name", "left").select(
        "name", F.when(author.isNotNull(), "unique").otherwise("not_found").alias("status"), F.coalesce(author, F.lit("")).alias("author"),
        F.when(F.col("own").isNull() & F.col("other").isNotNull(), F.concat("name", F.lit("→"), "other")).otherwise("").alias("via"), F.coalesce("suggestions", F.lit("")).alias("suggestions"),
    )


def panorama(names: DataFrame, groups: DataFrame, profiles: DataFrame, key: str) -> DataFrame:
    """name, key, n, via: the profile of a tune's name; without one, the largest of a name in the same alias group (group_id,
    name), or of a key that has such a name inside."""
    asked = names.select("name").distinct()
    exact = asked.join(profiles.select(F.col(key).alias("name"), F.col(key), F.col("n")), "name")
    rest = asked.join(exact.select("name"), "name", "left_anti")
    others = rest.join(groups, "name").select(F.col("name").alias("asked"), "group_id").join(groups, "group_id").select(F.col("asked").alias("name"), F.col("name").alias("candidate"))
    tried = rest.select("name", F.col("name").alias("candidate")).unionByName(others).distinct()
    met = tried.join(profiles.select(key, "n"), F.contains(key, F.col("candidate")))  # names asked for and profiles: both dimensions
    best = met.groupBy("name").agg(F.max_by(key, F.struct("n", key)).alias(key), F.max("n").alias("n"))
    return exact.withColumn("via", F.lit("exact")).unionByName(best.withColumn("via", F.lit("alias")))


def allusions(texts: DataFrame, seeds: list[tuple[str, str, tuple[str, ...], str]], hints: dict[str, tuple[str, ...]], profile: TextProfile) -> DataFrame:
    """doc_id, seed_id, name, surface, pos, signals of texts (doc_id, text): candidates, once an allusion.

    A seed is (id, name, surfaces, implies). Of its surfaces the longest in the text counts, where it first stands; signals are
    the hint words of what the seed implies that stand within AROUND characters.
    """
    folded = texts.select("doc_id", fold(F.col("text"), profile).alias("f"))

    def candidate(seed) -> Column:
        number, name, surfaces, implies = seed
        words = [w for key, ws in hints.items() if key in implies for w in ws]
        out = F.lit(None).cast("struct<seed_id:string,name:string,surface:string,pos:bigint,signals:string>")
        for s in sorted(surfaces, key=lambda s: len(s)):  # the last one that fits, the longest, stands outermost
            pos = F.locate(s, F.col("f")) - 1
            window = F.substring(F.col("f"), F.greatest(pos - AROUND, F.lit(0)) + 1, F.least(pos, F.lit(AROUND)) + len(s) + AROUND)
            signals = F.array_join(F.array_compact(F.array(*(F.when(F.contains(window, F.lit(w)), F.lit(w)) for w in words))), ",") if words else F.lit("")
            one = F.struct(F.lit(number).alias("seed_id"), F.lit(name).alias("name"), F.lit(s).alias("surface"), pos.cast("long").alias("pos"), signals.alias("signals"))
            out = F.when(pos >= 0, one).otherwise(out)
        return out

    found = folded.select("doc_id", F.explode(F.array_compact(F.array(*map(candidate, seeds)))).alias("a"))
    return found.select("doc_id", "a.*")


def recommend(moods: DataFrame, rolled: DataFrame, works: DataFrame, lexicons: dict[str, Lexicon], hints: dict[str, list[tuple[str, str]]], profile: TextProfile, k: int) -> DataFrame:
    """mood_id, place, doc_id, score: for each mood (mood_id, text) the k works with most of what it wants.

    A mood wants what the lexicons find in it and what the hints add for a key in it. Works that have the same things are scored
    once: there are no more kinds of them than sets of canons, and of each only the k least ids can be recommended.
    """
    folded = moods.select("mood_id", fold(F.col("text"), profile).alias("f"))
    wants = hits_in(folded, "f", lexicons, "mood_id").select("mood_id", "kind", "canon")
    for key, added in hints.items():
        extra = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(canon).alias("canon")) for kind, canon in added)))
        wants = wants.unionByName(folded.where(F.contains("f", F.lit(key))).select("mood_id", extra.alias("w")).select("mood_id", "w.kind", "w.canon"))
    wants = wants.distinct()
    has = rolled.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "canon"))).alias("has")).join(works.select("doc_id", "curated"), "doc_id")
    place = F.row_number().over(Window.partitionBy("has", "curated").orderBy("doc_id"))
    few = has.withColumn("nth", place).where(F.col("nth") <= k)
    kinds = few.select("has", "curated").distinct()
    worth = F.when(F.col("kind") == "image", IMAGE).when(F.col("kind") == "theme", THEME).otherwise(FEELING)
    scored = kinds.select("has", "curated", F.explode("has").alias("thing")).join(wants.select("mood_id", "kind", F.concat_ws(":", "kind", "canon").alias("thing")), "thing")
    scored = scored.groupBy("mood_id", "has", "curated").agg(F.sum(worth).alias("s"))
    scored = scored.select("mood_id", "has", "curated", (F.col("s") + F.when(F.col("curated"), CURATED).otherwise(0.0)).alias("score"))
    order = Window.partitionBy("mood_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.join(few, ["has", "curated"]).withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
    return ranked.select("mood_id", "place", "doc_id", "score")
