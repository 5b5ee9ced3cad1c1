"""Profiles induced across works: of images, themes, tunes and authors; ties are broken by name or by order of works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Support from which a profile is gold or silver, and how much of a list a profile shows.
IMAGE_GOLD, IMAGE_SILVER, THEME_GOLD, TUNE_SILVER, CONSISTENT = 8, 3, 30, 5, 0.5
CO_IMAGES, TOP_IMAGES, TOP_THEMES, EXAMPLES, LEAST_WORKS, LARGEST_CLEAN = 8, 10, 6, 8, 5, 250


def top_rows(counts: DataFrame, keys: list[str], item: str, n: str, most: int | None) -> DataFrame:
    """keys, rank, value, n: the `most` items with the highest n for each key, then by name."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(n), item)).cast("long")
    ranked = counts.select(*keys, rank.alias("rank"), F.col(item).cast("string").alias("value"), F.col(n).alias("n"))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def top_joined(counts: DataFrame, keys: list[str], item: str, n: str, most: int, name: str) -> DataFrame:
    """keys and the same in one string, `item:n` comma-joined."""
    rows = top_rows(counts, keys, item, n, most)
    spelt = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "value", F.col("n").cast("string")).alias("s")))), lambda x: x["s"])
    return rows.groupBy(*keys).agg(F.array_join(spelt, ",").alias(name))


def image_associations(rules: DataFrame) -> DataFrame:
    """image, feeling, support, same_line, next_line, best_doc, best_line: the best example is of the same line, then the first."""
    best = F.min_by(F.struct("doc_id", "line_no"), F.struct("strength", "doc_id", "seq"))
    per = rules.groupBy("image", "feeling").agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("strength") == 0).alias("same_line"), F.count_if(F.col("strength") == 1).alias("next_line"), best.alias("b")
    )
    return per.select("image", "feeling", "support", "same_line", "next_line", F.col("b.doc_id").alias("best_doc"), F.col("b.line_no").alias("best_line"))


def image_profiles(rules: DataFrame, rolled: DataFrame, works: DataFrame, opposed: list[tuple[str, str]]) -> DataFrame:
    """image, n_rules, n_docs, eras, co_images, conflicts, score, level.

    `rules` are image-feeling rules, `rolled` (doc_id, kind, canon) what works have, `works` gives an era to a doc_id. Opposed
    feelings that both go with an image are shown, not judged.
    """
    held = rules.select("image", "doc_id").distinct()
    eras = top_joined(held.join(works.select("doc_id", "era"), "doc_id").groupBy("image", "era").agg(F.count(F.lit(1)).alias("n")), ["image"], "era", "n", 100, "eras")
    others = rolled.where("kind = 'image'").select("doc_id", "canon")
    co = held.join(others, "doc_id").where("canon <> image").groupBy("image", "canon").agg(F.count(F.lit(1)).alias("n"))
    per = rules.groupBy("image").agg(F.count(F.lit(1)).alias("n_rules"), F.count_distinct("doc_id").alias("n_docs"), F.collect_set("feeling").alias("_f"))
    met = [F.when(F.array_contains("_f", a) & F.array_contains("_f", b), F.lit(f"{a}/{b}")) for a, b in opposed]
    level = F.when(F.col("n_rules") >= IMAGE_GOLD, "gold").when(F.col("n_rules") >= IMAGE_SILVER, "silver").otherwise("bronze")
    out = per.join(eras, "image").join(top_joined(co, ["image"], "canon", "n", CO_IMAGES, "co_images"), "image", "left")
    return out.select(
        "image", "n_rules", "n_docs", "eras", F.coalesce("co_images", F.lit("")).alias("co_images"), F.array_join(F.array_compact(F.array(*met)), ",").alias("conflicts"),
        F.round(F.least(F.lit(0.95), 0.6 + 0.02 * F.col("n_rules")), 3).alias("score"), level.alias("level"),
    )


def theme_profiles(rules: DataFrame, rolled: DataFrame) -> DataFrame:
    """theme, n_docs, top_images, examples (the first EXAMPLES works, strong ones first), level."""
    held = rules.select("theme", "doc_id", "strength")
    images = rolled.where("kind = 'image'").select("doc_id", "canon")
    top = held.join(images, "doc_id").groupBy("theme", "canon").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("theme").orderBy("strength", "doc_id"))
    shown = held.withColumn("k", place).where(F.col("k") <= EXAMPLES).groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("k", "doc_id"))).alias("e"))
    shown = shown.select("theme", F.array_join(F.transform("e", lambda x: x["doc_id"].cast("string")), ",").alias("examples"))
    per = held.groupBy("theme").agg(F.count(F.lit(1)).alias("n_docs"))
    out = per.join(top_joined(top, ["theme"], "canon", "n", TOP_IMAGES, "top_images"), "theme", "left").join(shown, "theme")
    return out.select("theme", "n_docs", F.coalesce("top_images", F.lit("")).alias("top_images"), "examples", F.when(F.col("n_docs") >= THEME_GOLD, "gold").otherwise("silver").alias("level"))


def modal_profiles(works: DataFrame, key: str, pattern: str, number: str | None = None, least: int = 2, left_out: tuple[str, ...] = ()) -> DataFrame:
    """key, n, mode, mode_n, consistency, level and, if asked for, number_mode, for keys with `least` works: the most frequent
    pattern (then the lesser) and its share. A key whose mode holds no half is no fixed form, whatever its size."""
    known = works.where(F.col(key).isNotNull() & (F.col(key) != "") & ~F.col(key).isin(*left_out)) if left_out else works.where(F.col(key).isNotNull())
    counts = known.groupBy(key, pattern).agg(F.count(F.lit(1)).alias("k"))
    out = counts.groupBy(key).agg(F.sum("k").alias("n"), F.min_by(pattern, F.struct(-F.col("k"), pattern)).alias("mode"), F.max("k").alias("mode_n")).where(F.col("n") >= least)
    share = F.col("mode_n") / F.col("n")
    level = F.when((F.col("n") >= TUNE_SILVER) & (share >= CONSISTENT), "silver").otherwise("bronze")
    out = out.select(key, "n", "mode", "mode_n", F.round(share, 4).alias("consistency"), level.alias("level"))
    if number:
        numbers = known.groupBy(key, number).agg(F.count(F.lit(1)).alias("k"))
        out = out.join(numbers.groupBy(key).agg(F.min_by(number, F.struct(-F.col("k"), number)).alias("number_mode")), key)
    return out


def group_profiles(members: DataFrame, key: str, facets: dict[str, tuple[DataFrame, str, int | None]], least: int = LEAST_WORKS) -> DataFrame:
    """key, facet, rank, value, n for keys with `least` members: of each facet (its rows with the key, a column, and how many to
    show) the most frequent values."""
    enough = members.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(key)
    out = None
    for name, (rows, value, most) in facets.items():
        counts = rows.join(enough, key, "left_semi").groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
        part = top_rows(counts, [key], value, "n", most).select(key, F.lit(name).alias("facet"), "rank", "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def component_profiles(components: DataFrame, support: DataFrame) -> DataFrame:
    """component, label (the three members that most works have), n_members, n_docs (works with any member), low_purity, rank (by
    size, then least member); `components` are (node, component), `support` distinct (doc_id, node)."""
    held = support.join(components, "node")
    freq = held.groupBy("component", "node").agg(F.count(F.lit(1)).alias("n"))
    three = top_rows(freq, ["component"], "node", "n", 3)
    label = three.groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), "·").alias("label"))
    per = components.groupBy("component").agg(F.count(F.lit(1)).alias("n_members")).join(held.groupBy("component").agg(F.count_distinct("doc_id").alias("n_docs")), "component")
    order = Window.orderBy(F.desc("n_members"), "component")  # a row a component
    return per.join(label, "component").select("component", "label", "n_members", "n_docs", (F.col("n_members") > LARGEST_CLEAN).alias("low_purity"), F.row_number().over(order).cast("long").alias("rank"))


def catalogue(profiles: list[tuple[str, DataFrame, str, Column, int]]) -> DataFrame:
    """family, name, description, n: an entry for each row of each family's profiles (family, rows, name column, number, least
    number) that has enough support."""
    out = None
    for family, rows, name, number, least in profiles:
        part = rows.select(F.lit(family).alias("family"), F.col(name).alias("name"), number.cast("long").alias("n")).where(F.col("n") >= least)
        part = part.select("family", "name", F.format_string(f"{family} %s: %d works", "name", "n").alias("description"), "n")
        out = part if out is None else out.unionByName(part)
    return out
