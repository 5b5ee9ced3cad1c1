"""A tree of skills as text files: a file a skill below its family, with front matter; written and read by all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import replace_atomically

FRONT = r"(?s)\A---\n(.*?)\n---"


def write_tree(skills: DataFrame, examples: DataFrame, folder: str) -> None:
    """Skills (family, name, description, body) as family=.../skill=.../ with one text each, examples (name, query, route) as JSON
    lines, and a manifest with the number of skills of each family. A line end in a name or description becomes a blank."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    front = F.concat(F.lit("---\nname: "), flat("name"), F.lit("\ndescription: "), flat("description"), F.lit("\n---\n\n"), F.coalesce("body", F.lit("")))
    told = skills.select("family", F.col("name").alias("skill"), front.alias("value")).repartition("family", "skill")
    told.write.mode("overwrite").partitionBy("family", "skill").text(f"{folder}/skills")
    examples.select("name", "query", "route").write.mode("overwrite").json(f"{folder}/examples")
    replace_atomically(skills.groupBy("family").agg(F.count(F.lit(1)).alias("n")), f"{folder}/manifest")


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """family, name, description, meta (a map of all front matter), body of every file of a tree.

    Front matter is a line a field, up to its first colon; of lines with one name the last counts. A file without a name has that of
    its folder, one without front matter is all body.
    """
    files = spark.read.option("basePath", f"{folder}/skills").text(f"{folder}/skills", wholetext=True)
    files = files.withColumn("value", F.regexp_replace("value", r"\n\z", ""))  # that of the writer
    lines = F.filter(F.split(F.regexp_extract("value", FRONT, 1), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.regexp_replace(x, r"\A[^:]*:", "")).alias("value")))
    told = files.select(F.col("family").cast("string"), F.col("skill").cast("string"), "value", pairs.alias("pairs"))
    last = F.filter("pairs", lambda p, i: ~F.exists(F.slice(F.col("pairs"), i + 2, F.size("pairs")), lambda q: q["key"] == p["key"]))
    meta = told.withColumn("meta", F.map_from_entries(last))
    return meta.select(
        "family", F.coalesce(F.try_element_at("meta", F.lit("name")), "skill").alias("name"), F.coalesce(F.try_element_at("meta", F.lit("description")), F.lit("")).alias("description"), "meta",
        F.regexp_replace("value", FRONT + r"\n*", "").alias("body"),
    )


def read_examples(spark: SparkSession, folder: str) -> DataFrame:
    """name, query, route of the examples that have all of them."""
    return spark.read.schema("name string, query string, route string").option("mode", "DROPMALFORMED").json(f"{folder}/examples").where("query <> '' AND route <> ''")
