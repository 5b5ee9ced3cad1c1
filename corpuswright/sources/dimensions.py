"""Small tables beside the corpus: biographies, glossaries, readings, tune patterns, allusions, classics. Of entries with one key
the first counts, by file and place in it; each reader takes paths and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TextProfile, fold

MOST_BUFFER, MOST_MEMBER, LEAST_MEMBERS, MOST_UNKNOWN = 200, 3, 2, 20  # fixed values
#: The signs of a tune pattern's source and those it is shown in.
PATTERN_FROM, PATTERN_TO = "－＋│％＊", "○⊙●△▲"
GLOSS_LINE = "^(.{1,80}?)，(.{1,12}也)。?$"


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("_at", F.monotonically_increasing_id())


def _first(df: DataFrame, key: str) -> DataFrame:
    """One row a key: the first."""
    rest = [c for c in df.columns if c not in (key, "_at")]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), "_at").alias("r")).select(key, "r.*")


def biographies(spark: SparkSession, paths: dict[str, str], profile: TextProfile) -> DataFrame:
    """key (folded name), name, description, dynasty from a JSON array for each dynasty."""
    out = None
    for dynasty, path in paths.items():
        raw = spark.read.schema("name string, desc string, description string").option("multiLine", True).json(path)
        told = F.coalesce(F.nullif(F.trim("desc"), F.lit("")), F.nullif(F.trim("description"), F.lit("")))
        rows = raw.select(F.trim("name").alias("name"), told.alias("description"), F.lit(dynasty).alias("dynasty"))
        out = rows if out is None else out.unionByName(rows)
    known = _placed(out.where("name <> '' AND description IS NOT NULL")).withColumn("key", fold(F.col("name"), profile))
    return _first(known, "key")


def glossary(spark: SparkSession, path: str, profile: TextProfile) -> DataFrame:
    """key, char, radical, fanqie, gloss: each entry under its folded and its own form."""
    raw = spark.read.schema("char string, radical string, fanqie string, gloss string").option("mode", "DROPMALFORMED").json(path)
    known = _placed(raw.withColumn("char", F.trim("char")).where("char <> ''"))
    return _first(known.withColumn("key", F.explode(F.array_distinct(F.array(fold(F.col("char"), profile), "char")))), "key")


def gloss_groups(spark: SparkSession, path: str) -> DataFrame:
    """chapter, members, gloss: lines `a、b、c，gloss也。` of each chapter's content. A line that is none may be continued by the next
    ones, up to MOST_BUFFER characters; members have at most MOST_MEMBER characters, and a group at least LEAST_MEMBERS."""
    raw = spark.read.schema("chapter string, content string").option("mode", "DROPMALFORMED").json(path)
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.replace(F.trim(x), F.lit("　"), F.lit(""))), lambda x: x != "")

    def step(acc: Column, line: Column) -> Column:
        joined = F.concat(acc["buffer"], line)
        hit = F.when(joined.rlike(GLOSS_LINE), joined).when(line.rlike(GLOSS_LINE), line)
        keep = F.when(hit.isNotNull(), "").when(F.length(joined) > MOST_BUFFER, line).otherwise(joined)
        return F.struct(keep.alias("buffer"), F.when(hit.isNotNull(), F.concat(acc["found"], F.array(hit))).otherwise(acc["found"]).alias("found"))

    none = F.struct(F.lit("").alias("buffer"), F.array().cast("array<string>").alias("found"))
    found = raw.select("chapter", F.explode(F.aggregate(lines, none, step)["found"]).alias("line"))
    members = F.filter(F.split(F.regexp_extract("line", GLOSS_LINE, 1), "[、，]"), lambda m: F.length(m).between(1, MOST_MEMBER))
    return found.select("chapter", members.alias("members"), F.regexp_extract("line", GLOSS_LINE, 2).alias("gloss")).where(F.size("members") >= LEAST_MEMBERS)


def readings(spark: SparkSession, syllables: str, chars: str, tones: dict[str, str], variants: dict[str, str], profile: TextProfile) -> DataFrame:
    """char, tone, rhyme, initial, fanqie: a row a reading, under a character's own and its folded form.

    `tones` gives a rhyme's tone, `variants` the usual form of a rhyme's name; a name may end in A or B. Rhymes without a tone are
    left out, but more than MOST_UNKNOWN of them mean that table or data are broken: ValueError.
    """
    read = lambda path, names: spark.read.option("sep", "\t").schema(", ".join(f"{n} string" for n in names)).csv(path)
    raw = read(syllables, ("id", "a", "initial", "b", "name", "fanqie")).where("fanqie IS NOT NULL")
    lookup = lambda table, key: F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key) if table else F.lit(None).cast("string")
    bare = F.regexp_replace("name", "[AB]+$", "")
    named = raw.withColumn("rhyme", F.coalesce(lookup(variants, F.col("name")), lookup(variants, bare), bare)).withColumn("tone", lookup(tones, F.col("rhyme")))
    unknown = [r["name"] for r in named.where("tone IS NULL").select("name").distinct().limit(MOST_UNKNOWN + 1).collect()]
    if len(unknown) > MOST_UNKNOWN:
        raise ValueError(f"over {MOST_UNKNOWN} rhymes have no tone, among them {', '.join(sorted(unknown)[:5])}")
    known = named.where("tone IS NOT NULL").select("id", "tone", "rhyme", "initial", "fanqie")
    each = read(chars, ("char", "id")).where("id IS NOT NULL").join(known, "id")
    return each.select(F.explode(F.array_distinct(F.array("char", fold(F.col("char"), profile)))).alias("char"), "tone", "rhyme", "initial", "fanqie").distinct()


def tune_patterns(spark: SparkSession, path: str, charset: str = "UTF-16") -> DataFrame:
    """cipai, aliases, intro, forms (label, pattern) from the XML of a book of tunes; its signs are shown in usual ones."""
    form = "struct<_VALUE:string,`_说明`:string>"
    schema = f"`名称` array<string>, `说明` string, `正文` array<struct<`格律`:array<{form}>>>"
    raw = spark.read.format("xml").option("rowTag", "词牌").option("charset", charset).schema(schema).load(path)
    names = F.filter(F.transform("名称", lambda n: F.trim(n)), lambda n: n != "")
    forms = F.filter(F.flatten(F.transform("正文", lambda t: t["格律"])), lambda g: F.trim(g["_VALUE"]) != "")
    shown = F.transform(forms, lambda g: F.struct(F.coalesce(g["_说明"], F.lit("定格")).alias("label"), F.translate(F.trim(g["_VALUE"]), PATTERN_FROM, PATTERN_TO).alias("pattern")))
    known = raw.withColumn("names", names).where(F.size("names") > 0)
    return known.select(F.get("names", F.lit(0)).alias("cipai"), F.slice("names", F.lit(2), F.size("names")).alias("aliases"), F.coalesce(F.trim("说明"), F.lit("")).alias("intro"), shown.alias("forms"))


def tune_index(patterns: DataFrame, profile: TextProfile) -> DataFrame:
    """key (folded name or alias), cipai."""
    named = _placed(patterns).select("_at", "cipai", F.posexplode(F.concat(F.array("cipai"), "aliases")).alias("k", "name"))
    return _first(named.select("_at", "cipai", fold(F.col("name"), profile).alias("key")), "key")


def classics(spark: SparkSession, path: str) -> DataFrame:
    """work_id, source, category, author, era, chapter, content of a corpus of prose; ids go by place in the file."""
    fields = ("source", "category", "author", "era", "chapter", "content")
    raw = _placed(spark.read.schema(", ".join(f"{f} string" for f in fields)).option("mode", "DROPMALFORMED").json(path))
    number = F.row_number().over(Window.orderBy("_at")) - 1  # a shelf of chapters, not the corpus
    return raw.select(F.format_string("CW_%05d", number).alias("work_id"), *(F.coalesce(f, F.lit("")).alias(f) for f in fields))


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """ext_id, author, text, subject, theme, emotion: analyses that others made, as JSON lines."""
    raw = spark.read.schema("id string, author string, text string, subject string, theme string, emotion string").option("mode", "DROPMALFORMED").json(path)
    return raw.withColumnRenamed("id", "ext_id")


def allusion_seeds(spark: SparkSession, path: str) -> DataFrame:
    """id, name, surfaces, source, implies, status, ambiguity_note; lines without a name or surfaces are no seeds."""
    schema = "id string, name string, surfaces array<string>, source string, implies string, status string, ambiguity_note string"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return raw.where((F.col("name") != "") & (F.size("surfaces") > 0))
