"""Form metrics of lined texts, and genre resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import TextProfile, char_pattern, content

#: Line count and line length of the regular forms, the lengths between which feet are read, and other names.
REGULAR_FORMS = {(4, 5): "五绝", (4, 7): "七绝", (8, 5): "五律", (8, 7): "七律"}
FOOT_LENGTHS = (4, 7)
LONG_FORMS = {5: ("五言齐言长篇", "五言古体"), 7: ("七言齐言长篇", "七言古体")}
EVEN_FORMS = {4: "四言", 6: "六言"}
LYRIC, MIXED, LONG_FROM = "词", "杂言", 8


def line_counts(lines: Column, profile: TextProfile) -> Column:
    return F.transform(lines, lambda x: F.length(content(x, profile)).cast("long"))


def is_uniform(counts: Column) -> Column:
    return F.size(F.array_distinct(counts)) == 1


def feet(lines: Column, profile: TextProfile, letters: int = 1) -> Column:
    """The last characters of the even lines."""
    even = F.filter(lines, lambda x, i: i % 2 == 1)
    return F.filter(F.transform(even, lambda x: F.right(content(x, profile), F.lit(letters))), lambda x: x != "")


def rhyme_feet(lines: Column, counts: Column, profile: TextProfile) -> Column:
    """The feet of works whose lines are of one length from 4 to 7; of others none, as the foot cannot be told."""
    even = (F.size(counts) >= 2) & is_uniform(counts) & F.element_at(counts, 1).between(*FOOT_LENGTHS)
    return F.when(even, feet(lines, profile)).otherwise(F.array().cast("array<string>"))


def detect_form(counts: Column, tune: Column | None = None, collection: Column | None = None) -> Column:
    """A tune makes a lyric, a collection of one form has that form (`collection` is its name or null); then line count and
    length name the regular forms and the long ones; works with uneven lines are mixed."""
    n, width = F.size(counts), F.try_element_at(counts, F.lit(1))
    out = F.when(F.coalesce(tune, F.lit("")) != "", LYRIC) if tune is not None else F.when(F.lit(False), "")
    if collection is not None:
        out = out.when(F.coalesce(collection, F.lit("")) != "", collection)
    for (lines, chars), name in REGULAR_FORMS.items():
        out = out.when(is_uniform(counts) & (n == lines) & (width == chars), name)
    for chars, (long, short) in LONG_FORMS.items():
        out = out.when(is_uniform(counts) & (width == chars), F.when((n > LONG_FROM) & (n % 2 == 0), long).otherwise(short))
    for chars, name in EVEN_FORMS.items():
        out = out.when(is_uniform(counts) & (width == chars), name)
    return out.otherwise(MIXED)


def resolve_genre(explicit: Column, tags: Column, known: list[str], form: Column) -> Column:
    """An explicit genre, else the first tag that is one, else the detected form."""
    tagged = F.filter(tags, lambda t: t.isin(known))
    return F.coalesce(F.when(F.trim(explicit) != "", F.trim(explicit)), F.when(F.size(tagged) > 0, F.element_at(tagged, 1)), form)


def describe(counts: Column) -> list[Column]:
    """n_lines, n_chars, whether lines are even, and their pattern, from the stored counts."""
    return [
        F.size(counts).cast("long").alias("n_lines"), F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("n_chars"),
        (F.size(counts) > 0) & is_uniform(counts), char_pattern(counts).alias("pattern"),
    ]


def is_rhyme_sample(counts: Column, rhymes: Column) -> Column:
    """Whether a work's feet tell what rhymes: even lines, 4 or 8 of 5 or 7 characters, two feet and two that differ."""
    shape = is_uniform(counts) & F.size(counts).isin(4, 8) & F.try_element_at(counts, F.lit(1)).isin(5, 7)
    return F.coalesce(shape & (F.size(rhymes) >= 2) & (F.size(F.array_distinct(rhymes)) >= 2), F.lit(False))
