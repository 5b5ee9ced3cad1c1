"""Tones of lines, the standard templates of regulated verse, and parallel couplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVEL, OBLIQUE, BOTH, UNKNOWN = "平", "仄", "两", "无"
#: The openings, by the tone of the first line's second character and whether that line rhymes.
OPENINGS = {"仄起不入韵": (OBLIQUE, False), "仄起入韵": (OBLIQUE, True), "平起不入韵": (LEVEL, False), "平起入韵": (LEVEL, True)}
CLOSE, WIDE, LEAST_PAIRS = 0.7, 0.5, 2  # fixed values of the couplet verdict
QUATRAIN = 4


def tone_classes(readings: DataFrame) -> DataFrame:
    """char, tone (level, oblique, both) from one row a reading (char, tone name); the table has a row a character at most."""
    level = F.col("tone") == LEVEL
    return readings.groupBy("char").agg(
        F.when(F.bool_or(level) & F.bool_or(~level), BOTH).when(F.bool_or(level), LEVEL).otherwise(OBLIQUE).alias("tone")
    )


def line_tones(lines: DataFrame, readings: DataFrame) -> DataFrame:
    """poem_id, line_no, tones: a letter a character, for lines of content (poem_id, line_no, line)."""
    chars = lines.select("poem_id", "line_no", F.posexplode(F.split("line", "")).alias("i", "char")).where("char <> ''")
    named = chars.join(tone_classes(readings), "char", "left").withColumn("tone", F.coalesce("tone", F.lit(UNKNOWN)))
    ordered = named.groupBy("poem_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("i", "tone"))).alias("t"))
    return ordered.select("poem_id", "line_no", F.array_join(F.transform("t", lambda x: x["tone"]), "").alias("tones"))


def opposite(tone: str) -> str:
    return OBLIQUE if tone == LEVEL else LEVEL


def template(opening: str, n_chars: int, n_lines: int) -> list[dict[int, str]]:
    """The tones that bind in each line, by position from 1.

    Tones alternate from each even position to the next. The lines of a couplet are opposed, and a couplet begins with the tone
    on which the one before ended. Even lines rhyme, on a level tone, the others end oblique; but the first line of a quatrain
    does too where the opening rhymes. Eight lines are two quatrains alike.
    """
    tone, rhymes = OPENINGS[opening]
    lines = []
    for i in range(n_lines):
        if i % 2 and i:
            tone = opposite(tone)
        bound, at = {}, tone
        for position in range(2, n_chars, 2):
            bound[position], at = at, opposite(at)
        bound[n_chars] = LEVEL if i % 2 or (rhymes and i % QUATRAIN == 0) else OBLIQUE
        lines.append(bound)
    return lines


def match_template(poems: DataFrame) -> DataFrame:
    """Adds best_fit and deviations to poems with `tones` (array of lines) and `first_rhymes` (boolean or null).

    Only known tones can deviate. A first line that rhymes costs openings without rhyme two; one that is known not to costs all
    openings the same, which decides nothing. Of equals the first opening is taken. Poems of other shapes get nulls.
    """
    rows = []
    for n_chars in (5, 7):
        for n_lines in (4, 8):
            for k, name in enumerate(OPENINGS):
                rows.append((n_chars, n_lines, k, name, template(name, n_chars, n_lines)))

    def deviations(want: list[dict[int, str]]) -> Column:
        off = F.lit(0)
        for i, line in enumerate(want):
            for position, tone in line.items():
                got = F.substring(F.element_at("tones", i + 1), position, 1)
                off = off + F.when(got == opposite(tone), 1).otherwise(0)
        return off

    same = F.size(F.array_distinct(F.transform("tones", lambda t: F.length(t)))) == 1
    out = F.lit(None).cast("struct<cost:int,k:int,name:string,off:int>")
    for n_chars in (5, 7):
        for n_lines in (4, 8):
            fits = []
            for c, n, k, name, want in rows:
                if (c, n) == (n_chars, n_lines):
                    off = deviations(want)
                    penalty = F.when(F.coalesce("first_rhymes", F.lit(False)) & F.lit("不入韵" in name), 2).otherwise(0)
                    fits.append(F.struct((off + penalty).cast("int").alias("cost"), F.lit(k).alias("k"), F.lit(name).alias("name"), off.cast("int").alias("off")))
            shape = same & (F.size("tones") == n_lines) & (F.length(F.element_at("tones", 1)) == n_chars)
            out = F.when(shape, F.array_min(F.array(*fits))).otherwise(out)
    return poems.withColumn("fit", out).select(*poems.columns, F.col("fit.name").alias("best_fit"), F.col("fit.off").cast("long").alias("deviations"))


def couplets(pairs: DataFrame, categories: dict[str, str]) -> DataFrame:
    """pair_id, tone_rate, category_rate, verdict for pairs of lines (a, b) with their tones (ta, tb); `categories` maps a
    category's name to its characters."""
    kind = F.create_map(*(F.lit(x) for name, chars in categories.items() for ch in chars for x in (ch, name)))
    cell = F.struct
    cells = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1))),
        lambda i: cell(*(F.substring(c, i, F.lit(1)).alias(n) for c, n in ((F.col("a"), "a"), (F.col("b"), "b"), (F.col("ta"), "ta"), (F.col("tb"), "tb")))),
    )
    known = lambda x: x["ta"].isin(LEVEL, OBLIQUE) & x["tb"].isin(LEVEL, OBLIQUE)
    both = lambda x: kind[x["a"]].isNotNull() & kind[x["b"]].isNotNull()
    n = lambda test: F.size(F.filter("cells", test))
    rate = lambda part, whole: F.when(whole > 0, F.round(part / whole, 3))
    counted = pairs.withColumn("cells", cells).select(
        "pair_id", (F.length("a") == F.length("b")).alias("even"), n(known).alias("tp"), n(lambda x: known(x) & (x["ta"] != x["tb"])).alias("to"),
        n(both).alias("cp"), n(lambda x: both(x) & (kind[x["a"]] == kind[x["b"]]) & (x["a"] != x["b"])).alias("cm"),
    )
    rated = counted.withColumn("tone_rate", rate(F.col("to"), F.col("tp"))).withColumn("category_rate", rate(F.col("cm"), F.col("cp")))
    strong = (F.coalesce("category_rate", F.lit(0.0)) >= WIDE) & (F.col("cp") >= LEAST_PAIRS)
    verdict = F.when(~F.col("even"), "字数不等").when(F.coalesce("tone_rate", F.lit(0.0)) < CLOSE, "对仗弱").when(strong, "工对倾向").otherwise("宽对倾向")
    return rated.select("pair_id", "tone_rate", "category_rate", verdict.alias("verdict"))


def issues(poems: DataFrame) -> DataFrame:
    """poem_id, rule, place: breaches of the rules of regulated verse in poems with `tones` (array of lines), as far as tones are
    known. place is the line or couplet from 1.

    In any poem: three level or three oblique tones at a line's end. In even ones of 4 or 8 lines of 5 or 7 characters also:
    tones that do not alternate within a line, couplets whose lines are not opposed (one breach each), and a couplet that does
    not take up the tone of the one before.
    """
    n, width = F.size("tones"), F.length(F.element_at("tones", 1))
    regular = n.isin(4, 8) & width.isin(5, 7) & (F.size(F.array_distinct(F.transform("tones", lambda t: F.length(t)))) == 1)
    at = lambda line, k: F.substring(line, k, 1)
    known = lambda c: c.isin(LEVEL, OBLIQUE)
    same = lambda a, b: known(a) & (a == b)
    apart = lambda a, b: known(a) & known(b) & (a != b)
    keys = (2, 4, 6)
    wide = lambda k: (width == 7) if k == 6 else F.lit(True)

    def any_of(tests: list[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    breach = lambda name, place: F.struct(F.lit(name).alias("rule"), place.cast("long").alias("place"))
    line = lambda i: F.element_at("tones", i)
    lines = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    per_line = lambda name, test: F.transform(F.filter(lines, lambda i: test(line(i))), lambda i: breach(name, i))
    halves = F.sequence(F.lit(1), F.greatest((n / 2).cast("int"), F.lit(1)))
    found = F.concat(
        per_line("三平尾", lambda t: (F.length(t) >= 3) & (F.right(t, F.lit(3)) == LEVEL * 3)),
        per_line("三仄尾", lambda t: (F.length(t) >= 3) & (F.right(t, F.lit(3)) == OBLIQUE * 3)),
        F.when(regular, per_line("二四六不交替", lambda t: any_of([wide(b) & same(at(t, a), at(t, b)) for a, b in zip(keys, keys[1:])]))).otherwise(F.array()),
        F.when(regular, F.transform(
            F.filter(halves, lambda c: any_of([wide(k) & same(at(line(2 * c - 1), k), at(line(2 * c), k)) for k in keys])), lambda c: breach("失对", c)
        )).otherwise(F.array()),
        F.when(regular, F.transform(
            F.filter(halves, lambda c: (c < F.size(halves)) & apart(at(line(2 * c), 2), at(line(F.least(2 * c + 1, n)), 2))), lambda c: breach("失粘", c)
        )).otherwise(F.array()),
    )
    return poems.where(n > 0).select("poem_id", F.explode(found).alias("b")).select("poem_id", "b.rule", "b.place")


def rhyme_votes(feet: DataFrame, readings: DataFrame) -> DataFrame:
    """poem_id, rhyme_tone: the tone of most feet (poem_id, line_no, char) whose readings agree on one; the lesser name on a tie."""
    tones = readings.groupBy("char").agg(F.count_distinct("tone").alias("n"), F.min("tone").alias("tone")).where("n = 1")
    votes = feet.join(tones, "char").groupBy("poem_id", "tone").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("poem_id").agg(F.min_by("tone", F.struct(-F.col("votes"), "tone")).alias("rhyme_tone"))


def first_line_rhymes(feet: DataFrame, readings: DataFrame, departments: dict[str, str]) -> DataFrame:
    """poem_id, first_rhymes: whether the last character of the first line shares a rhyme department with an even line's.

    `feet` has the last character of each line (poem_id, line_no from 0, char), `readings` (char, tone, rhyme) a row a reading and
    `departments` a rhyme's department. Only readings in the tone of most unambiguous even feet count. False where the first line
    has no such reading, null where the even lines have none or there are none.
    """
    groups = F.create_map(*(F.lit(x) for pair in departments.items() for x in pair))
    even = feet.where(F.col("line_no") % 2 == 1)
    votes = rhyme_votes(even.select("poem_id", "line_no", "char"), readings)
    read = feet.where("line_no = 0 OR line_no % 2 = 1").join(readings, "char").join(votes, "poem_id", "left")
    read = read.where(F.col("rhyme_tone").isNull() | (F.col("tone") == F.col("rhyme_tone"))).withColumn("dept", groups[F.col("rhyme")]).where(F.col("dept").isNotNull())
    sets = read.groupBy("poem_id").agg(
        F.collect_set(F.when(F.col("line_no") == 0, F.col("dept"))).alias("one"), F.collect_set(F.when(F.col("line_no") > 0, F.col("dept"))).alias("others")
    )
    answer = F.when(F.size("others") > 0, F.size(F.array_intersect("one", "others")) > 0)
    return feet.select("poem_id").distinct().join(sets, "poem_id", "left").select("poem_id", answer.alias("first_rhymes"))


def departments_of(chars: DataFrame, readings: DataFrame, departments: dict[str, str], wider: dict[str, list[str]]) -> DataFrame:
    """char, rhymes, departments, wider: each character's rhymes, their departments, and the wider groups of these (a department
    may be in several), each sorted and comma-joined."""
    groups = F.create_map(*(F.lit(x) for pair in departments.items() for x in pair))
    above = F.create_map(*(x for d, ws in wider.items() for x in (F.lit(d), F.array(*map(F.lit, ws)))))
    read = chars.select("char").distinct().join(readings.select("char", "rhyme").distinct(), "char", "left").withColumn("dept", groups[F.col("rhyme")])
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return read.groupBy("char").agg(
        joined(F.collect_set("rhyme")).alias("rhymes"), joined(F.collect_set("dept")).alias("departments"),
        joined(F.array_distinct(F.flatten(F.collect_set(above[F.col("dept")])))).alias("wider"),
    )


def group_profile(members: DataFrame, readings: DataFrame, most: int = 4) -> DataFrame:
    """group_id, top_rhymes, tones, tone_purity of groups of characters (group_id, char): the `most` rhymes that most characters
    have (then by name), how many have each tone, and the share of the most frequent tone."""
    read = members.join(readings, "char")
    ranked = read.groupBy("group_id", "rhyme").agg(F.count_distinct("char").alias("n"))
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("n"), "rhyme"))).where(F.col("k") <= most)
    spelt = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda x: F.concat_ws(":", x["name"], x["n"].cast("string"))), ",")
    top = ranked.groupBy("group_id").agg(spelt(F.collect_list(F.struct("k", F.col("rhyme").alias("name"), "n"))).alias("top_rhymes"))
    tones = read.groupBy("group_id", "tone").agg(F.count_distinct("char").alias("n"))
    per = tones.groupBy("group_id").agg(
        spelt(F.collect_list(F.struct(F.col("tone").alias("name"), "n"))).alias("tones"), F.round(F.max("n") / F.sum("n"), 3).alias("tone_purity")
    )
    return top.join(per, "group_id")


def middle_couplets(poems: DataFrame) -> DataFrame:
    """pair_id (poem_id and the couplet's name), a, b: lines 3 and 4, 5 and 6 of poems with `lines` of eight."""
    lines = poems.where(F.size("lines") == 8)
    pair = lambda name, i: F.struct(F.lit(name).alias("name"), F.element_at("lines", i).alias("a"), F.element_at("lines", i + 1).alias("b"))
    each = lines.select("poem_id", F.explode(F.array(pair("颔联", 3), pair("颈联", 5))).alias("p"))
    return each.select(F.concat_ws("/", F.col("poem_id").cast("string"), "p.name").alias("pair_id"), "p.a", "p.b")
