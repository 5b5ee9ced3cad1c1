"""Text functions, against plain Python where there is a plain way, and on the cases that are easy to get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from corpuswright.functions import text as T
from corpuswright.operators import metrics
from corpuswright.operators.annotate import hits_in
from corpuswright.operators.components import connected_components
from corpuswright.operators.dedup_merge import merge_collections, with_family
from corpuswright.operators.review import consensus, release


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_cjk_tokens_are_characters_then_pairs(spark):
    assert one(spark, T.tokens(F.col("t"), T.CJK_PROFILE), t="明月，光a𠀀") == ["明", "月", "光", "𠀀", "明月", "月光", "光𠀀"]
    assert one(spark, T.tokens(F.col("t"), T.CJK_PROFILE), t="abc") == []


def test_lines_lose_notes_quotes_and_blanks(spark):
    assert one(spark, T.split_lines(F.col("t"), T.CJK_PROFILE), t="「床前」明月光，（注）疑是 地上霜。") == ["床前」明月光", "疑是", "地上霜"]
    assert one(spark, T.split_lines(F.col("t"), T.LATIN), t="One two. Three!\n\n four?") == ["One two", "Three", "four"]


def test_containment_needs_content(spark):
    verbatim = T.contains_verbatim(F.col("a"), F.col("b"), T.CJK_PROFILE)
    assert one(spark, verbatim, a="床前，明月光", b="前明") is True
    assert one(spark, verbatim, a="床前明月光", b="，。") is False


def test_dice(spark):
    assert one(spark, T.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), t=1) == 0.5
    assert one(spark, T.dice(F.array().cast("array<string>"), F.array(F.lit("b"))), t=1) == 0.0


def plain_hits(text, ranked):
    taken, out = [False] * len(text), []
    for surface, canon in ranked:
        at = text.find(surface)
        while at >= 0:
            if not any(taken[at : at + len(surface)]):
                taken[at : at + len(surface)] = [True] * len(surface)
                out.append((at, canon, surface))
                at = text.find(surface, at + len(surface))
            else:
                at = text.find(surface, at + 1)
    return sorted(out)


def test_mask_is_longest_first_and_not_leftmost(spark):
    lexicon = T.Lexicon((("A", ("ab", "bcd")), ("B", ("b", "dd", "cdab"))))
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abcd", k=rnd.randrange(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    got = {}
    for r in hits_in(df, "t", {"x": lexicon}, "t").collect():
        got.setdefault(r.t, []).append((r.pos, r.canon, r.surface))
    for t in texts:
        assert sorted(got.get(t, [])) == plain_hits(t, lexicon.ranked()), t


def test_negation_looks_back_three_characters(spark):
    pattern = "[不无未莫非休勿][是见得必成为曾复即在有]{0,2}$"
    for text, at, want in (("不愁", 1, True), ("未必愁", 2, True), ("不知愁", 2, False), ("愁", 0, False), ("非是在有愁", 4, False)):
        assert one(spark, T.negated(F.col("t"), F.lit(at), pattern), t=text) is want, text


def test_forms(spark):
    form = lambda *c, tune="": one(spark, metrics.detect_form(F.array(*(F.lit(x) for x in c)).cast("array<bigint>"), F.col("tune")), tune=tune)
    assert form(5, 5, 5, 5) == "五绝" and form(*[7] * 8) == "七律" and form(5, 7) == "杂言" and form(5, 5, tune="菩萨蛮") == "词"
    assert form(*[5] * 10) == "五言齐言长篇" and form(*[7] * 6) == "七言古体" and form() == "杂言" and form(*[4] * 3) == "四言"
    lines = F.array(*map(F.lit, ["床前明月光", "疑是地上霜"]))
    assert one(spark, metrics.feet(lines, T.CJK_PROFILE), t=1) == ["霜"]
    assert one(spark, metrics.rhyme_feet(lines, metrics.line_counts(lines, T.CJK_PROFILE), T.CJK_PROFILE), t=1) == ["霜"]
    assert one(spark, metrics.detect_form(F.array(F.lit(5)), collection=F.col("c")), c="曲") == "曲"


@pytest.mark.parametrize(
    "strength, n, conf, external, want, level",
    [(0, 2, 0.9, False, 0.936, "gold"), (1, 2, 0.8, False, 0.902, "gold"), (2, 1, 0.7, False, 0.848, "silver")],
)
def test_worked_scores(spark, strength, n, conf, external, want, level):
    none = F.array().cast("array<string>")
    rule = spark.createDataFrame([(strength, n, conf, False)], "strength int, n_conditions int, model_confidence double, repaired boolean")
    rule = rule.withColumns({f"f_{s}": none for s in ("schema", "evidence", "semantics", "critic")})
    got = release(consensus(rule)).first()
    assert got.score == want and got.level == level


def test_merge_by_prefix(spark):
    rows = [
        (1, "a", "0123456789abcdefgh", "x"), (2, "a", "0123456789abcdefghijkl", "y"), (3, "a", "0123456789ab-other", "z"), (4, "b", "0123456789abcdefgh", "x"), (5, "a", "short", "x"), (6, "a", "short", "x"),
        (7, "a", "0123456789abcdefghijkl", "x"), (8, "a", "a variant of one text, first", "x"), (9, "a", "a variant of one text, fi!st", "x"), (10, None, None, "x"), (11, "a", "9 letters", "x"), (12, "a", "9 letters and more", "x"),
    ]
    got = {r.ord: (r.body, r.n_merged, r.origins) for r in merge_collections(spark.createDataFrame(rows, "ord long, author string, body string, origin string")).collect()}
    assert got[1] == ("0123456789abcdefghijkl", 3, "x,y") and set(got) == {1, 3, 4, 5, 6, 8, 10, 11, 12}


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_families_across_partitions(spark, partitions):
    rnd = random.Random(6)
    bodies = sorted({"".join(rnd.choices("ab", k=rnd.randrange(12, 30))) for _ in range(300)} | {"x" * k for k in range(12, 60)})
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.body: r.top for r in with_family(spark.createDataFrame([("a", b) for b in bodies], "author string, body string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    top = None
    for b, after in reversed(list(zip(bodies, bodies[1:] + [None]))):
        top = top if after and after.startswith(b) else b
        assert got[b] == top


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
