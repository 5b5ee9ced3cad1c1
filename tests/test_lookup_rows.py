"""What leaves a task in a lookup of passages: the passages that its texts have, not the places where one could begin."""

from pyspark.sql import functions as F

from corpuswright.functions.text import LATIN
from corpuswright.operators import lookup, rules


def test_heads_alone_make_no_rows(spark):
    """Texts full of the heads and tails of passages that they do not have, and one that has them all at many places."""
    asked = [["a", "b", f"w{k}"] for k in range(50)] + [["a", "b"], ["c"]]
    texts = [(k, ["a", "b", "x"] * 300 + [f"w{j}" for j in range(50)] + ["c"] * 100) for k in range(20)]
    texts += [(100, [w for p in asked[:50] for w in p] * 5)]
    works = spark.createDataFrame(texts, "doc_id long, unit array<string>")
    keyed = lookup.keyed(spark.createDataFrame([(p,) for p in asked], "passage array<string>"), ["passage"]).cache()
    found = lookup.holders(works, keyed, [])
    assert found.count() == 20 * 2 + 51
    assert found.join(keyed, lookup.KEY).where(F.col("doc_id") == 100).count() == 51


def test_binding_of_copies(spark):
    """A first line that all have, one of a copied work, lines with the same beginning, an author's alone, and null ids and authors."""
    rows = [(k, "m", "the. moon is full") for k in range(30, 0, -1)] + [(40, "m", "moon is full. the"), (41, "m", "moon is up. the"), (42, "n", "moon is full"), (43, "n", "sun"), (None, "n", "sun"), (44, None, "sun"), (45, "n", "...")]
    df = spark.createDataFrame(rows, "doc_id long, author string, text string")
    works = df.select("doc_id", "author", F.split("text", "[.]")[0].alias("first_line"))
    got = rules.bind_external(works, df.select(F.col("doc_id").alias("ext_id"), "author", "text"), LATIN).collect()
    assert len(got) == len({r.doc_id for r in got})
    assert {r.doc_id: r.ext_id for r in got} == {1: 2} | {k: 1 for k in range(2, 31)} | {40: 1}
