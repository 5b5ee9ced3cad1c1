"""Records with odd fields, and the tree of skills."""

from pyspark.sql import functions as F

from corpuswright.operators import records
from corpuswright.sources import skills

FIELDS = (records.Field("id", "bigint"), records.Field("name", "string", "nobody"), records.Field("tags", "array<string>", []), records.Field("review", (records.Field("score", "double", 0.0), records.Field("level", "string"))))
TEXTS = {
    '{"id": 1, "name": "a", "tags": ["x", "y"], "review": {"score": 0.5, "level": "gold", "more": 1}, "extra": {"deep": [1]}}': (1, "a", ["x", "y"], (0.5, "gold")),
    '{"id": "2", "review": {}}': (2, "nobody", [], (0.0, None)),
    '{"id": "no number", "name": null, "review": null}': (None, None, [], None),
    "not json": (None, "nobody", [], None),
    "[]": (None, "nobody", [], None),
}


def test_records(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in frame.select("t", *records.decode(F.col("t"), FIELDS)).collect():
        want = TEXTS[r.t]
        assert (r.id, r.tags, r.review and tuple(r.review)) == (want[0], want[2], want[3])
        assert r.name == want[1] or r.t.startswith('{"id": "no')
    rows = spark.createDataFrame([(1, None, ["x"]), (None, "b", None)], "id long, name string, tags array<string>")
    assert rows.select(records.encode(rows).alias("t")).collect()[0].t == '{"id":1,"name":null,"tags":["x"]}'


def test_tree_of_skills(spark, tmp_path):
    rows = [("image", "moon/light: a", "of: the moon\nand more", "# moon\n\ntext"), ("author", "Bo", None, None), ("author", "=odd 'n'", "", "---\nnot front\n---")]
    asked = spark.createDataFrame([("Bo", "who is Bo", "author"), ("Bo", "", "author")], "name string, query string, route string")
    skills.write_tree(spark.createDataFrame(rows, "family string, name string, description string, body string").repartition(2), asked, f"{tmp_path}/t")
    (tmp_path / "t/skills/family=author/skill=bare").mkdir()
    (tmp_path / "t/skills/family=author/skill=bare/SKILL.txt").write_text("no front matter")
    (tmp_path / "t/skills/family=author/skill=twice").mkdir()
    (tmp_path / "t/skills/family=author/skill=twice/SKILL.txt").write_text("---\nname: one\nno field\nname: two\nkey: v\n---\nbody")
    got = {r.name: (r.family, r.description, r.body) for r in skills.read_tree(spark, f"{tmp_path}/t").collect()}
    assert got == {
        "moon/light: a": ("image", "of: the moon and more", "# moon\n\ntext"), "Bo": ("author", "", ""), "=odd 'n'": ("author", "", "---\nnot front\n---"),
        "bare": ("author", "", "no front matter"), "two": ("author", "", "body"),
    }
    assert {r.family: r.n for r in spark.read.parquet(f"{tmp_path}/t/manifest").collect()} == {"image": 1, "author": 2}
    assert [r.query for r in skills.read_examples(spark, f"{tmp_path}/t").collect()] == ["who is Bo"]
