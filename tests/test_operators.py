"""Operators that no query over the tables shows in full: shortcuts of search, layers of evidence, goldens of verse."""

import random
import re
import tracemalloc

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuswright.functions import text
from corpuswright.functions.text import CJK_PROFILE, LATIN, Lexicon
from corpuswright.operators import annotate, gate, guards, intertext, metrics, prosody, search, stage
from corpuswright.plans import QUERIES, induced
from corpuswright.sources import corpus

IMAGES = Lexicon((("moon", ("moon", "moonlight")), ("river", ("river",))))
THEMES = Lexicon((("travel", ("road", "far away")),))
FEELINGS = Lexicon((("sorrow", ("sad", "tears")),))


@pytest.fixture(scope="module")
def works(spark):
    rows = [
        (1, "night", "ann", "en", "The moon over the river. I am sad.", False), (2, "night", "bob", "en", "A road far away. No light.", True), (3, "dawn", "ann", "fr", "The river is cold.", False),
        (4, "night", "bob", "en", "A road far away. No light.", False), (5, "noon", "cy", "fr", "Nothing here.", False),
    ]
    df = spark.createDataFrame(rows, "doc_id long, title string, author string, lang string, text string, curated boolean")
    has = lambda lexicon: F.array_compact(F.array(*(F.when(F.lower("text").rlike("|".join(ss)), F.lit(c)) for c, ss in lexicon.entries)))
    lines = F.filter(F.transform(F.split("text", r"[.]"), lambda x: F.trim(x)), lambda x: x != "")
    return df.withColumns({"lines": lines, "images": has(IMAGES), "themes": has(THEMES), "book": F.lit("b"), "source": F.lit("s")})


def test_shortcuts(works):
    find = lambda text, **how: [(r.doc_id, r.match) for r in search.search(works, search.Query(text, **how), IMAGES, THEMES, LATIN).collect()]
    assert find("see #3 please") == [(3, "direct_id")]
    assert find("«night» by bob") == [(2, "direct_title"), (4, "direct_title")]
    assert find("«night»") == [(1, "direct_title"), (2, "direct_title"), (4, "direct_title")]
    ranked = find("moon river")
    assert ranked[0] == (1, "bm25+rerank") and {d for d, _ in ranked} == {1, 3}
    assert find("road", filters={"lang": "fr"}) == []
    assert [d for d, _ in find("road")] == [2]  # 4 is a variant of the same work
    assert find("cy") == [(5, "author_index")]


def test_query_parsing():
    assert search.images_in("moonlight on the river", IMAGES) == ["moon", "river"]
    assert search.erase_names("a long river song", ["river", "long river"]) == ("a   song", "long river")


def rule(spark, **changes):
    row = dict(
        rule_id="R1_001", doc_id=1, rule_type="image_feeling", evidence_type="original_text", interpretation="normalized", image="moon", surfaces=["moon"], feeling="sorrow", marker="sad", theme=None, markers=None, pattern=None,
        feet=None, annotation=None, ext_id=None, ext_fields=None, span="the moon is sad", strength=0, model_confidence=0.9, n_conditions=2, n_conclusions=2, body="", content="thewindandthemoonissadagain", n_chars=40,
        notes=["anoteonmoons"], appreciation="praise", lines=["thewind", "themoonissadagain"], own_pattern="p", own_feet="f", ext_text=None, ext_record=None,
    )
    row.update(changes)
    schema = (
        "rule_id string, doc_id long, rule_type string, evidence_type string, interpretation string, image string, surfaces array<string>, feeling string, marker string, theme string, markers array<string>, pattern string, feet string, "
        "annotation string, ext_id string, ext_fields map<string,string>, span string, strength int, model_confidence double, n_conditions int, n_conclusions int, body string, content string, n_chars int, notes array<string>, appreciation string, "
        "lines array<string>, own_pattern string, own_feet string, ext_text string, ext_record map<string,string>"
    )
    got = gate.review(spark.createDataFrame([tuple(row.values())], schema), IMAGES, FEELINGS, THEMES, ["modern"], r"\bnot $", LATIN)
    return got.first()


def test_gate_layers(spark):
    good = rule(spark)
    assert (good.score, good.level, good.first_flags) == (0.936, "gold", [])
    external = dict(evidence_type="external_analysis", rule_type="external", interpretation="external_llm", image=None, surfaces=None, feeling=None, marker=None, model_confidence=0.6, ext_id="e", ext_fields={"theme": "longing"})
    bound = rule(spark, **external, ext_text="hewritesthemoonissadhere", ext_record={"theme": "Longing for home"})
    assert (bound.score, bound.level) == (0.864, "silver")
    assert "external_conclusion_not_in_record:theme" in rule(spark, **external, ext_text="themoonissad", ext_record={"theme": "joy"}).first_flags
    assert "span_not_in_source" in rule(spark, **external, ext_text="other", ext_record={"theme": "longing"}).first_flags
    assert "external_record_not_found" in rule(spark, **external).first_flags
    note = dict(rule_type="annotation", evidence_type="annotation_text", image=None, surfaces=None, feeling=None, marker=None, span="note on moons")
    assert rule(spark, **note, annotation="a note on moons").level == "gold" and "annotation_not_in_notes" in rule(spark, **note, annotation="another").first_flags
    assert rule(spark, evidence_type="appreciation_text", span="praise", rule_type="form", pattern="p", image=None, surfaces=None, marker=None).level == "gold"
    assert rule(spark, content=None).level == "rejected"


def test_gate_repairs_only_delete(spark):
    over = rule(spark, lines=["themoon", "issadagain"])
    assert (over.first_flags, over.strength, over.model_confidence, over.score) == (["warn:strength_overclaimed"], 1, 0.8, 0.902)
    theme = dict(rule_type="theme", image=None, surfaces=None, feeling=None, marker=None, theme="travel", n_conditions=2)
    fixed = rule(spark, **theme, markers=["moon", "castle"])
    assert fixed.markers == ["moon"] and fixed.repairs == ["dropped_marker:castle"] and fixed.level != "rejected" and fixed.n_conditions == 1
    emptied = rule(spark, **theme, markers=["castle"])
    assert emptied.level == "rejected" and "theme_without_markers" in emptied.f_semantics
    late = rule(spark, body="a Modern view")
    assert late.body == "a  view" and late.interpretation == "model_inference" and late.score == 0.92
    negated = rule(spark, span="the moon is not sad", content="themoonisnotsad", lines=["themoonisnotsad"])
    assert negated.level == "rejected" and negated.f_critic == ["negated_feeling"]


def test_templates_of_known_poems(spark):
    """Openings of four famous poems, from their tones."""
    poems = [
        (1, ["仄仄平平仄", "平平仄仄平", "仄平平仄仄", "仄仄仄平平"], False, "仄起不入韵"), (2, ["平平仄仄仄平平", "仄仄平平仄仄平", "仄仄平平平仄仄", "平平仄仄仄平平"], True, "平起入韵"),
        (3, ["平平平仄仄", "仄仄仄平平", "仄仄平平仄", "平平仄仄平"], False, "平起不入韵"), (4, ["仄仄平平仄仄平", "平平仄仄仄平平", "平平仄仄平平仄", "仄仄平平仄仄平"], True, "仄起入韵"),
    ]
    df = spark.createDataFrame([(i, t, r) for i, t, r, _ in poems], "poem_id int, tones array<string>, first_rhymes boolean")
    got = {r.poem_id: (r.best_fit, r.deviations) for r in prosody.match_template(df).collect()}
    assert got == {i: (name, 0) for i, _, _, name in poems}


def test_rhyme_samples(spark):
    rows = [([5, 5, 5, 5], ["a", "b"], True), ([5, 5, 5, 5], ["a", "a"], False), ([5, 5], ["a", "b"], False), ([4] * 4, ["a", "b"], False), ([], [], False), ([7] * 8, list("abcd"), True)]
    df = spark.createDataFrame(rows, "c array<bigint>, f array<string>, want boolean")
    assert all(r.got == r.want for r in df.select("want", metrics.is_rhyme_sample(F.col("c"), F.col("f")).alias("got")).collect())


def test_literal_candidates_pass_their_own_check(spark):
    docs = spark.createDataFrame([(1, "The moon rose. The river ran. Nothing.")], "doc_id long, text string")
    lines = annotate.lines_of(docs, F.col("text"), LATIN)
    hits = annotate.annotate_lines(lines, {"image": IMAGES}, LATIN, r"\bnot $")
    told = guards.literal_candidates(hits, lines).join(docs.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("hay")), "doc_id")
    got = guards.verify_candidates(told, IMAGES, LATIN).collect()
    assert sorted((r.image, r.status, r.score) for r in got) == [("moon", "known", 0.375), ("river", "known", 0.375)]


def test_asides_and_stored_works(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 2, 9), (3, 4, 9)], "a long, b long, length long")
    spans = spark.createDataFrame([(1, 2, "exit the king"), (3, 4, "the moon")], "a long, b long, span string")
    assert [(r.a, r.b) for r in intertext.without_asides(pairs, spans, "^exit").collect()] == [(3, 4)]
    spark.createDataFrame([("p1", ["x"], 1)], "poem_id string, paragraphs array<string>, other int").write.parquet(f"{tmp_path}/w")
    row = corpus.load_works(spark, f"{tmp_path}/w").first()
    assert row.poem_id == "p1" and row.paragraphs == ["x"] and row.title is None
    assert CJK_PROFILE.others.startswith("[^")


def _longest_first(text, lexicon):
    """Hits by the definition: surfaces by length, each from left to right, none over another."""
    taken, found = [False] * len(text), []
    for surface, canon in lexicon.ranked():
        at = text.find(surface)
        while at >= 0:
            if not any(taken[at : at + len(surface)]):
                taken[at : at + len(surface)] = [True] * len(surface)
                found.append((at, canon, surface))
                at = text.find(surface, at + len(surface))
            else:
                at = text.find(surface, at + 1)
    return found


def test_private_characters_are_no_hits(spark):
    lexicon = Lexicon((("moon", ("moonlight", "moon")), ("sea", ("lights", "sea"))))
    texts = ["my \ue000 and moon", "moonlights \uf8ff sea", "seasea moonmoonlight", "", None, "\ue001\ue002"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = annotate.annotation(docs, {"x": lexicon}, LATIN, r"\bnot $")
    want = sorted((i, pos, canon, surface) for i, t in enumerate(texts) for pos, canon, surface in _longest_first(t or "", lexicon))
    assert sorted((r.doc_id, r.pos, r.canon, r.surface) for r in got.collect()) == want
    assert annotate.annotation(docs, {"x": lexicon}, LATIN, r"\bnot $").inputFiles() == got.inputFiles()  # read, not made again
    other = annotate.annotation(docs.where("doc_id > 0"), {"x": lexicon}, LATIN, r"\bnot $")
    assert other.count() == len([w for w in want if w[0] > 0])


def _shared_runs(texts: dict[int, list[str]], n: int, most: int) -> set[tuple]:
    """The maximal runs of grams of two to `most` documents, place by place."""
    at = {}
    for d, ws in texts.items():
        for i in range(len(ws) - n + 1):
            at.setdefault(tuple(ws[i : i + n]), []).append((d, i))
    shared = {(a, b, i, j) for places in at.values() if 2 <= len({d for d, _ in places}) <= most for a, i in places for b, j in places if a < b}
    out = set()
    for a, b, i, j in shared:
        if (a, b, i - 1, j - 1) not in shared:
            k = 0
            while (a, b, i + k + 1, j + k + 1) in shared:
                k += 1
            out.add((a, b, i, j, k + n))
    return out


def test_runs_by_their_ends(spark):
    """Runs cut by grams of too many documents, repeated in one document, at both ends of texts."""
    deal = random.Random(5)
    texts = {d: [deal.choice("abc") for _ in range(deal.randrange(0, 40))] for d in range(1, 9)}
    texts |= {11: list("xyzxyzxyzxyz"), 12: list("xyzxyzxyz"), 13: [f"w{i}" for i in range(300)], 14: [f"w{i}" for i in range(300)]}
    df = spark.createDataFrame([(d, ws) for d, ws in texts.items()] + [(None, list("xyzxyz"))], "doc_id long, unit array<string>")
    for n, most in ((2, 3), (3, 4), (5, 20)):
        got = [tuple(r) for r in intertext.runs(df, n, most).select("a", "b", "pa", "pb", "length").collect()]
        assert len(got) == len(set(got)) and set(got) == _shared_runs(texts, n, most)


def test_frequent_grams_as_text(spark):
    rows = [(d, f"p{d} a b c d e q{d} a b c d e".split()) for d in range(30)] + [(99, "a b c".split())]
    got = intertext.frequent_runs(spark.createDataFrame(rows, "doc_id long, unit array<string>"), 5, 20).collect()
    assert sorted((r.gram, r.n_docs, r.doc_id, r.pos) for r in got) == [("a b c d e", 30, d, 1) for d in range(30)]


def test_hits_of_a_long_line(spark):
    """Marks and negators far into a line are where they are in a short one, and only the end of what stands before is read."""
    words = ["moon", "not moon", "moonlight", "so sad", "é tears", "not at all a moon"] * 300
    df = spark.createDataFrame([(1, 0, " ".join(words)), (2, 0, "not moon"), (3, 0, "nothing")], "doc_id long, line_no int, line string")
    got = annotate.annotate_lines(df, {"image": IMAGES, "feeling": FEELINGS}, LATIN, r"\bnot $").collect()
    line = " ".join(words)
    want = {(m.start(), m.group(), bool(re.search(r"\bnot $", line[: m.start()]))) for m in re.finditer("moonlight|moon|sad|tears", line)}
    assert {(r.pos, r.surface, r.negated) for r in got if r.doc_id == 1} == want and len(got) == len(want) + 1
    assert [text._reach(p) for p in (r"\bnot $", "no+ $", "^no $", "(?<=a)no $", "[^a]no$")] == [7, None, None, None, 6]


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    """Splits of a file without the middle of a row group have no rows: one task would read all, however many splits there are."""
    rows = pa.table({"doc_id": list(range(4000)), "text": [str(i) * 500 for i in range(4000)]})
    pq.write_table(rows, f"{tmp_path}/one.parquet", compression="none", use_dictionary=False)
    pq.write_table(rows, f"{tmp_path}/many.parquet", compression="none", use_dictionary=False, row_group_size=100)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512k")
    try:
        busy = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        one, many = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("one", "many"))
        assert one.rdd.getNumPartitions() >= 8 and busy(one) == [4000]
        assert max(busy(stage.spread(one, "doc_id"))) < 1000 and stage.spread(one, "doc_id").count() == 4000
        assert stage.spread(many, "doc_id") is many
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_work_on_a_spread_table_runs_where_its_rows_went(spark, tmp_path):
    """A costly filter stays above the exchange, so that not the one task that reads a row group does all of it."""
    rows = pa.table({"doc_id": list(range(400)), "text": ["A line. Another"] * 399 + [""]})
    pq.write_table(rows, f"{tmp_path}/one.parquet")
    works = stage.spread(spark.read.parquet(f"{tmp_path}/one.parquet"), "doc_id").select("doc_id", text.split_lines(F.col("text"), LATIN).alias("lines"))
    full = works.where(F.size("lines") > 0).select("doc_id")
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert full.count() == 399 and 0 <= plan.find("split(text") < plan.find("RepartitionByExpression")


def test_corpus_stats_splits_the_texts_once(spark):
    """Its rules are built on the works that it has stored, so its plan does not read the documents again."""
    sf = "/root/testdata/sf0.001"
    assert not [f for f in induced.corpus_stats(spark, sf).inputFiles() if "documents.parquet" in f]


def test_hits_keep_within_their_lines(spark):
    """Lines of a batch are masked together: nothing is found across two of them, in null or empty ones, or in private characters."""
    lines = ["moon", "", None, "mo", "on", "\ue000moon", "no \U000f0000 moon not ", "moon"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, line_no int, line string").coalesce(1)
    for pattern in (r"\bnot $", r"(?<![a-z])not $"):  # as far back as it can see, and all of the line
        got = annotate.annotate_lines(df, {"image": IMAGES}, LATIN, pattern).collect()
        assert sorted((r.line_no, r.pos, r.canon, r.surface, r.negated) for r in got) == [(0, 0, "moon", "moon", False), (5, 1, "moon", "moon", False), (6, 5, "moon", "moon", False), (7, 0, "moon", "moon", False)]


def _joined(df):
    """The rows that come out of the joins of a plan, after it has run."""

    def of(plan):
        rows = plan.metrics().apply("numOutputRows").value() if "Join" in plan.nodeName() else 0
        return rows + sum(of(plan.children().apply(i)) for i in range(plan.children().size()))

    df.collect()
    return of(df._jdf.queryExecution().executedPlan())


def test_rules_do_not_pair_all_hits_of_a_long_line(spark):
    """A line with n images and n feelings makes a pair for each two canons, not n times n."""
    rows = [(1, line, kind, 10 * i + line + 1, kind + str(i % 2), f"{kind}{i}", False) for line in (3, 4) for kind in ("image", "feeling") for i in range(500)]
    found = spark.createDataFrame(rows, "doc_id long, line_no int, kind string, pos long, canon string, surface string, negated boolean")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that is known before it runs
    try:
        rules = annotate.image_feeling_rules(found)
        assert _joined(rules) <= 12  # of canons, lines and strengths
        want = [(1, "image0", "feeling0", 0, 3), (2, "image0", "feeling1", 0, 3), (3, "image1", "feeling0", 0, 3), (4, "image1", "feeling1", 0, 3)]
        assert sorted(tuple(r)[1:] for r in rules.collect()) == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_rules_with_their_surfaces_and_lines(spark):
    """Rules have the surfaces of their evidence line, and only texts with rules are split, after they met them."""
    texts = [(1, "No sign. Moonlight, moon and tears, sad."), (2, "The river. Tears. Sad"), (3, "Nothing. At all"), (4, None), (5, "moon tears")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = annotate.annotate_lines(annotate.lines_of(docs, F.col("text"), LATIN), {"image": IMAGES, "feeling": FEELINGS}, LATIN, r"\bnot $")
    rules = annotate.image_feeling_rules(found, surfaces=True)
    shorter = docs.where("doc_id < 5").unionByName(docs.select(F.lit(5).cast("long").alias("doc_id"), F.lit(" . ").alias("text")))
    got = annotate.with_lines(rules, shorter, LATIN)
    want = [(1, 1, "moon", 0, "Moonlight, moon and tears, sad", "moonlight", "tears"), (2, 1, "river", 1, "The river", "river", None)]
    assert sorted((r.doc_id, r.seq, r.image, r.strength, r.line, r.image_surface, r.feeling_surface) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("split(text") < plan.find("Join Inner, (doc_id")


def test_texts_are_not_dealt_to_be_counted(spark, tmp_path):
    """Where the annotation is stored, the texts of one row group are scanned by the task that reads them, and sources are counted there."""
    rows = pa.table({"doc_id": list(range(400)), "text": ["thanea und elle. Andere"] * 400, "lang": ["de"] * 400, "source": ["a", "b"] * 200})
    pq.write_table(rows, f"{tmp_path}/documents.parquet")
    want = sorted([("image", "moon", 400), ("author", "a", 200), ("author", "b", 200)])
    assert sorted((r.family, r.name, r.n) for r in induced.skill_catalogue(spark, tmp_path).collect()) == want
    sc, group = spark.sparkContext, f"stored-{tmp_path}"
    sc.setJobGroup(group, "the annotation is read")
    try:
        again = induced.skill_catalogue(spark, tmp_path)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup(group) for s in told.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) == 1
    assert "RepartitionByExpression" not in again._jdf.queryExecution().optimizedPlan().toString()


def test_long_lines_are_masked_in_pieces(monkeypatch):
    """A batch of long lines takes the memory of a piece, and pieces find what the whole batch has."""
    line = ("Ü moon 𝄞 road no sad moonlight, é " * 300)[:10000]
    batch = lambda texts: pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "f": pa.array(texts, pa.string())})
    lexicons = {"image": IMAGES, "feeling": FEELINGS}
    found = lambda b: sorted(tuple(r.values()) for x in annotate._found("f", lexicons, ["doc_id"], 6)(iter([b])) for r in x.to_pylist())
    few = [line, None, "", "no moon", line[:700], "sad", "", line[5:]] * 3
    whole = found(batch(few))
    assert {(p, s, before) for d, _, p, _, s, before in whole if d == 3} == {(3, "moon", "no ")}
    assert sorted(p for d, kind, p, _, _, _ in whole if d == 0 and kind == "feeling") == [m.start() for m in re.finditer("sad", line)]
    assert {before for *_, p, _, _, before in whole if p > 6} == {line[m.start() - 6 : m.start()] for m in re.finditer("moon|sad", line) if m.start() > 6}
    monkeypatch.setattr(annotate, "PIECE", 1000, raising=False)
    assert found(batch(few)) == whole
    monkeypatch.undo()
    many = batch([line] * 2000)
    tracemalloc.start()
    try:
        assert sum(x.num_rows for x in annotate._found("f", lexicons, ["doc_id"], 6)(iter([many]))) == 2000 * len(re.findall("moon|sad", line))
        assert tracemalloc.get_traced_memory()[1] < 12 * 2000 * len(line)
    finally:
        tracemalloc.stop()


def test_reviewed_texts_are_dealt_once(spark, tmp_path):
    """The texts of one row group move for the join with their rules, and not before it as well."""
    rows = pa.table({"doc_id": list(range(400)), "text": ["thanea und elle. Andere"] * 400, "lang": ["de"] * 400, "source": ["a"] * 400})
    pq.write_table(rows, f"{tmp_path}/documents.parquet")
    reviewed = QUERIES["review_decisions"](spark, tmp_path)
    plan = reviewed._jdf.queryExecution().executedPlan().toString()
    assert reviewed.count() == 400 and "REPARTITION_BY_NUM" not in plan and "REPARTITION_BY_COL" in plan
