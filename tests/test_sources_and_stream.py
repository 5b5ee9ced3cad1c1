import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpuswright.functions.text import CJK_PROFILE, TextProfile
from corpuswright.operators import review
from corpuswright.sources import corpus, dimensions
from corpuswright.sources.corpus import Source, known_sources, manifest, read_corpus, read_lines
from corpuswright.streaming.incremental_review import review_stream


def dump(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False))


def test_corpus_order_and_fields(spark, tmp_path):
    for k in (2, 10):
        works = [{"title": f"t{k}-{i}", "author": "甲", "paragraphs": ["一二三四五，", " ", "六七八九十。"]} for i in range(3)]
        dump(tmp_path / f"part-{k}.json", works + [{"title": "none", "paragraphs": []}])
    dump(tmp_path / "odes.json", [{"title": "关雎", "chapter": "国风", "section": "周南", "content": ["关关雎鸠"]}, {"title": "x", "chapter": "国风", "section": "", "content": ["y"]}])
    dump(tmp_path / "arias.json", [
        {"title": "窦娥冤・仙吕/点绛唇", "author": "关汉卿", "para": ["满腹闲愁"], "tags": ["x"]}, {"title": "山坡羊・峰峦如聚，波涛如怒。", "para": []}, {"title": "散曲", "para": ["z"]}, {"title": "失・短", "para": []},
    ])
    dump(tmp_path / "sections.json", {"content": [{"type": "五绝", "content": [{"chapter": "春晓", "author": "（唐）孟浩然", "paragraphs": ["春眠不觉晓"]}, {"chapter": "空", "author": "无", "paragraphs": []}]},
                                                  {"type": "七绝", "content": [{"chapter": "早春", "author": "韩愈", "paragraphs": ["天街小雨"]}]}]})
    dump(tmp_path / "tunes.json", [{"title": "长相思·山一程", "author": "纳兰", "para": ["山一程"]}, {"title": "一二三四五六七八·x", "para": ["y"]}, {"title": "plain", "para": ["y"]}])
    at = lambda name: f"{tmp_path}/{name}.json"
    got = read_corpus(spark, [
        Source("tang", at("part-*"), "Tang", "唐"), Source("odes", at("odes"), "Odes", "先秦", "odes"), Source("yuan", at("arias"), "Arias", "元", "arias", {"genre": "曲"}),
        Source("qj", at("sections"), "Thousand", "", "nested_sections"), Source("nl", at("tunes"), "Tunes", "清", "titled_by_tune"),
    ]).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(16)) and len({r.poem_id for r in got}) == 16
    assert [r.title for r in got[:6]] == ["t2-0", "t2-1", "t2-2", "t10-0", "t10-1", "t10-2"]
    assert [r.poem_id for r in got[:6]] == [f"CNP_TANG_{k:05d}" for k in range(1, 7)]  # numbers go on from file to file
    assert got[0].paragraphs == ["一二三四五，", "六七八九十。"] and got[0].dynasty == "唐"
    assert [(r.author, r.genre, r.section, r.dynasty) for r in got[6:8]] == [("佚名", "诗经体", "国风·周南", "先秦"), ("佚名", "诗经体", "国风", "先秦")]
    aria, rescued, plain = got[8:11]
    assert (aria.title, aria.section, aria.cipai, aria.tags, aria.genre) == ("窦娥冤・仙吕/点绛唇", "窦娥冤", "点绛唇", ["x", "宫调:仙吕"], "曲")
    assert (rescued.title, rescued.cipai, rescued.paragraphs) == ("山坡羊", "山坡羊", ["峰峦如聚，波涛如怒。"]) and (plain.title, plain.cipai) == ("散曲", "")
    assert [(r.title, r.author, r.dynasty, r.genre) for r in got[11:13]] == [("春晓", "孟浩然", "唐", "五绝"), ("早春", "韩愈", "", "七绝")]
    assert [r.cipai for r in got[13:]] == ["长相思", "", ""]


def test_only_known_collections_are_read(spark, tmp_path):
    assert len(known_sources("/x")) == 14 and known_sources("/x", "NALAN")[0].path == "/x/nalan/nalan.json"
    with pytest.raises(ValueError):
        known_sources("/x", "NALAN", "OTHER")
    with pytest.raises(ValueError):
        read_corpus(spark, [Source("x", str(tmp_path), "X", parser="guess")])


FOLD = TextProfile("cjk", CJK_PROFILE.token, CJK_PROFILE.breaks, fold_from="東陽韻", fold_to="东阳韵", bigrams=True)


def test_dimensions(spark, tmp_path):
    dump(tmp_path / "bio.json", [{"name": "東坡", "desc": "first"}, {"name": "东坡", "desc": "second"}, {"name": "x", "desc": " "}])
    got = {r.key: (r.name, r.description, r.dynasty) for r in dimensions.biographies(spark, {"宋": f"{tmp_path}/bio.json"}, FOLD).collect()}
    assert got == {"东坡": ("東坡", "first", "宋")}
    (tmp_path / "words.jsonl").write_text('{"char": "東", "gloss": "动也"}\n{"char": "东", "gloss": "later"}\nbroken\n')
    assert {r.key: r.gloss for r in dimensions.glossary(spark, f"{tmp_path}/words.jsonl", FOLD).collect()} == {"东": "动也", "東": "动也"}
    content = "初、哉、首，始也。\n林、烝，\n天、帝，君也。\n不合式的行\n孤，独也。"
    (tmp_path / "groups.jsonl").write_text(json.dumps({"chapter": "释诂", "content": content}, ensure_ascii=False))
    assert [(r.members, r.gloss) for r in dimensions.gloss_groups(spark, f"{tmp_path}/groups.jsonl").collect()] == [(["初", "哉", "首"], "始也"), (["林", "烝"], "天、帝，君也")]
    (tmp_path / "syl.tsv").write_text("1\ta\t端\tb\t東\t德红\n2\ta\t以\tb\t陽A\t与章\n3\ta\tx\tb\t无\ty\n4\tshort\n")
    (tmp_path / "chars.tsv").write_text("東\t1\n陽\t2\n坏\t9\n")
    read = dimensions.readings(spark, f"{tmp_path}/syl.tsv", f"{tmp_path}/chars.tsv", {"東": "平", "陽": "平"}, {}, FOLD)
    assert sorted((r.char, r.tone, r.rhyme) for r in read.collect()) == [("东", "平", "東"), ("東", "平", "東"), ("阳", "平", "陽"), ("陽", "平", "陽")]
    (tmp_path / "bad.tsv").write_text("".join(f"{k}\ta\tx\tb\tr{k}\ty\n" for k in range(30)))
    with pytest.raises(ValueError):
        dimensions.readings(spark, f"{tmp_path}/bad.tsv", f"{tmp_path}/chars.tsv", {}, {}, FOLD)
    xml = "<r><类别><名称>平韵</名称><词牌><名称>忆江南</名称><名称> 望江南 </名称><说明>单调</说明><正文><格律 说明=\"其一\">＋│－</格律><格律> </格律></正文></词牌><词牌><名称> </名称></词牌></类别></r>"
    (tmp_path / "tunes.xml").write_bytes(xml.encode("utf-16"))
    tunes = dimensions.tune_patterns(spark, f"{tmp_path}/tunes.xml")
    row = tunes.collect()
    assert [(r.cipai, r.aliases, r.intro, [tuple(f) for f in r.forms]) for r in row] == [("忆江南", ["望江南"], "单调", [("其一", "⊙●○")])]
    assert {r.key: r.cipai for r in dimensions.tune_index(tunes, FOLD).collect()} == {"忆江南": "忆江南", "望江南": "忆江南"}
    (tmp_path / "seeds.jsonl").write_text('{"_meta": 1}\n{"id": "a", "name": "n", "surfaces": ["s"]}\n{"id": "b", "name": "m", "surfaces": []}\n')
    assert [r.id for r in dimensions.allusion_seeds(spark, f"{tmp_path}/seeds.jsonl").collect()] == ["a"]
    (tmp_path / "prose.jsonl").write_text('{"source": "史记", "content": "x"}\n{"source": "论语", "content": "y"}\n')
    assert [(r.work_id, r.source, r.author) for r in dimensions.classics(spark, f"{tmp_path}/prose.jsonl").orderBy("work_id").collect()] == [("CW_00000", "史记", ""), ("CW_00001", "论语", "")]
    (tmp_path / "ext.jsonl").write_text('{"id": "e1", "author": "甲", "text": "t", "theme": "h"}\n')
    assert dimensions.analyses(spark, f"{tmp_path}/ext.jsonl").first().ext_id == "e1"


def test_sinks(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    corpus.write_assets({"a": one, "b": two}, f"{tmp_path}/assets")
    corpus.replace_atomically(two, f"{tmp_path}/assets/a")
    assert sorted(p.name for p in (tmp_path / "assets").iterdir()) == ["a", "b"]
    got = {r.asset: (r.ok, r.n) for r in corpus.ready(spark, f"{tmp_path}/assets", {"a": 5, "b": 4, "c": -1}).collect()}
    assert got == {"a": (True, 5), "b": (False, 5), "c": (False, -1)}
    corpus.write_lines(spark.createDataFrame([(1, None)], "doc_id long, n int"), f"{tmp_path}/lines")
    assert read_lines(spark, f"{tmp_path}/lines", spark.createDataFrame([], "doc_id long, n int").schema).first().doc_id == 1


def test_malformed_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": 1, "n": 2}\nnot json\n{"doc_id": 3, "n": 4}\n')
    schema = spark.createDataFrame([], "doc_id long, n int").schema
    assert sorted(r.doc_id for r in read_lines(spark, f"{tmp_path}/a.jsonl", schema).collect()) == [1, 3]
    assert manifest(spark, f"{tmp_path}/a.jsonl").first().n_bytes == len((tmp_path / "a.jsonl").read_bytes())


RULE = "doc_id long, rule_id string, image string, feeling string, strength int, span string, text string, image_surface string, feeling_surface string, feeling_negated boolean, model_confidence double, n_conditions int, claimed int, body string"


def rules(spark):
    good = dict(doc_id=1, rule_id="R1_001", image="moon", feeling="sorrow", strength=0, span="the moon is sad", text="Tonight the moon is sad again.", image_surface="moon", feeling_surface="sad", feeling_negated=False, model_confidence=0.9, n_conditions=2, claimed=1, body="")
    changes = [{}, {"span": "a moon is sad"}, {"image": "sun"}, {"feeling_negated": True}, {"claimed": 2}, {"body": "a modern view"}, {"feeling_surface": "glad"}, {"span": "m"}, {"rule_id": "R2_001"}, {"strength": 5}]
    return spark.createDataFrame([tuple({**good, "rule_id": f"R1_{k:03d}", **c}.values()) for k, c in enumerate(changes)], RULE)


def test_gate(spark):
    got = {(r.rule_id): r for r in review.review(rules(spark), ["moon"], ["sorrow"], ["modern"]).collect()}
    assert (got["R1_000"].score, got["R1_000"].level) == (0.936, "gold")
    for k in (1, 2, 3, 7, 9):
        assert got[f"R1_{k:03d}"].level == "rejected", k
    assert got["R2_001"].level == "rejected"
    assert got["R1_004"].repaired and got["R1_004"].claimed == 1 and got["R1_004"].score == 0.92
    assert got["R1_005"].repaired and got["R1_005"].body == "" and got["R1_005"].level == "gold"
    assert got["R1_006"].repaired and got["R1_006"].strength == 1 and got["R1_006"].score == 0.906
    assert all(0 <= r.score <= 0.98 for r in got.values())


def test_stream_is_the_batch(spark, tmp_path):
    want = rules(spark)
    want.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(want.schema).json(f"{tmp_path}/in")
    review_stream(stream, ["moon"], ["sorrow"], ["modern"], f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out/decisions").select("rule_id", "score", "level")
    batch = review.review(want, ["moon"], ["sorrow"], ["modern"]).select("rule_id", "score", "level")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(f"{tmp_path}/out/audit").count() == 6 * want.count()
    assert spark.read.parquet(f"{tmp_path}/out/audit").where(F.col("stage") == "release").count() == want.count()


def test_manifest_hashes_long_files_in_pieces(spark, tmp_path):
    """Files past what binaryFile takes, which is set low here: their digests are those of the whole file, whatever their bytes."""
    rng = random.Random(5)
    noise = rng.randbytes(300_000)
    files = {
        "noise.bin": noise, "end.txt": noise + b"\n", "ends.txt": b"\n\n" + noise.replace(b"\r", b"\r\n") + b"\n\n", "mark.txt": b"\xef\xbb\xbf" + noise, "mark_end.txt": b"\xef\xbb\xbf" + noise + b"\n",
        "breaks.txt": b"\n" * 250_000, "one_line.txt": b"x" * 250_000, "short.txt": b"a\n", "a b%20#.txt": noise[::-1],
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    confs = {"spark.sql.sources.binaryFile.maxLength": "65536", "spark.sql.files.maxPartitionBytes": "32768"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = {r.file: (r.sha256, r.n_bytes) for r in corpus.manifest(spark, str(tmp_path), most=65536).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in files.items()}
