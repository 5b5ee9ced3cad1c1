"""The gate's audit and sinks, assets with their counts, and malformed lines."""

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuswright.operators import gate
from corpuswright.plans import checks
from corpuswright.sources import corpus

SF = "/root/testdata/sf0.001"


def test_three_sinks_of_one_gate(spark, tmp_path):
    reviewed = checks.gated(spark, SF)
    gate.persist(reviewed, f"{tmp_path}/out")
    levels = {r.level: r.n for r in reviewed.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    n_rejected = levels.get("rejected", 0)
    assert read("rejected").count() == n_rejected and read("accepted").count() == sum(levels.values()) - n_rejected > 0
    rows = sorted(read("audit").collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(1, len(rows) + 1)) and all(r.audit_id == f"AUD_{r.seq:06d}" for r in rows)
    stages, at = {}, []
    for r in rows:
        if r.rule_id not in stages:
            at.append(r.rule_id)
        stages.setdefault(r.rule_id, []).append((r.stage, r.result))
    assert len(stages) == sum(levels.values())
    for said in stages.values():
        names = [s for s, _ in said]
        assert said[-1][0] == "release" and names[0] == "schema"
        if said[0][1] == "fail":
            assert names == ["schema", "release"] and said[-1][1] == "rejected"
        elif ("repair", "repaired") in said:
            assert names == ["schema", "evidence", "semantic", "critic", "repair", "evidence", "consensus", "release"]
        else:
            assert names == ["schema", "evidence", "semantic", "critic", "consensus", "release"]
    known = corpus.ready(spark, f"{tmp_path}/out", {"accepted": -1, "audit": len(rows), "rejected": n_rejected, "nothing": 3}).collect()
    assert [(r.asset, r.ok, r.n) for r in known][1:] == [("audit", True, len(rows)), ("rejected", True, n_rejected), ("nothing", False, -1)] and known[0].ok


def test_counts_are_committed_with_an_asset(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, cast(id AS string)) AS text").repartition(7)
    first = corpus.replace_atomically(rows, f"{tmp_path}/a")
    again = corpus.replace_atomically(rows.repartition(2), f"{tmp_path}/b")
    assert first == again == corpus.counts_of(spark, f"{tmp_path}/a") and first["n"] == 1000
    other = corpus.replace_atomically(rows.where("id <> 5"), f"{tmp_path}/a")
    assert other["n"] == 999 and other["checksum"] != first["checksum"] and spark.read.parquet(f"{tmp_path}/a").count() == 999
    assert corpus.replace_atomically(rows.limit(0), f"{tmp_path}/c")["n"] == 0 and corpus.counts_of(spark, f"{tmp_path}/d") is None


def test_malformed_lines_are_counted_in_the_same_pass(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": "no number"}\n{"b": "y", "c": 3}\n')
    seen = Observation()
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = corpus.read_lines(spark, f"{tmp_path}/x.json", schema, seen).collect()
    assert sorted((r.a or 0, r.b) for r in rows) == [(0, "y"), (1, "x")] and seen.get == {"n": 4, "malformed": 2}
    assert corpus.read_lines(spark, f"{tmp_path}/x.json", schema).count() == 2
