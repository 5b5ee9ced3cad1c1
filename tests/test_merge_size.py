"""The merge of collections moves a body twice at most, whatever merges, and keeps runs that partitions cut."""

import random

import pytest

from corpuswright.operators import dedup_merge


def _written(spark, df) -> float:
    """Bytes of shuffle files that the rows of `df` take, by the status of the stages."""
    store = spark._jsc.sc().statusStore()
    done = lambda: sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))
    before = done()
    df.write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return done() - before


def test_bodies_move_twice(spark):
    rnd = random.Random(3)
    whole = ["".join(rnd.choices("abcdefghijklmnop", k=2000)) for _ in range(300)]
    rows = [(k, "a", t, "x") for k, t in enumerate(whole)] + [(1000 + k, "a", t[: 500 + k], "y") for k, t in enumerate(whole)]
    records = spark.createDataFrame(rows, "ord long, author string, body string, origin string").repartition(4).cache()
    size = sum(len(r[2]) for r in rows) // 2  # of letters out of sixteen, packed
    assert records.count() == 600
    assert _written(spark, dedup_merge.merged_works(records)) < 4 * size
    records.unpersist()


@pytest.mark.parametrize("partitions", ["1", "5", "60"])
def test_merge_across_partitions(spark, partitions):
    """Runs over several partitions, many copies, many short bodies, the same body under two authors, and no id."""
    run = [(k, "a", "x" * (12 + k), f"o{k % 3}") for k in range(80)]
    other = [(200 + k, "b", "x" * 40, "o") for k in range(50)] + [(300 + k, None, "", "o") for k in range(40)] + [(400, "a", "y" * 9, "p"), (401, "a", "y" * 9, "q"), (402, "a", "y" * 20, "q")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.ord: (r.body[:1], len(r.body), r.n_merged, r.origins) for r in dedup_merge.merge_collections(spark.createDataFrame(run + other, "ord long, author string, body string, origin string")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {0: ("x", 91, 80, "o0,o1,o2"), 200: ("x", 40, 50, "o"), 400: ("y", 9, 2, "p,q"), 402: ("y", 20, 1, "q")} | {300 + k: ("", 0, 1, "o") for k in range(40)}
    assert got == want
