"""The prefix trie of conversations, with sums over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns; equal sequences are found by running sums of hashes of (place, turn), so no
conversation is ever read as a whole. A node is named by its smallest member and its depth.

Heavy paths. Of a node's children the one with most members (ties: smallest conv_id) continues its path, every other begins a
path of its own. A light child has at most half of its parent's members, so below the root there are at most log2(members)
light edges. Every path ends in a childless node, whose smallest member passes through all of the path: so a path is a range of
depths of one conversation, and its beginning is that conversation's last light edge. Paths hang their totals on their parents'
nodes in one round for each number of light edges, deepest first, and then one suffix sum along all paths gives the sums of all
subtrees.

Skew. Popular nodes, popular parents and very long conversations are joined by join_groups (the hot ones are broadcast, under
a thousand of them), running sums go by blocks of places, and the hash over a node's conversations streams through its task.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered, running_sums
from .common import join_groups, written

FAMILY = 100
HEADS = 6


def _hash_number(text, half: int):
    """60 bits of a hash, as an exact decimal that a sum of any length does not overflow."""
    return F.conv(F.substring(F.sha2(text, 256), 1 + 15 * half, 15), 16, 10).cast("decimal(38,0)")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn_hash, chars) and conversations (conv_id, length) after each takes over the first h turns of
    the first conversation of its family of a hundred, h = crc32(conv_id) % 6, in place of its own first h."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({
        "turn_hash": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), "chars": F.length("text").cast("long"),
    })
    placed = written(numbered(rows, ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"], "at", drop=["turn", "role", "text"]))
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = sizes.withColumns({"family": family, "h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))})
    heads = sizes.select(F.col("conv_id").alias("family"), F.col("n").alias("family_n"))
    taken = F.least("h", F.coalesce("family_n", F.lit(0)))
    convs = convs.join(heads, "family", "left").withColumn("taken", taken)
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("family_n"))

    own = join_groups(placed, convs, ["conv_id"], "n", max(1, placed.count()))
    own = own.withColumn("place", F.col("at") - F.col("first") + 1)
    kept = own.where(F.col("place") > F.col("h")).select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "turn_hash", "chars")
    lent = own.where((F.col("place") < HEADS) & (F.col("conv_id") == F.col("family"))).select("family", F.col("place").alias("depth"), "turn_hash", "chars")
    lent = lent.join(convs.select("conv_id", "family", "h"), "family").where(F.col("depth") <= F.col("h"))
    return kept.unionByName(lent.select("conv_id", "depth", "turn_hash", "chars")), convs.select("conv_id", "length")


def _members_hash(batches):
    """node, depth, ends_sha256 of rows sorted by node, depth and conv_id; only the running hash is in memory."""
    at, running = None, None
    for b in batches:
        edges = (b[["node", "depth"]].diff().fillna(1) != 0).any(axis=1).to_numpy().nonzero()[0].tolist()
        out = []
        for lo, hi in zip(edges, [*edges[1:], len(b)]):
            key = (int(b["node"].iloc[lo]), int(b["depth"].iloc[lo]))
            ids = ",".join(map(str, b["conv_id"].iloc[lo:hi].tolist()))
            if key == at:
                running.update(f",{ids}".encode())
                continue
            if at is not None:
                out.append((*at, running.hexdigest()))
            at, running = key, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["node", "depth", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, running.hexdigest())], columns=["node", "depth", "ends_sha256"])


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (node, depth, parent, n_convs, chars, n_children, heavy), with the root; the node of each conversation at each depth
    (conv_id, depth, node, n_convs); and the number of the latter. There is at least one conversation."""
    told = F.concat_ws(":", "depth", "turn_hash")
    keyed = turns.select("conv_id", "depth", "chars", _hash_number(told, 0).alias("k0"), _hash_number(told, 1).alias("k1"))
    keyed = running_sums(written(keyed), "conv_id", "depth", ["k0", "k1"])
    keyed = written(keyed.select("conv_id", "depth", "chars", F.concat_ws(":", "depth", "k0", "k1").alias("key")))
    total = max(1, keyed.count())
    found = keyed.groupBy("key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("chars").alias("chars"))
    found = written(found)
    placed = join_groups(keyed.select("conv_id", "depth", "key"), found.select("key", "node", "n_convs"), ["key"], "n_convs", total)
    placed = written(placed.select("conv_id", "depth", "node", "n_convs"))
    root = convs.agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")).select(
        "node", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("chars")
    )
    top = root.first()["node"]
    above = placed.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = found.drop("key").unionByName(root).join(above, ["node", "depth"], "left")
    nodes = written(nodes.withColumn("parent", F.when(F.col("depth") == 1, F.lit(top)).otherwise(F.col("parent"))))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", (-F.col("node")).alias("id"))).alias("best")
    )
    children = written(children.select("node", "depth", "n_children", (-F.col("best.id")).alias("heavy")))
    heavy = children.select(F.col("heavy").alias("node"), (F.col("depth") + 1).alias("depth"), F.lit(True).alias("heavy"))
    nodes = nodes.join(children.drop("heavy"), ["node", "depth"], "left").join(heavy, ["node", "depth"], "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": F.coalesce("heavy", F.col("depth") == 0)})
    return written(nodes), placed, total


def _subtree_sums(nodes: DataFrame, placed: DataFrame, total: int, deepest: int) -> DataFrame:
    """node, depth, n_leaves, saved_tokens."""
    leaves = nodes.where("n_children = 0").select(F.col("node").alias("conv_id"), F.col("depth").alias("bottom"))
    root = nodes.where("depth = 0").select("node", "depth", "n_convs")
    along = join_groups(placed, leaves, ["conv_id"], "bottom", total).select("conv_id", "depth", "node", "n_convs")
    along = along.unionByName(leaves.select("conv_id").crossJoin(F.broadcast(root)).select("conv_id", "depth", "node", "n_convs"))  # the root is one row
    facts = nodes.select("node", "depth", "parent", "n_convs", "chars", "n_children", "heavy")
    along = written(join_groups(along.drop("n_convs"), facts, ["node", "depth"], "n_convs", total).withColumnRenamed("conv_id", "path"))
    light = F.when(~F.col("heavy"), F.struct("depth", "parent"))
    paths = along.groupBy("path").agg(F.max(light).alias("begin"), F.count(light).alias("level"), F.count(F.lit(1)).alias("rows"))
    paths = paths.select("path", "level", "rows", F.coalesce("begin.depth", F.lit(0)).alias("top"), F.col("begin.parent").alias("above"))
    paths = written(paths)
    steps = join_groups(along, paths.select("path", "top", "rows"), ["path"], "rows", total).where(F.col("depth") >= F.col("top"))
    steps = written(steps.select(
        "path", "node", "depth", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    ))
    sums = ["n_leaves", "saved_tokens"]
    owners = steps.select(F.col("node").alias("above"), F.col("depth").alias("at"), F.col("path").alias("up"), "n_children")
    hung = join_groups(paths.where("level > 0").withColumn("at", F.col("top") - 1).drop("rows", "top"), owners, ["above", "at"], "n_children", total)
    own = steps.groupBy("path").agg(*(F.sum(c).alias(c) for c in sums))
    hung = written(hung.select("path", "level", "up", "at").join(own, "path"))

    levels, added = hung.agg(F.max("level").alias("top")).first()["top"] or 0, None
    from_below, everything = None, None
    for level in range(levels, 0, -1):
        mine = hung.where(F.col("level") == level)
        if from_below is not None:
            below = from_below.groupBy("path").agg(*(F.sum(c).alias(f"more_{c}") for c in sums))
            mine = mine.join(below, "path", "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums})
        added = written(mine.groupBy(F.col("up").alias("path"), F.col("at").alias("depth")).agg(*(F.sum(c).alias(c) for c in sums)))
        from_below, everything = added, added if everything is None else everything.unionByName(added)
    if everything is not None:
        more = everything.withColumnsRenamed({c: f"more_{c}" for c in sums})
        steps = steps.join(more, ["path", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums})
    upwards = written(steps.select("path", "node", "depth", (F.lit(deepest) - F.col("depth")).alias("place"), *sums))
    return running_sums(upwards, "path", "place", sums).select("node", "depth", *sums)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    `conversations` needs conv_id, turn, role and text; other columns are ignored. Rows without conv_id belong to no
    conversation and take no part. Turns are ordered by turn, null first; rows with the same turn by role and then text, and
    repeated rows are turns of their own. A null role or text is an empty one. A rebuilt conversation without turns is a member of
    the root only, and where all are, the root is its own only leaf. No conversation at all gives no row.
    """
    turns, convs = rebuilt(conversations)
    convs = written(convs)
    if convs.isEmpty():
        return convs.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        )
    nodes, placed, total = _nodes(turns, convs)
    deepest = convs.agg(F.max("length").alias("top")).first()["top"]
    sums = _subtree_sums(nodes, placed, total, deepest)
    ends = placed.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("node", "depth", "conv_id")
    top = nodes.where("depth = 0").select("node", "depth")
    ends = ends.unionByName(convs.where("length = 0").select("conv_id").crossJoin(F.broadcast(top)).select("node", "depth", "conv_id"))
    ends = ends.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id").mapInPandas(_members_hash, "node long, depth long, ends_sha256 string")
    out = nodes.join(sums, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    return out.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE = """
    WITH RECURSIVE t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
      FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
      SELECT conv_id, conv_id - conv_id % 100 AS family, count(*) AS n,
             xor(list_reduce([unicode(x) for x in string_split(CAST(conv_id AS VARCHAR), '')], lambda a, b:
               list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(a, CAST(b AS BIGINT))), 4294967295), 4294967295) % 6 AS h
      FROM t GROUP BY conv_id
    ), l AS (
      SELECT c.*, least(c.h, coalesce(f.n, 0)) AS taken FROM c LEFT JOIN c f ON f.conv_id = c.family
    ), r AS (
      SELECT l.conv_id, t.place AS depth, t.role, t.text FROM l JOIN t ON t.conv_id = l.family AND t.place <= l.h
      UNION ALL
      SELECT l.conv_id, t.place - l.h + l.taken, t.role, t.text FROM l JOIN t ON t.conv_id = l.conv_id AND t.place > l.h
    ), p AS (
      SELECT conv_id, 0 AS depth, '' AS key, 0 AS chars FROM l
      UNION ALL
      SELECT p.conv_id, p.depth + 1, sha256(p.key || ':' || length(r.role) || ':' || r.role || r.text), length(r.text)
      FROM p JOIN r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1
    ), q AS (
      SELECT *, min(conv_id) OVER (PARTITION BY depth, key) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM p
    ), g AS (
      SELECT node, depth, any_value(chars) AS chars, count(*) AS n_convs,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '')) AS ends_sha256
      FROM q GROUP BY node, depth
    ), e AS (
      SELECT g.*, q.node AS parent FROM g LEFT JOIN q ON q.conv_id = g.node AND q.depth = g.depth - 1
    ), k AS (
      SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL
    ), m AS (
      SELECT e.*, coalesce(k.n_children, 0) AS n_children FROM e LEFT JOIN k USING (node, depth)
    ), s AS (
      SELECT up.node, up.depth, sum(CAST(m.n_children = 0 AS BIGINT)) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
      FROM m JOIN q up ON up.conv_id = m.node AND up.depth <= m.depth GROUP BY ALL
    )
    SELECT m.node AS conv_id, CAST(m.depth AS BIGINT) AS depth, m.parent AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children,
           CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN s USING (node, depth)
"""
