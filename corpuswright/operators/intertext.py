"""Reuse of passages between documents: shared word n-grams, runs on a diagonal, the best run of each pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lookup import mixed, pieces
from .stage import once

GRAM, MAX_DOCS, SPAN_LEVELS = 5, 20, (10, 7)  # fixed values
MARK = 34  # bits of a gram's hash by which those of one document are told
LEAST_BITS, MOST_BITS, BITS_A_GRAM = 1 << 20, 1 << 30, 16  # of the filter: 128 MiB at most
LEAST_SHARES, MOST_SHARES = 4, 1 << 12  # of the marks


def shingles(units: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, pos, gram from doc_id, unit (array of tokens)."""
    grams = F.when(
        F.size("unit") >= n,
        F.transform(F.sequence(F.lit(0), F.size("unit") - n), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("unit", i + 1, F.lit(n)), " ").alias("gram"))),
    )
    return units.select("doc_id", F.explode(grams).alias("g")).select("doc_id", F.col("g.pos").alias("pos"), F.col("g.gram").alias("gram"))


def keyed_grams(units: DataFrame, n: int = GRAM) -> DataFrame:
    """g, h, doc_id, pos: every gram of doc_id, unit by 96 bits of hash, dealt once by them. What is grouped and joined by the gram
    after that reads this one exchange."""
    words = units.where(F.col("doc_id").isNotNull()).select("doc_id", F.transform("unit", lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= n)
    gram = lambda hashed, i, *seed: hashed(*map(F.lit, seed), *(F.get("w", i + k) for k in range(n)))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(i.alias("pos"), gram(F.xxhash64, i).alias("g"), gram(F.hash, i, 1).alias("h")))
    return words.select("doc_id", F.explode(grams).alias("x")).select("x.g", "x.h", "doc_id", "x.pos").repartition("g", "h")


def _gram_hashes(words: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, place in the piece, g and h of all grams of a piece's rows."""
    sizes = np.diff(ends, prepend=0)
    last = max(len(words) - n + 1, 0)
    g = h = words[:last]
    for k in range(1, n):
        g, h = mixed(g, words[k : k + last], 0xFF51AFD7ED558CCD), mixed(h, words[k : k + last], 0xC4CEB9FE1A85EC53)
    row = np.repeat(np.arange(len(sizes)), sizes)[:last]
    at = np.flatnonzero(np.arange(last) + n <= ends[row])
    return row[at], at, g[at], h[at]


def _packed(sorted_marks: np.ndarray) -> bytes:
    """The steps of ascending marks, byte by byte, so that what is always zero is next to itself."""
    return np.diff(sorted_marks, prepend=np.uint64(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(steps: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint64)


def _marks(n: int, width: int):
    """Rows of texts to the marks of their grams, of each text once, in shares of 2**width marks: share, marks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words, ends in pieces(batch):
                row, _, g, _ = _gram_hashes(words, ends, n)
                told = np.unique(((g >> np.uint64(64 - MARK)) << np.uint64(64 - MARK)) | row.astype(np.uint64)) >> np.uint64(64 - MARK)
                share = told >> np.uint64(width)
                first = np.flatnonzero(np.append(True, np.diff(share) != 0)) if len(told) else []
                parts = np.split(told & np.uint64((1 << width) - 1), first[1:]) if len(told) else []
                yield pa.RecordBatch.from_arrays([pa.array(share[first].astype(np.int32)) if len(told) else pa.array([], pa.int32()), pa.array(map(_packed, parts), pa.binary())], ["share", "marks"])

    return of


def _repeated(table: pa.Table) -> pa.Table:
    """Of a share the marks that more than one text has."""
    all_ = np.sort(np.concatenate([_unpacked(x) for x in table["marks"].to_pylist()]))
    twice = np.unique(all_[1:][all_[1:] == all_[:-1]])
    return pa.table({"share": table["share"][:1], "n": pa.array([len(twice)], pa.int64()), "marks": pa.array([_packed(twice)], pa.binary())})


def _bits(width: int, shift: int):
    """Shares of marks to their bits of the filter, one for 2**shift marks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share, marks in zip(batch.column("share").to_pylist(), batch.column("marks").to_pylist()):
                held = np.zeros(1 << (width - shift), bool)
                held[_unpacked(marks) >> np.uint64(shift)] = True
                yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["share", "bits"])

    return of


def _kept_grams(n: int, held, n_bits: int):
    """Rows of texts to their grams that the filter holds: pos, g, h, and the g of the grams right before and after, where it holds them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = np.frombuffer(held.value, np.uint8), np.uint64(64 - n_bits.bit_length() + 1)
        for batch in batches:
            for some, words, ends in pieces(batch):
                row, place, g, h = _gram_hashes(words, ends, n)
                bit = g >> shift
                has = (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
                at = np.flatnonzero(has)
                if not len(at):
                    continue
                near = [np.clip(at + k, 0, len(g) - 1) for k in (-1, 1)]
                none = [~has[x] | (x == at) | (row[x] != row[at]) for x in near]
                told = some.drop_columns(["w"]).take(pa.array(row[at]))
                pos = place[at] - (ends - np.diff(ends, prepend=0))[row[at]]
                beside = [pa.array(g[x].view(np.int64), mask=m) for x, m in zip(near, none)]
                yield pa.RecordBatch.from_arrays(
                    [*told.columns, pa.array(pos.astype(np.int32)), pa.array(g[at].view(np.int64)), pa.array((h[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)), *beside], [*told.schema.names, "pos", "g", "h", "before", "after"]
                )

    return of


def repeated_grams(units: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, pos, g, h (96 bits of a gram's hash), before and after (g of the grams beside it): all grams that two documents may
    share, and few others.

    Most grams are one document's. To find the others 34 bits of each gram's hash are enough, which sorted take about two bytes; they
    are dealt by their ranges, and what repeats becomes a filter, one bit for several marks where there are very many. The texts are
    read again with it, and only what it holds leaves the task.
    """
    spark = units.sparkSession
    words = units.where(F.col("doc_id").isNotNull()).select("doc_id", F.transform("unit", lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= n)
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = min(max(1 << (wanted - 1).bit_length(), LEAST_SHARES), MOST_SHARES)
    width = MARK - shares.bit_length() + 1
    twice = once(words.select("w").mapInArrow(_marks(n, width), "share int, marks binary").groupBy("share").applyInArrow(_repeated, "share int, n long, marks binary"))
    many = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    n_bits = LEAST_BITS
    while n_bits < min(MOST_BITS, BITS_A_GRAM * many):
        n_bits *= 2
    held, size = bytearray(n_bits // 8), n_bits // 8 // shares
    for r in twice.mapInArrow(_bits(width, MARK - n_bits.bit_length() + 1), "share int, bits binary").collect():
        held[r["share"] * size : (r["share"] + 1) * size] = r["bits"]
    kind = words.schema["doc_id"].dataType.simpleString()
    return words.mapInArrow(_kept_grams(n, spark.sparkContext.broadcast(bytes(held)), n_bits), f"doc_id {kind}, pos int, g long, h int, before long, after long")


def shared_grams(units: DataFrame, n: int = GRAM, max_docs: int = MAX_DOCS) -> DataFrame:
    """g, h, doc_id, pos, before, after of the grams of two to `max_docs` documents, dealt by g; before and after are those grams beside
    it that are not of more. Grams of more are no evidence of reuse (a feature of the operator); the others make at most max_docs
    squared pairs of documents each, so none is hot.

    Whether a gram is of too many is known where its rows are, so from there a row goes to each gram that stands beside it anywhere.
    """
    of_gram = Window.partitionBy("g", "h")
    docs = F.dense_rank().over(of_gram.orderBy("doc_id"))  # where the exchange has put a gram's rows, so it is the only one
    whole = (F.spark_partition_id() >= 0) | (F.hash("h", "pos", "before", "after") == 0)  # which all rows pass: so every reader wants all columns, and all read one exchange
    ranked = repeated_grams(units, n).repartition("g").where(whole).withColumn("k", docs).withColumn("n", F.max("k").over(of_gram))
    sides = F.array(F.struct(F.col("after").alias("of"), F.col("g").alias("before"), F.lit(None).cast("long").alias("after")), F.struct(F.col("before").alias("of"), F.lit(None).cast("long").alias("before"), F.col("g").alias("after")))
    told = ranked.where(F.col("n") > max_docs).select(F.explode(sides).alias("x")).select("x.*").where(F.col("of").isNotNull()).distinct()
    often = told.groupBy(F.col("of").alias("g")).agg(F.collect_set("before").alias("often_before"), F.collect_set("after").alias("often_after"))
    found = ranked.where(F.col("n").between(2, max_docs)).drop("k", "n").join(often, "g", "left")
    rare = lambda side: F.when(~F.coalesce(F.array_contains(f"often_{side}", F.col(side)), F.lit(False)), F.col(side)).alias(side)
    return found.select("g", "h", "doc_id", "pos", rare("before"), rare("after"))


def frequent_runs(units: DataFrame, n: int = GRAM, max_docs: int = MAX_DOCS) -> DataFrame:
    """gram, n_docs, doc_id, pos: what shared_grams leaves out, as membership instead of pairs: the documents that share each
    gram of over `max_docs` documents, with a place of it. Grams go by their hashes; a gram's words are read once, in the least
    document that has it."""
    first = keyed_grams(units, n).groupBy("g", "h", "doc_id").agg(F.min("pos").alias("pos"))
    often = first.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "pos")).alias("at")).where(F.col("n_docs") > max_docs)
    told = once(first.join(often, ["g", "h"]))
    asked = told.where(F.col("doc_id") == F.col("at.doc_id")).groupBy("doc_id").agg(F.collect_list(F.struct("g", "h", "pos")).alias("asked"))
    said = units.join(asked, "doc_id").select(F.explode(F.transform("asked", lambda x: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.array_join(F.slice("unit", x["pos"] + 1, n), " ").alias("gram")))).alias("x"))
    return told.join(said.select("x.*"), ["g", "h"]).select("gram", "n_docs", "doc_id", F.col("pos").cast("long").alias("pos"))


def runs(units: DataFrame, n: int = GRAM, max_docs: int = MAX_DOCS) -> DataFrame:
    """a, b, pa, pb, length with a < b of the maximal runs: consecutive shared grams of two documents on one diagonal.

    Each place of a shared gram knows the shared grams right before and after it. Where two documents meet in a gram, a run begins
    unless the grams before are the same, and ends unless those after are: so only the two ends of a run leave the join, however
    long it is, and not all of its places.
    """
    placed = shared_grams(units, n, max_docs)
    side = lambda x: placed.select("g", "h", *(F.col(c).alias(f"{k}{x}") for c, k in (("doc_id", ""), ("pos", "p"), ("before", "before_"), ("after", "after_"))))
    same = lambda k: F.coalesce(F.col(f"{k}_a") == F.col(f"{k}_b"), F.lit(False))
    same_h = F.col("h_a").bitwiseXOR(F.col("h_b")) == 0  # no key of the join, as rows are dealt by g
    met = side("a").withColumnRenamed("h", "h_a").join(side("b").withColumnRenamed("h", "h_b"), "g").where(same_h & (F.col("a") < F.col("b")) & ~(same("before") & same("after")))
    ends = met.select("a", "b", (F.col("pa") - F.col("pb")).alias("diagonal"), "pa", (~same("before")).alias("begins"), (~same("after")).alias("ends"))
    on = Window.partitionBy("a", "b", "diagonal").orderBy(F.desc("pa"))
    till = F.min(F.when(F.col("ends"), F.col("pa"))).over(on)  # the next end from here
    found = ends.withColumn("till", till).where("begins").groupBy("a", "b", "diagonal", "pa").agg(F.min("till").alias("till"))
    return found.select("a", "b", F.col("pa").cast("long").alias("pa"), (F.col("pa") - F.col("diagonal")).cast("long").alias("pb"), (F.col("till") - F.col("pa") + n).cast("long").alias("length"))


def best_runs(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b, pa, pb, length, coverage (of the shorter document), mode: the longest run of each pair, the first on a tie."""
    best = found.groupBy("a", "b").agg(F.max_by(F.struct("pa", "pb", "length"), F.struct(F.col("length"), -F.col("pa"), -F.col("pb"))).alias("r"))
    na, nb = sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
    out = best.select("a", "b", "r.*").join(na, "a").join(nb, "b").withColumn("coverage", F.round(F.col("length") / F.least("na", "nb"), 4))
    mode = F.when((F.col("length") >= SPAN_LEVELS[0]) & (F.col("coverage") >= 0.8), "same").when(F.col("length") >= SPAN_LEVELS[1], "quote").otherwise("echo")
    return out.select("a", "b", "pa", "pb", "length", "coverage", mode.alias("mode"))


def pairs_within(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs (a, b) of which both documents are asked for (doc_id)."""
    ids = asked.select("doc_id").distinct()
    return pairs.join(ids.select(F.col("doc_id").alias("a")), "a", "left_semi").join(ids.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")


def pairs_of(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The pairs of which either document is asked for, each once."""
    ids = asked.select("doc_id").distinct()
    left = pairs.join(ids.select(F.col("doc_id").alias("a")), "a", "left_semi").select("a", "b")
    return left.unionByName(pairs.join(ids.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")).distinct()


def without_asides(found: DataFrame, spans: DataFrame, pattern: str) -> DataFrame:
    """The best runs (a, b, ...) whose passage (a, b, span) is no stage direction: a pair with one as its best run goes."""
    aside = spans.where(F.col("span").rlike(pattern)).select("a", "b")
    return found.join(aside, ["a", "b"], "left_anti")


def with_direction(pairs: DataFrame, works: DataFrame, eras: list[str]) -> DataFrame:
    """Adds source_id, target_id and common_source to pairs: from the earlier era to the later (in the order of `eras`, unknown
    ones last); of one era by id, and then a common source is possible."""
    rank = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, eras)), c), F.lit(0)), F.lit(len(eras) + 1))
    era = works.select("doc_id", "era")
    told = pairs.join(era.select(F.col("doc_id").alias("a"), F.col("era").alias("ea")), "a").join(era.select(F.col("doc_id").alias("b"), F.col("era").alias("eb")), "b")
    turned = rank(F.col("eb")) < rank(F.col("ea"))
    out = told.withColumns({"source_id": F.when(turned, F.col("b")).otherwise(F.col("a")), "target_id": F.when(turned, F.col("a")).otherwise(F.col("b")), "common_source": rank(F.col("ea")) == rank(F.col("eb"))})
    return out.drop("ea", "eb")
