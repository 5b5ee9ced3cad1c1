"""Line annotation: longest-match hits of lexicons, negation, roll-up to documents, and the rules that lines support."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import FILLER, FIRST_MARK, Lexicon, TextProfile, fold, negated, seen_before, split_lines
from .stage import kept, spread

EDGE = "\uffff"  # between texts: no surface has it; of two bytes, so that a batch without rarer characters has no wider ones
PRIVATE = re.compile(f"[{chr(FIRST_MARK)}-{chr(FILLER)}]")  # a text's own are read as replacement characters
HITS, HELD = 1 << 16, 1 << 26  # rows of a batch, and characters where hits keep their lines
PIECE = 1 << 22  # characters that are masked at once, if they are not one line


def lines_of(docs: DataFrame, text: Column, profile: TextProfile) -> DataFrame:
    """doc_id, line_no from 0, line."""
    return docs.select("doc_id", F.posexplode(split_lines(text, profile)).alias("line_no", "line"))


def _masked(text: str, ranked: list[tuple[str, str]]) -> str:
    """The text with the matches of ranked surfaces, longest first and none over another, as one private character that names the
    surface and fillers up to its length, so that places stay."""
    for i, (surface, _) in enumerate(ranked):
        if surface:
            text = text.replace(surface, chr(FIRST_MARK + i) + chr(FILLER) * (len(surface) - 1))
    return text


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slices(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The text from `begin` to `end` for each of them, from code points."""
    sizes = end - begin
    ends = np.cumsum(sizes)
    said = points[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)]
    wide = np.concatenate(([0], np.cumsum(1 + (said > 0x7F) + (said > 0x7FF) + (said > 0xFFFF))))  # bytes in UTF-8
    offsets = wide[np.concatenate(([0], ends))].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(said.tobytes().decode("utf-32-le").encode()))


def _pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PIECE characters of a column at most, so that long lines do not meet in one large string."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(column).fill_null("")).to_numpy(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]))


def _found(folded: str, lexicons: dict[str, Lexicon], keep: list[str], reach: int | None):
    """Rows to a row a hit. The texts of a piece are masked as one string, between edges that no surface has."""
    ranked = {kind: lexicon.ranked() for kind, lexicon in lexicons.items()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, folded):
            texts = batch.column(folded).fill_null("")
            sizes = pc.utf8_length(texts).to_numpy().astype(np.int64) + 1
            starts = np.cumsum(sizes) - sizes
            whole = EDGE.join(texts.to_pylist())
            plain = PRIVATE.sub("\ufffd", whole)
            rows, kept = [], batch.select(keep)
            step = max(1, min(HITS, HELD // int(sizes.max(initial=1)))) if folded in keep else HITS
            for kind, names in ranked.items():
                marks = _points(_masked(plain, names)) - np.uint32(FIRST_MARK)  # what is below the marks comes out far above them
                at = np.flatnonzero(marks < len(names))
                rows.append((kind, names, at, marks[at]))
            seen = None if reach is None else _points(whole)
            for kind, names, every, marks in rows:
                for some in range(0, len(every), step):
                    at, mark = every[some : some + step], pa.array(marks[some : some + step])
                    row = np.searchsorted(starts, at, "right") - 1
                    said = [pa.array([kind] * len(at), pa.string()), pa.array(at - starts[row]), *(pa.array([n[k] for n in names], pa.string()).take(mark) for k in (1, 0))]
                    if seen is not None:
                        said.append(_slices(seen, np.maximum(starts[row], at - reach), at))
                    yield pa.RecordBatch.from_arrays([*kept.take(pa.array(row)).columns, *said], [*keep, "kind", "pos", "canon", "surface", "before"][: len(keep) + len(said)])

    return of


def hits_in(texts: DataFrame, folded: str, lexicons: dict[str, Lexicon], *keep: str, reach: int | None = None) -> DataFrame:
    """The columns to keep, kind, pos (from 0), canon, surface: a row a hit in the column `folded`; kinds have masks of their own.
    With `reach` also before: so many characters at most before the hit. A batch is masked at once and all places of its marks come
    from one pass, so a hit costs the same in a long line as in a short one, also if the line is not kept."""
    kept = [f for f in texts.schema.fields if f.name in keep]
    said = T.StructType([*kept, *(T.StructField(n, t) for n, t in (("kind", T.StringType()), ("pos", T.LongType()), ("canon", T.StringType()), ("surface", T.StringType())))])
    if reach is not None:
        said = said.add("before", T.StringType())
    return texts.select(*dict.fromkeys([*(f.name for f in kept), folded])).mapInArrow(_found(folded, lexicons, [f.name for f in kept], reach), said)


def annotate_lines(lines: DataFrame, lexicons: dict[str, Lexicon], profile: TextProfile, negation: str) -> DataFrame:
    """doc_id, line_no, kind, pos, canon, surface, negated: a row a hit. Of a line only what the pattern can see goes with a hit."""
    folded = lines.select("doc_id", "line_no", fold(F.col("line"), profile).alias("f"))
    reach = seen_before(negation)
    if reach is None:
        found = hits_in(folded, "f", lexicons, "doc_id", "line_no", "f").withColumn("negated", negated(F.col("f"), F.col("pos").cast("int"), negation))
    else:
        found = hits_in(folded, "f", lexicons, "doc_id", "line_no", reach=reach).withColumn("negated", F.col("before").rlike(negation))
    return found.select("doc_id", "line_no", "kind", "pos", "canon", "surface", "negated")


def annotation(docs: DataFrame, lexicons: dict[str, Lexicon], profile: TextProfile, negation: str) -> DataFrame:
    """annotate_lines of `docs` (doc_id, text) as a stored table, which everything about the same texts and lexicons reads.

    The table's name has the lexicons and two sums of hashes of all rows: so the texts are scanned to see that they are the same,
    and annotated only where they are not. That scan takes the texts where they lie; they are dealt for the annotation alone, whose
    work is much more than the dealing.
    """
    sums = [F.coalesce(F.sum(F.xxhash64("doc_id", "text", F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"s{seed}") for seed in (1, 2)]
    told = docs.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    name = hashlib.sha256(repr((tuple(told), lexicons, profile, negation)).encode()).hexdigest()
    return kept(annotate_lines(lines_of(spread(docs, "doc_id"), F.col("text"), profile), lexicons, profile, negation), f"annotation-{name}")


def roll_up(found: DataFrame) -> DataFrame:
    """doc_id, kind, canon, n, first_line, seen_rank: canons in order of first appearance; negated hits do not count."""
    live = found.where(~F.col("negated"))
    per = live.groupBy("doc_id", "kind", "canon").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "pos")).alias("at"))
    order = Window.partitionBy("doc_id", "kind").orderBy("at.line_no", "at.pos", "canon")
    return per.select(
        "doc_id", "kind", "canon", "n", F.col("at.line_no").cast("long").alias("first_line"), F.row_number().over(order).cast("long").alias("seen_rank")
    )


def image_feeling_rules(found: DataFrame, image: str = "image", feeling: str = "feeling", surfaces: bool = False) -> DataFrame:
    """doc_id, seq, image, feeling, strength, line_no: each pair of an image and a feeling in the same (0) or the next line (1).

    Of a pair's occurrences the best by (strength, line, positions) is the evidence; rules are numbered by first appearance. With
    `surfaces` also image_surface and feeling_surface, what the evidence line (line_no) has of the two, null where that is in the next line.

    Of a line's hits of one canon only the first can be evidence, so no more meet the other kind: pairs grow with lines, not with
    the square of a long line's hits.
    """
    live, first = found.where(~F.col("negated")), F.struct("pos", "surface") if surfaces else F.struct("pos")
    a = live.where(F.col("kind") == image).select("doc_id", F.col("line_no").alias("la"), F.col("canon").alias("image"), first.alias("at"))
    b = live.where(F.col("kind") == feeling).select("doc_id", F.explode(F.array(F.col("line_no"), F.col("line_no") - 1)).alias("la"), F.col("line_no").alias("lb"), F.col("canon").alias("feeling"), first.alias("at"))
    spots = a.groupBy("doc_id", "la", "image").agg(F.min("at").alias("a"))
    near = b.groupBy("doc_id", "la", "lb", "feeling").agg(F.min("at").alias("b"))  # an equi-join, not a range one
    both = spots.join(near, ["doc_id", "la"]).withColumn("strength", F.col("lb") - F.col("la"))
    said = [F.col("a.surface").alias("sa"), F.col("b.surface").alias("sb")] if surfaces else []
    places = F.col("a.pos").alias("pa"), F.col("b.pos").alias("pb")
    best = both.groupBy("doc_id", "image", "feeling").agg(
        F.min(F.struct("strength", "la", *places, *said)).alias("best"), F.min(F.struct("la", "strength", *places)).alias("first")
    )
    order = Window.partitionBy("doc_id").orderBy("first", "image", "feeling")
    shown = [F.col("best.sa").alias("image_surface"), F.when(F.col("best.strength") == 0, F.col("best.sb")).alias("feeling_surface")] if surfaces else []
    return best.select(
        "doc_id", F.row_number().over(order).cast("long").alias("seq"), "image", "feeling",
        F.col("best.strength").cast("long").alias("strength"), F.col("best.la").cast("long").alias("line_no"), *shown,
    )


def with_lines(rules: DataFrame, docs: DataFrame, profile: TextProfile) -> DataFrame:
    """The rules (doc_id, line_no and more) with their `line` of `docs` (doc_id, text); those whose text has no such line drop out.

    A work's rules are few, as the pairs of canons are, so they meet its text as one row: texts are dealt by doc_id and only those
    with rules are split, once, where a join of lines would deal every line. The dealing is the join's own, so texts move once, and
    it is asked for, so that few rules that are broadcast do not leave the splitting to the one task that reads a row group.
    """
    own = F.struct(*(c for c in rules.columns if c != "doc_id"))
    per = rules.groupBy("doc_id").agg(F.collect_list(own).alias("_rules"))
    split = F.array(split_lines(F.col("text"), profile))  # bound, so that a text is split once
    told = F.transform(split, lambda ls: F.transform("_rules", lambda r: F.struct(r.alias("r"), F.get(ls, r["line_no"].cast("int")).alias("line"))))
    each = docs.repartition("doc_id").join(per, "doc_id").select("doc_id", F.explode(F.get(told, F.lit(0))).alias("e"))
    return each.select("doc_id", "e.r.*", "e.line").where("line IS NOT NULL")
