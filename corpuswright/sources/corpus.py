"""Collections of works in JSON files, normalised to one table; JSON lines and Parquet at the edges."""

from __future__ import annotations

import _hashlib
import ctypes
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.stage import shared_folder

_TEXTS = ("title", "chapter", "section", "rhythmic", "author", "prologue", "desc", "dynasty", "genre")
_LISTS = ("paragraphs", "para", "content", "notes", "tags")
COUNTS = "_counts.json"  # beside an asset's files; names with an underscore are no data
RAW = T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS] + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LISTS])


def _text(*names: str) -> Column:
    """The first of the fields that is not blank."""
    return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names))


def _lines(*names: str) -> Column:
    kept = [F.filter(F.col(n), lambda x: x.isNotNull() & (F.trim(x) != "")) for n in names]
    return F.coalesce(*(F.when(F.size(k) > 0, k) for k in kept), F.array().cast("array<string>"))


def standard(raw: DataFrame) -> DataFrame:
    """title, cipai, author, dynasty, genre, section, paragraphs, notes, tags, appreciation; works without a paragraph are left
    out. Columns that begin with an underscore pass through."""
    return with_text(
        raw.select(
            *(c for c in raw.columns if c.startswith("_")),
            F.coalesce(_text("title", "chapter", "rhythmic"), F.lit("")).alias("title"), F.coalesce(_text("rhythmic"), F.lit("")).alias("cipai"),
            F.coalesce(_text("author"), F.lit("佚名")).alias("author"), F.coalesce(_text("dynasty"), F.lit("")).alias("dynasty"), F.coalesce(_text("genre"), F.lit("")).alias("genre"),
            F.coalesce(_text("section", "chapter"), F.lit("")).alias("section"), _lines("paragraphs", "para", "content").alias("paragraphs"), _lines("notes").alias("notes"),
            _lines("tags").alias("tags"), F.coalesce(_text("prologue", "desc"), F.lit("")).alias("appreciation"),
        )
    )


def with_text(works: DataFrame) -> DataFrame:
    return works.where(F.size("paragraphs") > 0)


def odes(raw: DataFrame) -> DataFrame:
    """Anonymous works of a chapter and a section; both, if there, name the section."""
    section = F.concat_ws("·", F.nullif(F.trim("chapter"), F.lit("")), F.nullif(F.trim("section"), F.lit("")))
    named = raw.withColumns({"_section": section, "author": F.lit("佚名"), "genre": F.lit("诗经体")})
    return standard(named).withColumn("section", F.col("_section")).drop("_section")


def songs_of_chu(raw: DataFrame) -> DataFrame:
    return standard(raw.withColumn("genre", F.lit("楚辞体")))


def arias(raw: DataFrame) -> DataFrame:
    """Titles `play・mode/tune`: the play is the section, the tune the cipai, the mode a tag. Where there is no body and what
    follows the mark is punctuated or long, it is the body, and what stands before is the tune."""
    head, tail = F.trim(F.substring_index("title", "・", 1)), F.regexp_replace("title", "^.*?・", "")
    split, lost = F.contains("title", F.lit("・")), (F.size(_lines("paragraphs", "para", "content")) == 0) & (tail.rlike("[，。！？；]") | (F.length(tail) > 15))
    rescued, parted = split & lost, split & ~lost
    mode, tune = F.when(F.contains(tail, F.lit("/")), F.trim(F.substring_index(tail, "/", 1))).otherwise(""), F.trim(F.regexp_replace(tail, "^[^/]*/", ""))
    told = raw.withColumns({
        "_mode": F.when(parted & (mode != ""), F.concat(F.lit("宫调:"), mode)), "_play": F.when(parted, head), "_tune": F.when(rescued, F.left(head, F.lit(8))).when(parted, F.left(tune, F.lit(12))),
        "paragraphs": F.when(rescued, F.array(tail)).otherwise(F.col("paragraphs")), "title": F.when(rescued, F.when(head == "", "支曲").otherwise(head)).otherwise(F.col("title")),
    })
    out = standard(told).withColumns({
        "cipai": F.coalesce("_tune", "cipai"), "section": F.coalesce("_play", "section"), "tags": F.array_compact(F.concat("tags", F.array("_mode"))),
    })
    return out.drop("_mode", "_play", "_tune")


def titled_by_tune(raw: DataFrame) -> DataFrame:
    """Titles `tune·first line`: what stands before the first mark is the tune, if it has two to seven characters."""
    head = F.trim(F.regexp_extract("title", "^(.*?)[·・‧]", 1))
    return standard(raw.withColumn("rhythmic", F.when(F.length(head).between(2, 7), head).otherwise(F.col("rhythmic"))))


def nested_sections(raw: DataFrame) -> DataFrame:
    """A file of sections, each a genre with its works, whose authors are written `（dynasty）name`."""
    each = raw.select("_file", "_pos", F.posexplode("content").alias("_i", "s")).select("_file", "_pos", "_i", F.trim("s.type").alias("_genre"), F.posexplode("s.content").alias("_j", "w"))
    pattern = "^（(.*?)）(.*)$"
    found = F.trim(F.regexp_extract("w.author", pattern, 1))
    flat = each.select(
        "_file", (F.col("_pos") * (1 << 24) + F.col("_i") * (1 << 16) + F.col("_j")).alias("_pos"), F.trim("w.chapter").alias("title"), F.col("_genre").alias("genre"), F.col("_genre").alias("section"),
        F.when(found != "", found).alias("dynasty"), F.when(found != "", F.trim(F.regexp_extract("w.author", pattern, 2))).otherwise(F.trim("w.author")).alias("author"), F.col("w.paragraphs").alias("paragraphs"),
    )
    missing = [f for f in RAW.fields if f.name not in flat.columns]
    return standard(flat.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in missing)))


def prefixed_dynasty(raw: DataFrame) -> DataFrame:
    """Authors written `（dynasty）name` are split."""
    found = F.regexp_extract("author", "^（(.*?)）(.*)$", 1)
    return standard(
        raw.withColumn("dynasty", F.when(found != "", found).otherwise(F.col("dynasty"))).withColumn("author", F.when(found != "", F.regexp_extract("author", "^（(.*?)）(.*)$", 2)).otherwise(F.col("author")))
    )


SECTIONS = T.StructType([T.StructField("content", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("content", T.ArrayType(T.StructType([T.StructField("chapter", T.StringType()), T.StructField("author", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType()))]))),
])))])
PARSERS: dict[str, tuple[T.StructType, Callable[[DataFrame], DataFrame]]] = {
    "standard": (RAW, standard), "odes": (RAW, odes), "songs_of_chu": (RAW, songs_of_chu), "arias": (RAW, arias), "titled_by_tune": (RAW, titled_by_tune), "prefixed_dynasty": (RAW, prefixed_dynasty),
    "nested_sections": (SECTIONS, nested_sections),
}


@dataclass(frozen=True)
class Source:
    """A registered collection; what is not registered is not read."""

    key: str
    path: str
    book: str
    dynasty: str = ""
    parser: str = "standard"
    over: dict[str, str] = field(default_factory=dict)


#: The collections that are known, by key, place under the corpus folder, book, era and parser.
COLLECTIONS = (
    Source("SHIJING", "shijing/shijing.json", "诗经", "先秦", "odes"),
    Source("CHUCI", "chuci/chuci.json", "楚辞", "先秦", "songs_of_chu"),
    Source("CAOCAO", "caocao/caocao.json", "曹操诗集", "汉魏", over={"author": "曹操", "genre": "乐府"}),
    Source("TANG300", "tang300/tang300.json", "唐诗三百首", "唐"),
    Source("QIANJIA", "qianjiashi/qianjiashi.json", "千家诗", "", "nested_sections"),
    Source("SHUIMO", "shuimo/shuimotangshi.json", "水墨唐诗", "唐"),
    Source("QTS", "quantangshi/poet.tang.*.json", "全唐诗（抽样）", "唐"),
    Source("HUAJIAN", "wudai/huajianji-*.json", "花间集", "五代"),
    Source("NANTANG", "wudai/nantang.json", "南唐二主词", "五代"),
    Source("QSS", "quansongshi/poet.song.*.json", "全宋诗（抽样）", "宋"),
    Source("SONGCI300", "songci300/songci300.json", "宋词三百首", "宋"),
    Source("SONGCI", "songci/ci.song.*.json", "全宋词（抽样）", "宋"),
    Source("YUANQU", "yuanqu/yuanqu.json", "元曲", "元", "arias", {"genre": "曲"}),
    Source("NALAN", "nalan/nalan.json", "纳兰词", "清", "titled_by_tune", {"genre": "词"}),
)


def known_sources(folder: str, *keys: str) -> list[Source]:
    """The collections with these keys (all without any) under a folder; an unknown key is an error, never a guess."""
    by_key = {s.key: s for s in COLLECTIONS}
    if unknown := [k for k in keys if k not in by_key]:
        raise ValueError(f"no collection is registered as {', '.join(unknown)}")
    return [replace(by_key[k], path=f"{folder}/{by_key[k].path}") for k in keys or by_key]


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """The works of a collection with file and position; a file is one JSON array and one task."""
    if source.parser not in PARSERS:
        raise ValueError(f"no parser is registered as {source.parser}")
    schema, parse = PARSERS[source.parser]
    raw = spark.read.schema(schema).option("multiLine", True).json(source.path)
    raw = raw.select("*", F.col("_metadata.file_name").alias("_file")).withColumn("_pos", F.monotonically_increasing_id())
    out = parse(raw)
    fixed = {"dynasty": source.dynasty, **source.over}
    for name, value in fixed.items():
        if value:
            out = out.withColumn(name, F.when(F.col(name) == "", F.lit(value)).otherwise(F.col(name)) if name == "dynasty" else F.lit(value))
    return out.withColumn("source", F.lit(source.key)).withColumn("book", F.lit(source.book))


def natural_key(name: Column) -> Column:
    """A sort key with numbers padded, so that part 10 follows part 9."""
    pieces = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 12, "0")).otherwise(p)), "")


def read_corpus(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All works with ord (from 0) by source, then file in natural order, then position in the file, and poem_id.

    Counts per file are summed on the driver's side of the registry (one row a file); within a file ranks are windows of that
    file, so no window spans the corpus.
    """
    frames = [read_source(spark, s).withColumn("_source_no", F.lit(k)) for k, s in enumerate(sources)]
    works = frames[0]
    for f in frames[1:]:
        works = works.unionByName(f)
    works = works.withColumn("_key", natural_key(F.col("_file")))
    files = works.groupBy("_source_no", "_key").agg(F.count(F.lit(1)).alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = files.withColumns({"_before": so_far(Window.orderBy("_source_no", "_key")), "_of_source": so_far(Window.partitionBy("_source_no").orderBy("_key"))})
    ranked = works.withColumn("_rank", F.row_number().over(Window.partitionBy("_source_no", "_key").orderBy("_pos")) - 1)
    placed = ranked.join(before.select("_source_no", "_key", "_before", "_of_source"), ["_source_no", "_key"])
    ordered = placed.withColumn("ord", (F.col("_before") + F.col("_rank")).cast("long"))
    named = ordered.withColumn("poem_id", F.format_string("CNP_%s_%05d", F.upper("source"), F.col("_of_source") + F.col("_rank") + 1))
    return named.drop("_source_no", "_key", "_before", "_of_source", "_rank", "_pos", "_file")


def read_lines(spark: SparkSession, path: str, schema: T.StructType, malformed: Observation | None = None) -> DataFrame:
    """JSON lines with a declared schema; malformed lines are left out. An observation that is given has their number (malformed)
    and that of all lines (n), counted in the pass that reads the frame."""
    whole = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    told = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"}).alias("r")).select("r.*")
    if malformed is not None:
        told = told.observe(malformed, F.count(F.lit(1)).alias("n"), F.count("_malformed").alias("malformed"))
    return told.where(F.col("_malformed").isNull()).drop("_malformed")


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, a file a partition; null fields are written too, so that every line has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


class _Sha256:
    """SHA-256 whose state is bytes, so that one task goes on where another has stopped; hashlib's objects keep theirs. The functions are
    those of the libcrypto that hashlib itself uses."""

    def __init__(self, state: bytes | None = None):
        self._lib = ctypes.CDLL(_hashlib.__file__)
        self._state = ctypes.create_string_buffer(state or bytes(112), 112)  # the size of SHA256_CTX
        if state is None:
            self._lib.SHA256_Init(self._state)

    def update(self, data: bytes) -> _Sha256:
        self._lib.SHA256_Update(self._state, data, ctypes.c_size_t(len(data)))
        return self

    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, ctypes.create_string_buffer(self._state.raw, 112))
        return out.raw.hex()


def _hashed(states: dict[str, tuple[bytes, bool]]):
    """path and state after the rows (path, line), which come in order; a line end stands between two lines of a file."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = sha = begun = None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sha.state()], pa.binary())], ["path", "state"])
        for batch in batches:
            for name, rows in groupby(zip(batch.column("path").to_pylist(), batch.column("line").to_pylist()), lambda r: r[0]):
                if name != path:
                    if sha:
                        yield row()
                    path, (state, begun) = name, states[name]
                    sha = _Sha256(state)
                sha.update((b"\n" if begun else b"") + b"\n".join(line for _, line in rows))
                begun = True
        if sha:
            yield row()

    return of


def _long_digests(spark: SparkSession, long: DataFrame, most: int) -> DataFrame:
    """path and sha256 of long files (path, length, block, at, line): their bytes, cut at line ends by Spark's own reader, are stored once
    and hashed in rounds of about `most` bytes a file. A round's tasks go on from the state of the one before, a row a file."""
    folder = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    pieces = long.withColumns({"round": F.floor(F.col("block") / most), "n": F.octet_length("line") + 1})
    pieces.write.partitionBy("round").parquet(folder)
    stored = spark.read.schema(pieces.schema).parquet(folder)
    files = stored.groupBy("path", "length").agg(F.sum("n").alias("n"), F.max("round").alias("last")).collect()
    states, ends = {}, {}
    for f in files:  # the reader drops a byte order mark, and does not say whether a line end is last
        mark = f["n"] < f["length"]
        ends[f["path"]] = f["n"] + 3 * mark == f["length"]
        if not ends[f["path"]] and f["n"] + 3 * mark != f["length"] + 1:
            raise ValueError(f"{f['path']} changed while it was read")
        states[f["path"]] = (_Sha256().update(b"\xef\xbb\xbf" if mark else b"").state(), False)
    for k in range(1 + max((f["last"] for f in files), default=-1)):
        rows = stored.where(F.col("round") == k).repartition(4 * len(files), "path").sortWithinPartitions("path", "block", "at").select("path", "line")
        states |= {r["path"]: (bytes(r["state"]), True) for r in rows.mapInArrow(_hashed(states), "path string, state binary").collect()}
    told = [(p, _Sha256(s).update(b"\n" if ends[p] else b"").hexdigest()) for p, (s, _) in states.items()]
    return spark.createDataFrame(told, "path string, sha256 string")


MOST = 1 << 29  # bytes of a file that one task reads
PACKED = r"\.(gz|bz2|lz4|snappy|deflate|zst)$"  # names of files that Spark's reader of lines unpacks


def manifest(spark: SparkSession, path: str, names: str = "*", most: int = MOST) -> DataFrame:
    """file, sha256 and n_bytes of each file under a path, and under its folders, whose name fits. A file over `most` bytes is hashed
    in pieces, by one task after the other, unless its name is that of a packed one: those are one piece, of 2 GB at most. Spark lists no
    file without a byte."""
    reader = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True)
    told, long = F.col("_metadata"), (F.col("_metadata.file_size") > most) & ~F.col("_metadata.file_name").rlike(PACKED)
    whole = reader.format("binaryFile").load(path)
    short = whole.where(~long).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))
    listed = whole.where(long).select(told["file_path"].alias("path"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"))
    if listed.isEmpty():
        return short
    lines = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).option("lineSep", "\n").text(path).where(long)
    rows = lines.select(
        told["file_path"].alias("path"), told["file_size"].alias("length"), told["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line")
    )
    return short.unionByName(listed.join(_long_digests(spark, rows, most), "path").select("file", "sha256", "n_bytes"))


def _hadoop(spark: SparkSession, path: str):
    """A path and its file system, as Spark's own writers see them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_atomically(df: DataFrame, path: str) -> dict[str, int]:
    """Parquet at `path`, which changes from the old to the new in one renaming: a reader never meets half a manifest.

    The number of rows and an order-free checksum of them are observed while they are written, stored beside them before the
    renaming, and returned.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    seen = Observation()
    row = F.xxhash64(F.to_json(F.struct("*")))
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("checksum")).write.parquet(fresh)
    told = {k: int(v) for k, v in seen.get.items()}
    place, files = _hadoop(spark, path)
    out = files.create(_hadoop(spark, f"{fresh}/{COUNTS}")[0], True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    had = files.exists(place)
    if had:
        files.rename(place, _hadoop(spark, old)[0])
    if not files.rename(_hadoop(spark, fresh)[0], place):
        if had:
            files.rename(_hadoop(spark, old)[0], place)
        raise OSError(f"{path} could not be replaced")
    if had:
        files.delete(_hadoop(spark, old)[0], True)
    return told


def counts_of(spark: SparkSession, path: str) -> dict[str, int] | None:
    """Rows and checksum that were committed with an asset; None where there is no such asset. No row is read."""
    place, files = _hadoop(spark, f"{path}/{COUNTS}")
    if not files.exists(place):
        return None
    source = files.open(place)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    finally:
        source.close()


def write_assets(assets: dict[str, DataFrame], folder: str) -> dict[str, dict[str, int]]:
    """Each named table under a folder of its own; and what was observed of it."""
    return {name: replace_atomically(df, f"{folder}/{name}") for name, df in assets.items()}


def ready(spark: SparkSession, folder: str, expected: dict[str, int]) -> DataFrame:
    """asset, ok, n: whether each asset of a folder has as many rows as expected (at least one where that is negative), by the counts
    that were committed with it; n is -1 where there is none."""
    rows = []
    for name, n in expected.items():
        told = counts_of(spark, f"{folder}/{name}")
        found = -1 if told is None else told["n"]
        rows.append((name, found == n if n >= 0 else found > 0, found))
    return spark.createDataFrame(rows, "asset string, ok boolean, n long")


WORKS = T.StructType([T.StructField(c, T.StringType()) for c in ("poem_id", "source", "book", "dynasty", "author", "title", "cipai", "genre", "section", "appreciation")] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("paragraphs", "notes", "tags")])


def load_works(spark: SparkSession, path: str) -> DataFrame:
    """The stored works with their declared schema."""
    return spark.read.schema(WORKS).parquet(path)
