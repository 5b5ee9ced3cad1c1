"""BM25 retrieval over a long-format index."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import TextProfile, fold, n_tokens, tokens
from .stage import once

K1, B = 1.5, 0.75  # fixed values of the ranking function


@dataclass(frozen=True)
class TextIndex:
    """postings (term, doc_id, tf), lengths (doc_id, dl), and the two corpus constants."""

    postings: DataFrame
    lengths: DataFrame
    n_docs: int
    avg_length: float


def build_index(docs: DataFrame, text: Column, profile: TextProfile) -> TextIndex:
    """Tokens are counted where they lie before the (doc_id, term) shuffle; the constants are one row."""
    split = docs.select("doc_id", tokens(text, profile).alias("tokens"))
    lengths = once(docs.select("doc_id", (F.size(tokens(text, profile)).cast("long") if profile.bigrams else n_tokens(text, profile)).alias("dl")))
    postings = split.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    one = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("a")).first()
    return TextIndex(postings, lengths, one["n"], one["a"] or 1.0)


def index_terms(docs: DataFrame, text: Column, profile: TextProfile, terms: list[str]) -> TextIndex:
    """The same with the postings of some terms only, for a single query: one pass over the texts, which extracts just these
    words and counts the others, and leaves a narrow row a document that everything after it reads."""
    wanted = "|".join(sorted({re.escape(t) for t in terms}, key=lambda t: (-len(t), t)))
    edge = profile.token.removesuffix("+")
    folded = fold(text, profile)
    found = F.regexp_extract_all(folded, F.lit(f"(?<!{edge})(?:{wanted})(?!{edge})"), F.lit(0))
    counted = once(docs.select("doc_id", n_tokens(text, profile).alias("dl"), found.alias("found")))
    postings = counted.select("doc_id", F.explode("found").alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    one = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("a")).first()
    return TextIndex(postings, counted.select("doc_id", "dl"), one["n"], one["a"] or 1.0)


def _weight(index: TextIndex) -> Column:
    idf = F.log(1 + (index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / index.avg_length))


def score(index: TextIndex, terms: list[str]) -> DataFrame:
    """doc_id and unrounded score of every document with a query term; terms are a set."""
    hit = index.postings.where(F.col("term").isin(sorted(set(terms))))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return hit.join(F.broadcast(df), "term").join(index.lengths, "doc_id").groupBy("doc_id").agg(F.sum(_weight(index)).alias("score"))


def search(index: TextIndex, terms: list[str], k: int) -> DataFrame:
    """doc_id, score (rounded after ranking), rank: best first, then least doc_id."""
    top = score(index, terms).orderBy(F.desc("score"), "doc_id").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("long"))  # at most k rows
    return ranked.select("doc_id", F.round("score", 4).alias("score"), "rank")


def search_many(index: TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """The same for a table of queries (query_id, term): one pass over the index for all of them."""
    asked = queries.select("query_id", "term").distinct()
    hit = asked.join(index.postings, "term")
    df = index.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hit.join(df, "term").join(index.lengths, "doc_id").groupBy("query_id", "doc_id").agg(F.sum(_weight(index)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
