"""The inverted index as relations: lexicon, postings, document and corpus statistics, smoothed TF-IDF weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.order import number_in_order
from quillspark.operators.terms import document_frequency, term_frequency
from quillspark.storage import at_most, written


@dataclass(frozen=True)
class Index:
    """``lexicon`` (term_id, term, df, idf), ``postings`` (term_id, doc_id, tf, weight), ``doc_stats`` (doc_id, total_tokens, distinct_terms, norm), and the number of documents."""

    lexicon: DataFrame
    postings: DataFrame
    doc_stats: DataFrame
    n_docs: int


def idf(n_docs: int | F.Column, df: F.Column) -> F.Column:
    """1 + ln((N + 1) / (df + 1))."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return 1.0 + F.log1p((n - df) / (df + 1.0))


def lexicon(tf: DataFrame) -> DataFrame:
    """(term, term_id): the rank of each term in byte order."""
    return number_in_order(tf.select("term").distinct(), "term", "term_id").select("term", "term_id")


def document_statistics(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """(doc_id, total_tokens, distinct_terms); documents without terms have zeros."""
    sums = tf.groupBy("doc_id").agg(F.sum("tf").alias("total_tokens"), F.count("*").alias("distinct_terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", zero("total_tokens"), zero("distinct_terms"))


def statistics_in_place(tokens: DataFrame) -> DataFrame:
    """The same from documents' tokens (doc_id, terms), each counted where it lies, without a shuffle."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return tokens.select("doc_id", size("terms").alias("total_tokens"), size(F.array_distinct("terms")).alias("distinct_terms"))


def corpus_statistics(stats: DataFrame) -> DataFrame:
    """One row: documents, total_tokens, postings."""
    return stats.agg(F.count("*").alias("documents"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("distinct_terms"), F.lit(0)).alias("postings"))


def posting_lists(tf: DataFrame) -> DataFrame:
    """(term, postings array<struct<doc_id, tf>>), ascending by doc_id. A whole list is one row: for frequent terms see ``posting_blocks``."""
    return tf.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def posting_blocks(tf: DataFrame, size: int = 4096) -> DataFrame:
    """(term, block, postings): the lists in blocks of ``size`` ids, so that no row holds more than that, however frequent a term is."""
    return tf.groupBy("term", F.floor(F.col("doc_id") / F.lit(size)).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def term_bytes(tf: DataFrame) -> DataFrame:
    """One row: distinct_terms, vocabulary_bytes, longest_term (bytes), postings and the longest list, as limits are checked against."""
    each = tf.groupBy("term").agg(F.count("*").alias("n")).select(F.octet_length("term").cast("long").alias("b"), "n")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return each.agg(F.count("*").alias("distinct_terms"), zero(F.sum("b"), "vocabulary_bytes"), zero(F.max("b"), "longest_term"), zero(F.sum("n"), "postings"), zero(F.max("n"), "longest_list"))


def valid_postings(postings: DataFrame) -> DataFrame:
    """(term_id, ok): doc_ids strictly increase in each list and counts are positive."""
    last = F.lag("doc_id").over(Window.partitionBy("term_id").orderBy("doc_id"))
    return postings.select("term_id", ((F.col("tf") > 0) & (last.isNull() | (F.col("doc_id") > last))).alias("good")).groupBy("term_id").agg(F.bool_and("good").alias("ok"))


#: A table of document frequencies with at most so many terms is broadcast.
BROADCAST_TERMS = 1_000_000


def weighted(tf: DataFrame, n_docs: int, counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, df, idf, w) with w = tf * idf. ``counts`` (term, df) may be given, and is then broadcast if it is small."""
    if counts is None:
        counts = document_frequency(tf)
    elif at_most(counts, BROADCAST_TERMS):
        counts = F.broadcast(counts)
    return tf.join(counts, "term").withColumn("idf", idf(n_docs, F.col("df"))).withColumn("w", F.col("tf") * F.col("idf"))


def norms(w: DataFrame, exact: bool = False) -> DataFrame:
    """(doc_id, norm): Euclidean length of a document's weights; ``exact`` folds them in the order of terms, so that the last bit is fixed."""
    if exact:
        ordered = F.array_sort(F.collect_list(F.struct("term", "w")))
        return w.groupBy("doc_id").agg(F.aggregate(ordered, F.lit(0.0), lambda a, x: F.hypot(a, x["w"])).alias("norm"))
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def build_index(docs: DataFrame, tok: str = "english", stop_words: tuple[str, ...] = (), text: str = "content", exact: bool = False) -> Index:
    """The index over ``docs`` (doc_id, text); documents without terms count in N.

    Documents are tokenised once: the term counts are written to the shared folder, and so is the lexicon.
    """
    spark = docs.sparkSession
    tf = written(spark, term_frequency(docs, tok, stop_words, ("doc_id",), text))
    n = docs.count()
    counts = written(spark, document_frequency(tf))
    w = weighted(tf, n, counts)
    length = norms(w, exact)
    lex = written(spark, number_in_order(counts, "term", "term_id").select("term_id", "term", "df", idf(n, F.col("df")).alias("idf")))
    ids = F.broadcast(lex.select("term_id", "term")) if at_most(lex, BROADCAST_TERMS) else lex.select("term_id", "term")
    posts = w.join(length, "doc_id").join(ids, "term").select("term_id", "term", "doc_id", "tf", (F.col("w") / F.col("norm")).alias("weight"))
    stats = document_statistics(docs, tf).join(length, "doc_id", "left").withColumn("norm", F.coalesce("norm", F.lit(0.0)))
    return Index(lex, posts, stats, n)


def weight_of(index: Index, term: str, doc_id: int) -> float | None:
    """The weight of a term in a document; none if the term is unknown or isn't in it."""
    ids = index.lexicon.where(F.col("term") == term).select("term_id")
    row = index.postings.select("term_id", "doc_id", "weight").where(F.col("doc_id") == doc_id).join(F.broadcast(ids), "term_id").first()
    return row["weight"] if row else None


def idf_of(index: Index, term: str) -> float | None:
    """A term's inverse document frequency; none if it is unknown."""
    row = index.lexicon.where(F.col("term") == term).select("idf").first()
    return row["idf"] if row else None


def norm_of(index: Index, doc_id: int) -> float | None:
    """A document's norm: 0 without terms, none if it is unknown."""
    row = index.doc_stats.where(F.col("doc_id") == doc_id).select("norm").first()
    return row["norm"] if row else None
