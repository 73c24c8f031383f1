"""Limits that fail a whole operation, never shorten it, and the admission of read items."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.errors import EngineError
from quillspark.functions.text import is_relative_path
from quillspark.operators.index import term_bytes
from quillspark.operators.order import sums_before

STATUSES = ("success", "warning", "no_text", "rejected", "failed")


@dataclass(frozen=True)
class Limits:
    """Inclusive limits; None is none. ``PROFILE_1`` has the limits of the small in-memory engine."""

    file_bytes: int | None = None
    total_bytes: int | None = None
    records: int | None = None
    text_bytes: int | None = None
    comparisons: int | None = None
    document_tokens: int | None = None
    token_bytes: int | None = None
    input_terms: int | None = None
    distinct_terms: int | None = None
    vocabulary_bytes: int | None = None
    total_tokens: int | None = None
    postings: int | None = None
    postings_per_term: int | None = None

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and value < 1:
                raise EngineError("limits.value", f"{f.name} must be positive")


#: The limits of profile 1.
PROFILE_1 = Limits(
    file_bytes=16 << 20, total_bytes=128 << 20, records=10_000, text_bytes=128 << 20, comparisons=50_000_000, document_tokens=1_000_000,
    token_bytes=4096, input_terms=10_000_000, distinct_terms=1_000_000, total_tokens=100_000_000, postings=10_000_000,
)


def within(value: int | None, limit: int | None, context: str) -> None:
    """Fails with ``context`` if the value is above the limit."""
    if limit is not None and (value or 0) > limit:
        raise EngineError(context, f"{value} is above the limit of {limit}")


def check_files(files: DataFrame, limits: Limits) -> None:
    """Input files (input_path, bytes): relative paths, each once, and their sizes. The first fault in this order is raised."""
    size = F.octet_length("bytes").cast("long")
    row = files.agg(F.coalesce(F.sum((~is_relative_path("input_path")).cast("int")), F.lit(0)).alias("bad"), F.max(size).alias("largest"), F.sum(size).alias("total")).first()
    if row["bad"]:
        raise EngineError("reader.path", "a path isn't a relative one")
    if not files.groupBy("input_path").count().where("count > 1").isEmpty():
        raise EngineError("reader.duplicate_path", "a path occurs twice")
    within(row["largest"], limits.file_bytes, "reader.file_bytes")
    within(row["total"], limits.total_bytes, "reader.total_bytes")


def _text_bytes(record: str = "record") -> Column:
    return F.coalesce(F.octet_length(f"{record}.title"), F.lit(0)).cast("long") + F.coalesce(F.octet_length(f"{record}.content"), F.lit(0))


def admit_items(items: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Read items with ``accepted``, ``fault`` and ``text_before``: what a collector that takes them in source order accepts.

    Faults, the first that holds: ``item.status`` (unknown), ``item.payload`` (a record where the status has none, or none where it has one),
    ``item.issues`` (a success with issues, or another status without any), ``item.ordinal`` (not above the one before in its file), and, over the
    accepted items before, ``item.records`` and ``item.text_bytes``. ``text_before`` is the text that the well-formed items before hold.
    """
    limits = limits or Limits()
    delivered = F.col("status").isin("success", "warning")
    issues = F.coalesce(F.size("issues"), F.lit(0))
    last = F.lag("record_ordinal").over(Window.partitionBy("input_path").orderBy("record_ordinal", "_place"))
    numbered = items.withColumn("_place", F.monotonically_increasing_id())
    form = (
        F.when(~F.col("status").isin(*STATUSES), "item.status").when(F.col("record").isNotNull() != delivered, "item.payload")
        .when((F.col("status") == "success") != (issues == 0), "item.issues").when((F.col("record_ordinal") < 0) | (F.col("record_ordinal") <= F.col("_last")), "item.ordinal")
    )
    formed = numbered.withColumn("_last", F.coalesce(last, F.lit(-1).cast("long"))).withColumn("fault", form)
    good = F.col("fault").isNull() & delivered
    keys = ["input_path", "record_ordinal", "_place"]
    summed = sums_before(formed, keys, F.when(good, _text_bytes()).otherwise(0), "text_before")
    if limits.records is not None:
        summed = sums_before(summed, keys, F.when(good, 1).otherwise(0), "_records")
        summed = summed.withColumn("fault", F.when(good & (F.col("_records") >= limits.records), "item.records").otherwise(F.col("fault")))
    if limits.text_bytes is not None:
        over = good & (F.col("text_before") + _text_bytes() > limits.text_bytes)
        summed = summed.withColumn("fault", F.when(over & F.col("fault").isNull(), "item.text_bytes").otherwise(F.col("fault")))
    return summed.withColumn("accepted", F.col("fault").isNull()).select(*items.columns, "accepted", "fault", "text_before")


def check_terms(tf: DataFrame, limits: Limits) -> None:
    """Term counts (doc_id, term, tf): tokens of a document and in all, terms, their bytes and their postings."""
    each = tf.groupBy("doc_id").agg(F.sum("tf").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    row = term_bytes(tf).first()
    within(each["most"], limits.document_tokens, "index.document_tokens")
    within(each["all"], limits.total_tokens, "index.total_tokens")
    within(row["longest_term"], limits.token_bytes, "lexicon.term_bytes")
    within(row["postings"], limits.input_terms, "lexicon.input_terms")
    within(row["distinct_terms"], limits.distinct_terms, "lexicon.distinct_terms")
    within(row["vocabulary_bytes"], limits.vocabulary_bytes, "lexicon.vocabulary_bytes")
    within(row["postings"], limits.postings, "weights.postings")
    within(row["longest_list"], limits.postings_per_term, "index.postings_per_term")
