"""From raw documents to packed training sequences: filter, deduplicate, sanitise, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``. Nulls, empty texts, repeated rows and extra columns are handled as the operators'
docstrings say; rows without a doc_id pass the deduplication, as nothing tells them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._space import Space
from quillspark.llm.mixing import mix_sources
from quillspark.llm.neardup import near_duplicates
from quillspark.llm.packing import pack, tokenizer_spec
from quillspark.llm.pii import personal_data
from quillspark.llm.quality import score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs.select(*COLUMNS), labels).where("predicted = 1").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more), and one row of each doc_id."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs, words=5, percent=80).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id"))
    ids = kept.groupBy("_id").agg(F.count("*").alias("_rows"))
    met = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("_id"))
    repeated = met.where("_rows > 1").select(*COLUMNS).groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return met.where("_rows = 1").select(*COLUMNS).unionByName(repeated).unionByName(docs.where("doc_id is null"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced in their texts."""
    found = personal_data(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.char_length("clean_text").cast("long")).select("doc_id", F.col("clean_text").alias("text"), "lang", "source", "n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet smoothed shares of sources, languages and topics."""
    return mix_sources(docs.select(*COLUMNS)).where("selected").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document."""
    return pack(docs.select("doc_id", "text"), tokenizer_spec("word_bpe_49k.json"), size=4096, end_id=1)


STAGES = [("quality", quality), ("near-dedup", deduplicate), ("pii", sanitise), ("mixing", mix), ("packing", packed)]

#: SQL can't express the classifier or the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``; what lies between them is written to the shared folder."""
    space = Space(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = space.save(docs, f"{k}-{name}")
    return docs
