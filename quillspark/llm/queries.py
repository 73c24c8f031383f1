"""The operators of this subpackage as driver queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import score_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, _table(spark, sf_dir, "labels"), threshold=0.3).drop("text")


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.repetition import repetition_rules

    # Half of the words, the default, is a limit that the base rule implies.
    return repetition_rules(_table(spark, sf_dir, "documents"), covered=0.2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack, tokenizer_spec

    return pack(_table(spark, sf_dir, "documents"), tokenizer_spec("word_bpe_49k.json"), size=4096, end_id=1)


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.licences import scan_licences

    return scan_licences(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), power=0.5, keep=0.7).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.substrings import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.imatch import edited_fingerprints

    return edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.preference import format_preferences, preference_pairs

    return format_preferences(preference_pairs(_table(spark, sf_dir, "conversations")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")


def queries() -> dict[str, Query]:
    return {
        "op1_neardup": op1_neardup,
        "op2_quality": op2_quality,
        "op3_repetition": op3_repetition,
        "op4_packing": op4_packing,
        "op5_licences": op5_licences,
        "op6_mixing": op6_mixing,
        "op7_substrings": op7_substrings,
        "op8_imatch": op8_imatch,
        "op9_preference": op9_preference,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    from quillspark.llm.preference import PREFERENCE_SQL

    return {"op9_preference": PREFERENCE_SQL}
