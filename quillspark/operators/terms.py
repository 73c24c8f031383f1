"""From documents to term counts: normalise, tokenise, drop stop-words, count."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions.text import WS, english_tokens, normalize
from quillspark.storage import spread

Tokenizer = Callable[[Column], Column]
TOKENIZERS: dict[str, Tokenizer] = {"english": english_tokens}


def tokenizer(name: str | Tokenizer) -> Tokenizer:
    """A tokenizer by name, or any function from a text column to an array of strings."""
    if callable(name):
        return name
    if name not in TOKENIZERS:
        raise EngineError("pipeline.tokenizer", f"unknown tokenizer {name!r}")
    return TOKENIZERS[name]


def checked_tokens(found: Column) -> Column:
    """Tokens of a foreign tokenizer: an empty one, or one with white space or NUL, fails the job with ``frequency.token``."""
    bad = F.exists(found, lambda t: t.isNull() | (t == "") | t.contains("\0") | t.rlike(WS))
    return F.when(bad, F.raise_error(F.lit("frequency.token: a token is empty or holds white space or NUL"))).otherwise(found)


def tokens(docs: DataFrame, tok: str | Tokenizer = "english", stop_words: Iterable[str] = (), keys: tuple[str, ...] = ("doc_id",), text: str = "content") -> DataFrame:
    """(keys, terms array<string>): the tokens of the normalised text in order, without stop-words (exact matches)."""
    found = tokenizer(tok)(normalize(F.coalesce(F.col(text), F.lit(""))))
    found = checked_tokens(found) if callable(tok) else found
    stop = sorted(set(stop_words))
    if stop:
        found = F.filter(found, lambda t: ~t.isin(stop))
    return spread(docs.select(*keys, text)).select(*keys, found.alias("terms"))


def term_frequency(docs: DataFrame, tok: str | Tokenizer = "english", stop_words: Iterable[str] = (), keys: tuple[str, ...] = ("doc_id",), text: str = "content") -> DataFrame:
    """(keys, term, tf long). Documents without terms have no rows."""
    flat = tokens(docs, tok, stop_words, keys, text).select(*keys, F.explode("terms").alias("term"))
    return flat.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df long)."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def recommendation_frequency(tf: DataFrame) -> DataFrame:
    """(term, frequency long): occurrences over all documents, duplicates included."""
    return tf.groupBy("term").agg(F.sum("tf").alias("frequency"))


def merged_frequency(current: DataFrame, more: DataFrame) -> DataFrame:
    """Two tables of (term, frequency) as one: a batch of new documents added to what was counted before. Neither is changed."""
    return current.select("term", "frequency").unionByName(more.select("term", "frequency")).groupBy("term").agg(F.sum("frequency").alias("frequency"))
