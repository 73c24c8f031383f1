"""Queries over the driver tables, one for each operator, and their DuckDB twins.

``documents`` is the corpus (path = source, ordinal = doc_id), ``benchmark`` and the users' turns of ``conversations`` are query batches, ``events`` stands in
for a request log (user = connection, event type = request kind, value = milliseconds), ``pages`` holds HTML. Scores and weights are rounded on both
sides; ties go by the rounded score, then doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import limits, service
from quillspark.errors import EngineError
from quillspark.functions import text as X
from quillspark.operators import display, fingerprints, index, search, suggest, terms
from quillspark.sources import files, html
from quillspark.storage import written
from quillspark.streaming import requests as R

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

STOP = ("the", "of", "and", "a", "to", "in", "is", "on", "la", "de")
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_TOK = f"tok AS (SELECT doc_id, unnest(regexp_extract_all({_FOLD.format('text')}, '[A-Za-z0-9]+')) AS term FROM documents)"
_TF = _TOK + ", tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term)"
_W = _TF + """, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT term, count(*) AS df, 1 + ln(1 + (any_value(n) - count(*)) / (count(*) + 1.0)) AS idf FROM tf, n GROUP BY term),
w AS (SELECT doc_id, term, tf, df, idf, tf * idf AS w FROM tf JOIN d USING (term)), l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
p AS (SELECT doc_id, term, tf, idf, w / norm AS weight FROM w JOIN l USING (doc_id))"""


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("content"), F.col("source").alias("input_path"))


def _tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(_docs(spark, sf_dir))


def _weighted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    w = index.weighted(terms.term_frequency(docs), docs.count())
    return w, index.norms(w)


_BUILT: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    """What is built once for a table and then asked many times, as an index is: its tables lie in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _index(spark: SparkSession, sf_dir: str) -> index.Index:
    def make() -> index.Index:
        built = index.build_index(_docs(spark, sf_dir))
        # Postings lie in order of terms, so that a lookup of a few terms reads a few row groups.
        kept = lambda df, by: written(spark, df.repartitionByRange(by).sortWithinPartitions(by))
        return index.Index(kept(built.lexicon, "term"), kept(built.postings, "term_id"), written(spark, built.doc_stats), built.n_docs)

    return _once(spark, sf_dir, "index", make)


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "dictionary", lambda: written(spark, suggest.dictionary(terms.recommendation_frequency(_tf(spark, sf_dir)))))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


FIXED = [(1, "the lantern of the road"), (2, "THE thing in that"), (3, "est pas la"), (4, "zzzunknownzzz the"), (5, "!!!")]
_FIXED_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in FIXED) + ") AS v(query_id, text))"


def _fixed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED, "query_id long, text string")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


def _search_sql(source: str, mode: str, k: int) -> str:
    # Sums are rounded before they are compared: their order isn't fixed in either engine.
    have = "HAVING count(*) = any_value(n_terms)" if mode == "and" else ""
    return f"""WITH {_W}, {source},
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all({_FOLD.format('text')}, '[A-Za-z0-9]+')) AS term FROM q) GROUP BY ALL),
qn AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id), kn AS (SELECT qt.*, d.idf, n_terms FROM qt JOIN d USING (term) JOIN qn USING (query_id)),
ql AS (SELECT query_id, sqrt(sum(qtf * idf * qtf * idf)) AS qnorm FROM kn GROUP BY query_id),
s AS (SELECT query_id, doc_id, round(least(1.0, sum(qtf * kn.idf / qnorm * weight)), 9) AS score FROM kn JOIN ql USING (query_id) JOIN p USING (term) GROUP BY query_id, doc_id {have})
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""


def _search(spark: SparkSession, sf_dir: str, queries: DataFrame, mode: str, k: int) -> DataFrame:
    return search.search(_index(spark, sf_dir), queries, mode, k, digits=9)


# --- text ---

@_register("normalize_text", rf"SELECT doc_id, md5(t) AS digest, length(t) AS n_chars FROM (SELECT doc_id, regexp_replace(regexp_replace({_FOLD.format('text')}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g') AS t FROM documents)")
def normalize_text(spark, sf_dir):
    t = X.normalize("content")
    return _docs(spark, sf_dir).select("doc_id", F.md5(t).alias("digest"), X.code_points(t).alias("n_chars"))


@_register("english_tokens", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all({_FOLD.format('text')}, '[A-Za-z0-9]+') AS t FROM documents)")
def english_tokens(spark, sf_dir):
    return terms.tokens(_docs(spark, sf_dir)).select("doc_id", F.size("terms").cast("long").alias("n_tokens"), F.md5(F.array_join("terms", " ")).alias("digest"))


@_register("utf8_lengths", "SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents")
def utf8_lengths(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.code_points("content").alias("n_chars"), X.utf8_bytes("content").alias("n_bytes"))


@_register("html_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM documents")
def html_escape(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.escape_html("content")).alias("digest"))


@_register("txt_read", rf"""SELECT doc_id, CASE WHEN regexp_replace(b, '{_WS}', '', 'g') = '' THEN 'no_text' ELSE 'warning' END AS status, CASE WHEN regexp_replace(b, '{_WS}', '', 'g') = '' THEN NULL ELSE md5(b) END AS digest,
CASE WHEN regexp_replace(b, '{_WS}', '', 'g') = '' THEN NULL ELSE 'f' || doc_id::VARCHAR END AS title FROM (SELECT doc_id, regexp_replace(chr(13) || text, '\r\n?', chr(10), 'g') AS b FROM documents)""")
def txt_read(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    raw = docs.select("doc_id", F.concat(F.lit("a/f"), "doc_id", F.lit(".txt")).alias("input_path"), F.concat(F.unhex(F.lit("EFBBBF0D")), F.encode("content", "UTF-8")).alias("bytes"))
    items = files.read_text(raw)
    return items.select(F.regexp_extract("input_path", r"f(\d+)\.txt", 1).cast("long").alias("doc_id"), "status", F.md5("record.content").alias("digest"), F.col("record.title").alias("title"))


@_register("read_status_counts", rf"SELECT CASE WHEN regexp_replace(text, '{_WS}', '', 'g') = '' THEN 'no_text' ELSE 'warning' END AS status, count(*) AS items FROM documents GROUP BY 1")
def read_status_counts(spark, sf_dir):
    raw = _docs(spark, sf_dir).select(F.concat("input_path", F.lit("/"), "doc_id").alias("input_path"), F.encode("content", "UTF-8").alias("bytes"))
    return files.read_counts(files.read_text(raw))


@_register("source_ids", "SELECT source AS input_path, doc_id AS record_ordinal, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT source, max(doc_id) AS doc_id, max(doc_id) + 1 AS n FROM documents GROUP BY source)")
def source_ids(spark, sf_dir):
    record = F.struct(*[F.lit("").alias(c) for c in ("title", "content", "kind", "url", "author", "published_at_raw")])
    items = _docs(spark, sf_dir).select("input_path", F.col("doc_id").alias("record_ordinal"), F.lit("success").alias("status"), record.alias("record"))
    ids = files.documents(items).groupBy("input_path").agg(F.max("record_ordinal").alias("record_ordinal"), F.min(F.col("doc_id") - F.col("record_ordinal")).alias("base"))
    return ids.select("input_path", "record_ordinal", "base")


# --- terms and index ---

@_register("term_frequency", f"WITH {_TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(spark, sf_dir):
    return _tf(spark, sf_dir)


@_register("stopword_filtered_tf", f"WITH {_TF} SELECT doc_id, term, tf FROM tf WHERE term NOT IN ({_STOP_SQL})")
def stopword_filtered_tf(spark, sf_dir):
    return terms.term_frequency(_docs(spark, sf_dir), stop_words=STOP)


@_register("document_frequency_idf", f"WITH {_W} SELECT term, df, round(idf, 9) AS idf FROM d")
def document_frequency_idf(spark, sf_dir):
    n = _docs(spark, sf_dir).count()
    return terms.document_frequency(_tf(spark, sf_dir)).withColumn("idf", F.round(index.idf(n, F.col("df")), 9))


@_register("lexicon_ids", f"WITH {_TOK} SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM tok)")
def lexicon_ids(spark, sf_dir):
    return index.lexicon(_tf(spark, sf_dir))


@_register("posting_lists", f"WITH {_TF} SELECT term, count(*) AS df, md5(string_agg(doc_id::VARCHAR || ':' || tf::VARCHAR, ' ' ORDER BY doc_id)) AS digest FROM tf GROUP BY term")
def posting_lists(spark, sf_dir):
    lists = index.posting_lists(_tf(spark, sf_dir))
    return lists.select("term", F.size("postings").cast("long").alias("df"), F.md5(F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ")).alias("digest"))


@_register("document_statistics", f"WITH {_TF} SELECT documents.doc_id, coalesce(sum(tf), 0)::BIGINT AS total_tokens, count(tf) AS distinct_terms FROM documents LEFT JOIN tf USING (doc_id) GROUP BY documents.doc_id")
def document_statistics(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return index.document_statistics(docs, terms.term_frequency(docs))


@_register("corpus_statistics", f"WITH {_TF} SELECT (SELECT count(*) FROM documents) AS documents, sum(tf)::BIGINT AS total_tokens, count(*) AS postings FROM tf")
def corpus_statistics(spark, sf_dir):
    return index.corpus_statistics(document_statistics(spark, sf_dir))


@_register("document_norms", f"WITH {_W} SELECT doc_id, round(norm, 6) AS norm FROM l")
def document_norms(spark, sf_dir):
    return _weighted(spark, sf_dir)[1].withColumn("norm", F.round("norm", 6))


@_register("normalized_weights", f"WITH {_W} SELECT doc_id, term, tf, round(weight, 9) AS weight FROM p")
def normalized_weights(spark, sf_dir):
    w, length = _weighted(spark, sf_dir)
    return w.join(length, "doc_id").select("doc_id", "term", "tf", F.round(F.col("w") / F.col("norm"), 9).alias("weight"))


# --- search ---

def _candidates(spark, sf_dir, mode, queries=None):
    built = _index(spark, sf_dir)
    known = search.known_terms(search.query_terms(_fixed(spark) if queries is None else queries), built.lexicon)
    return search.candidates(known, built.postings, mode)


_QT = f"qt AS (SELECT query_id, term FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all({_FOLD.format('text')}, '[A-Za-z0-9]+')) AS term FROM q))"


@_register("candidates_or", f"WITH {_TF}, {_FIXED_SQL}, {_QT} SELECT DISTINCT query_id, doc_id FROM qt JOIN tf USING (term)")
def candidates_or(spark, sf_dir):
    return _candidates(spark, sf_dir, "or")


@_register("candidates_and", f"WITH {_TF}, {_FIXED_SQL}, {_QT} SELECT query_id, doc_id FROM qt JOIN tf USING (term) GROUP BY query_id, doc_id HAVING count(*) = (SELECT count(*) FROM qt AS x WHERE x.query_id = qt.query_id)")
def candidates_and(spark, sf_dir):
    return _candidates(spark, sf_dir, "and")


@_register("search_or_topk", _search_sql(_FIXED_SQL, "or", 10))
def search_or_topk(spark, sf_dir):
    return _search(spark, sf_dir, _fixed(spark), "or", 10)


@_register("search_and_topk", _search_sql(_FIXED_SQL, "and", 10))
def search_and_topk(spark, sf_dir):
    return _search(spark, sf_dir, _fixed(spark), "and", 10)


@_register("search_batch_topk", _search_sql("q AS (SELECT item_id AS query_id, text FROM benchmark)", "or", 10))
def search_batch_topk(spark, sf_dir):
    return _search(spark, sf_dir, _benchmark(spark, sf_dir), "or", 10)


# The same over a batch that grows with the table: every hundredth document is a query against all of them.

_HUNDREDTH_SQL = "q AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0)"


def _hundredth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("content").alias("text"))


@_register("candidates_or_table", f"WITH {_TF}, {_HUNDREDTH_SQL}, {_QT} SELECT DISTINCT query_id, doc_id FROM qt JOIN tf USING (term)")
def candidates_or_table(spark, sf_dir):
    return _candidates(spark, sf_dir, "or", _hundredth(spark, sf_dir))


@_register("candidates_and_table", f"WITH {_TF}, {_HUNDREDTH_SQL}, {_QT}, n AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id) SELECT query_id, doc_id FROM qt JOIN tf USING (term) JOIN n USING (query_id) GROUP BY query_id, doc_id HAVING count(*) = any_value(n.n)")
def candidates_and_table(spark, sf_dir):
    return _candidates(spark, sf_dir, "and", _hundredth(spark, sf_dir))


@_register("search_or_table_topk", _search_sql(_HUNDREDTH_SQL, "or", 10))
def search_or_table_topk(spark, sf_dir):
    return _search(spark, sf_dir, _hundredth(spark, sf_dir), "or", 10)


@_register("search_and_table_topk", _search_sql(_HUNDREDTH_SQL, "and", 10))
def search_and_table_topk(spark, sf_dir):
    return _search(spark, sf_dir, _hundredth(spark, sf_dir), "and", 10)


_TERMS = ("then", "road", "est")


@_register("summary_window", f"""WITH b AS (SELECT doc_id, text, {_FOLD.format('text')} AS f, length(text) AS n, least(length(text), 60) AS w FROM documents),
h AS (SELECT *, (SELECT min(p) FROM (SELECT unnest([{', '.join(f"instr(f, '{t}')" for t in _TERMS)}]) AS p) WHERE p > 0) AS hit FROM b),
s AS (SELECT *, CASE WHEN hit IS NULL THEN 0 ELSE least(greatest(hit - 1 - 10, 0), n - w) END AS s FROM h)
SELECT doc_id, substr(text, s + 1, w) AS snippet, strlen(substr(text, 1, s)) AS source_byte_offset, hit IS NOT NULL AS matched, s > 0 AS truncated_before, s + w < n AS truncated_after FROM s""")
def summary_window(spark, sf_dir):
    s = display.summary(F.col("content"), F.array(*map(F.lit, _TERMS)), 60, 10)
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.col("s.text").alias("snippet"), "s.source_byte_offset", "s.matched", "s.truncated_before", "s.truncated_after")


@_register("highlight_html", "SELECT doc_id, md5(regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), '(([tT][hH][eE])+)', '<mark>\\1</mark>', 'g')) AS digest FROM documents")
def highlight_html(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(display.highlight("content", F.array(F.lit("the")))["html"]).alias("digest"))


# --- suggestions ---

@_register("recommendation_frequencies", f"WITH {_TOK} SELECT term, count(*) AS frequency FROM tok GROUP BY term")
def recommendation_frequencies(spark, sf_dir):
    return terms.recommendation_frequency(_tf(spark, sf_dir))


@_register("character_index", f"WITH {_TOK}, t AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id FROM (SELECT DISTINCT term FROM tok)), e AS (SELECT DISTINCT unnest(string_split(term, '')) AS cp, term_id FROM t) SELECT cp, count(*) AS terms, min(term_id) AS first_id, max(term_id) AS last_id FROM e GROUP BY cp")
def character_index(spark, sf_dir):
    edges = suggest.character_index(index.lexicon(_tf(spark, sf_dir)))
    return edges.groupBy("cp").agg(F.count("*").alias("terms"), F.min("term_id").alias("first_id"), F.max("term_id").alias("last_id"))


_KEYS = [(1, "lantrn"), (2, "the"), (3, "thng"), (4, "zq9"), (5, "THE")]


@_register("suggest_topk", f"""WITH {_TOK}, t AS (SELECT term, count(*) AS frequency FROM tok GROUP BY term), i AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM t),
k AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{w}')" for i, w in _KEYS)}) AS v(query_id, key)), c AS (SELECT query_id, key, term, term_id, frequency, levenshtein(key, term) AS distance FROM k, i WHERE len(list_intersect(string_split(key, ''), string_split(term, ''))) > 0)
SELECT query_id, rank, term_id, term, distance, frequency FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, frequency DESC, term) AS rank FROM c) WHERE rank <= 10""")
def suggest_topk(spark, sf_dir):
    return suggest.suggest(spark.createDataFrame(_KEYS, "query_id long, key string"), _dictionary(spark, sf_dir), 10)


@_register("suggest_table_topk", f"""WITH {_TOK}, t AS (SELECT term, count(*) AS frequency FROM tok GROUP BY term), i AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id FROM t),
k AS (SELECT term_id AS query_id, term AS key FROM i WHERE term_id % 100 = 0), c AS (SELECT query_id, key, i.term, i.term_id, frequency, levenshtein(key, i.term) AS distance FROM k, i WHERE len(list_intersect(string_split(key, ''), string_split(i.term, ''))) > 0)
SELECT query_id, rank, term_id, term, distance, frequency FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, frequency DESC, term) AS rank FROM c) WHERE rank <= 10""")
def suggest_table_topk(spark, sf_dir):
    words = _dictionary(spark, sf_dir)
    return suggest.suggest(words.where("term_id % 100 = 0").select(F.col("term_id").alias("query_id"), F.col("term").alias("key")), words, 10)


# --- fingerprints ---

_M = "18446744073709551616::UHUGEINT"
_SIM = f"""{_TF}, v AS (SELECT DISTINCT term FROM tf),
h0 AS (SELECT term, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(term, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % {_M}) AS h FROM v),
h1 AS (SELECT term, (xor(h, h >> 33::UHUGEINT) * 18397679294719823053::UHUGEINT) % {_M} AS h FROM h0), h2 AS (SELECT term, (xor(h, h >> 33::UHUGEINT) * 14181476777654086739::UHUGEINT) % {_M} AS h FROM h1),
hh AS (SELECT term, xor(h, h >> 33::UHUGEINT)::UBIGINT AS h FROM h2), bits AS (SELECT doc_id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1::UBIGINT = 1::UBIGINT THEN tf ELSE -tf END) AS s FROM tf JOIN hh USING (term), (SELECT unnest(range(64)) AS i) GROUP BY doc_id, i),
sim AS (SELECT doc_id, bit_or(CASE WHEN s > 0 THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END) AS simhash FROM bits GROUP BY doc_id)"""


def _simhash(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return terms.tokens(docs, keys=("doc_id", "input_path")).select("doc_id", "input_path", fingerprints.simhash_of("terms").alias("simhash"))


@_register("simhash64", f"WITH {_SIM} SELECT doc_id, CASE WHEN simhash IS NULL THEN NULL ELSE lpad(format('{{:x}}', simhash), 16, '0') END AS simhash FROM documents LEFT JOIN sim USING (doc_id)")
def simhash64(spark, sf_dir):
    return _simhash(spark, sf_dir).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@_register("hamming_pairs", f"WITH {_SIM}, u AS (SELECT min(doc_id) AS id, simhash FROM sim GROUP BY simhash) SELECT x.id AS a, y.id AS b, bit_count(xor(x.simhash, y.simhash))::BIGINT AS distance FROM u x JOIN u y ON x.id < y.id AND bit_count(xor(x.simhash, y.simhash)) <= 3")
def hamming_pairs(spark, sf_dir):
    distinct = _simhash(spark, sf_dir).where("simhash is not null").groupBy("simhash").agg(F.min("doc_id").alias("ordinal"))
    return fingerprints.near_pairs(distinct, 3)


@_register("hamming_classes", f"WITH {_SIM}, u AS (SELECT min(doc_id) AS id, simhash FROM sim GROUP BY simhash), n AS (SELECT x.id, count(*) AS links FROM u x JOIN u y ON x.id <> y.id AND bit_count(xor(x.simhash, y.simhash)) <= 3 GROUP BY x.id) SELECT doc_id, u.id AS representative, coalesce(links, 0) AS links FROM documents LEFT JOIN sim USING (doc_id) LEFT JOIN u USING (simhash) LEFT JOIN n ON n.id = u.id")
def hamming_classes(spark, sf_dir):
    """The membership to the pairs of hamming_pairs: each document's representative and how many others that one is within 3 bits of."""
    made = _simhash(spark, sf_dir).select("doc_id", "simhash")
    distinct = made.where("simhash is not null").groupBy("simhash").agg(F.min("doc_id").alias("ordinal"))
    pairs = fingerprints.near_pairs(distinct, 3)
    links = pairs.select(F.explode(F.array("a", "b")).alias("ordinal")).groupBy("ordinal").agg(F.count("*").alias("links"))
    classes = distinct.join(links, "ordinal", "left")
    return made.join(classes, "simhash", "left").select("doc_id", F.col("ordinal").alias("representative"), F.coalesce("links", F.lit(0)).alias("links"))


_KEPT = "list_filter(a, lambda k: k.hit IS NULL)"
_GREEDY = f"""WITH {_SIM}, o AS (SELECT d.doc_id, simhash AS h FROM documents d JOIN sim USING (doc_id) ORDER BY d.source, d.doc_id),
l AS (SELECT list([{{'id': doc_id, 'h': h, 'hit': NULL::BIGINT, 'd': NULL::BIGINT, 'n': 0::BIGINT}}] ORDER BY (SELECT d.source FROM documents d WHERE d.doc_id = o.doc_id), doc_id) AS l FROM o),
r AS (SELECT unnest(list_reduce(list_prepend([{{'id': NULL::BIGINT, 'h': NULL::UBIGINT, 'hit': -1::BIGINT, 'd': NULL::BIGINT, 'n': 0::BIGINT}}], l), lambda a, x: list_append(a, list_transform([{_KEPT}], lambda kept:
  list_transform([coalesce(list_position(list_transform(kept, lambda k: bit_count(xor(k.h, x[1].h)) <= 3), true), 0)], lambda p:
  {{'id': x[1].id, 'h': x[1].h, 'hit': CASE WHEN p > 0 THEN kept[p].id END, 'd': CASE WHEN p > 0 THEN bit_count(xor(kept[p].h, x[1].h))::BIGINT END, 'n': (CASE WHEN p > 0 THEN p ELSE len(kept) END)::BIGINT}})[1])[1]))) AS x FROM l),
dec AS (SELECT documents.doc_id, source AS input_path, CASE WHEN x.id IS NULL THEN 'no_features' WHEN x.hit IS NULL THEN 'kept' ELSE 'duplicate' END AS disposition, x.hit AS retained_id, x.d AS distance, coalesce(x.n, 0) AS comparisons FROM documents LEFT JOIN r ON r.x.id = documents.doc_id)"""


def _decisions(spark, sf_dir):
    return fingerprints.duplicates(_simhash(spark, sf_dir).withColumn("record_ordinal", F.col("doc_id")), 3)


@_register("dedup_decisions", _GREEDY + " SELECT doc_id, disposition, retained_id, distance, comparisons FROM dec")
def dedup_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir).select("doc_id", "disposition", "retained_id", "distance", "comparisons")


@_register("dedup_counts", _GREEDY + " SELECT disposition, count(*) AS documents, sum(comparisons)::BIGINT AS comparisons FROM dec GROUP BY disposition")
def dedup_counts(spark, sf_dir):
    return fingerprints.decision_counts(_decisions(spark, sf_dir))


@_register("deduped_index_stats", _GREEDY + " SELECT count(DISTINCT doc_id) AS documents, sum(tf)::BIGINT AS total_tokens, count(*) AS postings FROM tf WHERE doc_id IN (SELECT doc_id FROM dec WHERE disposition = 'kept')")
def deduped_index_stats(spark, sf_dir):
    kept = _decisions(spark, sf_dir).where("disposition = 'kept'").select("doc_id")
    stats = index.statistics_in_place(terms.tokens(_docs(spark, sf_dir)))
    return index.corpus_statistics(stats.join(kept.hint("merge"), "doc_id", "left_semi"))


# --- pages and feeds ---

@_register("html_text")
def html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html.html_text("html").alias("t")).select("page_id", X.code_points("t.text").alias("n_chars"), F.md5("t.text").alias("digest"), "t.recovered")


@_register("main_content")
def main_content(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html.main_content("html").alias("t")).select("page_id", "t.title", X.code_points("t.text").alias("n_chars"))


@_register("rss_items")
def rss_items(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    feed = F.concat(F.lit('<rss version="2.0"><channel><item><title>'), X.escape_html("url"), F.lit("</title><description>"), X.escape_html("html"), F.lit("</description></item></channel></rss>"))
    items = files.read_feeds(pages.select(F.concat(F.lit("p/"), "page_id").alias("input_path"), F.encode(feed, "UTF-8").alias("bytes")))
    return items.select("input_path", "record_ordinal", "status", X.code_points("record.content").alias("n_chars"), F.size("issues").cast("long").alias("n_issues"))


# --- requests ---

def _log(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("conn_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 1000).cast("long").alias("micros"))


_MICROS = "floor(value * 1000)::BIGINT"


@_register("latency_histogram", f"SELECT event_type AS kind, CASE WHEN m <= 100 THEN 0 WHEN m <= 1000 THEN 1 WHEN m <= 10000 THEN 2 WHEN m <= 100000 THEN 3 WHEN m <= 1000000 THEN 4 ELSE 5 END AS bucket, count(*) AS requests FROM (SELECT event_type, {_MICROS} AS m FROM events) GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    return R.latency_histogram(_log(spark, sf_dir))


@_register("kind_counters", f"SELECT event_type AS kind, count(*) AS requests, sum({_MICROS})::BIGINT AS total, max({_MICROS}) AS most FROM events GROUP BY event_type")
def kind_counters(spark, sf_dir):
    return R.kind_counters(_log(spark, sf_dir))


@_register("metrics_tumbling", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type AS kind, count(*) AS requests FROM events GROUP BY ALL")
def metrics_tumbling(spark, sf_dir):
    return R.tumbling_metrics(_log(spark, sf_dir), "1 hour").withColumn("start", F.unix_timestamp("start"))


@_register("idle_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS conn_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS requests FROM s GROUP BY user_id, k""")
def idle_sessions(spark, sf_dir):
    return R.idle_sessions(_log(spark, sf_dir), "1 hour").withColumn("start", F.unix_micros("start")).withColumn("last", F.unix_micros("last"))


@_register("admission_control", "SELECT event_id AS request_id, CASE WHEN row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 HOUR, ts) ORDER BY ts, event_id) <= 3 THEN 0 ELSE 2 END AS status FROM events")
def admission_control(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("batch", F.date_trunc("hour", "ts"))
    return R.admit(log, 3).select("request_id", "status")


@_register("deadline_flags", f"SELECT event_id AS request_id, CASE WHEN {_MICROS} > 50000 THEN 5 ELSE 0 END AS status FROM events")
def deadline_flags(spark, sf_dir):
    return R.past_deadline(_log(spark, sf_dir), 50_000).select("request_id", "status")


@_register("late_drop", "SELECT event_id AS request_id, NOT (user_id % 3 = 0 AND event_id % 2 = 0) AS stale FROM events")
def late_drop(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("generation", F.col("request_id") % 2)
    live = log.where("conn_id % 3 = 0").select("conn_id", F.lit(0).cast("long").alias("generation"))
    return R.drop_stale(log, live).select("request_id", "stale")


@_register("lru_replay")
def lru_replay(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("shard", F.col("conn_id") % 16).withColumn("key", F.concat_ws("/", "kind", "conn_id"))
    return R.replay_cache(log, 8)


@F.arrow_udf(T.LongType())
def _status(bodies: pa.Array) -> pa.Array:
    out = []
    for body in bodies.to_pylist():
        try:
            service.parse_request("SEARCH", body, service.Settings())
            out.append(service.OK)
        except EngineError as e:
            out.append(service.status_of(e))
    return pa.array(out, pa.int64())


@_register("request_validation", "SELECT conv_id, turn, CASE WHEN turn * 30 > 100 THEN 6 WHEN turn = 0 OR turn % 2 = 1 THEN 1 ELSE 0 END AS status FROM conversations WHERE role = 'user'")
def request_validation(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    body = F.to_json(F.struct(F.col("text").alias("query"), (F.col("turn") * 30).alias("top_k"), F.when(F.col("turn") % 2 == 1, "xor").otherwise("or").alias("mode")))
    return talk.select("conv_id", "turn", _status(body).alias("status"))


@_register("one_in_flight", """WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS a, floor(value * 1000)::BIGINT AS m, sum(floor(value * 1000)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)
SELECT x.event_id AS request_id, (SELECT max(y.a + x.s - y.s + y.m) FROM w y WHERE y.user_id = x.user_id AND (y.a, y.event_id) <= (x.a, x.event_id))::BIGINT AS finish FROM w x""")
def one_in_flight(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("arrival", F.unix_micros("ts"))
    return R.one_in_flight(log).select("request_id", "finish")


@_register("due_deadlines", "SELECT user_id AS key, arg_max(floor(value * 1000)::BIGINT, event_id) AS \"when\" FROM events GROUP BY user_id HAVING arg_max(floor(value * 1000)::BIGINT, event_id) <= 50000")
def due_deadlines(spark, sf_dir):
    log = _log(spark, sf_dir).select(F.col("request_id").alias("seq"), F.col("conn_id").alias("key"), F.col("micros").alias("when"))
    return R.due_deadlines(log, 50_000)


@_register("checksums", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def checksums(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha256"))


@_register("posting_blocks", f"WITH {_TF} SELECT term, doc_id // 256 AS block, count(*) AS postings, md5(string_agg(doc_id::VARCHAR || ':' || tf::VARCHAR, ' ' ORDER BY doc_id)) AS digest FROM tf GROUP BY ALL")
def posting_blocks(spark, sf_dir):
    blocks = index.posting_blocks(_tf(spark, sf_dir), 256)
    return blocks.select("term", "block", F.size("postings").cast("long").alias("postings"), F.md5(F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ")).alias("digest"))


@_register("term_budgets", f"WITH {_TF}, e AS (SELECT term, count(*) AS n FROM tf GROUP BY term) SELECT count(*) AS distinct_terms, sum(strlen(term))::BIGINT AS vocabulary_bytes, max(strlen(term)) AS longest_term, sum(n)::BIGINT AS postings, max(n) AS longest_list FROM e")
def term_budgets(spark, sf_dir):
    return index.term_bytes(_tf(spark, sf_dir))


@_register("item_admission", "SELECT doc_id, text_before, fault FROM (SELECT doc_id, sum(b) OVER (ORDER BY source, doc_id) - b AS text_before, CASE WHEN sum(b) OVER (ORDER BY source, doc_id) > 1000000 THEN 'item.text_bytes' END AS fault FROM (SELECT doc_id, source, strlen(text) + strlen(source) AS b FROM documents))")
def item_admission(spark, sf_dir):
    record = F.struct(F.col("input_path").alias("title"), "content", *[F.lit("").alias(c) for c in ("kind", "url", "author", "published_at_raw")])
    items = _docs(spark, sf_dir).select("input_path", F.col("doc_id").alias("record_ordinal"), F.lit("success").alias("status"), record.alias("record"), F.array().cast("array<struct<code:string,message:string,region:string>>").alias("issues"))
    told = limits.admit_items(items, limits.Limits(text_bytes=1_000_000))
    return told.select(F.col("record_ordinal").alias("doc_id"), "text_before", "fault")


@_register("snapshot_roundtrip", f"WITH {_W} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM d) AS terms, (SELECT count(*) FROM p) AS postings, (SELECT sum(tf)::BIGINT FROM tf) AS total_tokens, (SELECT round(sum(weight * weight), 6) FROM p) AS squares")
def snapshot_roundtrip(spark, sf_dir):
    import uuid

    from quillspark.snapshot import open_snapshot, publish
    from quillspark.storage import shared_folder

    docs = _docs(spark, sf_dir).select("doc_id", F.lit("").alias("title"), "content", F.lit(None).cast("string").alias("url"))
    built = index.build_index(docs)
    words = suggest.dictionary(terms.recommendation_frequency(terms.term_frequency(docs)))
    parent, version = f"{shared_folder(spark)}/snapshots", uuid.uuid4().hex
    publish(spark, parent, version, docs, built, words, suggest.character_index(words))
    snap = open_snapshot(spark, parent, version, verify=True)
    t = snap.tables
    stats = index.corpus_statistics(t["doc_stats"])
    return stats.crossJoin(t["lexicon"].agg(F.count("*").alias("terms"))).crossJoin(t["postings"].agg(F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("squares"))).select("documents", "terms", "postings", "total_tokens", "squares")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten documents of each benchmark query, with the text around the first match."""
    hits = search_batch_topk(spark, sf_dir)
    asked = terms.tokens(_benchmark(spark, sf_dir), keys=("query_id",), text="text")
    shown = hits.join(asked, "query_id").join(_docs(spark, sf_dir), "doc_id").withColumn("s", display.summary(F.col("content"), F.col("terms")))
    return shown.select("query_id", "rank", "doc_id", "score", F.col("s.text").alias("snippet"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
