"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed terms: its words, in lower case; and how it is written: the runs of character classes of each word (space, lower, upper,
digit, sentence mark, symbol, beyond ASCII), pairs of these patterns, the patterns with the word's length, and how often words repeat the
one before. Terms are weighted by tf-idf and projected on the leading singular vectors of the labelled sample's term matrix. A document's score is
the mean of the labels of its ``neighbours`` nearest labelled vectors, weighted by a steep function of cosine similarity; products with all
labelled vectors are exact, in blocks.

The only thing fitted is the labelled sample, at most ``most`` rows (the smallest by a hash of doc_id, whatever the size of the
corpus), so the vectors that are broadcast have a fixed bound of ``most * rank`` floats. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._bytes import Chunk, _powers, chunks, mix
from quillspark.llm._space import small_batches

_U = np.uint64
#: Character classes: space, lower, upper, digit, sentence mark, symbol, beyond ASCII.
_CLASS = np.full(256, 5, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,;:?'\"()-")] = 4
_CLASS[128:] = 6

TERMS = 1 << 13


def _terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and weight of each distinct term of each text, ordered by text."""
    starts, stops, text = chunk.words()
    n = len(starts)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float32)
    kinds = _CLASS[chunk.data]
    change = np.ones(len(kinds), bool)
    change[1:] = kinds[1:] != kinds[:-1]
    change[starts] = True
    # A word's pattern: its runs of character classes, each by its place from the front, all of them.
    at = np.flatnonzero(change & (kinds > 0))
    first = np.searchsorted(at, starts)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    code = np.add.reduceat((kinds[at].astype(_U) + _U(1)) * _powers(len(at) + 1)[0][nth], first)
    size = (stops - starts).astype(float)
    size = np.where(size < 12, size, 12 + np.floor(4 * np.log2(np.maximum(size, 12) / 12))).astype(_U)
    h = chunk.hashes(starts, stops, lower=True)
    same = np.zeros(n, bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    # How often a word has stood there in a row, in powers of two; and tenths of the text's words that repeat the one before.
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    row = np.log2(1 + np.arange(n) - begin).astype(np.int64).astype(_U)
    many = np.bincount(text, minlength=chunk.count)
    tenth = (10 * np.bincount(text, same, chunk.count) / np.maximum(many, 1)).astype(np.int64).astype(_U)
    pair = np.flatnonzero(text[1:] == text[:-1])
    families = [
        (text, mix(code * _U(0x9E3779B97F4A7C15) + _U(1))),
        (text[pair], mix(code[pair] * _U(0xC2B2AE3D27D4EB4F) + code[pair + 1] * _U(31) + _U(2))),
        (text[same], mix(row[same] + _U(3))),
        (text[same], mix(code[same] * _U(0xE7037ED1A0B428DB) + row[same] * _U(131) + _U(6))),
        (text, mix(tenth[text] + _U(1000))),
        (text, mix(code * _U(0xA0761D6478BD642F) + size * _U(97) + _U(4))),
        (text, mix(h + _U(5))),
    ]
    of = np.concatenate([f[0] for f in families])
    term = (np.concatenate([f[1] for f in families]) % _U(TERMS)).astype(np.int64)
    key, count = np.unique(of * TERMS + term, return_counts=True)
    return key // TERMS, key % TERMS, np.log1p(count).astype(np.float32)


class Space:
    """Inverse document frequencies, singular vectors and the labelled documents' unit vectors."""

    def __init__(self, of: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, rank: int, rounds: int = 4):
        """Of the labelled texts: text, term and weight of each distinct term (ordered by text), and their labels."""
        base = len(labels)
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + base) / (1 + np.bincount(term, minlength=TERMS))).astype(np.float32) + 0.1
        weight = weight * self.idf[term]
        norm = np.sqrt(np.bincount(of, weight * weight, base)).astype(np.float32)
        weight = weight / np.maximum(norm[of], 1e-9)
        rows = np.searchsorted(of, np.arange(base + 1))
        by_term = np.argsort(term, kind="stable")
        cols = np.searchsorted(term[by_term], np.arange(TERMS + 1))

        def times(dense: np.ndarray, index: np.ndarray, values: np.ndarray, edge: np.ndarray) -> np.ndarray:
            out = np.zeros((len(edge) - 1, dense.shape[1]), np.float32)
            for a in range(0, len(edge) - 1, 512):
                b = min(a + 512, len(edge) - 1)
                s, e = edge[a], edge[b]
                if e > s:
                    some = np.flatnonzero(edge[a + 1 : b + 1] > edge[a:b]) + a
                    out[some] = np.add.reduceat(dense[index[s:e]] * values[s:e, None], edge[some] - s, axis=0)
            return out

        # Randomised subspace iteration for the leading right singular vectors.
        basis = np.random.default_rng(11).standard_normal((TERMS, rank + 8)).astype(np.float32)
        for _ in range(rounds):
            basis, _r = np.linalg.qr(times(times(basis, term, weight, rows), of[by_term], weight[by_term], cols))
            basis = basis.astype(np.float32)
        seen = times(basis, term, weight, rows)
        _u, _s, vt = np.linalg.svd(seen, full_matrices=False)
        self.basis = np.ascontiguousarray((basis @ vt.T[:, :rank]).astype(np.float32)) if len(seen) else basis[:, :rank]
        self.vectors = self._unit(times(self.basis, term, weight, rows))

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def project(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of a chunk's texts, and which texts have any term."""
        of, term, weight = _terms(chunk)
        weight = weight * self.idf[term]
        out = np.zeros((chunk.count, self.basis.shape[1]), np.float32)
        edge = np.searchsorted(of, np.arange(chunk.count + 1))
        some = np.flatnonzero(edge[1:] > edge[:-1])
        if len(some):
            out[some] = np.add.reduceat(self.basis[term] * weight[:, None], edge[some], axis=0)
        return self._unit(out), edge[1:] > edge[:-1]

    def vote(self, vectors: np.ndarray, sharp: float, neighbours: int, block: int = 2048) -> np.ndarray:
        """The weighted mean label of the nearest labelled vectors, by exact products block by block; ties go to the earlier one."""
        if len(vectors) > 512:  # however short the texts of a chunk are, few products are held at a time
            return np.concatenate([self.vote(vectors[a : a + 512], sharp, neighbours, block) for a in range(0, len(vectors), 512)])
        best = np.zeros((len(vectors), 0), np.float32)
        label = np.zeros((len(vectors), 0), np.float32)
        for a in range(0, len(self.vectors), block):
            like = np.concatenate([best, vectors @ self.vectors[a : a + block].T], axis=1)
            mark = np.concatenate([label, np.broadcast_to(self.labels[a : a + block], (len(vectors), len(self.labels[a : a + block])))], axis=1)
            if like.shape[1] > neighbours:
                at = np.argpartition(-like, neighbours - 1, axis=1)[:, :neighbours]
                like, mark = np.take_along_axis(like, at, 1), np.take_along_axis(mark, at, 1)
            best, label = like, mark
        weight = np.exp(sharp * (best - best.max(1, keepdims=True)))
        return (weight * label).sum(1) / weight.sum(1)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each text."""
    for batch in batches:
        for chunk in chunks(batch.column(1), 1 << 19):
            of, term, weight = _terms(chunk)
            edge = pa.array(np.searchsorted(of, np.arange(chunk.count + 1)).astype(np.int32))
            part = batch.slice(chunk.first, chunk.count)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(edge, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(edge, pa.array(weight))], names=["doc_id", "quality", "term", "weight"])


def score_documents(docs: DataFrame, labels: DataFrame, most: int = 6000, rank: int = 48, neighbours: int = 25, sharp: float = 20.0, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with held_out, score and predicted; nothing is shuffled but the labelled sample.

    ``labels`` (doc_id, quality) teaches; rows whose crc32(doc_id) mod 5 is 0 are held out and never used. Labelled rows with a
    null label or text teach nothing; with several labels for a doc_id the greatest counts, with several texts the greatest.
    Of the rest, at most ``most`` rows with the smallest hashes of doc_id are the sample (a documented bound of the fit).
    Scores lie in 0 to 1. A text without words (null and empty ones too) scores 0; if nothing is labelled every other text scores
    1. A null doc_id has a null held_out. Repeated rows give repeated results. Result columns replace columns of the same
    names; other columns stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")])
    crc = lambda c: F.crc32(F.col(c).cast("long").cast("string"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null").where(crc("doc_id") % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").where("text is not null").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = taught.select("doc_id", "text", "quality").mapInArrow(_bags, "doc_id long, quality int, term array<int>, weight array<float>").orderBy("doc_id").toArrow()  # at most `most` rows of at most TERMS terms
    space = None
    if rows.num_rows:
        size = pc.list_value_length(rows["term"]).to_numpy()
        space = Space(np.repeat(np.arange(len(size)), size), pc.list_flatten(rows["term"]).to_numpy().astype(np.int64), pc.list_flatten(rows["weight"]).to_numpy(), rows["quality"].to_numpy() > 0, rank)
    shared = spark.sparkContext.broadcast(space)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        space, out = shared.value, [np.zeros(0)]
        for chunk in chunks(texts, 1 << 19):
            if space is None:
                out.append((np.bincount(chunk.words()[2], minlength=chunk.count) > 0).astype(float))
            else:
                vectors, some = space.project(chunk)
                out.append(np.where(some, np.clip(space.vote(vectors, sharp, neighbours), 0, 1), 0.0))
        return pa.array(np.concatenate(out), pa.float64())

    scored = docs.withColumn("score", score("text"))
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns], (crc("doc_id") % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
