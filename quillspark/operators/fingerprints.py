"""64-bit SimHash fingerprints and the order-dependent choice of near duplicates."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.errors import EngineError
from quillspark.functions.text import hamming
from quillspark.operators.order import number_in_order
from quillspark.storage import written

_U = np.uint64
# Fixed values of policy 1: FNV-1a 64 and the finaliser of MurmurHash3.
OFFSET, PRIME = 14695981039346656037, 1099511628211
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The policy's hash of each word; all words advance by one byte at a time together."""
    h = np.full(len(words), OFFSET, _U)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(size) - size
    for k in range(int(size.max()) if len(words) else 0):
        on = np.flatnonzero(size > k)
        h[on] = (h[on] ^ flat[begin[on] + k].astype(_U)) * _U(PRIME)
    for factor in (MIX_1, MIX_2):
        h = (h ^ (h >> _U(33))) * _U(factor)
    return h ^ (h >> _U(33))


@F.arrow_udf(T.LongType())
def word_hash(words: pa.Array) -> pa.Array:
    """The policy's hash of each word, as a signed long."""
    return pa.array(word_hashes([w.encode() for w in words.to_pylist()]).view(np.int64))


def _bits(words: pa.Array, size: np.ndarray) -> list[int | None]:
    """The fingerprint of each run of ``size`` words: bit i is set where words with it occur strictly more often than others."""
    table = words.dictionary_encode()
    hashes = word_hashes([w.encode() for w in table.dictionary.to_pylist()])[table.indices.to_numpy()]
    out: list[int | None] = []
    ends = np.cumsum(size)
    a = 0
    while a < len(size):  # some million votes at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 200_000, "right")))
        begin = ends[a:b] - size[a:b] - (ends[a - 1] if a else 0)
        own = hashes[ends[a - 1] if a else 0 : ends[b - 1]]
        votes = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        some = size[a:b] > 0
        count = np.add.reduceat(votes, begin[some], axis=0) if some.any() else np.zeros((0, 64), np.int64)
        marks = np.packbits(2 * count > size[a:b][some][:, None], axis=1, bitorder="little").view("<i8").reshape(-1)
        held = iter(marks.tolist())
        out += [next(held) if x else None for x in some]
        a = b
    return out


@F.arrow_udf(T.LongType())
def simhash_of(terms: pa.Array) -> pa.Array:
    """The fingerprint of an array of terms, with repeats; null if there are none."""
    size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(_bits(pc.list_flatten(terms), size) if size.any() else [None] * len(size), pa.int64())


def simhash(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """(doc_id, simhash long or null) from term counts; documents without terms have a null fingerprint.

    Where documents are at hand, ``simhash_of`` over their tokens needs no shuffle.
    """
    words = tf.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int")))).alias("terms"))
    return docs.select("doc_id").join(words.select("doc_id", simhash_of("terms").alias("simhash")), "doc_id", "left")


def _bands(distance: int) -> tuple[list[tuple[int, ...]], int]:
    """Sets of blocks of the 64 bits, such that fingerprints within ``distance`` bits agree in all blocks of one of them: each leaves out ``distance`` blocks.

    Of the numbers of blocks with at most 40 such sets the largest is taken, as its sets hold the most bits.
    """
    blocks = max([n for n in range(distance + 1, min(64, distance + 8) + 1) if math.comb(n, distance) <= 40] or [min(64, distance + 1)])
    return list(itertools.combinations(range(blocks), blocks - distance)), blocks


def near_pairs(fingerprints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance): pairs of ``fingerprints`` (ordinal, simhash) with a < b that differ in at most ``distance`` bits.

    64 bits are cut into blocks. Such a pair agrees in all but ``distance`` of them, so an equi-join on sets of blocks finds it, and is kept at the first set
    in which it agrees. A set holds half of the bits at a distance of 3, so that among 10**9 fingerprints hardly any others share them. Equal
    fingerprints should be joined through their smallest member only; see ``duplicates``.
    """
    if not 0 <= distance <= 64:
        raise EngineError("duplicate.policy", "the distance must lie in 0..64")
    sets, blocks = _bands(min(distance, 63))
    edges = [64 * k // blocks for k in range(blocks + 1)]
    mask = lambda k: ((1 << (edges[k + 1] - edges[k])) - 1) << edges[k]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(mask(k) for k in s)) for s in sets]
    cut = fingerprints.where("simhash is not null").select("ordinal", "simhash", F.posexplode(F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "bits"))
    x, y = cut.alias("x"), cut.alias("y")
    d = hamming(F.col("x.simhash"), F.col("y.simhash"))
    diff = F.col("x.simhash").bitwiseXOR(F.col("y.simhash"))
    first = F.coalesce(*[F.when(diff.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    met = x.join(y.hint("merge"), (F.col("x.band") == F.col("y.band")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.ordinal") < F.col("y.ordinal")) & (d <= distance))
    if distance == 64:  # every pair is near, whether or not it shares a block
        x, y = (fingerprints.where("simhash is not null").alias(n) for n in "xy")
        return x.join(y.hint("shuffle_replicate_nl"), F.col("x.ordinal") < F.col("y.ordinal")).select(F.col("x.ordinal").alias("a"), F.col("y.ordinal").alias("b"), d.alias("distance"))
    return met.where(F.col("x.band") == first).select(F.col("x.ordinal").alias("a"), F.col("y.ordinal").alias("b"), d.alias("distance"))


def duplicates(candidates: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, input_path, record_ordinal, disposition, retained_id, distance, comparisons) for (doc_id, input_path, record_ordinal, simhash).

    In (input_path, record_ordinal) order a document is a duplicate of the first earlier kept one within ``distance`` bits, else kept; without a
    fingerprint it is 'no_features'. Equal fingerprints are decided once, by their first document: the others are duplicates of whatever decides it. The order
    is resolved in rounds: a fingerprint is kept once all its earlier neighbours are out, and out once one of them is kept. ``comparisons`` is how many kept
    documents a scan in that order looks at: all before it for a kept one, up to the one that decides for a duplicate.

    Tables that grow with the documents are merged, never broadcast: by the size of their compressed files they would seem small, and the driver would hold them.
    Rounds only see the fingerprints with earlier neighbours.
    """
    spark: SparkSession = candidates.sparkSession
    candidates = written(spark, candidates)
    ranked = candidates.withColumn("place", F.struct("input_path", "record_ordinal", "doc_id"))
    heads = ranked.where("simhash is not null").groupBy("simhash").agg(F.min("place").alias("place"))
    heads = written(spark, number_in_order(heads, "place", "ordinal"))
    edges = written(spark, near_pairs(heads.select("ordinal", "simhash"), distance))
    # Without an earlier neighbour a fingerprint is kept; state holds the others.
    state = edges.select(F.col("b").alias("ordinal"), F.lit(None).cast("boolean").alias("kept")).distinct()
    while True:
        told = state.select(F.col("ordinal").alias("a"), "kept", F.lit(True).alias("late")).hint("merge")
        met = edges.join(told, "a", "left").select("b", F.when(F.col("late"), F.col("kept")).otherwise(True).alias("kept"))
        seen = met.groupBy(F.col("b").alias("ordinal")).agg(F.bool_or("kept").alias("beaten"), F.bool_or(F.col("kept").isNull()).alias("waits"))
        state = written(spark, seen.select("ordinal", F.when(F.coalesce("beaten", F.lit(False)), False).when(~F.col("waits"), True).alias("kept")))
        if state.where("kept is null").isEmpty():
            break
    state = heads.join(state.hint("merge"), "ordinal", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
    kept = written(spark, number_in_order(state.where("kept").select("ordinal"), "ordinal", "before"))
    by = edges.join(kept.select(F.col("ordinal").alias("a")).hint("merge"), "a").groupBy(F.col("b").alias("ordinal")).agg(F.min(F.struct("a", "distance")).alias("by"))
    told = state.join(by.hint("merge"), "ordinal", "left").select("ordinal", "simhash", "place", "kept", F.col("by.a").alias("a"), F.col("by.distance").alias("d"))
    owner = heads.select(F.col("ordinal").alias("a"), F.col("place.doc_id").alias("owner")).join(kept.select(F.col("ordinal").alias("a"), F.col("before").alias("owner_before")).hint("merge"), "a")
    told = told.join(owner.hint("merge"), "a", "left").join(kept.hint("merge"), "ordinal", "left").select("simhash", F.col("place").alias("head"), "kept", "owner", "d", "before", "owner_before")
    out = ranked.join(told.hint("merge"), "simhash", "left")
    first = F.col("place") == F.col("head")
    return out.select(
        "doc_id", "input_path", "record_ordinal",
        F.when(F.col("simhash").isNull(), "no_features").when(F.col("kept") & first, "kept").otherwise("duplicate").alias("disposition"),
        F.when(F.col("simhash").isNull() | (F.col("kept") & first), None).when(F.col("kept"), F.col("head.doc_id")).otherwise(F.col("owner")).alias("retained_id"),
        F.when(F.col("simhash").isNull() | (F.col("kept") & first), None).when(F.col("kept"), F.lit(0).cast("long")).otherwise(F.col("d")).alias("distance"),
        F.when(F.col("simhash").isNull(), F.lit(0).cast("long")).when(F.col("kept") & first, F.col("before")).when(F.col("kept"), F.col("before") + 1).otherwise(F.col("owner_before") + 1).alias("comparisons"),
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    """(disposition, documents, comparisons)."""
    return decisions.groupBy("disposition").agg(F.count("*").alias("documents"), F.sum("comparisons").alias("comparisons"))
