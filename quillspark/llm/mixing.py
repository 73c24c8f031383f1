"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling by calibrated probabilities.

*Topics* come from the corpus, all of it: words are hashed to ``WORDS`` buckets and weighted by tf-idf; the leading eigenvectors of the sum of
x x' over all documents are found by randomised subspace iteration (two passes over the bags, in which tasks sum whole numbers, so the result
doesn't depend on how rows are dealt out) and rotated by varimax, which gives each of them few words. A text's topic is the
direction on which it loads most.

*Cells* are (source, language, topic) with their tokens (words); documents are summed per task before the shuffle. Token weights are
raked to the three target marginals in turn until they hold. Targets that can't hold together are an error. Each document is kept with a
probability proportional to the factor of its cell, scaled (and capped at 1) so that the expected number of kept tokens is ``keep`` times the
corpus.

The table of cells is raked in the driver up to ``held`` cells. Beyond that the same rounds run as joins of distributed tables, each
written to the shared folder; no source, language or topic is ever merged with others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._bytes import chunks
from quillspark.llm._space import Space

_U = np.uint64
WORDS = 4096
_SCALE = float(1 << 24)
KEYS = ("source", "lang", "topic")


def _bag(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and text, bucket and count of each distinct bucket, ordered by text."""
    starts, stops, text = chunk.words()
    key, count = np.unique(text * WORDS + (chunk.hashes(starts, stops, lower=True) % _U(WORDS)).astype(np.int64), return_counts=True)
    return np.bincount(text, minlength=chunk.count), key // WORDS, key % WORDS, count


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(batch.schema.get_field_index("text")), 1 << 19):
            n, of, word, count = _bag(chunk)
            edge = np.searchsorted(of, np.arange(chunk.count + 1))
            word, count = word.astype("<u2"), np.minimum(count, 65_535).astype("<u2")
            bags = [word[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
            part = batch.slice(chunk.first, chunk.count)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(bags, pa.binary()), part.column(0), part.column(1)], names=["n_tokens", "bag", "source", "lang"])


def _slices(bags: pa.Array, entries: int = 200_000) -> Iterator[pa.Array]:
    """The bags in slices of about so many entries, as every entry becomes a row of numbers."""
    edge = np.cumsum(pc.fill_null(pc.binary_length(bags), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
    at = 0
    while at < len(bags):
        to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + entries, "right")))
        yield bags.slice(at, to - at)
        at = to


def _unpacked(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blobs = bags.to_pylist()
    size = np.array([len(b) // 4 for b in blobs], np.int64)
    word = np.frombuffer(b"".join(b[: len(b) // 2] for b in blobs), "<u2").astype(np.int64)
    count = np.frombuffer(b"".join(b[len(b) // 2 :] for b in blobs), "<u2")
    return np.repeat(np.arange(len(blobs)), size), word, count


def _weights(of: np.ndarray, word: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Entries of unit vectors."""
    w = np.log1p(count.astype(float)) * idf[word]
    return w / np.maximum(np.sqrt(np.bincount(of, w * w, n)), 1e-12)[of]


def _loads(of: np.ndarray, word: np.ndarray, w: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Products of the vectors with the columns of a basis."""
    out = np.zeros((n, basis.shape[1]))
    edge = np.searchsorted(of, np.arange(n + 1))
    some = np.flatnonzero(edge[1:] > edge[:-1])
    if len(some):
        out[some] = np.add.reduceat(basis[word] * w[:, None], edge[some], axis=0)
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WORDS, np.int64)
    for batch in batches:
        for bags in _slices(batch.column(0)):
            total += np.bincount(_unpacked(bags)[1], minlength=WORDS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["word", "n"])


def _spreader(idf: np.ndarray, basis: np.ndarray):
    """Sums of x (x' basis) over a task's documents, as whole numbers."""
    r = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((WORDS, r), np.int64)
        for bags in (part for batch in batches for part in _slices(batch.column(0))):
            of, word, count = _unpacked(bags)
            w = _weights(of, word, count, idf, len(bags))
            loads = _loads(of, word, w, basis, len(bags))
            for j in range(r):
                # Rounded entry by entry, so that the sum is the same in any order.
                total[:, j] += np.bincount(word, np.rint(w * loads[of, j] * _SCALE), WORDS).astype(np.int64)
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(total[some, j]) for j in range(r))], names=["word", *(f"c{j}" for j in range(r))])
    return run


def varimax(loads: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The loadings, rotated so that each column has few large ones (Kaiser's criterion)."""
    p, k = loads.shape
    turn, before = np.eye(k), 0.0
    for _ in range(rounds):
        now = loads @ turn
        u, s, vt = np.linalg.svd(loads.T @ (now**3 - now * (now**2).sum(0) / p))
        turn = u @ vt
        if s.sum() < before * (1 + 1e-9):
            break
        before = s.sum()
    return loads @ turn


def topic_basis(bags: DataFrame, topics: int, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies and the topics' loadings (WORDS x topics), from all ``bags`` (bag binary)."""
    n = bags.count()
    df = np.zeros(WORDS)
    for r in bags.select("bag").mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most WORDS rows
        df[r["word"]] = r["n"]
    idf = np.log((1 + n) / (1 + df))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((WORDS, topics + 8)))[0]
    fields = "word int, " + ", ".join(f"c{j} long" for j in range(topics + 8))
    for last in (False, True):
        spread = np.zeros_like(basis)
        sums = bags.select("bag").mapInArrow(_spreader(idf, basis), fields).groupBy("word").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(topics + 8)])
        for r in sums.collect():  # at most WORDS rows
            spread[r["word"]] = r[1:]
        if not last:
            basis = np.linalg.qr(spread / _SCALE + 1e-9 * basis)[0]
    inner = basis.T @ (spread / _SCALE)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    top = np.argsort(-values)[:topics]
    loads = varimax(basis @ vectors[:, top])
    return idf, loads * np.sign((loads**3).sum(0) + 1e-300)


def _topics(idf: np.ndarray, loads: np.ndarray):
    """Words and topic of each text."""
    @F.arrow_udf("struct<n_tokens: bigint, topic: int>")
    def run(texts: pa.Array) -> pa.Array:
        words, best = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for chunk in chunks(texts, 1 << 19):
            n, of, word, count = _bag(chunk)
            words.append(n.astype(np.int64))
            count = np.minimum(count, 65_535)
            best.append(_loads(of, word, _weights(of, word, count, idf, chunk.count), loads, chunk.count).argmax(1).astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(words)), pa.array(np.concatenate(best))], names=["n_tokens", "topic"])
    return run


def _topics_of_bags(idf: np.ndarray, loads: np.ndarray):
    """The same topics, from bags."""
    @F.arrow_udf("int")
    def run(bags: pa.Array) -> pa.Array:
        best = [np.zeros(0, np.int32)]
        for part in _slices(bags):
            of, word, count = _unpacked(part)
            best.append(_loads(of, word, _weights(of, word, count, idf, len(part)), loads, len(part)).argmax(1).astype(np.int32))
        return pa.array(np.concatenate(best))
    return run


class _Local:
    """Cells in the driver."""

    def __init__(self, table: pd.DataFrame):
        self.table = table

    def marginal(self, key: str, weight: str) -> dict:
        return self.table[weight].groupby(self.table[key], sort=True).sum().to_dict()

    def scale(self, key: str, weight: str, ratio: dict) -> None:
        self.table[weight] *= self.table[key].map(ratio).astype(float)

    def add(self, name: str, value) -> None:
        self.table[name] = value(self.table)

    def sums(self, *values) -> list[float]:
        return [float(v(self.table).sum()) for v in values]

    def done(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.table[[*KEYS, "weight", "probability"]], "source string, lang string, topic int, weight double, probability double")


def _rake_local(cells: _Local, weight: str, goals: dict[str, dict], rounds: int, close: float) -> float:
    """Scales ``weight`` until its shares meet ``goals`` (key -> category -> share); how far it is off at the end."""
    total, worst = cells.sums(lambda t: t[weight])[0], 0.0
    for _ in range(rounds):
        worst = 0.0
        for key, goal in goals.items():
            now = cells.marginal(key, weight)
            ratio = {c: goal.get(c, 0.0) * total / v if v > 0 else 1.0 for c, v in now.items()}
            worst = max([worst, *(abs(ratio[c] - 1) for c, v in now.items() if v > 0)])
            cells.scale(key, weight, ratio)
        if worst < close:
            break
    return worst


class Clash(ValueError):
    """Target marginals that no weights of the cells meet together."""


def _checked(goals: dict[str, dict], there: dict[str, set]) -> dict[str, dict]:
    """Given shares without categories that have no tokens, scaled to a sum of 1."""
    out = {}
    for key, goal in goals.items():
        kept = {c: float(v) for c, v in goal.items() if c in there[key] and v > 0}
        if any(v < 0 for v in goal.values()) or not kept:
            raise Clash(f"targets of {key} leave nothing")
        total = sum(kept.values())
        out[key] = {c: v / total for c, v in kept.items()}
    return out


def rake(table: pd.DataFrame, targets: dict[str, dict], power: float, rounds: int = 500, close: float = 1e-9, off: float = 1e-2) -> pd.Series:
    """Factors of cells (source, lang, topic, tokens): tokens times factors have the target share in each category of each marginal.

    Categories without tokens are left out and the other targets scaled up; categories that a given marginal doesn't name get nothing. Marginals that
    aren't given follow from the tokens to the power ``power``, raked to the given ones, so they never clash with them. Given ones that do
    clash, by more than ``off`` in any category, raise ``Clash``.
    """
    cells = _Local(table[[*KEYS, "tokens"]].copy())
    cells.add("goal", lambda t: np.power(t["tokens"].astype(float), power).where(t["tokens"] > 0, 0.0))
    cells.add("now", lambda t: t["tokens"].astype(float))
    if not cells.sums(lambda t: t["now"])[0] > 0:
        return pd.Series(1.0, index=table.index)
    there = {key: {c for c, v in cells.marginal(key, "now").items() if v > 0} for key in KEYS}
    given = _checked(targets, there)
    if given and _rake_local(cells, "goal", given, rounds, close) > off:
        raise Clash("the targets of " + ", ".join(given) + " can't hold together")
    whole = cells.sums(lambda t: t["goal"])[0]
    goals = {key: {c: v / whole for c, v in cells.marginal(key, "goal").items()} for key in KEYS} | given
    _rake_local(cells, "now", goals, rounds, close)
    return (cells.table["now"] / cells.table["tokens"]).where(cells.table["tokens"] > 0, 1.0)


def calibrate(sums, total: float, budget: float) -> float:
    """The scale at which the expected tokens min(1, scale * factor) * tokens make up ``budget``.

    ``sums(scale)`` gives the tokens of cells whose probability is capped, and tokens times factors of the others. Infinite if everything is kept.
    """
    if budget >= total:
        return float("inf")
    scale, capped = 0.0, -1.0
    while True:
        now, free = sums(scale)
        if now == capped or free <= 0:
            return scale if free > 0 else float("inf")
        capped, scale = now, (budget - now) / free


def _rake_far(space: Space, cells: DataFrame, weight: str, goals: dict[str, DataFrame], rounds: int, close: float, name: str) -> tuple[DataFrame, float]:
    """As ``_rake_local``, as joins; ``goals`` are tables (key, share). Each round is written to the shared folder."""
    total, worst = cells.agg(F.sum(weight)).first()[0], 0.0
    for k in range(rounds):
        worst_of = F.lit(0.0)
        for key, goal in goals.items():
            now = cells.groupBy(key).agg(F.sum(weight).alias("_now"))
            ratio = now.join(goal, key, "left").select(key, F.when(F.col("_now") > 0, F.coalesce("share", F.lit(0.0)) * total / F.col("_now")).otherwise(1.0).alias("_ratio"))
            cells = cells.join(ratio, key)
            worst_of = F.greatest(worst_of, F.when(F.col(weight) > 0, F.abs(F.col("_ratio") - 1)).otherwise(0.0))
            cells = cells.withColumn("_worst", worst_of).withColumn(weight, F.col(weight) * F.col("_ratio")).drop("_ratio")
            worst_of = F.col("_worst")
        cells = space.save(cells, f"{name}-{k}")
        worst = cells.agg(F.max("_worst")).first()[0]
        cells = cells.drop("_worst")
        if k:
            space.drop(f"{name}-{k - 1}")
        if worst < close:
            break
    return cells, worst


def _far(spark: SparkSession, space: Space, cells: DataFrame, targets: dict[str, dict], power: float, keep: float, rounds: int = 500, close: float = 1e-9, off: float = 1e-2) -> DataFrame:
    """Weights and probabilities of more cells than the driver holds."""
    cells = cells.withColumn("goal", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power))).otherwise(0.0)).withColumn("now", F.col("tokens").cast("double"))
    cells = space.save(cells, "far")
    total = cells.agg(F.sum("now")).first()[0]
    there = {key: {r[0] for r in cells.where(F.col("now") > 0).where(F.col(key).isin(list(goal))).select(key).distinct().collect()} for key, goal in targets.items()}  # among those that are named
    given = {key: spark.createDataFrame(sorted(goal.items()), f"{key} {'int' if key == 'topic' else 'string'}, share double") for key, goal in _checked(targets, there).items()}
    if given:
        cells, worst = _rake_far(space, cells, "goal", given, rounds, close, "goal")
        if worst > off:
            raise Clash("the targets of " + ", ".join(given) + " can't hold together")
    whole = cells.agg(F.sum("goal")).first()[0]
    goals = {key: given[key] if key in given else space.save(cells.groupBy(key).agg((F.sum("goal") / whole).alias("share")), f"goals-{key}") for key in KEYS}
    cells, _ = _rake_far(space, cells, "now", goals, rounds, close, "now")
    weight = F.when(F.col("tokens") > 0, F.col("now") / F.col("tokens")).otherwise(1.0)
    cells = space.save(cells.withColumn("weight", weight), "weights")

    def sums(scale: float) -> tuple[float, float]:
        capped = F.col("weight") * scale >= 1
        r = cells.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        return float(r[0] or 0), float(r[1] or 0)

    scale = calibrate(sums, total, keep * total)
    return cells.select(*KEYS, "weight", F.least(F.lit(1.0), F.col("weight") * scale if np.isfinite(scale) else F.lit(1.0)).alias("probability"))


def mix_sources(docs: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.7, keep: float = 0.9, topics: int = 8, seed: int = 17, held: int = 200_000) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, source, ...) with n_tokens, topic, weight, probability and selected.

    ``targets`` may give shares for 'source', 'lang' and 'topic' (numbers of topics; missing categories get 0). A marginal that isn't given is
    smoothed: it follows from the cells' tokens to the power ``power``, which lifts small ones. ``weight`` is the factor of the row's cell. A row is
    selected if a hash of (seed, doc_id) in [0, 1) is below its probability, so repeated rows go together and a re-run gives the same sample.
    Null sources and languages are categories of their own (named ''). Texts without words have no tokens but a cell, and are sampled like it; a cell
    without tokens has factor 1; a null doc_id counts as a value. Result columns replace columns of the same names; other columns stay, whatever
    their names. An empty table gives an empty result. Targets that clash raise ``Clash``.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "mixing")
    extra = [c for c in docs.columns if c.lower() not in ("n_tokens", "topic", "weight", "probability", "selected")]
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang"))
    bags = space.save(docs.select(source.alias("source"), lang.alias("lang"), "text").mapInArrow(_bags, "n_tokens long, bag binary, source string, lang string"), "bags")
    idf, loads = topic_basis(bags, topics)
    topic_of, topic_in = _topics(idf, loads), _topics_of_bags(idf, loads)
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)]).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), lang.alias("lang"), topic_of("text").alias("found"))
    rows = rows.select("rest", "doc_id", "source", "lang", F.col("found.n_tokens").alias("n_tokens"), F.col("found.topic").alias("topic"))

    seen = space.save(bags.select("source", "lang", topic_in("bag").alias("topic"), "n_tokens").groupBy(*KEYS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if seen.count() <= held:
        table = seen.toPandas().sort_values(list(KEYS)).reset_index(drop=True)
        table["weight"] = rake(table, targets or {}, power)
        tokens, weight = table["tokens"].to_numpy(float), table["weight"].to_numpy(float)
        scale = calibrate(lambda s: (tokens[weight * s >= 1].sum(), (tokens * weight)[weight * s < 1].sum()), tokens.sum(), keep * tokens.sum())
        table["probability"] = np.minimum(1.0, weight * scale) if np.isfinite(scale) else 1.0
        plan = F.broadcast(_Local(table).done(spark))
    else:
        plan = space.save(_far(spark, space, seen, targets or {}, power, keep), "plan")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1).cast("long"))), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = rows.join(plan, list(KEYS), "left").withColumn("selected", draw < F.col("probability"))
    return out.select(*[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(extra)], "n_tokens", "topic", "weight", "probability", "selected")
