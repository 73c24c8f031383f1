"""Near-duplicate detection: MinHash signatures in an LSH forest, links confirmed on full shingle sets.

1. *Sketch.* Every whole text becomes a MinHash signature, a digest of its shingle set and the set's size. Equal sets collapse to their
   smallest doc_id, so thousands of copies cost one row from here on.
2. *Forest.* Each tree is an order of all signatures, by its own values. Documents whose longest common prefix there has at least ``base`` values are a
   region, a run of the sorted order. Inside a region neighbours with the longest prefixes are compared first, and all of its members in the end; those
   whose estimated similarity isn't clearly below the threshold are joined. Only a spanning star is written per joined set, never all pairs.
   *Adaptive depth:* a region of more than ``region`` members goes on by its next values, as deep as it needs, in parts of ``region`` members at most.
   That keeps apart members whose common prefix is shorter than the parts'. Unless all members of such a region have been joined anyway, they enter
   another forest, whose trees are deeper (so its regions are smaller) and more, so that links are missed as rarely as before. What is
   crowded and not joined in the last forest too is compared whole, block by block. So no link is lost because a region is crowded.
   The connected components of all joins are *families*: supersets of the true groups.
3. *Confirmation.* Similarities are computed on full sets. The texts of a family with at most ``block`` shingles meet in one task. A larger family is
   confirmed region by region instead, first in two trees, then in the regions of the other trees that still hold different groups. That its members have
   been joined by estimates says nothing there: its crowded regions that hold different groups go through the deeper forests too, and are compared whole
   after the last. A region of more than ``block`` shingles is cut into blocks, and each pair of blocks is a task.

A link of similarity s is missed if no tree shows it: (1 - s**base)**trees. That is 5e-7 at 0.85 and 3e-5 at 0.8 in the first forest, less than
1e-5 in the second and 2e-5 in the third.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm._bytes import chunks, free_memory, grouped, mix, shingles
from quillspark.llm._graph import connected_components
from quillspark.llm._space import Space

#: Values of a tree beyond its base, by which crowded regions go deeper.
MORE = 4
#: Parts that a crowded region can be cut into.
CUTS = 256
#: Most values that similarities are estimated from.
VALUES = 256
_U = np.uint64

_SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
    T.StructField("sig", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("tails", T.ArrayType(T.LongType())),
])


def _sets(chunk, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text of a chunk."""
    h, of = shingles(chunk, size)
    at = np.searchsorted(of, np.arange(chunk.count + 1))
    return [np.unique(h[a:b]) for a, b in zip(at, at[1:], strict=False)]


def _sketcher(size: int, trees: int, base: int, seed: int):
    depth = base + MORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        factors = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) * _U(2) + _U(1)
        flips = rng.integers(0, 2**63, trees * depth, dtype=np.uint64) * _U(2)
        salt = mix(rng.integers(1, 2**63, trees, dtype=np.uint64))
        for batch in batches:
            ids = batch.column(0)
            for chunk in chunks(batch.column(1), 1 << 19):
                sets = _sets(chunk, size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, _U)
                begin = np.concatenate([[0], np.cumsum(n[full])])[:-1]
                low = np.empty((len(full), trees * depth), _U)
                work = np.empty_like(flat)
                for k in range(trees * depth) if len(full) else ():
                    np.bitwise_xor(flat, flips[k], out=work)
                    np.multiply(work, factors[k], out=work)
                    low[:, k] = np.minimum.reduceat(work, begin)
                low = mix(low)
                sig = (low[:, :VALUES] >> _U(56)).astype(np.uint8)
                key = np.zeros((len(full), trees), _U) + salt
                for k in range(base):
                    key = mix(key ^ low[:, k::depth]) * _U(0x9FB21C651E98DF25)
                # Sixteen bits of each further value, in front those that come first.
                tail = np.zeros((len(full), trees), _U)
                for k in range(base, depth):
                    tail = tail << _U(16) | low[:, k::depth] >> _U(48)
                digests, sigs, keys, tails = ([None] * chunk.count for _ in range(4))
                for row, i in enumerate(full):
                    digests[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    sigs[i] = sig[row].tobytes()
                    keys[i], tails[i] = key[row].view(np.int64), tail[row].view(np.int64)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.first, chunk.count), pa.array(n), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, longs), pa.array(tails, longs)], names=_SKETCH.names)
        free_memory()
    return run


def _join_region(ids: np.ndarray, sig: np.ndarray, least: int) -> np.ndarray:
    """The smallest member that each member is joined with, by estimated similarity; one pass of comparisons for each pivot.

    Members come in the order of their tree, so that the neighbours of longest common prefix are joined first and need no pass of their own.
    """
    n = len(ids)
    root = np.arange(n)
    for p in range(n):
        rest = np.flatnonzero(root[p + 1 :] != root[p]) + p + 1
        if len(rest):
            like = rest[(sig[rest] == sig[p]).sum(1) >= least]
            if len(like):
                old = np.unique(np.append(root[like], root[p]))
                root[np.isin(root, old)] = old[0]
    least_id = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least_id, root, ids)
    return least_id[root]


def _forester(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "key"):
            ids = table.column("doc_id").to_numpy()
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), -1)
            root = _join_region(ids, sig, least)
            away = root != ids
            if away.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(root[away])], names=["a", "b"])
    return run


def _linked(ids: np.ndarray, sets: list[np.ndarray], num: int, first: int = 0) -> np.ndarray:
    """The smallest member reachable from each over links 100 * both >= num * either, confirmed on full sets."""
    n = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(flat)))
    group = np.cumsum(new) - 1
    mine = np.argsort(of, kind="stable")
    edge = np.concatenate([[0], np.cumsum(size)])
    root = np.arange(n)
    for p in range(n):
        rest = np.flatnonzero(root[p + 1 :] != root[p]) + p + 1
        if not len(rest):
            continue
        g = group[mine[edge[p] : edge[p + 1]]]
        g = g[count[g] > 1]
        if not len(g):
            continue
        c = count[g]
        at = np.repeat(begin[g] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
        both = np.bincount(of[at], minlength=n)[rest]
        like = rest[(both > 0) & (100 * both >= num * (size[p] + size[rest] - both))]
        if len(like):
            old = np.unique(np.append(root[like], root[p]))
            root[np.isin(root, old)] = old[0]
    return root


def _confirmer(size: int, num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "task"):
            ids, texts = table.column("doc_id").to_numpy(), table.column("text")
            order = np.argsort(ids)
            sets = [s for chunk in chunks(texts) for s in _sets(chunk, size)]
            root = _linked(ids[order], [sets[i] for i in order], num)
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ids[order][root])], names=["a", "b"])
        free_memory()
    return run


def _regions(space: Space, found: DataFrame, region: int, name: str, trees: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of sketches (doc_id, component, keys, tails): the regions (doc_id, tree, key, tail) with at most ``region`` members, and the crowded ones (doc_id, key, n).

    Regions whose members are all of one component are left out: nothing in them is left to be joined. ``trees`` may give the first tree and the one
    behind the last. Crowded regions are cut, in the order of their next values, at quantiles of these; members that agree in all of the next
    values are dealt out by doc_id if they are too many.
    """
    values = F.arrays_zip("keys", "tails")
    first = trees[0] if trees else 0
    values = F.slice(values, first + 1, trees[1] - first) if trees else values
    flat = found.select("doc_id", "component", F.posexplode(values).alias("tree", "v")).select("doc_id", "component", (F.col("tree") + first).alias("tree"), F.col("v.keys").alias("key"), F.col("v.tails").alias("tail"))
    shared = flat.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b")).where("n > 1 and a <> b").select("key", "n")
    met = space.save(flat.join(shared, "key").select("doc_id", "tree", "key", "tail", "n"), name)
    crowded = met.where(F.col("n") > region)
    # The upper 52 bits of the next values, as quantiles are taken of floating-point numbers.
    upper = F.shiftright("tail", 12)
    shares = ", ".join(f"{k / CUTS!r}D" for k in range(1, CUTS))
    cuts = crowded.groupBy("key").agg(F.expr(f"percentile_approx(shiftright(tail, 12), array({shares}), {20 * CUTS})").alias("cuts"))
    placed = crowded.join(cuts, "key").withColumn("at", F.size(F.filter("cuts", lambda c: c <= upper))).withColumn("equal", F.size(F.filter("cuts", lambda c: c == upper)))
    part = F.floor(F.col("at") / F.greatest(F.lit(1), F.floor(F.lit(CUTS * region) / (2 * F.col("n")))))
    deal = F.when(F.col("equal") > 0, F.pmod(F.xxhash64("doc_id"), F.ceil((F.col("equal") + 1) * F.col("n") / (CUTS * region)))).otherwise(0)
    cut = placed.select("doc_id", "tree", F.xxhash64("key", part, deal).alias("key"), "tail")
    return met.where(F.col("n") <= region).select("doc_id", "tree", "key", "tail").unionByName(cut), crowded.select("doc_id", "key", "n")


def _salted(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """Join on ``key``, of which ``other`` has each once; rows of a frequent key are dealt to several tasks."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    return rows.join(other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), [key, "_salt"], how).drop("_salt")


def _crowded(space: Space, hot: DataFrame, families: DataFrame, name: str) -> DataFrame:
    """The rows (doc_id, key) of crowded regions whose members aren't all in one family."""
    placed = hot.join(families.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    return space.save(_salted(placed.select("doc_id", "key"), mixed, "key"), name)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, trees: int = 20, base: int = 4, region: int = 1000, block: int = 2_000_000, deeper: tuple[tuple[int, int], ...] = ((64, 8), (160, 12))) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; shingles are runs of ``words`` of them, or the whole
    sequence if there are fewer. Two documents are linked if 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest doc_id reachable over links; kept says whether it is the row's own. ``deeper`` lists (trees, base) of the
    further forests for crowded regions.

    Null or empty texts and texts without words have no shingles and stand alone. Equal texts are linked. Rows that share a
    doc_id stand for one document: copies of a row stay together, and where their texts differ, links are confirmed on the
    greatest text. Rows without a doc_id are in no group: their component is that of an equal text if there is one, else null,
    and only the latter are kept. Other columns are not looked at. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    sketch = space.save(docs.mapInArrow(_sketcher(words, trees, base, 7), _SKETCH), "sketch")
    some = sketch.where("digest is not null and doc_id is not null")
    classes = space.save(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sketch.where("digest is not null").join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"])
    texts = docs.join(reps.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text")) if _repeats(sketch) else texts

    # The forests. In the first one, some trees join most of what belongs together; the others then only look at regions where different families
    # meet. Every frame of joins is read from the shared folder.
    families = None
    for level, (n_trees, depth) in enumerate(((trees, base), *deeper)):
        if level:
            met = texts.join(flagged.select("doc_id").distinct(), "doc_id", "left_semi")
            found = space.save(met.mapInArrow(_sketcher(words, n_trees, depth, 7 + level), _SKETCH).where("digest is not null").select("doc_id", "sig", "keys", "tails"), f"sketch-{level}")
        else:
            found = reps.select("doc_id", "sig", "keys", "tails")
        values, t = min(VALUES, n_trees * (depth + MORE)), percent / 100
        least = max(1, math.floor(values * t - 5.5 * math.sqrt(values * t * (1 - t))))
        hots = []
        for part in ((0, n_trees),) if level or n_trees <= 4 else ((0, 4), (4, n_trees)):
            name = f"{level}-{part[0]}"
            known = found.select("doc_id", "keys", "tails")
            known = known.withColumn("component", F.col("doc_id")) if families is None else known.join(families.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            own, hot = _regions(space, known, region, f"regions-{name}", part)
            hots.append(hot)
            rows = own.join(found.select("doc_id", "sig"), "doc_id")
            more = rows.repartition("key").sortWithinPartitions("key", "tail", "doc_id").select("key", "doc_id", "sig").mapInArrow(_forester(least), "a long, b long")
            more = space.save(more.distinct(), f"joins-{name}")
            # What has been joined before goes on as stars.
            stars = more if families is None else more.union(families.select(F.col("node").alias("a"), F.col("component").alias("b")))
            families = space.save(connected_components(spark, stars, space, f"families-{name}"), f"families-{name}")
        flagged = _crowded(space, functools.reduce(DataFrame.union, hots), families, f"crowded-{level}")
        if flagged.isEmpty():
            break
    # What is crowded in the last forest too is confirmed whole.
    if not flagged.isEmpty():
        stars = flagged.groupBy("key").agg(F.min("doc_id").alias("b"))
        stars = _salted(flagged, stars, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").union(families.select("node", "component"))
        families = space.save(connected_components(spark, stars, space, "families-all"), "families-all")

    size = sketch.where("digest is not null and doc_id is not null").groupBy("doc_id").agg(F.max("n_shingles").alias("n"))
    families = space.save(families.withColumnRenamed("node", "doc_id").join(size, "doc_id"), "sized")
    total = families.groupBy("component").agg(F.sum("n").alias("total"))
    sized = space.save(_salted(families, total, "component"), "whole")

    def confirmed(groups: DataFrame, name: str) -> DataFrame:
        """Links inside groups (doc_id, n, key, total): each against the others on full sets, a pair of blocks a task."""
        groups = space.save(groups, f"{name}-groups")
        run = Window.partitionBy("key").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
        large = groups.where(F.col("total") > block).withColumn("blk", F.floor(F.coalesce(F.sum("n").over(run), F.lit(0)) / block))
        n_blocks = large.groupBy("key").agg((F.max("blk") + 1).alias("blks"))
        pairs = large.join(n_blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blks") - 1))).where("blks = 1 or other <> blk")
        tasks = pairs.select("doc_id", F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("task")).union(groups.where(F.col("total") <= block).select("doc_id", F.col("key").alias("task")))
        work = texts.join(tasks, "doc_id")
        return space.save(work.repartition("task").sortWithinPartitions("task").select("task", "doc_id", "text").mapInArrow(_confirmer(words, percent), "a long, b long"), f"{name}-links")

    small = sized.where(F.col("total") <= block).select("doc_id", "n", F.xxhash64(F.lit(0), "component").alias("key"), "total")
    large = sized.where(F.col("total") > block).select("doc_id", "n", F.col("component").alias("family"))
    links = confirmed(small, "small")
    if not large.isEmpty():
        large = space.save(large, "large")

        def weighed(rows: DataFrame, name: str) -> DataFrame:
            each = space.save(rows.select("doc_id", "key").join(large.select("doc_id", "n"), "doc_id"), name)
            return _salted(each, each.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("m")).where("m > 1").drop("m"), "key")

        # The forests once more, each family on its own and by what has been confirmed so far, whatever the estimates have joined: crowded regions
        # whose members aren't all linked go on to the next forest, and are compared whole after the last.
        own_keys = F.transform("keys", lambda k: F.xxhash64(k, F.col("family")))
        so_far = None
        for level, (n_trees, depth) in enumerate(((trees, base), *deeper)):
            if level:
                met = texts.join(flagged.select("doc_id").distinct(), "doc_id", "left_semi")
                found = met.mapInArrow(_sketcher(words, n_trees, depth, 7 + level), _SKETCH).where("digest is not null").select("doc_id", "keys", "tails")
            else:
                found = reps.select("doc_id", "keys", "tails")
            found = space.save(found.join(large, "doc_id").select("doc_id", own_keys.alias("keys"), "tails"), f"large-sketch-{level}")
            hots = []
            for part in ((0, n_trees),) if level or n_trees <= 2 else ((0, 2), (2, n_trees)):
                name = f"large-{level}-{part[0]}"
                known = found.withColumn("component", F.col("doc_id")) if so_far is None else found.join(so_far.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
                own, hot = _regions(space, known, region, name, part)
                hots.append(hot)
                links = links.union(confirmed(weighed(own, f"{name}-members"), name))
                so_far = space.save(connected_components(spark, links, space, f"cc-{name}"), f"so-far-{name}")
            flagged = _crowded(space, functools.reduce(DataFrame.union, hots), so_far, f"large-crowded-{level}")
            if flagged.isEmpty():
                break
        if not flagged.isEmpty():
            links = links.union(confirmed(weighed(flagged, "large-all-members"), "large-all"))
    whole = connected_components(spark, links, space, "cc")

    found = classes.join(whole.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(found, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _repeats(sketch: DataFrame) -> bool:
    """Whether a doc_id occurs twice."""
    return not sketch.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
