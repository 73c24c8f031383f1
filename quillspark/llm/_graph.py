"""Connected components of a large graph, with DataFrames only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._space import Space

SALTS = 8
#: At most so many different edges, of 16 bytes each, are put together on the driver.
FEW = 100_000


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges and the smallest node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return nodes, nodes[root]
        # The larger root of each edge goes below the smallest that it meets; then all nodes are led to their roots.
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def connected_components(spark: SparkSession, edges: DataFrame, space: Space, name: str = "cc") -> DataFrame:
    """``edges`` (a long, b long) -> one row (node, component) for each node of an edge; component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014); at most ``FEW`` edges, which are counted first, are joined on the driver
    instead, as each step costs several jobs. Each round is written to the shared folder; the loop ends when a round leaves the edge set as it was. Minima are combined before each shuffle, so a node with very
    many edges costs one row per map task, and its edges are joined back in several tasks.
    Self-loops and repeated edges are allowed; an empty input gives an empty result.
    """

    def least(both: DataFrame) -> DataFrame:
        return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def met(both: DataFrame, low: DataFrame) -> DataFrame:
        # The edges of a node with very many are dealt to several tasks; each has the node's minimum.
        salts = F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)]))
        return both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(low.withColumn("s", salts), ["u", "s"]).select(F.col("v").alias("a"), F.col("m").alias("b"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        return met(both.where("v > u"), least(both))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = least(down)
        return met(down, low).union(low.select("u", "m"))

    def saved(e: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        # The table and a mark of what it holds, in one job.
        seen = Observation()
        told = e.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)).alias("h"))
        table = space.save(told, f"{name}-{k}")
        return table, (seen.get["n"], seen.get["h"])

    now, mark = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    loops = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    all_loops = loops.select("node", F.col("node").alias("component"))
    if 0 < mark[0] <= FEW:
        few = now.toArrow()
        nodes, least_of = _joined(*(few.column(c).to_numpy() for c in "ab"))
        found = space.save(spark.createDataFrame(pa.table({"node": nodes, "component": least_of})), f"{name}-few")
        return found.union(all_loops).groupBy("node").agg(F.min("component").alias("component"))
    k, last = 0, None
    while mark[0] and mark != last:
        k, last = k + 1, mark
        now, mark = saved(small(large(now)).where("a <> b").distinct(), k)
        space.drop(f"{name}-{k - 1}")
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return found.union(roots).union(all_loops).groupBy("node").agg(F.min("component").alias("component"))
