import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from quillspark.llm._graph import connected_components
from quillspark.llm._space import Space
from quillspark.llm.neardup import _regions, _sketcher, near_duplicates

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size, percent):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 2_000_000), (5, 80, 150)])
def test_against_brute_force(docs, rows, size, percent, block):
    got = near_duplicates(docs, words=size, percent=percent, block=block).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows)
    for r in got:
        n, c = want[r["doc_id"]]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (n, c, c == r["doc_id"]), r


def test_nulls_and_empty(spark, none):
    assert near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "some words that nobody else has here"), (5, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got == {None: (3, None, True), 5: (0, 5, True), 6: (0, 6, True)}


def test_chain(spark):
    """A chain of links reaches from end to end."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 50), (60, 61), (61, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(spark, edges, Space(spark, "t")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 60: 60, 61: 60}


def test_crowded_region(spark, rows):
    """Narrow regions make the forest go deeper; equal signatures still meet."""
    base = rows[0][1]
    many = [(i, base + f" end{i % 7}") for i in range(60)]
    got = near_duplicates(spark.createDataFrame(many, "doc_id long, text string"), 3, 85, region=5, block=400).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_n, c) in brute(many, 3, 85).items()}


@pytest.mark.parametrize("deeper", [((64, 8), (160, 12)), ()])
def test_no_link_is_lost_in_crowded_regions(spark, deeper):
    """Hundreds of different texts share most of a page, so regions are crowded in every tree; each has one near copy. All links are found."""
    rng = random.Random(21)
    page = prose(rng, 60)
    rows = []
    for i in range(0, 600, 2):
        words = (page + " " + prose(rng, 25) + f" own{i}").split()
        rows.append((i, " ".join(words)))
        for _ in range(rng.randrange(1, 3)):
            words[rng.randrange(len(words))] = f"edit{i}"
        rows.append((i + 1, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, region=20, block=3000, deeper=deeper).collect()}
    assert got == {i: c for i, (_n, c) in brute(rows, 3, 85).items()}
    assert len(set(got.values())) > 200


def test_regions(spark):
    """Parts of crowded regions are runs of the tree's order, bounded, and what is crowded is known."""
    rng = random.Random(2)
    rows = [(i, [1, 100 + i % 50], [rng.randrange(3) << 48 | rng.randrange(40) << 32, 7]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, keys array<long>, tails array<long>").withColumn("component", F.col("doc_id"))
    own, hot = _regions(Space(spark, "t"), df, 100, "r")
    size = Counter(r["key"] for r in own.collect())
    assert max(size.values()) <= 100 and {r["key"] for r in hot.collect()} == {1} and hot.count() == 1000
    parts = defaultdict(set)
    for r in own.where("tree = 0").collect():
        parts[r["key"]].add(r["tail"] >> 32)
    runs = sorted((min(v), max(v)) for v in parts.values())
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:], strict=False)) and sum(n for k, n in size.items() if k in parts) == 1000
    joined, _ = _regions(Space(spark, "t2"), df.withColumn("component", F.when(F.col("doc_id") < 500, 0).otherwise(F.col("doc_id"))), 2000, "r", (1, 2))
    assert {r["tree"] for r in joined.collect()} == {1} and joined.count() == 1000
    assert _regions(Space(spark, "t3"), df.withColumn("component", F.lit(0).cast("long")), 100, "r")[0].count() == 0


def test_estimates(spark):
    """The share of equal values is the similarity of the sets, without bias and with the spread of independent draws."""
    rng = random.Random(5)
    off = []
    for k in range(60):
        a = [f"w{k}x{j}" for j in range(400)]
        b = a[: rng.randrange(100, 390)] + [f"v{k}x{j}" for j in range(100)]
        batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([" ".join(a), " ".join(b)])], names=["doc_id", "text"])
        sig = [np.frombuffer(x.as_py(), np.uint8) for x in next(iter(_sketcher(3, 20, 4, 7)(iter([batch])))).column("sig")]
        x, y = shingles(" ".join(a), 3), shingles(" ".join(b), 3)
        s = len(x & y) / len(x | y)
        off.append(((sig[0] == sig[1]).mean() - s - (1 - s) / 256) / np.sqrt(s * (1 - s) / len(sig[0])))
    assert abs(np.mean(off)) < 0.5 and 0.7 < np.std(off) < 1.3


def test_no_link_is_lost_in_a_large_family(spark):
    """Texts that share four fifths of their shingles are one family by estimates, which is too large for one task; its regions are crowded. All links are found."""
    rng = random.Random(22)
    page = prose(rng, 100)
    rows = []
    for i in range(0, 500, 2):
        words = (page + " " + prose(rng, 9) + f" own{i}").split()
        rows.append((i, " ".join(words)))
        for k in rng.sample(range(2, 100, 3), 2):
            words[k] = f"edit{i}"
        rows.append((i + 1, " ".join(words)))
    rng.shuffle(rows)
    rows = [(k, text) for k, (_i, text) in enumerate(rows)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, region=10, block=3000, deeper=()).collect()}
    assert got == {i: c for i, (_n, c) in brute(rows, 3, 85).items()}
    assert len(set(got.values())) > 150


@pytest.mark.parametrize("few", [0, 1000])
def test_few_edges(spark, monkeypatch, few):
    """Few edges are joined on the driver, many by steps of jobs; components are the same."""
    monkeypatch.setattr("quillspark.llm._graph.FEW", few)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 50), (60, 61), (61, 60), (70, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(spark, edges, Space(spark, "t"), f"few{few}").collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 60: 60, 61: 60, 70: 0}
