"""Exact removal of repeated substrings, by prefix-free parsing.

The bytes of each document are parsed at *triggers*: places whose rolling hash over ``key`` bytes is the least among all that a string of ``span``
bytes holds. So every string of ``span`` bytes has one trigger, at the same distance wherever the string stands, and consecutive strings
with the same trigger make up its *phrase*. Phrases overlap by less than ``span`` bytes. Distinct phrases are the
dictionary, and a document is the sequence of its phrases (the parse); repetitive text has few distinct phrases.

1. *Parse.* Tasks parse their documents and sort the phrases by (trigger hash, phrase hash, doc_id). A phrase that a smaller doc_id of the same task
   has is covered at once; only its first document goes on. The rest is dealt by trigger hash, packed in columns.
2. *Dictionary.* Equal phrases meet: all but the smallest doc_id's are covered. Phrases that share a trigger but differ may still share
   strings; only those go on.
3. *Corpus order.* The bytes around those triggers are sorted: the suffix array of the dictionary at each trigger, continued along the parse as far as
   a string of ``span`` bytes reaches. For each distance from a string's start to its trigger, runs whose longest common prefix reaches the string's
   end are LCP intervals; within one, equal left parts are equal strings, and the interval's smallest doc_id covers the others.
4. *Removal.* Covered ranges are united per document, and what remains is put together.

Matches are decided on the input. Positions are bytes of the UTF-8 form. A hash of 64 bits stands for the phrase in step 2 and for the left part in
step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm._bytes import _CODE, Chunk, _powers, chunks, grouped, mix
from quillspark.llm._space import Space, free_shuffles

_U = np.uint64
#: Columns of packed entries: trigger hash, phrase hash, document, number of its text, start of its first string, number of strings, distance to the trigger.
#: Type and number of bytes that are kept: 48 bits of each hash are enough, as buckets, places and the bytes themselves tell the rest apart.
_ENTRY = (("k", "<u8", 6), ("e", "<u8", 6), ("doc", "<i8", 8), ("sub", "<u4", 4), ("lo", "<u4", 4), ("n", "u1", 1), ("off", "u1", 1))
_SEEK = (("k", "<u8", 6), ("doc", "<i8", 8), ("sub", "<u4", 4), ("lo", "<u4", 4), ("n", "u1", 1), ("off", "u1", 1))
_COVER = (("doc", "<i8", 8), ("sub", "<u4", 4), ("lo", "<u4", 4), ("size", "<u4", 4))
_ROWS = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("data", T.BinaryType())])
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

Columns = dict[str, np.ndarray]


def _pack(cols: Columns, layout: tuple, at: np.ndarray) -> bytes:
    """Columns byte by byte (all first bytes, all second ones, ...), so that high zero bytes compress to nothing."""
    return b"".join(np.ascontiguousarray(cols[n][at].astype(t)).view(np.uint8).reshape(len(at), -1)[:, :kept].T.tobytes() for n, t, kept in layout)


def _unpack(blobs: list[bytes], layout: tuple) -> Columns:
    width = sum(kept for *_t, kept in layout)
    out: dict[str, list[np.ndarray]] = {n: [] for n, *_t in layout}
    for b in blobs:
        count, at = len(b) // width, 0
        for n, t, kept in layout:
            full = np.zeros((count, np.dtype(t).itemsize), np.uint8)
            full[:, :kept] = np.frombuffer(b, np.uint8, count * kept, at).reshape(kept, count).T
            out[n].append(full.view(t).reshape(count))
            at += count * kept
    return {n: np.concatenate(v) if v else np.zeros(0, t) for (n, t, _k), v in zip(layout, out.values(), strict=True)}


def _deal(kind: int, cols: Columns, layout: tuple, bucket: np.ndarray) -> pa.RecordBatch | None:
    """Entries packed by bucket, one row each."""
    if not len(bucket):
        return None
    order = np.lexsort((cols["lo"], cols["doc"], bucket))
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    parts = np.split(order, cuts)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), kind, np.int32)), pa.array([int(bucket[p[0]]) for p in parts], pa.int64()), pa.array([_pack(cols, layout, p) for p in parts], pa.binary())], names=_ROWS.names)


def _doc_bucket(doc: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a document; its rows' ``bucket`` is computed alike in SQL."""
    return doc.astype(np.int64) % buckets


def _slide(a: np.ndarray, n: int, f) -> np.ndarray:
    """f over each run of n values, by doubling."""
    step = 1
    while step * 2 <= n:
        a = f(a[:-step], a[step:])
        step *= 2
    return f(a[: len(a) - (n - step)], a[n - step :]) if n > step else a


def parse(chunk: Chunk, span: int, key: int) -> Columns:
    """The phrases of a chunk's texts: text, place of the trigger, first string, number of strings, trigger hash and phrase hash."""
    data, n = chunk.data, len(chunk.data)
    if n < span:
        return {c: np.zeros(0, np.int64) for c in ("text", "t", "lo", "n")} | {c: np.zeros(0, _U) for c in ("k", "e")}
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_CODE[data] * power[:n], out=sums[1:])
    rolling = mix((sums[key:] - sums[:-key]) * inverse[: n - key + 1])
    # The least of the upper half of the hash and, among equals, of the place: a property of the string alone.
    least = _slide((rolling >> _U(32) << _U(32)) | np.arange(len(rolling), dtype=_U), span - key + 1, np.minimum)
    begin, end = chunk.offsets[:-1], chunk.offsets[1:]
    has = end - begin >= span
    change = np.zeros(n + 2, np.int32)
    np.add.at(change, begin[has], 1)
    np.add.at(change, end[has] - span + 1, -1)
    string = np.flatnonzero(np.cumsum(change[: len(least)]) > 0)  # strings never cross texts
    place = (least[string] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(_runs(place)) if len(place) else place
    t, lo, hi = place[first], string[first], string[np.append(first[1:], len(place)) - 1] if len(place) else place
    text = np.searchsorted(chunk.offsets, t, "right") - 1
    e = mix((sums[hi + span] - sums[lo]) * inverse[lo] + (t - lo).astype(_U) * _U(0x9FB21C651E98DF25))
    return {"text": text, "t": t, "lo": lo, "n": hi - lo + 1, "k": rolling[t], "e": e}


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _covered(c: Columns, at: np.ndarray, span: int) -> Columns:
    return {"doc": c["doc"][at], "sub": c["sub"][at], "lo": c["lo"][at], "size": c["n"][at].astype(np.int64) + span - 1}


def _parser(span: int, key: int, buckets: int, doc_buckets: int, flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Columns] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            c = {n: np.concatenate([h[n] for h in held]) for n, *_t in _ENTRY}
            order = np.lexsort((c["doc"], c["e"], c["k"]))
            c = {n: v[order] for n, v in c.items()}
            new = _runs(c["k"], c["e"])
            first = c["doc"][np.flatnonzero(new)][np.cumsum(new) - 1] if len(new) else c["doc"]
            later = np.flatnonzero(c["doc"] > first)
            covers = _covered(c, later, span)
            for b in (_deal(1, covers, _COVER, _doc_bucket(covers["doc"], doc_buckets)), _deal(0, {n: v[c["doc"] == first] for n, v in c.items()}, _ENTRY, (c["k"][c["doc"] == first] % _U(buckets)).astype(np.int64))):
                if b:
                    yield b

        for batch in batches:
            ids, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in chunks(batch.column(2), 1 << 20):
                p = parse(chunk, span, key)
                at = p["text"] + chunk.first
                held.append({"k": p["k"], "e": p["e"], "doc": ids[at], "sub": subs[at], "lo": p["lo"] - chunk.offsets[p["text"]], "n": p["n"], "off": p["t"] - p["lo"]})
                size += len(chunk.data)
                if size >= flush:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()
    return run


def _dictionary(span: int, doc_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "bucket"):
            kinds = table.column("kind").to_numpy()
            for b in table.filter(pa.array(kinds == 1)).to_batches():
                yield b
            c = _unpack(table.filter(pa.array(kinds == 0)).column("data").to_pylist(), _ENTRY)
            if not len(c["k"]):
                continue
            order = np.lexsort((c["doc"], c["e"], c["k"]))
            c = {n: v[order] for n, v in c.items()}
            of_k, of_e = _runs(c["k"]), _runs(c["k"], c["e"])
            first = c["doc"][np.flatnonzero(of_e)][np.cumsum(of_e) - 1]
            full = c["doc"] > first
            covers = _covered(c, np.flatnonzero(full), span)
            group = np.cumsum(of_k) - 1
            phrases = np.bincount(group, of_e)
            start = np.flatnonzero(of_k)
            docs = np.maximum.reduceat(first, start) > np.minimum.reduceat(first, start)
            seek = np.flatnonzero(~full & (phrases > 1)[group] & docs[group])
            some = {n: c[n][seek] for n, *_t in _SEEK}
            for b in (_deal(1, covers, _COVER, _doc_bucket(covers["doc"], doc_buckets)), _deal(2, some, _SEEK, _doc_bucket(some["doc"], doc_buckets))):
                if b:
                    yield b
    return run


def _by_document(table: pa.Table) -> tuple[list[bytes], pa.Table]:
    """The packed entries and the texts of one bucket of documents."""
    kinds = table.column("kind").to_numpy()
    return table.filter(pa.array(kinds < 9)).column("data").to_pylist(), table.filter(pa.array(kinds == 9))


def _contexts(span: int, key: int, buckets: int):
    width = 2 * span - key  # a phrase's strings, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "bucket"):
            blobs, texts = _by_document(table)
            c = _unpack(blobs, _SEEK)
            if not len(c["k"]):
                continue
            order = np.lexsort((c["sub"], c["doc"]))
            c = {n: v[order] for n, v in c.items()}
            docs, subs = texts.column("doc").to_numpy(), texts.column("sub").to_numpy()
            data = texts.column("data")
            found: list[np.ndarray] = []
            rows: list[np.ndarray] = []
            a, b = np.searchsorted(c["doc"], docs, "left"), np.searchsorted(c["doc"], docs, "right")
            for i in np.flatnonzero(b > a):
                at = np.arange(a[i], b[i])
                at = at[c["sub"][at] == subs[i]]
                raw = np.frombuffer(data[int(i)].as_py(), np.uint8)
                place = c["lo"][at].astype(np.int64)[:, None] + np.arange(width)
                length = c["n"][at].astype(np.int64) + span - 1
                found.append(at)
                rows.append(np.where(np.arange(width) < length[:, None], raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint8))
            if not found:
                continue
            at, ctx = np.concatenate(found), np.concatenate(rows)
            got = {n: v[at] for n, v in c.items()}
            bucket = (got["k"] % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([int(bucket[part[0]])], pa.int64()), pa.array([len(part).to_bytes(8, "little") + _pack(got, _SEEK, part) + ctx[part].tobytes()], pa.binary())], names=_ROWS.names)
    return run


def shared_strings(c: Columns, ctx: np.ndarray, span: int, key: int) -> Columns:
    """Which strings at equal triggers a smaller doc_id also has, as covered ranges."""
    n, off, count = len(ctx), c["off"].astype(np.int64), c["n"].astype(np.int64)
    padded = np.pad(ctx, ((0, 0), (0, span + 6)))
    right = padded[np.arange(n)[:, None], off[:, None] + np.arange(span + 6)][:, :56]
    right[:, span:] = 0
    words = np.ascontiguousarray(right).view(">u8")
    order = np.lexsort((*[words[:, i] for i in range(words.shape[1] - 1, -1, -1)], c["k"]))
    c = {x: v[order] for x, v in c.items()}
    ctx, right, off, count = ctx[order], right[order], off[order], count[order]
    differ = right[1:] != right[:-1]
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), span)
    lcp[1:][c["k"][1:] != c["k"][:-1]] = 0
    power, inverse = _powers(ctx.shape[1] + 1)
    sums = np.zeros((n, ctx.shape[1] + 1), _U)
    np.cumsum(_CODE[ctx] * power[: ctx.shape[1]], axis=1, out=sums[:, 1:])
    hit = np.zeros((n, span - key + 1), bool)
    for a in range(span - key + 1):
        own = np.flatnonzero((off >= a) & (off - a < count))
        if len(own) < 2:
            continue
        interval = np.cumsum(lcp < span - a)[own]  # LCP intervals of this depth
        left = (sums[own, off[own]] - sums[own, off[own] - a]) * inverse[off[own] - a]
        by = np.lexsort((c["doc"][own], left, interval))
        new = _runs(interval[by], left[by])
        doc = c["doc"][own][by]
        later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        hit[own[by[later]], off[own[by[later]]] - a] = True
    row, j = np.nonzero(hit)
    new = _runs(row, j - np.arange(len(j)))
    start = np.flatnonzero(new)
    long_ = np.diff(np.append(start, len(j)))
    return {"doc": c["doc"][row[start]], "sub": c["sub"][row[start]], "lo": c["lo"][row[start]].astype(np.int64) + j[start], "size": long_ + span - 1}


def _orderer(span: int, key: int, doc_buckets: int):
    width = 2 * span - key
    each = sum(kept for *_t, kept in _SEEK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "bucket"):
            heads, bodies = [], []
            for blob in table.column("data").to_pylist():
                m = int.from_bytes(blob[:8], "little")
                heads.append(blob[8 : 8 + m * each])
                bodies.append(np.frombuffer(blob, np.uint8, m * width, 8 + m * each).reshape(m, width))
            c, ctx = _unpack(heads, _SEEK), np.concatenate(bodies)
            # Whole groups of a trigger at a time, some tens of thousands of entries.
            order = np.argsort(c["k"], kind="stable")
            edges = np.append(np.flatnonzero(_runs(c["k"][order])), len(order))
            a = 0
            while a < len(edges) - 1:
                b = max(a + 1, int(np.searchsorted(edges, edges[a] + 30_000, "right")) - 1)
                part = order[edges[a] : edges[b]]
                covers = shared_strings({n: v[part] for n, v in c.items()}, ctx[part], span, key)
                out = _deal(1, covers, _COVER, _doc_bucket(covers["doc"], doc_buckets))
                if out:
                    yield out
                a = b
    return run


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of the union; ranges that touch are one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, "bucket"):
        blobs, texts = _by_document(table)
        c = _unpack(blobs, _COVER)
        order = np.argsort(c["doc"], kind="stable")
        c = {n: v[order] for n, v in c.items()}
        ids, docs, subs = texts.column("doc_id").to_pylist(), texts.column("doc").to_numpy(), texts.column("sub").to_numpy()
        a, b = np.searchsorted(c["doc"], docs, "left"), np.searchsorted(c["doc"], docs, "right")
        rows = []
        for i, raw in enumerate(texts.column("data").to_pylist()):
            at = np.arange(a[i], b[i]) if ids[i] is not None else np.zeros(0, np.int64)
            at = at[c["sub"][at] == subs[i]]
            if not len(at):
                rows.append((ids[i], len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                continue
            lo = c["lo"][at].astype(np.int64)
            s, e = united(lo, lo + c["size"][at])
            kept = hashlib.sha256()
            last = 0
            for x, y in zip(s.tolist(), e.tolist(), strict=True):
                kept.update(raw[last:x])
                last = y
            kept.update(raw[last:])
            rows.append((ids[i], len(raw), int((e - s).sum()), len(s), kept.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, span: int = 50, key: int = 20, flush: int = 12_000_000) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes covered by a string of ``span`` bytes that also starts in a document with a smaller doc_id are removed; overlaps count, and
    strings never cross documents. A null text is an empty one. Rows without a doc_id are neither smaller nor larger than others: nothing
    is removed from them or because of them. Rows that share a doc_id don't cover each other; each is judged for itself. Texts shorter than ``span``
    bytes stay whole. Other columns are not looked at; an empty table gives an empty result. ``span`` is at most 50 here, ``key`` less.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count("doc_id"), F.countDistinct("doc_id")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = total[0] or 0
    # Every task deals to every bucket, so buckets are no more than parallel work and memory ask for.
    buckets = max(tasks, size // (16 << 20))
    doc_buckets = min(max(16, size // (4 << 20)), max(4 * tasks, size // (64 << 20)))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(0))).withColumn("sub", F.lit(0))
    if total[1] != total[2]:  # some doc_id has several rows: number its texts
        docs = docs.withColumn("sub", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("text")) - 1)

    parsed = docs.where("doc_id is not null").select("doc_id", "sub", "text").mapInArrow(_parser(span, key, buckets, doc_buckets, flush), _ROWS)
    # A bucket is a task of its own, so a task's input is bounded by what a bucket is meant to hold.
    dealt = lambda rows, n: rows.repartitionById(n, F.col("bucket").cast("int")).sortWithinPartitions("bucket")
    met = dealt(parsed, max(buckets, doc_buckets)).mapInArrow(_dictionary(span, doc_buckets), _ROWS)
    told = space.save(met, "told")
    free_shuffles(spark)

    # The texts and the entries that ask for them, by bucket of documents.
    placed = docs.select(F.lit(9).alias("kind"), F.pmod("doc", F.lit(doc_buckets).cast("long")).alias("bucket"), F.encode("text", "UTF-8").alias("data"), "doc", "sub", "doc_id")
    entry = lambda df: df.select("kind", "bucket", "data", F.lit(0).cast("long").alias("doc"), F.lit(0).alias("sub"), F.lit(None).cast("long").alias("doc_id"))
    asked = placed.where("doc_id is not null").unionByName(entry(told.where("kind = 2")))
    ctx = dealt(asked, doc_buckets).mapInArrow(_contexts(span, key, buckets), _ROWS)
    more = dealt(ctx, buckets).mapInArrow(_orderer(span, key, doc_buckets), _ROWS)
    more = space.save(more, "more")
    free_shuffles(spark)

    covers = entry(told.where("kind = 1")).unionByName(entry(more))
    return dealt(placed.unionByName(covers), doc_buckets).mapInArrow(_remover, _OUT)
