"""Quality rules on repetition: a suffix array of each text's words, its longest-common-prefix intervals, and limits on what they cover.

The suffixes of a text are sorted by prefix doubling (all texts of a batch at once, in numpy; only groups that are still
undecided are sorted again). Neighbours in suffix order whose common prefix has at least ``least`` words bound an interval of a
maximal repeated substring; the spans of both are united. A text fails if the united spans hold more than ``covered`` of its
words, or if one substring of more than ``longest`` words occurs twice.

Texts whose runs of ``least`` words are all different can have no such interval, so only the others are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._bytes import LEAD, SPACE, Chunk, _powers, chunks, mix
from quillspark.llm._space import small_batches

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_OUT = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("n_covered_words", T.LongType()), T.StructField("longest_repeat", T.LongType()), T.StructField("n_repeats", T.LongType()),
])


def _again(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + lengths, -1)
    return np.cumsum(depth[:n]) > 0


def suffix_array(symbols: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Suffixes of all texts in an order that is right inside each text; ``text`` is ascending, suffixes end with their text."""
    n = len(symbols)
    order = np.lexsort((symbols, text))
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (text[order][1:] != text[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 1
    while True:
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return order
        at = order[open_]
        to = at + step
        inside = to < n
        inside[inside] = text[to[inside]] == text[at[inside]]
        second = np.zeros(len(at), np.int64)
        second[inside] = rank[to[inside]] + 1
        by = rank[at] * (n + 1) + second
        by_order = np.argsort(by, kind="stable")
        order[open_], by = at[by_order], by[by_order]
        fresh = np.ones(len(by), bool)
        fresh[1:] = by[1:] != by[:-1]
        new[open_] = fresh
        rank[order[open_]] = np.maximum.accumulate(np.where(fresh, open_, 0))
        step *= 2


def common_prefixes(order: np.ndarray, h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order`` (0 for the first, and across texts)."""
    n = len(h)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(h * power[:n], out=sums[1:])
    end = np.searchsorted(text, text, "right")
    out = np.zeros(n, np.int64)
    pair = np.flatnonzero((text[order[1:]] == text[order[:-1]]) & (h[order[1:]] == h[order[:-1]])) + 1
    a, b = order[pair - 1], order[pair]
    room = np.minimum(end[a] - a, end[b] - b)
    got = np.zeros(len(pair), np.int64)
    bit = 1 << (int(room.max()).bit_length() - 1) if len(pair) else 0
    while bit:
        try_ = got + bit
        ok = np.flatnonzero(try_ <= room)
        x, y, t = a[ok], b[ok], try_[ok]
        same = (sums[x + t] - sums[x]) * inverse[x] == (sums[y + t] - sums[y]) * inverse[y]
        got[ok[same]] = t[same]
        bit >>= 1
    out[pair] = got
    return out


def maximal_intervals(lcp: list[int], differs: list[bool]) -> int:
    """How many longest-common-prefix intervals of a run of suffixes are of substrings that can't be extended to the left either.

    ``lcp`` are the prefixes of a run of neighbours that all share something, ``differs`` whether what stands before the two is different. An interval's
    substring can be extended to the left only if the same stands before all of its suffixes.
    """
    found, open_ = 0, []  # intervals that are still open: their prefix, and whether anything differs
    for value, mixed in zip([*lcp, 0], [*differs, False], strict=True):
        while open_ and open_[-1][0] > value:
            inner = open_.pop()[1]
            found += inner
            if open_ and open_[-1][0] >= value:
                open_[-1][1] |= inner
            else:
                mixed |= inner
        if open_ and open_[-1][0] == value:
            open_[-1][1] |= mixed
        elif value:
            open_.append([value, mixed])
    return found


def _measure(chunk: Chunk, least: int) -> list[np.ndarray]:
    starts, stops, text = chunk.words()
    n, count = len(starts), chunk.count
    per = lambda places, weights=None: np.bincount(places, weights, minlength=count).astype(np.int64)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[chunk.offsets])
    n_words = per(text)
    word_chars = sums(LEAD[chunk.data] & ~SPACE[chunk.data])
    n_symbols = sums(_SYMBOL[chunk.data])

    breaks = np.flatnonzero(chunk.data == 10)
    begins = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]), kind="stable")
    owner = np.concatenate([np.arange(count), np.searchsorted(chunk.offsets, breaks, "right") - 1])
    owner = np.sort(owner, kind="stable")
    ends = np.append(begins[1:], len(chunk.data))
    last = np.append(owner[1:] != owner[:-1], True)
    ends = np.where(last, ends, ends - 1)
    solid = np.concatenate([[0], np.cumsum(~SPACE[chunk.data])])
    real = np.flatnonzero(solid[ends] > solid[begins])
    keys = mix(chunk.hashes(begins[real], ends[real]) ^ mix(owner[real].astype(_U) + _U(1)))
    n_dup_lines = per(owner[real]) - per(owner[real][np.unique(keys, return_index=True)[1]])

    h = chunk.hashes(starts, stops)
    power, inverse = _powers(n + 1)
    running = np.zeros(n + 1, _U)
    np.cumsum(h * power[:n], out=running[1:])

    def windows(size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        keys = mix((running[at + size] - running[at]) * inverse[at] ^ mix(text[at].astype(_U) + _U(1)))
        return at, _again(keys)

    at, twice = windows(3)
    n_repeat_words = per(text[_covered(at[twice], 3, n)] if n else text)

    at, twice = windows(least)
    some = np.unique(text[at[twice]])
    n_covered, longest, n_repeats = np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    if len(some):
        use = np.isin(text, some)
        sub, sub_text = h[use], text[use]
        order = suffix_array(sub, sub_text)
        lcp = common_prefixes(order, sub, sub_text)
        hit = np.flatnonzero(lcp >= least)
        flags = _covered(np.concatenate([order[hit - 1], order[hit]]), np.concatenate([lcp[hit], lcp[hit]]), len(sub))
        n_covered = per(sub_text[flags])
        np.maximum.at(longest, sub_text[order[hit]], lcp[hit])
        # What stands before each suffix, and whether it differs from what stands before its neighbour; the start of a text differs from everything.
        inner = (order > 0) & (sub_text[order] == sub_text[order - 1])
        before = np.where(inner, sub[order - 1], _U(0))
        differs = np.append(True, (before[1:] != before[:-1]) | ~inner[1:] | ~inner[:-1])
        edges = np.append(np.flatnonzero(np.diff(hit) > 1) + 1, len(hit))
        a = 0
        for b in edges.tolist() if len(hit) else ():
            n_repeats[sub_text[order[hit[a]]]] += maximal_intervals(lcp[hit[a:b]].tolist(), differs[hit[a:b]].tolist())
            a = b
    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered, longest, n_repeats]


def repetition_rules(docs: DataFrame, least: int = 10, covered: float = 0.5, longest: int = 60) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the measures and the verdict.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or more than half of
    them in repeated runs of three), kept, n_covered_words, longest_repeat (words), n_repeats (different maximal repeated
    substrings of ``least`` words or more). A null text is an empty one: no words, so base_failed. Repeated rows give repeated results; other
    columns are not looked at; an empty table gives an empty result. Texts are read whole, of any length.
    Covered words lie in repeated runs of three, so ``covered`` decides nothing that base_failed doesn't unless it is below 0.5.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), 1 << 19):
                n, chars, symbols, lines, repeat, cov, long_, many = _measure(chunk, least)
                failed = (n < 50) | (100 * repeat > 50 * n)
                kept = ~failed & (cov <= covered * n) & (long_ <= longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, chunk.count), *map(pa.array, (n, chars, symbols, lines, repeat, failed, kept, cov, long_, many))], names=_OUT.names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)
