"""Vectorised work on the UTF-8 bytes of whole batches of texts (numpy on Arrow buffers, no loop over characters)."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: White space of the word pattern ``[^\x20\x09-\x0D]+``; all of it is ASCII, so it is safe to look for it in UTF-8 bytes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: First bytes of code points.
LEAD = (np.arange(256) & 0xC0) != 0x80
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_pow = np.ones(1, _U)
_inv = np.ones(1, _U)
_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_CODE_LOWER = _CODE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all of them."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, _BASE, _U)
        steps[0] = 1
        _pow = np.multiply.accumulate(steps)
        steps[1:] = _U(pow(_BASE, -1, 1 << 64))
        _inv = np.multiply.accumulate(steps)
    return _pow, _inv


def free_memory() -> None:
    """Gives back what the allocators of a Python worker hold but don't use; workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Chunk:
    """Some consecutive texts of a batch: their bytes end to end, and where each begins and ends."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets
        self.count = len(offsets) - 1
        self._sums: dict[bool, np.ndarray] = {}

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each word; words never cross texts."""
        data, offsets = self.data, self.offsets
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none
        space = SPACE[data]
        before, after = np.empty(len(data), bool), np.empty(len(data), bool)
        before[0] = after[-1] = True
        before[1:], after[:-1] = space[:-1], space[1:]
        begins, ends = offsets[:-1], offsets[1:]
        before[begins[begins < len(data)]] = True
        after[ends[ends > 0] - 1] = True
        starts = np.flatnonzero(before & ~space)
        stops = np.flatnonzero(after & ~space) + 1
        return starts, stops, np.searchsorted(offsets, starts, "right") - 1

    def hashes(self, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each piece of the bytes (of its ASCII-lower-cased form)."""
        power, inverse = _powers(len(self.data) + 1)
        if lower not in self._sums:
            sums = np.zeros(len(self.data) + 1, _U)
            np.cumsum((_CODE_LOWER if lower else _CODE)[self.data] * power[: len(self.data)], out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        return mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(_U))


def chunks(texts: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[Chunk]:
    """The texts in chunks of about ``most`` bytes (a longer text is a chunk of its own); null counts as empty."""
    parts = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    first = 0
    for part in parts:
        part = part.cast(pa.large_string()) if not pa.types.is_large_string(part.type) else part
        if part.null_count:
            part = part.fill_null("")
        if len(part):
            _, offs, data = part.buffers()
            offsets = np.frombuffer(offs, np.int64)[part.offset : part.offset + len(part) + 1]
            whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            at = 0
            while at < len(part):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
                yield Chunk(first + at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                at = to
        first += len(part)


def shingles(chunk: Chunk, size: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of ``size`` words; a text with fewer words, but some, has its whole sequence as one.

    The result is ordered by text. Sequences of other lengths never hash alike by construction.
    """
    starts, stops, text = chunk.words()
    h = chunk.hashes(starts, stops, lower)
    n = len(h) - size + 1
    per_text = np.bincount(text, minlength=chunk.count)
    out, of = np.zeros(0, _U), np.zeros(0, np.int64)
    step = _U(0x9FB21C651E98DF25)
    if n > 0:
        full = text[:n] == text[size - 1 :]
        out = h[:n].copy()
        for k in range(1, size):
            out *= step
            out += h[k : n + k]
        out, of = mix(out[full]), text[:n][full]
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(per_text)])
        extra = np.empty(len(short), _U)
        for i, d in enumerate(short):
            v = int(per_text[d])
            for x in h[begin[d] : begin[d + 1]].tolist():
                v = (v * int(step) + x) & 0xFFFFFFFFFFFFFFFF
            extra[i] = v
        out, of = np.concatenate([out, mix(extra)]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as one table each; the batches must be sorted by the key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for a, b in zip(edges, edges[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
