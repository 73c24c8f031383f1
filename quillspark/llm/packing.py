"""Best-fit packing of tokenised documents into sequences, by a linear grouping scheme.

Only the histogram of piece lengths matters for the plan, and it has at most ``size`` entries whatever the corpus holds. So the
driver plans on counts, and executors then look up where each piece goes:

1. Texts are tokenised whole; documents longer than a sequence are cut, and full pieces are sequences of their own.
2. *Linear grouping*: lengths above ``small`` are sorted and cut into groups of equal cardinality; each length is rounded up to the
   largest of its group. How often to use which configuration of these few sizes is a linear program, solved exactly by column
   generation: a revised simplex over the groups, priced by a knapsack recursion. Small lengths take part as tokens that fill
   what room configurations leave. Numbers are rounded down; configurations whose fraction was largest are then used once more, as
   far as pieces are left for them.
3. *Substitution*: the real lengths take the places of their group, longest first, which frees the room that rounding cost.
4. *Best fit*: small lengths, and the few large ones that rounding down has left, longest first, each go where the least room remains that
   holds them.

Sequences with equal contents are held as one class with a multiplicity, so the plan's size follows the number of distinct
lengths and configurations, not the number of documents.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.llm._bytes import chunks, free_memory
from quillspark.llm._space import Space

_PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "row_key"))])


def tokenizer_spec(name: str) -> str:
    """The text of an installed public tokenizer file (a few MB; it travels to the executors with the task)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


class _Index(dict):
    """Keys to their numbers; an unknown key gets the next number and is noted."""

    def __init__(self):
        self.new: list = []
        self.next = 0

    def __missing__(self, key):
        self[key] = k = self.next
        self.next += 1
        self.new.append(key)
        return k


class _Table:
    """Numbered keys and the ids of each, end to end."""

    def __init__(self):
        self.index = _Index()
        self.flat = np.zeros(1 << 20, np.uint32)
        self.begin = np.zeros(1, np.int64)

    def add(self, size: np.ndarray, ids: np.ndarray) -> None:
        """The ids of the keys that were noted since the last call, in their order."""
        used = int(self.begin[-1])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + len(ids)] = ids
        self.begin = np.concatenate([self.begin, used + np.cumsum(size)])
        self.index.new = []

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these keys end to end, and how many each has."""
        begin = self.begin[number]
        size = self.begin[number + 1] - begin
        ends = np.cumsum(size)
        return self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], size


class WordEncoder:
    """Ids of texts by a byte-level tokenizer with word ends, which lower-cases and drops white space.

    Its pre-tokens never cross white space, so each distinct word is encoded once and looked up from then on. Words of ASCII and
    Latin-1 letters need no normalising beyond lower case and go to the tokenizer's model pre-token by pre-token; any other
    word, and a text that holds a marker of special tokens, is encoded whole by the library. ``held`` bounds the table of known
    words; when it is full it starts anew (results don't depend on it).
    """

    #: The steps of a tokenizer file that this class follows.
    STEPS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence", "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }
    MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False}
    PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    LINE = re.compile("[ -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    #: A space, a word that was encoded whole (its number between two marks), or a pre-token.
    PARTS = re.compile(" |\ue000[0-9]+\ue001|'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^ a-z0-9\u00df-\u00f6\u00f8-\u00ff\ue000\ue001]+")

    def __init__(self, spec: str, held: int = 150_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.known = self._known(json.loads(spec))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.odd = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.held = held
        # Byte-level alphabets print the bytes of visible Latin-1 characters as themselves and the others from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letter = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
        self._clear()

    @classmethod
    def _known(cls, spec: dict) -> bool:
        """Whether the file's normaliser, pre-tokeniser and model are the ones that words are split for here; with any other, the library encodes whole texts."""
        return all(spec.get(k) == v for k, v in cls.STEPS.items()) and all(spec["model"].get(k) == v for k, v in cls.MODEL.items())

    def _clear(self) -> None:
        self.words, self.parts = _Table(), _Table()
        self.parts.index[" "]  # the first part has no ids
        self.parts.add(np.zeros(1, np.int64), np.zeros(0, np.uint32))

    def _whole(self, text: bytes) -> list[int]:
        return self.tok.encode(text.decode(), add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of words that the index has just numbered: all their pre-tokens at once."""
        line, whole = b" ".join(words).decode(), {}
        if not self.LINE.fullmatch(line):
            split = line.split(" ")
            for k, w in enumerate(split):
                if not self.PLAIN.fullmatch(w):
                    split[k] = f"\ue000{len(self.parts.index.new) + len(self.parts.begin)}{k}\ue001"
                    whole[split[k]] = self._whole(words[k])
            line = " ".join(split)
        parts = self.PARTS.findall(line.lower())
        number = np.fromiter(map(self.parts.index.__getitem__, parts), np.int64, len(parts))
        if self.parts.index.new:
            got = [whole[x] if x in whole else [t.id for t in self.tok.model.tokenize(x if x.isascii() else "".join(map(self.letter.__getitem__, x.encode())))] for x in self.parts.index.new]
            self.parts.add(np.array([len(x) for x in got], np.int64), np.fromiter(itertools.chain.from_iterable(got), np.uint32))
            for x in whole:  # a word of its own is looked up among the words
                del self.parts.index[x]
        flat, size = self.parts.of(number)
        of_word = np.cumsum(number == 0)
        self.words.add(np.bincount(of_word, size, len(words)).astype(np.int64), flat)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text."""
        if not self.known:
            return [np.array(self._whole(t), np.uint32) for t in texts]
        if len(self.words.index) > self.held:
            self._clear()
        split = [[] if any(x in t for x in self.odd) else t.split() for t in texts]
        number = np.fromiter(map(self.words.index.__getitem__, itertools.chain.from_iterable(split)), np.int64)
        if self.words.index.new:
            self._learn(self.words.index.new)
        flat, size = self.words.of(number)
        edge = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum([len(x) for x in split])])]
        return [flat[a:b] if b > a or not any(x in t for x in self.odd) else np.array(self._whole(t), np.uint32) for t, a, b in zip(texts, edge, edge[1:], strict=False)]


@functools.lru_cache(maxsize=1)
def _coder(spec: str) -> WordEncoder:
    """One encoder for each Python worker, so that its words outlive a task."""
    return WordEncoder(spec)


def _cutter(spec: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec)
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), 1 << 19):
                whole, edge = chunk.data.tobytes(), chunk.offsets.tolist()
                rows: list[tuple] = []
                for k, got in enumerate(coder.encode([whole[a:b] for a, b in itertools.pairwise(edge)])):
                    full = np.concatenate([got, tail])
                    for p, s in enumerate(range(0, len(full), size)):
                        piece = full[s : s + size]
                        rows.append((ids[chunk.first + k], p, s, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), chunk.first + k))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=_PIECES.names)
        free_memory()
    return run


def plan(histogram: dict[int, int], size: int, groups: int = 128, small: int | None = None) -> list[tuple[int, list[int]]]:
    """Classes (multiplicity, lengths) that hold each length as often as the histogram says, no class above ``size``.

    ``groups`` bounds the number of groups. The program is solved with and without the small lengths' share in it,
    and rounded with and without the fractions that are used once more; the plan with the fewest sequences counts.
    """
    plans = [_best_fit(*found, size) for with_small in (True, False) for found in grouped_classes(histogram, size, groups, small, with_small)]
    return min(plans, key=lambda classes: sum(times for times, _ in classes))


def grouped_classes(histogram: dict[int, int], size: int, groups: int = 128, small: int | None = None, with_small: bool = True) -> list[tuple[list[tuple[int, list[int]]], dict[int, int]]]:
    """The classes of full lengths and of configurations, with real lengths in their places, and what is left of the histogram: with either rounding."""
    small = size // 4 if small is None else small
    left = {n: c for n, c in histogram.items() if c > 0}
    full = [(left.pop(size), [size])] if size in left else []
    large = sorted((n for n in left if n > small), reverse=True)
    total = sum(left[n] for n in large)
    if not total:
        return [(full, left)]
    groups = min(groups, total)
    # Ranks of the longest first; a group is a range of ranks, a length may reach over several groups.
    ends = np.cumsum([left[n] for n in large])
    length = np.array(large)
    at_rank = lambda r: np.searchsorted(ends, r, "right")
    bound = np.unique([total * g // groups for g in range(groups + 1)])
    sizes, demand = length[at_rank(bound[:-1])], np.diff(bound)
    tiny = np.array(sorted(n for n in left if n <= small and with_small), np.int64)
    many = np.cumsum([left[int(n)] for n in tiny])
    # Whole small pieces fill a room: from the tenth shortest of a hundred on, and no more of them than fit.
    least = int(tiny[np.searchsorted(many, many[-1] / 10)]) if len(tiny) else size + 1
    room = np.arange(size + 1)
    fill = np.minimum(room, room // least * int(tiny.max())) if len(tiny) else room * 0
    columns, used = _configure(sizes, demand, size, sum(int(n) * left[int(n)] for n in tiny), fill)

    def substituted(once: bool) -> tuple[list[tuple[int, list[int]]], dict[int, int]]:
        out, rest, taken = list(full), dict(left), bound[:-1].copy()
        for times, config in _rounded(columns, used, demand, once):
            slots = []
            for g in np.flatnonzero(config):
                slots += [taken[g] + j * times for j in range(config[g])]
                taken[g] += config[g] * times
            # Sequence i of this configuration takes rank slot + i for each slot: lengths change where a run of equal ones ends.
            cuts = np.unique(np.concatenate([[0, times], *[ends[at_rank(s) : at_rank(s + times - 1)] - s for s in slots]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                real = [int(length[at_rank(s + i)]) for s in slots]
                out.append((j - i, real))
                for n in real:
                    rest[n] -= j - i
        return out, {n: c for n, c in rest.items() if c}

    return [substituted(True), substituted(False)]


def _priced(sizes: np.ndarray, value: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, int]:
    """The most valuable configuration: how many of each size, and the room it takes. ``rest[c]`` is what the room beside c is worth."""
    worth, room = np.flatnonzero(value > 1e-12), len(rest) - 1
    gain, last = np.full(room + 1, -np.inf), np.full(room + 1, -1)
    gain[0] = 0
    # An unbounded knapsack over every exactly filled room, a layer for each piece.
    for _ in range(int(room // sizes[worth].min()) if len(worth) else 0):
        before = gain.copy()
        for g in worth:
            w = sizes[g]
            with_g = before[: room + 1 - w] + value[g]
            better = with_g > gain[w:] + 1e-12
            if better.any():
                gain[w:][better] = with_g[better]
                last[w:][better] = g
        if (gain == before).all():
            break
    out, c = np.zeros(len(sizes), np.int64), int(np.argmax(gain + rest))
    taken = c
    while c > 0:
        out[last[c]] += 1
        c -= sizes[last[c]]
    return out, taken


def _configure(sizes: np.ndarray, demand: np.ndarray, room: int, sand: int, fill: np.ndarray, steps: int = 1500) -> tuple[list[np.ndarray], np.ndarray]:
    """Configurations (how many of each size) and how often to use each, as fractions.

    Gilmore and Gomory's column generation: the least number of sequences that hold the demand exactly, and ``sand`` tokens of small
    lengths, of which ``fill[r]`` go into a room of r that a configuration leaves. ``steps`` bounds the number of columns; it ends long before,
    when no configuration prices below its cost.
    """
    n = len(sizes)
    fit = room // sizes
    beside = fill[::-1]
    # The last row is the sand, and its first column a sequence of nothing else.
    basis = np.diag([*fit, room]).astype(float)
    columns = [np.eye(n, dtype=np.int64)[g] * fit[g] for g in range(n)] + [np.zeros(n, np.int64)]
    used = np.append(demand / fit, sand / room)
    for _ in range(steps):
        price = np.linalg.solve(basis.T, np.ones(n + 1))
        config, taken = _priced(sizes, price[:n], max(price[n], 0) * beside)
        filled = beside[taken] if price[n] > 0 else 0
        if price[:n] @ config + price[n] * filled <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, np.append(config, filled).astype(float))
        some = np.flatnonzero(move > 1e-9)
        if not len(some):
            break
        out = some[np.argmin(used[some] / move[some])]
        step = used[out] / move[out]
        used = np.maximum(used - step * move, 0)
        used[out] = step
        basis[:, out] = np.append(config, filled)
        columns[out] = config
    return columns, used


def _rounded(columns: list[np.ndarray], used: np.ndarray, demand: np.ndarray, once: bool) -> list[tuple[int, np.ndarray]]:
    """Whole numbers of each configuration, never beyond the demand; with ``once``, those of the largest fractions get one more."""
    rest, times = demand.copy(), np.floor(used + 1e-9).astype(np.int64)
    # Rounding errors must not ask for more than there is.
    for k, config in enumerate(columns):
        some = config > 0
        times[k] = min(times[k], (rest[some] // config[some]).min()) if some.any() else 0
        rest = rest - times[k] * config
    for k in np.argsort(np.floor(used + 1e-9) - used, kind="stable") if once else ():
        if columns[k].any() and (columns[k] <= rest).all():
            times[k] += 1
            rest = rest - columns[k]
    return [(int(t), config) for t, config in zip(times, columns, strict=True) if t]


def _best_fit(classes: list[tuple[int, list[int]]], left: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Adds the lengths that are left, longest first, each where the least room remains that holds it."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(times: int, content: list[int], room: int) -> None:
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append([times, content])

    for times, content in classes:
        put(times, content, size - sum(content))
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(rooms, n)
            if at == len(rooms):
                fit = size // n
                if count >= fit:
                    put(count // fit, [n] * fit, size - fit * n)
                if count % fit:
                    put(1, [n] * (count % fit), size - (count % fit) * n)
                break
            room = rooms[at]
            held = by_room[room]
            times, content = held.pop()
            if not held:
                del by_room[room]
                rooms.pop(at)
            fit = room // n
            use = min(times, count // fit)
            if use:
                put(use, content + [n] * fit, room - fit * n)
                count -= use * fit
            if use < times:
                if use == 0 or count:
                    part = count if count < fit else 0
                    if part:
                        put(1, content + [n] * part, room - part * n)
                        count -= part
                        use += 1
                if use < times:
                    put(times - use, content, room)
    return [(times, content) for held in by_room.values() for times, content in held]


def _runs(classes: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Places of each length: (length, first rank, first sequence, number of sequences, offset)."""
    out, at, rank = [], 0, {}
    for times, content in classes:
        offset = 0
        for n in content:
            out.append((n, rank.get(n, 0), at, times, offset))
            rank[n] = rank.get(n, 0) + times
            offset += n
        at += times
    return out


def _placer(places: list[tuple[int, int, int, int, int]]):
    """Looks up the sequence and offset of rows (..., length, rank) among the sorted places of their length."""
    table = np.array(sorted(places), np.int64).reshape(-1, 5)
    lengths, firsts = np.unique(table[:, 0], return_index=True)
    firsts = np.append(firsts, len(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                k = np.searchsorted(lengths, length[part[0]])
                a, b = firsts[k], firsts[k + 1]
                at[part] = a + np.searchsorted(table[a:b, 1], rank[part], "right") - 1
            found = table[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 4])], names=[*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, spec: str, size: int = 4096, end_id: int = 1, rows: int = 1000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``spec`` is the text of a tokenizer file (``tokenizers`` library). Each text's ids are followed by ``end_id``.
    Null and empty texts are the end id alone. Rows that share a doc_id are packed each for itself. Other columns are not looked
    at. An empty table gives an empty result. Full pieces have sequences with negative numbers. Pieces of one length are numbered in blocks of about
    ``rows``.
    """
    spark: SparkSession = docs.sparkSession
    space = Space(spark, "packing")
    pieces = space.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cutter(spec, size, end_id), _PIECES), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `size` rows
    full = pieces.where(F.col("length") == size).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram.pop(size, None)
    if not histogram:
        return full
    # Rank of each piece among those of its length: its rank in its block, after all earlier blocks. A length has as many blocks as it
    # needs pieces' places, so that one that very many share is dealt to many tasks.
    blocks = F.get(F.from_json(F.lit(json.dumps([max(1, histogram.get(n, 0) // rows) for n in range(size)])), "array<bigint>"), F.col("length").cast("int"))
    blk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row_key"), blocks)
    rest = pieces.where(F.col("length") < size).withColumn("blk", blk)
    counts = rest.groupBy("length", "blk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).drop("n")
    local = rest.withColumn("k", F.row_number().over(Window.partitionBy("length", "blk").orderBy("doc_id", "piece", "ids_crc32", "row_key")) - 1)
    ranked = local.join(counts, ["length", "blk"]).withColumn("rank", F.col("before") + F.col("k"))
    found = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(_runs(plan(histogram, size))), full.schema)
    return full.unionByName(found)
