"""The online service: requests as JSON, a pinned snapshot for each, a result cache, responses as JSON."""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark import __version__
from quillspark.errors import EngineError
from quillspark.functions.text import LOWER, UPPER, WS, score_text
from quillspark.operators.display import highlight, summary
from quillspark.operators.search import known_terms, query_terms, rank, top_k
from quillspark.operators.suggest import suggest
from quillspark.snapshot import Snapshot, open_snapshot

# Status codes of the protocol.
OK, INVALID_REQUEST, OVERLOADED, STOPPING, INTERNAL_ERROR, DEADLINE_EXCEEDED, RESOURCE_LIMIT = range(7)

_LIMITS = ("query.limit", "candidate.", "ranking.work", "recommend.work", "summary.work", "highlight.work", "service.limit", "service.output")


#: The least and most that each number may be.
RANGES = {
    "max_query_bytes": (1, 65_536), "max_top_k": (1, 100), "max_work": (1, 50_000_000), "max_output_bytes": (1, 16 << 20), "cache_capacity": (0, 1_000_000), "cache_bytes": (1, 1 << 32),
    "workers": (1, 1024), "task_capacity": (1, 65_536), "idle_timeout_ms": (0, 86_400_000), "request_timeout_ms": (0, 86_400_000), "max_query_tokens": (1, 65_536), "max_query_terms": (1, 4096), "max_candidates": (1, 1 << 40),
}


@dataclass(frozen=True)
class Settings:
    """Limits and defaults; ``load`` reads a flat JSON object over them, then keyword or command-line overrides. All numbers are checked against ``RANGES``."""

    tokenizer: str = "english"
    stop_words: tuple[str, ...] = ()
    max_query_bytes: int = 65_536
    max_query_tokens: int = 65_536
    max_query_terms: int = 4096
    max_top_k: int = 100
    max_work: int = 50_000_000
    max_candidates: int = 1 << 40
    max_output_bytes: int = 1 << 20
    cache_capacity: int = 0
    cache_bytes: int = 16 << 20
    workers: int = 4
    task_capacity: int = 128
    idle_timeout_ms: int = 0
    request_timeout_ms: int = 0
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for name, (least, most) in RANGES.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most:
                raise EngineError("config.value", f"{name} must lie in {least}..{most}")

    @classmethod
    def load(cls, text: str | None = None, args: list[str] | None = None, **over) -> Settings:
        """Defaults, then JSON text, then ``--name=value`` arguments, then keywords."""
        known = {f.name for f in fields(cls)}
        values: dict = {}
        if text is not None:
            try:
                values = json.loads(text, object_pairs_hook=_unique)
            except ValueError as e:
                raise EngineError("config.json", str(e)) from None
            if not isinstance(values, dict) or values.pop("schema_version", None) != 2:
                raise EngineError("config.json", "schema_version must be 2")
        for arg in args or ():
            name, equals, value = arg.removeprefix("--").partition("=")
            name = name.replace("-", "_")
            if not arg.startswith("--") or not equals:
                raise EngineError("config.argument", f"not --name=value: {arg}")
            if name in RANGES and (not value.isascii() or not value.isdigit() or str(int(value)) != value):
                raise EngineError("config.argument", f"{name} must be a canonical number")
            values[name] = int(value) if name in RANGES else tuple(value.split(",")) if name == "stop_words" else value
        values |= over
        for k in values:
            if k not in known:
                raise EngineError("config.argument", f"unknown setting {k}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


_WHITE = re.compile(WS)
_FOLD = str.maketrans(UPPER, LOWER)


def normalized(text: str) -> str:
    """The query's normal form, as the engine normalises documents."""
    return re.sub(f"(?:{WS})+", " ", text.translate(_FOLD)).strip(" ")


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def status_of(error: EngineError) -> int:
    """The protocol's status for an error's context."""
    if error.context == "service.deadline":
        return DEADLINE_EXCEEDED
    if error.context.startswith(("request.", "query.", "normalize.", "recommend.query", "top_k.")):
        return RESOURCE_LIMIT if error.context.endswith((".query_bytes", ".top_k_limit", ".tokens", ".terms", ".input_bytes")) else INVALID_REQUEST
    return RESOURCE_LIMIT if error.context.startswith(_LIMITS) else INTERNAL_ERROR


def admitted(body: str | bytes, most: int) -> dict:
    """A request's JSON object: UTF-8, no byte order mark, no NUL, an object at the root, at most 64 levels, no key twice."""
    if isinstance(body, bytes):
        try:
            body = body.decode()
        except UnicodeDecodeError as e:
            raise EngineError("request.utf8", f"byte {e.start}") from None
    if len(body.encode()) > most:
        raise EngineError("query.query_bytes", "the request is too long")
    if body.startswith("\ufeff") or "\0" in body:
        raise EngineError("request.json", "a byte order mark or NUL")
    depth = most_deep = 0
    quoted = escaped = False
    for c in body:
        if quoted:
            escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most_deep = max(most_deep, depth)
        elif c in "]}":
            depth -= 1
    if most_deep > 64:
        raise EngineError("request.depth", "more than 64 levels")
    try:
        got = json.loads(body, object_pairs_hook=_unique, parse_constant=_no_constant)
    except ValueError as e:
        raise EngineError("request.json", str(e)) from None
    if not isinstance(got, dict):
        raise EngineError("request.json", "the root is no object")
    return got


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def parse_request(command: str, body: str | bytes, settings: Settings) -> dict:
    """The validated options of a request; duplicate or unknown keys, wrong types and empty keys are invalid. The body of a PING is ``{}`` and nothing else."""
    allowed = {"SEARCH": {"query": str, "top_k": int, "mode": str, "window": int, "context": int}, "SUGGEST": {"key": str, "top_k": int, "normalize_key": bool}, "PING": {}, "SERVER_INFO": {}}
    if command == "PING" and body not in ("{}", b"{}"):
        raise EngineError("request.json", "the body of a PING is {}")
    got = admitted(body, settings.max_query_bytes * 2)
    if command not in allowed:
        raise EngineError("request.command", f"unknown command {command}")
    if set(got) - set(allowed[command]):
        raise EngineError("request.keys", "unknown keys")
    for k, v in got.items():
        kind = allowed[command][k]
        if not isinstance(v, kind) or (kind is int and (isinstance(v, bool) or v < 0)):
            raise EngineError("request.value", f"{k} has a wrong type")
    main = {"SEARCH": "query", "SUGGEST": "key"}.get(command)
    if main:
        if main not in got:
            raise EngineError("request.keys", f"{main} is missing")
        if len(got[main].encode("utf-8", "surrogatepass")) > settings.max_query_bytes:
            raise EngineError("query.query_bytes", "the query is too long")
        if "\0" in got[main]:
            raise EngineError("request.value", "NUL")
        if any("\ud800" <= c <= "\udfff" for c in got[main]):
            raise EngineError("request.utf8", "half a surrogate pair")
    out = {"top_k": 10, "mode": "or", "window": 160, "context": 40, "normalize_key": False} | got
    if out["top_k"] < 1:
        raise EngineError("request.value", "top_k must be positive")
    if out["top_k"] > settings.max_top_k:
        raise EngineError("query.top_k_limit", "top_k is above the limit")
    if out["mode"] not in ("or", "and") or not 1 <= out["window"] <= 4096 or out["context"] >= out["window"]:
        raise EngineError("request.value", "mode, window or context")
    return out


def cache_key(snapshot: Snapshot, command: str, options: dict) -> tuple[str, str, str, str]:
    """What a result is held under: the version with its manifest's digest, the command, the normalised query, and the other options.

    Queries that normalise alike share a result. A key of suggestions is normalised only if the request asks for it.
    """
    main = "query" if command == "SEARCH" else "key"
    text = normalized(options[main]) if command == "SEARCH" or options["normalize_key"] else options[main]
    used = ("top_k", "mode", "window", "context") if command == "SEARCH" else ("top_k", "normalize_key")
    return f"{snapshot.version}@{snapshot.digest}", command, text, json.dumps({k: options[k] for k in used}, sort_keys=True)


_SHORT = {'"': '\\"', "\\": "\\\\"}


def json_text(value) -> str:
    """JSON of a response: characters below U+0020 as \\u00xx, scores with up to 17 significant digits, everything else as it is."""
    if isinstance(value, str):
        return '"' + "".join(_SHORT.get(c, f"\\u{ord(c):04x}" if c < " " else c) for c in value) + '"'
    if isinstance(value, float):
        return score_text(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json_text(k)}:{json_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(json_text, value)) + "]"
    return json.dumps(value)


class VersionedLru:
    """Results by (version, operation, query, parameters), least recently used first out, bounded in entries and bytes."""

    def __init__(self, capacity: int, most_bytes: int):
        self.capacity, self.most_bytes, self.bytes = capacity, most_bytes, 0
        self.held: OrderedDict[tuple, tuple[str, int]] = OrderedDict()
        self.hits = self.misses = self.evicted = 0
        self.lock = threading.Lock()

    @staticmethod
    def charge(key: tuple, value: str) -> int:
        return len(value.encode()) + 2 * len(key[2].encode()) + 2 * len(key[3].encode())

    def get(self, key: tuple) -> str | None:
        with self.lock:
            if key not in self.held:
                self.misses += 1
                return None
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][0]

    def put(self, key: tuple, value: str) -> None:
        cost = self.charge(key, value)
        with self.lock:
            if self.capacity == 0 or cost > self.most_bytes:
                return
            if key in self.held:
                self.bytes -= self.held.pop(key)[1]
            self.held[key] = (value, cost)
            self.bytes += cost
            while len(self.held) > self.capacity or self.bytes > self.most_bytes:
                _k, (_v, c) = self.held.popitem(last=False)
                self.bytes -= c
                self.evicted += 1


class SnapshotManager:
    """The version that requests are pinned to; loading a candidate doesn't publish it."""

    def __init__(self, spark: SparkSession, parent: str):
        self.spark, self.parent = spark, parent
        self.current: Snapshot | None = None
        self.candidate: Snapshot | None = None

    def load(self, version: str, verify: bool = True) -> None:
        self.candidate = open_snapshot(self.spark, self.parent, version, verify)

    def publish(self) -> str:
        """'published', 'unchanged' or 'invalid_candidate'."""
        if self.candidate is None:
            return "invalid_candidate"
        if self.current is not None and self.current.version == self.candidate.version:
            return "unchanged"
        self.current = self.candidate
        return "published"


class SearchService:
    """Executes requests against the current snapshot."""

    def __init__(self, spark: SparkSession, manager: SnapshotManager, settings: Settings | None = None):
        self.spark, self.manager, self.settings = spark, manager, settings or Settings()
        self.cache = VersionedLru(self.settings.cache_capacity, self.settings.cache_bytes)

    def execute(self, command: str, body: str | bytes) -> tuple[int, str]:
        """(status, JSON): the snapshot is pinned for the whole request."""
        return self.execute_batch([(command, body)])[0]

    def execute_batch(self, requests: list[tuple[str, str | bytes]]) -> list[tuple[int, str]]:
        """(status, JSON) of each request, all against the snapshot that is current now.

        Searches of one mode and number of hits are one job, and so are suggestions of one number. A batch that runs past ``request_timeout_ms`` is
        interrupted, and what it hasn't answered gets the status for that.
        """
        pinned = self.manager.current
        out: list[tuple[int, str] | None] = [None] * len(requests)
        work: dict[tuple, list[tuple[int, dict]]] = {}
        for k, (command, body) in enumerate(requests):
            try:
                options = parse_request(command, body, self.settings)
                if command == "PING":
                    out[k] = OK, "{}"
                elif command == "SERVER_INFO":
                    out[k] = OK, json_text({"schema_version": 1, "build_version": __version__, "commands": ["PING", "SERVER_INFO", "SEARCH", "SUGGEST"], "max_top_k": self.settings.max_top_k, "cache_enabled": self.settings.cache_capacity > 0})
                elif pinned is None:
                    out[k] = INTERNAL_ERROR, json_text({"error": "no snapshot"})
                elif self.settings.cache_capacity and (held := self.cache.get(cache_key(pinned, command, options))) is not None:
                    out[k] = OK, held
                elif command == "SUGGEST" and (not options["key"] or _WHITE.search(options["key"])) and not options["normalize_key"]:
                    raise EngineError("recommend.query", "the key is empty or holds white space")
                else:
                    group = (command, options["mode"], options["top_k"], options["window"], options["context"]) if command == "SEARCH" else (command, options["normalize_key"], options["top_k"])
                    work.setdefault(group, []).append((k, options))
            except EngineError as e:
                out[k] = status_of(e), json_text({"error": e.context})
        with Deadline(self.spark, self.settings.request_timeout_ms) as deadline:
            for (command, *_), asked in work.items():
                try:
                    deadline.check()
                    found = self._search(pinned, asked) if command == "SEARCH" else self._suggest(pinned, asked)
                    deadline.check()
                except Exception as e:
                    e = deadline.error(e)
                    if not isinstance(e, EngineError):
                        raise
                    found = {k: e for k, _ in asked}
                for k, options in asked:
                    got = found[k]
                    if not isinstance(got, EngineError) and len(got.encode()) > self.settings.max_output_bytes:
                        got = EngineError("service.output", "the response is too long")
                    if isinstance(got, EngineError):
                        out[k] = status_of(got), json_text({"error": got.context})
                    else:
                        self.cache.put(cache_key(pinned, command, options), got)
                        out[k] = OK, got
        return out

    def _search(self, snapshot: Snapshot, asked: list[tuple[int, dict]]) -> dict[int, str | EngineError]:
        """Ranked hits with summaries and marked matches, of searches that share mode, number of hits, window and context."""
        one, s = asked[0][1], self.settings
        queries = self.spark.createDataFrame([(k, o["query"]) for k, o in asked], "query_id long, text string")
        words: dict[int, list[tuple[str, int]]] = {k: [] for k, _ in asked}
        for r in query_terms(queries, s.tokenizer, s.stop_words).orderBy("query_id", "term").collect():
            words[r["query_id"]].append((r["term"], r["tf"]))
        out: dict[int, str | EngineError] = {}
        for k, w in words.items():
            if not w:
                out[k] = EngineError("query.empty", "no terms")
            elif sum(n for _, n in w) > s.max_query_tokens:
                out[k] = EngineError("query.tokens", "too many tokens")
            elif len(w) > s.max_query_terms:
                out[k] = EngineError("query.terms", "too many different terms")
        rows = [(k, t, n) for k, w in words.items() if k not in out for t, n in w]
        if not rows:
            return out
        known = known_terms(self.spark.createDataFrame(rows, "query_id long, term string, tf long"), snapshot.tables["lexicon"])
        heavy = {r["query_id"]: r["n"] for r in known.rows.groupBy("query_id").agg(F.sum("df").alias("n")).where(F.col("n") > min(s.max_work, s.max_candidates)).collect()}
        for k, n in heavy.items():
            out[k] = EngineError("ranking.work" if n > s.max_work else "candidate.postings", f"{n} postings")
        if heavy:
            known = replace(known, rows=known.rows.where(~F.col("query_id").isin(list(heavy))))
        hits = top_k(rank(known, snapshot.tables["postings"], one["mode"], exact=True), one["top_k"])
        asked_words = self.spark.createDataFrame([(k, [t for t, _ in w]) for k, w in words.items()], "query_id long, words array<string>")
        shown = F.broadcast(hits.join(F.broadcast(asked_words), "query_id")).join(snapshot.tables["documents"], "doc_id").withColumn("s", summary(F.col("content"), F.col("words"), one["window"], one["context"]))
        results: dict[int, list] = {}
        for r in shown.withColumn("h", highlight(F.col("s.text"), F.col("words"))).drop("content").orderBy("query_id", "rank").collect():
            results.setdefault(r["query_id"], []).append({
                "document_id": str(r["doc_id"]), "score": r["score"], "title": r["title"], "url": r["url"],
                "summary": {"text": r["s"]["text"], "source_byte_offset": r["s"]["source_byte_offset"], "matched": r["s"]["matched"], "truncated_before": r["s"]["truncated_before"], "truncated_after": r["s"]["truncated_after"], "html": r["h"]["html"], "spans": [{"byte_offset": x["byte_offset"], "byte_length": x["byte_length"]} for x in r["h"]["spans"]]},
            })
        for k, options in asked:
            if k not in out:
                out[k] = json_text({**self._head(snapshot, "SEARCH", options), "mode": options["mode"], "query_config": {"tokenizer": s.tokenizer, "hmm": None}, "terms": [{"term": t, "tf": n} for t, n in words[k]], "results": results.get(k, [])})
        return out

    def _suggest(self, snapshot: Snapshot, asked: list[tuple[int, dict]]) -> dict[int, str | EngineError]:
        """Dictionary terms near each key, of suggestions that share their number and whether keys are normalised."""
        one = asked[0][1]
        keys = self.spark.createDataFrame([(k, o["key"]) for k, o in asked], "query_id long, key string")
        rows = suggest(keys, snapshot.tables["rec_terms"], one["top_k"], one["normalize_key"], max_work=self.settings.max_work).orderBy("query_id", "rank").collect()
        results: dict[int, list] = {}
        for r in rows:
            results.setdefault(r["query_id"], []).append({"term_id": str(r["term_id"]), "term": r["term"], "distance": r["distance"], "frequency": r["frequency"]})
        return {k: json_text({**self._head(snapshot, "SUGGEST", o), "key": o["key"], "normalized": o["normalize_key"], "results": results.get(k, [])}) for k, o in asked}

    @staticmethod
    def _head(snapshot: Snapshot, command: str, options: dict) -> dict:
        return {"schema_version": 1, "command": command, "snapshot_version": snapshot.version, "build_version": __version__, "top_k": options["top_k"]}


class Deadline:
    """Interrupts the jobs of its block when the time is over; 0 is no limit."""

    def __init__(self, spark: SparkSession, timeout_ms: int):
        self.spark, self.timeout_ms, self.tag = spark, timeout_ms, f"deadline-{uuid.uuid4().hex}"
        self.until = time.monotonic() + timeout_ms / 1000
        self.timer = threading.Timer(timeout_ms / 1000, lambda: spark.interruptTag(self.tag)) if timeout_ms else None

    def __enter__(self) -> Deadline:
        if self.timer:
            self.spark.addTag(self.tag)
            self.timer.daemon = True
            self.timer.start()
        return self

    def __exit__(self, *_exc) -> None:
        if self.timer:
            self.timer.cancel()
            self.spark.removeTag(self.tag)

    def over(self) -> bool:
        return self.timer is not None and time.monotonic() >= self.until

    def check(self) -> None:
        if self.over():
            raise EngineError("service.deadline", "the request took too long")

    def error(self, e: Exception) -> Exception:
        """The deadline's error if the time is over, else the one that was raised."""
        return EngineError("service.deadline", "the request took too long") if self.over() else e
