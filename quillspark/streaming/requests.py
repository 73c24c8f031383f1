"""The request path as relations; each function takes a batch or, where it says so, a stream."""

from __future__ import annotations

import heapq
import signal
import threading
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

#: Inclusive upper bounds of the latency buckets, in microseconds; the last bucket is open.
BOUNDS = (100, 1_000, 10_000, 100_000, 1_000_000)


def latency_histogram(requests: DataFrame, kind: str = "kind", micros: str = "micros") -> DataFrame:
    """(kind, bucket, requests): exclusive buckets; works on streams (complete or update mode)."""
    bucket = F.coalesce(*[F.when(F.col(micros) <= b, F.lit(i)) for i, b in enumerate(BOUNDS)], F.lit(len(BOUNDS)))
    return requests.groupBy(F.col(kind).alias("kind"), bucket.cast("long").alias("bucket")).agg(F.count("*").alias("requests"))


def kind_counters(requests: DataFrame, kind: str = "kind", micros: str = "micros") -> DataFrame:
    """(kind, requests, total, most); works on streams."""
    return requests.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("requests"), F.sum(micros).alias("total"), F.max(micros).alias("most"))


def tumbling_metrics(requests: DataFrame, every: str = "1 second", late: str | None = None) -> DataFrame:
    """(start, kind, requests) per tumbling window of ``ts``; ``late`` sets a watermark for streams."""
    if late:
        requests = requests.withWatermark("ts", late)
    return requests.groupBy(F.window("ts", every).alias("w"), "kind").agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), "kind", "requests")


def idle_sessions(requests: DataFrame, idle: str, late: str | None = None) -> DataFrame:
    """(conn_id, start, last, requests): a connection's session ends when nothing came for ``idle``; ``late`` sets a watermark for streams."""
    if late:
        requests = requests.withWatermark("ts", late)
    out = requests.groupBy("conn_id", F.session_window("ts", idle).alias("w")).agg(F.max("ts").alias("last"), F.count("*").alias("requests"))
    return out.select("conn_id", F.col("w.start").alias("start"), "last", "requests")


def admit(requests: DataFrame, capacity: int, batch: str = "batch") -> DataFrame:
    """Adds ``status``: 0 for the first ``capacity`` requests of each batch in order of (ts, request_id), else 2 (overloaded)."""
    place = F.row_number().over(Window.partitionBy(batch).orderBy("ts", "request_id"))
    return requests.withColumn("status", F.when(place <= capacity, 0).otherwise(2).cast("long"))


def past_deadline(requests: DataFrame, timeout_us: int, micros: str = "micros") -> DataFrame:
    """Adds ``status``: 5 where the work took longer than the timeout, else 0."""
    return requests.withColumn("status", F.when(F.col(micros) > timeout_us, 5).otherwise(0).cast("long"))


def drop_stale(completions: DataFrame, live: DataFrame) -> DataFrame:
    """Adds ``stale``: the completion's (conn_id, generation) isn't among the live ones."""
    mark = live.select("conn_id", "generation").distinct().withColumn("_live", F.lit(True))
    return completions.join(mark, ["conn_id", "generation"], "left").withColumn("stale", F.col("_live").isNull()).drop("_live")


def replay_cache(requests: DataFrame, capacity: int) -> DataFrame:
    """(shard, hits, misses, evicted): an LRU cache of ``capacity`` entries for each shard, replayed over (shard, ts, request_id, key).

    The fold reads each shard's requests as a sorted stream; only the cache is held.
    """
    from collections import OrderedDict

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, n = None, OrderedDict(), [0, 0, 0]
        for batch in batches:
            for s, key in zip(batch["shard"], batch["key"], strict=True):
                if s != shard:
                    if shard is not None:
                        yield pd.DataFrame([(shard, *n)], columns=["shard", "hits", "misses", "evicted"])
                    shard, held, n = s, OrderedDict(), [0, 0, 0]
                if key in held:
                    n[0] += 1
                    held.move_to_end(key)
                else:
                    n[1] += 1
                    held[key] = True
                    if len(held) > capacity:
                        held.popitem(last=False)
                        n[2] += 1
        if shard is not None:
            yield pd.DataFrame([(shard, *n)], columns=["shard", "hits", "misses", "evicted"])

    rows = requests.repartition("shard").sortWithinPartitions("shard", "ts", "request_id").select("shard", "key")
    return rows.mapInPandas(run, "shard long, hits long, misses long, evicted long")


def io_totals(io: DataFrame) -> DataFrame:
    """(conn_id, bytes_in, bytes_out, high_water) of I/O samples: bytes are added, the high-water mark is the largest."""
    return io.groupBy("conn_id").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.max("high_water").alias("high_water"))


def one_in_flight(requests: DataFrame, arrival: str = "arrival", micros: str = "micros") -> DataFrame:
    """Adds ``start`` and ``finish``: a connection's next request is held until the one before it is answered.

    A request starts when it has arrived and its predecessor is done. Over sums S of the work, the k-th ends at S_k plus the largest of arrival_j - S_(j-1) for j up to
    k, so two windows do, and no fold over the requests.
    """
    order = Window.partitionBy("conn_id").orderBy(arrival, "request_id").rowsBetween(Window.unboundedPreceding, 0)
    work = F.sum(micros).over(order)
    summed = requests.withColumn("_work", work).withColumn("_slack", F.col(arrival) - (F.col("_work") - F.col(micros)))
    finish = F.col("_work") + F.max("_slack").over(order)
    return summed.withColumn("finish", finish).withColumn("start", F.col("finish") - F.col(micros)).drop("_work", "_slack")


def due_deadlines(timers: DataFrame, now: int) -> DataFrame:
    """(key, when) in order of (when, key): of timers (seq, key, when) the last that was set for each key counts, one set to null is cancelled, and those up to ``now`` are due."""
    last = timers.groupBy("key").agg(F.max_by("when", "seq").alias("when"))
    return last.where(F.col("when") <= now).orderBy("when", "key")


class DeadlineQueue:
    """Timers of the driver: the earliest first, by (when, key); setting a key again moves it."""

    def __init__(self):
        self.held: dict = {}
        self.heap: list[tuple] = []

    def set(self, key, when: int) -> None:
        self.held[key] = when
        heapq.heappush(self.heap, (when, key))

    def cancel(self, key) -> None:
        self.held.pop(key, None)

    def next(self) -> int | None:
        """When the earliest is due."""
        while self.heap and self.held.get(self.heap[0][1]) != self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def pop_due(self, now: int) -> list:
        """The keys that are due, earliest first; they are no longer set."""
        out = []
        while (when := self.next()) is not None and when <= now:
            key = heapq.heappop(self.heap)[1]
            del self.held[key]
            out.append(key)
        return out


def bounded_output(responses: DataFrame, most: int) -> DataFrame:
    """Responses (status, body): a body of more than ``most`` bytes gives way to status 6 and a short one."""
    long_ = F.octet_length("body") > most
    return responses.withColumn("status", F.when(long_, F.lit(6).cast("long")).otherwise(F.col("status"))).withColumn("body", F.when(long_, '{"error":"service.output"}').otherwise(F.col("body")))


class Submitter(Protocol):
    """What answers requests: a service, or anything else that takes a batch of (kind, body) and gives (status, body) for each."""

    def execute_batch(self, requests: list[tuple[str, str]]) -> list[tuple[int, str]]: ...


def serve(requests: DataFrame, service: Submitter, out: str, checkpoint: str, capacity: int = 128) -> StreamingQuery:
    """Answers a stream of requests (conn_id, generation, request_id, kind, body, ts) until it ends; responses go to Parquet, a folder for each micro-batch.

    Each micro-batch is one admission window: at most ``capacity`` requests are answered, as one batch, against the snapshot that is current when the
    batch begins; the others get status 2. ``capacity`` bounds what comes to the driver. A connection's answers keep the order of its
    requests (column ``turn``). A micro-batch that is repeated after a failure replaces its folder.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        order = Window.partitionBy("conn_id", "generation").orderBy("ts", "request_id")
        told = admit(df.withColumn("batch", F.lit(0)), capacity).drop("batch").withColumn("turn", F.row_number().over(order).cast("long"))
        rows = told.where("status = 0").orderBy("ts", "request_id").limit(capacity).collect()
        done = service.execute_batch([(r["kind"], r["body"]) for r in rows])
        answered = [(r["conn_id"], r["generation"], r["request_id"], r["turn"], status, body) for r, (status, body) in zip(rows, done, strict=True)]
        schema = "conn_id long, generation long, request_id long, turn long, status long, body string"
        refused = told.where("status <> 0").select("conn_id", "generation", "request_id", "turn", "status", F.lit('{"error":"overloaded"}').alias("body"))
        df.sparkSession.createDataFrame(answered, schema).unionByName(refused).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(query: StreamingQuery, seconds: float) -> bool:
    """Lets a stream finish what has come, for at most so long, and stops it; whether it finished by itself."""
    done = query.awaitTermination(seconds) if query.isActive else True
    if query.isActive:
        query.stop()
    return bool(done)


def drain_on_signals(query: StreamingQuery, seconds: float, signals: tuple[int, ...] = (signal.SIGINT, signal.SIGTERM)) -> threading.Event:
    """The first of the signals begins a drain, a second one stops the stream at once. The event is set when the stream has ended. For the main thread."""
    ended, begun = threading.Event(), threading.Event()

    def work() -> None:
        drain(query, seconds)
        ended.set()

    def handle(_number, _frame) -> None:
        if begun.is_set():
            query.stop()
            return
        begun.set()
        threading.Thread(target=work, daemon=True).start()

    for number in signals:
        signal.signal(number, handle)
    return ended
