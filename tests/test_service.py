"""Sources end to end, snapshots, the service and the request stream."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.operators import fingerprints, index, suggest, terms
from quillspark.schemas import REQUESTS
from quillspark.service import INVALID_REQUEST, OK, RESOURCE_LIMIT, SearchService, Settings, SnapshotManager, VersionedLru
from quillspark.snapshot import open_snapshot, publish
from quillspark.sources import files
from quillspark.streaming import requests as R

FEED = "<rss version='2.0'><channel><item><title>Orchard</title><description>The old orchard is on a hill.</description><link>http://k</link></item><item><title>x</title><description>&lt;p&gt;&lt;/p&gt;</description></item></channel></rss>"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "txt").mkdir()
    (d / "rss").mkdir()
    for name, body in (("empty", b""), ("pond", "﻿Nine geese cross a frozen pond.\r\nThe ferryman is asleep.\n".encode()), ("crest-copy", b"The old orchard is on a hill."), ("bad", b"\xff\xfe"), ("nul", b"a\0b")):
        (d / "txt" / f"{name}.txt").write_bytes(body)
    (d / "rss" / "a.xml").write_text(FEED)
    return files.read_text(files.raw_files(spark, str(d / "txt"), "txt")).unionByName(files.read_feeds(files.raw_files(spark, str(d / "rss"), "rss")))


@pytest.fixture(scope="module")
def built(spark, corpus):
    docs = files.documents(corpus)
    tf = terms.term_frequency(docs, stop_words=("a", "the", "is", "on"))
    told = fingerprints.duplicates(docs.join(fingerprints.simhash(docs, tf), "doc_id"), 0)
    kept = docs.join(told.where("disposition = 'kept'").select("doc_id"), "doc_id", "left_semi")
    words = suggest.dictionary(terms.recommendation_frequency(tf))
    return docs, told, kept, index.build_index(kept, stop_words=("a", "the", "is", "on")), words


def test_reading(corpus, built):
    assert {r["status"]: r["items"] for r in files.read_counts(corpus).collect()} == {"no_text": 2, "rejected": 2, "warning": 3}
    docs, told, _k, _i, _w = built
    rows = {r["title"]: r for r in docs.collect()}
    assert rows["pond"]["content"] == "Nine geese cross a frozen pond.\nThe ferryman is asleep.\n" and rows["Orchard"]["url"] == "http://k"
    # Ids follow the paths in byte order: the feed's two items, then bad, crest-copy, empty, nul, pond.
    assert {t: r["doc_id"] for t, r in rows.items()} == {"Orchard": 0, "crest-copy": 3, "pond": 6}
    assert {r["doc_id"]: (r["disposition"], r["retained_id"]) for r in told.collect()} == {0: ("kept", None), 3: ("duplicate", 0), 6: ("kept", None)}


def test_stop_policy(spark):
    rows = [("a", 0, "success"), ("b", 0, "failed"), ("c", 0, "success")]
    items = spark.createDataFrame(rows, "input_path string, record_ordinal long, status string")
    assert [r[0] for r in files.until_failure(items).collect()] == ["a"]
    assert files.until_failure(items.where("status <> 'failed'")).count() == 2


@pytest.fixture(scope="module")
def store(spark, built, tmp_path_factory):
    _d, _t, kept, made, words = built
    parent = f"file://{tmp_path_factory.mktemp('snapshots')}"
    publish(spark, parent, "v1", kept.select("doc_id", "title", "content", "url"), made, words, suggest.character_index(words))
    return parent


def test_snapshot(spark, built, store, tmp_path):
    snap = open_snapshot(spark, store, "v1", verify=True)
    assert snap.manifest["n_docs"] == 2 and snap.tables["postings"].exceptAll(built[3].postings).count() == 0
    with pytest.raises(EngineError, match="writer.exists"):
        publish(spark, store, "v1", built[2].select("doc_id", "title", "content", "url"), built[3], built[4], suggest.character_index(built[4]))
    with pytest.raises(EngineError, match="reader.missing"):
        open_snapshot(spark, store, "v2")
    with pytest.raises(EngineError, match="writer.documents"):
        publish(spark, store, "v3", built[2].limit(1).select("doc_id", "title", "content", "url"), built[3], built[4], suggest.character_index(built[4]))
    with pytest.raises(EngineError, match="reader.missing"):
        open_snapshot(spark, store, "v3")


def test_tampering(spark, built, store):
    publish(spark, store, "v4", built[2].select("doc_id", "title", "content", "url"), built[3], built[4], suggest.character_index(built[4]))
    spark.createDataFrame([(99, "zzz", 1)], "term_id long, term string, frequency long").write.mode("append").parquet(f"{store}/v4/rec_terms")
    with pytest.raises(EngineError, match="reader.digest"):
        open_snapshot(spark, store, "v4", verify=True)


def test_service(spark, store):
    manager = SnapshotManager(spark, store)
    service = SearchService(spark, manager, Settings(stop_words=("a", "the", "is", "on"), cache_capacity=4))
    assert manager.publish() == "invalid_candidate"
    manager.load("v1")
    assert manager.publish() == "published" and manager.publish() == "unchanged"
    status, body = service.execute("SEARCH", json.dumps({"query": "The FERRYMAN", "window": 20, "context": 5}))
    got = json.loads(body)
    assert status == OK and [r["document_id"] for r in got["results"]] == ["6"] and got["terms"] == [{"term": "ferryman", "tf": 1}]
    assert "<mark>ferryman</mark>" in got["results"][0]["summary"]["html"]
    assert service.execute("SEARCH", json.dumps({"query": "The FERRYMAN", "window": 20, "context": 5}))[1] == body and service.cache.hits == 1
    assert json.loads(service.execute("SUGGEST", '{"key": "ferymann", "top_k": 1}')[1])["results"][0]["term"] == "ferryman"
    for command, bad in (("SEARCH", '{"query": "!!"}'), ("SEARCH", '{"query": "a", "query": "b"}'), ("SEARCH", "{}"), ("SEARCH", '{"query": "x", "top_k": 0}'), ("SEARCH", '{"query": "x", "z": 1}'), ("SUGGEST", '{"key": "a b"}'), ("SEARCH", '{"query": "x", "mode": "xor"}'), ("NONE", "{}")):
        assert service.execute(command, bad)[0] == INVALID_REQUEST, bad
    assert service.execute("SEARCH", '{"query": "x", "top_k": 101}')[0] == RESOURCE_LIMIT
    assert service.execute("PING", "{}") == (OK, "{}") and json.loads(service.execute("SERVER_INFO", "{}")[1])["cache_enabled"]
    assert json.loads(service.execute("SEARCH", '{"query": "absent"}')[1])["results"] == []


def test_lru():
    lru = VersionedLru(2, 100)
    k = [("v", "S", str(i), "") for i in range(4)]
    for i in range(3):
        lru.put(k[i], "x")
    assert lru.get(k[0]) is None and lru.get(k[1]) == "x" and lru.evicted == 1
    lru.put(k[3], "y" * 200)
    assert lru.get(k[3]) is None
    lru.put(k[3], "z")
    assert lru.get(k[2]) is None and lru.get(k[1]) == "x"


def test_settings():
    assert Settings.load('{"schema_version": 2, "workers": 8}', workers=2).workers == 2
    for bad in ('{"schema_version": 1}', '{"schema_version": 2, "x": 1}', '{"a": 1, "a": 2}', "["):
        with pytest.raises(EngineError, match="config"):
            Settings.load(bad)


def test_stream(spark, store, tmp_path):
    manager = SnapshotManager(spark, store)
    manager.load("v1")
    manager.publish()
    rows = [(1, 0, i, "SEARCH" if i % 2 else "PING", '{"query": "orchard"}' if i % 2 else "{}") for i in range(5)]
    df = spark.createDataFrame(rows, "conn_id long, generation long, request_id long, kind string, body string").withColumn("ts", F.timestamp_seconds(F.col("request_id")))
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).json(str(tmp_path / "in"))
    R.serve(stream, SearchService(spark, manager), str(tmp_path / "out"), str(tmp_path / "cp"), capacity=3).awaitTermination(120)
    got = {r["request_id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 2}
    windows = R.tumbling_metrics(spark.readStream.schema(REQUESTS).json(str(tmp_path / "in")), "2 seconds")
    q = windows.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["requests"] for r in spark.sql("select * from w").collect()) == 5


def test_request_relations(spark):
    rows = [(i, i % 2, "SEARCH", 60 * i if i < 5 else 10_000 + i, 10 ** (i % 7)) for i in range(10)]
    log = spark.createDataFrame(rows, "request_id long, conn_id long, kind string, s long, micros long").withColumn("ts", F.timestamp_seconds("s"))
    assert R.idle_sessions(log, "10 minutes").count() == 4
    assert {r["bucket"]: r["requests"] for r in R.latency_histogram(log).collect()} == {0: 6, 1: 1, 2: 1, 3: 1, 4: 1}
    assert [r["status"] for r in R.admit(log.withColumn("batch", F.lit(0)), 4).orderBy("request_id").collect()] == [0] * 4 + [2] * 6
    hits = R.replay_cache(spark.createDataFrame([(0, i, i, k) for i, k in enumerate("abacbb")], "shard long, ts long, request_id long, key string"), 2).collect()
    assert [(r["hits"], r["misses"], r["evicted"]) for r in hits] == [(2, 4, 2)]


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
