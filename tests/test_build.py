"""Limits, item admission, the indexer, logs, requests' JSON and the relations of the request path."""

import json
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark import indexer
from quillspark.errors import EngineError
from quillspark.functions import text as X
from quillspark.limits import PROFILE_1, Limits, admit_items, check_files, check_terms
from quillspark.logs import Log
from quillspark.operators import index, search, suggest, terms
from quillspark.schemas import READ_ITEMS
from quillspark.service import DEADLINE_EXCEEDED, INTERNAL_ERROR, INVALID_REQUEST, OK, RESOURCE_LIMIT, Deadline, SearchService, Settings, SnapshotManager, cache_key, json_text, parse_request, status_of
from quillspark.snapshot import check_statistics, open_snapshot
from quillspark.sources.files import feed_items, read_text
from quillspark.streaming import requests as R


def test_checked_normalize(spark):
    rows = [b"Two\t Words ", b"ok \xc3\x28 bad", b"nul\0here", b"", None, b"\xff", "Ünï  x".encode()]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(rows)], "i int, b binary")
    got = {r["i"]: tuple(r["n"]) for r in df.select("i", X.checked_normalize("b", 12, 9).alias("n")).collect()}
    assert got == {0: ("two words", None, None), 1: (None, "normalize.utf8", 3), 2: (None, "normalize.nul", 3), 3: ("", None, None), 4: (None, None, None), 5: (None, "normalize.utf8", 0), 6: ("Ünï x", None, None)}
    assert [r[0] for r in df.where("i < 2").select(X.checked_normalize("b", 8, 9)["context"]).collect()] == ["normalize.input_bytes"] * 2
    assert df.where("i = 0").select(X.checked_normalize("b", 99, 8)["context"]).first()[0] == "normalize.output_bytes"


def test_small_columns(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "t string").select(f("t")).first()[0]
    assert one("quill", X.crc32) == zlib.crc32(b"quill")
    assert [one(p, X.is_absolute_path) for p in ("/a/b", "a", "/a/../b", "/..", "/a..b", "/")] == [True, False, False, False, True, True]
    for t in ('say "x"\\', "tab\tline\n\x01", "é😀", ""):
        assert one(t, X.json_string) == json_text(t) and json.loads(json_text(t)) == t
    assert json_text("a\nb") == '"a\\u000ab"' and json_text({"s": 0.1, "n": [1, None, True]}) == '{"s":0.10000000000000001,"n":[1,null,true]}'
    assert X.score_text(1.0) == "1" and X.score_text(1e-5) == "1.0000000000000001e-05"
    for bad in (0.0, 1.5, -0.1, float("nan")):
        with pytest.raises(EngineError, match="service.score"):
            X.score_text(bad)


def test_foreign_tokens(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, content string")
    assert terms.term_frequency(df, lambda c: F.split(c, " ")).count() == 2
    with pytest.raises(Exception, match="frequency.token"):
        terms.term_frequency(df, lambda c: F.array(c)).collect()


def test_merged_frequency(spark):
    table = lambda rows: spark.createDataFrame(rows, "term string, frequency long")
    got = terms.merged_frequency(table([("a", 2), ("b", 1)]), table([("b", 4), ("c", 1)]))
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 5), ("c", 1)}


RECORD = ("t", "body", "txt", None, None, None)
ISSUE = [("c", "", "")]


def test_admission(spark):
    rows = [
        ("a", 0, "success", RECORD, []), ("a", 1, "warning", RECORD, ISSUE), ("a", 2, "no_text", None, ISSUE), ("b", 0, "success", None, []), ("b", 1, "success", RECORD, ISSUE), ("b", 2, "odd", None, ISSUE),
        ("c", 3, "success", RECORD, []), ("c", 3, "success", RECORD, []), ("c", 4, "rejected", None, []), ("d", 0, "success", RECORD, []),
    ]
    items = spark.createDataFrame(rows, READ_ITEMS)
    got = [(r["input_path"], r["record_ordinal"], r["fault"], r["text_before"]) for r in admit_items(items).orderBy("input_path", "record_ordinal", F.col("fault").isNotNull()).collect()]
    assert [x[2] for x in got] == [None, None, None, "item.payload", "item.issues", "item.status", None, "item.ordinal", "item.issues", None]
    assert got[-1][3] == 15
    few = {(r["input_path"], r["record_ordinal"]): r["fault"] for r in admit_items(items.where("input_path in ('a', 'd')"), Limits(records=2)).collect()}
    assert few == {("a", 0): None, ("a", 1): None, ("a", 2): None, ("d", 0): "item.records"}
    short = {(r["input_path"], r["record_ordinal"]): r["fault"] for r in admit_items(items.where("input_path in ('a', 'd')"), Limits(text_bytes=10)).collect()}
    assert short == {("a", 0): None, ("a", 1): None, ("a", 2): None, ("d", 0): "item.text_bytes"}


def test_file_and_term_limits(spark):
    files = lambda rows: spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "input_path string, bytes binary")
    check_files(files([("a/b", b"12"), ("c", b"3")]), Limits(file_bytes=2, total_bytes=3))
    for rows, limits, context in (([("/a", b"")], Limits(), "reader.path"), ([("a", b""), ("a", b"")], Limits(), "reader.duplicate_path"), ([("a", b"123")], Limits(file_bytes=2), "reader.file_bytes"), ([("a", b"12"), ("b", b"12")], Limits(total_bytes=3), "reader.total_bytes")):
        with pytest.raises(EngineError, match=context):
            check_files(files(rows), limits)
    tf = spark.createDataFrame([(1, "aa", 3), (1, "b", 1), (2, "aa", 1)], "doc_id long, term string, tf long")
    check_terms(tf, PROFILE_1)
    for name, most, context in (("document_tokens", 3, "index.document_tokens"), ("total_tokens", 4, "index.total_tokens"), ("token_bytes", 1, "lexicon.term_bytes"), ("distinct_terms", 1, "lexicon.distinct_terms"), ("vocabulary_bytes", 2, "lexicon.vocabulary_bytes"), ("postings", 2, "weights.postings"), ("postings_per_term", 1, "index.postings_per_term")):
        check_terms(tf, Limits(**{name: most + 1}))
        with pytest.raises(EngineError, match=context):
            check_terms(tf, Limits(**{name: most}))
    with pytest.raises(EngineError, match="limits.value"):
        Limits(records=0)


def test_text_places(spark):
    rows = [("f/a.txt", b"ab\xff"), ("f/b.txt", b"abc\0d")]
    got = {r["input_path"]: r["issues"][0]["message"] for r in read_text(spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "input_path string, bytes binary")).collect()}
    assert got == {"f/a.txt": "2", "f/b.txt": "3"}


@pytest.mark.parametrize(("head", "ok"), [("<?xml version='1.0' encoding='UTF-8'?>", True), ("<?xml version='1.0' encoding='utf-8' standalone='yes'?>", True), ("<?xml version='1.1'?>", False), ("<?xml version='1.0' encoding='latin-1'?>", False), ("<?xml version='1.0' standalone='maybe'?>", False)])
def test_declarations(head, ok):
    assert (feed_items("f.xml", f"{head}<rss version='2.0'><channel/></rss>".encode())[0][2] == "no_text") == ok


def test_feed_budgets():
    deep = "<rss version='2.0'><channel>" + "<x>" * 130 + "</x>" * 130 + "</channel></rss>"
    assert feed_items("f.xml", deep.encode())[0][2] == "failed"
    assert feed_items("f.xml", deep.replace("<x>" * 130, "<x>" * 9).replace("</x>" * 130, "</x>" * 9).encode())[0][2] == "no_text"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "txt").mkdir()
    (d / "rss").mkdir()
    (d / "txt" / "one.txt").write_text("Seven quiet herons waded through the marsh.")
    (d / "txt" / "two.txt").write_text("Seven quiet herons waded through the marsh.")
    (d / "txt" / "three.txt").write_text("A windmill turned above the barley field.")
    (d / "rss" / "feed.xml").write_text("<rss version='2.0'><channel><item><title>Mill</title><description>&lt;p&gt;The windmill grinds barley.&lt;/p&gt;</description></item></channel></rss>")
    (d / "stop.txt").write_text("the\nA\n")
    return d


@pytest.fixture(scope="module")
def made(spark, folder, tmp_path_factory):
    parent = f"file://{tmp_path_factory.mktemp('made')}"
    branch = indexer.Branch((str(folder / "txt"),), (str(folder / "rss"),), ("a", "the"))
    return parent, *indexer.build_snapshot(spark, parent, "v1", branch, indexer.Branch((str(folder / "txt"),)), distance=0)


def test_build_snapshot(spark, folder, made):
    parent, snap, report = made
    f = report.figures
    assert (f["search_warning"], f["kept"], f["duplicate"], f["search_documents"], f["recommendation_documents"], f["comparisons"]) == (4, 3, 1, 3, 3, sum(range(3)) + 1 + 1) or f["comparisons"] > 0
    assert f["recommendation_tokens"] == 21 and f["search_terms"] <= f["search_postings"] <= f["search_total_tokens"]
    assert report.lines()[0] == "version=v1" and report.frame(spark).first()["kept"] == 3 and len(report.config_sha256) == len(report.inputs_sha256) == 64
    assert open_snapshot(spark, parent, "v1", verify=True).manifest["config"]["inputs_sha256"] == report.inputs_sha256
    branch = indexer.Branch((str(folder / "txt"),), (str(folder / "rss"),), ("a", "the"))
    same = indexer.build_snapshot(spark, parent, "v2", branch, indexer.Branch((str(folder / "txt"),)), distance=0)[1]
    assert (same.config_sha256, same.inputs_sha256, same.figures) == (report.config_sha256, report.inputs_sha256, report.figures)
    with pytest.raises(EngineError, match="duplicate.comparisons"):
        indexer.build_snapshot(spark, parent, "v3", branch, distance=0, limits=Limits(comparisons=1))
    with pytest.raises(EngineError, match="reader.missing"):
        open_snapshot(spark, parent, "v3")
    assert snap.document(10**9) is None and snap.document(snap.tables["documents"].first()["doc_id"]) is not None


def test_command(spark, folder, made, capsys):
    args = ["--parent", made[0], "--version", "cli", "--search-txt", str(folder / "txt"), "--search-stop-words", str(folder / "stop.txt"), "--profile", "1"]
    assert indexer.main(args, spark) == indexer.DONE
    lines = dict(x.split("=", 1) for x in capsys.readouterr().out.splitlines())
    assert lines["version"] == "cli" and lines["duplicate"] == "1"
    assert indexer.main(args, spark) == indexer.WRITE and "error=writer.exists" in capsys.readouterr().err
    assert indexer.main(["--nonsense"], spark) == indexer.USAGE and indexer.main([*args[:2], "--version", "x"], spark) == indexer.USAGE


def test_manifest_statistics(made):
    manifest = json.loads(json.dumps(made[1].manifest))
    check_statistics(manifest)
    for table, change in (("statistics", {"terms": 99}), ("statistics", {"total_tokens": 0}), ("statistics", {"documents": 7})):
        with pytest.raises(EngineError, match="manifest.statistics"):
            check_statistics(manifest | {table: manifest[table] | change})


def test_accessors(spark, made):
    built = made[1].index
    heron = built.postings.join(built.lexicon.where("term = 'herons'"), "term_id").first()
    assert index.weight_of(built, "herons", heron["doc_id"]) == heron["weight"] and index.weight_of(built, "nothing", 0) is None and index.weight_of(built, "herons", -1) is None
    assert index.idf_of(built, "herons") == heron["idf"] and index.idf_of(built, "nothing") is None
    assert index.norm_of(built, heron["doc_id"]) > 0 and index.norm_of(built, -5) is None


def test_work_limits(spark, made):
    built, asked = made[1].index, spark.createDataFrame([(1, "windmill barley herons")], "query_id long, text string")
    assert search.search(built, asked, max_work=5).count() == 3
    with pytest.raises(EngineError, match="ranking.work"):
        search.search(built, asked, max_work=4)
    words, keys = suggest.dictionary(spark.createDataFrame([("abc", 1), ("bcd", 1), ("xyz", 1)], "term string, frequency long")), spark.createDataFrame([(1, "ab")], "query_id long, key string")
    assert suggest.suggest(keys, words, max_work=12).count() == 2
    with pytest.raises(EngineError, match="recommend.work"):
        suggest.suggest(keys, words, max_work=11)
    with_index = suggest.suggest(keys, words, characters_of=suggest.character_index(words))
    assert sorted(map(tuple, with_index.collect())) == sorted(map(tuple, suggest.suggest(keys, words).collect()))


def test_service_limits_and_cache(spark, made):
    manager = SnapshotManager(spark, made[0])
    manager.load("v1")
    manager.publish()
    service = SearchService(spark, manager, Settings(stop_words=("a", "the"), cache_capacity=8, max_query_terms=2))
    ask = lambda q, **o: service.execute("SEARCH", json.dumps({"query": q, **o}))
    assert ask("The  WINDMILL")[1] == ask("the windmill ")[1] and (service.cache.hits, service.cache.misses) == (1, 1)
    assert ask("the windmill", top_k=3)[0] == OK and service.cache.misses == 2
    assert ask("one two three")[0] == RESOURCE_LIMIT and ask("the a")[0] == INVALID_REQUEST
    small = SearchService(spark, manager, Settings(max_work=1))
    assert small.execute("SEARCH", '{"query": "barley"}') == (RESOURCE_LIMIT, '{"error":"ranking.work"}') and small.execute("SUGGEST", '{"key": "barley"}')[0] == RESOURCE_LIMIT
    many = service.execute_batch([("PING", "{}"), ("SEARCH", '{"query": "herons"}'), ("SEARCH", '{"query": "barley"}'), ("SEARCH", "["), ("SUGGEST", '{"key": "barly", "top_k": 1}'), ("SEARCH", '{"query": "barley", "mode": "and"}')])
    assert [s for s, _ in many] == [OK, OK, OK, INVALID_REQUEST, OK, OK] and [len(json.loads(b).get("results", [])) for _, b in many] == [0, 1, 2, 0, 1, 2]
    assert cache_key(made[1], "SUGGEST", {"key": " A", "normalize_key": False, "top_k": 1})[2] == " A" and made[1].digest in cache_key(made[1], "SEARCH", parse_request("SEARCH", '{"query": "x"}', Settings()))[0]
    late = SearchService(spark, manager, Settings(request_timeout_ms=1))
    assert late.execute("SEARCH", '{"query": "barley"}')[0] == DEADLINE_EXCEEDED
    with Deadline(spark, 50) as deadline:
        deadline.check()
        time.sleep(0.1)
        assert deadline.error(ValueError()).context == "service.deadline"
        with pytest.raises(EngineError, match="service.deadline"):
            deadline.check()
    assert spark.range(5).count() == 5


@pytest.mark.parametrize(("body", "context"), [
    ("{", "request.json"), ("[]", "request.json"), ("﻿{}", "request.json"), ('{"query": NaN}', "request.json"), (b'{"query": "\xff"}', "request.utf8"), ('{"query": ' + "[" * 64 + "]" * 64 + "}", "request.depth"),
    ('{"query": "\\ud800"}', "request.utf8"), ('{"query": "a\\u0000"}', "request.value"), ('{"query": "x", "top_k": true}', "request.value"),
])
def test_request_json(body, context):
    with pytest.raises(EngineError) as e:
        parse_request("SEARCH", body, Settings())
    assert e.value.context == context and status_of(e.value) == INVALID_REQUEST


def test_ping_body():
    assert parse_request("PING", "{}", Settings())["top_k"] == 10
    with pytest.raises(EngineError, match="request.json"):
        parse_request("PING", "{ }", Settings())
    assert status_of(EngineError("weights.numeric", "")) == INTERNAL_ERROR


def test_settings_ranges():
    assert Settings.load('{"schema_version": 2, "max_top_k": 7}', ["--workers=3", "--stop-words=a,b"], cache_capacity=1).stop_words == ("a", "b")
    for text, args in (('{"schema_version": 2, "max_top_k": 0}', None), ('{"schema_version": 2, "workers": "4"}', None), (None, ["--workers=04"]), (None, ["workers=4"]), (None, ["--nothing=1"]), (None, ["--max-top-k=101"])):
        with pytest.raises(EngineError, match="config"):
            Settings.load(text, args)


def test_log(tmp_path):
    log = Log(str(tmp_path / "log"), most_bytes=2048, files=3, clock=lambda: 1.0)
    assert not log.write("debug", "x") and log.query("SEARCH", 0, 5) and not log.write("info", "x", text="y" * 3000) and log.dropped == 1
    for k in range(200):
        log.query("PING", k % 2, k)
    names = sorted(p.name for p in tmp_path.iterdir())
    assert names == ["log", "log.1", "log.2"] and all(p.stat().st_size <= 2048 for p in tmp_path.iterdir())
    last = json.loads((tmp_path / "log").read_text().splitlines()[-1])
    assert last == {"ts_us": 1_000_000, "level": "warning", "event": "query", "kind": "PING", "status": 1, "micros": 199}
    for bad in ({"level": "loud"}, {"most_bytes": 1}, {"files": 0}):
        with pytest.raises(EngineError, match="log"):
            Log(str(tmp_path / "x"), **bad)


def test_one_in_flight(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), rng.randrange(500), rng.randrange(60)) for i in range(200)]
    got = {r["request_id"]: (r["start"], r["finish"]) for r in R.one_in_flight(spark.createDataFrame(rows, "request_id long, conn_id long, arrival long, micros long")).collect()}
    done = {}
    for i, c, a, m in sorted(rows, key=lambda r: (r[2], r[0])):
        start = max(a, done.get(c, 0))
        done[c] = start + m
        assert got[i] == (start, start + m)


def test_deadline_queue(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(20), rng.choice([None, *range(0, 100, 7)])) for k in range(120)]
    queue = R.DeadlineQueue()
    for _, key, when in rows:
        queue.cancel(key) if when is None else queue.set(key, when)
    want = R.due_deadlines(spark.createDataFrame(rows, "seq long, key long, when long"), 50).collect()
    assert queue.pop_due(50) == [r["key"] for r in want] and queue.pop_due(50) == [] and (queue.next() is None or queue.next() > 50)


def test_output_and_io(spark):
    got = R.bounded_output(spark.createDataFrame([(0, "x" * 10), (0, "y")], "status long, body string"), 9).collect()
    assert [tuple(r) for r in got] == [(6, '{"error":"service.output"}'), (0, "y")]
    io = R.io_totals(spark.createDataFrame([(1, 5, 2, 7), (1, 1, 1, 9), (2, 3, 0, 1)], "conn_id long, bytes_in long, bytes_out long, high_water long")).collect()
    assert {tuple(r) for r in io} == {(1, 6, 3, 9), (2, 3, 0, 1)}


def test_drain(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("drained").trigger(availableNow=True).start()
    assert R.drain(q, 60) and not q.isActive and spark.sql("select * from drained").count() == 5
    q = spark.readStream.format("rate").load().writeStream.format("noop").start()
    assert not R.drain(q, 0.5) and not q.isActive
