"""Queries that SQL can't express, against plain loops over the same rows."""

import datetime
import hashlib
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from quillspark.plans import registry
from quillspark.sources import files
from quillspark.sources.files import feed_items
from quillspark.sources.html import fragment_text, page_content

BITS = ["<p>", "</p>", "<b>bold</b>", "plain text", "<ul><li>item", "</ul>", "<script>no()</script>", "&amp;", "<br>", "  ", "<td>cell", "<main>", "</main>", "<h1>Head</h1>", "<nav>menu</nav>", "é😀", "<pre> x\n y</pre>"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("sf"), random.Random(17)
    pages = [(i, f"http://h/{i}?a=1&b={i}", "".join(rng.choices(BITS, k=rng.randrange(0, 25)))) for i in range(60)] + [(60, "http://h/none", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    start = datetime.datetime(2024, 1, 1)
    events = [(i, rng.randrange(40), rng.choice(["view", "click", "buy"]), start + datetime.timedelta(seconds=rng.randrange(5000)), rng.random() * 100) for i in range(600)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(f"{d}/events.parquet")
    return str(d), pages, events


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_html_text(spark, sf):
    got = {r["page_id"]: (r["n_chars"], r["digest"], r["recovered"]) for r in registry.queries()["html_text"](spark, sf[0]).collect()}
    want = {}
    for i, _u, html in sf[1]:
        text, recovered = fragment_text(html or "")
        want[i] = (len(text), digest(text), recovered)
    assert got == want


def test_main_content(spark, sf):
    got = {r["page_id"]: (r["title"], r["n_chars"]) for r in registry.queries()["main_content"](spark, sf[0]).collect()}
    for i, _u, html in sf[1]:
        title, _url, text = page_content(html or "")
        assert got[i] == (title, len(text or ""))


def test_rss_items(spark, sf):
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")
    got = {r["input_path"]: (r["record_ordinal"], r["status"], r["n_chars"], r["n_issues"]) for r in registry.queries()["rss_items"](spark, sf[0]).where("input_path <> 'p/60'").collect()}
    for i, url, html in sf[1][:-1]:
        feed = f'<rss version="2.0"><channel><item><title>{escape(url)}</title><description>{escape(html)}</description></item></channel></rss>'
        _p, k, status, record, issues = feed_items(f"p/{i}", feed.encode())[0]
        assert got[f"p/{i}"] == (k, status, len(record["content"]) if record else None, len(issues))


def test_lru_replay(spark, sf):
    got = {r["shard"]: (r["hits"], r["misses"], r["evicted"]) for r in registry.queries()["lru_replay"](spark, sf[0]).collect()}
    want = {}
    for shard in {u % 16 for _i, u, *_ in sf[2]}:
        held, n = OrderedDict(), [0, 0, 0]
        for _i, u, kind, _ts, _v in sorted((e for e in sf[2] if e[1] % 16 == shard), key=lambda e: (e[3], e[0])):
            key = f"{kind}/{u}"
            if key in held:
                n[0] += 1
                held.move_to_end(key)
                continue
            n[1] += 1
            held[key] = True
            if len(held) > 8:
                held.popitem(last=False)
                n[2] += 1
        want[shard] = tuple(n)
    assert got == want


def test_feeds(spark):
    """Pages written as feeds are read again as they were."""
    rows = [(f"p/{i:03}", f"T <{i}> & co", f"http://h/?a={i}&b" if i % 3 else None, f"line {i}\n  indented & <kept> é😀\nend") for i in range(25)] + [("p/x", "t", "u", "bell \x07"), ("p/y", "t", "u", " \n"), ("p/z", "t", "u", None)]
    made = files.feeds(spark.createDataFrame(rows, "input_path string, title string, url string, content string"), most=10)
    assert sorted((r["feed"], r["items"]) for r in made.collect()) == [(0, 10), (1, 10), (2, 5)]
    read = files.read_feeds(made.select(F.concat(F.lit("f/"), "feed").alias("input_path"), F.encode("xml", "UTF-8").alias("bytes"))).orderBy("input_path", "record_ordinal").collect()
    assert [(r["record"]["title"], r["record"]["url"], r["record"]["content"]) for r in read] == [r[1:] for r in rows[:25]]
