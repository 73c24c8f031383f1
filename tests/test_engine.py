"""Text, index, search, display, suggestion and fingerprints, on literals and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EngineError
from quillspark.functions import text as X
from quillspark.operators import display, fingerprints, index, search, suggest, terms
from quillspark.sources.chinese import Segmenter, chinese_tokenizer


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t")).first()[0]


WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def test_normalize(spark):
    keep = "".join(map(chr, (0x200B, 0x2060, 0xFEFF, 0x180E, 0x1C)))
    cases = [("\t Mixed CASE \n\n words\u2009here ", "mixed case words here"), ("ÄÖ Ω Ⅷ Groß ＺＡＨＬ", "ÄÖ Ω Ⅷ groß ＺＡＨＬ"), (keep, keep), ("", ""), ("".join(map(chr, WHITE)), ""), ("Z" * 50 + "\v" + "Q", "z" * 50 + " q")]
    cases += [(f"a{chr(c)}{chr(c)}B", "a b") for c in WHITE]
    rows = spark.createDataFrame([(i, a) for i, (a, _b) in enumerate(cases)], "i int, t string").select("i", X.normalize("t").alias("n"), X.normalize(X.normalize("t")).alias("m")).collect()
    for r in rows:
        assert r["n"] == r["m"] == cases[r["i"]][1]


def test_tokens(spark):
    assert one(spark, "it's half-past 7:45, v2.0_beta (x86)!", X.english_tokens) == "it s half past 7 45 v2 0 beta x86".split()
    assert one(spark, "naïve Ωmega ７8 日本Tokyo🚲bike", X.english_tokens) == ["na", "ve", "mega", "8", "Tokyo", "bike"]
    assert one(spark, None, X.english_tokens) is None


def test_small_functions(spark):
    assert one(spark, "a/b/.hid.den.txt", X.file_stem) == ".hid.den" and one(spark, "d/.rc", X.file_stem) == ".rc" and one(spark, "x", X.file_stem) == "x"
    assert one(spark, "<&\"'>", X.escape_html) == "&lt;&amp;&quot;&#39;&gt;"
    assert [one(spark, v, X.unsigned) for v in ("0", "12", "01", "-1", "x", "99999999999999999999")] == [0, 12, None, None, None, None]
    assert [one(spark, v, X.is_relative_path) for v in ("a/b", "/a", "a//b", "a/../b", "", ".", "a/")] == [True, False, False, False, False, False, False]


def test_weights(spark):
    docs = spark.createDataFrame([(1, "a a a b b b b"), (2, None)], "doc_id long, content string").where("doc_id = 1")
    made = index.build_index(docs, exact=True)
    assert {(r["term"], r["tf"], round(r["weight"], 12)) for r in made.postings.collect()} == {("a", 3, 0.6), ("b", 4, 0.8)}
    assert made.doc_stats.first()["norm"] == 5.0


def oracle_search(docs, queries, mode, k):
    tf = {d: {} for d, _ in docs}
    split = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in t).split()
    for d, t in docs:
        for w in split(t):
            tf[d][w] = tf[d].get(w, 0) + 1
    df = {}
    for d in tf:
        for w in tf[d]:
            df[w] = df.get(w, 0) + 1
    idf = {w: 1 + math.log((len(docs) + 1) / (n + 1)) for w, n in df.items()}
    norm = {d: math.sqrt(sum((n * idf[w]) ** 2 for w, n in ws.items())) for d, ws in tf.items()}
    out = []
    for q, t in queries:
        words = split(t)
        q_tf = {w: words.count(w) for w in words}
        known = {w: n * idf[w] for w, n in q_tf.items() if w in idf}
        if mode == "and" and len(known) < len(q_tf):
            continue
        length = math.sqrt(sum(v * v for v in known.values()))
        got = []
        for d, ws in tf.items():
            hit = [w for w in known if w in ws]
            if hit and (mode == "or" or len(hit) == len(known)):
                got.append((round(min(1.0, sum(known[w] / length * ws[w] * idf[w] / norm[d] for w in hit)), 9), d))
        got.sort(key=lambda x: (-x[0], x[1]))
        out += [(q, i + 1, d, s) for i, (s, d) in enumerate(got[:k])]
    return out


@pytest.mark.parametrize("mode", ["or", "and"])
def test_search(spark, mode):
    rng = random.Random(129)
    words = "red green blue lantern river boat gate copper kettle paper".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(40)]
    queries = [(i, " ".join(rng.choices([*words, "absent"], k=rng.randrange(0, 4)))) for i in range(12)]
    made = index.build_index(spark.createDataFrame(docs, "doc_id long, content string"))
    got = search.search(made, spark.createDataFrame(queries, "query_id long, text string"), mode, 5, digits=9).collect()
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in got) == sorted(oracle_search(docs, queries, mode, 5))
    known = search.known_terms(search.query_terms(spark.createDataFrame(queries, "query_id long, text string")), made.lexicon)
    some = {(r["query_id"], r["doc_id"]) for r in search.candidates(known, made.postings, mode).collect()}
    assert some == {x[0::2][:2] for x in [(q, 0, d) for q, _r, d, _s in oracle_search(docs, queries, mode, 1000)]}
    with pytest.raises(EngineError, match="query.mode"):
        search.candidates(known, made.postings, "xor")


def window_of(words, body, window, leading):
    """The rule of the window, by code points: from some places before the first match, moved back so that the window is full."""
    fold = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    places = [p for p in (fold(body).find(fold(w)) for w in words) if p >= 0]
    size = min(window, len(body))
    start = min(max(min(places) - leading, 0), len(body) - size) if places else 0
    return body[start : start + size], len(body[:start].encode()), bool(places), start > 0, start + size < len(body)


SUMMARY = [(w, b, n, k, window_of(w.split("|"), b, n, k)) for w, b, n, k in [
    ("heron", "A Heron stood in the reeds", 9, 2), ("reeds|stood", "A heron stood in the reeds", 6, 0), ("reeds", "A heron stood in the reeds", 12, 3), ("мост", "Старый мост у реки 🌉", 7, 1), ("🌉", "Старый мост у реки 🌉", 3, 1),
    ("absent", "A heron stood", 5, 4), ("any", "", 4, 1), ("a", "a", 1, 0), ("Ö", "öÖö", 1, 1),
]]


@pytest.mark.parametrize(("words", "body", "window", "leading", "want"), SUMMARY)
def test_summary(spark, words, body, window, leading, want):
    df = spark.createDataFrame([(body, words.split("|"))], "t string, w array<string>")
    assert tuple(df.select(display.summary(F.col("t"), F.col("w"), window, leading).alias("s")).first()["s"]) == want


def test_highlight(spark):
    assert display.mark("<&\"'", ["<", "&", '"', "'"]) == ("<mark>&lt;&amp;&quot;&#39;</mark>", [(0, 4)])
    assert display.mark("&", ["amp"]) == ("&amp;", []) and display.mark("&lt;<mark>", ["x"]) == ("&amp;lt;&lt;mark&gt;", [])
    assert display.mark("Éé é", ["é"]) == ("É<mark>é</mark> <mark>é</mark>", [(2, 2), (5, 2)])
    assert display.mark("aaaa", ["a"])[1] == [(0, 4)] and display.mark("ababa", ["aba"])[1] == [(0, 5)]
    got = spark.createDataFrame([("The the", ["the"]), (None, None)], "t string, w array<string>").select(display.highlight("t", "w").alias("h")).collect()
    assert got[0]["h"]["html"] == "<mark>The</mark> <mark>the</mark>" and got[1]["h"]["html"] == ""


def test_suggest(spark):
    words = suggest.dictionary(spark.createDataFrame([("cat", 2), ("bat", 5), ("rat", 5), ("act", 9), ("dog", 100)], "term string, frequency long"))
    got = suggest.suggest(spark.createDataFrame([(1, "cat"), (2, ""), (3, "c t"), (4, "CAT")], "query_id long, key string"), words, 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["term"], r["distance"]) for r in got] == [(1, "cat", 0), (1, "bat", 1), (1, "rat", 1), (1, "act", 2)]
    far = suggest.dictionary(spark.createDataFrame([("aqqqqqq", 1), ("bb", 100)], "term string, frequency long"))
    assert [(r["term"], r["distance"]) for r in suggest.suggest(spark.createDataFrame([(1, "aa")], "query_id long, key string"), far).collect()] == [("aqqqqqq", 6)]


def test_word_hashes():
    got = [f"{int(h):016x}" for h in fingerprints.word_hashes([w.encode() for w in ("a", "b", "中国", "😀")])]
    assert got == ["82a2a958a9bece5b", "6e673288764ad2d0", "b76ab2bc7f31fcf1", "da89b0991f06f386"]


def test_simhash(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a a b b"), (3, "")], "doc_id long, content string")
    got = {r["doc_id"]: r["simhash"] for r in fingerprints.simhash(docs, terms.term_frequency(docs)).collect()}
    a, b = 0x82A2A958A9BECE5B, 0x6E673288764AD2D0
    assert got[1] & (2**64 - 1) == a & b and got[2] & (2**64 - 1) == a and got[3] is None


@pytest.mark.parametrize("distance", [0, 3])
def test_duplicates(spark, distance):
    rng = random.Random(115 + distance)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for i in range(60):
        h = rng.choice(base)
        for _ in range(rng.randrange(0, 5)):
            h ^= 1 << rng.randrange(64)
        rows.append((i, f"p{rng.randrange(3)}", i, None if rng.random() < 0.05 else h - 2**64 if h >= 2**63 else h))
    kept, want = [], {}
    for i, p, o, h in sorted(rows, key=lambda r: (r[1], r[2])):
        if h is None:
            want[i] = ("no_features", None, None)
            continue
        hit = next(((k, bin((x ^ h) & (2**64 - 1)).count("1")) for k, x in kept if bin((x ^ h) & (2**64 - 1)).count("1") <= distance), None)
        want[i] = ("duplicate", *hit) if hit else ("kept", None, None)
        if not hit:
            kept.append((i, h))
    got = fingerprints.duplicates(spark.createDataFrame(rows, "doc_id long, input_path string, record_ordinal long, simhash long"), distance).collect()
    assert {r["doc_id"]: (r["disposition"], r["retained_id"], r["distance"]) for r in got} == want


def test_statistics_in_place(spark):
    docs = spark.createDataFrame([(1, "a b A"), (2, ""), (3, None), (4, "!? c")], "doc_id long, content string")
    got = index.statistics_in_place(terms.tokens(docs))
    assert set(map(tuple, got.collect())) == set(map(tuple, index.document_statistics(docs, terms.term_frequency(docs)).collect())) == {(1, 3, 2), (2, 0, 0), (3, 0, 0), (4, 1, 1)}


def test_suggest_many_keys(spark, monkeypatch):
    """Many keys meet the terms in cells, without a join that makes a row for each pair; rows equal a plain loop's."""
    rng = random.Random(5)
    word = lambda top: "".join(rng.choices("abcdeé😀", k=rng.randrange(1, top)))
    terms_ = sorted({word(9) for _ in range(300)} | {"zzz", "a" * 90, "ab" * 35, "q" * 8}, key=str.encode)
    rows = [(i, t, rng.randrange(1, 4)) for i, t in enumerate(terms_)]
    keys = [(i, word(8)) for i in range(70)] + [(70, "ab" * 40), (71, "b" * 64), (72, "q"), (73, "ww"), (74, ""), (75, "a b")]
    monkeypatch.setattr(suggest, "CELL_KEYS", 30)
    monkeypatch.setattr(suggest, "CELL_TERMS", 120)

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = set()
    for q, key in keys[:74]:
        found = sorted((far(key, t), -f, t.encode(), i) for i, t, f in rows if set(key) & set(t))[:10]
        want |= {(q, r, i, t.decode(), d, -f) for r, (d, f, t, i) in enumerate(found, 1)}
    made = suggest.suggest(spark.createDataFrame(keys, "query_id long, key string"), spark.createDataFrame(rows, "term_id long, term string, frequency long"), 10)
    assert set(map(tuple, made.collect())) == want
    assert "CoGroup" in made._jdf.queryExecution().executedPlan().toString()


def test_duplicates_without_broadcast(spark):
    """Tables that grow with the documents don't pass through the driver, however small their files are."""
    rows = [(i, "p", i, (i * 0x9E3779B97F4A7C15 % (1 << 63)) ^ (i % 3)) for i in range(40)] + [(40 + i, "q", i, 7 ^ (1 << i)) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, input_path string, record_ordinal long, simhash long")
    for made in (fingerprints.duplicates(frame), fingerprints.near_pairs(frame.select(F.col("doc_id").alias("ordinal"), "simhash"))):
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()


def test_chinese(spark):
    cut = Segmenter(["纸船 10 n", "河边 10 n", "停 5 v", "在 9 p", "闸门 4 n", "旁 3 f", "灯笼 8 n"], ["绿色"])
    assert cut.tokens("纸船停在河边闸门旁。Green 绿色灯笼xyz") == ["纸船", "停", "在", "河边", "闸门", "旁", "Green", "绿色", "灯笼", "xyz"]
    docs = spark.createDataFrame([(1, "纸船 灯笼 灯笼 AB")], "doc_id long, content string")
    assert {(r["term"], r["tf"]) for r in terms.term_frequency(docs, chinese_tokenizer(cut)).collect()} == {("纸船", 1), ("灯笼", 2), ("ab", 1)}
    for bad in (["词 1"], ["词 0 n"], ["词 1 n", "词 2 n"]):
        with pytest.raises(EngineError, match="cppjieba.dictionary"):
            Segmenter(bad)
    never = "-3.14e100"
    model = [f"-0.2 {never} {never} -1.5", f"{never} -0.1 -2 {never}", f"-0.5 {never} {never} -0.7", f"{never} -0.3 -1.2 {never}", f"-0.6 {never} {never} -0.6", "小:-1", "明:-1", "中:-1", "的:-1"]
    assert Segmenter(["大 1 a"], [], model).cut("小明的") == ["小明", "的"]


@pytest.mark.parametrize("block", [40, 1_000_000])
def test_many_queries_go_through_the_documents(spark, monkeypatch, block):
    """A batch too large to be broadcast has the same hits and ranks, copies' ties included, and no row for a pair of a query's and a document's term is dealt out."""
    rng = random.Random(6)
    words = "the of and river lantern boat copper kettle gate paper green road".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 9))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:40])]
    queries = spark.createDataFrame([(i, t + " nobody" * (i % 7 == 0)) for i, t in rows[::3]], "query_id long, text string")
    made = index.build_index(spark.createDataFrame(rows, "doc_id long, content string"))
    found = {}
    for many in (False, True):
        if many:
            monkeypatch.setattr(search, "BROADCAST_ROWS", 0)
            monkeypatch.setattr(search, "BLOCK_ROWS", block)
        for mode in ("or", "and"):
            known = search.known_terms(search.query_terms(queries), made.lexicon)
            assert known.small != many
            pairs = search.candidates(known, made.postings, mode)
            best = search.search(made, queries, mode, 4, digits=9)
            found[many, mode] = sorted(map(tuple, pairs.collect())), sorted(map(tuple, best.collect()))
            assert not many or "hashpartitioning(query_id" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert found[True, "or"] == found[False, "or"] and found[True, "and"] == found[False, "and"]
    assert all(len(x) > 40 for f in found.values() for x in f)
