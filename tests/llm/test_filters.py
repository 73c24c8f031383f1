import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_texts import prose

from quillspark.llm import quality as Q
from quillspark.llm._bytes import chunks
from quillspark.llm.quality import score_documents
from quillspark.llm.queries import op3_repetition
from quillspark.llm.repetition import common_prefixes, repetition_rules, suffix_array


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), twice, len(marked), w


def repeats(w, least):
    """Longest repeat and covered words by comparing all pairs of places."""
    longest, covered = 0, set()
    for a in range(len(w)):
        for b in range(a + 1, len(w)):
            n = 0
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            if n >= least:
                longest = max(longest, n)
                covered |= {*range(a, a + n), *range(b, b + n)}
    return longest, len(covered)


def maximal(w, least):
    """Different repeated runs of words that no repeat with as many places contains: extended by a word to either side, some place is lost."""
    places = {}
    for a in range(len(w)):
        for b in range(a + least, len(w) + 1):
            places.setdefault(tuple(w[a:b]), []).append(a)
    found = 0
    for run, at in places.items():
        if len(at) > 1:
            left = {w[a - 1] if a else None for a in at}
            right = {w[a + len(run)] if a + len(run) < len(w) else None for a in at}
            found += (len(left) > 1 or None in left) and (len(right) > 1 or None in right)
    return found


def test_maximal_repeats(spark):
    """Counts of maximal repeated substrings, against all substrings; a text's empty table gives none."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    texts += [" ".join(["p q r"] * 9), " ".join(f"w{k}" for k in range(30)), " ".join([f"w{k}" for k in range(15)] * 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (2, 5):
        for r in repetition_rules(df, least=least).collect():
            w = texts[r["doc_id"]].split()
            assert r["n_repeats"] == maximal(w, least), (least, w)
    assert repetition_rules(df.limit(0)).count() == 0


def test_repetition(docs, rows):
    got = repetition_rules(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        n, chars, symbols, lines, repeat, w = measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        if n <= 130:
            assert (r["longest_repeat"], r["n_covered_words"]) == repeats(w, 10)
            assert r["kept"] == (not r["base_failed"] and 2 * r["n_covered_words"] <= n and r["longest_repeat"] <= 60)


def test_repetition_query(spark, tmp_path):
    """Each limit of the query alone rejects a text that the base rule keeps."""
    word = iter(range(100_000))
    fresh = lambda n: [f"w{next(word)}" for _ in range(n)]
    passage, long_ = fresh(50), fresh(61)
    texts = [fresh(550) + sum((passage + [f"z{k}"] for k in range(9)), []), fresh(900) + long_ + ["zz"] + long_, fresh(900) + passage + ["zz"] + passage]
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op3_repetition(spark, str(tmp_path)).collect()}
    assert [got[i]["base_failed"] for i in range(3)] == [False] * 3 and [got[i]["kept"] for i in range(3)] == [False, False, True]
    assert got[0]["longest_repeat"] == 50 and got[1]["n_covered_words"] == 122


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (40, 2), (60, 3), (50, 1)):
        text = np.sort(rng.integers(0, 3, n))
        sym = rng.integers(1, k + 1, n).astype(np.uint64)
        order = suffix_array(sym, text)
        suffix = lambda i, s=sym, t=text: (t[i], tuple(s[i : np.searchsorted(t, t[i], "right")]))
        assert order.tolist() == sorted(range(n), key=suffix)
        lcp = common_prefixes(order, sym, text)
        for j in range(1, n):
            a, b = suffix(order[j - 1]), suffix(order[j])
            m = 0
            while a[0] == b[0] and m < min(len(a[1]), len(b[1])) and a[1][m] == b[1][m]:
                m += 1
            assert lcp[j] == m


def test_quality(spark, none):
    rng = random.Random(9)
    good = [(i, prose(rng, 60)) for i in range(150)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split())) for i in range(60)] + [(300 + i, (rng.choice("abc") + "x ") * 80) for i in range(40)]
    docs = spark.createDataFrame([*good, *bad, (900, None), (901, ""), (None, "a text"), (902, "x" * 40_000), (1, good[1][1])], "doc_id long, text string").withColumnRenamed("text", "text")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(900, 1, 0), (None, 1, 0), (7, None, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    got = score_documents(docs, labels, most=200).collect()
    assert len(got) == 255
    by = {r["doc_id"]: r for r in got}
    held = [i for i, _ in good + bad if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i]["held_out"] == (i in held) for i, _ in good + bad) and by[None]["held_out"] is None
    assert sum((by[i]["predicted"] == 1) == (i < 200) for i in held) >= 0.95 * len(held)
    assert by[900]["score"] == by[901]["score"] == 0.0 and all(0 <= r["score"] <= 1 and (r["predicted"] == 1) == (r["score"] >= 0.3) for r in got)
    assert score_documents(none, labels).count() == 0
    assert {r["score"] for r in score_documents(docs.limit(3), labels.limit(0)).collect()} <= {0.0, 1.0}


def test_quality_votes(spark):
    """Scores are the votes of the nearest labelled vectors, against plain products; every word counts, in any script."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(5, 80)) for _ in range(60)] + ["".join(rng.choice("абвгдежз ") for _ in range(200)) for _ in range(30)] + ["".join(rng.choice("一二三四五 ") for _ in range(90)) for _ in range(30)]
    marks = [int(i < 60 or i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(500, texts[3], "x", 1)], "doc_id long, text string, held_out string, `a b` int")
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(5, marks[5])], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in score_documents(df, labels, rank=8, neighbours=7, sharp=5.0).collect()}
    assert got[500]["score"] == got[3]["score"] and got[500]["a b"] == 1
    taught = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    chunk = next(iter(chunks(pa.array([texts[i] for i in taught]))))
    of, term, weight = Q._terms(chunk)
    space = Q.Space(of, term, weight, np.array([marks[i] for i in taught]) > 0, 8)
    vectors = space.project(next(iter(chunks(pa.array(texts)))))[0]
    for i, v in enumerate(vectors):
        like = sorted(((float(v @ u), marks[k]) for u, k in zip(space.vectors, taught, strict=True)), reverse=True)
        # Neighbours that tie with the last one may be chosen either way.
        rest = [x for x in like if x[0] > like[6][0] + 1e-6]
        if len({m for c, m in like if abs(c - like[6][0]) <= 1e-6}) == 1:
            top = rest + [x for x in like if abs(x[0] - like[6][0]) <= 1e-6][: 7 - len(rest)]
            w = [np.exp(5 * c) for c, _ in top]
            assert abs(got[i]["score"] - sum(a * m for a, (_, m) in zip(w, top, strict=True)) / sum(w)) < 1e-4
    long_words = {t for t in Q._terms(next(iter(chunks(pa.array(["electroencephalography otorhinolaryngologist"])))))[1].tolist()}
    assert long_words != {t for t in Q._terms(next(iter(chunks(pa.array(["electroencephalographs otorhinolaryngologies"])))))[1].tolist()}
