"""Fingerprints, personal data, licences, preferences and mixing."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from llm_texts import prose
from pyspark.sql import functions as F

from quillspark.llm._order import Blocks
from quillspark.llm.imatch import edited_fingerprints
from quillspark.llm.licences import LICENCE, TEMPLATES, _anchor, scan_licences, train
from quillspark.llm.mixing import Clash, calibrate, mix_sources, rake
from quillspark.llm.pii import personal_data
from quillspark.llm.preference import format_preferences, preference_pairs


def lexicons(rows, rare, common):
    """The band's terms, and a function from a text to its terms in it."""
    terms = lambda t: {w for w in re.split(r"[^\w]|_", (t or "").lower()) if w}
    df = Counter(w for _, t in rows for w in terms(t))
    band = {w for w, c in df.items() if max(2.0, rare * len(rows)) <= c <= max(2.0, common * len(rows))}
    return band, lambda t: terms(t) & band


def test_imatch(spark, docs, rows, none):
    rare, common = 0.01, 0.5
    got = edited_fingerprints(docs, rare=rare, common=common).collect()
    order = sorted(rows, key=lambda r: (r[0], r[1] or ""))
    band, terms = lexicons(rows, rare, common)
    rows_of = spark.createDataFrame([(w,) for w in band], "w string").selectExpr("w", "xxhash64(w) as h", "transform(sequence(0, 3), g -> xxhash64(xxhash64(w), g)) as own").collect()
    number, own = {r["w"]: r["h"] for r in rows_of}, {r["h"]: r["own"] for r in rows_of}

    def kept(text):
        """The terms that each lexicon keeps of a text, the whole band first; none if the band has none of its terms."""
        h = sorted(number[w] for w in terms(text))
        return [tuple(h)] + [tuple(x for x in h if not (own[x][f // 4] >> 16 * (f % 4)) & (2**d - 1)) for f in range(16) for d in range(2, 11)] if h else None

    def like(a, b):
        x, y = kept(a), kept(b)
        if x is None or y is None:
            return 1.0 if a == b else None
        best = 0.0
        for d in range(9):
            met = [(p, q) for p, q in zip(x[1 + d :: 9], y[1 + d :: 9], strict=True) if p or q]
            best = max(best, sum(p == q for p, q in met) / len(met) if len(met) >= 4 else 0.0)
        return 1.0 if x == y else best

    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want.append((i, t, edited, nxt))
    texts = dict(rows)
    have = {(r["doc_id"], r["edited_sha256"]): r for r in got}
    assert len(got) == len(rows)
    told = 0
    for i, t, edited, nxt in want:
        r = have[i, hashlib.sha256(edited.encode()).hexdigest()]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        for column, other in (("near_edited", edited), ("near_next", nxt)):
            if like(t, other) is not None:
                told += 1
                assert abs(r[column] - like(t, other)) < 1e-9
        if kept(t):
            assert [bool(x) for x in r["fingerprint"].split(",")] == [bool(x) for x in kept(t)]
    assert told > len(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    assert next(r for r in got if r["doc_id"] == 81)["near_edited"] == 1.0
    assert edited_fingerprints(none).count() == 0
    assert sorted(r["fingerprint"] for r in edited_fingerprints(docs, rare=rare, common=common, held=0).collect()) == sorted(r["fingerprint"] for r in got)


@pytest.mark.parametrize("spread", ["dense", "sparse", "clustered"])
def test_next_rows(spark, spread):
    """The next row is right, and blocks are even, wherever the ids lie."""
    rng = random.Random(1)
    n = 3000
    ids = {"dense": list(range(n)), "sparse": [rng.randrange(-(2**62), 2**62) for _ in range(n)], "clustered": [*range(n // 2), *(10**12 + rng.randrange(10**15) for _ in range(n // 2))]}[spread]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids] + [(None, f"none {k}") for k in range(300)], "doc_id long, text string")
    blocks = df.select("doc_id", Blocks(df.select("doc_id"), "doc_id").of(F.xxhash64("text")).alias("block")).collect()
    held = sorted((r["doc_id"], r["block"]) for r in blocks if r["doc_id"] is not None)
    assert [b for _, b in held] == sorted(b for _, b in held) and max(Counter(b for _, b in held).values()) < 900
    assert len({r["block"] for r in blocks if r["doc_id"] is None}) > 3 and all((r["block"] < 0) == (r["doc_id"] is None) for r in blocks)
    order = sorted(set(ids))
    got = {r["doc_id"]: r["edited_sha256"] for r in edited_fingerprints(df.where("doc_id is not null")).collect()}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = f"text {a}", f"text {b}"
        assert got[a] == hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(x) < 256 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


CASES = [
    "mail a@b.co x.y+z@d-e.f.g, 1.2.3.4.5 300.1.1.1 001.02.3.255", None, "", "a@b.c_d@e.f q@@w.e a@b a@b.c.d", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (988) 555-2485 😀 +12 3 x@y.zz", "9" * 40 + " " + "1 " * 3000,
    "a" * 20000 + " " + "1.2." * 2000 + " +1" + "(" * 3000, "4111111111111111+491234567890 5. 6.7.8.9@x.y.z", "+ +1 2 +123456789012345678 +1-2-3-4-5-6-7-8. 12", "\n\n0000000000000000 é́ 1.1.1.1\n a.b@c.d-e.fé",
]


def test_pii(spark, none):
    df = spark.createDataFrame([(i, t, "z", 9) for i, t in enumerate([*CASES, CASES[0]])], "doc_id long, text string, lang string, n_email int")
    got = {r["doc_id"]: r for r in personal_data(df).collect()}
    for i, t in enumerate([*CASES, CASES[0]]):
        want = base(t)
        assert got[i]["spans"] == ",".join(want) and got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
    assert got[4]["clean_text"] == "[CARD] and 4111-1111-1111-1112 [PHONE] 😀 +12 3 [EMAIL]" and got[1]["clean_text"] is None and got[4]["lang"] == "z"
    assert personal_data(none).count() == 0


def test_pii_in_long_texts(spark):
    """Pieces meet at places that no match spans; columns of any name come through."""
    rng = random.Random(12)
    bits = ["a.b@c-d.example.org", "10.20.30.40", "4111 1111 1111 1111", "+1 (988) 555-2485", "word", "été", "漢字", "7", "+", "1.2.3.", ", ", "\n", "-", "(", "x@y"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "", "  "]) for _ in range(1500)) for _ in range(6)] + [" ".join(f"u{i}@h.example.org" for i in range(5000))]
    names = ["added", "all", "base", "terms", "pieces", "parts", "rest", "k1", "_email", "_ip", "row_key", "a b"]
    df = spark.createDataFrame([(i, t, *names) for i, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for r in personal_data(df, bits=99.0).collect():
        assert r["spans"] == ",".join(base(texts[r["doc_id"]])) and [r[n] for n in names] == names


def told(rows, support, share, least, near=8, reach=200):
    """Disclosing terms by counting: every value's neighbours, every document's words."""
    docs = {(i, t or "") for i, t in rows}
    words = lambda t: re.findall(r"[^\W\d_]{2,}", t)
    pairs, entities, terms = defaultdict(set), defaultdict(set), defaultdict(set)
    for d in docs:
        for w in words(d[1]):
            terms[w.lower()].add(d)
        for s in base(d[1]):
            a, b = map(int, s.split(":")[1:])
            left, right = d[1][max(0, a - reach) : a], d[1][b : b + reach]
            left = re.sub(r"^[^\W\d_]+", "", left) if a > reach else left
            right = re.sub(r"[^\W\d_]+$", "", right) if len(right) == reach else right
            bare = lambda x: words(re.sub(r"[A-Za-z0-9._%+-]*@[A-Za-z0-9.-]*", " ", x))
            entity = d[1][a:b].lower()
            entities[entity].add(d)
            for t in {w.lower() for w in bare(left.split("\n")[-1])[-near:] + bare(right.split("\n")[0])[:near]}:
                pairs[t, entity].add(d)
    p = lambda t, e: len(pairs[t, e]) / len(terms[t])
    return {t for t, e in pairs if len(pairs[t, e]) >= support and p(t, e) >= share and math.log2(p(t, e) * len(docs) / len(entities[e])) >= least}


def test_disclosure_against_counts(spark):
    """n(t,e), n(t), n(e), the share and the bits, against a count by hand; and every place of every such term."""
    rng = random.Random(8)
    people = [(f"p{k}@mail.example.org", rng.choice(["Quor", "Blyt", "Zarq"]) + chr(97 + k) + "on") for k in range(12)]
    rows = []
    for i in range(160):
        line = [prose(rng, rng.randrange(0, 30)) for _ in range(3)]
        if i % 3 == 0:
            mail, name = rng.choice(people)
            line[1] = f"{prose(rng, 4)} {name if rng.random() < 0.9 else 'Someone'} wrote: {mail} {prose(rng, 40)}"
        if i % 11 == 0:
            line.append(people[i % 12][1] + " " + prose(rng, 3))
        rows.append((i, "\n".join(line)))
    rows += [rows[3], rows[6], (400, None), (401, "")]
    for support, share, least in ((1, 0.6, 4.0), (2, 0.5, 3.0), (3, 0.2, 1.0)):
        want = told(rows, support, share, least)
        got = personal_data(spark.createDataFrame(rows, "doc_id long, text string"), support=support, share=share, bits=least).collect()
        texts = dict(rows)
        assert want
        for r in got:
            t = texts[r["doc_id"]] or ""
            own = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in want]
            assert r["spans"] == ",".join(base(t) + own)


@pytest.mark.parametrize(("mode", "mark"), [("generalise", "[TERM]"), ("remove", "")])
def test_disclosing_terms(spark, mode, mark):
    rows = [(j, f"w{j} zarquon writes to zed@x.io on the day") for j in range(9)] + [(50, "Zarquon!\nzarquonish zarquon")] + [(100 + j, f"the day of number {j} and those who write") for j in range(300)]
    got = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string"), support=5, share=0.9, bits=4.0, mode=mode).collect()}
    assert got[3]["clean_text"].startswith(f"w3 {mark} ") and "[EMAIL]" in got[3]["clean_text"]
    assert got[50]["spans"] == "term:0:7,term:20:27" and got[50]["clean_text"] == f"{mark}!\nzarquonish {mark}"
    assert all(got[100 + j]["spans"] == "" for j in range(300))


def test_disclosing_terms_of_rare_values(spark):
    """Values of one document, one line in many documents, short names, scripts without spaces, and rows that are repeated."""
    rows = [(1, "intro\nquorvax wrote as one@x.io of the day")] + [(10 + j, f"number {j}\nli zarquon, the@sign.ature") for j in range(4)] + [(20, "ask li of number"), (40, "the day 嬴 +1 (988) 555-2499")]
    rows += [(30, "blyth of the day +1 (988) 555-2485")] * 2 + [(100 + j, f"the day of number {j} and as one wrote intro to ask") for j in range(700)]
    got = {r["doc_id"]: r for r in personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["clean_text"] == "intro\n[TERM] wrote as [EMAIL] of the day" and got[40]["clean_text"] == "the day [TERM] [PHONE]"
    assert all(got[10 + j]["clean_text"] == f"number {j}\nli [TERM], [EMAIL]" for j in range(4)) and got[20]["n_term"] == 0
    assert got[30]["clean_text"] == "[TERM] of the day [PHONE]" and all(got[100 + j]["spans"] == "" for j in range(700))
    short = {r["doc_id"]: r for r in personal_data(spark.createDataFrame([r for r in rows if r[0] != 20], "doc_id long, text string")).collect()}
    assert all(short[10 + j]["clean_text"] == f"number {j}\n[TERM] [TERM], [EMAIL]" for j in range(4))


def test_licences(spark, none):
    rows = [
        (1, "intro\nReleased under the MIT License.\nmore"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
        (4, "He got a license to fish in this state.\nthe of and"), (5, None), (6, ""), (7, "x" * 50_000 + "\n" + "word " * 20_000), (1, "intro\nReleased under the MIT License.\nmore"),
    ]
    got = sorted((r["doc_id"], r["licences"], r["n_licences"], r["n_confirmed"]) for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, "1:MIT:1", 1, 1)] * 2 + [(2, "0:Apache-2.0:1", 1, 1), (3, "0:GPL:1,1:CC-BY-NC:1", 2, 2), (4, "", 0, 0), (5, "", 0, 0), (6, "", 0, 0), (7, "", 0, 0)])
    assert scan_licences(none).count() == 0 and 0.5 <= train()[1] < 1


MIT = """# MIT License
#
# Copyright (c) 2021 Somebody
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:
#
# The above copyright notice and this permission notice shall be included in all
# copies or substantial portions of the Software.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""


def test_wrapped_and_unknown_licences(spark):
    """Wrapped notices are paragraphs; licences of no family are unknown; other talk of licences is nothing."""
    rows = [
        (1, MIT), (2, GPL), (3, "Licensed under the Eclipse Public License 2.0"), (4, "Licensed under the GNU Affero General Public License, version 3."), (5, "Licensed under the ISC License."), (6, "Released under the Unlicense."),
        (7, "Licensed under the Open Software License 3.0."), (8, "This work is licensed under the Harbour Public License, version 2."), (9, "Her driver's license expired in May, and she paid for a new one."),
        (10, "one line\n\nAll rights reserved.\n\nLicensed under\nthe Mozilla\nPublic License 2.0"), (11, "This program is free software: you can modify it under the terms of the General Public tea room."),
    ]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, parts string, k1 string")
    got = {r["doc_id"]: r for r in scan_licences(df).collect()}
    assert [got[i]["licences"] for i in (1, 2, 3, 4, 5, 6)] == ["0:MIT:1,4:MIT:1,11:MIT:1", "0:GPL:1", "0:EPL-2.0:1", "0:AGPL:1", "0:ISC:1", "0:Unlicense:1"]
    assert [(got[i]["n_licences"], got[i]["n_unknown"]) for i in (7, 8, 9)] == [(0, 1), (0, 1), (0, 0)]
    assert got[10]["licences"] == "2:Proprietary:1,4:MPL-2.0:1" and got[11]["n_confirmed"] == 0


def test_licence_scan_against_plain_python(spark):
    """Paragraphs, scores, thresholds and alignments, against loops over lines, weights and words."""
    weights, threshold = train()
    cut = math.log(threshold / (1 - threshold))
    rng = random.Random(2)
    pool = [t for ts in TEMPLATES.values() for t in ts] + [prose(rng, 9) for _ in range(30)] + ["", "--", "a licence of the software", "Licensed under the Foo License.", "public license", "no rights"]
    rows = []
    for i in range(120):
        lines = []
        for t in rng.choices(pool, k=rng.randrange(1, 7)):
            w = [x for x in t.split() if rng.random() > 0.04]
            lines += ["\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))] if rng.random() < 0.5 else [" ".join(w)]
        rows.append((i, rng.choice(["\n", "\n\n"]).join(lines)))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(max(row[j + 1], row[j] + 1) if x == y else row[j + 1] for j, y in enumerate(b))]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        return row[-1]

    words = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    anchor = re.compile(_anchor({g for w in weights.values() for g, v in w.items() if g and v > 0}))

    def scan(text):
        found, unknown, part, first = [], 0, [], None
        lines = text.split("\n")
        blank = [not re.search(r"[^\W_]", x) for x in lines]
        for k, line in enumerate(lines):
            first = k if first is None and anchor.search(line) else first
            part.append(line)
            if k + 1 == len(lines) or blank[k] or blank[k + 1] or re.search(r"""[.!?;][)\]"'*/ \t\r]{0,4}$""", line):
                w = words("\n".join(part))
                grams = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}
                z = {f: round(v[""] + sum(v.get(g, 0.0) for g in grams), 6) for f, v in weights.items()}
                best = max((z[f], f) for f in z if f != LICENCE)
                if first is None:
                    pass
                elif best[0] >= cut:
                    sure = any(sum(common(w, words(t)[a : a + 60]) for a in range(0, len(words(t)), 60)) >= 0.85 * len(words(t)) for t in TEMPLATES[best[1]])
                    found.append(f"{first}:{best[1]}:{int(sure)}")
                elif z[LICENCE] >= 0:
                    unknown += 1
                part, first = [], None
        return ",".join(found), unknown

    for r in scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["licences"], r["n_unknown"]) == scan(rows[r["doc_id"]][1]), rows[r["doc_id"]][1]


def test_preferences(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "A"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "BB"), (1, "rejected", 2, "user", None),
        (2, "chosen", 0, None, "x"), (2, "rejected", 0, "user", "x"), (3, "chosen", 0, "user", "only"), (4, "rejected", 5, "assistant", "z"), (None, "chosen", 0, "user", "n"), (5, "other", 0, "user", "n"), (1, "chosen", 0, "user", "hi"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, side string, turn int, role string, text string, prompt int")
    got = {r["pair_id"]: r for r in format_preferences(df, "<", ">").collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["n_common"], got[1]["prompt"], got[1]["chosen"], got[1]["chosen_mask"], got[1]["rejected"], got[1]["rejected_mask"]) == (1, "<user\nhi>\n", "<assistant\nA>\n", "11:13", "<assistant\nBB>\n<user\n>\n", "11:14")
    assert (got[2]["n_common"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "") and got[3]["chosen"] == "<user\nonly>\n" and got[3]["n_common"] == 0 and got[4]["rejected_mask"] == "11:13"
    assert format_preferences(df.limit(0)).count() == 0


def test_long_preferences(spark):
    """Long turns, many turns, and other columns with the names of results."""
    long_ = "tulip 😀 " * 30_000
    rows = [(1, s, t, "user" if t % 2 == 0 else "assistant", long_ if t == 1 else f"turn {t}" + (s if t == 39 else "")) for s in ("chosen", "rejected") for t in range(40)]
    df = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], "pair_id long, side string, turn int, role string, text string, chosen string, prompt string, n_common int")
    r = format_preferences(df).first()
    head = len("<|im_start|>assistant\n")
    assert r["n_common"] == 39 and long_ in r["prompt"] and r["chosen"] == "<|im_start|>assistant\nturn 39chosen<|im_end|>\n"
    assert r["chosen_mask"] == f"{head}:{head + len('turn 39chosen<|im_end|>')}"


def test_preference_pairs(spark):
    talk = [(1, 0, "user", "a"), (1, 1, "assistant", "r1"), (1, 2, "user", "b"), (2, 0, "user", "q"), (9, 0, "assistant", "r9"), (9, 0, "assistant", "zz"), (70, 3, "assistant", "r70"), (None, 0, "user", "n")]
    got = {(r["pair_id"], r["side"], r["turn"]): r["text"] for r in preference_pairs(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, "chosen", 0): "a", (1, "rejected", 0): "a", (1, "chosen", 1): "r1", (1, "rejected", 1): "r9", (9, "chosen", 0): "r9", (9, "rejected", 0): "r70", (70, "chosen", 0): "r70", (70, "rejected", 0): "r1"}


def test_rake():
    rng = np.random.default_rng(1)
    table = pd.DataFrame([(s, l, t) for s in "abc" for l in ("en", "de", "fr", "es") for t in range(5)], columns=["source", "lang", "topic"])
    table["tokens"] = (rng.random(60) * 1000).astype(int)
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {x: 0.25 for x in ("en", "de", "fr", "es")}, "topic": dict(enumerate((0.1, 0.1, 0.2, 0.2, 0.4)))}
    f = rake(table, targets, 0.9)
    now = table.tokens * f
    for key, want in targets.items():
        got = (now.groupby(table[key]).sum() / now.sum()).to_dict()
        assert all(abs(got[c] - v) < 1e-6 for c, v in want.items())
    total = float(table.tokens.sum())
    scale = calibrate(lambda s: (table.tokens[f * s >= 1].sum(), now[f * s < 1].sum()), total, 0.5 * total)
    p = np.minimum(1, f * scale)
    assert abs((p * table.tokens).sum() - 0.5 * total) < 1e-6 and (f * scale > 1).any()
    assert calibrate(lambda s: (0, 1), total, total) == float("inf")
    # A marginal that isn't given is smoothed, and never clashes with those that are.
    skew = pd.DataFrame([("a", "en", 0, 900), ("b", "de", 1, 90), ("c", "de", 1, 10)], columns=["source", "lang", "topic", "tokens"])
    smooth = skew.tokens * rake(skew, {}, 0.5)
    assert np.allclose(smooth / smooth.sum(), skew.tokens**0.5 / (skew.tokens**0.5).sum())
    given = skew.tokens * rake(skew, {"source": {"a": 0.1, "b": 0.6, "c": 0.3, "nowhere": 5.0}}, 0.5)
    assert np.allclose(given / given.sum(), [0.1, 0.6, 0.3])
    with pytest.raises(Clash):
        rake(skew, {"source": {"a": 0.1, "b": 0.6, "c": 0.3}, "lang": {"en": 0.5, "de": 0.5}}, 0.5)
    with pytest.raises(Clash):
        rake(skew, {"source": {"nowhere": 1.0}}, 0.5)


def test_mixing(spark, none):
    rows = [(i, "alpha beta gamma " * (1 + i % 5), ["en", "de", None][i % 3], ["s1", "s2"][int(i % 4 == 0)], 1, "a", "b", "c") for i in range(3000)] + [(5000, None, None, None, None, "a", "b", "c"), (None, "x y", "en", "s1", 2, "a", "b", "c"), (7, "alpha beta gamma " * 3, "de", "s1", 1, "a", "b", "c"), (5001, "long " * 200_000, "en", "s1", 1, "a", "b", "c")]
    df = spark.createDataFrame(rows[:-1], "doc_id long, text string, lang string, source string, weight int, _s string, _l string, _top string")
    got = mix_sources(df, targets={"source": {"s1": 0.8, "s2": 0.2}}, keep=0.4, topics=2).toPandas()
    assert len(got) == len(rows) - 1 and (got._top == "c").all()
    kept = got[got.selected]
    assert abs(kept.n_tokens.sum() / got.n_tokens.sum() - 0.4) < 0.05 and abs(kept[kept.source == "s2"].n_tokens.sum() / kept.n_tokens.sum() - 0.2) < 0.05
    assert got[got.text.isna()].n_tokens.tolist() == [0] and set(got[got.doc_id == 7].selected) in ({True}, {False})
    again = mix_sources(df.repartition(5), targets={"source": {"s1": 0.8, "s2": 0.2}}, keep=0.4, topics=2).toPandas()
    assert sorted(again[again.selected].doc_id.dropna()) == sorted(kept.doc_id.dropna())
    assert mix_sources(spark.createDataFrame(rows, df.schema)).where("doc_id = 5001 and n_tokens = 200000").count() == 1
    assert mix_sources(none).count() == 0
    with pytest.raises(Clash):
        mix_sources(df, targets={"source": {"s1": 1.0}, "lang": {"xx": 1.0}})


def test_mixing_of_more_cells_than_the_driver_holds(spark):
    """Many sources: nothing is merged, and joins give what the driver gives."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["en", "de"]), f"host{int(rng.random() ** 2 * 80)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for targets in (None, {"source": {f"host{k}": 1.0 for k in range(80)}}):
        near, far = (mix_sources(df, targets, power=0.5, keep=0.6, topics=2, held=held).toPandas().set_index("doc_id").sort_index() for held in (200_000, 0))
        assert np.allclose(near.weight, far.weight, rtol=1e-5) and np.allclose(near.probability, far.probability, rtol=1e-5) and (near.selected == far.selected).mean() > 0.99
        share = (far.weight * far.n_tokens).groupby(far.source).sum()
        if targets:
            assert np.allclose(share / share.sum(), 1 / len(share), atol=1e-6)


def test_topics_are_those_of_the_corpus(spark):
    """Documents of planted vocabularies come apart, whatever their source."""
    rng = random.Random(11)
    words = [[f"t{k}w{j}" for j in range(60)] for k in range(4)]
    rows = []
    for i in range(600):
        k = i % 4
        rows.append((i, " ".join(rng.choice(words[k]) if rng.random() < 0.6 else prose(rng, 1) for _ in range(rng.randrange(30, 90))), "en", f"s{rng.randrange(3)}"))
    got = {r["doc_id"]: r["topic"] for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), topics=4).collect()}
    most = [Counter(got[i] for i in range(600) if i % 4 == k).most_common(1)[0] for k in range(4)]
    assert len({t for t, _ in most}) == 4 and sum(n for _, n in most) >= 0.95 * 600
