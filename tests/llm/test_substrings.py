import hashlib

import numpy as np

from quillspark.llm.substrings import remove_repeats, united


def brute(rows):
    texts = sorted({(i, (t or "").encode()) for i, t in rows})
    least = {}
    for i, x in texts:
        for p in range(len(x) - 49):
            s = x[p : p + 50]
            least[s] = min(i, least.get(s, i))
    out = {}
    for i, x in texts:
        flags = bytearray(len(x))
        for p in range(len(x) - 49):
            if least[x[p : p + 50]] < i:
                flags[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(x)) if flags[k] and not (k and flags[k - 1]))
        out[i] = (len(x), sum(flags), spans, hashlib.sha256(bytes(b for b, f in zip(x, flags, strict=True) if not f)).hexdigest())
    return out


def test_against_brute_force(docs, rows):
    more = [(200, "pre " + "-" * 49), (201, "-" * 49 + "x"), (202, "q" + "-" * 49), (203, "-" * 50), (204, "y" * 60 + "-" * 50 + "y" * 49)]
    spark = docs.sparkSession
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute([*rows, *more])
    for flush in (12_000_000, 3000):
        got = remove_repeats(df, flush=flush).collect()
        assert len(got) == len(rows) + len(more)
        for r in got:
            assert tuple(r)[1:] == want[r["doc_id"]], r["doc_id"]


def test_nulls_and_empty(spark, none):
    assert remove_repeats(none).count() == 0
    text = "a sentence of more than fifty bytes that everyone has, word for word"
    df = spark.createDataFrame([(None, text), (3, text), (4, text), (4, text + " too"), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in remove_repeats(df).collect())
    n = len(text)
    assert got == [(False, 3, n, 0), (False, 4, n, n), (False, 4, n + 4, n), (False, 5, 0, 0), (True, 0, n, 0)]


def test_united():
    s, e = united(np.array([5, 0, 2, 9]), np.array([7, 3, 5, 12]))
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == [(0, 7), (9, 12)]
