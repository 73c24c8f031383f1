import re
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from llm_texts import prose
from test_neardup import brute

from quillspark.llm.mixing import mix_sources
from quillspark.llm.packing import tokenizer_spec


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    rng = random.Random(6)
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, prose(rng, 60), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "s1") for i in range(10)] + [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "s2") for i in range(40)]
    rows += [(300, prose(rng, 60) + " me@x.org", "de", "s0"), (301, None, None, None), (302, "", "en", "s3"), (0, rows[0][1], "en", "s0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows[:110]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = P.quality(spark, docs, sf_dir)
    kept = {r["doc_id"] for r in one.collect()}
    assert kept >= set(range(60)) and not kept & {200 + i for i in range(40) if zlib.crc32(str(200 + i).encode()) % 5} and one.columns == list(P.COLUMNS)
    one = spark.createDataFrame(one.collect(), one.schema)
    two = P.deduplicate(spark, one, sf_dir)
    want = {i for i, (_n, c) in brute([(r["doc_id"], r["text"]) for r in one.collect()], 5, 80).items() if i == c}
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(want) and two.columns == list(P.COLUMNS)
    two = spark.createDataFrame(two.collect(), two.schema)
    three = P.sanitise(spark, two, sf_dir).collect()
    assert {r["doc_id"] for r in three} == want and all(r["n_chars"] == len(r["text"]) for r in three if r["text"] is not None)
    mail = next((r["text"] for r in three if r["doc_id"] == 300), "[EMAIL]")
    assert mail.endswith("[EMAIL]") and not any(re.search("@x", r["text"] or "") for r in three)
    four = P.mix(spark, spark.createDataFrame(three, two.schema), sf_dir)
    assert {r["doc_id"] for r in four.collect()} <= want and four.columns == list(P.COLUMNS)


def test_run(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.count() > 0 and [n for n, _ in P.STAGES] == ["quality", "near-dedup", "pii", "mixing", "packing"]


def test_packed(spark, sf_dir):
    """The last stage against the tokenizer: every piece of every document, in sequences without gaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tok = Tokenizer.from_str(tokenizer_spec("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    got = P.packed(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1.1 * sum(n for _, n in want) / 4096 + 1


def test_mixed(spark, sf_dir):
    """The sample is the one that the operator's probabilities and draws give, and it leaves something out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = {r["doc_id"]: r["probability"] for r in mix_sources(docs).collect()}
    kept = {r["doc_id"] for r in P.mix(spark, docs, sf_dir).collect()}
    assert {i for i, p in told.items() if p >= 1} <= kept < set(told) and min(told.values()) < 1


def test_empty(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
