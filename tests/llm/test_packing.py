import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm.packing import WordEncoder, grouped_classes, pack, plan, tokenizer_spec

ODD = ["a<|endoftext|>b c", "x\x01y", "", "  ", "İSTANBUL ΑΣ ΑΣ.", "é ́a", "can't don't I'LL --'s 'S", "12 345 ½ ²", "a\x1cb \x00c", "Ǆ ß ẞ", "ÀÉÎ ÿÿ. ß× ª", "\x7f \x80 a\xad", "ŒŸ", "a1b22c"]


@pytest.fixture(scope="module")
def spec():
    return tokenizer_spec("word_bpe_49k.json")


def test_encoder(spec):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    coder = WordEncoder(spec, held=5)
    for _ in range(2):
        for t in ODD:
            assert coder.encode([t.encode()])[0].tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_encoder_of_another_file(spec):
    """A file with other steps than the ones that words are split for is left to the library."""
    from tokenizers import Tokenizer

    other = json.loads(spec)
    other["normalizer"] = {"type": "Lowercase"}
    other = json.dumps(other)
    tok = Tokenizer.from_str(other)
    assert [x.tolist() for x in WordEncoder(other).encode([t.encode() for t in ODD])] == [tok.encode(t, add_special_tokens=False).ids for t in ODD]


def test_plan():
    rng = random.Random(3)
    cases = [{}, {1: 10}, {4096: 7}, {3000: 10, 1096: 10}, {2049: 9}, {4095: 3, 1: 1}] + [{rng.randrange(1, 4097): rng.randrange(1, 30) for _ in range(rng.randrange(1, 200))} for _ in range(8)]
    for h in cases:
        held = defaultdict(int)
        classes = plan(h, 4096)
        for times, content in classes:
            assert times > 0 and sum(content) <= 4096
            for n in content:
                held[n] += times
        assert dict(held) == h
        least = max(-(-sum(n * c for n, c in h.items()) // 4096), sum(c for n, c in h.items() if n > 2048))
        assert sum(t for t, _ in classes) <= 1.08 * least + 1


@pytest.mark.parametrize("draw", [lambda r: r.lognormal(6.5, 1.0, 20_000), lambda r: r.integers(1, 4096, 20_000), lambda r: r.integers(600, 3000, 20_000), lambda r: np.full(20_000, 1100)])
def test_configurations_place_the_large_pieces(draw):
    """Best fit only gets small lengths and the little that rounding down leaves of the large ones."""
    lengths = np.clip(draw(np.random.default_rng(5)), 1, 4095).astype(int)
    h = dict(Counter(lengths.tolist()))
    large = sum(n * c for n, c in h.items() if n > 1024)
    for classes, left in grouped_classes(h, 4096):
        assert sum(n * c for n, c in left.items() if n > 1024) <= 0.03 * large
        assert all(n > 1024 for _, content in classes for n in content) and all(sum(content) <= 4096 for _, content in classes)
    least = max(-(-int(lengths.sum()) // 4096), -(-20_000 // 3) if (lengths == 1100).all() else 0)
    assert sum(t for t, _ in plan(h, 4096)) <= 1.02 * least


def test_pack(spark, docs, rows, none, spec):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    got = pack(docs, spec, size=256, rows=7).collect()
    want = defaultdict(int)
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], np.uint32)
        for p, s in enumerate(range(0, len(ids), 256)):
            want[i, p, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].astype("<u4").tobytes())] += 1
    have = defaultdict(int)
    places = defaultdict(list)
    for r in got:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= 1.05 * -(-sum(r["length"] for r in got) // 256) + 1
    assert pack(none, spec).count() == 0
