"""BPE against the tokenizers library."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def same(codec, library, text):
    packed = codec.encode_all([text])[0]
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert codec.decode(packed) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "Hello  world's\n\n\tIt'LL 12345 ½²³", "<|endoftext|>a <|endoftext|>", "naïve été straße", "漢字かな 😀🏳️‍🌈 ٣٤Ⅳ", "\x00\x1c\x1d\x85\xa0 x", "a" * 5000, "ab " * 3000, "é" * 2000])
def test_cases(codec, library, text):
    same(codec, library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" 'sdmretl\n<|>endoftxé1²")), max_size=60))
def test_random(codec, library, text):
    same(codec, library, text)


def test_failing_proposals_are_merged(codec):
    words = [b" therein", b"abcabcabc", b"tionally", b"...."]
    own = codec.encoder
    assert {w: np.frombuffer(p, "<u4").tolist() for w, p in own.learn(words).items()} == {w: own.merge(w) for w in words}


def test_many_words_at_once(codec):
    """Proposals and merges of many words, against one by one."""
    own, rng = codec.encoder, np.random.default_rng(3)
    tokens = [b for b in codec.vocab if len(b) > 1]
    words = [b"".join(rng.choice(tokens, rng.integers(1, 4)))[: int(rng.integers(1, 20))] for _ in range(3000)]
    words += [bytes(rng.integers(0, 256, rng.integers(1, 12), dtype=np.uint8)) for _ in range(500)] + [b"a" * n for n in range(1, 60)] + [b"ab" * 40, b" ", b"\n\n\n"]
    for many, one in ((own.propose_all, own.propose), (own.merge_all, own.merge)):
        flat, sizes = many(words)
        stops = np.cumsum(sizes)
        assert [flat[b - n : b].tolist() for b, n in zip(stops, sizes, strict=True)] == [one(w) for w in words]
    assert own.merge_all([])[0].tolist() == own.propose_all([])[0].tolist() == []


def test_pair_checks_are_exact(codec):
    """Whole entries and compatible pairs, against merging their bytes."""
    own, rng = codec.encoder, np.random.default_rng(0)
    assert own.orderly
    ids = rng.choice([i for b, i in codec.vocab.items()], 4000)
    assert own.whole[ids].tolist() == [own.merge(codec.bytes[i]) == [i] for i in ids.tolist()]
    whole = np.flatnonzero(own.whole)
    common = whole[:3000]
    left, right = np.append(rng.choice(whole, 5000), rng.choice(common, 20000)), np.append(rng.choice(whole, 5000), rng.choice(common, 20000))
    left, right = np.append(left, common), np.append(right, common)  # an entry next to itself
    want = [own.merge(codec.bytes[a] + codec.bytes[b]) == [a, b] for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert own.compatible(left, right).tolist() == want and 0 < sum(want) < len(want)


def test_a_disorderly_vocabulary_is_merged_exactly():
    vocab = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    own = bpe.Encoder(vocab, [(b"a", b"b"), (b"ab", b"c"), (b"b", b"c"), (b"a", b"bc")], {})
    assert not own.orderly and own.learn([b"abcbc"]) == {b"abcbc": np.array([257, 258], "<u4").tobytes()}

def test_frame(spark, codec):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, None, 7), (None, "", 8)], "doc_id long, text string, ids int")
    out = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == [(0, 0, ""), (1, 2, "a b"), (1, 2, "a b"), (2, 0, "")]
    assert sorted(map(str, out)) == sorted(map(str, bpe.bpe_round_trip(df, PATH).collect()))
    assert bpe.bpe_encode(df.limit(0), PATH).count() == bpe.bpe_round_trip(df.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op6_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
