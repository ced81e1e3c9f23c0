import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from docdelta.llm import byte_bpe, queries
from docdelta.llm.byte_bpe import Decoder, Encoder, Merges, Stream, Transducer

VOCABULARY = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
RANKS = byte_bpe.read_ranks(VOCABULARY.splitlines())
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER, DECODER = Encoder(RANKS, public_tokenizers.PATTERN, True), Decoder(RANKS)


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<u4")


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text(alphabet="ab '\n\tsd1é日😀") | st.lists(st.sampled_from([" the", "ing", " ", "\n", "tion", "A", "!!", "0"])).map("".join))
def test_encodes_as_the_library_does(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids(text).tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["a", " ", "ab", "\n", "ha", "é", "日本", "0", "=-", "aaab"])
def test_long_matches(unit):
    for n in (1, 7, 100, 5000):
        assert ids(unit * n).tolist() == LIBRARY.encode_ordinary(unit * n)


def small_ranks(seed):
    """A vocabulary trained by no one: random merges, so that ranks follow no language."""
    rnd, ranks = random.Random(seed), {bytes([x]): x for x in range(256)}
    names = [b"a", b"b", b"c"]
    while len(ranks) < 300:
        if (new := rnd.choice(names) + rnd.choice(names)) not in ranks and len(new) <= 12:
            ranks[new] = len(ranks)
            names.append(new)
    return ranks


@pytest.mark.parametrize("seed", range(8))
def test_transducer_equals_merging_for_any_vocabulary(seed):
    merges = Merges(small_ranks(seed))
    transducer, rnd = Transducer(merges), random.Random(seed)
    for n in range(1, 40):
        for _ in range(25):
            text = bytes(rnd.choice(b"abcd") for _ in range(n))
            assert transducer.run(text) == merges.merged(text)


@pytest.mark.parametrize("seed", range(4))
def test_neighbours_without_merging(seed):
    """Of the public vocabulary, and of a small one in which each token is merged from two earlier ones."""
    rnd, merges = random.Random(seed), ENCODER.transducer.merges
    assert merges.ordered
    short, tokens = [i for x, i in RANKS.items() if len(x) <= 3], list(RANKS.values())
    for _ in range(5000):
        a, b = (rnd.choice(short if rnd.random() < 0.7 else tokens) for _ in range(2))
        assert merges._apart(a, b) == (merges.merged(merges.raw[a] + merges.raw[b]) == [a, b])
    names = [b"a", b"b"]
    ranks = {bytes([x]): x for x in range(256)}
    while len(ranks) < 290:
        new = rnd.choice(names) + rnd.choice(names)
        if new not in ranks and len(Merges(ranks).merged(new)) == 2:
            ranks[new] = len(ranks)
            names.append(new)
    merges = Merges(ranks)
    assert merges.ordered
    for a in map(ranks.get, names):
        for b in map(ranks.get, names):
            assert merges._apart(a, b) == (merges.merged(merges.raw[a] + merges.raw[b]) == [a, b])


def test_vocabulary_in_no_order():
    ranks = {bytes([x]): x + 10 for x in range(256)} | {b"ab": 5, b"abc": 1, b"bc": 7, b"abcd": 2}
    merges = Merges(ranks)
    assert not merges.ordered
    transducer = Transducer(merges)
    for n in range(9):
        for k in range(4**n if n < 5 else 200):
            text = bytes(b"abcd"[(k // 4**j) % 4] for j in range(n))
            if text:
                assert transducer.run(text) == merges.merged(text)


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 20)
    monkeypatch.setattr(byte_bpe, "PAIRS", 20)
    monkeypatch.setattr(byte_bpe, "CACHE", 5)
    encoder, rnd = Encoder(RANKS, public_tokenizers.PATTERN, True), random.Random(1)
    for _ in range(100):
        text = " ".join("".join(rnd.choice("thinges") for _ in range(rnd.randrange(1, 12))) for _ in range(20))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert len(encoder.words) + len(encoder.words.before) <= 11


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé日😀ࠀ퟿￿\U00010000\U0010ffff ") | st.text(), st.integers(1, 5))
def test_streams_between_characters(text, n):
    text = text.encode("utf-8", "ignore").decode()
    own, stream = ids(text), Stream(DECODER)
    parts = [stream.feed(own[k : k + n]) for k in range(0, len(own), n)]
    assert "".join(x.decode() for x in parts) == text and stream.close() == b"" and stream.valid


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=8), st.integers(1, 3))
def test_bytes_that_are_no_text(raw, n):
    own, stream = np.array([RANKS[bytes([x])] for x in raw], np.uint32), Stream(DECODER)
    out = b"".join([*(stream.feed(own[k : k + n]) for k in range(0, len(own), n)), stream.close()])
    try:
        raw.decode()
        valid = True
    except UnicodeDecodeError:
        valid = False
    assert out == raw and stream.valid == valid


def test_all_single_steps():
    for first in range(256):
        for second in range(256):
            raw = bytes([first, second])
            state = byte_bpe.utf8_step(0, first)
            state = byte_bpe.utf8_step(state, second) if state >= 0 else -1
            try:
                (raw + b"\x80\x80\x80")[: 2 + state if state in (1, 2, 3) else 2].decode()
                ok = True
            except UnicodeDecodeError:
                ok = False
            if state in (-1, 0, 1, 2, 3):
                assert ok == (state >= 0)


def test_odd_rows(odd_docs, no_docs):
    out = byte_bpe.encode_texts(odd_docs, VOCABULARY, public_tokenizers.PATTERN, True)
    out = byte_bpe.decode_ids(out, VOCABULARY)
    assert out.count() == odd_docs.count()
    for r in out.collect():
        assert r.n_tokens == len(r.ids) // 4
        assert bytes(r.decoded).decode() == (r.text or "") and r.valid
    assert byte_bpe.encode_texts(no_docs, VOCABULARY, public_tokenizers.PATTERN).count() == 0
    both = byte_bpe.encode_texts(odd_docs.select("doc_id", "text"), VOCABULARY, public_tokenizers.PATTERN, True, decode=True)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_byte_bpe(spark, sf).collect():
        own = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_missing_bytes():
    with pytest.raises(ValueError):
        Merges({b"a": 0})
