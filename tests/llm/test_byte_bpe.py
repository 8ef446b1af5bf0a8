"""Byte-level BPE against the tiktoken library, with odd texts and very long matches."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
OURS = byte_bpe.Vocabulary(RAW)
SPLIT = regex.compile(public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(OURS.ranks), special_tokens={})
ODD = ["", " ", "\n \t\r\n", "it's we'll I'D", "a" * 5000, " " * 3000 + "x", "ñandú señor 12345 ½²", "日本語のテキスト" * 300, "😀👩‍👩‍👧 é é", "\x00\x1c\x85\xa0　x", "<|endoftext|>", "=" * 777 + "-" * 333, "ab" * 4000, "ſ İ ß ŉ"]


def ids(text):
    return np.frombuffer(OURS.encoded(text, SPLIT), "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ids(text) == THEIRS.encode_ordinary(text)
    assert OURS.decoded(OURS.encoded(text, SPLIT)) == text.encode()


@given(st.text(alphabet=st.one_of(st.sampled_from("abc de's\n\t12.,-'"), st.characters(exclude_categories=["Cs"])), max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert ids(text) == THEIRS.encode_ordinary(text)


def test_long_matches_and_shares(monkeypatch):
    rng = random.Random(4)
    for alphabet in ("ab", "aeioutnrs", "abcdefghijklmnopqrstuvwxyzñéü", "猫犬日本語"):
        text = "".join(rng.choice(alphabet) for _ in range(9000))  # one match, beyond the length that lists are for
        assert ids(text) == THEIRS.encode_ordinary(text)
    whole = " ".join("".join(rng.choice("etaoin shrdlu") for _ in range(rng.randrange(12))) for _ in range(3000))
    want = THEIRS.encode_ordinary(whole)
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    monkeypatch.setattr(byte_bpe, "SHARE", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    assert ids(whole) == want
    assert OURS.decoded(OURS.encoded(whole, SPLIT)) == whole.encode()


def test_a_match_of_a_megabyte_takes_seconds():
    rng = random.Random(9)
    piece = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20)).encode()
    began = time.process_time()
    out = OURS.merged(piece)
    assert time.process_time() - began < 60  # a scan for each merge would take days
    assert OURS.decoded(out) == piece


def test_the_queue_is_empty_between_matches():
    rng = random.Random(2)
    for _ in range(300):
        piece = "".join(rng.choice("abetn ") for _ in range(rng.randrange(1, 60))).encode()
        got = np.frombuffer(OURS.merged(piece), "<u4").tolist()
        assert got == THEIRS._encode_single_piece(piece)
        assert not any(OURS.leaf)


def test_a_rank_file_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(base64.b64encode(b"a") + b" 0\n")


def test_table(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[3]), (None, "no id"), (70, None)]
    docs = spark.createDataFrame([(i, t, "n", b"x", 5) for i, t in rows], "doc_id long, text string, ids string, decoded binary, n_tokens int").repartition(3)
    encoded = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = byte_bpe.round_trip_digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        own = THEIRS.encode_ordinary(t or "")
        want.append((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    arrays = {(r["doc_id"]): r["ids"] for r in byte_bpe.id_arrays(encoded).collect()}
    assert arrays[7] == THEIRS.encode_ordinary(ODD[7]) and arrays[70] == []
    bad = spark.createDataFrame([(1, None), (2, np.array([60000], "<u4").tobytes()), (3, np.array([0, 1], "<u4").tobytes())], "doc_id long, ids binary")
    assert {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(bad, PATH).collect()} == {1: None, 2: None, 3: OURS.tokens[0] + OURS.tokens[1]}
    assert byte_bpe.round_trip_digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
