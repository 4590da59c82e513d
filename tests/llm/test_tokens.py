"""Token counts and byte-level BPE against the libraries."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from evigrid.llm.bpe_monoid import TreeCodec, decode_documents, encode_documents, read_ranks, round_trip
from evigrid.llm.token_counts import MergeCounter, token_counts

from .odd import ODD, docs

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
    COUNTER = MergeCounter(f.read(), public_tokenizers.PATTERN)
with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
    RANKS = read_ranks(f.read())
CODEC = TreeCodec(RANKS, public_tokenizers.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def library_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("ab", max_size=200), st.text("the and ing", max_size=300), st.text("éè 中'sl\n\t ", max_size=80)))
def test_texts_match_both_libraries(text):
    assert COUNTER.count(text) == library_count(text)
    ids = CODEC.encode(text)
    assert ids == TIKTOKEN.encode_ordinary(text) and CODEC.decode(ids).decode() == text


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "thein", "0123456789", "!?#*", "éàü", "中文字"])
def test_long_words_match(alphabet):
    rng = random.Random(alphabet)
    word = "".join(rng.choice(alphabet) for _ in range(20_000))
    assert COUNTER.count(word) == library_count(word)
    assert CODEC.encode(word) == TIKTOKEN.encode_ordinary(word)


def test_small_leaves_need_many_joins(monkeypatch):
    monkeypatch.setattr("evigrid.llm.bpe_monoid.LEAF", 2)
    rng = random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("theandious") for _ in range(rng.randrange(1, 90)))
        assert TreeCodec(RANKS, public_tokenizers.PATTERN).encode(word) == TIKTOKEN.encode_ordinary(word)


def test_odd_documents(spark):
    df = docs(spark, ODD)
    got = sorted((tuple(r) for r in token_counts(df).collect()), key=repr)
    want = [(i, len((t or "").encode()), library_count(t or ""), library_count(t or "") > 512) for i, t in ODD]
    assert got == sorted(want, key=repr)
    assert [c for c, _ in token_counts(df).dtypes] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]

    def digest(text):
        ids = TIKTOKEN.encode_ordinary(text)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    assert sorted((tuple(r) for r in round_trip(df).collect()), key=repr) == sorted(((i, *digest(t or "")) for i, t in ODD), key=repr)
    back = decode_documents(encode_documents(df)).collect()
    assert sorted((r.data.decode() for r in back)) == sorted(t or "" for _, t in ODD)
    assert token_counts(df.limit(0)).count() == round_trip(df.limit(0)).count() == 0


def test_only_plain_files_are_taken():
    with pytest.raises(ValueError, match="byte-level"):
        MergeCounter(b'{"model": {"type": "WordPiece", "vocab": {}}}', public_tokenizers.PATTERN)


def test_long_words_are_not_remembered():
    """Unique long words, such as encoded blobs, leave nothing behind in a worker; their counts and ids stay those of the library."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        counter = MergeCounter(f.read(), public_tokenizers.PATTERN)
    codec = TreeCodec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    blobs = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=2000)) for _ in range(50)]
    for blob in blobs:
        assert counter.count(f"say {blob}") == library_count(f"say {blob}")
        assert codec.encode(f"say {blob}") == TIKTOKEN.encode_ordinary(f"say {blob}")
    assert max(map(len, counter.known)) <= 64 and max(map(len, codec.known)) <= 64
    assert len(counter.known) == len(codec.known) == 1


def test_words_in_use_stay_remembered(monkeypatch):
    """A full memory drops words not met lately and keeps the others; ids are those of the library all along."""
    import evigrid.llm.bpe_monoid as module
    monkeypatch.setattr(module, "REMEMBERED", 20)
    codec = TreeCodec(RANKS, public_tokenizers.PATTERN)
    for i in range(200):
        text = f" often wörd{chr(97 + i % 26)}{chr(97 + i // 26)}"
        assert codec.encode(text) == TIKTOKEN.encode_ordinary(text)
        assert " often" in {**codec.known, **codec.older} and len(codec.known) + len(codec.older) <= 20
