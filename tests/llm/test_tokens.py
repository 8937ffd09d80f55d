import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import byte_bpe, token_counts

from .helpers import empty, odd

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIGNS = [" ", "  ", "\n", "a", "e", "th", "▁", "é", "ß", "\x00", "\r", "\t", "<s>", "ﬁ", "漢", "🙂", "0", "12", "'s", ".", ",", "　", "\xa0", "\u0085", "\x1c"]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.load_vocabulary(MODEL)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.codec(RANKS, public_tokenizers.PATTERN)


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
TIKTOKEN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_counts_as_the_library(vocabulary):
    memo = token_counts.Memo(lambda p: token_counts.pieces_of(p, vocabulary))

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(SIGNS), max_size=30).map("".join)))
    def same(text):
        assert token_counts.count_tokens(text, vocabulary, memo) == len(LIBRARY.encode(text))

    same()
    assert all(len(token_counts.merge(p, vocabulary.scores)) == 1 for p in list(vocabulary.whole)[:2000])
    rng = random.Random(3)
    for word in ("".join(rng.choices("abcdeth", k=3000)), "a" * 5000):
        assert token_counts.count_tokens(word, vocabulary) == len(LIBRARY.encode(word))


def test_transducer_as_the_library(coder):
    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(SIGNS), max_size=30).map("".join)))
    def same(text):
        ids = coder.encode(text)
        assert ids == TIKTOKEN.encode_ordinary(text)
        assert coder.decode(ids) == text

    same()
    rng = random.Random(4)
    for word in ("".join(rng.choices("abcdeth", k=20_000)), "a" * 20_000):
        assert coder.encode(word) == TIKTOKEN.encode_ordinary(word)


def test_state_machine_holds_back_unfinished_characters():
    @settings(max_examples=200, deadline=None)
    @given(st.binary(max_size=40), st.integers(1, 5))
    def same(data, step):
        stream = byte_bpe.Utf8Stream()
        parts = [stream.feed(data[i : i + step]) for i in range(0, len(data), step)]
        assert "".join([*parts, stream.finish()]) == data.decode("utf-8", "replace")

    same()


def test_few_states_are_kept(coder):
    small = byte_bpe.Transducer(coder.transducer.ranks, most_moves=50)
    for word in ("thingamabob", "erthanonthe", "schreibmaschine"):
        assert list(small.encode(word.encode())) == TIKTOKEN.encode_ordinary(word)
    assert len(small.states) < 200


def test_odd_rows(spark, vocabulary):
    rows = odd(spark).withColumn("N_TOKENS", F.lit(-1))
    out = token_counts.with_token_counts(rows, vocabulary).collect()
    assert len(out) == rows.count()
    for r in out:
        assert r.n_tokens == len(LIBRARY.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 4096)
    assert token_counts.with_token_counts(empty(spark), vocabulary).count() == 0
    coded = byte_bpe.round_trip(odd(spark).withColumn("n_tokens", F.lit(-1)), RANKS, public_tokenizers.PATTERN, ids="ids").collect()
    for r in coded:
        ids = TIKTOKEN.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    back = byte_bpe.decode(byte_bpe.encode(odd(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert byte_bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0
