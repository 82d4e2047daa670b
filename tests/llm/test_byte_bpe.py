import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from metaeval.llm import byte_bpe


@pytest.fixture(scope="module")
def both():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.RANKS))
    own = byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


def test_random_texts(both):
    own, other = both
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\x1c", "\x85", " ", "é", "漢", "🙂", "'s", "'re", "1", "22", "!", "\n", "\t", "the", "ing", "​", "²"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert ids(own, text) == other.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 20000, "abcdefgh" * 4000, " " * 5000])
def test_long_pieces(both, text):
    assert ids(both[0], text) == both[1].encode_ordinary(text)


def test_digests_of_the_documents(docs, texts, both):
    for r in byte_bpe.encoding_digests(docs).collect():
        want = both[1].encode_ordinary(texts[r["id"]])
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["id"]].encode()).hexdigest()


def test_odd_rows(odd, none, both):
    assert "ids" in odd.columns
    odd = odd.withColumn("decoded", F.lit("x"))
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] == both[1].encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode() and r["key"] == "key"
    assert byte_bpe.encoding_digests(odd).count() == odd.count()
    assert byte_bpe.encoding_digests(none).count() == 0


def test_memory_of_unbroken_text(both):
    """Ten megabytes of one letter: some 50 bytes a byte at most, and nothing of it is kept."""
    own = byte_bpe.ByteBpe(both[0].ranks, public_tokenizers.PATTERN)
    tracemalloc.start()
    found = own.encode("a" * 10_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.decode(found) == b"a" * 10_000_000 and peak < 400e6
    assert not own.known and ids(own, "a" * 100_000) == both[1].encode_ordinary("a" * 100_000)


def test_frequent_pieces_stay_known(both, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN", 40)
    own = byte_bpe.ByteBpe(both[0].ranks, public_tokenizers.PATTERN)
    asked, encode_piece = [], own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda piece: asked.append(piece) or encode_piece(piece))
    for i in range(300):
        text = f" quixotry x{i:04d}z"
        assert ids(own, text) == both[1].encode_ordinary(text)
        assert len(own.known) + len(own.before) <= 40
    assert asked.count(b" quixotry") == 1 and asked.count(b" x") == 1


@pytest.mark.parametrize("size", [2, 9, 63, 64, 65, 200])
def test_pieces_on_both_sides_of_the_short_ones(both, size):
    rng = random.Random(size)
    for letters in ("ab", "étaoinshrdlu", "aaab", "漢字ñ"):
        for _ in range(40):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert ids(both[0], text) == both[1].encode_ordinary(text)
