import hashlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from metaeval.functions.audio import file_ending, has_audio_ending, has_audio_header, segment_ref
from metaeval.functions.text import (
    bucket_label, cache_key, char_class, hash_bucket, normalize, prefix_path, prompt_prefix,
    prompt_tail, target_text,
)
from metaeval.operators.languages import with_language_name


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_published_buckets(spark):
    for text, bucket in (("[,?.!]", 782575), ("abc", 907236), ("[a-z]", 391582)):
        assert one(spark, hash_bucket(F.lit(text))) == bucket
    assert one(spark, bucket_label(F.lit(None).cast("string"))) == "None"


@settings(max_examples=5, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=30), min_size=1, max_size=8),
       low=st.integers(0, 50), size=st.integers(1, 2**31 - 1))
def test_bucket_is_the_digest_modulo_the_range(spark, texts, low, size):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hash_bucket(F.col("t"), low, low + size - 1)).collect()]
    assert got == [low + int(hashlib.sha256(t.encode()).hexdigest(), 16) % size for t in texts]


def test_class_keeps_the_meaning_of_its_characters(spark):
    text = "a-b[c]d&&e^f."
    assert one(spark, normalize(F.lit(text), char_class([",", "?", "."]))) == "a-b[c]d&&e^f"
    assert one(spark, normalize(F.lit(text), char_class(["[", "&", "."]))) == "a-bc]de^f"
    assert one(spark, normalize(F.lit(text), char_class(["a", "-", "d"]))) == "-[]&&e^f."
    assert one(spark, normalize(F.lit("A.B"), char_class(None), lower=False)) == "A.B"


def test_missing_target_reads_none(spark):
    missing = F.lit(None).cast("string")
    assert one(spark, target_text(missing)) == "none "
    assert one(spark, target_text(missing, lower=False)) == "None "
    assert one(spark, target_text(F.lit("Ab, c"), char_class([","]))) == "ab c "


def test_prompts(spark):
    inst, lang = F.lit("Rate"), F.lit("German")
    assert one(spark, prompt_prefix(inst)) == "###[Human]: Rate "
    assert one(spark, prompt_prefix(inst, lang, chatml=True)) == \
        "<|im_start|>user\nRate\nGerman audio: "
    assert one(spark, prompt_prefix(inst, lang, True, False)) == "<|im_start|>user\nRate\nGerman: "
    assert one(spark, prompt_tail(F.lit("S"), True)) == "S<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, prompt_tail(F.lit(None).cast("string"))) == "\n\n\n###[Assistant]:"


def test_cache_key(spark):
    key = one(spark, cache_key(F.lit("test*_x.tsv,b.json"), "some/llama", True, F.lit("[a-z]")))
    assert key == "processed_tokllama_lowerTrue_regex391582_testall_x,b"


@pytest.mark.parametrize("base, path, want", [
    ("/a", "b/c.wav", "/a/b/c.wav"), ("/a/", "b", "/a/b"), ("/a", "/b", "/b"), ("", "b", "b"),
    (None, "b", "b"),
])
def test_prefix(spark, base, path, want):
    assert one(spark, prefix_path(base, F.lit(path))) == want


@pytest.mark.parametrize("path, want", [
    ("a.wav:10:20", ("a.wav", 10, 20)), ("a.flac:0:-1", ("a.flac", 0, -1)),
    ("a.mp3:1:2", ("a.mp3:1:2", 0, -1)), ("a.wav", ("a.wav", 0, -1)),
    ("a.wav:1", ("a.wav:1", 0, -1)), ("a.wav:1:2:3", ("a.wav:1:2:3", 0, -1)),
    ("a.WAV:1:2", ("a.WAV:1:2", 0, -1)), ("a.wav:x:2", ("a.wav", None, 2)),
])
def test_segment(spark, path, want):
    assert tuple(one(spark, segment_ref(F.lit(path)))) == want


@pytest.mark.parametrize("path, ending, good", [
    ("x/a.wav", ".wav", True), ("a.WAV", ".WAV", False), ("a.b.ogg", ".ogg", True),
    ("x.d/a", "", False), (".wav", "", False), ("a.mp3", ".mp3", True), ("a.txt", ".txt", False),
    ("a.wav\n", ".wav\n", False),
])
def test_ending(spark, path, ending, good):
    assert one(spark, file_ending(F.lit(path))) == ending
    assert one(spark, has_audio_ending(F.lit(path))) is good


@pytest.mark.parametrize("content, good", [
    (b"RIFF\x00\x01\x02\x03WAVEfmt ", True), (b"RIFX0000WAVE", True), (b"RF64\xff\xff\xff\xffWAVE", True), (b"RIFX0000AVI ", False), (b"fLaC\x00", True),
    (b"OggS", True), (b"ID3\x04", True), (b"\xff\xfb\x90", True), (b"", False), (None, False),
    (b"xxRIFF0000WAVE", False), (b"RIFF\n\n\n\nWAVE", True),
])
def test_header(spark, content, good):
    df = spark.createDataFrame([(bytearray(content) if content is not None else None,)], "c binary")
    assert df.select(has_audio_header(F.col("c"))).first()[0] is good


def test_language_names(spark):
    rows = spark.createDataFrame([("de",), ("es",), ("zz",), ("en",)], "lang string")
    got = {r["lang"]: r["lang_name"] for r in with_language_name(rows).collect()}
    assert got == {"de": "German", "es": "Spanish", "en": "English", "zz": "zz"}
