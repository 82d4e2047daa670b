import io
import random
import wave

import pytest

from metaeval.functions.containers import crc8, crc16, flac_frame, mpeg_frame, ogg_crc, parse_bytes
from metaeval.sinks.audio import flac_bytes, mpeg_bytes, ogg_page_bytes, opus_bytes, wav_bytes
from metaeval.sources.inventory import probe_audio

RNG = random.Random(2)
SOUND = RNG.randbytes(90_000)
FILES = {
    "riff": (wav_bytes(SOUND, 16000), ("wav", "pcm", 16000, 1, 45_000)),
    "odd_riff": (wav_bytes(SOUND[:7], 8000, bits=8), ("wav", "pcm", 8000, 1, 7)),
    "rifx": (wav_bytes(SOUND, 44100, 2, 24, kind=b"RIFX"), ("wav", "pcm", 44100, 2, 15_000)),
    "rf64": (wav_bytes(SOUND, 48000, 2, 32, 3, b"RF64"), ("wav", "float", 48000, 2, 11_250)),
    "mulaw": (wav_bytes(SOUND, 8000, 1, 8, 7), ("wav", "mulaw", 8000, 1, 90_000)),
    "flac": (flac_bytes(SOUND, 16000), ("flac", "flac", 16000, 1, 45_000)),
    "long_flac": (flac_bytes(RNG.randbytes(2 * 16 * 3000), 96000, 16), ("flac", "flac", 96000, 1, 48_000)),
    "opus": (opus_bytes([SOUND[:300], SOUND[:65_000], SOUND[:1]], 12_345), ("ogg", "opus", 48000, 2, 12_345)),
    "counted_mpeg": (mpeg_bytes(77), ("mpeg", "mp3", 44100, 2, 77 * 1152)),
    "plain_mpeg": (mpeg_bytes(77, False, 9, SOUND[:5000]), ("mpeg", "mp3", 44100, 2, 77 * 1152)),
    "long_mpeg": (mpeg_bytes(6000, False), ("mpeg", "mp3", 44100, 2, 6000 * 1152)),
}


@pytest.mark.parametrize("name", FILES)
def test_whole_files(name):
    content, want = FILES[name]
    assert parse_bytes(content) == (*want, True)
    if name in ("flac", "counted_mpeg", "plain_mpeg", "long_flac"):
        assert parse_bytes(content + b"TAG" + bytes(125)) == (*want, True)


@pytest.mark.parametrize("name", [n for n in FILES if n != "long_mpeg"])
def test_cut_files(name):
    content, _ = FILES[name]
    for end in sorted({*range(min(len(content) - 1, 120)), len(content) // 3, len(content) // 2, len(content) - 5, len(content) - 2}):
        found = parse_bytes(content[:end])
        whole_frames = name == "plain_mpeg" and found and (end - 5010) % 626 == 0
        assert found is None or not found.complete or whole_frames, end


@pytest.mark.parametrize("content", [
    b"", b"RIFF", b"RIFF0000WAVE", b"RIFF0000WAVEfmt prose and prose " * 9, b"RIFX0000AVI " + SOUND, b"fLaC", b"fLaC" + SOUND, b"OggS", b"OggS\0" + SOUND, b"ID3",
    b"ID3\x03\0\0\0\0\0\5hello, prose", b"\xff\xfb\x90\0" + b"prose" * 500, b"prose " * 1000, SOUND, wav_bytes(SOUND, 0), wav_bytes(SOUND, 8000, 0x0),
    FILES["riff"][0].replace(b"data", b"junk"), FILES["riff"][0].replace(b"fmt ", b"junk"), ogg_page_bytes(b"no codec", 0, 6, 0)])
def test_false_files(content):
    found = parse_bytes(content)
    assert found is None or not found.complete


def test_damage_inside_is_seen_by_the_checksums():
    for name in ("flac", "opus"):
        content = bytearray(FILES[name][0])
        content[-1] ^= 1
        assert not parse_bytes(bytes(content)).complete


def test_streams_of_unknown_length():
    content = FILES["riff"][0]
    at = content.index(b"data") + 4
    assert parse_bytes(content[:at] + b"\xff" * 4 + content[at + 4:])[4:] == (45_000, True)
    flac = bytearray(FILES["flac"][0])
    flac[8 + 13:8 + 18] = bytes([flac[8 + 13] & 0xF0, 0, 0, 0, 0])
    assert parse_bytes(bytes(flac))[4:] == (45_000, True)


def test_the_standard_reader_agrees():
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(2)
        file.setsampwidth(2)
        file.setframerate(22050)
        file.writeframes(SOUND)
    assert parse_bytes(out.getvalue()) == ("wav", "pcm", 22050, 2, 22_500, True)
    with wave.open(io.BytesIO(wav_bytes(SOUND, 22050, 2))) as file:
        assert (file.getnframes(), file.getframerate(), file.getnchannels()) == (22_500, 22050, 2)


def test_checksums_and_headers():
    # published check values of these checksums, and a header written out by hand
    assert crc8(b"123456789") == 0xF4 and crc16(b"123456789") == 0xFEE8
    assert ogg_crc(b"") == 0 and ogg_crc(b"\0\0\0\1") == 0x04C11DB7
    assert mpeg_frame(b"\xff\xfb\x90\x00")[1:5] == (44100, 2, 1152, 417)
    assert mpeg_frame(b"\xff\xfb\x92\x00")[4] == 418 and mpeg_frame(b"\xff\xf3\x80\xc0")[1:5] == (22050, 1, 576, 208)
    assert mpeg_frame(b"\xff\xff\xf0\x00") is None and mpeg_frame(b"\xff\xfb\x9c\x00") is None
    head = b"\xff\xf8\xc9\x08\xc3\xa9"
    assert flac_frame(head + bytes([crc8(head)]) + bytes(20), 0, 4096) == (0xE9 * 4096, 4096)


def test_reads_are_bounded():
    read = []

    def note(content):
        return lambda at, n: read.append(n) or content[at:at + n]

    from metaeval.functions.containers import parse
    for name in ("long_mpeg", "long_flac", "rf64"):
        read.clear()
        content = FILES[name][0] + (bytes(1 << 20) if name == "rf64" else b"")
        assert parse(note(content), len(content)) and sum(read) <= (1 << 20) + (1 << 18)


def test_probing_tells_what_files_hold(spark, tmp_path):
    rows = []
    for name, (content, want) in FILES.items():
        (tmp_path / name).write_bytes(content)
        (tmp_path / f"{name}.cut").write_bytes(content[:len(content) - 700])
        rows += [(str(tmp_path / name), want), (str(tmp_path / name), want)]
    df = spark.createDataFrame([(p,) for p, _ in rows] + [(None,), (str(tmp_path),), (str(tmp_path / "absent"),)], "path string")
    got = probe_audio(df).collect()
    want = {p: w for p, w in rows}
    assert len(got) == len(rows) + 3
    for r in got:
        assert r["is_readable"] == (r["path"] in want)
        assert (r["audio"] is None) == (r["path"] not in want) and (r["audio"] is None or tuple(r["audio"]) == (*want[r["path"]], True))
    cut = spark.createDataFrame([(str(tmp_path / f"{n}.cut"),) for n in ("riff", "flac", "opus")], "path string")
    assert [r["is_readable"] for r in probe_audio(cut).collect()] == [False] * 3
    assert [r["is_readable"] for r in probe_audio(cut, whole=False).collect()] == [True] * 3
