"""What an audio file says about itself: WAV, FLAC, Ogg and MPEG, by bounded reads.

A parser is given ``read(place, count)`` and the size of the file. It follows the
structure of the container rather than its first bytes: chunk by chunk, block by
block, page by page or frame by frame, with the checksums the format has. Of a file
of any size it reads a few headers, the last frame or page, and for MPEG without a
frame count at most ``MPEG_SCAN`` bytes of frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

MAX_CHUNKS = 10_000
MPEG_SCAN = 1 << 20
MPEG_SEARCH = 1 << 16
LARGEST_PAGE = 27 + 255 + 255 * 255
LEAST_TAIL = 1 << 16


class Audio(NamedTuple):
    """``frames`` are samples per channel; ``complete`` is False where the end is missing."""

    container: str
    codec: str
    rate: int
    channels: int
    frames: int
    complete: bool


Read = Callable[[int, int], bytes]


def parse(read: Read, size: int) -> Audio | None:
    """The properties of an audio file, or None for anything else."""
    try:
        head = read(0, 12)
        if head[:4] in (b"RIFF", b"RIFX", b"RF64", b"BW64") and head[8:12] == b"WAVE":
            return _wav(read, size, head[:4])
        start = _tag_end(read)
        mark = read(start, 4)
        if mark == b"fLaC":
            return _flac(read, size, start)
        return _ogg(read, size) if mark == b"OggS" and not start else _mpeg(read, size, start)
    except (struct.error, ValueError, IndexError, ZeroDivisionError):
        return None


def parse_bytes(content: bytes | None) -> Audio | None:
    return None if content is None else parse(lambda at, n: content[at:at + n], len(content))


def _tag_end(read: Read) -> int:
    """Where the file begins after leading tags."""
    at = 0
    while (head := read(at, 10))[:3] == b"ID3" and len(head) == 10:
        if max(head[6:]) > 127:
            raise ValueError("a tag's size has seven bits a byte")
        at += 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + (10 if head[5] & 0x10 else 0)
    return at


def _end(read: Read, size: int) -> int:
    """Where the file ends without a closing tag."""
    return size - 128 if size >= 128 and read(size - 128, 3) == b"TAG" else size


# ---- RIFF

# Format numbers whose frames have a fixed number of bytes.
WAV_CODECS = {1: "pcm", 3: "float", 6: "alaw", 7: "mulaw"}
WAV_BLOCKS = {2: "ms_adpcm", 0x11: "ima_adpcm", 0x31: "gsm610", 0x55: "mp3"}


def _wav(read: Read, size: int, kind: bytes) -> Audio | None:
    order = ">" if kind == b"RIFX" else "<"
    at, form, fact, wide = 12, None, None, None
    for _ in range(MAX_CHUNKS):
        name, length = struct.unpack(order + "4sI", read(at, 8))
        if name == b"ds64":
            wide = struct.unpack("<QQQ", read(at + 8, 24))
        elif name == b"fmt ":
            form = read(at + 8, min(length, 40))
        elif name == b"fact":
            fact = struct.unpack(order + "I", read(at + 8, 4))[0]
        elif name == b"data":
            break
        at += 8 + length + (length & 1)
    else:
        return None
    codec, channels, rate, _, block, bits = struct.unpack(order + "HHIIHH", form[:16] if form else b"")
    if codec == 0xFFFE:
        codec = struct.unpack(order + "H", form[24:26])[0]
    there = size - at - 8
    declared = there if length == 0xFFFFFFFF else length
    if wide and length == 0xFFFFFFFF:
        declared, fact = wide[1], wide[2] or fact
    if not channels or not rate or not block or codec not in WAV_CODECS | WAV_BLOCKS:
        return None
    held = min(declared, there)
    if codec in WAV_CODECS:
        if block != channels * ((bits + 7) // 8) or not bits:
            return None
        frames = held // block
    elif codec in (2, 0x11) and len(form) >= 20:
        per_block = struct.unpack(order + "H", form[18:20])[0]
        frames = fact if fact is not None else held // block * per_block
    else:
        frames = fact or 0
    return Audio("wav", (WAV_CODECS | WAV_BLOCKS)[codec], rate, channels, frames, declared <= there)


# ---- FLAC


def _table(width: int, polynomial: int) -> list[int]:
    out = []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial if value >> (width - 1) else value << 1) & ((1 << width) - 1)
        out.append(value)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)


def crc8(data: bytes) -> int:
    value = 0
    for byte in data:
        value = _CRC8[value ^ byte]
    return value


def crc16(data: bytes) -> int:
    value = 0
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ _CRC16[value >> 8 ^ byte]
    return value


def flac_frame(data: bytes, at: int, block_size: int) -> tuple[int, int] | None:
    """First sample and number of samples of the frame whose header is there, if one is."""
    head = data[at:at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    code, rate, lead = head[2] >> 4, head[2] & 15, head[4]
    more = 0 if lead < 0x80 else next((n for n in range(1, 7) if lead >> (6 - n) == (1 << (n + 2)) - 2), None)
    if not code or rate == 15 or more is None:
        return None
    number = lead if not more else lead & ((1 << (6 - more)) - 1)
    for byte in head[5:5 + more]:
        if byte >> 6 != 2:
            return None
        number = number << 6 | byte & 63
    end = 5 + more
    extra = {6: 1, 7: 2}.get(code, 0)
    samples = int.from_bytes(head[end:end + extra], "big") + 1 if extra else 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
    end += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(head) or crc8(head[:end]) != head[end]:
        return None
    return (number if head[1] & 1 else number * block_size), samples


def _flac(read: Read, size: int, start: int) -> Audio | None:
    at, last, info = start + 4, False, None
    for _ in range(MAX_CHUNKS):
        if last:
            break
        head = read(at, 4)
        last, kind, length = head[0] >> 7, head[0] & 127, int.from_bytes(head[1:4], "big")
        if (info is None) != (kind == 0) or at + 4 + length > size:
            return None
        if info is None:
            info = read(at + 4, 34)
        at += 4 + length
    largest_block, largest_frame = int.from_bytes(info[2:4], "big"), int.from_bytes(info[7:10], "big")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, frames = packed >> 44, (packed >> 41 & 7) + 1, packed & ((1 << 36) - 1)
    if not last or not rate or largest_block < 16:
        return None
    end = _end(read, size)
    if at == end:
        # a file without samples
        return Audio("flac", "flac", rate, channels, 0, frames == 0)
    if flac_frame(read(at, 16), 0, largest_block) is None:
        return None
    tail = read(max(at, end - max(largest_frame, LEAST_TAIL)), end - max(at, end - max(largest_frame, LEAST_TAIL)))
    place = len(tail)
    while (place := max(tail.rfind(b"\xff\xf8", 0, place), tail.rfind(b"\xff\xf9", 0, place))) >= 0:
        found = flac_frame(tail, place, largest_block)
        if found and crc16(tail[place:-2]) == int.from_bytes(tail[-2:], "big"):
            last_sample = sum(found)
            return Audio("flac", "flac", rate, channels, frames or last_sample, frames in (0, last_sample))
    return Audio("flac", "flac", rate, channels, frames, False)


# ---- Ogg

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero: the usual one, with all bits the other way round."""
    value = ~zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) & 0xFFFFFFFF
    return int(f"{value:032b}"[::-1], 2)


def ogg_page(data: bytes, at: int) -> tuple[int, int, int, bytes, int] | None:
    """Flags, granule position, stream, body and end of the sound page that begins there, if one does."""
    if data[at:at + 5] != b"OggS\0" or at + 27 > len(data):
        return None
    flags, granule, stream, _, checksum, segments = struct.unpack("<BqIIIB", data[at + 5:at + 27])
    body = at + 27 + segments
    end = body + sum(data[at + 27:body])
    if end > len(data) or ogg_crc(data[at:at + 22] + bytes(4) + data[at + 26:end]) != checksum:
        return None
    return flags, granule, stream, data[body:end], end


def _ogg(read: Read, size: int) -> Audio | None:
    first = ogg_page(read(0, LARGEST_PAGE), 0)
    if first is None or not first[0] & 2:
        return None
    stream, body, skipped = first[2], first[3], 0
    if body[:7] == b"\x01vorbis":
        codec, channels, rate = "vorbis", body[11], struct.unpack("<I", body[12:16])[0]
    elif body[:8] == b"OpusHead":
        codec, channels, rate, skipped = "opus", body[9], 48000, struct.unpack("<H", body[10:12])[0]
    elif body[:5] == b"\x7fFLAC":
        packed = int.from_bytes(body[27:35], "big")
        codec, channels, rate = "flac", (packed >> 41 & 7) + 1, packed >> 44
    elif body[:8] == b"Speex   ":
        codec, rate, _, channels = "speex", *struct.unpack("<III", body[36:40] + body[40:44] + body[48:52])
    else:
        return None
    if not channels or not rate:
        return None
    start = max(0, size - 2 * LARGEST_PAGE)
    tail, frames, complete = read(start, size - start), 0, None
    place = len(tail)
    while (place := tail.rfind(b"OggS", 0, place)) >= 0:
        page = ogg_page(tail, place)
        if page and page[2] == stream:
            if complete is None:
                complete = page[4] == len(tail) and bool(page[0] & 4)
            if page[1] >= 0:
                frames = max(0, page[1] - skipped)
                break
    return Audio("ogg", codec, rate, channels, frames, bool(complete))


# ---- MPEG

# Kilobits per second of the fifteen codes, for version 1 in layers I, II, III,
# and for the lower rates in layer I and in layers II and III; sampling rates of version 1.
MPEG_BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = (44100, 48000, 32000)


class Frame(NamedTuple):
    kind: tuple
    rate: int
    channels: int
    samples: int
    length: int
    side: int


def mpeg_frame(head: bytes) -> Frame | None:
    """What the four bytes of a frame header say, or None if they are none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] >> 5 != 7:
        return None
    version, layer = {0: 4, 2: 2, 3: 1}.get(head[1] >> 3 & 3), 4 - (head[1] >> 1 & 3)
    code, place = head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer == 4 or code in (0, 15) or place == 3:
        return None
    bitrate = 1000 * MPEG_BITRATES[min(version, 2), layer if version == 1 else min(layer, 2)][code]
    rate, padding = MPEG_RATES[place] // version, head[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version > 1 else 1152
    length = (12 * bitrate // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // rate + padding
    mono = head[3] >> 6 == 3
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return Frame((version, layer, rate), rate, 1 if mono else 2, samples, length, side)


def _mpeg(read: Read, size: int, start: int) -> Audio | None:
    end = _end(read, size)
    data = read(start, min(MPEG_SEARCH + 8192, end - start))
    at = -1
    while (at := data.find(b"\xff", at + 1, MPEG_SEARCH)) >= 0:
        first = mpeg_frame(data[at:at + 4])
        if first is None:
            continue
        after = mpeg_frame(data[at + first.length:at + first.length + 4])
        if (after and after.kind == first.kind) or start + at + first.length == end:
            break
    else:
        return None
    if at < 0:
        return None
    begin, codec = start + at, f"mp{first.kind[1]}"
    body = data[at:at + first.length]
    for name, offset, fields in ((b"Xing", 4 + first.side, ">4sIII"), (b"Info", 4 + first.side, ">4sIII"), (b"VBRI", 36, ">4s6xII")):
        if body[offset:offset + 4] == name:
            values = struct.unpack_from(fields, body, offset)
            flags, frames, held = (values[1], values[2], values[3]) if name != b"VBRI" else (3, values[2], values[1])
            if flags & 1:
                return Audio("mpeg", codec, first.rate, first.channels, frames * first.samples, not flags & 2 or held <= end - begin)
    return _mpeg_walk(read, begin, end, first, codec)


def _mpeg_walk(read: Read, begin: int, end: int, first: Frame, codec: str) -> Audio:
    """Frames counted one by one, up to ``MPEG_SCAN`` bytes, and beyond by the mean of those."""
    data = read(begin, min(MPEG_SCAN, end - begin))
    at = count = 0
    while (frame := mpeg_frame(data[at:at + 4])) and frame.kind == first.kind and begin + at + frame.length <= end:
        at += frame.length
        count += 1
    if len(data) == end - begin or at < len(data) - 8192:
        # all was read, or something else stands after the frames
        return Audio("mpeg", codec, first.rate, first.channels, count * first.samples, begin + at == end)
    return Audio("mpeg", codec, first.rate, first.channels, count * (end - begin) // at * first.samples, True)
