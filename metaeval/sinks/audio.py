"""Samples as small, complete audio files: WAV, FLAC, Ogg and MPEG, uncompressed or silent."""

from __future__ import annotations

import struct

from metaeval.functions.containers import MPEG_BITRATES, crc8, crc16, ogg_crc


def wav_bytes(samples: bytes, rate: int, channels: int = 1, bits: int = 16, codec: int = 1, kind: bytes = b"RIFF") -> bytes:
    """A WAV file around sample bytes; ``kind`` RIFX has big-endian headers, RF64 64-bit sizes."""
    order = ">" if kind == b"RIFX" else "<"
    block = channels * bits // 8
    form = struct.pack(order + "4sIHHIIHH", b"fmt ", 16, codec, channels, rate, rate * block, block, bits)
    wide, size, total = b"", len(samples), 36 + len(samples) + len(samples) % 2
    if kind == b"RF64":
        wide = struct.pack("<4sIQQQI", b"ds64", 28, total + 36, size, size // block, 0)
        size = total = 0xFFFFFFFF
    return struct.pack(order + "4sI4s", kind, total, b"WAVE") + wide + form + struct.pack(order + "4sI", b"data", size) + samples + b"\0" * (len(samples) % 2)


def flac_bytes(samples: bytes, rate: int, block: int = 4096) -> bytes:
    """A mono FLAC file of big-endian 16-bit samples, stored as they are."""
    total = len(samples) // 2
    info = struct.pack(">HH", block, block) + bytes(6) + (rate << 44 | 0 << 41 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = [b"fLaC", bytes([0x80, 0, 0, len(info)]), info]
    for number, first in enumerate(range(0, total, block)):
        count = min(block, total - first)
        # UTF-8 of a number is the UTF-8 of that code point, as long as it is no surrogate
        head = b"\xff\xf8\x70\x08" + chr(number).encode("utf-8", "surrogatepass") + struct.pack(">H", count - 1)
        frame = head + bytes([crc8(head)]) + b"\x02" + samples[2 * first:2 * (first + count)]
        out.append(frame + struct.pack(">H", crc16(frame)))
    return b"".join(out)


def ogg_page_bytes(packet: bytes, granule: int, flags: int, number: int, stream: int = 1) -> bytes:
    """One page with one packet of less than 65,025 bytes."""
    lacing = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
    start = b"OggS\0" + struct.pack("<BqII", flags, granule, stream, number)
    rest = bytes([len(lacing)]) + lacing + packet
    return start + struct.pack("<I", ogg_crc(start + bytes(4) + rest)) + rest


def opus_bytes(packets: list[bytes], frames: int, channels: int = 2, skipped: int = 312) -> bytes:
    """An Ogg file whose last page says that it has so many frames."""
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, channels, skipped, 48000, 0, 0)
    pages = [ogg_page_bytes(head, 0, 2, 0), ogg_page_bytes(b"OpusTags" + bytes(8), 0, 0, 1)]
    for i, packet in enumerate(packets):
        last = i + 1 == len(packets)
        pages.append(ogg_page_bytes(packet, frames + skipped if last else 0, 4 if last else 0, 2 + i))
    return b"".join(pages)


def mpeg_bytes(count: int, counted: bool = True, code: int = 5, tag: bytes = b"") -> bytes:
    """Silent stereo frames at 44,100 Hz, behind a tag, with a first frame that counts them if ``counted``."""
    head = bytes([0xFF, 0xFB, code << 4, 0])
    frame = head.ljust(144_000 * MPEG_BITRATES[1, 3][code] // 44100, b"\0")
    first = b""
    if counted:
        first = (head + bytes(32) + struct.pack(">4sIII", b"Xing", 3, count, (count + 1) * len(frame))).ljust(len(frame), b"\0")
    size = len(tag)
    lead = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tag if tag else b""
    return lead + first + frame * count
