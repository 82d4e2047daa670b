"""Audio references and file headers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted file endings, and those that may carry a segment.
AUDIO_ENDINGS = (".wav", ".flac", ".ogg", ".mp3")
SEGMENT_ENDINGS = r"\.(?:wav|flac)\z"


def segment_ref(path: Column) -> Column:
    """STRUCT(file, start, frames) of a path that may read ``file:start:frames``.

    A plain path starts at 0 and has -1 frames, meaning all. Numbers that
    cannot be read give NULL.
    """
    parts = F.split(path, ":", -1)
    segment = (F.size(parts) == 3) & F.element_at(parts, 1).rlike(SEGMENT_ENDINGS)
    number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("bigint")
    return F.struct(
        F.when(segment, F.get(parts, F.lit(0))).otherwise(path).alias("file"),
        F.when(segment, number(1)).otherwise(F.lit(0).cast("bigint")).alias("start"),
        F.when(segment, number(2)).otherwise(F.lit(-1).cast("bigint")).alias("frames"),
    )


def file_ending(path: Column) -> Column:
    """The last dotted part of the file name, empty if there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)


def has_audio_ending(path: Column) -> Column:
    """Whether the ending, case included, is one of the accepted ones."""
    return F.coalesce(file_ending(path).isin(*AUDIO_ENDINGS), F.lit(False))


def has_audio_header(content: Column) -> Column:
    """Whether the bytes begin like a WAV, FLAC, OGG or MPEG audio file."""
    start = F.hex(F.substring(content, 1, 12))
    return F.coalesce(
        start.rlike(
            r"\A(?:52494646.{8}57415645"  # RIFF....WAVE
            r"|(?:52494658|52463634).{8}57415645"  # RIFX, RF64
            r"|664C6143"  # fLaC
            r"|4F676753"  # OggS
            r"|494433"  # ID3
            r"|FF[EF])"  # MPEG frame sync
        ),
        F.lit(False),
    )
