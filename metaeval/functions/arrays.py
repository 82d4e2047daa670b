"""Token, mask, length and waveform arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: label of positions that do not count in a loss.
IGNORED_LABEL = -100


def ones_mask(ids: Column) -> Column:
    """An attention mask that covers every id."""
    return F.array_repeat(F.lit(1), F.size(ids))


def ignored(ids: Column) -> Column:
    """Labels for ids that must not count."""
    return F.array_repeat(F.lit(IGNORED_LABEL), F.size(ids))


def prompt_labels(ids: Column, label_all: bool = False) -> Column:
    """Labels of prompt ids: ignored, or the ids themselves on request."""
    return ids if label_all else ignored(ids)


def pad(values: Column, size: Column, filler: int) -> Column:
    """``values`` filled up at the right to ``size`` entries."""
    missing = F.greatest(size - F.size(values), F.lit(0))
    return F.concat(values, F.array_repeat(F.lit(filler), missing))


def truncate(values: Column, size: Column) -> Column:
    """The first ``size`` entries."""
    return F.slice(values, F.lit(1), size.cast("int"))


def padding_mask(length: Column, size: Column) -> Column:
    """``size`` flags, true from position ``length`` on."""
    flags = F.transform(F.sequence(F.lit(0).cast("bigint"), size.cast("bigint") - 1),
                        lambda i: i >= length)
    return F.when(size > 0, flags).otherwise(F.array().cast("array<boolean>"))


def attention_from_padding(mask: Column) -> Column:
    """The mask of real positions: the padding mask negated."""
    return F.transform(mask, lambda padded: ~padded)


def mask_length(mask: Column) -> Column:
    """The number of real positions in a 0/1 mask."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, m: acc + m)


def encoder_length(frames: Column) -> Column:
    """Frames left after the encoder's stride-two layer."""
    return F.floor((frames.cast("bigint") - 1) / F.lit(2.0)) + 1


def subsampled_length(length: Column, layers: int = 3) -> Column:
    """Frames left after ``layers`` stride-two convolutions."""
    return F.aggregate(
        F.array_repeat(F.lit(0), layers), length.cast("bigint"),
        lambda out, _: F.floor((out - 1) / F.lit(2.0) + F.lit(1.0)).cast("bigint"),
    )


def speech_length(frames: Column, layers: int = 3) -> Column:
    """Speech positions one clip takes in the sequence."""
    return subsampled_length(encoder_length(frames), layers)


def mono(channels: Column) -> Column:
    """The mean over channels of an ARRAY<ARRAY<FLOAT>>, sample by sample."""
    count = F.size(channels)
    first = F.transform(F.element_at(channels, 1), lambda v: v.cast("double"))
    summed = F.aggregate(F.slice(channels, F.lit(2), F.greatest(count - 1, F.lit(0))), first,
                         lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b))
    return F.transform(summed, lambda v: v / count)


def full_scale(samples: Column) -> Column:
    """Samples on the 16-bit integer scale."""
    return F.transform(samples, lambda v: v * F.lit(32768.0))


def peak_normalized(samples: Column) -> Column:
    """Samples scaled so the loudest has size one; silence stays as it is."""
    peak = F.array_max(F.transform(samples, lambda v: F.abs(v)))
    return F.when(peak > 0, F.transform(samples, lambda v: v / peak)).otherwise(samples)
