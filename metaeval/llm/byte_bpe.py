"""Byte-level BPE: exact merges in linear time, and decoding.

Pieces of up to ``SHORT`` bytes, nearly all there are, are merged by rank step by step.
For longer ones the vocabulary's byte strings, read as Latin-1, go into an Aho-Corasick automaton.
One pass over a piece of text lists the tokens that start at each byte. The
encoder takes the longest token at each place, steps back to a shorter one, or to
the place before, where neighbours do not fit, and remembers places that lead
nowhere, so that each is left once. Two neighbours fit if merging their joint
bytes gives just these two; that is kept by pair. A sequence whose neighbours all
fit is the one that merging by rank gives.

Texts are split by a pattern first and each match is encoded by itself. A task
keeps the ids of the matches it has met, up to ``KNOWN`` of them: at half as many it
begins anew and takes over from the former half what it meets again, so that memory is
bounded and frequent matches stay.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to no bytes. Ids and repeated rows are passed through. Extra columns are
not read by the query's form; ``encode_documents`` keeps all of them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from metaeval.llm import flat
from metaeval.llm.registry import query

#: Matches of the pattern, and half the pairs of tokens, that a task remembers; longer matches are not remembered.
KNOWN = 300_000
LONGEST_KNOWN = 64
#: Bytes of a piece that merging step by step is quicker for.
SHORT = 64
_NONE = 1 << 60
RANKS = "byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # what counts as white space there: the Unicode property, without the separators U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.size = {rank: len(token) for token, rank in ranks.items()}
        #: the next shorter token that a token begins with, -1 without one
        self.shorter = {rank: next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1) for token, rank in ranks.items()}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merging by rank, step by step, the first of equal pairs first: short pieces, and what a pair of tokens is tested by."""
        rank_of, n = self.ranks.get, len(piece)
        # where the parts begin, and the end; the rank of each part joined with the next one
        starts = list(range(n + 1))
        pairs = [rank_of(piece[i:i + 2], _NONE) for i in range(n - 1)]
        while pairs and (best := min(pairs)) != _NONE:
            i = pairs.index(best)
            del starts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(piece[starts[i]:starts[i + 2]], _NONE)
            if i:
                pairs[i - 1] = rank_of(piece[starts[i - 1]:starts[i + 1]], _NONE)
        return [self.ranks[piece[first:end]] for first, end in zip(starts, starts[1:])]

    def fit(self, left: int, right: int) -> bool:
        found = self.fits.get(left << 32 | right)
        if found is None:
            if len(self.fits) >= 2 * KNOWN:
                self.fits.clear()
            found = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self.fits[left << 32 | right] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= SHORT:
            return self.merged(piece)
        n, size, shorter = len(piece), self.size, self.shorter
        # of the tokens from each byte on the longest; all others are what it begins with
        longest = array("i", [-1]) * n
        for last, (rank, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[last - length + 1] = rank
        closed = bytearray(n + 1)  # places from which nothing fits on
        ids, ends, tries = [], [0], [longest[0]]
        while ends[-1] < n:
            at, rank = ends[-1], tries[-1]
            while rank >= 0:
                end = at + size[rank]
                if not closed[end] and (not ids or self.fit(ids[-1], rank)):
                    break
                rank = shorter[rank]
            else:
                closed[at] = 1
                tries.pop()
                ends.pop()
                ids.pop()
                continue
            tries[-1] = shorter[rank]
            ids.append(rank)
            ends.append(end)
            tries.append(longest[end] if end < n else -1)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, pieces = self.known, self.split(text)
        new = set(pieces).difference(known)
        if new:
            if len(known) + len(new) > KNOWN // 2:
                self.before, self.known = known, {}
                known, new = self.known, set(pieces)
            once, before = {}, self.before
            for piece in new:
                ids = before.get(piece)
                if ids is None:
                    found = self.encode_piece(piece.encode())
                    ids = struct.pack(f"<{len(found)}I", *found) if len(found) <= SHORT else np.array(found, "<u4").tobytes()
                # a match of the pattern may be as long as a text: long ones are not kept
                keep = known if len(piece) <= LONGEST_KNOWN else once
                keep[piece] = ids
            if once:
                return b"".join(once.get(piece) or known[piece] for piece in pieces)
        return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind ids."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(documents: DataFrame, path: str, pattern: str) -> Callable[[], ByteBpe]:
    """The file is read on the driver and sent to the tasks: its size is the vocabulary's."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))
    return lambda: ByteBpe(ranks.value, pattern)


def encode_documents(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """The documents with their ids as an array of integers, in place of a column of that name."""
    flat.small_batches(documents.sparkSession)
    make = _encoder(documents, path or public_tokenizers.path(RANKS), pattern)
    names = [c for c in documents.columns if c != ids_column]
    documents = documents.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*documents.schema, T.StructField(ids_column, T.ArrayType(T.IntegerType()))])
    at = names.index(text_column)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in batches:
            found = [bpe.encode(text or "") for text in batch.column(at).to_pylist()]
            ids = flat.lists(pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)), np.array([len(x) // 4 for x in found], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=schema.names)

    return documents.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     ids_column: str = "ids", bytes_column: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids, in place of a column of that name; null ids decode to no bytes."""
    flat.small_batches(encoded.sparkSession)
    make = _encoder(encoded, path or public_tokenizers.path(RANKS), pattern)
    names = [c for c in encoded.columns if c != bytes_column]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([*encoded.schema, T.StructField(bytes_column, T.BinaryType())])
    at = names.index(ids_column)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in batches:
            column = batch.column(at)
            ids = column.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            texts = [bpe.decode(ids[first:end].tobytes()) for first, end in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.mapInArrow(run, schema)


def encoding_digests(documents: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes that they decode to."""
    flat.small_batches(documents.sparkSession)
    make = _encoder(documents, path or public_tokenizers.path(RANKS), pattern)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = make()
        for batch in batches:
            sizes, digests, decoded = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                sizes.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


@query()
def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return encoding_digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
