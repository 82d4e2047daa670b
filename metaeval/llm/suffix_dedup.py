"""Removal of repeated byte strings with suffix arrays.

Every byte that a string of ``MATCH`` bytes covers which also starts anywhere else,
in any document, is found exactly:

1. Each window of ``MATCH`` bytes names its anchor, the ``GRAM`` bytes of least hash
   in it. Equal windows have equal anchors at the same place. Neighbouring
   windows with one anchor are a run; a run's bytes are its context.
2. Anchors that occur once cannot belong to a repeat. A bitmap of a fixed size
   leaves out nearly all of them. Runs with equal contexts are counted; all
   windows of a context that occurs twice are repeats.
3. Anchors with several different contexts are dealt to shards, equal anchors to
   one. A shard has a suffix array of its contexts, by Larsson-Sadakane
   refinement, and the common prefixes of neighbours, by Kasai's method run over
   all contexts in step; a window is a repeat if it shares ``MATCH`` bytes with a
   neighbour.
4. An anchor whose contexts exceed a shard has several. Each has its array, and
   each pair is merged by binary search of one's windows in the other's array.

A task holds one shard, or two. Texts travel once, and only where something goes.

Defined results: a null text counts as empty; texts under ``MATCH`` bytes lose
nothing. Rows with equal id and text are repeats of each other and get equal
results. A null id is kept. Extra columns are never read. ``without_repeats``
decodes what stays leniently, since a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from metaeval.llm import bits, flat
from metaeval.llm.cells import frequent_slots
from metaeval.llm.registry import query

MATCH = 400
GRAM = 64
WINDOW = MATCH - GRAM + 1
SHARD_BYTES = 2 << 20
BITMAP_BITS = 26
_PLACE_BITS = np.uint64(28)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from minima inside of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def find_runs(data: np.ndarray, offsets: np.ndarray, match: int = MATCH, gram: int = GRAM):
    """Row, first window, number of windows, anchor hash and context hash of every run of a piece."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < match:
        return none
    sums = flat.prefix_sums(data)
    _, down = flat._powers_to(len(data) + 1)
    hashes = flat.mixed((sums[gram:] - sums[:-gram]) * down[:len(data) - gram + 1])
    place = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | ((np.uint64(1) << _PLACE_BITS) - np.uint64(1) - place)
    least = _least(keys, match - gram + 1)
    sizes = np.maximum(np.diff(offsets) - match + 1, 0)
    # a run ends where the anchor changes, and where a text begins or has no window any more
    edges = np.concatenate([np.flatnonzero(least[1:] != least[:-1]) + 1, offsets[:-1], offsets[:-1] + sizes])
    edges = np.unique(edges[edges < len(least)])
    row = np.searchsorted(offsets, edges, side="right") - 1
    end = np.minimum(np.append(edges[1:], len(least)), offsets[row] + sizes[row])
    some = edges < end
    row, first, windows = row[some], edges[some], (end - edges)[some]
    last_place = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    anchor = (last_place - (least[first] & last_place)).astype(np.int64)
    # least hashes lie close together: mixed once more, they spread over bitmaps and cells
    return row, first, windows, flat.mixed(hashes[anchor]), flat.span_hashes(sums, first, first + windows + match - 1)


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros after the end, as numbers in the order of the bytes."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    key = padded[:n].copy()
    for j in range(1, 8):
        key <<= np.uint64(8)
        key |= padded[j:j + n]
    return key


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, and the place of each in it.

    Suffixes are sorted by eight bytes first. Then only those that still share a
    place are sorted anew, by the place of the suffix as many bytes on as are
    settled, which doubles that number.
    """
    n = len(text)
    key = _words(text)
    order = np.argsort(key)
    same = np.zeros(n, bool)
    same[1:] = key[order][1:] == key[order][:-1]
    head = np.flatnonzero(~same)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    settled = 8
    open_ = np.flatnonzero(same | np.append(same[1:], False))  # places shared so far
    while len(open_):
        own = order[open_]
        group = rank[own]
        then = rank[np.minimum(own + settled, n)]
        # past the end, the nearer the end the smaller
        then = np.where(own + settled > n, n - own - settled - 1, then)
        by = np.argsort(group * (2 * n + 2) + then + n)
        own, group, then = own[by], group[by], then[by]
        order[open_] = own
        new = np.ones(len(own), bool)
        new[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(own)))
        rank[own] = np.repeat(open_[head], count)
        open_ = open_[np.repeat(count > 1, count)]
        settled *= 2
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, up to ``limit``, by place.

    Kasai's method goes through the text in order; from one suffix to the next at
    most one byte of the common prefix is lost. Here all contexts go in step.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(limit + 80, text.dtype)])
    words = _words(padded)
    block = 8 * np.arange(8)
    longest = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[longest], lengths[longest]
    alive = len(lengths) - np.cumsum(np.bincount(lengths, minlength=int(lengths.max()) + 1))[:-1]
    shared = np.zeros(len(starts), np.int64)
    for t, k in enumerate(alive.tolist()):
        at = starts[:k] + t
        place = rank[at]
        other = order[np.maximum(place - 1, 0)]
        size = np.where(place > 0, np.maximum(shared[:k] - 1, 0), 0)
        # 64 bytes at a time, then 8, then single ones; what zeros after the end add is cut off
        going = np.flatnonzero(place > 0)
        for width, same in ((64, lambda a, b: (words[a[:, None] + block] == words[b[:, None] + block]).all(1)),
                            (8, lambda a, b: words[a] == words[b]), (1, lambda a, b: padded[a] == padded[b])):
            left = going
            while len(left):
                a, b = at[left] + size[left], other[left] + size[left]
                left = left[(size[left] < limit) & (np.maximum(a, b) < n)]
                a, b = at[left] + size[left], other[left] + size[left]
                left = left[same(a, b)]
                size[left] += width
        size = np.minimum(size, np.minimum(limit, n - np.maximum(at, other)))
        shared[:k] = size
        out[place] = size
    return out


def _valid(starts: np.ndarray, windows: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int64)
    mark[starts] += 1
    np.add.at(mark, starts + windows, -1)
    return np.cumsum(mark[:-1]) > 0


def repeated_inside(text, order, rank, starts, lengths, windows, match: int = MATCH) -> np.ndarray:
    """Which places of a shard's text begin a window that another place of it begins too."""
    n = len(text)
    valid = _valid(starts, windows, n)
    # only windows matter: places that are none are passed over, and what is shared is the least on the way
    shared = common_prefixes(text, order, rank, starts, lengths, match)
    whole = shared >= match
    hit = np.zeros(n, bool)
    # places in one unbroken stretch of whole matches share all of MATCH bytes
    stretch = np.cumsum(~whole)
    good = valid[order]
    many = np.bincount(stretch[good], minlength=int(stretch[-1]) + 1) > 1
    hit[order[good & many[stretch]]] = True
    return hit


def repeated_in_other(text, starts, windows, other, other_order, other_starts, other_windows, match: int = MATCH) -> np.ndarray:
    """Which windows of one shard begin in the other too, by binary search in the other's array."""
    hit = np.zeros(len(text), bool)
    own = np.flatnonzero(_valid(starts, windows, len(text)))
    sorted_windows = other_order[_valid(other_starts, other_windows, len(other))[other_order]]
    if not len(sorted_windows) or not len(own):
        return hit
    step = np.arange(match)
    for first in range(0, len(own), 20_000):
        at = own[first:first + 20_000]
        mine = text[at[:, None] + step]
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sorted_windows))
        found = np.zeros(len(at), bool)
        while (low < high).any():
            middle = (low + high) // 2
            theirs = other[sorted_windows[np.minimum(middle, len(sorted_windows) - 1)][:, None] + step]
            differ = mine != theirs
            where = differ.argmax(1)
            some = differ[np.arange(len(at)), where]
            found |= ~some & (low < high)
            less = some & (theirs[np.arange(len(at)), where] < mine[np.arange(len(at)), where])
            going = low < high
            low = np.where(going & less, middle + 1, low)
            high = np.where(going & ~less, np.where(some, middle, low), high)
        hit[at[found]] = True
    return hit


def _joined(part: pd.DataFrame):
    lengths = part["bytes"].map(len).to_numpy()
    return np.frombuffer(b"".join(part["bytes"]), np.uint8), np.cumsum(lengths) - lengths, lengths, part["windows"].to_numpy(np.int64)


def _ranges(hit: np.ndarray, part: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    windows = part["windows"].to_numpy(np.int64)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a stretch may run over several contexts only if windows do, and they never reach a context's end
    of = np.searchsorted(starts, first, side="right") - 1
    assert (end <= starts[of] + windows[of]).all()
    return pd.DataFrame({"anchor": part["anchor"].to_numpy()[of], "context": part["context"].to_numpy()[of], "first": first - starts[of], "end": end - starts[of]})


def _shard(group: pd.DataFrame) -> pd.DataFrame:
    """The repeated windows of one shard, or those that two shards have in common."""
    sides = [group[group["side"] == s] for s in (0, 1)]
    sides = [s.sort_values(["anchor", "context"], kind="stable") for s in sides if len(s)]
    texts = [_joined(s) for s in sides]
    arrays = [suffix_array(t[0]) for t in texts]
    if group["alone"].iloc[0]:
        (text, starts, lengths, windows), (order, rank) = texts[0], arrays[0]
        return _ranges(repeated_inside(text, order, rank, starts, lengths, windows), sides[0], starts)
    if len(sides) < 2:
        return pd.DataFrame({"anchor": [], "context": [], "first": [], "end": []}).astype("int64")
    out = []
    for a, b in ((0, 1), (1, 0)):
        hit = repeated_in_other(texts[a][0], texts[a][1], texts[a][3], texts[b][0], arrays[b][0], texts[b][1], texts[b][3])
        out.append(_ranges(hit, sides[a], texts[a][1]))
    return pd.concat(out)


def _rows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("key"), F.col(text_column).alias("text"))


def _runs_of(rows: DataFrame, wanted) -> DataFrame:
    """id, key, first window, number of windows, anchor and context of the runs whose anchor is in the bitmap."""
    schema = T.StructType([rows.schema["id"], *(T.StructField(c, T.LongType()) for c in ("key", "first", "windows", "anchor", "context"))])

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in flat.pieces(batch.column("text")):
                row, first, windows, anchor, context = find_runs(data, offsets)
                ok = bits.has(wanted.value, anchor, BITMAP_BITS)
                row, first = row[ok], first[ok]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(begin, end - begin).take(pa.array(row)) for c in ("id", "key")), pa.array(first - offsets[row]),
                     pa.array(windows[ok]), flat.signed(anchor[ok]), flat.signed(context[ok])], names=schema.names)

    return rows.mapInArrow(run, schema)


def _contexts_of(rows: DataFrame, wanted) -> DataFrame:
    """anchor, context, windows and bytes of the runs whose anchor is in the bitmap; a task gives each context once, several may give the same."""
    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, _, data, offsets in flat.pieces(batch.column("text")):
                _, first, windows, anchor, context = find_runs(data, offsets)
                out = []
                for i in np.flatnonzero(bits.has(wanted.value, anchor, BITMAP_BITS)).tolist():
                    name = (int(anchor[i]), int(context[i]))
                    if name not in seen:
                        seen.add(name)
                        out.append((i, data[first[i]:first[i] + windows[i] + MATCH - 1].tobytes()))
                if out:
                    at = np.array([i for i, _ in out])
                    yield pa.RecordBatch.from_arrays([flat.signed(anchor[at]), flat.signed(context[at]), pa.array(windows[at]), pa.array([b for _, b in out], pa.binary())],
                                                     names=["anchor", "context", "windows", "bytes"])

    return rows.mapInArrow(run, "anchor long, context long, windows long, bytes binary")


def repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, key (hash of the text), first and end byte of strings that go; they may overlap."""
    spark = documents.sparkSession
    flat.small_batches(spark)
    rows = _rows(documents, id_column, text_column)
    twice = spark.sparkContext.broadcast(frequent_slots(rows, lambda data, offsets: [find_runs(data, offsets)[3]], (2,), BITMAP_BITS)[0])
    runs = flat.written(_runs_of(rows, twice))
    counts = flat.written(runs.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.first("windows").alias("windows")))
    several = counts.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum(F.col("windows") + MATCH - 1).alias("size")).filter("contexts > 1")
    several = flat.written(several)
    total = several.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    wanted = spark.sparkContext.broadcast(bits.of_hashes(several, "anchor", BITMAP_BITS))
    # anchors of more than one shard are fewer than there are shards; an anchor that only passed the bitmap has nothing to meet
    large = flat.written(several.filter(F.col("size") > SHARD_BYTES).select("anchor", "size"))
    contexts = _contexts_of(rows, wanted)
    contexts = contexts.withColumn("size", F.lit(0)) if large.isEmpty() else contexts.join(large, "anchor", "left")
    last = F.greatest(F.ceil(F.col("size") / SHARD_BYTES) - 1, F.lit(0)).cast("long")
    part = F.pmod(F.xxhash64("context"), last + 1)
    dealt = contexts.select("anchor", "context", "windows", "bytes", last.alias("last"), part.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    alone, single = F.col("own") == F.col("other"), F.col("last") == 0
    dealt = dealt.select(
        "anchor", "context", "windows", "bytes", F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), alone.alias("alone"),
        F.when(single, 0).otherwise(F.col("anchor")).alias("whole"),
        F.when(single, F.pmod(F.xxhash64("anchor"), F.lit(shards))).otherwise(F.least("own", "other")).alias("i"),
        F.when(single, -1).otherwise(F.greatest("own", "other")).alias("j"))
    # one shuffle: what tasks gave more than once is dropped where the shard is put together
    shard = ["whole", "i", "j"]
    dealt = dealt.repartition(*shard).groupBy(*shard, "side", "alone", "anchor", "context").agg(F.first("windows").alias("windows"), F.first("bytes").alias("bytes"))
    some = dealt.groupBy(*shard).applyInPandas(_shard, "anchor long, context long, first long, end long")
    whole = counts.filter("n > 1").select("anchor", "context", F.lit(0).cast("long").alias("first"), F.col("windows").alias("end"))
    once = counts.filter("n = 1").select("anchor", "context")
    hits = whole.unionByName(some.join(once, ["anchor", "context"], "left_semi"))
    hits = hits.select("anchor", "context", F.col("first").alias("from"), F.col("end").alias("to"))
    found = runs.select("id", "key", "first", "anchor", "context").join(hits, ["anchor", "context"])
    return found.select("id", "key", (F.col("first") + F.col("from")).alias("first"), (F.col("first") + F.col("to") - 1 + MATCH).alias("end"))


def _affected(documents: DataFrame, id_column: str, text_column: str):
    """Rows (id, key, text) without any repeat, and those with one beside its ranges."""
    spark = documents.sparkSession
    before = flat.tables_made()
    ranges = flat.written(repeats(documents, id_column, text_column).distinct().groupBy("id", "key").agg(
        F.array_sort(F.collect_list(F.struct("first", "end"))).alias("ranges")))
    flat.delete_tables(spark, before, ranges)
    named = spark.sparkContext.broadcast(bits.of_hashes(ranges, "key", BITMAP_BITS))
    maybe = F.pandas_udf(lambda keys: pd.Series(bits.has(named.value, keys.to_numpy(np.int64).view(np.uint64), BITMAP_BITS)), "boolean")
    rows = _rows(documents, id_column, text_column).withColumn("maybe", maybe("key"))
    ranges = ranges.select(F.col("id").alias("id2"), F.col("key").alias("key2"), F.transform("ranges", lambda r: r["first"]).alias("firsts"), F.transform("ranges", lambda r: r["end"]).alias("ends"))
    hit = rows.filter("maybe").join(ranges, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left").select("id", "text", "firsts", "ends")
    return rows.filter("not maybe").select("id", "text"), hit


def merged(firsts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that ordered, overlapping or touching ranges cover."""
    if not len(firsts):
        return firsts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate([[True], firsts[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return firsts[at], reach[np.append(at[1:], len(firsts)) - 1]


def _kept(text: bytes, firsts, ends) -> tuple[bytes, int]:
    first, end = merged(np.array(firsts or [], np.int64), np.array(ends or [], np.int64))
    edges = np.concatenate([[0], np.stack([first, end], 1).ravel(), [len(text)]])
    return b"".join(text[a:b] for a, b in edges.reshape(-1, 2).tolist()), len(first)


def dedup_digests(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the digest of the bytes that stay."""
    plain, hit = _affected(documents, id_column, text_column)
    text = F.coalesce("text", F.lit(""))
    zero = F.lit(0).cast("long")
    plain = plain.select("id", F.octet_length(text).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    names = plain.columns

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, firsts, ends in zip(*(batch.column(c) for c in ("text", "firsts", "ends"))):
                text = (text.as_py() or "").encode()
                kept, spans = _kept(text, firsts.as_py(), ends.as_py())
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x) for x in zip(*out))], names=names)

    return plain.unionByName(hit.mapInArrow(run, plain.schema))


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and the text that stays."""
    plain, hit = _affected(documents, id_column, text_column)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_kept((t.as_py() or "").encode(), f.as_py(), e.as_py())[0].decode("utf-8", "ignore") if t.as_py() is not None else None
                     for t, f, e in zip(*(batch.column(c) for c in ("text", "firsts", "ends")))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return plain.unionByName(hit.mapInArrow(run, plain.schema))


@query()
def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    return dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
