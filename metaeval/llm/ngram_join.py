"""N-gram Jaccard join with several global orders of the tokens.

A document's set holds its distinct five-word shingles. Two sets with a Jaccard
similarity of 0.75 or more share a token among the first ``n - ceil(0.75 n) + 1``
of each, under any order of all tokens. So candidates have to share such a prefix
token under every one of three orders, and to agree in the number of tokens per
hash class closely enough; only what passes all filters is verified on the whole
sets.

* Every order puts tokens of few documents first. How frequent a token is comes
  from counts over all documents, kept as bitmaps of a fixed size for three
  thresholds; they only order tokens, so coarse counts cost time, never links.
  Within a class of frequency each order has its own hash.
* The first order finds the candidates: prefix tokens are shuffled and sorted, and
  tokens that several sets share are kept. Equal sets travel once.
* Among the sets that share a token, all are held against a leader, the set with
  the fewest rare tokens; links give components. Then only sets of different components that share a
  token are held against each other. No pair inside a component is made, so a
  group of near copies costs its size, and no link between components is missed.

Sets, tokens and texts are known by 64-bit hashes.

Defined results: null and empty texts have no shingles and are their own
component; texts of one to four words are one shingle. Repeated rows are
components together, except without shingles. A null id is kept; a component
without any id has none. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from metaeval.llm import bits, flat
from metaeval.llm.cells import frequent_slots
from metaeval.llm.components import components
from metaeval.llm.registry import query

WORDS = 5
#: Similarity of at least 3 / 4: 4 * common >= 3 * union, or 7 * common >= 3 * (a + b).
FREQUENT = (8, 64, 1024)
BITMAP_BITS = 25
CLASSES = 64
ORDERS = (np.uint64(0x1F3D5B79), np.uint64(0x2545F4914F6CDD1D))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a piece."""
    data = flat.LOWER[data]
    starts, ends, row = flat.runs(data, offsets, flat.NOT_SPACE)
    words = flat.span_hashes(flat.prefix_sums(data), starts, ends)
    shingles, _ = flat.grams(words, row, WORDS)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    short = {n: flat.grams(words, row, n)[0] for n in range(1, WORDS)} if (np.diff(bounds) < WORDS).any() else {}
    sets = []
    for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = end - first
        if n >= WORDS:
            sets.append(np.unique(shingles[first:end - WORDS + 1]))
        else:
            sets.append(flat.mixed(short[n][first:first + 1] + np.uint64(n)) if n else np.zeros(0, np.uint64))
    return sets


def signature(tokens: np.ndarray) -> int:
    """A number that equal sets share."""
    total = int(flat.mixed(tokens + np.uint64(0x51ED270B)).sum(dtype=np.uint64)) + 0x632BE59BD9B4E019 * len(tokens)
    return int(flat.mixed(np.array([total & (1 << 64) - 1], np.uint64)).view(np.int64)[0])


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


def _over_sets(rows: DataFrame, schema: T.StructType, handle: Callable) -> DataFrame:
    """``handle(state, ids, sets)`` yields record batches; ``state`` is a dict of the task, ``ids`` is None at the end."""
    flat.small_batches(rows.sparkSession)

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for first, end, data, offsets in flat.pieces(batch.column("text")):
                yield from handle(state, batch.column("id").slice(first, end - first), shingle_sets(data, offsets))
        yield from handle(state, None, [])

    return rows.mapInArrow(run, schema)


def frequency(tokens: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    return sum(bits.has(m, tokens, BITMAP_BITS).astype(np.int64) for m in maps)


def prefix(tokens: np.ndarray, frequent: np.ndarray, order: np.uint64 | None) -> np.ndarray:
    """The first tokens of a set under an order: rare ones first, then by hash."""
    key = tokens if order is None else flat.mixed(tokens ^ order)
    return tokens[np.lexsort((key, frequent))[:prefix_size(len(tokens))]]


def _sets_with_prefix(rows: DataFrame, maps) -> DataFrame:
    """id, n_shingles, signature, number of rare tokens and the prefix tokens; a task gives those of equal sets once."""
    schema = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("rare", T.LongType()),
                           T.StructField("prefix", T.ArrayType(T.LongType()))])

    def handle(state: dict, ids, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sets:
            return
        seen = state.setdefault("seen", set())
        sigs, heads, rare, known = [signature(s) for s in sets], [], [], np.concatenate(sets)
        frequent, first = frequency(known, maps.value), 0
        for sig, tokens in zip(sigs, sets):
            heads.append(np.zeros(0, np.uint64) if sig in seen else prefix(tokens, frequent[first:first + len(tokens)], None))
            rare.append(int((frequent[first:first + len(tokens)] == 0).sum()))
            seen.add(sig)
            first += len(tokens)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(np.array(sigs, np.int64)), pa.array(rare, pa.int64()),
             flat.lists(flat.signed(np.concatenate(heads)), np.array([len(h) for h in heads]))], names=schema.names)

    return _over_sets(rows, schema, handle)


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """token, set, its size, the token's place in it, and the token's leader; tokens of one set are left out.

    The leader is the set with the fewest rare tokens: of a text and its edited
    copies that is the text, to which most copies are closer than to each other.
    """
    posts = sets.select("sig", "n", "rare", F.posexplode("prefix").alias("pos", "token")).repartition("token").sortWithinPartitions("token", "rare", "sig")
    names = ["token", "sig", "n", "pos"]
    schema = "token long, sig long, n long, pos int, leader long, leader_n long, leader_pos int"
    out_names = [c.split()[0] for c in schema.split(", ")]

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = leader = None  # the last row, not yet known to be shared; the first row of its token
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            token, sig = rows[0], rows[1]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
            rows = [x[new] for x in rows]
            token = rows[0]
            starts = np.ones(len(token), bool)
            starts[1:] = token[1:] != token[:-1]
            group = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            lead = [x[first] for x in rows]
            continued = leader is not None and leader[0][0] == token[0]
            if continued:
                for x, y in zip(lead, leader):
                    x[0] = y[0]
            size = np.bincount(group)
            shared = (size > 1)[group]
            if continued and leader[1][0] != rows[1][0]:
                shared[group == 0] = True
            # the last row waits: it may be alone so far, and its double may follow
            shared[-1] = False
            held, leader = [x[-1:] for x in rows], [x[-1:] for x in lead]
            yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (*rows, *(y[group] for y in lead[1:]))], names=out_names)
        if held is not None and leader[1][0] != held[1][0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*held, *leader[1:])], names=out_names)

    return posts.mapInArrow(run, schema)


def _may_link(n, m, i, j):
    """Sizes and places of the first common token leave room for enough common tokens."""
    need = (3 * (n + m) + 6) / 7
    return F.least(n - i, m - j) >= F.floor(need) if not isinstance(n, np.ndarray) else np.minimum(n - i, m - j) >= (3 * (n + m) + 6) // 7


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def _across(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of sets that share a token and have different labels."""
    known = labels.select(F.col("node").alias("sig"), "component")
    rows = shared.join(known, "sig", "left").select("token", F.coalesce("component", "sig").alias("label"), "sig", "n", "pos")
    mixed = rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("token")
    rows = rows.join(mixed, "token").repartition("token").sortWithinPartitions("token", "label", "sig")

    def group_pairs(label, sig, n, pos):
        # n in order within a label does not matter: every member meets the members of later labels
        first = np.searchsorted(label, label, side="right")
        for k in range(len(sig)):
            rest = slice(first[k], None)
            ok = _may_link(np.full(len(sig) - first[k], n[k]), n[rest], pos[k], pos[rest])
            if ok.any():
                yield np.full(int(ok.sum()), sig[k]), sig[rest][ok]

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, out, size = None, set(), [], 0
        names = ["token", "label", "sig", "n", "pos"]

        def finish(rows, last):
            nonlocal size
            token = rows[0]
            at = np.flatnonzero(np.diff(token, prepend=token[0] - 1)) if len(token) else np.zeros(0, int)
            ends = [*at[1:].tolist(), len(token)]
            done = len(at) if last else len(at) - 1
            for first, end in zip(at[:done].tolist(), ends[:done]):
                for a, b in group_pairs(*(x[first:end] for x in rows[1:])):
                    out.append((a, b))
                    size += len(a)
                    if size > 200_000:
                        yield emit()
            left = at[done] if done < len(at) else len(token)
            yield [x[left:] for x in rows]

        def emit():
            nonlocal size
            a, b = (np.concatenate(x) for x in zip(*out))
            out.clear()
            size = 0
            keep = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(keep[0]), pa.array(keep[1])], names=["a", "b"])

        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            for x in finish(rows, False):
                if isinstance(x, list):
                    held = x
                else:
                    yield x
        if held is not None:
            for x in finish(held, True):
                if not isinstance(x, list):
                    yield x
        if out:
            yield emit()

    return _pairs(rows.mapInArrow(run, "a long, b long"))


def _candidate_sets(rows: DataFrame, pairs: DataFrame, maps) -> DataFrame:
    """The whole sets named in pairs, with what the filters need: one row per set."""
    spark = rows.sparkSession
    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    wanted = spark.sparkContext.broadcast(bits.of_hashes(named, "sig", BITMAP_BITS))
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("tokens", T.BinaryType()), T.StructField("filters", T.BinaryType())])

    def handle(state: dict, ids, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        seen, out = state.setdefault("seen", set()), []
        for tokens in sets:
            sig = signature(tokens)
            if sig in seen or not len(tokens) or not bits.has(wanted.value, np.array([sig], np.int64).view(np.uint64), BITMAP_BITS)[0]:
                continue
            seen.add(sig)
            frequent = frequency(tokens, maps.value)
            heads = [np.unique((prefix(tokens, frequent, order) & np.uint64(0xFFFF)).astype("<u2")) for order in ORDERS]
            counts = np.bincount((tokens >> np.uint64(40) & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES).astype("<u4")
            sizes = np.array([len(tokens), len(heads[0])], "<u4")
            out.append((sig, tokens.astype("<u8").tobytes(), b"".join(x.tobytes() for x in (sizes, counts, *heads))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=schema.names)

    found = _over_sets(rows, schema, handle).join(named, "sig", "left_semi")
    return flat.written(found.groupBy("sig").agg(F.first("tokens").alias("tokens"), F.first("filters").alias("filters")))


def _passes(x: bytes, y: bytes) -> bool:
    """Whether two sets share prefix tokens under the further orders and may have enough in common."""
    parts = []
    for blob in (x, y):
        n, head = np.frombuffer(blob, "<u4", 2)
        at = 8 + 4 * CLASSES
        parts.append((int(n), np.frombuffer(blob, "<u4", CLASSES, 8).astype(np.int64), np.frombuffer(blob, "<u2", head, at), np.frombuffer(blob, "<u2", -1, at + 2 * int(head))))
    (n, counts, *heads), (m, other_counts, *other_heads) = parts
    if 7 * int(np.minimum(counts, other_counts).sum()) < 3 * (n + m):
        return False
    return all(len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(heads, other_heads))


def _similar(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    return 7 * len(np.intersect1d(a, b, assume_unique=True)) >= 3 * (len(a) + len(b))


def _tested(pairs: DataFrame, sets: DataFrame, column: str, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    left = sets.select(F.col("sig").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col(column).alias("y"))

    @flat.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [test(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _links(rows: DataFrame, pairs: DataFrame, maps) -> DataFrame:
    sets = _candidate_sets(rows, pairs, maps)
    passed = flat.written(_tested(pairs, sets, "filters", _passes))
    return flat.written(_tested(passed, sets, "tokens", _similar))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every document (id, n, sig), and the component of each set that has a link to a different one (node, component)."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    maps = spark.sparkContext.broadcast(frequent_slots(rows, shingle_sets, FREQUENT, BITMAP_BITS, rising=True))
    sets = flat.written(_sets_with_prefix(rows, maps))
    shared = flat.written(_shared_tokens(sets))
    led = shared.filter("sig != leader").filter(_may_link(F.col("n"), F.col("leader_n"), F.col("pos"), F.col("leader_pos")))
    first = flat.written(_pairs(led.select(F.col("sig").alias("a"), F.col("leader").alias("b"))))
    links = _links(rows, first, maps)
    second = flat.written(_across(shared, components(links)).join(first, ["a", "b"], "left_anti"))
    if not second.isEmpty():
        links = links.unionByName(_links(rows, second, maps))
    return sets.select("id", "n", "sig"), components(links)


def with_component(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """id, n and component_id, the least id of the component."""
    named = sets.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("id", "n", F.coalesce("component", "sig").alias("component"))
    least = named.filter("n > 0").groupBy("component").agg(F.min("id").alias("least"))
    linked = named.filter("n > 0").join(least, "component").select("id", "n", F.col("least").alias("component_id"))
    return linked.unionByName(named.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))


@query()
def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    sets, labels = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return with_component(sets, labels).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
