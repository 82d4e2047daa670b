"""A whitespace vocabulary and id encoding of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metaeval.functions.arrays import ones_mask, prompt_labels
from metaeval.functions.text import assistant_tail
from metaeval.operators.lookup import join_by_weight, within_limits
from metaeval.operators.ordering import with_positions
from metaeval.session import cut

# The reserved ids.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
FIRST_ID = 4

WHITESPACE = r"[ \t\n\x0B\f\r]+"
# The frequent tokens that a task's code holds: cells of the table, and bytes of text.
DICTIONARY_ENTRIES = 32_768
DICTIONARY_BYTES = 512 << 10


def tokens_of(text: Column) -> Column:
    """The whitespace-separated tokens; none for a missing text."""
    parts = F.split(F.coalesce(text, F.lit("")), WHITESPACE, -1)
    return F.filter(parts, lambda t: t != "")


def build_vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """Tokens with their counts; ids follow falling count, then the token."""
    counts = (
        texts.select(F.explode(tokens_of(F.col(column))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    placed = with_positions(counts, (), [F.col("n").desc(), F.col("token").asc()], "_pos")
    return placed.select("token", "n", (F.col("_pos") + FIRST_ID).alias("id"))


def dictionary(vocabulary: DataFrame, entries: int, text_bytes: int) -> tuple[list[str], list[int]]:
    """The most frequent tokens and their ids in a table of ``entries`` cells, at the cell their hash names.

    Of tokens that meet in a cell the most frequent has it. Together they have at most
    ``text_bytes`` bytes, so the table fits into every task's code.
    """
    cell = F.pmod(F.xxhash64("token"), F.lit(entries)).cast("int").alias("cell")
    top = vocabulary.orderBy("id").limit(entries // 2).select("token", "id", cell).collect()
    tokens, ids, size = [""] * entries, [UNK_ID] * entries, 0
    for row in sorted(top, key=lambda r: r["id"]):
        size += len(row["token"].encode())
        if size > text_bytes:
            break
        if not tokens[row["cell"]]:
            tokens[row["cell"]], ids[row["cell"]] = row["token"], row["id"]
    return tokens, ids


def encode(rows: DataFrame, key, segments: dict, vocabulary: DataFrame,
           max_rows: int | None = None, entries: int = DICTIONARY_ENTRIES, text_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """Id arrays of the text ``segments`` of every row, one row per ``key``.

    ``key`` is a column or a list of them; rows that share a key raise.

    ``segments`` maps output columns to text Columns. The first one begins with
    the beginning-of-sequence id; tokens the vocabulary lacks get the unknown id.

    The texts are split once. The most frequent tokens of the vocabulary get their ids
    where the row stands, from a table of bounded size in the task's code; only
    the others leave the row, are given their ids and come back by the key. They are
    joined by weight where the vocabulary is too large to be broadcast.
    """
    key = [key] if isinstance(key, str) else list(key)
    tokens, ids = dictionary(vocabulary, entries, text_bytes)
    # both fold into constants; no token holds white space
    cells = F.split(F.lit("\n".join(tokens)), "\n", -1)
    numbers = F.split(F.lit("\n".join(map(str, ids))), "\n", -1).cast("array<int>")

    def known(token: Column) -> Column:
        cell = F.pmod(F.xxhash64(token), F.lit(entries)).cast("int")
        return F.when(F.get(cells, cell) == token, F.get(numbers, cell))

    # texts are smaller than their ids with places: they are shuffled by the key, and nothing is afterwards
    texts = rows.select(*key, *[text.alias(f"_t{i}") for i, text in enumerate(segments.values())]).repartition(*key)
    split = texts.select(*key, *[tokens_of(F.col(f"_t{i}")).alias(f"_t{i}") for i in range(len(segments))])
    found = split.select("*", *[F.transform(f"_t{i}", known).alias(f"_i{i}") for i in range(len(segments))])

    def others(i: int) -> Column:
        placed = F.transform(F.col(f"_t{i}"), lambda t, at: F.struct(F.lit(i).alias("seg"), at.alias("at"), t.alias("token"), F.get(f"_i{i}", at).isNull().alias("rest")))
        return F.transform(F.filter(placed, lambda x: x["rest"]), lambda x: x.dropFields("rest"))

    own = F.struct(*[F.col(f"_i{i}") for i in range(len(segments))])
    none = F.lit(None).cast("struct<seg:int,at:int,token:string>")
    kind = f"struct<{', '.join(f'_i{i}: array<int>' for i in range(len(segments)))}>"
    # a row itself comes first, then a row for each of its other tokens
    parts = F.concat(F.array(F.struct(own.alias("own"), none.alias("other"))),
                     *[F.transform(others(i), lambda x: F.struct(F.lit(None).cast(kind).alias("own"), x.alias("other"))) for i in range(len(segments))])
    pieces = found.select(*key, F.explode(parts).alias("_p")).select(*key, "_p.own", F.col("_p.other.seg").alias("seg"), F.col("_p.other.at").alias("at"), F.col("_p.other.token").alias("token"))
    words = vocabulary.select("token", "id")
    if within_limits(words, max_rows):
        numbered = pieces.join(F.broadcast(words), "token", "left")
    else:
        pieces = cut(pieces)
        rest = pieces.filter(F.col("token").isNotNull())
        weights = cut(rest.groupBy("token").agg(F.count(F.lit(1)).alias("_weight")).join(words, "token", "left"))
        total = weights.agg(F.coalesce(F.sum("_weight"), F.lit(0))).first()[0]
        rest = join_by_weight(rest, weights, ["token"], "_weight", total, spread=[*key, "seg", "at"]).drop("_weight")
        numbered = pieces.filter(F.col("token").isNull()).withColumn("id", F.lit(None).cast("bigint")).unionByName(rest)
    placed = F.struct("seg", "at", F.coalesce("id", F.lit(UNK_ID)).cast("int").alias("id"))
    grouped = numbered.groupBy(*key).agg(
        F.collect_list("own").alias("_own"), F.collect_list(F.when(F.col("seg").isNotNull(), placed)).alias("_rest"))
    failure = F.raise_error(F.concat(F.lit("rows share the key "), F.to_json(F.struct(*key)))).cast("array<int>")

    def segment(index: int) -> Column:
        mine = F.col("_own")[0][f"_i{index}"]
        rest = F.transform(F.filter("_rest", lambda x: x["seg"] == index), lambda x: F.struct(x["at"].alias("at"), x["id"].alias("id")))
        there = F.filter(F.transform(mine, lambda x, at: F.struct(at.alias("at"), x.alias("id"))), lambda x: x["id"].isNotNull())
        merged = F.transform(F.sort_array(F.concat(there, rest)), lambda x: x["id"])
        ids = F.when(F.size(rest) == 0, mine).otherwise(merged)
        ids = ids if index else F.concat(F.array(F.lit(BOS_ID)), ids)
        return F.when(F.size("_own") == 1, ids).otherwise(failure)

    return grouped.select(*key, *[segment(i).alias(name) for i, name in enumerate(segments)])


def constant_ids(vocabulary: DataFrame, text: str) -> list[int]:
    """The ids of one fixed text, looked up on the driver."""
    tokens = text.split()
    found = vocabulary.filter(F.col("token").isin(tokens)).select("token", "id").collect()
    ids = {row["token"]: row["id"] for row in found}
    return [ids.get(t, UNK_ID) for t in tokens]


def assemble(rows: DataFrame, vocabulary: DataFrame, prefix: str, suffix: str | None,
             response: str | None, chatml: bool = False, label_all: bool = False) -> DataFrame:
    """The six encoded columns from id columns.

    The suffix side holds the row's suffix and the answer opening, and in
    training (``response`` given) the response with its end. Prompt ids are not
    labelled unless ``label_all``; response ids always are.
    """
    tail = F.array(*[F.lit(i) for i in constant_ids(vocabulary, assistant_tail(chatml))]).cast(
        "array<int>")
    prompt = tail if suffix is None else F.concat(F.col(suffix), tail)
    ids, labels = prompt, prompt_labels(prompt, label_all)
    if response is not None:
        answer = F.concat(F.col(response), F.array(F.lit(EOS_ID)))
        ids, labels = F.concat(prompt, answer), F.concat(labels, answer)
    first = F.col(prefix)
    return rows.withColumns({
        "input_ids": first,
        "attention_mask": ones_mask(first),
        "labels": prompt_labels(first, label_all),
        "suffix_input_ids": ids,
        "suffix_attention_mask": ones_mask(ids),
        "suffix_labels": labels,
    })


def full_sequence(rows: DataFrame, speech_length: Column) -> DataFrame:
    """Mask and labels over prefix, speech and suffix; speech carries no labels."""
    speech = speech_length.cast("int")
    return rows.withColumns({
        "sequence_mask": F.concat("attention_mask", F.array_repeat(F.lit(1), speech),
                                  "suffix_attention_mask"),
        "sequence_labels": F.concat("labels", F.array_repeat(F.lit(-100), speech),
                                    "suffix_labels"),
    })
