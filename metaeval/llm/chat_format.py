"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records come as JSON text in any layout: messages, prompt and response,
instruction, input and output, and so on. The nested field paths of a record, with
the kinds of values left out, are hashed to a fingerprint; the fingerprint selects a
declarative mapping (``MAPPINGS``), and the mapping says where the canonical turns
are. A template joins the turns to one text, with control strings inside the texts
escaped reversibly, and gives the spans of the loss mask, in code points: the texts
of the assistant. ``parsed`` reads turns back from the text alone.

Defined results: a null text is empty, and so is a null role. Records whose
fingerprint no mapping has, null records and invalid JSON keep their row, with
null layout, turns and output. A record without turns gives an empty text.
Repeated rows are formatted each. Turns with equal numbers are put in the order of
role and text. Extra columns are kept by ``canonical`` and ``formatted``; their
output columns replace input columns of the same name.

A conversation is one record and one output row, so it has to fit a task. Texts of
any length are formatted where they come as columns (``as_records``); a JSON record
too long for Spark's parser raises, since it may be valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from metaeval.llm.registry import query

#: Strings that mean something to a chat model; inside a text they are broken up.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
HEAD, HEAD_END, TURN_END = "<|", "|>\n", "<|end|>\n"
LEARNED_ROLE = "assistant"
#: In these layouts roles have names of their own.
RENAMED = ("conversations",)
#: Spark's parser refuses strings, and records, from about this length on.
LONGEST_JSON = 20_000_000
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant"}

#: Layout: field paths in order of their names, and where the turns are: either
#: (array, role field, text field), or a list of (role, field).
MAPPINGS = {
    "messages": ("{messages:[{content,role}]}", ("messages", "role", "content")),
    "conversations": ("{conversations:[{from,value}]}", ("conversations", "from", "value")),
    "dialogue": ("{dialogue:[{speaker,text}]}", ("dialogue", "speaker", "text")),
    "prompt": ("{prompt,response}", [("user", "prompt"), ("assistant", "response")]),
    "system_prompt": ("{prompt,response,system}", [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "instruction": ("{input,instruction,output}", [("system", "instruction"), ("user", "input"), ("assistant", "output")]),
    "short_instruction": ("{instruction,output}", [("user", "instruction"), ("assistant", "output")]),
    "question": ("{answer,question}", [("user", "question"), ("assistant", "answer")]),
    "nested": ("{completion:{text},prompt:{text}}", [("user", "prompt.text"), ("assistant", "completion.text")]),
    "empty_messages": ("{messages:[]}", ("messages", "role", "content")),
}


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON text, in order of their names, without the kinds of values."""
    kinds = F.schema_of_variant(F.try_parse_json(record))
    out = F.regexp_replace(kinds, r"(: )?\b(STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|DECIMAL\(\d+,\s*\d+\))(?=[,>]|$)", "")
    out = F.regexp_replace(F.regexp_replace(out, r"OBJECT<", "{"), r"ARRAY<", "[")
    # what closes what: objects and arrays nest as they were opened
    out = F.regexp_replace(out, r"\{([^{}\[\]>]*)>", "{$1}")
    for _ in range(6):
        out = F.regexp_replace(F.regexp_replace(out, r"\[((?:[^\[\]>])*)>", "[$1]"), r"\{((?:[^>])*?)>", "{$1}")
    return F.regexp_replace(out, r"[\s`]", "")


def fingerprint(paths: Column) -> Column:
    """The hash that selects a mapping."""
    return F.xxhash64(paths)


def _turn(rename: bool, role: Column, text: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    if rename:
        role = F.coalesce(F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))[role], role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _from_fields(role: str, text: str, rename: bool):
    return lambda item: _turn(rename, item[role], item[text])


def canonical(records: DataFrame, record_column: str = "record", texts_column: str | None = None) -> DataFrame:
    """The rows with ``fingerprint``, ``layout`` and ``turns``, an array of (role, text).

    With ``texts_column``, an array, the texts in the record are places in it: so texts of any
    length stay out of the JSON. Valid records may be refused by the parser from ``LONGEST_JSON``
    characters on; such a record raises.
    """
    value = F.try_parse_json(record_column)
    rows = records.withColumn("fingerprint", fingerprint(field_paths(F.col(record_column))))
    layout = turns = None
    for name, (paths, where) in MAPPINGS.items():
        is_it = F.col("fingerprint") == fingerprint(F.lit(paths))
        if isinstance(where, tuple):
            array, role, text = where
            items = F.try_variant_get(value, f"$.{array}", f"array<struct<{role}:string,{text}:string>>".replace("from:", "`from`:"))
            found = F.transform(items, _from_fields(role, text, name in RENAMED))
        else:
            found = F.array(*(_turn(False, F.lit(role), F.try_variant_get(value, f"$.{field}", "string")) for role, field in where))
        if texts_column is not None:
            found = F.transform(found, lambda t: F.struct(t["role"], F.coalesce(F.get(texts_column, t["text"].cast("int")), F.lit("")).alias("text")))
        layout = F.when(is_it, name) if layout is None else layout.when(is_it, name)
        turns = F.when(is_it, found) if turns is None else turns.when(is_it, found)
    refused = value.isNull() & (F.length(record_column) >= LONGEST_JSON)
    layout = F.when(refused, F.raise_error(F.concat(F.lit("a record of so many characters cannot be parsed: "), F.length(record_column).cast("string")))).otherwise(layout)
    return rows.withColumn("layout", layout).withColumn("turns", turns)


def escaped(text: Column) -> Column:
    """No control string is left. Every backslash is followed by 0 (it was one) or 1 (a mark)."""
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\1" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\1"), F.lit("")), F.lit("\\0"), F.lit("\\"))


def formatted(rows: DataFrame, turns_column: str = "turns") -> DataFrame:
    """The rows with ``formatted`` and ``loss_spans``, an array of (start, end) in code points."""
    safe = F.transform(turns_column, lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == LEARNED_ROLE).alias("learned")))
    rows = rows.withColumn("_safe_turns", safe)
    text = F.array_join(F.transform("_safe_turns", lambda t: F.concat(F.lit(HEAD), t["role"], F.lit(HEAD_END), t["text"], F.lit(TURN_END))), "")

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + len(HEAD) + len(HEAD_END)
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(TURN_END)).cast("long").alias("at"), F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    spans = F.aggregate("_safe_turns", begin, step, lambda state: state["spans"])
    return rows.withColumn("formatted", text).withColumn("loss_spans", spans).drop("_safe_turns")


def parsed(text: Column) -> Column:
    """The turns of a formatted text."""
    pieces = F.split(text, F.lit(r"\Q" + TURN_END + r"\E"))

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, HEAD_END, 1)
        return F.struct(unescaped(F.substr(head, F.lit(len(HEAD) + 1))).alias("role"),
                        unescaped(F.substr(piece, F.length(head) + len(HEAD_END) + 1)).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order, unescaped."""
    return F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))


def as_records(conversations: DataFrame) -> DataFrame:
    """One JSON record per conversation, in the layout that its roles suggest, with places for texts, and its ``texts``.

    User and assistant become prompt and response, system, user and assistant an
    instruction with input and output; all others are message lists of either kind.
    """
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    # the record has a text's place, the texts stay beside it
    roles, text = F.array_join(F.transform("turns", lambda t: t["role"]), "\n"), lambda i: F.lit(str(i))
    messages = lambda role, content: F.transform("turns", lambda t, i: F.struct(t["role"].alias(role), i.cast("string").alias(content)))
    record = (
        F.when(roles == "user\nassistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(roles == "system\nuser\nassistant", F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(messages("role", "content").alias("messages"))))
        .otherwise(F.to_json(F.struct(messages("speaker", "text").alias("dialogue")))))
    return turns.select("conv_id", record.alias("record"), F.transform("turns", lambda t: t["text"]).alias("texts"))


def digests(rows: DataFrame) -> DataFrame:
    """What the formatted texts say when read back."""
    turns = F.transform(parsed(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    rows = rows.select("conv_id", "formatted", "layout", turns.alias("turns"), F.array_join(masked(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_SQL_ESCAPED = "{0}"
for _text, _safe in [("\\", "\\0"), *((c, c[0] + "\\1" + c[1:]) for c in CONTROL)]:
    _SQL_ESCAPED = f"replace({_SQL_ESCAPED}, '{_text}', '{_safe}')"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_SQL_ESCAPED.format("role")}) + length({_SQL_ESCAPED.format("text")}) + {len(HEAD + HEAD_END + TURN_END)}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query(SQL)
def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """Format all conversations and read them back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(same).alias("text"))
    return digests(formatted(canonical(as_records(rows.unionByName(probe)), texts_column="texts")))
