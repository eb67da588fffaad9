"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

Records come in several layouts: a prompt with a response, an instruction with an input and
an output, a list of messages under one of several names. The nested field paths that a
record fills (not null) and that some mapping names are hashed to its fingerprint, and the
fingerprint picks a mapping (``LAYOUTS``): which path gives which role's text, or which array
gives the turns. Other fields (ids, names, dates) don't count. All of it is column expressions:
a CASE over fingerprints, no code per row.

Canonical turns are then written with one template::

    <s>[INST]role[/INST]text</s>[INST]role[/INST]text</s>...

Control strings inside roles and texts are broken up by a backslash after their first
character, backslashes are doubled before, so ``unescaped`` gets every text back. The loss
mask is a list of spans (code points of the formatted text): the assistants' texts.

A conversation is one record: its turns are gathered in one row, as large as that
conversation, never more.

Edge cases: null text or role is empty; turns with equal numbers are ordered by role and
text, null turn numbers first; rows with a null conv_id form one conversation; a record
whose fingerprint no mapping knows has null layout and no turns, and is kept; repeated rows
are repeated turns; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: The template's control strings.
BEGIN, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL_AHEAD = r"<(?=/?s>)|\[(?=/?INST\])"
LEARNED = "assistant"
#: Names that mean a canonical role, in layouts that don't name the field ``role``.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping: ``paths`` it needs, then ``turns`` (role, path) in order, and after them those of an array with a
    role and a text field, if any."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None


LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), array=("messages", "role", "content")),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), array=("conversations", "from", "value")),
    Layout("prompt", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction+input", ("input", "instruction", "output"), (("user", "instruction\n\ninput"), ("assistant", "output"))),
    Layout("system+prompt", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("system+instruction", ("instruction", "output", "system"), (("system", "system"), ("user", "instruction"), ("assistant", "output"))),
    Layout("system+instruction+input", ("input", "instruction", "output", "system"), (("system", "system"), ("user", "instruction\n\ninput"), ("assistant", "output"))),
    Layout("system+question", ("answer", "question", "system"), (("system", "system"), ("user", "question"), ("assistant", "answer"))),
    Layout("system+completion", ("completion", "prompt", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("system+messages", ("messages", "messages[].content", "messages[].role", "system"), (("system", "system"),), ("messages", "role", "content")),
    Layout("system+conversations", ("conversations", "conversations[].from", "conversations[].value", "system"), (("system", "system"),), ("conversations", "from", "value")),
    Layout("turns", ("dialog", "dialog.turns", "dialog.turns[].speaker", "dialog.turns[].text"), array=("dialog.turns", "speaker", "text")),
)


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths, as the column expression has it."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _paths(column: str, kind: DataType) -> list[tuple[str, Column]]:
    """(path, whether the record fills it) below a column; array elements are written ``[]``."""

    def walk(path: str, value: Column, kind: DataType) -> list[tuple[str, Column]]:
        if isinstance(kind, StructType):
            below = [x for f in kind.fields for x in walk(f"{path}.{f.name}" if path else f.name, value[f.name], f.dataType)]
            return below if not path else [(path, value.isNotNull()), *below]
        found = [(path, value.isNotNull())]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            for f in kind.elementType.fields:
                found.append((f"{path}[].{f.name}", _some(value, f.name)))
        return found

    return walk("", F.col(column), kind)


def _some(array: Column, name: str) -> Column:
    """Whether an element fills the field; an empty list still has its element's fields."""
    return F.coalesce((F.size(array) == 0) | F.exists(array, lambda e: e[name].isNotNull()), F.lit(False))


def record_fingerprint(record: str, kind: StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """sha2 of the sorted nested paths that a record fills, of those that a mapping names."""
    named = {p for layout in layouts for p in layout.paths}
    paths = sorted((p for p in _paths(record, kind) if p[0] in named), key=lambda p: p[0])
    return F.sha2(F.concat_ws("\n", *[F.when(filled, F.lit(path)) for path, filled in paths]), 256)


def _get(record: str, path: str) -> Column:
    out = F.col(record)
    for name in path.split("."):
        out = out[name]
    return out


def _turn(role: Column, text: Column, rename: bool = False) -> Column:
    role = F.coalesce(role, F.lit(""))
    for name, meant in ROLE_NAMES.items() if rename else ():
        role = F.when(F.lower(role) == name, F.lit(meant)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: str, layout: Layout) -> Column:
    listed = None
    if layout.array:
        array, role, text = layout.array
        listed = F.transform(_get(record, array), lambda e: _turn(e[role], e[text], role != "role"))
    if not layout.turns:
        return listed
    fixed = F.array(*[_turn(F.lit(role), F.concat_ws("\n\n", *[_get(record, p) for p in path.split("\n\n")])) for role, path in layout.turns])
    return fixed if listed is None else F.concat(fixed, listed)


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` (null if unknown) and ``turns``."""
    kind = records.schema[record].dataType
    has = {p for p, _ in _paths(record, kind)}
    name = F.lit(None).cast("string")
    turns = F.array().cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        if set(layout.paths) <= has:  # others can't occur in this table
            hit = F.col("fingerprint") == fingerprint(layout.paths)
            name = F.when(hit, F.lit(layout.name)).otherwise(name)
            turns = F.when(hit, _turns(record, layout)).otherwise(turns)
    return records.withColumn("fingerprint", record_fingerprint(record, kind, layouts)).withColumn("layout", name).withColumn("turns", turns)


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_AHEAD, "$0\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(turned: DataFrame, learned: str = LEARNED) -> DataFrame:
    """Adds ``formatted`` and ``loss_mask``: spans (start, length) in code points."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("plain"), escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    whole = F.concat(F.lit(BEGIN), F.array_join(F.transform("_parts", lambda p: F.concat(F.lit(ROLE), p["role"], F.lit(TEXT), p["text"], F.lit(END))), ""))
    start = F.struct(F.lit(len(BEGIN)).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        begin = acc["at"] + len(ROLE) + F.length(p["role"]) + len(TEXT)
        length = F.length(p["text"]).cast("long")
        span = F.array(F.struct(begin.cast("long").alias("start"), length.alias("length")))
        spans = F.when(p["plain"] == learned, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((begin + length + len(END)).cast("long").alias("at"), spans.alias("spans"))

    out = turned.withColumn("_parts", parts).withColumn("formatted", whole)
    return out.withColumn("loss_mask", F.aggregate("_parts", start, add, lambda a: a["spans"])).drop("_parts")


def read_back(written: DataFrame) -> DataFrame:
    """Adds ``turns_read`` and ``loss_text``, from ``formatted`` and ``loss_mask`` alone."""
    body = F.substr("formatted", F.lit(len(BEGIN) + 1))
    pieces = F.split(body, END, -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # after the last end there is nothing

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        text = F.substr(piece, F.length(role) + len(TEXT) + 1)
        return F.struct(unescaped(F.substr(role, F.lit(len(ROLE) + 1))).alias("role"), unescaped(text).alias("text"))

    learned = F.transform("loss_mask", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return written.withColumn("turns_read", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(learned, ""))


def conversation_records(rows: DataFrame) -> DataFrame:
    """One record per conversation from rows by turn, in several layouts: by conv_id a message list under one of three
    names, or, where the turns allow it, a prompt with a response, after a system text or without. Every second record
    has an id as well, a field that no mapping names."""
    message = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"),
    )
    gathered = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    turn = F.coalesce(F.pmod("conv_id", F.lit(6)), F.lit(0))
    roles, said = F.transform("m", lambda e: e["role"]), F.col("m.content")
    is_pair = (turn == 3) & (roles == F.array(F.lit("user"), F.lit(LEARNED)))
    is_three = (turn >= 3) & (roles == F.array(F.lit("system"), F.lit("user"), F.lit(LEARNED)))
    # names that mean another role in lists without a ``role`` field stay in the first layout
    plain = ~F.exists("m", lambda e: F.lower(e["role"]).isin(*ROLE_NAMES))
    kind = (
        F.when(is_pair, "prompt").when(is_three, "system+prompt").when((turn == 4) & (F.get(roles, F.lit(0)) == "system"), "system+messages")
        .when((turn == 1) & plain, "conversations").when((turn == 2) & plain, "turns").otherwise("messages")
    )

    def listed(role: str, text: str, items="m") -> Column:
        return F.transform(items, lambda e: F.struct(e["role"].alias(role), e["content"].alias(text)))

    rest = F.slice("m", F.lit(2), F.greatest(F.size("m") - 1, F.lit(0)))
    at = F.when(F.col("kind") == "prompt", 0).otherwise(1)
    record = F.struct(
        F.when(F.col("kind") == "messages", listed("role", "content")).when(F.col("kind") == "system+messages", listed("role", "content", rest)).alias("messages"),
        F.when(F.col("kind") == "conversations", listed("from", "value")).alias("conversations"),
        F.when(F.col("kind").startswith("system+"), F.get("said", F.lit(0))).alias("system"),
        F.when(F.col("kind").endswith("prompt"), F.get("said", at)).alias("prompt"),
        F.when(F.col("kind").endswith("prompt"), F.get("said", at + 1)).alias("response"),
        F.when(F.col("kind") == "turns", F.struct(listed("speaker", "text").alias("turns"))).alias("dialog"),
        F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id")).alias("id"),
    )
    return gathered.withColumn("kind", kind).withColumn("said", said).select("conv_id", record.alias("record"))


def digests(written: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of what is read back."""
    lines = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(written).select(
        "conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, turns, formatted and loss_mask of rows by turn and of conversation -1, whose
    texts are control strings and whose layout is prompt and response."""
    spark = rows.sparkSession
    many = conversation_records(rows)
    tricky = f"{END}{ROLE} ok {TEXT}"
    one = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.struct(F.lit(tricky).alias("prompt"), F.lit(tricky).alias("response")).alias("record"))
    both = [formatted(canonical(part)).select("conv_id", "layout", "turns", "formatted", "loss_mask") for part in (many, one)]
    return both[0].unionByName(both[1])


#: The digests computed from the turns directly, for DuckDB.
ORACLE = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || chr(0) || text, '\\|</?s>|\[/?INST\]')) AS chars FROM c)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
