"""Chat formatting: records of any known layout become canonical turns, turns become training text.

A record's layout is told by its fingerprint, the hash of the nested field paths that hold a value; a table
of declared layouts, each with its required and optional paths, says for every fingerprint how its fields become
turns of (role, text). The template marks each turn, and what would read as one of its control strings inside a text
is escaped, so that the text can be read back exactly. The loss mask lists the spans of the
assistant's texts in the formatted text, in code points. All of it is DataFrame functions.

A record of no declared layout keeps its fingerprint and has null turns and formatted text. Null texts and roles
count as empty. An empty message list, or a missing optional field, gives no turn. Turns of equal number are
ordered by role, then text; a number that is null or no number comes first; repeated rows are turns of their own; rows without
conv_id make one conversation without id. An empty table gives an empty result. Columns of other names are
ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: What is escaped, in order; the sign of the escapes comes first.
ESCAPES = (
    ("%", "%25"), ("<|", "%3C|"), ("[INST]", "%5BINST]"), ("[/INST]", "%5B/INST]"), ("<s>", "%3Cs>"), ("</s>", "%3C/s>"),
)
UNESCAPES = (("%3C", "<"), ("%5B", "["), ("%0A", "\n"), ("%25", "%"))
TRAINED = "assistant"


@dataclass(frozen=True)
class Layout:
    """Paths of a layout, and its turns: (role, fields joined by a blank line), or (list, role field, text field)
    with the canonical names of its roles."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    messages: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> list[str]:
        """One for the required paths with every choice of the optional ones."""
        return [
            fingerprint_of((*self.required, *some))
            for k in range(len(self.optional) + 1)
            for some in combinations(self.optional, k)
        ]


#: Roles under other names, in the layout that uses these names; other layouts keep their roles as given.
ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("prompt", ("prompt", "response"), ("system",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout(
        "instruction", ("instruction", "output"), ("input", "system"),
        (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout("exchange", ("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), roles=ROLES),
)


def fingerprint_of(paths) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def _holds(name: str):
    return lambda element: element[name].isNotNull()


def _paths(kind: T.DataType, value: Column, path: str) -> list[tuple[str, Column]]:
    """Every leaf path below a value, and whether it holds anything."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for x in _paths(f.dataType, value[f.name], f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [(f"{path}[].{name}", F.exists(value, _holds(name))) for name in kind.elementType.names]
    return [(path, value.isNotNull())]


def fingerprint(records: DataFrame, record: str = "record") -> Column:
    """Hash of the paths of a struct column that hold a value, row by row."""
    found = sorted(_paths(records.schema[record].dataType, F.col(record), ""), key=lambda x: x[0])
    return F.md5(F.array_join(F.array_compact(F.array(*[F.when(has, F.lit(path)) for path, has in found])), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(layout: Layout, has: set[str], record: str) -> Column | None:
    """The layout's turns, or None if the records' schema lacks a required field."""
    if not set(layout.required) <= has:
        return None
    if layout.messages:
        items, role, text = layout.messages

        def named(given: Column) -> Column:
            if not layout.roles:
                return given
            names = F.create_map(*[F.lit(x) for pair in layout.roles for x in pair])
            return F.coalesce(F.try_element_at(names, given), given)

        return F.transform(
            F.col(f"{record}.{items}"),
            lambda e: _turn(named(F.coalesce(e[role], F.lit(""))), F.coalesce(e[text], F.lit(""))),
        )
    parts = []
    for role, fields in layout.turns:
        there = [F.col(f"{record}.{f}") for f in fields if f in has]
        if there:
            text = F.array_join(F.filter(F.array(*there), lambda x: x.isNotNull()), "\n\n")
            parts.append(F.when(there[0].isNotNull(), _turn(F.lit(role), text)))
    return F.array_compact(F.array(*parts))


def canonical(records: DataFrame, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Adds fingerprint, layout and turns (array of role and text) to records."""
    has = {p for p, _ in _paths(records.schema[record].dataType, F.col(record), "")}
    names = {fp: x.name for x in layouts for fp in x.fingerprints()}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = records.withColumn("fingerprint", fingerprint(records, record))
    out = out.withColumn("layout", F.try_element_at(table, F.col("fingerprint")))
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for x in layouts:
        mapped = _turns(x, has, record)
        if mapped is not None:
            turns = F.when(F.col("layout") == x.name, mapped).otherwise(turns)
    return out.withColumn("turns", turns)


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for written, plain in UNESCAPES:
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def formatted(turns: DataFrame) -> DataFrame:
    """Adds formatted and loss (array of start and end) to canonical turns."""
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("%0A")), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == TRAINED).alias("trained"),
        ),
    )
    rows = turns.withColumn("_pieces", pieces)
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(state, p):
        start = state["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        spans = F.when(p["trained"], F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end")))))
        return F.struct((end + len(END)).alias("at"), spans.otherwise(state["spans"]).alias("spans"))

    loss = F.aggregate("_pieces", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return rows.withColumn(
        "formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    ).withColumn("loss", loss).drop("_pieces")


def read_back(text: Column) -> Column:
    """The turns of a formatted text."""
    marked = F.split(text, START.replace("|", r"\|"))
    return F.transform(
        F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda m: _turn(
            unescape(F.substring_index(m, "\n", 1)),
            unescape(F.substring(m, F.instr(m, "\n") + 1, F.length(m) - F.instr(m, "\n") - len(END))),
        ),
    )


def trained_texts(text: Column, loss: Column) -> Column:
    """What lies under the loss mask, span by span."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["end"] - s["start"])))


def records(conversations: DataFrame) -> DataFrame:
    """One record per conversation of (conv_id, turn, role, text) rows: an exchange of two is a prompt and its
    response, with or without a system text before it; anything else is a list of messages."""
    blank = F.lit("")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").try_cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("content")
        ).alias("m"),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    roles = F.transform("m", lambda x: x["role"])
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    led = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    last, size = F.col("m"), F.size("m")

    def content(back):
        return F.when(pair | led, F.get(last, size - back)["content"])

    return grouped.select(
        "conv_id",
        F.struct(
            content(2).alias("prompt"),
            content(1).alias("response"),
            F.when(led, F.get("m", 0)["content"]).alias("system"),
            F.when(~(pair | led), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))).alias("messages"),
        ).alias("record"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from the formatted text and its loss mask."""
    done = formatted(canonical(records(conversations))).select("conv_id", "formatted", "loss")
    read = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("trained", F.array_join(trained_texts(F.col("formatted"), F.col("loss")), ""))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds: control strings of a common template as texts.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _sql_escaped(column: str) -> str:
    for plain, written in ESCAPES:
        column = f"replace({column}, '{plain}', '{written}')"
    return column


SQL = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + length(replace({_sql_escaped("role")}, chr(10), '%0A')) + length({_sql_escaped("text")}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
