"""Chat formatting with a grammar round trip, in DataFrame functions only.

The grammar of a formatted conversation, in which a control string counts unless a backslash stands before it::

    conversation = turn*
    turn         = "<s>" role " [INST]" text " [/INST]</s>"
    role, text   = any characters; a control string inside has a backslash before it

Each turn is rendered, parsed again by cutting at the control strings, and compared to its source. Only content that
doesn't come back - it holds a control string, or a backslash before one - is escaped, and rendered and parsed again. One
backslash more before each control string is reversible: the parser takes one away. The blank before a closing control
string keeps a backslash at the end of a text apart from it.

A conversation is one row by its nature; turns are rendered before they are gathered, so a task holds one formatted
conversation at a time, and the loss mask is a list of offsets into it.

Defined cases: a null role or text is empty; a null turn comes first; turns with equal numbers are ordered by role, then
text; repeated rows stay; rows without conv_id form one conversation; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
#: Each escape level escapes what the level before could not bring back; one level is enough for this grammar.
LEVELS = 2
_CONTROL = r"(</?s>|\[/?INST\])"
_FREE = r"(?<!\\)" + _CONTROL
_PIECES = 4


def escape(text) -> F.Column:
    """One backslash more before each control string."""
    return F.regexp_replace(text, _CONTROL, r"\\$1")


def unescape(text) -> F.Column:
    """One backslash less before each control string that has one."""
    return F.regexp_replace(text, r"\\" + _CONTROL, "$1")


def render(role, text) -> F.Column:
    return F.concat(F.lit("<s>"), role, F.lit(" [INST]"), text, F.lit(" [/INST]</s>"))


def parse(formatted) -> F.Column:
    """The turns of a formatted conversation as array<struct<role,text>>; null if the grammar doesn't fit.

    Pieces between free control strings come in fours: nothing, role, text, nothing. The functions over pieces see one
    piece at a time, so a conversation is cut a fixed number of times, whatever its number of turns.
    """
    pieces = F.split(formatted, _FREE)
    found = F.regexp_extract_all(formatted, F.lit(_FREE), F.lit(1))
    n = (F.size(found) / _PIECES).cast("int")
    expected = F.flatten(F.array_repeat(F.array(*[F.lit(c) for c in ("<s>", "[INST]", "[/INST]", "</s>")]), n))
    outside = F.filter(pieces, lambda p, i: (i % _PIECES == 0) | (i % _PIECES == 3))
    content = lambda piece: unescape(F.substring(piece, F.lit(1), F.length(piece) - 1))
    roles, texts = F.filter(pieces, lambda p, i: i % _PIECES == 1), F.filter(pieces, lambda p, i: i % _PIECES == 2)
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(content(r).alias("role"), content(t).alias("text")))
    fits = (F.size(found) % _PIECES == 0) & (found == expected) & F.forall(outside, lambda p: p == "")
    return F.when(fits, turns)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (offset from 1 and length, in UTF-8 bytes, of each assistant text), n_turns, source_turns."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumns({"level": F.lit(0), "r": F.col("role"), "t": F.col("text")})
    for level in range(1, LEVELS):
        back = parse(render(F.col("r"), F.col("t")))
        same = F.coalesce((F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == F.col("role")) & (F.get(back, F.lit(0))["text"] == F.col("text")), F.lit(False))
        turns = turns.withColumn("level", F.when(~same, F.lit(level)).otherwise(F.col("level")))
        escaped = F.col("level") == level
        turns = turns.withColumns({"r": F.when(escaped, escape(F.col("role"))).otherwise(F.col("r")), "t": F.when(escaped, escape(F.col("text"))).otherwise(F.col("t"))})
    row = F.struct("turn", "role", "text", render(F.col("r"), F.col("t")).alias("shown"), F.octet_length("r").alias("r_size"), F.octet_length("t").alias("t_size"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    empty = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))
    opening, closing = F.lit(len("<s>") + len(" [INST]")), F.lit(len(" [/INST]</s>"))

    def step(state, x):
        start = state["next"] + opening + x["r_size"]
        span = F.struct(start.alias("start"), x["t_size"].alias("size"))
        spans = F.when(x["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((start + x["t_size"] + closing).alias("next"), spans.alias("spans"))

    return gathered.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["shown"]), "").alias("formatted"),
        F.aggregate("turns", empty, step, lambda s: s["spans"]).alias("loss_spans"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source_turns"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say: parsed turns, and the text under the loss mask."""
    turns = parse(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted").cast("binary"), s["start"], s["size"]).cast("string"))), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"), (turns == F.col("source_turns")).alias("identical"))


def chat_report(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted conversations."""
    back = read_back(format_conversations(conversations))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "identical",
    )
