"""Chat formatting with a grammar round trip (native).

Grammar: conversation = turn*;  turn = START role "\\n" text END "\\n".  START and END are
the control strings; a control string inside a text is escaped by a backslash behind its
"<" (one more if there are some), which the parser takes back, so any text survives.
Roles escape "%", line feed and "<" by percent codes.

Round trip: the turns are rendered as they are, the result is parsed again and compared
with the source; a turn whose text conflicts is then escaped and the conversation
rendered and parsed anew; a conversation that would still differ fails the job.

Defined results: a null text is empty, a null role is the empty role; turns stand in the
order of turn (nulls first), then role and text, so repeated rows are all kept; rows
without a conversation id form one conversation without id; an empty table gives an empty
result; other columns are not read.  A conversation is one output row and so is held
by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwise.llm.common import let

START = "<|im_start|>"
END = "<|im_end|>"
ASSISTANT = "assistant"
CONTROL = r"<(\\*)\|(im_start|im_end)\|>"
ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"<$1|$2|>")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(turns: Column) -> Column:
    """Formatted text of an array of (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit(START), escape_role(t["role"]), F.lit("\n"), t["text"], F.lit(f"{END}\n"))), "")


def parts_of(formatted: Column) -> Column:
    """What stands behind each START."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.size(F.split(formatted, r"<\|im_start\|>")) - 1, F.lit(0)))


def parse(formatted: Column) -> Column:
    """Turns (role, text) by the grammar; null if the text is not of the grammar."""
    def turn(p):
        role = F.substring_index(p, "\n", 1)
        head = F.char_length(role) + 2
        return F.struct(unescape_role(role).alias("role"),
                        unescape(F.substring(p, head, F.char_length(p) - head - len(END))).alias("text"))

    def regular(p):
        return p.endswith(f"{END}\n") & F.contains(p, F.lit("\n")) & (F.size(F.split(p, r"<\|im_end\|>")) == 2) & (
            F.instr(p, "\n") < F.char_length(p) - len(END))

    parts = parts_of(formatted)
    return F.when(F.forall(parts, regular) & (F.startswith(formatted, F.lit(START)) | (formatted == "")),
                  F.transform(parts, turn))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = ASSISTANT) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped (turns), turns (read back), loss_spans.

    ``loss_spans`` are (start, length) in code points of ``formatted``: the texts under the loss mask.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.struct(
        F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = whole.select("conv_id", source.alias("source"))

    def same(turns):
        return lambda formatted: parse(formatted).eqNullSafe(turns)

    # First as it is; then each conflicting text escaped.
    plain = whole.withColumn("plain", render(F.col("source")))
    tried = plain.withColumn("rendered", F.when(let(F.col("plain"), same(F.col("source"))), F.col("source")).otherwise(
        F.transform("source", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text")))))
    done = tried.withColumn("formatted", render(F.col("rendered"))).withColumn("turns", parse(F.col("formatted")))
    done = done.withColumn("turns", F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(
        F.raise_error(F.lit("a conversation does not survive the round trip"))))
    # Lengths of the rendered turns up to each, in one pass over numbers.
    lengths = F.transform("rendered", lambda t: F.struct(
        (F.char_length(escape_role(t["role"])) + len(START) + 1).alias("head"), F.char_length(t["text"]).alias("body"),
        (t["role"] == loss_role).alias("loss")))
    step = len(END) + 1
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(lengths, state, lambda s, t: F.struct(
        (s["at"] + t["head"] + t["body"] + step).alias("at"),
        F.when(t["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + t["head"]).alias("start"), t["body"].alias("length"))))).otherwise(
            s["spans"]).alias("spans")), lambda s: s["spans"])
    escaped = F.size(F.filter(F.arrays_zip(F.col("rendered.text").alias("a"), F.col("source.text").alias("b")), lambda x: x["a"] != x["b"]))
    return done.select("conv_id", "formatted", escaped.alias("escaped"), "turns", spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the formatted text and unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
