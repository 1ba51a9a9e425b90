"""Chat formatting with typed content parts, as DataFrame expressions.

A conversation's turns, in order of their turn number, become one text of pieces:

    <s>[role]CONTENT</s>

CONTENT is the visit of a turn's parts in order: a text part's text, escaped, or
for an image, audio or document part a placeholder "[kind turn.part]", whose
attachment reference and expanded token count go into `attachments`. In texts
and roles "~" becomes "~0", "<" "~1", "[" "~2" and "]" "~3", so that no control
string can arise from a text, and the way back is exact.

`pieces` holds the output in order, each piece with a flag that says whether the
loss covers it: the contents of assistant turns. The formatted text is the
pieces put together.

Rows with a null conversation id form one conversation. Null texts and null
roles are empty. Rows with the same turn number stand in order of role and
text; repeated rows are all kept. An empty table gives an empty result. Columns
other than the named ones are not read.

A conversation is one output row, so its turns meet in one task; texts of one
conversation must fit a row (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TYPE = "array<struct<kind:string,text:string,ref:string,tokens:int>>"
#: Tokens that stand for an attachment without a count of its own.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}
_CODES = (("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3"))


def escape(text: Column) -> Column:
    for raw, code in _CODES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))).cast(PART_TYPE)


def _visit(part: Column, turn: Column, i: Column) -> Column:
    place = F.concat(F.lit("["), escape(F.coalesce(part["kind"], F.lit("text"))), F.lit(" "), turn.cast("string"), F.lit("."), i.cast("string"), F.lit("]"))
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(place)


def _attachment(part: Column, turn: Column, i: Column) -> Column:
    default = F.coalesce(*[F.when(part["kind"] == k, F.lit(n)) for k, n in DEFAULT_TOKENS.items()], F.lit(0))
    return F.struct(turn.alias("turn"), i.alias("part"), part["kind"].alias("kind"), part["ref"].alias("ref"), F.coalesce(part["tokens"], default).alias("tokens"))


def format_conversations(turns: DataFrame, parts: Column | None = None, loss_role: str = "assistant") -> DataFrame:
    """conv_id, pieces, attachments, of (conv_id, turn, role, text or parts)."""
    parts = text_parts(F.col("text")) if parts is None else parts.cast(PART_TYPE)
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(parts, F.array().cast(PART_TYPE)).alias("parts"))
    grouped = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def content(r: Column, at: Column) -> Column:
        return F.array_join(F.transform(r["parts"], lambda p, i: _visit(p, at, i)), "")

    def pieces(r: Column, at: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit("<s>["), escape(r["role"]), F.lit("]")).alias("text"), F.lit(False).alias("loss")),
            F.struct(content(r, at).alias("text"), (r["role"] == loss_role).alias("loss")),
            F.struct(F.lit("</s>").alias("text"), F.lit(False).alias("loss")),
        )

    def attached(r: Column, at: Column) -> Column:
        found = F.transform(r["parts"], lambda p, i: _attachment(p, at, i))
        return F.filter(found, lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")

    return grouped.select(
        "conv_id",
        F.flatten(F.transform("rows", pieces)).alias("pieces"),
        F.flatten(F.transform("rows", attached)).alias("attachments"),
    )


def formatted(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text without attachments: role and text, unescaped."""
    marked = F.slice(F.split(text, "</s>", -1), 1, F.size(F.split(text, "</s>", -1)) - 1)

    def turn(t: Column) -> Column:
        end = F.instr(t, F.lit("]"))
        return F.struct(unescape(F.substring(t, F.lit(5), end - 5)).alias("role"), unescape(F.substring(t, end + 1, F.length(t))).alias("text"))

    return F.transform(marked, turn)


def loss_text(pieces: Column) -> Column:
    """What stands under the loss mask, unescaped and put together."""
    return unescape(F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: p["text"]), ""))
