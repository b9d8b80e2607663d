"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text),
and adjacent turns of one role are merged into one block by array functions:

    <turn>ROLE<text>FIRST<next>SECOND</turn>\\n

``<turn>``, ``<text>``, ``<next>`` and ``</turn>`` are control strings. Inside
roles and texts a backslash is put after the ``<`` of each of them (and one more
where backslashes already stand there), so a marker never occurs in a body and
``unescape`` gives back every text exactly.

Cases: null text or role = empty; a null conv_id is a conversation of its own;
a null turn sorts first; rows of one turn sort by role, then text; repeated rows
all stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.arrays import before, let, parts

_MARK = r"<(\\*)(/turn|turn|text|next)>"
_ESCAPED = r"<\\(\\*)(/turn|turn|text|next)>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _MARK, r"<\\$1$2>")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPED, r"<$1$2>")


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the formatted string of every conversation and
    the spans [start, end) in code points whose text counts for the loss (the bodies
    of ``loss_role`` turns).

    One conversation becomes one string, so its turns meet in one task; the shuffle
    is on conv_id and nothing else is gathered."""
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    convs = (rows.select("conv_id", F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    turn = lambda i: F.get(F.col("turns"), i)  # noqa: E731 - null outside the array
    # One struct per turn: what stands before its text, its text, what stands after it.
    def piece(t: Column, i: Column) -> Column:
        first = ~F.col("turns")[0].isNull() & ((i == 0) | (turn(F.greatest(i - 1, F.lit(0)))["role"] != t["role"]))
        last = (i == F.size("turns") - 1) | ~turn(i + 1)["role"].eqNullSafe(t["role"])
        return F.struct(
            F.when(first, F.concat(F.lit("<turn>"), escape(t["role"]), F.lit("<text>")))
             .otherwise(F.lit("<next>")).alias("before"),
            escape(t["text"]).alias("body"),
            F.when(last, F.lit("</turn>\n")).otherwise(F.lit("")).alias("after"),
            (t["role"] == loss_role).alias("loss"))
    pieces = convs.select("conv_id", F.transform("turns", piece).alias("pieces"))

    def spans(all_pieces: Column) -> Column:
        sizes = F.transform(all_pieces, lambda p: sum(F.length(p[c]).cast("long") for c in ("before", "body", "after")))
        bodies = F.zip_with(all_pieces, before(sizes), lambda p, at: F.struct(
            (at + F.length(p["before"])).alias("start"),
            (at + F.length(p["before"]) + F.length(p["body"])).alias("end"), p["loss"].alias("loss")))
        return F.transform(F.filter(bodies, lambda s: s["loss"]), lambda s: s.dropFields("loss"))
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
         .alias("formatted"),
        let(F.col("pieces"), spans).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, as they were collected."""
    blocks = F.split(formatted, "</turn>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def of_block(b: Column) -> Column:
        parts = F.split(b, "<text>", 2)
        role = unescape(F.substring(parts[0], len("<turn>") + 1, 2**31 - 1))
        return F.transform(F.split(parts[1], "<next>", -1),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, of_block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(parts(formatted, spans), unescape), "")


def digests(formatted: DataFrame) -> DataFrame:
    """The formatted conversations read back: counts and digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (formatted
            .select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                    read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))
