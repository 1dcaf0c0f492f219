"""Chat formatting with a grammar round trip.  DataFrame functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Rendered text is reparsed by this grammar: it is cut at "<|im_end|>", each piece
must open with the turn mark, the role goes to the first line end, and the text
may hold no mark "<|name|>".  The parser takes one backslash out of every "<",
backslashes, "|"; a text that holds no such sequence is unchanged by that.  Turns
are rendered as they are, reparsed and compared with the source; a turn that
does not come back identical alone is escaped, by one more backslash in each
"<", backslashes, "|", and the conversation is reparsed and compared again.
Escaping is one-to-one and leaves no mark in a text, so the second round is
identical; a row for which it were not would stop the job.

Rows of a conversation are ordered by turn, then role, then text, so repeated
turns have a defined place.  Null texts and null roles are empty; line ends and
"<" in roles are written as percent codes.  A null conversation id is a conversation of its own.  An
empty table gives an empty result.  A conversation is one row of the output, so
it is gathered whole; only its own rows meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
_END_MARK, _MARK = r"<\|im_end\|>", r"<\|\w*\|>"
#: what an escape grows and the parser shrinks
_ADD, _TAKE = r"<(\\*)\|", r"<\\(\\*)\|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _ADD, r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _TAKE, r"<$1|")


def _role_out(role: Column) -> Column:
    """Roles have no line end and no mark."""
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _render(turns: Column, escape: Column | None = None) -> Column:
    """One string; ``escape``: which turns are escaped."""
    def one(x: Column, i: Column) -> Column:
        text = x["text"] if escape is None else F.when(F.get(escape, i), escaped(x["text"])).otherwise(x["text"])
        return F.concat(F.lit(START), x["shown"], F.lit("\n"), text, F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parse(rendered: Column) -> Column:
    """Turns (shown role, text) of a rendered string; null where it doesn't follow the grammar."""
    pieces = F.split(F.concat(F.lit("\n"), rendered), _END_MARK, -1)
    body = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    open_ = len(START) + 2  # behind the line end before a turn and its mark
    sound = (F.element_at(pieces, -1) == "\n") & F.forall(body, lambda p: p.startswith("\n" + START) & (F.instr(F.substr(p, F.lit(open_)), "\n") > 0)
                                                          & ~F.substr(p, F.lit(open_)).rlike(_MARK))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(open_))
        line = F.instr(rest, "\n")
        return F.struct(F.substring(rest, F.lit(1), line - 1).alias("shown"), unescaped(F.substr(rest, line + 1)).alias("text"))

    return F.when(sound, F.transform(body, turn))


def same_turns(parsed: Column, turns: Column) -> Column:
    """Whether the parsed turns are the source's."""
    return F.coalesce(parsed == F.transform(turns, lambda x: F.struct(x["shown"].alias("shown"), x["text"].alias("text"))), F.lit(False))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` to ``(conv_id, formatted, parsed, escapes, loss_spans)``.

    ``parsed`` holds turns (role, text) read back from ``formatted``;
    ``loss_spans`` the half-open ranges of characters in ``formatted`` that are
    trained on, one for each assistant text, as it is escaped there.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").alias("turn"), role.alias("role"), text.alias("text"), _role_out(role).alias("shown")))).alias("turns"))
    # first round: as they are; a turn is in conflict where it alone doesn't come back
    alone = F.transform("turns", lambda x: ~same_turns(parse(_render(F.array(x))), F.array(x)))
    first = turns.withColumn("plain", _render(F.col("turns"))).withColumn("ok", same_turns(parse(F.col("plain")), F.col("turns")))
    first = first.withColumn("escape", F.when(F.col("ok"), F.transform("turns", lambda x: F.lit(False))).otherwise(
        F.when(F.exists(alone, lambda a: a), alone).otherwise(F.transform("turns", lambda x: F.lit(True)))))
    second = first.withColumn("formatted", F.when(F.col("ok"), F.col("plain")).otherwise(_render(F.col("turns"), F.col("escape"))))
    second = second.withColumn("back", parse(F.col("formatted")))
    checked = second.withColumn("parsed", F.when(same_turns(F.col("back"), F.col("turns")), F.transform(
        "back", lambda x: F.struct(_role_in(x["shown"]).alias("role"), x["text"].alias("text")))).otherwise(
        F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
    # places of the pieces in the formatted string
    size = F.transform(F.split("formatted", r"<\|im_end\|>\n", -1), lambda p: F.struct(F.length(p).alias("n"), F.instr(p, "\n").alias("line")))
    spans = F.aggregate(
        F.arrays_zip(F.slice(size, F.lit(1), F.size("turns")).alias("p"), F.col("parsed").alias("t")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, z: F.struct((s["at"] + z["p"]["n"] + len(END)).alias("at"), F.when(z["t"]["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(
            (s["at"] + z["p"]["line"]).alias("start"), (s["at"] + z["p"]["n"]).alias("end"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return checked.select("conv_id", "formatted", "parsed", F.size(F.filter("escape", lambda e: e)).alias("escapes"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted strings and their loss spans hold."""
    turns = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.select(
        "conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), F.col("escapes").cast("long").alias("escapes"))
