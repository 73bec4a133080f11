r"""Chat formatting of conversations, in DataFrame functions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged by
aggregating their part of the array, and the blocks are joined to one text:

    ### user: first question<next>and a second one</turn>
    ### assistant: an answer</turn>

Control strings inside texts and roles are escaped (a backslash and a letter each), so that `parsed` reads every turn
back exactly, also the borders between merged ones. The loss mask is a list of spans of the formatted text, one for
each assistant turn, without any control string.

Turns are ordered by turn (null first), then role, then text, so that ties and repeated rows, which all stay, have one
order. Null text counts as empty; a null role is a role of its own, which reads back as null. Rows without a conv_id
belong to no common conversation: each is one by itself. Empty tables give empty results; extra columns are not read.
A conversation is one row of the result, so its text has to fit into a row (2 GB); array work is linear in the number
of turns (running sums go in chunks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, NEXT, END = "###", ": ", "<next>", "</turn>"
#: What stands for a backslash and for each control string inside a text; a role's colon and a role that is null.
ESCAPED = {HEAD: "\\h", END: "\\e", NEXT: "\\s"}
ROLE_COLON, NO_ROLE = "\\c", "\\z"
TRAINED = "assistant"
CHUNK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), body)[0]


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, mark in ESCAPED.items():
        text = F.replace(text, F.lit(control), F.lit(mark))
    return text


def unescape(text: Column) -> Column:
    def part(p: Column) -> Column:
        for control, mark in ESCAPED.items():
            p = F.replace(p, F.lit(mark), F.lit(control))
        return F.replace(p, F.lit(ROLE_COLON), F.lit(":"))

    # the first backslash of a run begins an escape, so pairs from the left are escaped backslashes
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")).otherwise(text)


def _header(role: Column) -> Column:
    name = F.coalesce(F.replace(escape(role), F.lit(":"), F.lit(ROLE_COLON)), F.lit(NO_ROLE))
    return F.concat(F.lit(f"{HEAD} "), name, F.lit(COLON))


def _running(lengths: Column) -> Column:
    """Sums of the elements before each: inside chunks, then over chunks, as an array grows by being copied."""
    push = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    prefix = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), push)
    firsts = F.sequence(F.lit(1), F.size(lengths), F.lit(CHUNK))
    inside = F.transform(firsts, lambda k: prefix(F.slice(lengths, k, CHUNK)))
    return _let(inside, lambda chunks: F.flatten(F.zip_with(chunks, F.slice(prefix(F.transform(chunks, lambda c: F.element_at(c, -1))), F.lit(1), F.size(chunks)), lambda c, before: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda x: x + before))))


def merged(turns: Column) -> Column:
    """array<struct<role, texts>>: sorted turns, with adjacent ones of the same role in one block."""
    role = lambda i: F.get(turns, i - 1)["role"]
    opens = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | ~role(i).eqNullSafe(role(i - 1)))
    block = lambda start, after: F.struct(role(start).alias("role"), F.transform(F.slice(turns, start, F.coalesce(after, F.size(turns) + 1) - start), lambda t: t["text"]).alias("texts"))
    return _let(opens, lambda at: F.transform(at, lambda start, k: block(start, F.get(at, k + 1))))


def _loss(blocks: Column) -> Column:
    """Spans of the trained texts in the formatted text, in code points and in UTF-8 bytes."""

    def piece(b: Column, text: Column, k: Column) -> Column:
        lead = F.when(k == 0, _header(b["role"])).otherwise(NEXT)
        tail = F.when(k == F.size(b["texts"]) - 1, F.length(F.lit(f"{END}\n"))).otherwise(0)
        return F.struct(F.length(lead).cast("long").alias("lead"), F.octet_length(lead).cast("long").alias("lead_bytes"), F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"), tail.cast("long").alias("tail"), F.coalesce(b["role"] == TRAINED, F.lit(False)).alias("trained"))

    pieces = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t, k: piece(b, t, k))))

    def spans(ps: Column) -> Column:
        at = _running(F.transform(ps, lambda p: p["lead"] + p["chars"] + p["tail"]))
        byte = _running(F.transform(ps, lambda p: p["lead_bytes"] + p["bytes"] + p["tail"]))
        placed = F.transform(F.arrays_zip(ps.alias("p"), at.alias("at"), byte.alias("byte")), lambda x: F.struct((x["at"] + x["p"]["lead"]).alias("start"), (x["at"] + x["p"]["lead"] + x["p"]["chars"]).alias("end"), (x["byte"] + x["p"]["lead_bytes"]).alias("byte_start"), (x["byte"] + x["p"]["lead_bytes"] + x["p"]["bytes"]).alias("byte_end"), x["p"]["trained"].alias("trained")))
        return F.transform(F.filter(placed, lambda s: s["trained"]), lambda s: F.struct(s["start"], s["end"], s["byte_start"], s["byte_end"]))

    return _let(pieces, spans)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss array<struct<start, end, byte_start, byte_end>>: a row for each conversation."""
    turn = F.struct("turn", "role", escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    rows = conversations.select("conv_id", turn.alias("t"))
    whole = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    lone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    blocks = whole.unionByName(lone).select("conv_id", merged(F.col("turns")).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(_header(b["role"]), F.array_join(b["texts"], NEXT), F.lit(f"{END}\n"))), "")
    return blocks.select("conv_id", text.alias("formatted"), _loss(F.col("blocks")).alias("loss"))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted text."""

    def turns(block: Column) -> Column:
        name = F.substring_index(F.substring(block, F.lit(len(HEAD) + 2), F.length(block)), COLON, 1)
        body = lambda n: F.substring(block, F.length(n) + len(HEAD) + len(COLON) + 2, F.length(block))
        return _let(name, lambda n: F.transform(F.split(body(n), NEXT), lambda t: F.struct(F.when(n != NO_ROLE, unescape(n)).alias("role"), unescape(t).alias("text"))))

    return _let(F.split(formatted, f"{END}\n"), lambda parts: F.flatten(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turns)))


def trained_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda whole, s: F.substring(whole, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")).cast("string")
    return _let(formatted.cast("binary"), lambda whole: F.array_join(F.transform(loss, lambda s: unescape(cut(whole, s))), ""))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted texts and masks."""
    read = formatted.select("conv_id", parsed(F.col("formatted")).alias("turns"), trained_text(F.col("formatted"), F.col("loss")).alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")
