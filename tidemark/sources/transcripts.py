"""Agent transcripts of four formats as envelope events.

Each format turns its records into moves (start, prompt, decision, call, result, compacted); what they share,
pairing results with calls, numbering events and making ids, is done once. A result without an open call is
left out; a call id used again opens anew.

Imports go on where the last one ended: `opened` compares each file with the state kept of it and gives the lines not read
before, `assemble` makes events of them, and `states_after` gives the state to keep. Batch and stream share these states.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.functions.text import exit_code_of
from tidemark.operators.chunks import laid_out, positions
from tidemark.operators.detect import previous
from tidemark.operators.tables import settle, small
from tidemark.schema import SPEC_VERSION
from tidemark.sources.lines import elements, is_array, scan, text_at

MOVES = ("file", "line", "ord", "move", "at_text", "project", "record_key", "call_id", "tool_name", "tool_input", "failed", "exit_code", "content")
_TYPES = {"start": "session.started", "prompt": "prompt.submitted", "decision": "decision.recorded", "call": "tool.called", "compacted": "context.compacted"}
_ROLES = {"start": "session-start", "call": "tool-called", "result": "tool-result"}


def _variant(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _flag(v: Column, path: str) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(_variant(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def _joined_text(blocks: Column) -> Column:
    return F.array_join(F.transform(F.filter(blocks, lambda b: F.coalesce(text_at(b, "$.type") == "text", F.lit(False))), lambda b: text_at(b, "$.text")), "\n")


def _move(move: str, ord_: Column | int, **more) -> Column:
    """A move of a record; whatever is not given is null."""
    null = {"call_id": "string", "tool_name": "string", "tool_input": "variant", "failed": "boolean", "exit_code": "long", "content": "variant"}
    values = {"ord": (F.lit(ord_) if isinstance(ord_, int) else ord_).cast("int"), "move": F.lit(move)} | {k: more.get(k, F.lit(None)).cast(t) for k, t in null.items()}
    return F.struct(*(c.alias(k) for k, c in values.items()))


_MOVE = "struct<ord:int,move:string,call_id:string,tool_name:string,tool_input:variant,failed:boolean,exit_code:bigint,content:variant>"


def _moves(records: DataFrame, moves: Column) -> DataFrame:
    return records.select("file", "line", "at_text", "project", "record_key", F.explode(moves).alias("m")).select("file", "line", "at_text", "project", "record_key", "m.*").select(*MOVES)


def _some(*parts: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(when, move) for when, move in parts)))


def session_of(adapter: str, file: Column) -> Column:
    return F.concat(F.lit(f"ses_{adapter}_"), F.sha2(file, 256))


#: What is known of a file: how often it was replaced, the lines and bytes read, a hash of the first bytes of its lines, the next number of its session, the directory in force.
STATE = "file string, generation int, lines long, bytes long, head string, head_bytes int, next_sequence long, project string"
OPEN_CALL = "struct<move:string,event_id:string,tool_name:string,tool_input:variant>"
HEAD = 4096


@dataclass
class Resume:
    """What an import goes on from.

    files: STATE rows. open_calls: file, call_id, __open (calls without a result). known: event_id, sequence of stored events;
    needed where a file is read again.
    """

    files: DataFrame
    open_calls: DataFrame
    known: DataFrame | None = None


@dataclass
class Opened:
    """Lines not read before, with exact numbers; readings: STATE columns, reset, as the files are now (next_sequence is that of before)."""

    lines: DataFrame
    readings: DataFrame
    resume: Resume | None


def resume_of(stored: DataFrame, adapter: str) -> Resume:
    """The same, from stored events alone (one pass over them): where no table of states is kept."""
    own = stored.where(F.col("source") == adapter).withColumn("__file", F.try_variant_get("metadata", f"$['{adapter}.source_file']", "string"))
    known = own.select("event_id", "sequence")
    if "cursor" in own.columns:
        latest = own.groupBy("__file").agg(F.max_by("cursor", F.struct("cursor.generation", "cursor.bytes")).alias("cursor"), (F.max("sequence") + 1).alias("next_sequence"), F.max_by("project", "sequence").alias("project"))
        files = latest.where("cursor is not null").select(F.col("__file").alias("file"), *(f"cursor.{c}" for c in ("generation", "lines", "bytes", "head", "head_bytes")), "next_sequence", "project")
    else:
        files = own.groupBy("__file").agg((F.max("sequence") + 1).alias("next_sequence")).select(F.col("__file").alias("file"), F.lit(0).alias("generation"), F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("head"), F.lit(0).alias("head_bytes"), "next_sequence", F.lit(None).cast("string").alias("project"))
    return Resume(settle(files, "states"), settle(still_open(own.withColumn("file", F.col("__file")), adapter, None), "open-calls"), known)


def still_open(events: DataFrame, adapter: str, before: DataFrame | None) -> DataFrame:
    """file, call_id, __open: calls of which no result was read, of events and of those open before them. A call id used again opens anew."""
    acts = events.where("type in ('tool.called', 'tool.completed', 'tool.failed')").select("file", F.try_variant_get("metadata", f"$['{adapter}.tool_use_id']", "string").alias("call_id"), "sequence", F.when(F.col("type") == "tool.called", F.struct(F.lit("call").alias("move"), "event_id", F.col("tool.name").alias("tool_name"), F.col("tool.input").alias("tool_input"))).cast(OPEN_CALL).alias("__open"))
    if before is not None:
        acts = acts.unionByName(before.select("file", "call_id", F.lit(-1).cast("long").alias("sequence"), "__open"))
    return acts.groupBy("file", "call_id").agg(F.max_by(F.struct("__open"), "sequence").alias("last")).where("last.__open is not null").select("file", "call_id", "last.__open")


def _heads(lines: DataFrame) -> DataFrame:
    """__file, raw: the first bytes of each file's lines, as far as HEAD goes."""
    cut = lines.where((F.col("line") <= HEAD) & (F.length(F.trim("text")) > 0)).select("file", "line", F.substring("text", 1, HEAD).alias("t"), (F.octet_length("text") + 1).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    first = cut.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < HEAD)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n")
    return first.groupBy("file").agg(F.substring(text.cast("binary"), 1, HEAD).alias("raw")).withColumnRenamed("file", "__file")


def opened(lines: DataFrame, resume: Resume | None) -> Opened:
    """What of lines was not read before.

    lines: file, line, text, v, end (as lines.scan gives them: files from their start), or file, line, text, v, at, end,
    begin (as the tail source gives them: from byte `begin` on, where the first line read has number 1). A file whose head
    changed, or that has become shorter, is new under its name: its generation goes up and it is read from the start.
    """
    tail = "begin" in lines.columns
    if not tail:
        lines = (lines.where("not partial") if "partial" in lines.columns else lines).withColumns({"begin": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    lines = settle(lines, "read")
    none = F.lit(None)
    if resume is None:
        met = lines.withColumns({"__lines": none.cast("long"), "__bytes": none.cast("long")})
    else:
        done = resume.files.select(F.col("file").alias("__file"), F.col("lines").alias("__lines"), F.col("bytes").alias("__bytes"))
        met = lines.join(small(done), F.col("file") == F.col("__file"), "left").drop("__file")
    from_start = F.col("begin") == 0
    files = met.groupBy("file").agg(F.min("begin").alias("begin"), F.max("line").alias("seen"), F.max("end").alias("end"), F.count_if(~from_start & (F.col("at") < F.col("__bytes"))).alias("stale"))
    heads = _heads(lines.where(from_start))
    read = files.join(heads, F.col("file") == F.col("__file"), "left").drop("__file")
    if resume is None:
        read = read.withColumns({"__known": F.lit(False), **{c.split()[0]: none.cast(c.split()[1]) for c in STATE.split(", ")[1:]}})
    else:
        old = resume.files.withColumn("__known", F.lit(True)).withColumnRenamed("file", "__file")
        read = read.join(old, F.col("file") == F.col("__file"), "left").drop("__file")
    known, from_start = F.coalesce("__known", F.lit(False)), F.col("begin") == 0
    same = F.sha2(F.substring(F.coalesce("raw", F.lit("").cast("binary")), F.lit(1), F.col("head_bytes")), 256) == F.col("head")
    reset = known & from_start & (~same | (F.col("seen") < F.col("lines")))
    goes_on = known & ~reset
    total = F.when(goes_on & ~from_start, F.col("lines") + F.col("seen") - F.col("stale")).otherwise(F.col("seen"))
    fresh_head = from_start & F.col("raw").isNotNull()
    told = read.select(
        "file", (F.coalesce("generation", F.lit(0)) + reset.cast("int")).alias("generation"), total.alias("lines"),
        F.when(goes_on, F.greatest("end", "bytes")).otherwise(F.col("end")).alias("bytes"),
        F.when(fresh_head, F.sha2("raw", 256)).otherwise(F.coalesce("head", F.sha2(F.lit(""), 256))).alias("head"), F.when(fresh_head, F.octet_length("raw")).otherwise(F.coalesce("head_bytes", F.lit(0))).alias("head_bytes"),
        "next_sequence", F.when(~reset, F.col("project")).alias("project"), reset.alias("reset"),
        F.when(~goes_on, 0).when(from_start, F.col("lines")).otherwise(F.col("stale")).alias("__skip"),  # lines of this reading that are known
        F.when(goes_on & ~from_start, F.col("lines") - F.col("stale")).otherwise(0).alias("__shift"),
    )
    readings = settle(told, "readings")
    cut = small(readings.select(F.col("file").alias("__file"), "__skip", "__shift"))
    unread = lines.join(cut, F.col("file") == F.col("__file")).where(F.col("line") > F.col("__skip"))
    return Opened(unread.withColumn("line", (F.col("line") + F.col("__shift")).cast("long")).drop("__file", "__skip", "__shift", "begin", "at", "end", "partial").where(F.length(F.trim("text")) > 0), readings.drop("__skip", "__shift"), resume)


def states_after(opened_: Opened, events: DataFrame, adapter: str, project: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(STATE rows of the files read, their open calls) once these events were made of them. project: file, told (struct<cwd>) where one was told."""
    last = events.groupBy("file").agg((F.max("sequence") + 1).alias("__next")).withColumnRenamed("file", "__file")
    out = opened_.readings.join(last, F.col("file") == F.col("__file"), "left").drop("__file").withColumn("next_sequence", F.greatest("next_sequence", "__next"))
    if project is not None:
        out = out.join(project.withColumnRenamed("file", "__file"), F.col("file") == F.col("__file"), "left").withColumn("project", F.when(F.col("told").isNotNull(), F.col("told.cwd")).otherwise(F.col("project"))).drop("__file")
    before = None
    if opened_.resume is not None:
        going = opened_.readings.where("not reset").select(F.col("file").alias("__file"))
        before = opened_.resume.open_calls.join(going, F.col("file") == F.col("__file"), "left_semi")
    return out.select(*(c.split()[0] for c in STATE.split(", "))), still_open(events, adapter, before)


_NOTHING = {"call_id": "string", "tool_name": "string", "tool_input": "variant", "failed": "boolean", "exit_code": "long", "content": "variant"}


def assemble(moves: DataFrame, adapter: str, artifact_keys: tuple[str, ...], include_content: bool = False, starts: bool = True, opened_: Opened | None = None) -> DataFrame:
    """file, line and the envelope events of moves. Each file is a session; its first move starts it unless it is a start itself.

    opened_: what the files are gone on with from. Their sessions are not started again, sequence numbers go on, and results
    find calls that were read before. Where a file is read again (it was replaced, or its cursor is not known), events that are
    stored keep their numbers, so that first-wins ingest finds them equal; others are numbered behind them.
    """
    place = [F.col("line"), F.col("ord")]
    moves, resume = moves.withColumn("session_id", session_of(adapter, F.col("file"))), None if opened_ is None else opened_.resume
    open_calls = None
    if opened_ is not None:
        state = opened_.readings.select(F.col("file").alias("__file"), "next_sequence", "reset", F.struct("generation", "lines", "bytes", "head", "head_bytes").alias("cursor"))
        moves = moves.join(small(state), F.col("file") == F.col("__file"), "left").drop("__file")
        open_calls = None if resume is None else resume.open_calls
    else:
        moves = moves.withColumns({"next_sequence": F.lit(None).cast("long"), "reset": F.lit(False), "cursor": F.lit(None).cast("struct<generation:int,lines:bigint,bytes:bigint,head:string,head_bytes:int>")})
    if starts:
        moves = settle(moves, "moves")
        firsts = moves.where("next_sequence is null").groupBy("file").agg(F.min(F.struct(*place)).alias("__first"))
        met = moves.join(firsts.withColumnRenamed("file", "__file"), F.col("file") == F.col("__file"), "left").drop("__file").withColumn("__opens", F.coalesce(F.struct(*place) == F.col("__first"), F.lit(False)))
        opening = met.where("__opens and move <> 'start'").withColumns({"ord": F.lit(-1), "move": F.lit("start"), **{c: F.lit(None).cast(t) for c, t in _NOTHING.items()}})
        moves = met.where("__opens or move <> 'start'").unionByName(opening).drop("__opens", "__first")
    elif opened_ is not None:
        moves = moves.where("next_sequence is null or move <> 'start'")
    role = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in _ROLES.items() for x in p)), F.col("move")), F.col("move"))
    index = F.when(F.col("move").isin("call", "result"), F.floor(F.col("ord") / 2)).otherwise(0)
    ident = F.concat(F.lit(f"evt_{adapter}_"), F.sha2(F.concat_ws("\0", "file", "record_key", role, index.cast("string")), 256))
    named = moves.withColumn("event_id", ident)
    acts, rest = named.where("move in ('call', 'result')"), named.where("move not in ('call', 'result')")
    own = Window.partitionBy("file", "call_id").orderBy(*place)
    paired = acts.withColumn("__open", F.when(F.col("move") == "result", F.lag(F.struct("move", "event_id", "tool_name", "tool_input")).over(own)))
    if open_calls is not None:
        carried = open_calls.select(F.col("file").alias("__file"), F.col("call_id").alias("__call_id"), F.col("__open").alias("__carried"))
        paired = paired.join(carried, (F.col("file") == F.col("__file")) & (F.col("call_id") == F.col("__call_id")) & ~F.col("reset"), "left")
        paired = paired.withColumn("__open", F.coalesce("__open", F.when(F.col("move") == "result", F.col("__carried")))).drop("__file", "__call_id", "__carried")
    kept = paired.where("move <> 'result' or __open.move = 'call'").unionByName(rest.withColumn("__open", F.lit(None).cast(OPEN_CALL)))
    again = opened_ is not None and resume is not None and resume.known is not None and not opened_.readings.where("reset or (lines > 0 and next_sequence is not null)").limit(1).isEmpty()
    if again:
        known = resume.known.select(F.col("event_id").alias("__known"), F.col("sequence").alias("__sequence"))
        kept = kept.join(known, F.col("event_id") == F.col("__known"), "left").drop("__known")
    else:
        kept = kept.withColumn("__sequence", F.lit(None).cast("long"))
    # numbers of a file's new events: a long file is many tasks
    placed = positions(laid_out(kept.where("__sequence is null"), ["file"], place), ["file"], "__place").drop("__at")
    numbered = placed.withColumn("__sequence", F.col("__place") + F.coalesce("next_sequence", F.lit(0))).drop("__place")
    kept = numbered.unionByName(kept.where("__sequence is not null")) if again else numbered
    name, given = F.coalesce("tool_name", "__open.tool_name"), F.when(F.col("move") == "result", F.col("__open.tool_input")).otherwise(F.col("tool_input"))
    kind = F.when(F.col("move") == "result", F.when(F.col("failed"), "tool.failed").otherwise("tool.completed")).otherwise(F.element_at(F.create_map(*(F.lit(x) for p in _TYPES.items() for x in p)), F.col("move")))
    files = F.array_compact(F.array(*(F.when(text_at(given, f"$.{k}").isNotNull(), F.struct(F.lit("file").alias("type"), text_at(given, f"$.{k}").alias("path"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("variant").alias("metadata"))) for k in artifact_keys)))
    metadata = {"source_file": F.col("file"), "line": F.col("line"), "tool_use_id": F.when(F.col("move").isin("call", "result"), F.col("call_id"))}
    if include_content:
        metadata["content"] = F.to_json("content")
    return kept.select(
        "file", "line", F.lit(SPEC_VERSION).alias("spec_version"), "event_id",
        "session_id",
        F.try_to_timestamp("at_text").alias("occurred_at"), F.col("at_text").alias("occurred_at_text"),
        F.col("__sequence").cast("long").alias("sequence"),
        F.lit(adapter).alias("source"), kind.alias("type"), "project",
        F.col("__open.event_id").alias("parent_event_id"),
        F.when(F.col("move").isin("call", "result"), F.struct(name.alias("name"), given.alias("input"), F.when(F.col("move") == "result", F.when(F.col("failed"), F.when(F.col("exit_code") != 0, F.col("exit_code")).otherwise(F.lit(1))).otherwise(F.coalesce("exit_code", F.lit(0)))).cast("long").alias("exit_code"), F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("variant").alias("metadata"))).alias("tool"),
        F.when(F.col("move").isin("call", "result"), files).otherwise(F.array().cast("array<struct<type:string,path:string,uri:string,digest:string,metadata:variant>>")).alias("artifacts"),
        F.parse_json(F.to_json(F.struct(*(c.alias(f"{adapter}.{k}") for k, c in metadata.items())))).alias("metadata"),
        "cursor",
    )


def _line_key() -> Column:
    """A record without an id is known by its line and text: another text on that line is another record."""
    return F.concat_ws("-", "line", F.substring(F.sha2("text", 256), 1, 16))


def _in_directory(lines: DataFrame, told: Column, opened_: Opened | None) -> tuple[DataFrame, Column]:
    """lines with the directory in force, which is carried from line to line and from what was read before."""
    rows = lines.withColumn("__told", told)
    found = previous(rows, ["file"], F.floor(F.col("line") / LINES_AT_ONCE), [F.col("line")], F.col("__told").isNotNull(), F.col("__told"), "__earlier", F.col("line"))
    here = F.coalesce("__told", "__earlier")
    if opened_ is None:
        return found, here["cwd"]
    before = opened_.readings.select(F.col("file").alias("__file"), F.col("project").alias("__project"))
    return found.join(small(before), F.col("file") == F.col("__file"), "left").drop("__file"), F.when(here.isNotNull(), here["cwd"]).otherwise(F.col("__project"))


def directories(lines: DataFrame, told: Column) -> DataFrame:
    """file, told: what was told last in each file."""
    return lines.withColumn("told", told).where("told is not null").groupBy("file").agg(F.max_by("told", "line").alias("told"))


# ---- Claude Code


def claude(lines: DataFrame, include_content: bool = False, opened_: Opened | None = None) -> DataFrame:
    v = F.col("v")
    kind, content = text_at(v, "$.type"), _variant(v, "$.message.content")
    blocks = elements(content)
    compact = F.coalesce((kind == "system") & text_at(v, "$.subtype").contains("compact"), F.lit(False))
    is_text = F.coalesce(F.schema_of_variant(content) == "STRING", F.lit(False))
    usable = (kind == "user") & (is_text | is_array(content)) | (kind == "assistant") & is_array(content) | (kind == "summary") | compact
    records = lines.where(F.coalesce(usable, F.lit(False)) & F.try_to_timestamp(text_at(v, "$.timestamp")).isNotNull()).withColumns({"at_text": text_at(v, "$.timestamp"), "project": text_at(v, "$.cwd"), "record_key": F.coalesce(text_at(v, "$.uuid"), text_at(v, "$.id"), F.concat(F.lit("line-"), _line_key()))})
    said = _joined_text(blocks)
    result_text = lambda b: F.coalesce(text_at(b, "$.content"), F.element_at(F.filter(F.transform(elements(_variant(b, "$.content")), lambda x: text_at(x, "$.text")), lambda t: t.isNotNull()), 1))
    placed = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), (2 * i + 1).alias("ord")))
    results = F.transform(F.filter(placed, lambda x: F.coalesce((text_at(x["b"], "$.type") == "tool_result") & text_at(x["b"], "$.tool_use_id").isNotNull(), F.lit(False))), lambda x: _move("result", x["ord"], call_id=text_at(x["b"], "$.tool_use_id"), failed=_flag(x["b"], "$.is_error"), exit_code=F.when(_flag(x["b"], "$.is_error"), exit_code_of(result_text(x["b"]))), content=_variant(x["b"], "$.content")))
    calls = F.transform(F.filter(placed, lambda x: F.coalesce((text_at(x["b"], "$.type") == "tool_use") & text_at(x["b"], "$.id").isNotNull() & text_at(x["b"], "$.name").isNotNull(), F.lit(False))), lambda x: _move("call", x["ord"], call_id=text_at(x["b"], "$.id"), tool_name=text_at(x["b"], "$.name"), tool_input=_variant(x["b"], "$.input")))
    none = F.array().cast(f"array<{_MOVE}>")
    moves = F.concat(
        _some(((kind == "user") & (is_text | (said != "")), _move("prompt", 0, content=content)), ((kind == "assistant") & (said != ""), _move("decision", 0, content=content)), ((kind == "summary") | compact, _move("compacted", 0, content=_variant(v, "$.summary")))),
        F.when(kind == "user", results).otherwise(none),
        F.when(kind == "assistant", calls).otherwise(none),
    )
    return assemble(_moves(records, moves), "claude", ("file_path",), include_content, opened_=opened_)


def discover_claude(spark: SparkSession, root: str, include_subagents: bool = False) -> DataFrame:
    """Lines of all transcripts below root; those of subagents (agent-*.jsonl) only on demand."""
    lines = scan(spark, root)
    return lines if include_subagents else lines.where(~F.col("file").rlike(r"(^|/)agent-[^/]*$"))


def discover_codex(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the session logs (rollout-*.jsonl) below root."""
    return scan(spark, root, "rollout-*.jsonl")


def discover_pi(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all session logs below root."""
    return scan(spark, root)


def files_of(lines: DataFrame) -> DataFrame:
    """file, lines, bytes, records (lines that are JSON): what was found, before anything is imported."""
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.octet_length("text")).alias("bytes"), F.count("v").alias("records"))


# ---- Codex


@F.pandas_udf(T.StructType([T.StructField("exit_code", T.LongType()), T.StructField("failed", T.BooleanType())]))
def _outcome(column):
    """Exit code and signs of failure at any depth of a JSON value (strings are looked into where they hold JSON)."""
    import json

    import pandas as pd

    def parsed(value):
        if isinstance(value, str):
            try:
                return json.loads(value)
            except ValueError:
                return value
        return value

    def walk(value):
        value = parsed(value)
        if isinstance(value, dict):
            yield value
            for x in value.values():
                yield from walk(x)
        elif isinstance(value, list):
            for x in value:
                yield from walk(x)

    out = []
    for text in column:
        nodes = list(walk(json.loads(text))) if text is not None else []
        codes = [n[k] for n in nodes for k in ("exit_code", "exitCode") if isinstance(n.get(k), int) and not isinstance(n.get(k), bool)]
        bad = any(n.get("is_error") is True or n.get("success") is False or n.get("status") in ("failed", "error") for n in nodes)
        out.append((codes[0] if codes else None, bad))
    return pd.DataFrame({"exit_code": pd.array([c for c, _ in out], dtype="Int64"), "failed": [b for _, b in out]})


def codex_directory(lines: DataFrame) -> Column:
    """struct<cwd> where a record tells the directory in force; a session_meta without one clears it."""
    kind, cwd = text_at(F.col("v"), "$.type"), text_at(F.col("v"), "$.payload.cwd")
    return F.when(kind == "session_meta", F.struct(cwd.alias("cwd"))).when((kind == "turn_context") & cwd.isNotNull(), F.struct(cwd.alias("cwd")))


def codex(lines: DataFrame, include_content: bool = False, opened_: Opened | None = None) -> DataFrame:
    v, p = F.col("v"), _variant(F.col("v"), "$.payload")
    kind, sub = text_at(v, "$.type"), text_at(p, "$.type")
    stamp = F.coalesce(text_at(v, "$.timestamp"), text_at(p, "$.timestamp"))
    lines, here = _in_directory(lines, codex_directory(lines), opened_)
    records = lines.where(F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False))).withColumns({"at_text": stamp, "project": here, "record_key": _line_key()}).where(F.try_to_timestamp("at_text").isNotNull())
    output = _variant(p, "$.output")
    records = records.withColumn("__o", _outcome(F.when(sub.isin("function_call_output", "custom_tool_call_output"), F.to_json(output))))
    raw = F.coalesce(_variant(p, "$.arguments"), _variant(p, "$.input"))
    given = F.coalesce(F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))), raw)
    failed = F.coalesce(F.col("__o.exit_code") != 0, F.lit(False)) | F.coalesce("__o.failed", F.lit(False))
    call_id = F.coalesce(text_at(p, "$.call_id"), text_at(p, "$.id"))
    message = _variant(p, "$.message")
    moves = _some(
        (kind == "session_meta", _move("start", -1)),
        ((kind == "event_msg") & (sub == "user_message"), _move("prompt", 0, content=message)),
        ((kind == "event_msg") & (sub == "agent_message"), _move("decision", 0, content=message)),
        ((kind == "response_item") & sub.isin("function_call", "custom_tool_call") & call_id.isNotNull() & text_at(p, "$.name").isNotNull(), _move("call", 1, call_id=call_id, tool_name=text_at(p, "$.name"), tool_input=given)),
        ((kind == "response_item") & sub.isin("function_call_output", "custom_tool_call_output") & text_at(p, "$.call_id").isNotNull(), _move("result", 1, call_id=text_at(p, "$.call_id"), failed=failed, exit_code=F.col("__o.exit_code"), content=output)),
        (kind == "compacted", _move("compacted", 0, content=message)),
    )
    return assemble(_moves(records, moves), "codex", ("file_path", "path"), include_content, opened_=opened_)


# ---- Pi


def pi_directory(lines: DataFrame) -> Column:
    v = F.col("v")
    return F.when(text_at(v, "$.type") == "session", F.struct(text_at(v, "$.cwd").alias("cwd")))


def pi(lines: DataFrame, include_content: bool = False, opened_: Opened | None = None) -> DataFrame:
    v, m = F.col("v"), _variant(F.col("v"), "$.message")
    kind, role = text_at(v, "$.type"), text_at(m, "$.role")
    lines, here = _in_directory(lines, pi_directory(lines), opened_)
    stamped = lines.withColumns({"at_text": text_at(v, "$.timestamp"), "project": here, "record_key": _line_key()})
    records = stamped.where(F.coalesce(((kind == "session") | (kind == "message") & role.isin("user", "assistant", "toolResult", "bashExecution")), F.lit(False)) & F.try_to_timestamp("at_text").isNotNull())
    is_role = lambda r: (kind == "message") & (role == r)
    content = _variant(m, "$.content")
    blocks = F.transform(elements(content), lambda b, i: F.struct(b.alias("b"), (2 * i + 1).alias("ord")))
    calls = F.transform(F.filter(blocks, lambda x: F.coalesce((text_at(x["b"], "$.type") == "toolCall") & text_at(x["b"], "$.id").isNotNull() & text_at(x["b"], "$.name").isNotNull(), F.lit(False))), lambda x: _move("call", x["ord"], call_id=text_at(x["b"], "$.id"), tool_name=text_at(x["b"], "$.name"), tool_input=_variant(x["b"], "$.arguments")))
    bash = F.parse_json(F.to_json(F.struct(F.coalesce(text_at(m, "$.command"), F.lit("")).alias("command"))))
    own_call = F.concat(F.lit("bash-line-"), F.col("line"))
    code = F.when(F.schema_of_variant(_variant(m, "$.exitCode")) == "BIGINT", F.try_variant_get(m, "$.exitCode", "long"))
    bad = _flag(m, "$.cancelled") | F.coalesce(code != 0, F.lit(False))
    moves = F.concat(
        _some(
            (kind == "session", _move("start", -1)),
            (is_role("user"), _move("prompt", 0, content=content)),
            (is_role("assistant") & (F.length(F.regexp_replace(_joined_text(elements(content)), r"(?U)\s+", "")) > 0), _move("decision", 0, content=content)),
            (is_role("toolResult") & text_at(m, "$.toolCallId").isNotNull(), _move("result", 1, call_id=text_at(m, "$.toolCallId"), failed=_flag(m, "$.isError"), exit_code=_flag(m, "$.isError").cast("long"), content=content)),
            (is_role("bashExecution"), _move("call", 0, call_id=own_call, tool_name=F.lit("bash"), tool_input=bash)),
            (is_role("bashExecution"), _move("result", 1, call_id=own_call, failed=bad, exit_code=code, content=_variant(m, "$.output"))),
        ),
        F.when(is_role("assistant"), calls).otherwise(F.array().cast(f"array<{_MOVE}>")),
    )
    return assemble(_moves(records, moves), "pi", ("file_path", "path"), include_content, opened_=opened_)


# ---- OpenCode


def opencode_files(spark: SparkSession, root: str) -> DataFrame:
    """path, changed_at, level, parent, name of all files of a tree; Spark lists them, none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)
    at = F.split("path", "/")
    return listed.select("path", F.col("modificationTime").alias("changed_at"), F.element_at(at, -3).alias("level"), F.element_at(at, -2).alias("parent"), F.regexp_replace(F.element_at(at, -1), r"\.json$", "").alias("name"))


def opencode_changes(files: DataFrame, since, frontiers: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(sessions, paths): session of all sessions with a file changed since then, and the files to read of them: the session's own, its messages behind the frontier, their parts."""
    messages = files.where("level = 'message'").select(F.col("parent").alias("session"), F.col("name").alias("message"), "path", "changed_at")
    parts = files.where("level = 'part'").select(F.col("parent").alias("message"), F.col("path"), "changed_at").join(messages.select("message", "session"), "message")
    own = files.where("level = 'session'").select(F.col("name").alias("session"), F.lit(None).cast("string").alias("message"), "path", "changed_at")
    every = settle(own.unionByName(messages).unionByName(parts), "tree-files")
    sessions = every if since is None else every.where(F.col("changed_at") >= F.lit(since))
    sessions = settle(sessions.select("session").distinct(), "changed-sessions")
    wanted = every.join(sessions, "session", "left_semi")
    if frontiers is not None:
        wanted = wanted.join(small(frontiers.select(F.col("file").alias("session"), "head")), "session", "left").where("message is null or head is null or message > head")
    return sessions, wanted.select("path")


#: Files whose paths are handed to the reader one by one; of more than so many the tree is read and joined with them.
PATHS = 20_000


def opencode_texts(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """path, value: whole files of a tree, or those in paths."""
    reader = lambda: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    read = lambda *places: reader().text(list(places), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if paths is None:
        return read(root)
    paths = settle(paths, "paths")
    few = [r.path for r in paths.limit(PATHS + 1).collect()]
    if not few:
        return spark.createDataFrame([], "path string, value string")
    if len(few) <= PATHS:
        return read(*few)
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return read(root).join(paths.select(plain(F.col("path")).alias("__path")), plain(F.col("path")) == F.col("__path"), "left_semi")


def opencode(spark: SparkSession, root: str, include_content: bool = False, stored: DataFrame | None = None, frontiers: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Events of a tree of small JSON files: session/<project>/<id>, message/<session>/<id>, part/<message>/<id>.

    Messages count in the order of their ids, up to the first whose tools have not all ended (or, of an assistant,
    that is not completed): from there on a session is left for a later import, which goes on behind the frontier.
    frontiers: STATE rows, of which head is the last message taken; without them, what `stored` holds is left out.
    """
    return opencode_import(spark, root, include_content, stored, frontiers, texts)[0]


def opencode_import(spark: SparkSession, root: str, include_content: bool = False, stored: DataFrame | None = None, frontiers: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, messages taken: session, message, line)."""
    whole = opencode_texts(spark, root) if texts is None else texts
    path = F.split("path", "/")
    files = whole.select(F.element_at(path, -3).alias("level"), F.element_at(path, -2).alias("parent"), F.regexp_replace(F.element_at(path, -1), r"\.json$", "").alias("name"), F.try_parse_json("value").alias("v"))
    sessions = files.where("level = 'session' and v is not null").select(F.coalesce(text_at(F.col("v"), "$.id"), "name").alias("session"), text_at(F.col("v"), "$.directory").alias("project"), F.try_variant_get("v", "$.time.created", "long").alias("created"))
    # a message that can't be read stops its session like one that isn't finished
    messages = files.where("level = 'message'").select(F.col("parent").alias("session"), F.coalesce(text_at(F.col("v"), "$.id"), "name").alias("message"), F.col("v").isNull().alias("unread"), text_at(F.col("v"), "$.role").alias("role"), F.try_variant_get("v", "$.time.created", "long").alias("created"), F.try_variant_get("v", "$.time.completed", "long").alias("completed"))
    parts = files.where("level = 'part' and v is not null").select(F.col("parent").alias("message"), F.col("name").alias("part"), "v")
    status = text_at(F.col("v"), "$.state.status")
    is_tool = text_at(F.col("v"), "$.type") == "tool"
    listed = parts.groupBy("message").agg(F.array_sort(F.collect_list(F.struct("part", F.to_json("v").alias("j")))).alias("parts"), F.max((is_tool & ~F.coalesce(status.isin("completed", "error"), F.lit(False))).cast("int")).alias("open"))
    told = messages.join(listed, "message", "left").join(sessions.select("session", "project"), "session")
    if frontiers is not None:
        told = told.join(small(frontiers.select(F.col("file").alias("session"), "head", F.col("lines").alias("__lines"))), "session", "left").where("head is null or message > head")
    else:
        told = told.withColumn("__lines", F.lit(0).cast("long"))
    told = settle(told, "messages")
    deferred = F.col("unread") | (F.coalesce("open", F.lit(0)) == 1) | ((F.col("role") == "assistant") & F.col("completed").isNull())
    stops = told.where(deferred).groupBy("session").agg(F.min("message").alias("__stop"))
    told = told.join(stops, "session", "left").where("__stop is null or message < __stop").drop("__stop")
    told = positions(laid_out(told, ["session"], [F.col("message")]), ["session"], "__k").withColumn("line", F.col("__k") + 1 + F.coalesce("__lines", F.lit(0)))
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    records = told.select(F.col("session").alias("file"), "line", stamp(F.col("created")).alias("at_text"), "project", F.col("message").alias("record_key"), "role", F.transform(F.coalesce("parts", F.array().cast("array<struct<part:string,j:string>>")), lambda x: F.try_parse_json(x["j"])).alias("b")).where("at_text is not null")
    said = _joined_text(F.col("b"))
    placed = F.transform("b", lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    tools = F.filter(placed, lambda x: F.coalesce((text_at(x["b"], "$.type") == "tool") & text_at(x["b"], "$.tool").isNotNull(), F.lit(False)))
    ident = lambda x: F.coalesce(text_at(x["b"], "$.callID"), F.concat_ws("-", F.col("record_key"), x["i"]))
    both = F.flatten(F.transform(tools, lambda x: F.array(
        _move("call", 4 * x["i"] + 1, call_id=ident(x), tool_name=text_at(x["b"], "$.tool"), tool_input=_variant(x["b"], "$.state.input")),
        _move("result", 4 * x["i"] + 2, call_id=ident(x), failed=text_at(x["b"], "$.state.status") == "error", exit_code=(text_at(x["b"], "$.state.status") == "error").cast("long"), content=_variant(x["b"], "$.state.output")),
    )))
    moves = F.concat(_some(((F.col("role") == "user"), _move("prompt", 0)), ((F.col("role") == "assistant") & (said != ""), _move("decision", 0))), both)
    starts = sessions.where("created is not null").select(F.col("session").alias("file"), F.lit(0).cast("long").alias("line"), stamp(F.col("created")).alias("at_text"), "project", F.lit("session").alias("record_key"), F.array(_move("start", -1)).alias("moves"))
    every = _moves(records.withColumn("moves", moves), F.col("moves")).unionByName(_moves(starts, F.col("moves")))
    taken = told.select("session", "message", "line", "project")
    keys = ("filePath", "file_path", "path")
    none = F.lit(None)
    if frontiers is not None:
        readings = frontiers.select(*(c.split()[0] for c in STATE.split(", "))).withColumn("reset", F.lit(False))
    elif stored is not None:
        own = stored.where("source = 'opencode'")
        done = own.groupBy(F.try_variant_get("metadata", "$['opencode.source_file']", "string").alias("__file")).agg(F.max(F.try_variant_get("metadata", "$['opencode.line']", "long")).alias("lines"), (F.max("sequence") + 1).alias("next_sequence"))
        every = every.join(done.select("__file", "lines"), F.col("file") == F.col("__file"), "left").where("lines is null or line > lines").drop("__file", "lines")
        readings = done.select(F.col("__file").alias("file"), F.lit(0).alias("generation"), "lines", none.cast("long").alias("bytes"), none.cast("string").alias("head"), none.cast("int").alias("head_bytes"), "next_sequence", none.cast("string").alias("project"), F.lit(False).alias("reset"))
    else:
        return assemble(every, "opencode", keys, include_content), taken
    return assemble(every, "opencode", keys, include_content, opened_=Opened(every, settle(readings, "readings"), None)), taken


def opencode_states(events: DataFrame, taken: DataFrame, frontiers: DataFrame | None) -> DataFrame:
    """STATE rows of the sessions of which messages were taken: head is the last of them."""
    last = taken.groupBy(F.col("session").alias("file")).agg(F.max("line").alias("lines"), F.max("message").alias("head"), F.max_by("project", "line").alias("project"))
    sequences = events.groupBy("file").agg((F.max("sequence") + 1).alias("__next"))
    out = last.join(sequences, "file", "left")
    if frontiers is not None:
        out = out.join(frontiers.select("file", F.col("next_sequence").alias("__had")), "file", "left")
    else:
        out = out.withColumn("__had", F.lit(None).cast("long"))
    return out.select("file", F.lit(0).alias("generation"), "lines", F.lit(0).cast("long").alias("bytes"), "head", F.lit(0).alias("head_bytes"), F.greatest("__next", "__had").alias("next_sequence"), "project")


ADAPTERS = {"claude": claude, "codex": codex, "pi": pi}
DIRECTORIES = {"codex": codex_directory, "pi": pi_directory}
#: Lines of a file that one task looks through for the directory in force.
LINES_AT_ONCE = 65_536

