"""Generic JSONL events: strict decoding, validation with all errors, import with counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import privacy, store
from tidemark.operators.tables import settle
from tidemark.schema import ARTIFACT_TYPES, EVENT_TYPES, SPEC_VERSION, TOOL_TYPES
from tidemark.sources import transcripts
from tidemark.sources.lines import elements, text_at

# fixed values: fields of the wire format and the kinds of JSON value they take; a star marks those required
FIELDS = {"spec_version*": "STRING", "event_id*": "STRING", "session_id*": "STRING", "timestamp*": "STRING", "sequence": "BIGINT", "source*": "STRING", "type*": "STRING", "project": "STRING", "parent_event_id": "STRING", "tool": "OBJECT", "artifacts": "ARRAY", "metadata": "OBJECT"}
TOOL_FIELDS = {"name*": "STRING", "input": "", "exit_code": "BIGINT", "duration_ms": "BIGINT", "metadata": "OBJECT"}
ARTIFACT_FIELDS = {"type*": "STRING", "path": "STRING", "uri": "STRING", "digest": "STRING", "metadata": "OBJECT"}
NOT_NULL = ("artifacts", "metadata")
_ID = r"[A-Za-z0-9._:-]{1,127}$"


def _shape(v: Column, fields: dict[str, str]) -> Column:
    """Whether an object has no other fields than these, and these have the right kinds."""
    ok = F.coalesce(F.size(F.array_except(F.json_object_keys(F.to_json(v)), F.array(*(F.lit(f.rstrip("*")) for f in fields)))) == 0, F.lit(False))
    for name, kind in fields.items():
        value = F.try_variant_get(v, f"$.{name.rstrip('*')}", "variant")
        right = F.lit(True) if not kind else F.schema_of_variant(value).startswith(kind)
        if not name.endswith("*"):
            right = value.isNull() | right if name in NOT_NULL else value.isNull() | (F.schema_of_variant(value) == "VOID") | right
        ok = ok & F.coalesce(right, F.lit(False))
    return ok


def decode(lines: DataFrame) -> DataFrame:
    """file, line, well_formed, event columns: typed where the line has the format's shape."""
    v = F.col("v")
    tool, parts = F.try_variant_get(v, "$.tool", "variant"), elements(F.try_variant_get(v, "$.artifacts", "variant"))
    has_tool = F.coalesce(F.schema_of_variant(tool).startswith("OBJECT"), F.lit(False))
    stamp = text_at(v, "$.timestamp")
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & _shape(v, FIELDS) & (~has_tool | _shape(tool, TOOL_FIELDS)) & F.forall(parts, lambda a: F.coalesce(F.schema_of_variant(a).startswith("OBJECT"), F.lit(False)) & _shape(a, ARTIFACT_FIELDS) & F.coalesce(text_at(a, "$.type").isin(*ARTIFACT_TYPES), F.lit(False)))
    ok = ok & F.coalesce((text_at(v, "$.spec_version") == SPEC_VERSION) & text_at(v, "$.type").isin(*EVENT_TYPES) & F.try_to_timestamp(stamp).isNotNull(), F.lit(False))
    ok = ok & F.coalesce(F.try_variant_get(v, "$.sequence", "long") >= 0, F.lit(True)) & F.coalesce(F.try_variant_get(tool, "$.duration_ms", "long") >= 0, F.lit(True))
    return lines.select(
        "file", "line", F.coalesce(ok, F.lit(False)).alias("well_formed"),
        *(text_at(v, f"$.{c}").alias(c) for c in ("spec_version", "event_id", "session_id")),
        F.try_to_timestamp(stamp).alias("occurred_at"), stamp.alias("occurred_at_text"), F.try_variant_get(v, "$.sequence", "long").alias("sequence"),
        *(text_at(v, f"$.{c}").alias(c) for c in ("source", "type", "project", "parent_event_id")),
        F.when(has_tool, F.struct(text_at(tool, "$.name").alias("name"), F.try_variant_get(tool, "$.input", "variant").alias("input"), F.try_variant_get(tool, "$.exit_code", "long").alias("exit_code"), F.try_variant_get(tool, "$.duration_ms", "long").alias("duration_ms"), F.try_variant_get(tool, "$.metadata", "variant").alias("metadata"))).alias("tool"),
        F.transform(parts, lambda a: F.struct(text_at(a, "$.type").alias("type"), text_at(a, "$.path").alias("path"), text_at(a, "$.uri").alias("uri"), text_at(a, "$.digest").alias("digest"), F.try_variant_get(a, "$.metadata", "variant").alias("metadata"))).alias("artifacts"),
        F.try_variant_get(v, "$.metadata", "variant").alias("metadata"),
    )


def _error(when: Column, path: str, code: str) -> Column:
    return F.when(when, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))


def _blank(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)\s+", "")) == 0


def validation_errors() -> Column:
    """All (path, code) of an event's broken rules."""
    tool, code = F.col("tool"), F.col("tool.exit_code")
    rules = [
        _error(~F.col("event_id").rlike("^evt_" + _ID), "event_id", "invalid_id"),
        _error(~F.col("session_id").rlike("^ses_" + _ID), "session_id", "invalid_id"),
        _error(~F.col("parent_event_id").rlike("^evt_" + _ID), "parent_event_id", "invalid_id"),
        _error(F.col("parent_event_id") == F.col("event_id"), "parent_event_id", "self_parent"),
        _error(_blank(F.col("source")), "source", "blank"),
        _error(F.length("source") > 128, "source", "too_long"),
        _error(_blank(F.col("project")), "project", "blank"),
        _error(F.col("type").isin(*TOOL_TYPES) & tool.isNull(), "tool", "required"),
        _error((F.col("type") == "tool.called") & code.isNotNull(), "tool.exit_code", "not_allowed"),
        _error((F.col("type") == "tool.completed") & (code != 0), "tool.exit_code", "expected_zero"),
        _error((F.col("type") == "tool.failed") & tool.isNotNull() & code.isNull(), "tool.exit_code", "required"),
        _error((F.col("type") == "tool.failed") & (code == 0), "tool.exit_code", "expected_nonzero"),
        _error(_blank(F.col("tool.name")), "tool.name", "blank"),
        _error(F.length("tool.name") > 128, "tool.name", "too_long"),
        _error(F.size("artifacts") > 256, "artifacts", "too_many"),
        _error(F.exists("artifacts", lambda a: F.coalesce(a["path"], a["uri"], a["digest"]).isNull()), "artifacts", "missing_locator"),
        _error(F.exists("artifacts", lambda a: F.coalesce(_blank(a["path"]), F.lit(False)) | F.coalesce(_blank(a["uri"]), F.lit(False)) | F.coalesce(_blank(a["digest"]), F.lit(False))), "artifacts", "blank"),
    ]
    return F.array_compact(F.array(*rules))


@dataclass
class ImportOptions:
    projects: Sequence[str] = ()
    exclude_paths: Sequence[str] = ()
    max_diagnostics: int = 100


@dataclass
class Imported:
    events: DataFrame
    diagnostics: DataFrame
    conflicts: DataFrame
    summary: DataFrame
    frames: dict = field(default_factory=dict)


def import_events(lines: DataFrame, options: ImportOptions = ImportOptions(), stored: DataFrame | None = None, index: Index | None = None) -> Imported:
    """Decode, select projects, apply privacy, then take in by the first-wins rules, in the order of (file, line).

    summary: one row of counters. diagnostics: file, line, code; at most max_diagnostics are listed, all are counted.
    """
    # each step is long, and its result is used several times
    return _import(settle(decode(lines), "decoded"), lines, options, stored, index)


def import_transcripts(lines: DataFrame, normalize: Callable[..., DataFrame], options: ImportOptions = ImportOptions(), stored: DataFrame | None = None, include_content: bool = False, resume: transcripts.Resume | None = None, index: Index | None = None) -> Imported:
    """The same for a transcript's lines: `normalize` (one of transcripts.ADAPTERS) makes events of those not read before.

    What was read before is told by `resume`, or else by the stored events. frames: states and open_calls, the resume of a later import.
    """
    adapter = normalize.__name__
    if resume is None and stored is not None:
        resume = transcripts.resume_of(stored, adapter)
    opened = transcripts.opened(lines, resume)
    opened.lines = settle(opened.lines, "unread")
    events = settle(normalize(opened.lines, include_content, opened).withColumn("well_formed", F.col("occurred_at").isNotNull()), "decoded")
    told = transcripts.directories(opened.lines, transcripts.DIRECTORIES[adapter](opened.lines)) if adapter in transcripts.DIRECTORIES else None
    states, open_calls = transcripts.states_after(opened, events, adapter, told)
    done = _import(events, events, options, stored, index)
    done.frames |= {"states": states, "open_calls": open_calls}
    return done


def import_records(events: DataFrame, options: ImportOptions = ImportOptions(), stored: DataFrame | None = None, index: Index | None = None) -> Imported:
    """The same for events that a source has made already (file, line and the envelope)."""
    made = settle(events.withColumn("well_formed", F.col("occurred_at").isNotNull()), "decoded")
    return _import(made, made, options, stored, index)


@dataclass
class Index:
    """What a store knows of a batch: ids and places of stored events that can meet it, by functions of the batch; the last number given."""

    ids: Callable[[DataFrame], DataFrame | None]
    places: Callable[[DataFrame], DataFrame | None]
    last_ingest: int = 0


def _import(decoded: DataFrame, lines: DataFrame, options: ImportOptions, stored: DataFrame | None, index: Index | None = None) -> Imported:
    decoded = settle(decoded.withColumn("errors", F.when(F.col("well_formed"), validation_errors())), "checked")
    rejected = decoded.where("not well_formed or size(errors) > 0").select("file", "line", F.when(F.col("well_formed"), "invalid_event").otherwise("invalid_json").alias("code"), "errors")
    valid = decoded.where("well_formed and size(errors) = 0").drop("errors", "well_formed")
    wanted = valid.where(privacy.selected(options.projects))
    clean = privacy.private(wanted, options.exclude_paths)
    clean = settle(clean, "clean")
    # files in the order of their names, their lines in order; the number counts lines from those stored before
    last = index.last_ingest if index is not None else 0 if stored is None or "ingest_seq" not in stored.columns else stored.agg(F.coalesce(F.max("ingest_seq"), F.lit(0))).first()[0]
    batch = settle(store.hashed(clean.withColumns({"ingest_seq": F.col("line") + last, "imported_at": F.current_timestamp()})), "batch")
    taken = store.ingest(batch, stored, ("file", "line")) if index is None else store.ingest(batch, None, ("file", "line"), index.ids(batch), index.places(batch))
    taken = store.Ingested(*(settle(x, "taken") for x in (taken.accepted, taken.duplicates, taken.conflicts, taken.rejected)))
    stored_rejects = taken.rejected.select("file", "line", F.lit("store_rejected").alias("code"), F.array(F.struct(F.lit("").alias("path"), F.col("reason").alias("code"))).alias("errors"))
    problems = rejected.unionByName(stored_rejects)
    count = lambda df, name, e=F.count("*"): df.agg(F.coalesce(e, F.lit(0)).cast("long").alias("value")).select(F.lit(name).alias("counter"), "value")
    parts = [
        count(lines, "events_read"), count(valid, "decoded"), count(wanted, "selected"), count(clean, "validated"), count(taken.accepted, "inserted"), count(taken.duplicates, "duplicates"), count(taken.conflicts, "conflicts"),
        count(problems, "rejected"), count(clean, "redacted_fields", F.sum("redacted_fields")),
    ]
    summary = parts[0]
    for p in parts[1:]:
        summary = summary.unionByName(p)
    summary = summary.groupBy().pivot("counter", ["events_read", "decoded", "selected", "validated", "inserted", "duplicates", "conflicts", "rejected", "redacted_fields"]).agg(F.first("value"))
    summary = summary.select("events_read", "validated", "inserted", "duplicates", "conflicts", (F.col("decoded") - F.col("selected")).alias("skipped"), (F.col("selected") - F.col("validated")).alias("privacy_skipped"), "redacted_fields", "rejected", F.greatest(F.col("rejected") - options.max_diagnostics, F.lit(0)).alias("suppressed_diagnostics"))
    return Imported(taken.accepted, problems.orderBy("file", "line").limit(options.max_diagnostics), taken.conflicts, summary, {"rejected": problems, "duplicates": taken.duplicates})
