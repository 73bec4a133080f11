"""Stored events: ingest with first-wins rules, roll-ups, counts, retention.

Order of ingest is the total order (ingest_seq, event_id, content_hash); the caller numbers rows. Nothing is updated in place: results are frames to be written.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASHED = ("spec_version", "event_id", "session_id", "occurred_at", "occurred_at_text", "sequence", "source", "type", "project", "parent_event_id", "tool", "artifacts", "metadata")


def content_hash() -> Column:
    """Hash of all that an event says; local to this engine."""
    return F.sha2(F.to_json(F.struct(*HASHED)), 256)


def hashed(events: DataFrame) -> DataFrame:
    return events.withColumn("content_hash", content_hash())


@dataclass
class Ingested:
    accepted: DataFrame
    duplicates: DataFrame
    conflicts: DataFrame
    rejected: DataFrame


def identities(events: DataFrame) -> DataFrame:
    """event_id, content_hash: what ingest asks of stored ids."""
    return events.select("event_id", "content_hash")


def places(events: DataFrame) -> DataFrame:
    """session_id, sequence, source, occurred_at, event_id: what ingest asks of stored sessions."""
    return events.select("session_id", "sequence", "source", "occurred_at", "event_id")


def ingest(batch: DataFrame, stored: DataFrame | None = None, order: tuple[str, ...] = ("ingest_seq",), ids: DataFrame | None = None, held_places: DataFrame | None = None) -> Ingested:
    """Split a batch (event columns, content_hash, the columns of order) into accepted, duplicate, conflicting and rejected rows.

    A row with a stored id is a duplicate if the content is equal, else a conflict (checked before all else); a
    session belongs to the source that was first in it; a sequence number in a session is taken once. Of rows that
    are equal in order and content one is accepted. ids, held_places: `identities` and `places` of the stored events that
    can matter to this batch, in place of all stored events.
    """
    ids = identities(stored) if ids is None and stored is not None else ids
    held_places = places(stored) if held_places is None and stored is not None else held_places
    keep = batch.columns
    place = F.struct(*order)
    batch = batch.withColumn("__place", place)
    old = None if ids is None else ids.select("event_id", F.col("content_hash").alias("__hash"))
    # one row for each id: the least in ingest order, found by a pre-aggregated minimum, not by sorting a key's rows
    first = batch.groupBy("event_id").agg(F.min(F.struct("__place", "content_hash")).alias("__first"))
    if old is not None:
        first = first.join(old, "event_id", "left").withColumn("__first", F.when(F.col("__hash").isNotNull(), F.struct(F.lit(None).cast(batch.schema["__place"].dataType).alias("__place"), F.col("__hash").alias("content_hash"))).otherwise(F.col("__first"))).drop("__hash")
    # rows that tie in all of this are few: the window numbers ties, not a key's rows
    tie = F.row_number().over(Window.partitionBy("event_id", "content_hash", "__place").orderBy("event_id"))
    known = batch.join(first, "event_id").withColumn("__tie", tie)
    is_first = F.coalesce(F.col("__place") == F.col("__first.__place"), F.lit(False)) & (F.col("content_hash") == F.col("__first.content_hash")) & (F.col("__tie") == 1)
    same = F.col("content_hash") == F.col("__first.content_hash")
    fresh = known.where(is_first)
    turn = F.struct("__place", "event_id")
    owners = fresh.groupBy("session_id").agg(F.min_by("source", turn).alias("__owner"))
    if held_places is not None:
        owned = held_places.groupBy("session_id").agg(F.min_by("source", F.struct("occurred_at", "event_id")).alias("__had"))
        owners = owners.join(owned, "session_id", "left").select("session_id", F.coalesce("__had", "__owner").alias("__owner"))
    fresh = fresh.join(owners, "session_id").withColumn("__reason", F.when(F.col("source") != F.col("__owner"), "session_source_conflict"))
    numbered_rows = fresh.where("sequence is not null and __reason is null")
    taken = numbered_rows.groupBy("session_id", "sequence").agg(F.min(turn).alias("__holder"))
    if held_places is not None:
        held = held_places.where("sequence is not null").select("session_id", "sequence", F.lit(True).alias("__held")).distinct()
        taken = taken.join(held, ["session_id", "sequence"], "left")
    else:
        taken = taken.withColumn("__held", F.lit(None).cast("boolean"))
    fresh = fresh.join(taken, ["session_id", "sequence"], "left")
    late = F.col("__holder").isNotNull() & (F.coalesce("__held", F.lit(False)) | (turn != F.col("__holder")))
    fresh = fresh.withColumn("__reason", F.coalesce("__reason", F.when(late, "sequence_conflict")))
    return Ingested(
        fresh.where("__reason is null").select(*keep),
        known.where(~is_first & same).select(*keep),
        known.where(~is_first & ~same).select(*keep),
        fresh.where("__reason is not null").select(*keep, F.col("__reason").alias("reason")),
    )


def quarantine(conflicts: DataFrame) -> DataFrame:
    """event_id, content_hash, observation_count, first_seen, last_seen."""
    return conflicts.groupBy("event_id", "content_hash").agg(F.count("*").alias("observation_count"), F.min("ingest_seq").alias("first_seen"), F.max("ingest_seq").alias("last_seen"))


def session_rollup(events: DataFrame) -> DataFrame:
    """session_id, source, project (first that is given), started_at, ended_at, first_event_at, last_event_at, events."""
    order = F.struct("occurred_at", "event_id")
    return events.groupBy("session_id").agg(
        F.min_by("source", order).alias("source"),
        F.min_by("project", F.when(F.col("project").isNotNull(), order)).alias("project"),
        F.min(F.when(F.col("type") == "session.started", F.col("occurred_at"))).alias("started_at"),
        F.max(F.when(F.col("type") == "session.ended", F.col("occurred_at"))).alias("ended_at"),
        F.min("occurred_at").alias("first_event_at"),
        F.max("occurred_at").alias("last_event_at"),
        F.count("*").alias("events"),
    )


def list_sessions(rollup: DataFrame, limit: int = 50) -> DataFrame:
    return rollup.orderBy(F.desc("last_event_at"), F.asc("session_id")).limit(limit)


def source_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"))


def adapter_activity(adapters: DataFrame, rollup: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """source, sessions, events, last_event_at, last_cursor_at: a row for each adapter, also for idle ones."""
    busy = rollup.groupBy("source").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("last_event_at").alias("last_event_at"))
    out = adapters.join(busy, "source", "left")
    moved = cursors.groupBy("source").agg(F.max("updated_at").alias("last_cursor_at")) if cursors is not None else None
    out = out.join(moved, "source", "left") if moved is not None else out.withColumn("last_cursor_at", F.lit(None).cast("timestamp"))
    return out.select("source", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("events", F.lit(0)).alias("events"), "last_event_at", "last_cursor_at")


def event_artifacts(events: DataFrame) -> DataFrame:
    """event_id, artifact_id, ordinal, type, path, uri, digest: an artifact named twice in an event keeps its first place."""
    each = events.select("event_id", F.posexplode("artifacts").alias("ordinal", "a"))
    key = F.sha2(F.to_json(F.struct(F.col("a.type"), F.col("a.path"), F.col("a.uri"), F.col("a.digest")), {"ignoreNullFields": "false"}), 256)
    return each.groupBy("event_id", F.concat(F.lit("art_"), key).alias("artifact_id")).agg(F.min("ordinal").cast("long").alias("ordinal"), *(F.first(f"a.{c}").alias(c) for c in ("type", "path", "uri", "digest")))


def artifacts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("artifact_id").agg(*(F.first(c).alias(c) for c in ("type", "path", "uri", "digest")), F.count("*").alias("events"))


def orphan_artifacts(known: DataFrame, bridge: DataFrame) -> DataFrame:
    return known.join(bridge.select("artifact_id").distinct(), "artifact_id", "left_anti")


def counts(**frames: DataFrame) -> DataFrame:
    """table, rows: a row for each frame."""
    parts = [f.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, f in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grammar_versions(signatures: DataFrame) -> DataFrame:
    from tidemark.functions.text import grammar_version

    return signatures.select(grammar_version(F.col("operation_key")).alias("grammar")).where("grammar is not null").distinct()


def stale_signatures(signatures: DataFrame, prefix: str) -> DataFrame:
    return signatures.where(F.col("operation_key").isNotNull() & ~F.col("operation_key").startswith(prefix))


def search_projection(events: DataFrame, index_tool_input: bool = False, metadata_keys: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """event_id, tool_text, metadata_text, operation_key: what may be searched; excluded paths have none."""
    from tidemark.functions.text import metadata_text
    from tidemark.operators.detect import with_operation
    from tidemark.operators.privacy import allowed

    rows = with_operation(events.where(allowed(exclude)))
    said = F.array(*(metadata_text(F.col("metadata"), k) for k in metadata_keys)).cast("array<string>")
    return rows.select("event_id", (F.to_json("tool.input") if index_tool_input else F.lit(None).cast("string")).alias("tool_text"), F.array_join(F.filter(F.array_compact(said), lambda x: x != ""), "\n").alias("metadata_text"), (F.col("operation_key") if index_tool_input else F.lit(None).cast("string")).alias("operation_key"))


def doomed_sessions(rollup: DataFrame, cutoff: Column, project: str | None = None) -> DataFrame:
    """Sessions whose last event is before cutoff."""
    out = rollup.where(F.col("last_event_at") < cutoff)
    return out if project is None else out.where(F.col("project") == project)


def prune(events: DataFrame, rollup: DataFrame, cutoff: Column, project: str | None = None, guarded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept events, doomed events). guarded: session_ids with evidence of an active installation; they stay."""
    doomed = doomed_sessions(rollup, cutoff, project).select("session_id")
    if guarded is not None:
        doomed = doomed.join(guarded.select("session_id").distinct(), "session_id", "left_anti")
    return events.join(doomed, "session_id", "left_anti"), events.join(doomed, "session_id", "left_semi")


def lost_evidence(cited: DataFrame, kept: DataFrame, owner: str) -> DataFrame:
    """Owners (of candidates, reports) that cite an event no longer kept: they go with it."""
    return cited.join(kept.select("event_id"), "event_id", "left_anti").select(owner).distinct()


def export(events: DataFrame) -> DataFrame:
    """One JSON line for each event, in order of time, session, sequence (null last) and id."""
    return events.orderBy("occurred_at", "session_id", F.asc_nulls_last("sequence"), "event_id").select(F.to_json(F.struct(*(c for c in HASHED if c in events.columns))).alias("value"))


def upsert_sources(known: DataFrame, seen: DataFrame) -> DataFrame:
    """adapter, instance_key, display_name, first_seen_at, last_seen_at: known sources with what is seen now; a new name replaces an old one, none replaces nothing."""
    both = known.withColumn("turn", F.lit(0)).unionByName(seen.withColumn("turn", F.lit(1)))
    name = F.max_by("display_name", F.when(F.col("display_name").isNotNull(), F.struct("turn", "last_seen_at", "display_name")))
    return both.groupBy("adapter", "instance_key").agg(name.alias("display_name"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def upsert_cursors(*cursors: DataFrame) -> DataFrame:
    """adapter, instance_key, origin, position, updated_at: the last write of each origin; of several at a time the greatest position."""
    rows = cursors[0]
    for more in cursors[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("adapter", "instance_key", "origin").agg(F.max_by("position", F.struct("updated_at", "position")).alias("position"), F.max("updated_at").alias("updated_at"))


def reindex(events: DataFrame, path: str, index_tool_input: bool = False, metadata_keys: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Write the search projection of all events anew at path and count: indexed, excluded. Run again, it writes the same."""
    rows = search_projection(events, index_tool_input, metadata_keys, exclude)
    rows.write.mode("overwrite").parquet(path)
    told = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    return told(events.sparkSession.read.parquet(path), "indexed").join(told(events, "events"), "one").select("indexed", (F.col("events") - F.col("indexed")).alias("excluded"))


def import_scope(projects: tuple[str, ...] = (), exclude_paths: tuple[str, ...] = ()) -> str:
    """Equal for imports with the same selection, in whatever order it is told."""
    return hashlib.sha256("\0".join(["privacy/v1", "projects", *(sorted(projects) or [""]), "exclusions", *(sorted(exclude_paths) or [""])]).encode()).hexdigest()


def within(text: Column, start: Column, end: Column) -> Column:
    """Whether a time that is text lies in a span, ends included; what can't be read as a time does not."""
    return F.coalesce(F.try_to_timestamp(text).between(start, end), F.lit(False))
