"""Imports into a store of tables that change together.

A store holds events with narrow tables beside them: ids (event_id, content_hash) and places (session, sequence, source), dealt to buckets
by event and by session, and states and open_calls of log files. An import reads only the buckets of its own ids, sessions and
files, never the stored events, and commits all tables at once. Batch and stream imports of one adapter share a store, in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.operators.commits import KEYS, Snapshot, Tables
from tidemark.operators.tables import scratch, settle
from tidemark.sources import jsonl, transcripts


def _latest(rows: DataFrame | None, files: DataFrame) -> DataFrame | None:
    """The newest state of each file: of all its versions, that of the last commit."""
    if rows is None:
        return None
    own = rows.join(files.withColumnRenamed("file", "__file"), F.col("file") == F.col("__file"), "left_semi")
    columns = [c for c in rows.columns if c != "file"]
    return own.groupBy("file").agg(F.max_by(F.struct(*columns), "version").alias("s")).select("file", "s.*")


def resume_of(base: Snapshot, lines: DataFrame) -> transcripts.Resume | None:
    """States and open calls of the files in lines, and the numbers of stored events in their sessions."""
    if "states" not in base.tables:
        return None
    files = settle(lines.select("file").distinct(), "files")
    states = settle(_latest(base.of_keys("states", files, ["file"]), files), "states")
    version = states.select(F.col("file").alias("__file"), F.col("version").alias("__version"))
    calls = base.of_keys("open_calls", files, ["file"]).join(version, (F.col("file") == F.col("__file")) & (F.col("version") == F.col("__version")), "left_semi")
    return transcripts.Resume(states.drop("version"), settle(calls.drop("version"), "open-calls"))


def index_of(base: Snapshot) -> jsonl.Index:
    ids = lambda batch: base.of_keys("ids", batch, ["event_id"])
    places = lambda batch: base.of_keys("places", batch, ["session_id"])
    return jsonl.Index(ids, places, base.notes.get("last_ingest", 0))


def take(tables: Tables, lines: DataFrame, normalize: Callable[..., DataFrame] | None = None, options: jsonl.ImportOptions | None = None, include_content: bool = False, run: tuple[str, int] | None = None, dry_run: bool = False) -> Snapshot:
    """Import lines as events, or as records that `normalize` makes events of, and commit. run: name and number of a batch that may be repeated; the second time it changes nothing."""
    base, options = tables.snapshot(), options or jsonl.ImportOptions()
    if run is not None and base.notes.get("runs", {}).get(run[0], -1) >= run[1]:
        return base
    with scratch():
        if normalize is None:
            done = jsonl.import_events(lines, options, index=index_of(base))
        else:
            lines = settle(lines, "taken-lines")
            resume = resume_of(base, lines)
            if resume is not None:
                session = transcripts.session_of(normalize.__name__, F.col("file")).alias("session_id")
                known = base.of_keys("places", lines.select(session), ["session_id"])
                resume.known = None if known is None else known.select("event_id", "sequence")
            done = jsonl.import_transcripts(lines, normalize, options, None, include_content, resume, index_of(base))
        return _commit(tables, base, done, options, run, {}, dry_run)


def _commit(tables: Tables, base: Snapshot, done: jsonl.Imported, options: jsonl.ImportOptions, run: tuple[str, int] | None, notes: dict, dry_run: bool) -> Snapshot:
    events = settle(done.events, "accepted")
    version = F.lit(base.version + 1).alias("version")
    append = {"events": events, "ids": store.identities(events), "places": store.places(events), "conflicts": done.conflicts, "diagnostics": done.diagnostics, "summaries": done.summary}
    append |= {name: done.frames[name].select("*", version) for name in ("states", "open_calls") if name in done.frames}
    last = events.agg(F.max("ingest_seq")).first()[0]
    notes = notes | {"last_ingest": max(base.notes.get("last_ingest", 0), last or 0)} | ({"runs": base.notes.get("runs", {}) | {run[0]: run[1]}} if run is not None else {})
    return tables.commit(base, append=append, notes=notes, keys=KEYS, dry_run=dry_run)


def take_tree(tables: Tables, root: str, options: jsonl.ImportOptions | None = None, include_content: bool = False, run: tuple[str, int] | None = None, dry_run: bool = False) -> Snapshot:
    """Import what is new in a tree of session, message and part files (transcripts.opencode), and commit.

    Only sessions with a file changed since the last import are looked at, and of them only messages behind the frontier are read.
    """
    base, options, spark = tables.snapshot(), options or jsonl.ImportOptions(), tables.spark
    if run is not None and base.notes.get("runs", {}).get(run[0], -1) >= run[1]:
        return base
    with scratch():
        files = settle(transcripts.opencode_files(spark, root), "tree")
        newest = files.agg(F.max("changed_at").alias("t")).select(F.date_format("t", SECONDS)).first()[0]
        since = base.notes.get("changed_at")
        since = None if since is None else F.to_timestamp(F.lit(since), SECONDS) - F.expr("interval 2 seconds")  # file times are coarse
        known = _latest(base.read("states"), base.read("states").select("file").distinct()) if "states" in base.tables else None
        known = None if known is None else settle(known.drop("version"), "frontiers")
        sessions, paths = transcripts.opencode_changes(files, since, known)
        if sessions.isEmpty():
            return base
        texts = settle(transcripts.opencode_texts(spark, root, paths), "texts")
        frontiers = None if known is None else settle(known.join(sessions.select(F.col("session").alias("file")), "file", "left_semi"), "frontiers")
        events, taken = transcripts.opencode_import(spark, root, include_content, None, frontiers, texts)
        events = settle(events, "tree-events")
        if events.isEmpty():
            return base
        done = jsonl.import_records(events, options, index=index_of(base))
        done.frames["states"] = transcripts.opencode_states(events, taken, frontiers)
        return _commit(tables, base, done, options, run, {"changed_at": newest}, dry_run)


SECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSS"
