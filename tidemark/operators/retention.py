"""Deletion of sessions with all that rests on them. Frames go in and the frames to keep come out; `commit_deletion` and `commit_prune` write them, all tables at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import store
from tidemark.operators.commits import KEYS, Snapshot, Tables
from tidemark.operators.tables import settle


@dataclass
class Store:
    """What a store holds. evidence, replays, shadows: mutation_id, event_id of what is cited; efficacy: efficacy_id, mutation_id, event_id.

    dependents: frames by name that go with their mutation_id (candidates, transitions, attestations).
    installed: mutation_id of active installations.
    """

    events: DataFrame
    evidence: DataFrame
    replays: DataFrame | None = None
    shadows: DataFrame | None = None
    efficacy: DataFrame | None = None
    installed: DataFrame | None = None
    dependents: dict[str, DataFrame] = field(default_factory=dict)

    def cited(self) -> DataFrame:
        """mutation_id, event_id of the three chains of evidence that a mutation's state rests on."""
        chains = [x.select("mutation_id", "event_id") for x in (self.evidence, self.replays, self.shadows) if x is not None]
        return reduce(DataFrame.unionByName, chains).distinct()


def guarded_sessions(held: Store) -> DataFrame:
    """session_id of all sessions with an event that an active installation rests on."""
    active = held.cited().join(held.installed.select("mutation_id").distinct(), "mutation_id", "left_semi")
    return held.events.join(active.select("event_id").distinct(), "event_id", "left_semi").select("session_id").distinct()


def blocked(held: Store, sessions: DataFrame) -> DataFrame:
    """mutation_id of active installations that forbid the deletion of these sessions."""
    doomed = held.events.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("event_id")
    return held.cited().join(held.installed.select("mutation_id").distinct(), "mutation_id", "left_semi").join(doomed, "event_id", "left_semi").select("mutation_id").distinct()


def cascade(held: Store, kept: DataFrame) -> Store:
    """The store with these events alone: a mutation that has lost any event it cites goes, with all that depends on it; of efficacy only the report.

    Reports of a mutation that goes, go too; the depth is fixed, so that nothing is iterated.
    """
    lost = store.lost_evidence(held.cited(), kept, "mutation_id")
    alive = lambda x: None if x is None else x.join(lost, "mutation_id", "left_anti")
    efficacy = alive(held.efficacy)
    if efficacy is not None:
        efficacy = efficacy.join(store.lost_evidence(efficacy.select("efficacy_id", "event_id"), kept, "efficacy_id"), "efficacy_id", "left_anti")
    return Store(kept, alive(held.evidence), alive(held.replays), alive(held.shadows), efficacy, alive(held.installed), {k: alive(x) for k, x in held.dependents.items()})


def delete_sessions(held: Store, sessions: DataFrame) -> Store:
    """The store without these sessions (session_id); an active installation that rests on them is an error. Unknown sessions change nothing."""
    if held.installed is not None and (stop := blocked(held, sessions).orderBy("mutation_id").first()) is not None:
        raise ValueError(f"an active installation rests on this evidence: {stop.mutation_id}")
    return cascade(held, held.events.join(sessions.select("session_id").distinct(), "session_id", "left_anti"))


def delete_all(held: Store) -> Store:
    """The empty store; any active installation is an error."""
    if held.installed is not None and not held.installed.isEmpty():
        raise ValueError("there is an active installation")
    return cascade(held, held.events.limit(0))


def deletion_summary(before: Store, after: Store) -> DataFrame:
    """events_deleted, artifacts_deleted, mutations_deleted: one row, for a report or a dry run."""
    count = lambda df: df.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    parts = {"events": lambda s: s.events, "artifacts": lambda s: store.artifacts(store.event_artifacts(s.events)), "mutations": lambda s: s.evidence.select("mutation_id").distinct()}
    rows = None
    for name, of in parts.items():
        gone = count(of(before)).join(count(of(after)).withColumnRenamed("n", "m"), "one").select("one", (F.col("n") - F.col("m")).alias(f"{name}_deleted"))
        rows = gone if rows is None else rows.join(gone, "one")
    return rows.drop("one")


def _held(base: Snapshot) -> Store:
    table = lambda name, schema: base.read(name) if name in base.tables else base.spark.createDataFrame([], schema)
    cited = "mutation_id string, event_id string"
    dependents = {n: base.read(n) for n in ("candidates", "transitions", "attestations") if n in base.tables}
    return Store(base.read("events"), table("evidence", cited), table("replays", cited), table("shadows", cited), table("efficacy", f"efficacy_id string, {cited}"), table("installed", "mutation_id string"), dependents)


def commit_deletion(tables: Tables, sessions: DataFrame | None, dry_run: bool = False) -> DataFrame:
    """Delete sessions (None: all) with what rests on them from the tables of a store, in one commit: its summary, as a settled table.

    The narrow tables of ids and places go with their events. dry_run: the summary alone.
    """
    base = tables.snapshot()
    before = _held(base)
    after = delete_all(before) if sessions is None else delete_sessions(before, sessions)
    summary = settle(deletion_summary(before, after), "deleted")
    if not dry_run:
        kept = settle(after.events, "kept-events")
        frames = {"events": kept, "ids": store.identities(kept), "places": store.places(kept), "evidence": after.evidence, "replays": after.replays, "shadows": after.shadows, "efficacy": after.efficacy, "installed": after.installed, **after.dependents}
        tables.commit(base, replace={n: f for n, f in frames.items() if n in base.tables}, keys=KEYS)
    return summary


def commit_prune(tables: Tables, cutoff: Column, project: str | None = None, dry_run: bool = False) -> DataFrame:
    """Delete the sessions that ended before cutoff, but for those an active installation rests on."""
    held = _held(tables.snapshot())
    doomed = store.doomed_sessions(store.session_rollup(held.events), cutoff, project).select("session_id")
    return commit_deletion(tables, doomed.join(guarded_sessions(held), "session_id", "left_anti"), dry_run)
