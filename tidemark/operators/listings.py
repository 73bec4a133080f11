"""Listings in the orders that readers expect, and the parts of a store that an inspector shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.detect import session_order


def signature_hits(hits: DataFrame) -> DataFrame:
    return hits.orderBy(F.desc("occurred_at"), F.asc("event_id"))


def findings(found: DataFrame) -> DataFrame:
    return found.orderBy("finding_id")


def mutations(rows: DataFrame, by: str = "updated_at") -> DataFrame:
    """Latest first: by updated_at as a list, by created_at as an inspector shows them."""
    return rows.orderBy(F.desc(by), F.asc("mutation_id"))


def results(rows: DataFrame, key: str) -> DataFrame:
    """Results of scenarios or observations by their id."""
    return rows.orderBy("mutation_id", key) if "mutation_id" in rows.columns else rows.orderBy(key)


def generated(outcomes: DataFrame) -> DataFrame:
    """Outcomes of generation by mutation, those without one by finding."""
    return outcomes.orderBy(F.coalesce("mutation_id", "finding_id"))


def session_events(events: DataFrame, session_id: str) -> DataFrame:
    return events.where(F.col("session_id") == session_id).orderBy(*session_order())


def evidence_links(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """evidence with `present`: whether the store still has the event, whose type and time are told."""
    there = events.select("event_id", "type", "occurred_at", F.lit(True).alias("present"))
    return evidence.join(there, "event_id", "left").withColumn("present", F.coalesce("present", F.lit(False)))


def attested(attestations: DataFrame) -> DataFrame:
    """mutation_id of all that have an attestation."""
    return attestations.select("mutation_id").distinct()


def evidence_packet(evidence: DataFrame, events: DataFrame, finding: str) -> DataFrame:
    """The references of one finding, evidence before counterexamples, each with whether it is present."""
    return evidence_links(evidence.where(F.col("finding_id") == finding).select("finding_id", "role", "event_id"), events).orderBy(F.desc("role"), "occurred_at", "event_id")


def evidence_ids(*cited: DataFrame) -> DataFrame:
    """event_id of all that any of the frames cites, once."""
    out = cited[0].select("event_id")
    for x in cited[1:]:
        out = out.union(x.select("event_id"))
    return out.distinct()


def sorted_selectors(column: str = "selectors"):
    return F.array_sort(F.array_distinct(column))
