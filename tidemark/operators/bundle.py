"""Portable bundles of one candidate: build with redaction, parse with checks.

A bundle is a JSON document of bounded size (one candidate and the events it cites), so it is made on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import document_id
from tidemark.operators import lifecycle, store
from tidemark.operators.privacy import allowed, private
from tidemark.schema import EVENT

SPEC = "genome/0.1"
MAX_EVENTS = 10_000


def build(events: DataFrame, cited: list[str], package: dict, reports: list[dict], exclude: tuple[str, ...] = ()) -> dict:
    """The bundle of a candidate: its cited events, redacted and in order of id; an excluded or missing event is an error."""
    if len(cited) > MAX_EVENTS:
        raise ValueError("too many events for a bundle")
    wanted = events.where(F.col("event_id").isin(*cited))
    rows = private(wanted.where(allowed(exclude))).select("event_id", "redacted_fields", F.to_json(F.struct(*(c for c in events.columns))).alias("json")).orderBy("event_id").collect()
    if {r.event_id for r in rows} != set(cited):
        raise ValueError("an event is missing or excluded")
    body = {
        "spec_version": SPEC,
        "mutation": package,
        "evidence_events": [json.loads(r.json) for r in rows],
        "attestations": [{"kind": r["kind"], "set_hash": document_id("rpt", r), "report": r} for r in reports],
        "redaction": {"fields": int(sum(r.redacted_fields for r in rows))},
    }
    return {**body, "genome_id": document_id("gen", body)}


def parse(text: str) -> dict:
    """The bundle in a JSON text, if its version, id and report hashes are right."""
    bundle = json.loads(text)
    if bundle.get("spec_version") != SPEC:
        raise ValueError("unsupported version")
    body = {k: v for k, v in bundle.items() if k != "genome_id"}
    if bundle.get("genome_id") != document_id("gen", body):
        raise ValueError("the id does not match the content")
    if any(a["set_hash"] != document_id("rpt", a["report"]) for a in bundle["attestations"]):
        raise ValueError("a report was changed")
    return bundle


def origin(sources: DataFrame) -> DataFrame:
    """One row: the distinct sources in order, joined by +, or unknown."""
    return sources.select("source").distinct().agg(F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list("source")), "+"), F.lit("")), F.lit("unknown")).alias("origin"))


def take_in(spark: SparkSession, bundle: dict, registry: DataFrame, stored: DataFrame | None = None, exclude: tuple[str, ...] = ()) -> tuple[store.Ingested, DataFrame, DataFrame]:
    """Events taken in (redacted once more), the candidate with its outcome in the registry, and its attestations.

    bundle: as parse() returns it. An event that the store has with other content is a conflict, as in any import.
    """
    lines = spark.createDataFrame([(bundle["genome_id"], k, json.dumps(e)) for k, e in enumerate(bundle["evidence_events"])], "file string, line long, text string")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT)
    events = lines.select("file", "line", F.from_json("text", kind).alias("e")).select("file", "line", "e.*")
    clean = private(events.where(allowed(exclude)))
    taken = store.ingest(store.hashed(clean).withColumn("ingest_seq", F.col("line")), stored)
    package = bundle["mutation"]
    row = (package["mutation_id"], document_id("pkg", package), package.get("finding_id"), package.get("equivalence_key"))
    candidate = spark.createDataFrame([row], "mutation_id string, content_hash string, finding_id string, equivalence_key string")
    attested = spark.createDataFrame([(package["mutation_id"], a["kind"], a["set_hash"], json.dumps(a["report"])) for a in bundle["attestations"]], "mutation_id string, kind string, set_hash string, report string")
    return taken, lifecycle.register(candidate, registry), attested
