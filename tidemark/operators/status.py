"""Status of a store, cached detection, reports of evaluations, and the gate for candidates that others propose."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import detect, lifecycle, store
from tidemark.schema import GRAMMAR

CACHE_FORMAT = "findings/1"


def _scope(project: str | None) -> str:
    return hashlib.sha256((project or "").encode()).hexdigest()[:16]


def cache_key(events: DataFrame, thresholds: detect.Thresholds, project: str | None = None) -> tuple[str, str]:
    """Generation, which changes with the project's events, and key, which changes with the thresholds, the grammar and the format too."""
    seen = detect.fingerprint(events).first()
    generation = f"{_scope(project)}-" + hashlib.sha256("".join(f"{p}\0" for p in seen).encode()).hexdigest()
    parts = [CACHE_FORMAT, GRAMMAR, project or "", thresholds.min_occurrences, thresholds.min_sessions, thresholds.min_support_ratio_bps, *seen]
    return generation, hashlib.sha256("".join(f"{p}\0" for p in parts).encode()).hexdigest()


def detect_cached(events: DataFrame, cache: str, thresholds: detect.Thresholds = detect.Thresholds(), project: str | None = None, recompute: bool = False) -> DataFrame:
    """All candidate groups; read from `cache` (a shared folder) if they were computed for the same events and thresholds.

    A generation (what is cached for one state of the events) is deleted when another is written; other thresholds and
    projects of the same state stay.
    """
    spark = events.sparkSession
    if project is not None:
        events = events.where(F.col("project") == project)
    generation, key = cache_key(events, thresholds, project)
    path = f"{cache}/{generation}/{key}"
    if not recompute:
        try:
            return spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    detect.candidates(detect.with_operation(events), thresholds).write.mode("overwrite").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for old in files.listStatus(folder):
        if old.getPath().getName().startswith(f"{_scope(project)}-") and old.getPath().getName() != generation:
            files.delete(old.getPath(), True)
    return spark.read.parquet(path)


def status(events: DataFrame, log: DataFrame | None = None, installed: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """section, name, value: counts of the store, stale signatures, candidates by state, verdicts of what is installed."""
    ops = detect.with_operation(events)
    counted = store.counts(events=events, sessions=store.session_rollup(events), sources=store.source_rollup(events), signatures=ops.where("operation_key is not null"), stale_signatures=store.stale_signatures(ops, f"operation/{GRAMMAR}|"))
    out = counted.select(F.lit("store").alias("section"), F.col("table").alias("name"), F.col("rows").alias("value"))
    if log is not None:
        out = out.unionByName(lifecycle.state_counts(log).select(F.lit("candidates").alias("section"), F.col("state").alias("name"), F.col("mutations").alias("value")))
    if installed is not None and reports is not None:
        out = out.unionByName(lifecycle.efficacy_status(installed, reports).select(F.lit("efficacy").alias("section"), F.col("verdict").alias("name"), F.col("mutations").alias("value")))
    return out


def register_reports(new: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """new reports (key columns, content_hash) with outcome: inserted, duplicate (same bytes), conflict (other bytes)."""
    had = known.select(*key, F.col("content_hash").alias("__had"))
    out = new.join(had, key, "left")
    return out.withColumn("outcome", F.when(F.col("__had").isNull(), "inserted").when(F.col("__had") == F.col("content_hash"), "duplicate").otherwise("conflict")).drop("__had")


def inconsistent_reports(reports: DataFrame) -> DataFrame:
    """Reports (report_id, cited, registered: arrays of event ids) whose two lists are not the same set, or repeat an id."""
    same = (F.array_sort(F.array_distinct("cited")) == F.array_sort(F.array_distinct("registered"))) & (F.size("cited") == F.size(F.array_distinct("cited"))) & (F.size("registered") == F.size(F.array_distinct("registered")))
    return reports.where(~same)


def token_usage(runs: DataFrame) -> DataFrame:
    """input_tokens, output_tokens: sums, null where no run reported any."""
    return runs.agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def accept_proposals(findings: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates of a provider (finding_id, title, instruction), each with status and reason; the templates' own without one.

    A provider can word a candidate but not choose its id, trigger or evidence: those are taken from the finding.
    """
    own = lifecycle.generate(findings)
    if provider is None:
        return own
    told = provider(findings).select("finding_id", F.col("title").alias("__title"), F.col("instruction").alias("__said"))
    met = own.join(told, "finding_id", "left")
    fault = (
        F.when(F.col("status") != "candidate", F.col("reason"))
        .when(F.col("__said").isNull(), "no_proposal")
        .when((F.length(X.trimmed(F.col("__said"))) == 0) | (F.length(X.trimmed(F.col("__title"))) == 0), "blank_field")
        .when((F.length("__said") > 2_000) | (F.length("__title") > 200), "field_too_long")
        .when(X.redacted(F.col("__said")) != F.col("__said"), "secret_in_field")
    )
    return met.withColumn("reason", fault).withColumn("status", F.when(fault.isNull(), "candidate").otherwise("rejected")).withColumn("title", F.coalesce("__title", "title")).withColumn("instruction", F.coalesce("__said", "instruction")).drop("__title", "__said")
