"""Recurrence detectors: repeated failures, repeated corrections, repeated recoveries.

Findings carry counts; their evidence is a table of its own (finding_id, role, event), so that a signature
with a third of all events is never gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.ids import finding_id
from tidemark.schema import EVENT, FOLLOWED, GRAMMAR, LABEL_KEYS, OUTCOME_KEYS

FAILURE, CORRECTION, RECOVERY = "repeated_command_failure", "repeated_user_correction", "repeated_successful_recovery"
REFERENCE = ("event_id", "session_id", "occurred_at", "type", "project")


@dataclass(frozen=True)
class Thresholds:
    min_occurrences: int = 3
    min_sessions: int = 2
    min_support_ratio_bps: int = 0


def with_operation(events: DataFrame, label_keys: tuple[str, ...] = LABEL_KEYS, outcome_keys: tuple[str, ...] = OUTCOME_KEYS) -> DataFrame:
    """events with op (tool|command), operation_key, failure_signature, label and outcome; the keys name metadata, the first that is there counts."""
    op = X.operation(F.col("tool.name"), X.command_of(F.col("tool.input")), F.col("project"))
    outcome = F.lit(None).cast("string")
    for key in reversed(outcome_keys):
        outcome = F.when(F.try_variant_get("metadata", f"$['{key}']", "variant").isNotNull(), X.metadata_text(F.col("metadata"), key)).otherwise(outcome)
    return (
        events.withColumn("op", op)
        .withColumn("operation_key", X.operation_key(F.col("op")))
        .withColumn("failure_signature", F.when(F.col("type") == "tool.failed", X.failure_signature(F.col("op"), F.col("tool.exit_code"))))
        .withColumn("label", X.correction_label(F.col("metadata"), label_keys))
        .withColumn("outcome", outcome)
    )


def _tally(rows: DataFrame, key: str, n: str, sessions: str | None = None) -> DataFrame:
    """Counts by key. Sessions are counted in two steps, so that one key's rows are spread over its sessions."""
    if sessions is None:
        return rows.groupBy(key).agg(F.count("*").alias(n))
    return rows.groupBy(key, "session_id").agg(F.count("*").alias(n)).groupBy(key).agg(F.sum(n).alias(n), F.count("session_id").alias(sessions))


def failure_groups(ops: DataFrame) -> DataFrame:
    """signature, op, n, sessions, cx: failures by signature, with successes of the same operation anywhere as counterexamples."""
    failed = ops.where((F.col("type") == "tool.failed") & F.col("failure_signature").isNotNull())
    groups = _tally(failed.select(F.struct("failure_signature", "op").alias("k"), "session_id"), "k", "n", "sessions").select("k.failure_signature", "k.op", "n", "sessions")
    passed = _tally(ops.where((F.col("type") == "tool.completed") & F.col("op").isNotNull()), "op", "cx")
    return groups.join(passed, "op", "left").select(F.col("failure_signature").alias("signature"), "op", "n", "sessions", F.coalesce("cx", F.lit(0)).alias("cx"))


def correction_groups(ops: DataFrame) -> DataFrame:
    """signature, label, n, sessions, cx: corrections by label, with decisions that followed the rule as counterexamples."""
    groups = _tally(ops.where((F.col("type") == "user.corrected_agent") & F.col("label").isNotNull()), "label", "n", "sessions")
    heeded = _tally(ops.where((F.col("type") == "decision.recorded") & F.col("outcome").isin(*FOLLOWED) & F.col("label").isNotNull()), "label", "cx")
    return groups.join(heeded, "label", "left").select(F.concat(F.lit(f"correction/{GRAMMAR}|"), "label").alias("signature"), "label", "n", "sessions", F.coalesce("cx", F.lit(0)).alias("cx"))


def previous(rows: DataFrame, keys: list[str], chunk: Column, order: list[Column], wanted: Column, payload: Column, name: str, place: Column | None = None) -> DataFrame:
    """rows with `name`: the payload of the nearest earlier row of the same keys for which `wanted` holds. place: order as one sortable column, if it isn't that of sessions.

    Keys are cut into chunks (of ascending `chunk`), searched one by one; what a chunk ends with is carried into
    later ones by a window over chunks alone. A key with very many rows is thus spread over its chunks.
    """
    rows = rows.withColumn("__chunk", chunk)
    value = F.when(wanted, payload)
    within = Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*(F.coalesce(c, d) for c, d in _sortable(order))) if place is None else place
    ends = rows.where(wanted).groupBy(*keys, "__chunk").agg(F.max_by(payload, place).alias("__end"))
    chunks = rows.groupBy(*keys, "__chunk").agg(F.lit(1).alias("__one")).drop("__one")
    over = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.join(ends, [*keys, "__chunk"], "left").withColumn("__carried", F.last("__end", ignorenulls=True).over(over)).drop("__end")
    found = rows.withColumn("__near", F.last(value, ignorenulls=True).over(within)).join(carried, [*keys, "__chunk"], "left")
    return found.withColumn(name, F.coalesce("__near", "__carried")).drop("__near", "__carried", "__chunk")


def _sortable(order: list[Column]) -> list[tuple[Column, Column]]:
    low = {"occurred_at": F.lit("0001-01-01").cast("timestamp"), "sequence": F.lit(-1).cast("long"), "event_id": F.lit("")}
    return [(F.col(n), low[n]) for n in ("occurred_at", "sequence", "event_id")]


def session_order() -> list[Column]:
    """Order within a session: time, sequence (null first), id."""
    return [F.asc_nulls_first("occurred_at"), F.asc_nulls_first("sequence"), F.asc_nulls_first("event_id")]


def recoveries(ops: DataFrame, chunk: Column | None = None) -> DataFrame:
    """A row for each recovered operation: recovered, failure, step (structs of event references and op; step null: direct retry), signature."""
    chunk = F.to_date("occurred_at") if chunk is None else chunk
    tried = ops.where(F.col("type").isin("tool.completed", "tool.failed") & F.col("op").isNotNull()).select("session_id", "occurred_at", "sequence", "event_id", "type", "project", "op", "failure_signature")
    own = F.struct(*REFERENCE, "sequence", "op", "failure_signature")
    done = previous(tried, ["session_id"], chunk, session_order(), F.col("type") == "tool.completed", own, "step")
    both = previous(done, ["session_id", "op"], chunk, session_order(), F.lit(True), own, "before")
    found = both.where((F.col("type") == "tool.completed") & (F.col("before.type") == "tool.failed"))
    # the latest success lies between failure and recovery exactly if it comes after the failure; it is then of another operation
    place = lambda s: F.struct(*(F.coalesce(F.col(f"{s}.{c}"), d) for c, (_, d) in zip(("occurred_at", "sequence", "event_id"), _sortable([]))))
    step = F.when(F.col("step").isNotNull() & (place("step") > place("before")), F.col("step"))
    out = found.select(own.alias("recovered"), F.col("before").alias("failure"), step.alias("step"))
    signature = F.concat(F.lit(f"recovery/{GRAMMAR}|"), F.regexp_replace("failure.failure_signature", r"^failure/[^|]*\|", ""), F.lit("|via|"), F.col("step.op"))
    return out.withColumn("signature", signature)


def recovery_groups(found: DataFrame) -> DataFrame:
    """signature, failure_op, step_op, n, sessions, cx: motifs by signature, with direct retries of the same failure as counterexamples."""
    motifs = found.where("step is not null").select(F.struct("signature", F.col("failure.failure_signature").alias("failure_signature"), F.col("failure.op").alias("failure_op"), F.col("step.op").alias("step_op")).alias("k"), F.col("step.session_id").alias("session_id"))
    groups = _tally(motifs, "k", "n", "sessions").select("k.*", "n", "sessions")
    direct = _tally(found.where("step is null").select(F.col("failure.failure_signature").alias("failure_signature")), "failure_signature", "cx")
    return groups.join(direct, "failure_signature", "left").select("signature", "failure_op", "step_op", "n", "sessions", F.coalesce("cx", F.lit(0)).alias("cx"))


def scored(groups: DataFrame) -> DataFrame:
    """groups with ratio_bps and score_bps, in whole numbers."""
    ratio = F.expr("case when n + cx = 0 then 0 else n * 10000 div (n + cx) end")
    return groups.withColumn("ratio_bps", ratio).withColumn("score_bps", F.expr("least(10000, ratio_bps * 6 div 10 + least(n - 1, 6) * 500 + least(sessions - 1, 4) * 750)"))


def unmet_gate(t: Thresholds) -> Column:
    return F.when(F.col("n") < t.min_occurrences, "occurrences").when(F.col("sessions") < t.min_sessions, "distinct_sessions").when(F.col("ratio_bps") < t.min_support_ratio_bps, "support_ratio")


def candidates(ops: DataFrame, thresholds: Thresholds = Thresholds(), found: DataFrame | None = None) -> DataFrame:
    """All groups of the three detectors: finding_id, detector, signature, title, n, sessions, cx, ratio_bps, score_bps, unmet_gate."""
    found = recoveries(ops) if found is None else found
    parts = [
        (FAILURE, failure_groups(ops), F.concat(F.lit("Repeated command failure: "), X.truncated(X.operation_label(F.col("op"))))),
        (CORRECTION, correction_groups(ops), F.concat(F.lit("Repeated user correction: "), X.truncated(F.col("label")))),
        (RECOVERY, recovery_groups(found), F.concat(F.lit("Repeated successful recovery: "), X.truncated(F.concat(X.operation_label(F.col("failure_op")), F.lit(" via "), X.operation_label(F.col("step_op")))))),
    ]
    rows = reduce(DataFrame.unionByName, (g.select(F.lit(d).alias("detector"), "signature", title.alias("title"), "n", "sessions", "cx") for d, g, title in parts))
    return scored(rows).withColumn("unmet_gate", unmet_gate(thresholds)).withColumn("finding_id", finding_id(F.col("detector"), F.col("signature")))


def findings(groups: DataFrame) -> DataFrame:
    return groups.where("unmet_gate is null").drop("unmet_gate")


def observations(groups: DataFrame, limit: int = 5) -> DataFrame:
    """The nearest misses."""
    return groups.where("unmet_gate is not null").orderBy(F.desc("n"), F.desc("sessions"), F.desc("score_bps"), F.asc("signature"), F.asc("detector")).limit(limit)


def evidence(ops: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """finding_id, role (evidence or counterexample) and event references: a row for each event of a group, once."""
    found = recoveries(ops) if found is None else found
    refs = [F.col(c) for c in REFERENCE]
    failed = ops.where((F.col("type") == "tool.failed") & F.col("failure_signature").isNotNull())
    out = [failed.select(finding_id(FAILURE, F.col("failure_signature")).alias("finding_id"), F.lit("evidence").alias("role"), *refs)]
    kinds = failed.select("op", "failure_signature").distinct()
    out.append(ops.where((F.col("type") == "tool.completed") & F.col("op").isNotNull()).select("op", *refs).join(kinds, "op").select(finding_id(FAILURE, F.col("failure_signature")).alias("finding_id"), F.lit("counterexample").alias("role"), *refs))
    rule = finding_id(CORRECTION, F.concat(F.lit(f"correction/{GRAMMAR}|"), "label")).alias("finding_id")
    corrected = ops.where((F.col("type") == "user.corrected_agent") & F.col("label").isNotNull())
    out.append(corrected.select(rule, F.lit("evidence").alias("role"), *refs))
    out.append(ops.where((F.col("type") == "decision.recorded") & F.col("outcome").isin(*FOLLOWED)).join(corrected.select("label").distinct(), "label", "left_semi").select(rule, F.lit("counterexample").alias("role"), *refs))
    motif = found.where("step is not null").select("signature", F.explode(F.array("failure", "step", "recovered")).alias("e")).select(finding_id(RECOVERY, F.col("signature")).alias("finding_id"), F.lit("evidence").alias("role"), *(F.col(f"e.{c}") for c in REFERENCE))
    out.append(motif.dropDuplicates(["finding_id", "event_id"]))
    motifs = found.where("step is not null").select("signature", F.col("failure.failure_signature").alias("failure_signature")).distinct()
    direct = found.where("step is null").select(F.col("failure.failure_signature").alias("failure_signature"), F.explode(F.array("failure", "recovered")).alias("e")).join(motifs, "failure_signature")
    out.append(direct.select(finding_id(RECOVERY, F.col("signature")).alias("finding_id"), F.lit("counterexample").alias("role"), *(F.col(f"e.{c}") for c in REFERENCE)).dropDuplicates(["finding_id", "event_id"]))
    return reduce(DataFrame.unionByName, out)


def scan_report(events: DataFrame, groups: DataFrame) -> DataFrame:
    """events, sessions, candidates: one row."""
    seen = events.groupBy("session_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("session_id").alias("sessions"))
    tried = groups.agg(F.count("*").alias("candidates"))
    return seen.withColumn("one", F.lit(1)).join(tried.withColumn("one", F.lit(1)), "one").drop("one")


def fingerprint(events: DataFrame) -> DataFrame:
    """events, sessions, last_event_at, last_ingest, last_import: changes when the events do.

    last_ingest is the greatest ingest_seq, or a sum over all that the events say where they have none; last_import
    the latest imported_at, null where events have none.
    """
    told = F.max("ingest_seq").cast("decimal(38,0)") if "ingest_seq" in events.columns else F.sum(F.xxhash64(F.to_json(F.struct(*(c for c in EVENT.names if c in events.columns)))).cast("decimal(38,0)"))
    stamp = F.max("imported_at") if "imported_at" in events.columns else F.lit(None).cast("timestamp")
    by_session = events.groupBy("session_id").agg(F.count("*").alias("n"), F.max("occurred_at").alias("t"), told.alias("told"), stamp.alias("stamp"))
    whole = F.max("told") if "ingest_seq" in events.columns else F.sum("told")
    return by_session.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count("session_id").alias("sessions"), F.max("t").alias("last_event_at"), whole.cast("decimal(38,0)").alias("last_ingest"), F.max("stamp").alias("last_import"))
