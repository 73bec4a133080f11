"""Lesson candidates and their lifecycle: generation, validation, registry, replay, shadow and efficacy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.ids import equivalence_key, hashed, mutation_id
from tidemark.operators.chunks import laid_out, near, positions
from tidemark.operators.detect import CORRECTION, FAILURE, RECOVERY, session_order
from tidemark.operators.tables import settle

# fixed values: states in order of promotion, and the moves allowed between them
EDGES = (
    ("candidate", "challenged"), ("challenged", "replay_passed"), ("replay_passed", "shadow_passed"), ("shadow_passed", "active"), ("active", "retired"),
    ("candidate", "rejected"), ("challenged", "rejected"), ("replay_passed", "rejected"), ("shadow_passed", "rejected"),
)
MINIMUM_REPLAYS, MINIMUM_SUCCESS_BPS, MAXIMUM_FALSE_BPS, MINIMUM_OBSERVATIONS = 5, 8_000, 1_000, 5
CHECKS = 6


# ---- generation and registry


def generate(findings: DataFrame) -> DataFrame:
    """A candidate for each finding, or status insufficient_evidence with a reason.

    finding_id, status, reason, mutation_id, equivalence_key, detector, selector, trigger_kind, title, instruction.
    """
    failure = r"(?s)^failure/v2\|([^|]*)\|(.*)\|exit:(-?\d+)$"
    recovery = r"(?s)^recovery/v2\|([^|]*)\|(.*?)\|exit:(-?\d+)\|via\|([^|]*)\|(.*)$"
    part = lambda p, k: F.regexp_extract("signature", p, k)
    rule = F.trim(F.regexp_extract("signature", r"(?s)^correction/v2\|(.*)$", 1))
    blank = lambda *cs: sum((F.length(X.trimmed(c)) == 0).cast("int") for c in cs) > 0
    concrete = (
        F.when(F.col("detector") == FAILURE, F.col("signature").rlike(failure) & ~blank(part(failure, 1), part(failure, 2)))
        .when(F.col("detector") == CORRECTION, F.length(rule) > 0)
        .when(F.col("detector") == RECOVERY, F.col("signature").rlike(recovery) & ~blank(part(recovery, 2), part(recovery, 5)))
    )
    advice = (
        F.when(F.col("detector") == FAILURE, F.format_string("Check what `%s` needs before it runs. After exit code %s change its inputs or the plan; a plain retry is no fix.", part(failure, 2), part(failure, 3)))
        .when(F.col("detector") == CORRECTION, F.format_string("Follow the user's rule: %s.", rule))
        .when(F.col("detector") == RECOVERY, F.format_string("Before `%s`, see whether what `%s` restores is missing; only then run `%s` first.", part(recovery, 2), part(recovery, 5), part(recovery, 5)))
    )
    title = F.when(F.col("detector") == RECOVERY, F.regexp_replace("title", "^Repeated successful recovery", "Reuse successful recovery")).otherwise(F.regexp_replace("title", "^Repeated", "Prevent repeated"))
    enough = (F.col("n") >= 2) & (F.col("sessions") >= 2)
    reason = F.when(~enough, "two_independent_events_required").when(~F.coalesce(concrete, F.lit(False)), "signature_not_concrete")
    made = reason.isNull()
    return findings.select(
        "finding_id",
        F.when(made, "candidate").otherwise("insufficient_evidence").alias("status"),
        reason.alias("reason"),
        F.when(made, mutation_id(F.col("finding_id"))).alias("mutation_id"),
        F.when(made, equivalence_key(F.col("detector"), F.array("signature"))).alias("equivalence_key"),
        "detector",
        F.col("signature").alias("selector"),
        F.when(F.col("detector") == CORRECTION, "agent_decision").otherwise("tool_call").alias("trigger_kind"),
        title.alias("title"),
        F.when(made, advice).alias("instruction"),
    )


def package_errors(packages: DataFrame) -> DataFrame:
    """packages (mutation_id, version, title, support, counter, failure_cases, exclusions, selectors, permissions, *_bps) with errors array<string>."""
    bps = [F.when(~F.col(c).between(0, 10_000), f"{c}_out_of_range") for c in ("minimum_success_rate_bps", "maximum_false_positive_rate_bps")]
    rules = [
        F.when(~F.col("mutation_id").rlike(r"^mut_[A-Za-z0-9._:-]{1,127}$"), "invalid_mutation_id"),
        F.when(~F.col("version").rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$"), "invalid_version"),
        F.when(F.length(X.trimmed(F.col("title"))) == 0, "blank_title"),
        F.when(F.size("support") < 2, "too_little_support"),
        F.when(F.size(F.array_distinct("support")) < F.size("support"), "duplicate_support"),
        F.when(F.size(F.array_distinct("counter")) < F.size("counter"), "duplicate_counterexample"),
        F.when(F.arrays_overlap("support", "counter"), "conflicting_evidence"),
        F.when(F.size("failure_cases") == 0, "no_failure_cases"),
        F.when(F.size("exclusions") == 0, "no_exclusions"),
        F.when(F.size("selectors") == 0, "no_triggers"),
        F.when(F.size("permissions") > 0, "permissions_not_allowed"),
        *bps,
    ]
    return packages.withColumn("errors", F.array_compact(F.array(*rules)))


#: Which generator a version of the package format goes with, and whether its packages tell where they are from.
GENERATORS = {"mutation/0.1": ("deterministic_template_v1", False), "mutation/0.2": ("model_synthesis_v1", True)}
_TOLD = ("provider", "model_name", "model_revision", "manifest_spec_version")


def _each(items: str, path: str, code: str, wrong) -> Column:
    """A violation for each element that is wrong, with its place in the path."""
    placed = F.transform(F.coalesce(F.col(items), F.array().cast("array<string>")), lambda x, i: F.when(wrong(x), F.struct(F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")).alias("path"), F.lit(code).alias("code"))))
    return F.array_compact(placed)


def package_violations(packages: DataFrame) -> DataFrame:
    """mutation_id, path, code: a row for each broken rule of each package, with the place of the element that breaks it.

    Besides package_errors: ids of cited events, blank exclusions and selectors, and, where packages has the columns, minimum_replays
    and the contract between spec_version, generated_by and provenance (a struct of provider, model_name, model_revision,
    manifest_spec_version, model_digest): a deterministic package tells no provenance, a model's tells all of it.
    """
    blank = lambda x: F.coalesce(F.length(X.trimmed(x)) == 0, F.lit(True))
    no_event = lambda x: ~F.coalesce(x.rlike(r"^evt_[A-Za-z0-9._:-]{1,127}$"), F.lit(False))
    plain = F.transform("errors", lambda e: F.struct(F.lit("").alias("path"), e.alias("code")))
    found = [plain, _each("support", "support", "invalid_id", no_event), _each("counter", "counter", "invalid_id", no_event), _each("exclusions", "exclusions", "blank", blank), _each("selectors", "selectors", "blank", blank)]
    one = lambda when, path, code: F.when(when, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code")))
    single = []
    if "minimum_replays" in packages.columns:
        single.append(one(F.coalesce(F.col("minimum_replays") < 1, F.lit(True)), "minimum_replays", "minimum"))
    if {"spec_version", "generated_by", "provenance"} <= set(packages.columns):
        known = F.col("spec_version").isin(*GENERATORS) & F.col("generated_by").isin(*(g for g, _ in GENERATORS.values()))
        pairs = [(F.col("spec_version") == v) & (F.col("generated_by") == g) for v, (g, _) in GENERATORS.items()]
        told = F.col("provenance").isNotNull()
        single.append(one(known & ~(pairs[0] | pairs[1]), "generated_by", "provenance_mismatch"))
        single.append(one(~F.coalesce(known, F.lit(False)), "generated_by", "unknown"))
        for pair, (_, wanted) in zip(pairs, GENERATORS.values()):
            single.append(one(pair & ~told, "provenance", "required") if wanted else one(pair & told, "provenance", "unexpected_provenance"))
            if wanted:
                single += [one(pair & told & blank(F.col(f"provenance.{c}")), f"provenance.{c}", "blank") for c in _TOLD]
                single.append(one(pair & told & F.col("provenance.model_digest").isNotNull() & blank(F.col("provenance.model_digest")), "provenance.model_digest", "blank"))
    if single:
        found.append(F.array_compact(F.array(*single)))
    return package_errors(packages).select("mutation_id", F.explode(F.concat(*found)).alias("v")).select("mutation_id", "v.path", "v.code")


def register(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """candidates with outcome: duplicate (same id and content), conflict (same id, other content), equivalent_existing, inserted.

    Both need content_hash, mutation_id, finding_id, equivalence_key. Within a batch the least mutation_id of an
    equivalence key is inserted. Two joins stand for "same finding or same key", which as one condition would be a loop.
    """
    by_id = registry.select("mutation_id", F.col("content_hash").alias("__hash"))
    by_finding = registry.select("finding_id", F.lit(True).alias("__finding")).distinct()
    by_key = registry.select("equivalence_key", F.lit(True).alias("__key")).distinct()
    heirs = candidates.groupBy("equivalence_key").agg(F.min("mutation_id").alias("__heir"))
    out = candidates.join(by_id, "mutation_id", "left").join(by_finding, "finding_id", "left").join(by_key, "equivalence_key", "left").join(heirs, "equivalence_key")
    outcome = F.when(F.col("__hash") == F.col("content_hash"), "duplicate").when(F.col("__hash").isNotNull(), "conflict").when(F.coalesce("__finding", "__key", F.lit(False)) | (F.col("mutation_id") != F.col("__heir")), "equivalent_existing").otherwise("inserted")
    return out.withColumn("outcome", outcome).select(*candidates.columns, "outcome")


def states(log: DataFrame) -> DataFrame:
    """mutation_id, state, updated_at from the transition log (mutation_id, transition_id, to_state, at)."""
    return log.groupBy("mutation_id").agg(F.max_by("to_state", "transition_id").alias("state"), F.max("at").alias("updated_at"))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Rows of the log that no allowed edge covers; a first row must enter candidate."""
    before = F.lag("to_state").over(Window.partitionBy("mutation_id").orderBy("transition_id"))
    moved = log.withColumn("from_state", before)
    edge = F.struct("from_state", "to_state")
    legal = F.when(F.col("from_state").isNull(), F.col("to_state") == "candidate").otherwise(edge.isin(*(F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a, b in EDGES)))
    return moved.where(~legal)


def transition(current: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (mutation_id, to_state, reason, one for each mutation) with from_state and outcome against current states (mutation_id, state).

    changed, unchanged (it is in that state), refused (no edge leads there) or not_found; rows that are changed are to be
    appended to the log.
    """
    met = moves.join(current.select("mutation_id", F.col("state").alias("from_state")), "mutation_id", "left")
    edge = F.struct("from_state", "to_state").isin(*(F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state")) for a, b in EDGES))
    return met.withColumn("outcome", F.when(F.col("from_state").isNull(), "not_found").when(F.col("from_state") == F.col("to_state"), "unchanged").when(edge, "changed").otherwise("refused"))


def state_counts(log: DataFrame) -> DataFrame:
    return states(log).groupBy("state").agg(F.count("*").alias("mutations"))


def challenge(assessments: DataFrame) -> DataFrame:
    """assessments (mutation_id, checks map<string, boolean>) with passed: all six checks must hold."""
    held = F.size(F.filter(F.map_values("checks"), lambda x: x))
    return assessments.withColumn("passed", (F.size("checks") == CHECKS) & (held == CHECKS))


def resolve_prefix(registry: DataFrame, prefix: str, key: str = "mutation_id") -> str:
    """The id that equals the prefix, or else the only one that begins with it (six characters after the type at least)."""
    found = [r[0] for r in registry.where(F.col(key).startswith(prefix)).select(key).orderBy(F.length(key), key).limit(2).collect()]
    if found and found[0] == prefix:
        return prefix
    if len(prefix.split("_", 1)[-1]) < 6:
        raise ValueError("prefix too short")
    if len(found) != 1:
        raise ValueError("no such id" if not found else "ambiguous prefix")
    return found[0]


# ---- drafts


def context_window(events: DataFrame, evidence_ids: DataFrame, radius: int) -> DataFrame:
    """Events within `radius` rows of an evidence event of their session; is_evidence tells which they are.

    Sessions are laid out in ranges and neighbours found by position, so that a giant session is many tasks.
    """
    touched = events.join(evidence_ids.join(events.select("event_id", "session_id"), "event_id").select("session_id").distinct(), "session_id", "left_semi")
    marked = touched.join(evidence_ids.select("event_id", F.lit(True).alias("is_evidence")).distinct(), "event_id", "left").withColumn("is_evidence", F.coalesce("is_evidence", F.lit(False)))
    placed = settle(positions(laid_out(marked, ["session_id"], session_order()), ["session_id"], "__place"), "placed")
    return near(placed, placed.where("is_evidence"), ["session_id"], "__place", radius).drop("__place", "__at")


def draft(ops: DataFrame, evidence: DataFrame, mutation: str, selectors: list[str], kind: str = "replay", radius: int = 1) -> DataFrame:
    """Cases to review, one for each session and side: scenario_id, session_id, expected, source_event_ids, observed_selectors.

    evidence: event_id, role. Where a session has both sides, no neighbours are taken. Every side of a session
    becomes one row with its own events only.
    """
    prefix, spec = ("rps", "replay-draft/v1") if kind == "replay" else ("shd", "shadow-draft/v1")
    both = evidence.groupBy("event_id").agg(F.count_distinct("role").alias("k")).where("k > 1")
    if not both.isEmpty():
        raise ValueError("an event is both evidence and counterexample")
    placed = evidence.select("event_id", "role").distinct().join(ops.select("event_id", "session_id"), "event_id", "left")
    if not placed.where("session_id is null").isEmpty():
        raise ValueError("evidence is missing")
    mixed = placed.groupBy("session_id").agg((F.min("role") != F.max("role")).alias("mixed"), F.min("role").alias("side"))
    own = ops.withColumn("selector", X.event_selector(F.col("type"), F.col("tool.name"), F.col("tool.exit_code"), F.col("label")))
    around = context_window(own, placed.select("event_id"), radius).join(mixed, "session_id").where("is_evidence or not mixed")
    role = placed.select("event_id", "role")
    # neighbours are only taken where a session has one side
    sided = around.join(role, "event_id", "left").withColumn("role", F.coalesce("role", "side"))
    order = F.struct("occurred_at", F.coalesce("sequence", F.lit(-1)), "event_id")
    cases = sided.groupBy("session_id", "role").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "event_id", "selector", "is_evidence"))).alias("e"))
    ids = F.transform("e", lambda x: x["event_id"])
    expected = F.when(F.col("role") == "evidence", "intervene").otherwise("no_op")
    seen = F.array_distinct(F.concat(F.when(F.col("role") == "evidence", F.array(*(F.lit(s) for s in selectors))).otherwise(F.array().cast("array<string>")), F.transform("e", lambda x: x["selector"])))
    return cases.select(hashed(prefix, spec, mutation, F.col("session_id"), expected, F.array_join(ids, "\0")).alias("scenario_id"), "session_id", expected.alias("expected"), ids.alias("source_event_ids"), F.array_sort(seen).alias("observed_selectors"))


def suite_errors(cases: DataFrame, id_column: str = "scenario_id") -> DataFrame:
    """(code, value): ids and source events that occur more than once in a suite."""
    twice = cases.groupBy(id_column).count().where("count > 1").select(F.lit("duplicate_id").alias("code"), F.col(id_column).alias("value"))
    used = cases.select(F.explode("source_event_ids").alias("value")).groupBy("value").count().where("count > 1").select(F.lit("source_event_reused").alias("code"), "value")
    return twice.unionByName(used)


# ---- evaluation


def _matched(selectors: Column) -> Column:
    return F.arrays_overlap("observed_selectors", selectors)


def replay_results(cases: DataFrame) -> DataFrame:
    """cases (mutation_id, scenario_id, observed_selectors, selectors, expected, outcome) with triggered and disposition."""
    triggered = F.coalesce(_matched(F.col("selectors")), F.lit(False))
    wanted, happened = F.col("expected") == "intervene", F.coalesce(F.col("outcome") == "expected_result", F.lit(False))
    disposition = F.when(~wanted & ~F.col("triggered"), "no_op").when(~wanted, "false_intervention").when(F.col("triggered") & happened, "success").otherwise("contradiction")
    return cases.withColumn("triggered", triggered).withColumn("disposition", disposition)


def replay_summary(results: DataFrame) -> DataFrame:
    """A row for each mutation: counts, rates in basis points, unmet thresholds in order, passed.

    The success rate is over all scenarios; the false-intervention rate over those that call for no intervention.
    """
    n = lambda d: F.count_if(F.col("disposition") == d)
    out = results.groupBy("mutation_id").agg(F.count("*").alias("scenarios"), n("success").alias("successes"), n("no_op").alias("no_ops"), n("contradiction").alias("contradictions"), n("false_intervention").alias("false_interventions"))
    out = out.withColumn("success_rate_bps", X.basis_points("successes + no_ops", "scenarios")).withColumn("false_intervention_rate_bps", X.basis_points("false_interventions", "no_ops + false_interventions"))
    unmet = [
        F.when(F.col("scenarios") < MINIMUM_REPLAYS, "insufficient_scenarios"),
        F.when(F.col("successes") + F.col("contradictions") == 0, "missing_intervention_coverage"),
        F.when(F.col("no_ops") + F.col("false_interventions") == 0, "missing_no_op_coverage"),
        F.when(F.col("success_rate_bps") < MINIMUM_SUCCESS_BPS, "success_rate_below_minimum"),
        F.when(F.col("false_intervention_rate_bps") > MAXIMUM_FALSE_BPS, "false_intervention_rate_above_maximum"),
    ]
    return out.withColumn("threshold_failures", F.array_compact(F.array(*unmet))).withColumn("passed", F.size("threshold_failures") == 0)


def shadow_results(cases: DataFrame) -> DataFrame:
    """cases (mutation_id, observation_id, observed_selectors, selectors, would_help) with would_trigger and disposition."""
    hit = F.coalesce(_matched(F.col("selectors")), F.lit(False))
    kind = F.when(F.col("would_trigger") & F.col("would_help"), "true_positive").when(F.col("would_trigger"), "false_positive").when(F.col("would_help"), "false_negative").otherwise("true_negative")
    return cases.withColumn("would_trigger", hit).withColumn("disposition", kind)


def shadow_summary(results: DataFrame) -> DataFrame:
    """A row for each mutation; the false-positive rate is over triggered observations."""
    n = lambda d: F.count_if(F.col("disposition") == d)
    out = results.groupBy("mutation_id").agg(F.count("*").alias("observations"), n("true_positive").alias("tp"), n("true_negative").alias("tn"), n("false_positive").alias("fp"), n("false_negative").alias("fn"))
    out = out.withColumn("precision_bps", X.basis_points("tp", "tp + fp")).withColumn("false_positive_rate_bps", X.basis_points("fp", "tp + fp")).withColumn("recall_bps", X.basis_points("tp", "tp + fn"))
    unmet = [
        F.when(F.col("observations") < MINIMUM_OBSERVATIONS, "insufficient_observations"),
        F.when(F.col("tp") + F.col("fn") == 0, "missing_positive_coverage"),
        F.when(F.col("tn") + F.col("fp") == 0, "missing_negative_coverage"),
        F.when(F.col("tp") + F.col("fp") == 0, "missing_trigger_coverage"),
        F.when(F.col("false_positive_rate_bps") > MAXIMUM_FALSE_BPS, "false_positive_rate_above_maximum"),
    ]
    return out.withColumn("threshold_failures", F.array_compact(F.array(*unmet))).withColumn("passed", F.size("threshold_failures") == 0)


def index_grammars(ops: DataFrame) -> DataFrame:
    """newest, present array<int>: the versions of the signature grammar in the index; one row."""
    return ops.select(X.grammar_version(F.col("operation_key")).alias("g")).where("g is not null").distinct().agg(F.max("g").alias("newest"), F.collect_set("g").alias("present"))


def failures_up_to(failed: DataFrame, instants: DataFrame) -> DataFrame:
    """t, total_to, classifiable_to, total_before, classifiable_before: failures up to and with, and before, each instant t.

    Failures and instants are merged in order of time and summed up once: inside ranges of time that are equally full, and over
    the ranges, of which there are as many as partitions.
    """
    none = F.lit(0).cast("long")
    counted = failed.groupBy(F.col("occurred_at").alias("t")).agg(F.count("*").alias("total"), F.count("operation_key").alias("classifiable"))
    asked = instants.select("t").distinct().select("t", none.alias("total"), none.alias("classifiable"), F.lit(True).alias("asked"))
    merged = counted.withColumn("asked", F.lit(False)).unionByName(asked).groupBy("t").agg(F.sum("total").alias("total"), F.sum("classifiable").alias("classifiable"), F.max("asked").alias("asked"))
    laid = laid_out(merged, [], [F.col("t").asc()]).withColumn("range", F.shiftright("__at", 33))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy("range").agg(F.sum("total").alias("total"), F.sum("classifiable").alias("classifiable"))
    earlier = ranges.select("range", F.coalesce(F.sum("total").over(upto), none).alias("total_range"), F.coalesce(F.sum("classifiable").over(upto), none).alias("classifiable_range"))
    inside = Window.partitionBy("range").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = laid.select("t", "range", "asked", *(c for n in ("total", "classifiable") for c in (F.col(n), F.sum(n).over(inside).alias(f"{n}_in")))).where("asked")
    to = lambda n: F.col(f"{n}_range") + F.col(f"{n}_in")
    return summed.join(F.broadcast(earlier), "range").select("t", *(c for n in ("total", "classifiable") for c in (to(n).alias(f"{n}_to"), (to(n) - F.col(n)).alias(f"{n}_before"))))  # a row for each partition


def efficacy(ops: DataFrame, installed: DataFrame) -> DataFrame:
    """Occurrences before and after an installation, in windows of equal length, and a verdict.

    installed: mutation_id, selector, installed_at, now. Events outside all windows and operations that no selector
    asks for are cut off before anything is counted. Coverage counts failures with an operation among all failures
    of the span, over all sessions. A selector whose grammar is older than the newest of the index, and not in it, is
    a mismatch; of several selectors of a mutation one is enough.
    """
    spans = installed.withColumn("q", X.parsed_selector(F.col("selector"))).withColumn("pre_start", F.expr("installed_at - (now - installed_at)"))
    # whatever installations are derived from is worked out once; five steps use them
    spans = settle(spans.select("mutation_id", "selector", "installed_at", "now", "pre_start", F.col("q.operation_key").alias("operation_key"), F.col("q.exit_code").alias("exit_code")), "spans")
    # operations are derived from events once
    keyed = settle(ops.where((F.col("type") == "tool.failed") | F.col("operation_key").isNotNull()).select("event_id", "session_id", "occurred_at", "type", "operation_key", F.col("tool.exit_code").alias("code")), "keyed-events")
    failed = keyed.where("type = 'tool.failed'").drop("type")
    met = spans.join(failed, "operation_key").where((F.col("exit_code").isNull() | (F.col("exit_code") == F.col("code"))) & F.col("occurred_at").between(F.col("pre_start"), F.col("now")))
    met = met.select("mutation_id", "event_id", "session_id", "occurred_at", (F.col("occurred_at") >= F.col("installed_at")).alias("post")).dropDuplicates(["mutation_id", "event_id"])
    side = met.groupBy("mutation_id", "session_id").agg(F.count_if(~F.col("post")).alias("pre"), F.count_if("post").alias("post"))
    tally = side.groupBy("mutation_id").agg(F.sum("pre").alias("pre_n"), F.sum("post").alias("post_n"), F.count_if(F.col("pre") > 0).alias("pre_sessions"), F.count_if(F.col("post") > 0).alias("post_sessions"))
    bounds = spans.select("mutation_id", F.col("pre_start").alias("lo"), F.col("now").alias("hi")).groupBy("mutation_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bounds = settle(bounds, "bounds")
    marks = settle(failures_up_to(failed, bounds.select(F.col("lo").alias("t")).union(bounds.select("hi"))), "marks")
    low = marks.select(F.col("t").alias("lo"), "total_before", "classifiable_before")
    high = marks.select(F.col("t").alias("hi"), "total_to", "classifiable_to")
    covered = bounds.join(low, "lo").join(high, "hi").select("mutation_id", (F.col("total_to") - F.col("total_before")).alias("total"), (F.col("classifiable_to") - F.col("classifiable_before")).alias("classifiable"))
    grammars = spans.withColumn("one", F.lit(1)).join(F.broadcast(index_grammars(keyed).withColumn("one", F.lit(1))), "one")  # one row
    version = X.grammar_version(F.col("selector"))
    old = F.coalesce((version < F.col("newest")) & ~F.array_contains("present", version), F.lit(False))
    base = grammars.groupBy("mutation_id").agg(F.min("installed_at").alias("installed_at"), F.min("now").alias("now"), F.max(old).alias("grammar_mismatch"))
    out = base.join(tally, "mutation_id", "left").join(covered, "mutation_id", "left").fillna(0, ["pre_n", "post_n", "pre_sessions", "post_sessions", "total", "classifiable"])
    return verdicts(out.withColumn("seconds", F.expr("unix_timestamp(now) - unix_timestamp(installed_at)")))


def verdicts(counted: DataFrame) -> DataFrame:
    """counted (pre_n, post_n, total, classifiable, seconds, grammar_mismatch) with rates, delta, reasons and verdict."""
    rate = lambda n: F.expr(f"case when seconds <= 0 then 0 else {n} * 604800 * 1000 div seconds end")
    out = counted.withColumn("pre_rate_milli", rate("pre_n")).withColumn("post_rate_milli", rate("post_n"))
    out = out.withColumn("delta_bps", F.expr("case when pre_rate_milli = 0 then null else (post_rate_milli - pre_rate_milli) * 10000 div pre_rate_milli end"))
    out = out.withColumn("coverage_bps", F.expr("case when total = 0 then 10000 else classifiable * 10000 div total end"))
    reasons = F.array_compact(F.array(F.when(F.col("grammar_mismatch"), "selector_grammar_mismatch"), F.when(F.col("seconds") < 604_800, "post_window_too_short"), F.when(F.col("pre_n") + F.col("post_n") < 2, "sparse_occurrences"), F.when(F.col("coverage_bps") < 5_000, "partial_index_coverage")))
    verdict = F.when(F.size("reasons") > 0, "insufficient_data").when(F.col("delta_bps").isNull(), F.when(F.col("post_n") > F.col("pre_n"), "regressed").otherwise("unchanged")).when(F.col("delta_bps") <= -2_000, "improved").when(F.col("delta_bps") >= 2_000, "regressed").otherwise("unchanged")
    return out.withColumn("reasons", reasons).withColumn("verdict", verdict)


def efficacy_status(installed: DataFrame, reports: DataFrame) -> DataFrame:
    """verdict, mutations: the latest verdict of each installed mutation, not_measured without one."""
    last = reports.groupBy("mutation_id").agg(F.max_by("verdict", F.struct("created_at", "efficacy_id")).alias("verdict"))
    return installed.select("mutation_id").distinct().join(last, "mutation_id", "left").groupBy(F.coalesce("verdict", F.lit("not_measured")).alias("verdict")).agg(F.count("*").alias("mutations"))
