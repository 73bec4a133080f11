"""The registered queries over the given tables. Each reads its tables whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as X
from tidemark.functions.ids import finding_id, mutation_id
from tidemark.operators import chunks, constraints, detect, fulltext, lifecycle, listings, retention, retrieve, store
from tidemark.operators.commits import Tables
from tidemark.operators.tables import settle, shared_dir
from tidemark.sources.bridge import conversation_events, session_events


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their operations, derived once: detectors read them several times. What no query asks of operations is left out."""
    rows = detect.with_operation(session_events(spark, sf_dir)).drop("artifacts", "metadata", "spec_version", "occurred_at_text", "parent_event_id")
    return settle(rows.withColumn("tool", F.struct("tool.name", "tool.exit_code")), "operations")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- detectors


def failure_findings(spark, sf_dir):
    """The flagship: repeated command failures with scores, gates and ids."""
    groups = detect.scored(detect.failure_groups(_ops(spark, sf_dir))).withColumn("unmet_gate", detect.unmet_gate(detect.Thresholds()))
    found = groups.where("unmet_gate is null").withColumn("finding_id", finding_id(detect.FAILURE, F.col("signature")))
    return found.select("finding_id", "signature", "n", "sessions", "cx", F.col("ratio_bps").cast("long").alias("ratio_bps"), F.col("score_bps").cast("long").alias("score_bps"), mutation_id(F.col("finding_id")).alias("mutation_id"))


def failure_groups(spark, sf_dir):
    return detect.failure_groups(_ops(spark, sf_dir)).select("signature", "n", "sessions", "cx")


def failure_evidence(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    failed = ops.where((F.col("type") == "tool.failed") & F.col("failure_signature").isNotNull())
    return failed.select(finding_id(detect.FAILURE, F.col("failure_signature")).alias("finding_id"), "event_id", "session_id", "occurred_at")


def correction_findings(spark, sf_dir):
    ops = detect.with_operation(conversation_events(spark, sf_dir))
    return detect.scored(detect.correction_groups(ops)).select("signature", "n", "sessions", "cx", F.col("ratio_bps").cast("long").alias("ratio_bps"), F.col("score_bps").cast("long").alias("score_bps"), detect.unmet_gate(detect.Thresholds(min_sessions=3)).alias("unmet_gate"))


def recovery_pairs(spark, sf_dir):
    found = detect.recoveries(_ops(spark, sf_dir))
    return found.select(F.col("recovered.event_id").alias("recovered_id"), F.col("failure.event_id").alias("failure_id"), F.col("step.event_id").alias("step_id"), "signature")


def recovery_motifs(spark, sf_dir):
    groups = detect.scored(detect.recovery_groups(detect.recoveries(_ops(spark, sf_dir))))
    return groups.select("signature", "n", "sessions", "cx", F.col("ratio_bps").cast("long").alias("ratio_bps"), F.col("score_bps").cast("long").alias("score_bps"))


def direct_retries(spark, sf_dir):
    return detect.recoveries(_ops(spark, sf_dir)).where("step is null").groupBy(F.col("failure.op").alias("op")).agg(F.count("*").alias("retries"))


def all_findings(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return detect.findings(detect.candidates(ops)).select("finding_id", "detector", "signature", "title", "n", "sessions", "cx", F.col("score_bps").cast("long").alias("score_bps"))


def observations_top5(spark, sf_dir):
    return detect.observations(detect.candidates(_ops(spark, sf_dir))).select("detector", "signature", "n", "sessions", "cx", F.col("score_bps").cast("long").alias("score_bps"), "unmet_gate")


def scan_report(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return detect.scan_report(ops, detect.candidates(ops))


def fingerprint(spark, sf_dir):
    events = session_events(spark, sf_dir).withColumn("ingest_seq", F.expr("cast(substring(event_id, 5) as bigint)"))
    return detect.fingerprint(events).select("events", "sessions", "last_event_at", F.col("last_ingest").cast("long").alias("last_ingest"))


# ---- scalar functions


def operation_keys(spark, sf_dir):
    return _ops(spark, sf_dir).where("operation_key is not null").groupBy("operation_key").agg(F.count("*").alias("events"), F.count_if(F.col("type") == "tool.failed").alias("failures"))


def normalized_text(spark, sf_dir):
    """Whole documents through the rewrites of volatile tokens, with paths, urls and ids added to each."""
    extra = F.concat(F.lit(" /srv/data/run-"), "doc_id", F.lit("/x.txt https://h.example/a?b="), "doc_id", F.lit(" ~/w/"), F.col("doc_id"), F.lit(" id "), F.md5(F.col("doc_id").cast("string")), F.lit(" n "), F.col("doc_id") + 10_000)
    return _documents(spark, sf_dir).select("doc_id", F.sha2(X.normalize_command(F.concat(F.coalesce("text", F.lit("")), extra)), 256).alias("normalized_sha256"))


def redacted_text(spark, sf_dir):
    keyed = F.concat(F.coalesce("text", F.lit("")), F.lit(" API_KEY="), F.md5(F.col("doc_id").cast("string")), F.lit(" Authorization: bearer "), F.sha1(F.col("doc_id").cast("string")), F.lit(" sk-"), F.md5(F.col("doc_id").cast("string")))
    clean = X.redacted(keyed)
    return _documents(spark, sf_dir).select("doc_id", F.sha2(clean, 256).alias("redacted_sha256"), X.was_redacted(keyed, clean).cast("long").alias("changed"))


def selectors(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return ops.groupBy(X.event_selector(F.col("type"), F.col("tool.name"), F.col("tool.exit_code"), F.col("label")).alias("selector")).agg(F.count("*").alias("events"))


def parsed_selectors(spark, sf_dir):
    signed = _ops(spark, sf_dir).where("failure_signature is not null").select("failure_signature").distinct()
    q = X.parsed_selector(F.col("failure_signature"))
    return signed.select("failure_signature", q["operation_key"].alias("operation_key"), q["exit_code"].alias("exit_code"), X.grammar_version(F.col("failure_signature")).cast("long").alias("grammar"))


def grammar_versions(spark, sf_dir):
    return store.grammar_versions(_ops(spark, sf_dir)).select(F.col("grammar").cast("long").alias("grammar"))


# ---- store


def session_rollup(spark, sf_dir):
    return store.session_rollup(session_events(spark, sf_dir))


def topk_sessions(spark, sf_dir):
    return store.list_sessions(store.session_rollup(session_events(spark, sf_dir)), 50).select("session_id", "last_event_at", "events")


def adapter_activity(spark, sf_dir):
    events = session_events(spark, sf_dir)
    adapters = events.select("source").distinct().unionByName(events.select(F.concat(F.col("source"), F.lit("-idle")).alias("source")).distinct())
    return store.adapter_activity(adapters, store.session_rollup(events)).drop("last_cursor_at")


def global_counts(spark, sf_dir):
    events = session_events(spark, sf_dir)
    bridge = store.event_artifacts(events)
    return store.counts(events=events, sessions=store.session_rollup(events), sources=store.source_rollup(events), event_artifacts=bridge, artifacts=store.artifacts(bridge))


def artifact_identity(spark, sf_dir):
    return store.artifacts(store.event_artifacts(session_events(spark, sf_dir))).select("type", "path", "events")


def _redelivered(spark, sf_dir):
    """Every event, a third of them again under the same id: some equal, some with another type."""
    events = session_events(spark, sf_dir).withColumn("n", F.expr("cast(substring(event_id, 5) as bigint)"))
    again = events.where("n % 3 = 0").withColumn("type", F.when(F.col("n") % 6 == 0, "file.changed").otherwise(F.col("type"))).withColumn("ingest_seq", F.col("n") + 1_000_000_000)
    return store.hashed(events.withColumn("ingest_seq", F.col("n")).unionByName(again)).drop("n")


def dedup_first_wins(spark, sf_dir):
    return store.ingest(_redelivered(spark, sf_dir)).accepted.select("event_id", "type", "ingest_seq")


def duplicate_deliveries(spark, sf_dir):
    return store.ingest(_redelivered(spark, sf_dir)).duplicates.select("event_id", "ingest_seq")


def conflict_quarantine(spark, sf_dir):
    return store.quarantine(store.ingest(_redelivered(spark, sf_dir)).conflicts).select("event_id", "observation_count", "first_seen", "last_seen")


def sequence_conflicts(spark, sf_dir):
    """Turns of which several claim one sequence number of their session."""
    events = conversation_events(spark, sf_dir).drop("text").withColumn("ingest_seq", F.col("sequence")).withColumn("sequence", F.floor(F.col("sequence") / 2))
    return store.ingest(store.hashed(events)).rejected.select("event_id", "session_id", "sequence", "reason")


def prune_preview(spark, sf_dir):
    events = session_events(spark, sf_dir)
    rollup = store.session_rollup(events)
    last = rollup.agg(F.max("last_event_at").alias("t")).withColumn("one", F.lit(1))
    aged = rollup.withColumn("one", F.lit(1)).join(F.broadcast(last), "one")
    doomed = aged.where(F.col("last_event_at") < F.expr("t - interval 12 hours")).select("session_id")
    return events.join(doomed, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("events"))


def orphan_artifacts(spark, sf_dir):
    """Artifacts that no kept event names: every seventh start of a session is kept."""
    events = session_events(spark, sf_dir)
    bridge = store.event_artifacts(events)
    kept = store.event_artifacts(events.where("type = 'session.started' and pmod(cast(substring(event_id, 5) as bigint), 7) = 0"))
    return store.orphan_artifacts(store.artifacts(bridge), kept).select("path", "events")


def search_projection(spark, sf_dir):
    return store.search_projection(session_events(spark, sf_dir), index_tool_input=True).where("operation_key is not null").select("event_id", "operation_key")


# ---- retrieval


def exact_signature_lookup(spark, sf_dir):
    return retrieve.by_signature(_ops(spark, sf_dir), "operation/v2|shell|job --shard 7").select("event_id", "occurred_at", "type")


def outcome_filter(spark, sf_dir):
    return retrieve.filtered(session_events(spark, sf_dir), outcome="failure").select("event_id", "type", F.array_join("applied_filters", ";").alias("applied_filters"))


def project_filter(spark, sf_dir):
    return retrieve.filtered(session_events(spark, sf_dir), project="/repo/p1", since="2024-01-02", types=("tool.failed", "file.read")).groupBy("type", "project").agg(F.count("*").alias("events"))


QUERY_WORDS = ("the", "license")


def bm25_terms(spark, sf_dir):
    return retrieve.bm25(_documents(spark, sf_dir), "doc_id", F.col("text"), QUERY_WORDS).select("doc_id", F.round("bm25", 6).alias("bm25"))


def phrase_search(spark, sf_dir):
    return retrieve.phrase(_documents(spark, sf_dir), "doc_id", F.col("text"), ("under", "the")).select("doc_id", F.col("at").cast("long").alias("at"))


def hybrid_search(spark, sf_dir):
    """Failures of a shard and words of their job: events in both lists come first."""
    said = F.concat_ws(" ", "op", F.when(F.col("type") == "tool.failed", "failed")).alias("said")
    ops = settle(_ops(spark, sf_dir).where("operation_key is not null").select("event_id", "occurred_at", "operation_key", said), "operations")
    job = ops
    text = retrieve.bm25(job, "event_id", F.col("said"), ("failed", "7"))
    return retrieve.merged(retrieve.by_signature(ops, "operation/v2|shell|job --shard 7"), text, ops, 40).select("event_id", "score_bps", "match_kind")


def snippets(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    hits = retrieve.bm25(docs, "doc_id", F.col("text"), QUERY_WORDS).select("doc_id")
    return docs.join(hits, "doc_id").select("doc_id", retrieve.snippet(F.col("text"), QUERY_WORDS).alias("snippet"))


# ---- lifecycle


def generated_candidates(spark, sf_dir):
    return lifecycle.generate(detect.findings(detect.candidates(_ops(spark, sf_dir)))).select("finding_id", "status", "mutation_id", "equivalence_key", "trigger_kind", "title")


def _log(spark, sf_dir):
    """A transition log from orders: an order's lines are moves of one mutation through the states."""
    turn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice"))
    moves = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("mut_"), "l_orderkey").alias("mutation_id"), turn.cast("long").alias("transition_id"), F.col("l_shipdate").cast("timestamp").alias("at"), F.col("l_quantity"))
    state = F.element_at(F.array(*(F.lit(s) for s in ("candidate", "challenged", "replay_passed", "shadow_passed", "active", "retired", "rejected"))), F.least(F.col("transition_id"), F.lit(7)).cast("int"))
    return moves.select("mutation_id", "transition_id", "at", F.when((F.col("l_quantity") > 45) & (F.col("transition_id") > 1), "rejected").otherwise(state).alias("to_state"))


def state_counts(spark, sf_dir):
    return lifecycle.state_counts(_log(spark, sf_dir))


def illegal_transitions(spark, sf_dir):
    return lifecycle.illegal_transitions(_log(spark, sf_dir)).select("mutation_id", "transition_id", "from_state", "to_state")


def _reports(spark, sf_dir):
    """Efficacy reports from orders: a customer's orders are reports on one mutation."""
    verdict = F.element_at(F.array(F.lit("improved"), F.lit("unchanged"), F.lit("regressed"), F.lit("insufficient_data")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("mut_"), "o_custkey").alias("mutation_id"), F.col("o_orderkey").alias("efficacy_id"), F.col("o_orderdate").alias("created_at"), verdict.alias("verdict"))


def latest_verdict(spark, sf_dir):
    installed = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("mut_"), "c_custkey").alias("mutation_id"))
    return lifecycle.efficacy_status(installed, _reports(spark, sf_dir))


def _cases(spark, sf_dir):
    """Review cases from the table of lines: one suite for each supplier."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        F.concat(F.lit("mut_"), "l_suppkey").alias("mutation_id"),
        F.concat_ws("_", F.lit("case"), "l_orderkey", "l_linenumber").alias("scenario_id"),
        F.array(F.concat(F.lit("flag:"), "l_returnflag"), F.concat(F.lit("status:"), "l_linestatus")).alias("observed_selectors"),
        F.array(F.lit("flag:R"), F.lit("flag:missing")).alias("selectors"),
        F.when(F.col("l_discount") > 0.04, "intervene").otherwise("no_op").alias("expected"),
        F.when(F.col("l_tax") < 0.05, "expected_result").otherwise("contradiction").alias("outcome"),
    )


def replay_summary(spark, sf_dir):
    out = lifecycle.replay_summary(lifecycle.replay_results(_cases(spark, sf_dir)))
    return out.select("mutation_id", "scenarios", "successes", "no_ops", "contradictions", "false_interventions", F.col("success_rate_bps").cast("long").alias("success_rate_bps"), F.col("false_intervention_rate_bps").cast("long").alias("false_intervention_rate_bps"), F.array_join("threshold_failures", ",").alias("threshold_failures"), "passed")


def shadow_matrix(spark, sf_dir):
    cases = _cases(spark, sf_dir).withColumnRenamed("scenario_id", "observation_id").withColumn("would_help", F.col("expected") == "intervene")
    out = lifecycle.shadow_summary(lifecycle.shadow_results(cases))
    return out.select("mutation_id", "observations", "tp", "tn", "fp", "fn", *(F.col(c).cast("long").alias(c) for c in ("precision_bps", "false_positive_rate_bps", "recall_bps")), F.array_join("threshold_failures", ",").alias("threshold_failures"), "passed")


def _installed(ops):
    span = ops.agg(F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last")).withColumn("one", F.lit(1))
    signed = ops.where("failure_signature is not null").select("failure_signature").distinct().withColumn("one", F.lit(1))
    middle = F.expr("timestamp_micros((unix_micros(first) + unix_micros(last)) div 2)")
    return signed.join(F.broadcast(span), "one").select(mutation_id(finding_id(detect.FAILURE, F.col("failure_signature"))).alias("mutation_id"), F.col("failure_signature").alias("selector"), middle.alias("installed_at"), F.col("last").alias("now"))


def efficacy_windows(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    out = lifecycle.efficacy(ops, _installed(ops))
    whole = ("pre_n", "post_n", "pre_sessions", "post_sessions", "pre_rate_milli", "post_rate_milli", "delta_bps", "coverage_bps")
    return out.select("mutation_id", *(F.col(c).cast("long").alias(c) for c in whole), F.array_join("reasons", ",").alias("reasons"), "verdict")


def context_window(spark, sf_dir):
    events = session_events(spark, sf_dir)
    marked = events.where("type = 'tool.failed' and pmod(cast(substring(event_id, 5) as bigint), 50) = 0").select("event_id")
    return lifecycle.context_window(events, marked, 2).select("session_id", "event_id", "is_evidence")


def draft_cases(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    role = F.when(F.col("type") == "tool.failed", "evidence").otherwise("counterexample")
    cited = retrieve.by_signature(ops, "operation/v2|shell|job --shard 7").where("type <> 'tool.called'").select("event_id", role.alias("role"))
    return lifecycle.draft(ops, cited, "mut_demo", ["failure/v2|shell|job --shard 7|exit:1"]).select("session_id", "expected", F.size("source_event_ids").cast("long").alias("n_events"), "scenario_id")


# ---- sequences and sets


def forward_fill(spark, sf_dir):
    """The directory in force at each event: that of the last file event of the session, from chunk to chunk."""
    events = session_events(spark, sf_dir)
    place = F.when(F.col("type") == "file.read", F.col("artifacts")[0]["path"])
    got = detect.previous(events.withColumn("place", place), ["session_id"], F.to_date("occurred_at"), detect.session_order(), F.col("place").isNotNull(), F.col("place"), "earlier")
    return got.select("event_id", F.coalesce("place", "earlier").alias("place"))


def call_result_pairing(spark, sf_dir):
    """Results whose latest earlier event on the same operation is a call."""
    ops = _ops(spark, sf_dir).where("op is not null").select("session_id", "occurred_at", "sequence", "event_id", "type", "op")
    before = detect.previous(ops, ["session_id", "op"], F.to_date("occurred_at"), detect.session_order(), F.lit(True), F.struct("event_id", "type"), "before")
    return before.where("type <> 'tool.called' and before.type = 'tool.called'").select(F.col("event_id").alias("result_id"), F.col("before.event_id").alias("call_id"))


def evidence_union(spark, sf_dir):
    """Sessions cited by failures, recoveries or corrections of tools: a distinct union."""
    ops = _ops(spark, sf_dir)
    found = detect.recoveries(ops)
    return ops.where("failure_signature is not null").select("session_id").union(found.select("recovered.session_id")).union(found.where("step is not null").select("step.session_id")).distinct()


def evidence_intersect(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    failed, passed = ops.where("type = 'tool.failed'"), ops.where("type = 'tool.completed'")
    return failed.select("session_id", "op").intersect(passed.select("session_id", "op"))


def missing_evidence(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return ops.where("type = 'tool.failed'").select("session_id", "op").subtract(ops.where("type = 'tool.completed'").select("session_id", "op"))


def full_outer_merge(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    a = ops.where("type = 'tool.failed'").groupBy("session_id", "op").agg(F.count("*").alias("failures"))
    b = ops.where("type = 'tool.completed'").groupBy("session_id", "op").agg(F.count("*").alias("successes"))
    return a.join(b, ["session_id", "op"], "full_outer").fillna(0, ["failures", "successes"])


def event_positions(spark, sf_dir):
    """Number of each event in its session."""
    events = session_events(spark, sf_dir)
    laid = chunks.laid_out(events.select("session_id", "event_id", "occurred_at", "sequence"), ["session_id"], detect.session_order())
    return chunks.positions(laid, ["session_id"], "at").select("event_id", "at")


# ---- upserts, retention, listings


def _number():
    return F.expr("cast(substring(event_id, 5) as bigint)")


def source_upsert(spark, sf_dir):
    """Sources of even events as known, those of odd events as seen now; of one project they come with a name."""
    rows = session_events(spark, sf_dir).select(_number().alias("n"), F.col("source").alias("adapter"), F.col("project").alias("instance_key"), "occurred_at")
    told = lambda r, name: r.groupBy("adapter", "instance_key").agg(name.alias("display_name"), F.min("occurred_at").alias("first_seen_at"), F.max("occurred_at").alias("last_seen_at"))
    named = F.max(F.when(F.col("instance_key") == "/repo/p1", F.concat(F.lit("Agent "), "instance_key")))
    return store.upsert_sources(told(rows.where("n % 2 = 0"), F.lit(None).cast("string")), told(rows.where("n % 2 = 1"), named))


def cursor_upsert(spark, sf_dir):
    """Every event as a write of its session's cursor."""
    rows = session_events(spark, sf_dir).select(F.col("source").alias("adapter"), F.col("project").alias("instance_key"), F.col("session_id").alias("origin"), _number().alias("position"), F.col("occurred_at").alias("updated_at"))
    return store.upsert_cursors(rows.where("position % 3 = 0"), rows.where("position % 3 <> 0"))


def within_span(spark, sf_dir):
    """Events of four hours, by times that are text and in part unreadable."""
    text = F.when(F.col("n") % 50 == 0, "never").otherwise(F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))
    at = lambda t: F.lit(t).cast("timestamp")
    return session_events(spark, sf_dir).withColumn("n", _number()).where(store.within(text, at("2024-01-02 04:00:00"), at("2024-01-02 08:00:00"))).groupBy("type").agg(F.count("*").alias("events"))


def evidence_presence(spark, sf_dir):
    """Failures as cited evidence, of which a tenth is gone."""
    ops = _ops(spark, sf_dir)
    cited = ops.where("failure_signature is not null").select(finding_id(detect.FAILURE, F.col("failure_signature")).alias("finding_id"), "event_id")
    return listings.evidence_links(cited, ops.where(_number() % 10 != 3)).groupBy("finding_id").agg(F.count("*").alias("cited"), F.count_if(~F.col("present")).alias("missing"))


def session_listing(spark, sf_dir):
    return listings.session_events(session_events(spark, sf_dir), "ses_u7").select("event_id", "occurred_at", "type")


def attested_mutations(spark, sf_dir):
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'")
    return listings.attested(done.select(F.concat(F.lit("mut_"), "o_custkey").alias("mutation_id")))


def applied_transitions(spark, sf_dir):
    """Every seventh order's mutation, and some unknown ones, asked to move."""
    to = F.element_at(F.array(F.lit("challenged"), F.lit("rejected"), F.lit("active"), F.lit("retired")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    moves = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 7 = 0").select(F.concat(F.lit("mut_"), F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))).alias("mutation_id"), to.alias("to_state"), F.lit("review").alias("reason"))
    return lifecycle.transition(lifecycle.states(_log(spark, sf_dir)), moves).select("mutation_id", "from_state", "to_state", "outcome")


def _held(spark, sf_dir):
    """A store in which a mutation for each shard of a hundred rests on its failures, replays on its successes, shadows on its calls."""
    events = session_events(spark, sf_dir)
    owner = events.select("event_id", _number().alias("n"), "type", F.concat(F.lit("mut_k"), F.regexp_extract(F.col("artifacts")[0]["path"], r"src/(\d+)\.py", 1)).alias("mutation_id"))
    of = lambda kind: owner.where(F.col("type") == kind).select("mutation_id", "event_id", "n")
    reports = of("tool.completed").withColumn("efficacy_id", F.concat(F.lit("eff_"), F.col("n") % 50, F.lit("_"), "mutation_id"))
    return retention.Store(events, of("tool.failed"), of("tool.completed").where(F.col("n") % 9 == 0), of("tool.called").where(F.col("n") % 9 == 0), reports, of("tool.failed").where("mutation_id like '%0'").select("mutation_id").distinct(), {"candidates": of("tool.failed").select("mutation_id").distinct()})


def guarded_sessions(spark, sf_dir):
    return retention.guarded_sessions(_held(spark, sf_dir))


def _doomed(spark, sf_dir):
    return session_events(spark, sf_dir).select("session_id").distinct().where("session_id = 'ses_u7'")


def deleted_session(spark, sf_dir):
    """What the deletion of one session takes with it."""
    held = _held(spark, sf_dir)
    held.installed = None
    return retention.deletion_summary(held, retention.delete_sessions(held, _doomed(spark, sf_dir)))


def surviving_reports(spark, sf_dir):
    """Reports on efficacy that are left when one session goes."""
    held = _held(spark, sf_dir)
    kept = held.events.join(_doomed(spark, sf_dir), "session_id", "left_anti")
    return retention.cascade(held, kept).efficacy.groupBy("efficacy_id", "mutation_id").agg(F.count("*").alias("events"))


def word_search(spark, sf_dir):
    """Documents with a word, one of two others or a phrase, without a third."""
    found = retrieve.search(_documents(spark, sf_dir), "doc_id", F.col("text"), [["the"], ["password", "licens*", ("under", "the")]], none_of=["token"])
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"))


def constraint_violations(spark, sf_dir):
    """Broken rules of a store in which events were damaged in ten ways and some sessions and artifacts are gone."""
    n = F.col("n")
    text = lambda c, every, at, instead: F.when(n % every == at, F.lit(instead)).otherwise(c)
    own = session_events(spark, sf_dir).withColumn("n", _number())
    events = own.select(
        text(F.when(n % 1009 == 8, F.lit("evt_8")).otherwise(F.col("event_id")), 997, 3, "event").alias("event_id"), text(F.col("session_id"), 499, 7, None).alias("session_id"), "occurred_at", text(F.col("type"), 701, 5, "tool.other").alias("type"),
        F.when(n % 503 == 4, -n).otherwise(n % 2000).alias("sequence"), text(F.concat(F.lit("evt_"), n - 1), 311, 6, "evt_").alias("parent_event_id"), text(F.lit("{}"), 353, 2, "{no json").alias("metadata_json"), F.expr("substring(sha2(event_id, 256), 1, if(n % 401 = 9, 63, 64))").alias("content_hash"),
    )
    sessions = store.session_rollup(own.where("n % 3 < 2")).where(F.expr("cast(substring(session_id, 6) as bigint) % 50 <> 11")).withColumn("events", F.when(F.col("project") == "/repo/p1", -F.col("events")).otherwise(F.col("events")))
    bridge = store.event_artifacts(own).withColumn("path", F.when(F.col("path").like("%7.py"), F.lit(None)).otherwise(F.col("path")))
    known = store.artifacts(bridge).where("path is not null")
    found = constraints.violations({"events": events, "sessions": sessions, "event_artifacts": bridge, "artifacts": known})
    return found.groupBy("table", "rule").agg(F.count("*").alias("violations"))


def _matched(spark, sf_dir, query):
    """Documents by the MATCH language, from an index of their source and text that is stored first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    index = fulltext.write(Tables(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"), docs, "doc_id", {"source": F.col("source"), "text": F.col("text")})
    return fulltext.search(index, query).select(F.col("doc").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def match_or(spark, sf_dir):
    return _matched(spark, sf_dir, "password OR license NOT token")


def match_not(spark, sf_dir):
    return _matched(spark, sf_dir, "(the NOT license) NOT password")


def match_near(spark, sf_dir):
    return _matched(spark, sf_dir, "NEAR(under license, 6) AND the")


def match_columns(spark, sf_dir):
    """A beginning in one column and a phrase in the other."""
    return _matched(spark, sf_dir, 'source : src1* text : "under the"')


def match_prefix(spark, sf_dir):
    return _matched(spark, sf_dir, "licens* OR passw*")


QUERIES = {
    f.__name__: f
    for f in (
        failure_findings, failure_groups, failure_evidence, correction_findings, recovery_pairs, recovery_motifs, direct_retries, all_findings, observations_top5, scan_report, fingerprint,
        operation_keys, normalized_text, redacted_text, selectors, parsed_selectors, grammar_versions,
        session_rollup, topk_sessions, adapter_activity, global_counts, artifact_identity, dedup_first_wins, duplicate_deliveries, conflict_quarantine, sequence_conflicts, prune_preview, orphan_artifacts, search_projection,
        exact_signature_lookup, outcome_filter, project_filter, bm25_terms, phrase_search, hybrid_search, snippets,
        generated_candidates, state_counts, illegal_transitions, latest_verdict, replay_summary, shadow_matrix, efficacy_windows, context_window, draft_cases,
        forward_fill, call_result_pairing, evidence_union, evidence_intersect, missing_evidence, full_outer_merge, event_positions,
        source_upsert, cursor_upsert, within_span, evidence_presence, session_listing, attested_mutations, applied_transitions, guarded_sessions, deleted_session, surviving_reports, word_search, match_or, match_not, match_near, match_columns, match_prefix, constraint_violations,
    )
}
