"""Rules of a store against tables that break them."""

import pytest
from pyspark.sql import functions as F
from tidemark.operators import constraints, lifecycle


def test_each_kind_of_rule(spark):
    events = spark.createDataFrame([("evt_1", "ses_1", 0, "prompt.submitted", "{}", "a" * 64, None), ("evt_", "ses_1", 0, "no.such", "{", "A" * 64, "x"), (None, "ses_9", -1, None, None, None, "evt_1"), ("evt_1", None, None, "prompt.submitted", "[1]", "b" * 63, None)], "event_id string, session_id string, sequence long, type string, metadata_json string, content_hash string, parent_event_id string")
    sessions = spark.createDataFrame([("ses_1",)], "session_id string")
    got = {(r.table, r.rule, r.key, r.value) for r in constraints.violations({"events": events, "sessions": sessions}).collect()}
    assert got == {
        ("events", "prefix(event_id)", "evt_", "evt_"), ("events", "unique(event_id)", "evt_1", "evt_1"), ("events", "unique(session_id,sequence)", "evt_", "ses_1,0"), ("events", "one_of(type)", "evt_", "no.such"), ("events", "json(metadata_json)", "evt_", "{"),
        ("events", "hash(content_hash)", "evt_", "A" * 64), ("events", "hash(content_hash)", "evt_1", "b" * 63), ("events", "prefix(parent_event_id)", "evt_", "x"), ("events", "at_least(sequence)", None, "-1"), ("events", "refers(session_id)", None, "ses_9"),
    }
    sound = {"events": events.limit(1), "sessions": sessions}
    assert constraints.verified(sound) is sound and constraints.violations({"events": events.limit(0)}).count() == 0
    with pytest.raises(ValueError, match="events evt_ breaks"):
        constraints.verified({"events": events.where("event_id = 'evt_'"), "sessions": sessions})
    cursors = spark.createDataFrame([("a", " ", "o", 0), ("a" * 129, "k", "o", -2)], "adapter string, instance_key string, origin string, position long")
    assert sorted(r.rule for r in constraints.violations({"cursors": cursors}).collect()) == ["at_least(position)", "filled(adapter)", "filled(instance_key)"]
    with pytest.raises(ValueError):
        constraints.violations({"unknown": sessions})


def giant(spark):
    """A session with a third of all rows, and many small ones."""
    rows = spark.range(6_000).select(F.concat(F.lit("evt_"), F.lpad("id", 6, "0")).alias("event_id"), F.when(F.col("id") % 3 == 0, "ses_giant").otherwise(F.concat(F.lit("ses_"), F.col("id") % 97)).alias("session_id"), F.timestamp_seconds(F.col("id") * 7919 % 6_000).alias("occurred_at"), F.lit(None).cast("long").alias("sequence"))
    return rows.repartition(6)


def test_a_giant_session_is_many_tasks(spark):
    from tidemark.operators import chunks
    from tidemark.operators.detect import session_order

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        events = giant(spark)
        laid = chunks.laid_out(events, ["session_id"], session_order())
        sizes = [r["count"] for r in laid.groupBy(F.shiftright("__at", 33)).count().collect()]
        assert max(sizes) <= 600 and sum(sizes) == 6_000
        rows = sorted(((r.session_id, r.occurred_at, r.event_id) for r in events.collect()))
        want, seen = {}, {}
        for s, _, e in rows:
            want[e] = seen[s] = seen.get(s, -1) + 1
        assert {r.event_id: r.at for r in chunks.positions(laid, ["session_id"], "at").collect()} == want
        marked = events.where("cast(substring(event_id, 5) as int) % 40 = 0").select("event_id")
        ids = {r.event_id for r in marked.collect()}
        spots = {(s, want[e]) for s, _, e in rows if e in ids}
        for radius in (0, 1, 3):
            near = {r.event_id: r.is_evidence for r in lifecycle.context_window(events, marked, radius).collect()}
            assert near == {e: e in ids for s, _, e in rows if any((s, want[e] + k) in spots for k in range(-radius, radius + 1))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_draft_holds_what_it_says(spark):
    """Neighbours only where a session has one side; ids in order; selectors of both."""
    kinds = ["prompt.submitted", "tool.failed", "tool.completed", "prompt.submitted", "tool.failed"]
    ops = spark.createDataFrame([(f"evt_{s}{k}", f"ses_{s}", k, t) for s in "ab" for k, t in enumerate(kinds)], "event_id string, session_id string, t int, type string").select(
        "event_id", "session_id", F.timestamp_seconds("t").alias("occurred_at"), F.lit(None).cast("long").alias("sequence"), "type", F.struct(F.when(F.col("type").startswith("tool"), "Bash").alias("name"), F.when(F.col("type") == "tool.failed", 1).when(F.col("type") == "tool.completed", 0).cast("long").alias("exit_code")).alias("tool"), F.lit(None).cast("string").alias("label")
    )
    cited = spark.createDataFrame([("evt_a1", "evidence"), ("evt_b1", "evidence"), ("evt_b2", "counterexample")], "event_id string, role string")
    got = {(r.session_id, r.expected): r for r in lifecycle.draft(ops, cited, "mut_1", ["failure/v2|shell|x|exit:1"]).collect()}
    assert {k: r.source_event_ids for k, r in got.items()} == {("ses_a", "intervene"): ["evt_a0", "evt_a1", "evt_a2"], ("ses_b", "intervene"): ["evt_b1"], ("ses_b", "no_op"): ["evt_b2"]}
    assert "failure/v2|shell|x|exit:1" in got["ses_a", "intervene"].observed_selectors and got["ses_b", "no_op"].observed_selectors == ["event/v1|type:tool.completed|tool:bash|exit:0"]
    with pytest.raises(ValueError, match="missing"):
        lifecycle.draft(ops, cited.withColumn("event_id", F.lit("gone")).limit(1), "mut_1", [])
    with pytest.raises(ValueError, match="both"):
        lifecycle.draft(ops, cited.unionByName(cited.withColumn("role", F.lit("x"))), "mut_1", [])


def test_package_violations_name_places_and_provenance(spark):
    shape = "mutation_id string, version string, title string, support array<string>, counter array<string>, failure_cases array<string>, exclusions array<string>, selectors array<string>, permissions array<string>, minimum_success_rate_bps int, maximum_false_positive_rate_bps int, minimum_replays int, spec_version string, generated_by string, provenance struct<provider:string,model_name:string,model_revision:string,manifest_spec_version:string,model_digest:string>"
    told = ("p", "m", "r", "v", None)
    row = lambda i, replays, spec, by, source, support=("evt_1", "evt_2"), exclusions=("x",): (i, "1.0.0", "t", list(support), ["evt_3"], ["f"], list(exclusions), ["s"], [], 9_000, 100, replays, spec, by, source)
    rows = [
        row("mut_1", 1, "mutation/0.1", "deterministic_template_v1", None), row("mut_2", 1, "mutation/0.2", "model_synthesis_v1", told), row("mut_3", 1, "mutation/0.1", "deterministic_template_v1", told), row("mut_4", 1, "mutation/0.2", "model_synthesis_v1", None),
        row("mut_5", 0, "mutation/0.2", "deterministic_template_v1", told), row("mut_6", 1, "mutation/0.2", "model_synthesis_v1", (" ", "m", None, "v", "")), row("mut_7", 1, "mutation/0.1", "deterministic_template_v1", None, ("evt_1", "ses_2", "evt_3"), ("x", " ")), row("mut_8", 1, "mutation/0.3", "deterministic_template_v1", None),
    ]
    got = sorted((r.mutation_id, r.path, r.code) for r in lifecycle.package_violations(spark.createDataFrame(rows, shape)).collect())
    assert got == [
        ("mut_3", "provenance", "unexpected_provenance"), ("mut_4", "provenance", "required"), ("mut_5", "generated_by", "provenance_mismatch"), ("mut_5", "minimum_replays", "minimum"),
        ("mut_6", "provenance.model_digest", "blank"), ("mut_6", "provenance.model_revision", "blank"), ("mut_6", "provenance.provider", "blank"), ("mut_7", "", "conflicting_evidence"), ("mut_7", "exclusions[1]", "blank"), ("mut_7", "support[1]", "invalid_id"), ("mut_8", "generated_by", "unknown"),
    ]
