"""The event envelope: types, closed sets and versions."""

from __future__ import annotations

from pyspark.sql import types as T

SPEC_VERSION = "aep/0.1"
GRAMMAR = "v2"

# fixed values: the wire names of the event format
EVENT_TYPES = (
    "session.started", "session.ended", "prompt.submitted", "decision.recorded", "tool.called", "tool.completed", "tool.failed",
    "file.read", "file.changed", "test.failed", "test.passed", "user.corrected_agent", "user.rejected_action", "context.compacted",
)
TOOL_TYPES = ("tool.called", "tool.completed", "tool.failed")
ARTIFACT_TYPES = ("file", "git.commit", "git.diff", "test", "command.output", "other")
OUTCOMES = {"success": ("tool.completed", "test.passed"), "failure": ("tool.failed", "test.failed")}
#: Metadata keys of a rule and of what became of it; importers of foreign logs name theirs (`with_operation`).
LABEL_KEYS = ("event.signature", "correction_signature", "correction_key")
OUTCOME_KEYS = ("event.outcome", "correction_outcome")
FOLLOWED = ("followed", "accepted", "complied")
SHELL_NAMES = ("bash", "exec", "exec_command", "shell", "terminal")

TOOL = T.StructType([T.StructField("name", T.StringType()), T.StructField("input", T.VariantType()), T.StructField("exit_code", T.LongType()), T.StructField("duration_ms", T.LongType()), T.StructField("metadata", T.VariantType())])
ARTIFACT = T.StructType([T.StructField("type", T.StringType()), T.StructField("path", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("metadata", T.VariantType())])
#: occurred_at_text keeps the digits beyond microseconds and the offset; metadata is an object.
EVENT = T.StructType([
    T.StructField("spec_version", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("session_id", T.StringType()), T.StructField("occurred_at", T.TimestampType()), T.StructField("occurred_at_text", T.StringType()),
    T.StructField("sequence", T.LongType()), T.StructField("source", T.StringType()), T.StructField("type", T.StringType()), T.StructField("project", T.StringType()), T.StructField("parent_event_id", T.StringType()),
    T.StructField("tool", TOOL), T.StructField("artifacts", T.ArrayType(ARTIFACT)), T.StructField("metadata", T.VariantType()),
])
