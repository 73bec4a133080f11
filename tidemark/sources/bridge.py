"""The given tables as session events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 20

# how event types of the table map to the envelope's
TYPES = {"error": "tool.failed", "purchase": "tool.completed", "click": "tool.called", "signup": "session.started", "view": "file.read"}


def session_events(spark: SparkSession, sf_dir: str, shards: int = SHARDS) -> DataFrame:
    """Rows of `events` as envelope rows: a session for each user, a shell job on a shard for each tool event."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    shard = F.get_json_object("props", "$.k").cast("long") % shards
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair)), F.col("event_type"))
    tool = F.when(kind.startswith("tool."), F.struct(
        F.element_at(F.array(F.lit("Bash"), F.lit("exec_command"), F.lit(" Shell ")), (F.col("event_id") % 3 + 1).cast("int")).alias("name"),
        F.parse_json(F.to_json(F.struct(F.concat(F.lit("job  --shard "), shard).alias("command")))).alias("input"),
        F.when(kind == "tool.failed", F.lit(1)).when(kind == "tool.completed", F.lit(0)).cast("long").alias("exit_code"),
        F.lit(None).cast("long").alias("duration_ms"),
        F.lit(None).cast("variant").alias("metadata"),
    ))
    return raw.select(
        F.lit("aep/0.1").alias("spec_version"),
        F.concat(F.lit("evt_"), "event_id").alias("event_id"),
        F.concat(F.lit("ses_u"), "user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.lit(None).cast("string").alias("occurred_at_text"),
        F.lit(None).cast("long").alias("sequence"),
        F.concat(F.lit("adapter"), F.col("user_id") % 4).alias("source"),
        kind.alias("type"),
        F.concat(F.lit("/repo/p"), F.col("user_id") % 3).alias("project"),
        F.lit(None).cast("string").alias("parent_event_id"),
        tool.alias("tool"),
        F.array(F.struct(F.lit("file").alias("type"), F.concat(F.lit("src/"), F.get_json_object("props", "$.k"), F.lit(".py")).alias("path"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("variant").alias("metadata"))).alias("artifacts"),
        F.lit(None).cast("variant").alias("metadata"),
    )


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of `conversations` as envelope rows: user turns are corrections or prompts, assistant turns are decisions, each labelled by its first word."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), r"^([^ \n\t,.;:!?]+)", 1)
    kind = F.when((F.col("role") == "user") & (F.col("turn") > 0), "user.corrected_agent").when(F.col("role") == "user", "prompt.submitted").when(F.col("role") == "assistant", "decision.recorded").otherwise("context.compacted")
    metadata = F.parse_json(F.to_json(F.struct(F.concat(F.lit("Rule  "), F.length(word) % 7).alias("event.signature"), F.when(F.col("role") == "assistant", F.when(F.length("text") % 3 == 0, "followed").otherwise("ignored")).alias("event.outcome"))))
    return raw.select(
        F.lit("aep/0.1").alias("spec_version"),
        F.concat_ws("_", F.lit("evt_c"), "conv_id", "turn").alias("event_id"),
        F.concat(F.lit("ses_c"), "conv_id").alias("session_id"),
        F.timestamp_seconds(F.col("conv_id") * 86400 + F.col("turn")).alias("occurred_at"),
        F.lit(None).cast("string").alias("occurred_at_text"),
        F.col("turn").alias("sequence"),
        F.lit("chat").alias("source"),
        kind.alias("type"),
        F.lit(None).cast("string").alias("project"),
        F.lit(None).cast("string").alias("parent_event_id"),
        F.lit(None).cast("struct<name:string,input:variant,exit_code:bigint,duration_ms:bigint,metadata:variant>").alias("tool"),
        F.array().cast("array<struct<type:string,path:string,uri:string,digest:string,metadata:variant>>").alias("artifacts"),
        metadata.alias("metadata"),
        F.col("text").alias("text"),
    )
