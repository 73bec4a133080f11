"""JSON documents of a lifecycle: suites of scenarios and observations, bundles, manifests of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the fields of the documents
SCHEMAS = {
    "replay": "spec_version string, mutation_id string, scenarios array<struct<scenario_id: string, source_event_ids: array<string>, observed_trigger_selectors: array<string>, expected_action: string, counterfactual_outcome: string, note: string>>",
    "shadow": "spec_version string, mutation_id string, observations array<struct<observation_id: string, source_event_ids: array<string>, observed_trigger_selectors: array<string>, intervention_would_help: boolean, note: string>>",
    "manifest": "spec_version string, provider string, model string, parameters map<string, string>",
}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A row for each document at path (a file, a folder or a pattern); one that is no such document is an error."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def cases(suites: DataFrame, kind: str) -> DataFrame:
    """A row for each case of the suites, with the names that replay and shadow evaluation take."""
    if kind == "replay":
        return suites.select("mutation_id", F.explode("scenarios").alias("c")).select("mutation_id", "c.scenario_id", "c.source_event_ids", F.col("c.observed_trigger_selectors").alias("observed_selectors"), F.col("c.expected_action").alias("expected"), F.col("c.counterfactual_outcome").alias("outcome"))
    return suites.select("mutation_id", F.explode("observations").alias("c")).select("mutation_id", "c.observation_id", "c.source_event_ids", F.col("c.observed_trigger_selectors").alias("observed_selectors"), F.col("c.intervention_would_help").alias("would_help"))


def suite(drafts: DataFrame, mutation: str, kind: str = "replay") -> DataFrame:
    """Drafted cases as one suite document, in the order of their ids; what a reviewer must decide is left unknown.

    A suite is one document that people review, so its cases are gathered into one row.
    """
    if kind == "replay":
        case, name = F.struct("scenario_id", "source_event_ids", F.col("observed_selectors").alias("observed_trigger_selectors"), F.col("expected").alias("expected_action"), F.lit("unknown").alias("counterfactual_outcome")), "scenarios"
    else:
        case, name = F.struct(F.col("scenario_id").alias("observation_id"), "source_event_ids", F.col("observed_selectors").alias("observed_trigger_selectors"), (F.col("expected") == "intervene").alias("intervention_would_help")), "observations"
    return drafts.agg(F.array_sort(F.collect_list(case)).alias(name)).select(F.lit(f"{kind}-suite/0.1").alias("spec_version"), F.lit(mutation).alias("mutation_id"), name)


def write(documents: DataFrame, path: str, force: bool = False) -> None:
    """Documents as JSON below path; what is there already is kept, and an error, unless it is forced."""
    documents.write.mode("overwrite" if force else "errorifexists").json(path)
