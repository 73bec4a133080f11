"""Project selection, path exclusion and redaction of events."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import SECRETS, glob_regex


def selected(projects: Sequence[str]) -> Column:
    """Rows of the projects named; all rows for an empty list, rows without a project only then."""
    return F.coalesce(F.col("project").isin(*projects), F.lit(False)) if projects else F.lit(True)


def allowed(exclude: Sequence[str]) -> Column:
    """Rows whose project and artifact paths match none of the globs."""
    out = F.lit(True)
    for pattern in map(glob_regex, exclude):
        hit = F.coalesce(F.col("project").rlike(pattern), F.lit(False)) | F.coalesce(F.exists("artifacts", (lambda p: lambda a: F.coalesce(a["path"].rlike(p), F.lit(False)))(pattern)), F.lit(False))
        out = out & ~hit
    return out


def _python_rules():
    import regex

    return [(regex.compile(p.replace("(?iU)", "(?i)").replace("(?U)", "")), m.replace("$1", r"\1")) for p, m in SECRETS]


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("changed", T.LongType())]))
def redacted_json(column: pd.Series) -> pd.DataFrame:
    """JSON text with every string leaf redacted (keys stay), and the number of strings changed; null for null."""
    rules = _python_rules()

    def scrub(value, count):
        if isinstance(value, str):
            new = value
            for pattern, mark in rules:
                new = pattern.sub(mark, new)
            count[0] += new != value
            return new
        if isinstance(value, list):
            return [scrub(x, count) for x in value]
        if isinstance(value, dict):
            return {k: scrub(x, count) for k, x in value.items()}
        return value

    out = []
    for text in column:
        if text is None:
            out.append((None, 0))
            continue
        count = [0]
        clean = scrub(json.loads(text), count)
        out.append((json.dumps(clean, ensure_ascii=False, separators=(",", ":")) if count[0] else text, count[0]))
    return pd.DataFrame(out, columns=["json", "changed"])


def private(events: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Events that may be kept, with secrets in tool input, metadata and artifact texts replaced; redacted_fields counts strings changed.

    Project, source, tool name, digests and keys of objects stay as they are.
    """
    kept = events.where(allowed(exclude)).withColumn("__in", redacted_json(F.to_json("tool.input"))).withColumn("__tm", redacted_json(F.to_json("tool.metadata"))).withColumn("__md", redacted_json(F.to_json("metadata")))
    plain = F.to_json(F.transform("artifacts", lambda a: F.struct(a["path"].alias("path"), a["uri"].alias("uri"), F.to_json(a["metadata"]).alias("m"))), {"ignoreNullFields": "false"})
    kept = kept.withColumn("__ar", redacted_json(plain))
    parsed = F.from_json("__ar.json", "array<struct<path:string,uri:string,m:string>>")
    changed = sum((F.coalesce(f"{c}.changed", F.lit(0)) for c in ("__tm", "__md", "__ar")), F.coalesce("__in.changed", F.lit(0)))
    return (
        kept.withColumn("tool", F.when(F.col("tool").isNotNull(), F.struct("tool.name", F.parse_json("__in.json").alias("input"), "tool.exit_code", "tool.duration_ms", F.parse_json("__tm.json").alias("metadata"))))
        .withColumn("metadata", F.parse_json("__md.json"))
        .withColumn("artifacts", F.zip_with("artifacts", parsed, lambda a, p: F.struct(a["type"].alias("type"), p["path"].alias("path"), p["uri"].alias("uri"), a["digest"].alias("digest"), F.parse_json(p["m"]).alias("metadata"))))
        .withColumn("redacted_fields", changed)
        .drop("__in", "__tm", "__md", "__ar")
    )
