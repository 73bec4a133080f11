"""Lines of log files with their file, number and JSON value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.tables import settle, small


def numbered(rows: DataFrame) -> DataFrame:
    """rows (file, block, k: ascending in a block, bytes: of the line and its end) with line (from 1), and of the file: end (bytes of all lines), count (of lines), tail (bytes of the last one).

    rows are settled. Lines are counted by block; running sums over a file's blocks give where each block begins.
    """
    blocks = rows.groupBy("file", "block").agg(F.min("k").alias("first"), F.count("*").alias("n"), F.sum("bytes").alias("filled"), F.max_by("bytes", "k").alias("tail"))
    own = Window.partitionBy("file")
    before = F.sum("n").over(own.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    told = blocks.select(F.col("file").alias("__file"), F.col("block").alias("__block"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("filled").over(own).alias("end"), F.sum("n").over(own).alias("count"), F.max_by("tail", "block").over(own).alias("tail"))
    told = small(settle(told, "blocks"))
    met = rows.join(told, (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block")))
    return met.withColumn("line", (F.col("before") + F.col("k") - F.col("first") + 1).cast("long")).drop("__file", "__block", "first", "before")


def read(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """file (relative to root), line (from 1), text, end (bytes of the file's whole lines), partial (a last line that no line end follows).

    Files are read in splits, each line in one of them: a log of any length is many tasks, and its lines stay where they are read.
    """
    base = F.lit("^.*?" + root.rstrip("/").replace("file://", "").join(("\\Q", "\\E")) + "/?")
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root)
    meta = F.col("_metadata")
    rows = raw.select(F.regexp_replace(meta["file_path"], base, F.lit("")).alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("text"), (F.octet_length("value") + 1).cast("long").alias("bytes"))
    placed = numbered(settle(rows, "lines"))
    cut = F.col("end") > F.col("size")  # without a line end at the end of the file, one byte was counted too much
    return placed.select("file", "line", F.regexp_replace("text", "\r$", "").alias("text"), (F.col("end") - F.when(cut, F.col("tail")).otherwise(0)).alias("end"), (cut & (F.col("line") == F.col("count"))).alias("partial"))


def scan(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """file (relative to root), line (from 1), text, v (VARIANT; null where a line is no JSON), end, partial. Blank lines are left out."""
    return read(spark, root, pattern).where(F.length(F.trim("text")) > 0).select("file", "line", "text", F.try_parse_json("text").alias("v"), "end", "partial")


def text_at(v: Column, path: str) -> Column:
    """A string at a path; null for other types."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(v, path, "string"))


def is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def elements(v: Column) -> Column:
    """An array of VARIANT; empty for other values."""
    return F.coalesce(F.when(is_array(v), v.cast("array<variant>")), F.array().cast("array<variant>"))
