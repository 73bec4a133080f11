"""Small helpers shared by the operators: tables, shared storage, batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import shared_dir

ARROW_BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lost executor then costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.settled_at = path
    return back


def release(*settled: DataFrame | None) -> None:
    """Delete settled tables that nothing still to be computed reads."""
    for df in settled:
        if df is not None and (path := getattr(df, "settled_at", None)):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def packed(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs), doc_id, version: rows that can be joined whatever their columns' names are."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", F.xxhash64("text").alias("version"))


def unpacked(rows: DataFrame, like: DataFrame, **instead: Column) -> DataFrame:
    """The columns of like from the struct row; those named in `instead` by these expressions."""
    return rows.select(*(instead.get(c, F.col("row").getField(c)).alias(c) for c in like.columns))


def same_document(left: DataFrame, right: DataFrame):
    """Condition of a join of document rows by id and version, in which null ids are equal."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["version"] == right["version"])


BROADCAST_ROWS = 400_000


def small(df: DataFrame) -> DataFrame:
    """A settled table of a few narrow columns: marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows, and by bytes where this Spark can, so that long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
