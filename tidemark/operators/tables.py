"""Tables in the shared folder, which cut plans and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: list[list[tuple[SparkSession, str]]] = []
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only if the session names none and runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A settled table of a few narrow columns: marked for broadcast if it has at most BROADCAST_ROWS rows, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables settled inside are deleted at the end: for jobs that write their results themselves."""
    _scratch.append([])
    try:
        yield
    finally:
        for spark, path in _scratch.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
