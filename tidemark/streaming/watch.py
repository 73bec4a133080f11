"""Continuous import of growing JSONL logs.

A tail source reads whole lines past what was read before; a file that shrank, or whose head changed, is read
anew, which deduplication makes harmless. Each batch goes through the import operators against the states of its files and
the buckets of its ids, and is committed with its number, so that a repeated batch changes nothing. There is no
watermark: late events are taken in wherever their time puts them.

The source lists and reads files by path, so logs have to be in a folder that driver and executors mount.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.commits import Tables
from tidemark.operators.tables import scratch, settle
from tidemark.sources.intake import take, take_tree
from tidemark.sources.jsonl import ImportOptions
from tidemark.sources.lines import numbered
from tidemark.sources.transcripts import ADAPTERS

HEAD = 4096
#: Bytes of one task; longer additions are cut at line ends.
TASK_BYTES = 64 << 20


class Piece(InputPartition):
    """Bytes of a file that a task reads; begin: where this batch begins to read the file."""

    def __init__(self, file: str, start: int, end: int, begin: int):
        self.file, self.start, self.end, self.begin = file, start, end, begin


def _head(path: str, size: int) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(min(HEAD, size))).hexdigest()


def _complete(path: str, size: int) -> int:
    """Bytes up to and with the last line end."""
    with open(path, "rb") as f:
        at = size
        while at > 0:
            start = max(0, at - (1 << 16))
            f.seek(start)
            k = f.read(at - start).rfind(b"\n")
            if k >= 0:
                return start + k + 1
            at = start
    return 0


class TailReader(DataSourceStreamReader):
    """Offsets: for each file the bytes read, and the hash of its head as far as it was read."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(folder, name)
                if name.endswith(self.suffix) and not os.path.islink(path) and (end := _complete(path, os.path.getsize(path))):
                    out[os.path.relpath(path, self.root)] = {"end": end, "head": _head(path, end)}
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pieces: list[InputPartition] = []
        for file, now in sorted(end.items()):
            then = start.get(file, {"end": 0, "head": ""})
            grown = then["end"] <= now["end"] and (then["end"] == 0 or _head(os.path.join(self.root, file), then["end"]) == then["head"])
            at = begin = then["end"] if grown else 0
            while at < now["end"]:
                to = min(at + TASK_BYTES, now["end"])
                if to < now["end"]:
                    to = max(_complete(os.path.join(self.root, file), to), at) or to
                    to = now["end"] if to <= at else to
                pieces.append(Piece(file, at, to, begin))
                at = to
        return pieces

    def read(self, partition: Piece) -> Iterator[tuple]:
        with open(os.path.join(self.root, partition.file), "rb") as f:
            f.seek(partition.start)
            at, k = partition.start, 0
            while at < partition.end:
                line = f.readline()
                if not line:
                    break  # the file was cut meanwhile; the next batch sees that
                yield partition.file, partition.start, k, at, len(line), partition.begin, line.rstrip(b"\r\n").decode("utf-8", errors="replace")
                at, k = at + len(line), k + 1

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """spark.readStream.format("jsonl_tail").option("path", …): file, block and k (piece and place of a line in it), at and bytes (where a line begins, how long it is), begin, text."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return "file string, block long, k long, at long, bytes long, begin long, text string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], self.options.get("suffix", ".jsonl"))


def stored_events(spark: SparkSession, target: str) -> DataFrame | None:
    """What was stored so far; None before the first commit."""
    return Tables(spark, target).snapshot().read("events")


def take_in(target: str, options: ImportOptions = ImportOptions(), normalize: Callable[..., DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that imports lines into `target`: events, or records that `normalize` (one of transcripts.ADAPTERS) makes events of."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        with scratch():
            lines = numbered(settle(rows, "tail")).withColumns({"v": F.try_parse_json("text"), "end": F.col("at") + F.col("bytes")}).select("file", "line", "text", "v", "at", "end", "begin")
            if normalize is None:  # a line's number is where it begins: several batches read a file
                lines = lines.where(F.length(F.trim("text")) > 0).select("file", F.col("at").alias("line"), "text", "v")
            take(Tables(spark, target), lines, normalize, options, run=(spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream", number))

    return batch


class CycleReader(SimpleDataSourceStreamReader):
    """One row in each trigger: the clock of sources that are looked at as a whole."""

    def initialOffset(self) -> dict:
        return {"cycle": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        return iter([(start["cycle"] + 1,)]), {"cycle": start["cycle"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k,) for k in range(start["cycle"] + 1, end["cycle"] + 1)])


class Cycles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cycles"

    def schema(self) -> str:
        return "cycle long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return CycleReader()


def watch(spark: SparkSession, root: str, target: str, options: ImportOptions = ImportOptions(), interval: int | None = 60, adapter: str | None = None):
    """A running query that imports what is appended below root; interval None: what is there now, then stop. adapter: whose transcripts they are.

    Logs of lines are tailed; a tree of files (opencode) is listed in each trigger, and what is finished behind each session's frontier
    is taken. Each source gets a query of its own, so that one that fails leaves the others running; stop() ends one.
    """
    if adapter == "opencode":
        spark.dataSource.register(Cycles)
        rows = spark.readStream.format("cycles").load()
        named = lambda s: s.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        take_rows = lambda df, number: take_tree(Tables(df.sparkSession, target), root, options, run=(named(df.sparkSession), number))
    else:
        spark.dataSource.register(Tail)
        rows = spark.readStream.format("jsonl_tail").option("path", root).load()
        take_rows = take_in(target, options, ADAPTERS[adapter] if adapter else None)
    writer = rows.writeStream.foreachBatch(take_rows).option("checkpointLocation", f"{target}/_offsets")
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=f"{interval} seconds")).start()


def watch_all(spark: SparkSession, sources: dict[str, tuple[str, str]], target: str, options: ImportOptions = ImportOptions(), interval: int | None = 60) -> dict:
    """A query for each source (name: adapter and root), each with a folder of its own below target; one that fails leaves the others running."""
    return {name: watch(spark, root, f"{target}/{name}", options, interval, adapter if adapter in WATCHED else None) for name, (adapter, root) in sources.items()}


WATCHED = (*ADAPTERS, "opencode")


class _Heard(StreamingQueryListener):
    """Notes which queries have ended a trigger since they were last asked about."""

    def __init__(self):
        self.went_well: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.went_well.add(str(event.progress.runId))

    def onQueryIdle(self, event) -> None:
        self.went_well.add(str(event.runId))

    def onQueryTerminated(self, event) -> None:
        pass


class Supervisor:
    """Keeps the queries of several sources going: one that fails is started again after a pause that doubles, and the others go on.

    report(name, message) is called once for an error, however often it comes again in the same words; a trigger that ends well
    makes it news again, and the pause short. step() looks once, run() until stop() is called.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, tuple[str, str]], target: str, options: ImportOptions = ImportOptions(), interval: int | None = 60, report: Callable[[str, str], None] = print, pause: float = 1.0, longest: float = 300.0, start: Callable | None = None):
        self.spark, self.sources, self.report, self.pause, self.longest = spark, sources, report, pause, longest
        self.start = start or (lambda name: watch(spark, sources[name][1], f"{target}/{name}", options, interval, sources[name][0] if sources[name][0] in WATCHED else None))
        self.queries: dict = {}
        self.errors: dict[str, str] = {}
        self.waits: dict[str, float] = {}
        self.due: dict[str, float] = dict.fromkeys(sources, 0.0)
        self.failures, self.suppressed, self.ended = 0, 0, False
        self.heard = _Heard()
        spark.streams.addListener(self.heard)

    @staticmethod
    def told(error: BaseException) -> str:
        """The error in words that don't change from run to run: of a traceback its last line."""
        plain = re.sub(r"\[id = [^\]]*\]|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "", str(error)).split("JVM stacktrace")[0]
        raised = re.findall(r"^[A-Za-z_][\w.]*(?:Error|Exception): .*$", plain, re.M)
        return raised[-1].strip() if raised else plain.strip().splitlines()[0] if plain.strip() else type(error).__name__

    def _failed(self, name: str, error: BaseException, now: float) -> None:
        words = self.told(error)
        if self.errors.get(name) == words:
            self.suppressed += 1
        else:
            self.failures += 1
            self.report(name, words)
        self.errors[name] = words
        self.waits[name] = min(self.longest, 2 * self.waits[name]) if name in self.waits else self.pause
        self.due[name] = now + self.waits[name]

    def step(self) -> bool:
        """Start what is due, look after what has ended; whether anything is running or will be started again."""
        now = time.monotonic()
        for name in self.sources:
            query = self.queries.get(name)
            if query is not None:
                if str(query.runId) in self.heard.went_well:
                    self.errors.pop(name, None)
                    self.waits.pop(name, None)
                if query.isActive:
                    continue
                del self.queries[name]
                if (error := query.exception()) is not None:
                    self._failed(name, error, now)
            if name in self.due and now >= self.due[name] and not self.ended:
                del self.due[name]
                try:
                    self.queries[name] = self.start(name)
                except Exception as error:
                    self._failed(name, error, now)
        return bool(self.queries or (self.due and not self.ended))

    def run(self, every: float = 0.2) -> None:
        while self.step() and not self.ended:
            time.sleep(every)
        self.stop()

    def stop(self) -> None:
        self.ended = True
        for query in self.queries.values():
            query.stop()
        self.spark.streams.removeListener(self.heard)


def cursor(target: str) -> dict:
    """Offsets of the last batch, by file."""
    folder = f"{target}/_offsets/offsets"
    numbers = [int(x) for x in os.listdir(folder) if x.isdigit()]
    with open(f"{folder}/{max(numbers)}") as f:
        return json.loads(f.read().splitlines()[-1])
