"""Tables that change together: versioned folders, and a manifest that is put in place last.

A commit writes new folders beside the old ones and then one manifest, which lists the folders of every table. Readers follow
the newest manifest, so that they see all of a commit or nothing of it; a commit that fails, or is only tried (dry run), leaves the
version before it as it was. A version is put in place by a rename that never replaces one: of two writers that
began with the same version, the second one fails and changes nothing.

Rows may be dealt to folders by a bucket (a hash of a key), so that a reader that knows its keys lists and reads only
their buckets.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class VersionConflict(RuntimeError):
    """Another commit came first."""


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """One version of the tables below a root. tables: parts (names of folders) and schema by table; notes: what the writer says of itself."""

    spark: SparkSession
    root: str
    version: int
    tables: dict
    notes: dict

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a table, or those of some buckets of it; None if it was never written."""
        told = self.tables.get(name)
        if told is None:
            return None
        schema = T.StructType.fromJson(told["schema"])
        if not told["parts"]:
            return self.spark.createDataFrame([], schema)
        dealt = [T.StructField("part", T.StringType())] + [T.StructField("bucket", T.IntegerType())] * told["bucketed"]
        rows = self.spark.read.option("basePath", f"{self.root}/{name}").schema(T.StructType([*schema.fields, *dealt])).parquet(*(f"{self.root}/{name}/part={p}" for p in told["parts"]))
        if buckets is not None and told["bucketed"]:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.drop("part", "bucket")

    def of_keys(self, name: str, keys: DataFrame, columns: list[str]) -> DataFrame | None:
        """Rows of the buckets that hold these keys: at most BUCKETS numbers pass the driver."""
        if name not in self.tables:
            return None
        return self.read(name, sorted(r[0] for r in keys.select(bucket(*columns)).distinct().collect()))


class Tables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        files, place = self._files(), self._path("_versions")
        if not files.exists(place):
            return []
        names = (s.getPath().getName() for s in files.listStatus(place))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or a given one; version 0 is empty."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return Snapshot(self.spark, self.root, 0, {}, {})
        stream = self._files().open(self._path(f"_versions/{version:012d}.json"))
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(self.spark, self.root, version, told["tables"], told["notes"])

    def commit(self, base: Snapshot, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, notes: dict | None = None, keys: dict[str, list[str]] | None = None, dry_run: bool = False) -> Snapshot:
        """The next version: base with rows appended to tables, or tables replaced. keys: what tables are dealt to buckets by.

        With dry_run everything is worked out and written, but never put in place, and is deleted again.
        """
        tables, keys, made = {n: dict(t) for n, t in base.tables.items()}, keys or {}, []
        try:
            for rows, anew in ((append or {}, False), (replace or {}, True)):
                for name, df in rows.items():
                    part = uuid.uuid4().hex
                    made.append(f"{name}/part={part}")
                    dealt = df.withColumn("bucket", bucket(*keys[name])) if name in keys else df
                    # a hot bucket is cut to many tasks, small ones share one
                    writer = dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", *keys[name]).write.partitionBy("bucket") if name in keys else dealt.write
                    writer.parquet(f"{self.root}/{name}/part={part}")
                    old = [] if anew else tables.get(name, {"parts": []})["parts"]
                    empty = not self._files().exists(self._path(f"{name}/part={part}")) or (name in keys and not any(s.isDirectory() for s in self._files().listStatus(self._path(f"{name}/part={part}"))))
                    tables[name] = {"parts": old + [part] * (not empty), "schema": json.loads(df.schema.json()), "bucketed": name in keys}
            if not dry_run:
                self._publish(base.version + 1, {"tables": tables, "notes": base.notes | (notes or {})})
        except BaseException:
            self._drop(made)
            raise
        if dry_run:
            self._drop(made)
            return base
        return self.snapshot(base.version + 1)

    def _drop(self, places: list[str]) -> None:
        for place in places:
            self._files().delete(self._path(place), True)

    def _publish(self, version: int, told: dict) -> None:
        """Write the manifest under another name and rename it, which fails if the version is there."""
        jvm, draft = self.spark._jvm, self._path(f"_versions/.{uuid.uuid4().hex}")
        stream = self._files().create(draft, False)
        try:
            stream.write(bytearray(json.dumps(told).encode()))
        finally:
            stream.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context = self._fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else jvm.java.net.URI("file:///"), self._conf)
            context.rename(draft, self._path(f"_versions/{version:012d}.json"), none)
        except Exception as error:
            self._files().delete(draft, False)
            if "AlreadyExists" in str(error):
                raise VersionConflict(f"version {version} of {self.root} was written by another commit") from None
            raise

    def compact(self, *names: str, keys: dict[str, list[str]] | None = None) -> Snapshot:
        """Write tables of many appended parts as one part each, with the same rows and buckets."""
        base, replace, by = self.snapshot(), {}, {}
        for name in names:
            told = base.tables[name]
            if len(told["parts"]) > 1:
                rows = base.read(name)
                replace[name] = rows
                if told["bucketed"]:
                    by[name] = (KEYS | (keys or {}))[name]
        return self.commit(base, replace=replace, keys=by) if replace else base

    def vacuum(self, keep: int = 2) -> int:
        """Delete folders that none of the last `keep` versions lists, and older manifests; how many folders went. Readers of older versions lose them."""
        kept = self.versions()[-keep:]
        used = {f"{n}/part={p}" for v in kept for n, t in self.snapshot(v).tables.items() for p in t["parts"]}
        names = {n for v in self.versions() for n in self.snapshot(v).tables}
        files, gone = self._files(), []
        for name in sorted(names):
            if files.exists(self._path(name)):
                gone += [place for s in files.listStatus(self._path(name)) if (place := f"{name}/{s.getPath().getName()}") not in used]
        for version in self.versions()[:-keep]:
            files.delete(self._path(f"_versions/{version:012d}.json"), False)
        self._drop(gone)
        return len(gone)


#: What the tables of an event store are dealt to buckets by.
KEYS = {"ids": ["event_id"], "places": ["session_id"], "states": ["file"], "open_calls": ["file"]}
