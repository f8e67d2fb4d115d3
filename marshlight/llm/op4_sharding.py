"""Operator 4: a table of immutable Parquet shards with size-tiered compaction and versioned manifests."""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshlight.llm.common import free_name, scratch_dir, table

ARRIVALS = 6


#: Shards of a full segment of a manifest.
SEGMENT_SHARDS = 4_096


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ConflictError(RuntimeError):
    """Another writer has committed the version meanwhile; read the new one and try again."""


def merged_schema(old: T.StructType | None, new: T.StructType) -> T.StructType:
    """The columns of both, all of them nullable; ``ValueError`` if one has two types."""
    types: dict[str, T.DataType] = {}
    for field in [*(old or []), *new]:
        if types.setdefault(field.name, field.dataType) != field.dataType:
            raise ValueError(f"column {field.name} is {types[field.name].simpleString()} in the store and {field.dataType.simpleString()} here")
    return T.StructType([T.StructField(n, t, True) for n, t in types.items()])


class ShardStore:
    """Shards under ``<path>/data`` and one manifest a version under ``<path>/manifests``.

    A version is a short list of segments, files of up to ``segment_shards`` shards that never change; a commit writes those segments
    anew that it takes shards from, or that have room, and one for what it adds, so that its work doesn't grow with the store.
    For very large stores raise ``target_bytes`` too: a shard is what a manifest counts.

    A shard never changes. A version lists the live shards and the columns of all shards so far: deliveries may bring new
    columns, which are null in older rows, and may lack some; a column of another type is refused. A version becomes visible when its finished file gets its name, by a
    link on a local file system and by a rename elsewhere. Both fail if the name is taken (on HDFS too; an object store
    whose rename overwrites needs a store in front of it that doesn't), so readers see the old version or the new one, and
    of two writers one gets ``ConflictError``. Only file names and sizes pass through the driver, never rows. Compaction deletes
    nothing, so earlier versions and tables read from them stay readable until ``vacuum`` deletes the shards that only
    they list, with files of jobs that died, which no manifest lists.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 64 << 20, fanout: int = 4, smallest_bytes: int = 1 << 20, segment_shards: int = SEGMENT_SHARDS):
        self.spark, self.path, self.target, self.fanout, self.smallest = spark, path.rstrip("/"), target_bytes, fanout, smallest_bytes
        self.segment, self._known = segment_shards, {}
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0: nothing committed."""
        return max([0, *(int(n[1:-5]) for n in self._names() if n.startswith("v") and n.endswith(".json"))])

    def _names(self) -> list[str]:
        folder = self._path(f"{self.path}/manifests")
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _write(self, name: str, content: dict | list) -> None:
        stream = self._fs.create(self._path(f"{self.path}/manifests/{name}"), False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    def _segments(self, version: int) -> dict[str, list[Shard]]:
        """The segments that a version lists, with their shards; each is read once, as it never changes."""
        names = self._read(f"v{version}.json")["segments"] if version else []
        for name in names:
            if name not in self._known:
                self._known[name] = [Shard(**s) for s in self._read(name)]
        return {name: self._known[name] for name in names}

    def manifest(self, version: int | None = None) -> tuple[list[Shard], T.StructType | None]:
        version = self.version() if version is None else version
        if version == 0:
            return [], None
        schema = T.StructType.fromJson(self._read(f"v{version}.json")["schema"])
        return [s for shards in self._segments(version).values() for s in shards], schema

    def _commit(self, base: int, shards: list[Shard], schema: T.StructType) -> int:
        """Segments all of whose shards are still live stay, but for a last one that has room; the other shards get new segments."""
        live, kept = set(shards), {}
        for name, held in (self._segments(base) if base == self.version() else {}).items():
            if len(held) == self.segment and live.issuperset(held):
                kept[name] = held
        listed = {s for held in kept.values() for s in held}
        new = [s for s in shards if s not in listed]
        names = list(kept)
        for k in range(0, len(new), self.segment):
            names.append(f"segment-{uuid.uuid4().hex}.json")
            self._write(names[-1], [vars(s) for s in new[k : k + self.segment]])
        draft = f"draft-{uuid.uuid4().hex}"
        self._write(draft, {"version": base + 1, "schema": schema.jsonValue(), "segments": names})
        draft, final = (self._path(f"{self.path}/manifests/{n}") for n in (draft, f"v{base + 1}.json"))
        taken = not self._named(draft, final)
        self._fs.delete(draft, False)
        if taken:
            for name in names[len(kept) :]:
                self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)
            raise ConflictError(f"version {base + 1} of {self.path} is taken")
        return base + 1

    def _named(self, draft: JavaObject, final: JavaObject) -> bool:
        """Give a finished file its name; False if the name is taken."""
        if self._fs.getScheme() != "file":
            return not self._fs.exists(final) and self._fs.rename(draft, final)
        java, path = self.spark._jvm.java, lambda p: self.spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            java.nio.file.Files.createLink(path(final), path(draft))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _files(self, folder: str) -> list[Shard]:
        where, out = self._path(folder), []
        if self._fs.exists(where):
            files = self._fs.listFiles(where, True)
            while files.hasNext():
                f = files.next()
                if f.getPath().getName().endswith(".parquet"):
                    out.append(Shard(f.getPath().toString(), f.getLen()))
        return sorted(out, key=lambda s: s.path)

    def append(self, rows: DataFrame) -> int:
        """Write rows as new small shards, as they lie in their partitions (no shuffle), and commit them."""
        base = self.version()
        shards, schema = self.manifest(base)
        merged_schema(schema, rows.schema)  # refused before anything is written
        folder = f"{self.path}/data/append-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self._commit(base, shards + self._files(folder), merged_schema(schema, rows.schema))

    def append_arrivals(self, rows: DataFrame, arrival: F.Column, compact: bool = True) -> int:
        """Append several arrivals that come in one table: one pass writes them apart, then each gets a version of its own,
        in the order of their numbers, followed by the compaction that it makes due."""
        schema = merged_schema(self.manifest()[1], rows.schema)
        folder, column = f"{self.path}/data/append-{uuid.uuid4().hex}", free_name(rows, "_arrival")
        rows.withColumn(column, arrival.cast("int")).write.partitionBy(column).parquet(folder)
        by_arrival: dict[str, list[Shard]] = defaultdict(list)
        for shard in self._files(folder):
            by_arrival[shard.path.rsplit("/", 2)[1]].append(shard)
        if not by_arrival:
            return self._commit(self.version(), self.manifest()[0], schema)
        for key in sorted(by_arrival):
            base = self.version()
            shards, known = self.manifest(base)
            self._commit(base, shards + by_arrival[key], merged_schema(known, schema))
            while compact and self.compact():
                pass
        return self.version()

    def tier(self, shard: Shard) -> int:
        return max(0, math.floor(math.log(max(shard.bytes, 1) / self.smallest, self.fanout)) + 1)

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs of similar size to merge: tiers with ``fanout`` shards or more that are under half the target size."""
        tiers: dict[int, list[Shard]] = defaultdict(list)
        for s in shards:
            if 2 * s.bytes < self.target:
                tiers[self.tier(s)].append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]

    def compact(self) -> bool:
        """Merge what is due into files of about the target size and commit; False if nothing is.

        Whole files are read side by side and written again, each output by one task, so there is no shuffle; a task
        holds a row group, not a file.
        """
        base = self.version()
        shards, schema = self.manifest(base)
        runs = self.due(shards)
        if not runs:
            return False
        gone = [s for run in runs for s in run]
        folder = f"{self.path}/data/compact-{uuid.uuid4().hex}"
        for k, run in enumerate(runs):
            outputs = max(1, round(sum(s.bytes for s in run) / self.target))
            self.spark.read.schema(schema).parquet(*(s.path for s in run)).coalesce(outputs).write.parquet(f"{folder}/{k}")
        self._commit(base, [s for s in shards if s not in set(gone)] + self._files(folder), schema)
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Delete data files that none of the newest ``keep`` versions (one at least) lists; earlier ones can't be read then. Not
        while a writer is at work."""
        newest = self.version()
        live = {s.path for v in range(max(newest - max(keep, 1), 0) + 1, newest + 1) for s in self.manifest(v)[0]}
        dead = [s for s in self._files(f"{self.path}/data") if s.path not in live]
        for s in dead:
            self._fs.delete(self._path(s.path), False)
        listed = {name for v in range(max(newest - max(keep, 1), 0) + 1, newest + 1) for name in self._segments(v)}
        for name in self._names():
            if name.startswith("segment-") and name not in listed:
                self._fs.delete(self._path(f"{self.path}/manifests/{name}"), False)
        return len(dead)

    def read(self, version: int | None = None) -> DataFrame:
        shards, schema = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema or T.StructType())
        return self.spark.read.schema(schema).parquet(*(s.path for s in shards))


def shard_documents(docs: DataFrame, path: str, arrivals: int = ARRIVALS, **options: int) -> ShardStore:
    """Store documents as ``arrivals`` deliveries (doc_id modulo their number; null ids in the first), compacting as they come.

    Every row is stored once with all its columns, repeated rows and null or empty texts too.
    An empty table gives a version without shards that reads as an empty table.
    """
    store = ShardStore(docs.sparkSession, path, **options)
    store.append_arrivals(docs, F.coalesce(F.pmod(F.col("doc_id"), F.lit(arrivals)), F.lit(0)))
    return store


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard all documents and return, from the newest version's shards, a digest of each."""
    rows = shard_documents(table(spark, sf_dir, "documents"), scratch_dir(spark, "shards")).read()
    arrival = F.coalesce(F.pmod("doc_id", F.lit(ARRIVALS)), F.lit(0)).cast("int").alias("arrival")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", arrival, "lang", "source", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


ORACLE = f"""
SELECT doc_id, coalesce(doc_id % {ARRIVALS}, 0)::INTEGER AS arrival, lang, source, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
       sha256(coalesce(text, '')) AS text_sha256 FROM documents"""
