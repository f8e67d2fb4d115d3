"""The exports as a sink of Spark: tasks write parts, and a commit on the driver publishes all of them or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from marshlight.functions import constants as K
from marshlight.functions import geo
from marshlight.operators import export
from marshlight.sources import folders, versions

FORMAT = "archive_export"
#: What is written: a CSV record, a GeoJSON feature (null: no geometry) and its bounds.
SCHEMA = "record string, feature string, min_lon double, min_lat double, max_lon double, max_lat double"
BOUNDS = ("min_lon", "min_lat", "max_lon", "max_lat")


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: its place in the order, its files' name, rows, features and their bounds."""

    number: int
    name: str
    rows: int
    features: int
    bounds: list[float] | None


class ExportWriter(DataSourceArrowWriter):
    """Writes ``<path>/data-<id>/operations.csv`` and ``operations.geojson``, each in parts whose concatenation in name order is
    the document, and then publishes ``data-<id>`` as the newest version of ``<path>``.

    Files of attempts that failed or came second lie in a folder of their own and are never part of a document. ``abort`` leaves what
    was published before.
    """

    def __init__(self, path: str):
        self.path, self.folder = path, f"data-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, path = folders.open_folder(self.path)
        context = TaskContext.get()
        name, at = f"{context.partitionId():08}-{context.taskAttemptId()}", f"{path}/{self.folder}/attempts"
        system.create_dir(at)
        rows = features = 0
        bounds: list[float] | None = None
        with system.open_output_stream(f"{at}/{name}.csv") as flat, system.open_output_stream(f"{at}/{name}.json") as shaped:
            for batch in iterator:
                rows += batch.num_rows
                flat.write("".join(f"{r}\r\n" for r in batch.column("record").to_pylist()).encode())
                drawn = [f for f in batch.column("feature").to_pylist() if f is not None]
                shaped.write("".join((",\n" if features or k else "") + f for k, f in enumerate(drawn)).encode())
                features += len(drawn)
                for values in zip(*(batch.column(b).to_pylist() for b in BOUNDS), strict=True):
                    if None not in values:
                        bounds = merged_bounds(bounds, list(values))
        return Part(context.partitionId(), name, rows, features, bounds)

    def commit(self, messages: list[Part | None]) -> None:
        """Put the parts in their places, write what stands round and between them, and publish."""
        system, path = folders.open_folder(self.path)
        base, at = folders.newest(system, path), f"{path}/{self.folder}"
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.number)
        for name in ("operations.csv", "operations.geojson"):
            system.create_dir(f"{at}/{name}")
        bounds = None
        for p in parts:
            system.move(f"{at}/attempts/{p.name}.csv", f"{at}/operations.csv/1-{p.number:08}.csv")
            system.move(f"{at}/attempts/{p.name}.json", f"{at}/operations.geojson/1-{p.number:08}.json")
            bounds = merged_bounds(bounds, p.bounds)
        for p in [p for p in parts if p.features][:-1]:
            folders.write_bytes(system, f"{at}/operations.geojson/1-{p.number:08}.sep", b",\n")
        system.create_dir(f"{at}/attempts")
        system.delete_dir(f"{at}/attempts")
        folders.write_bytes(system, f"{at}/operations.csv/0-head.csv", (export.BOM + ",".join(K.EXPORT_COLUMNS) + "\r\n").encode())
        box = f'"bbox":{json.dumps(bounds)},' if bounds else ""
        folders.write_bytes(system, f"{at}/operations.geojson/0-head.json", f'{{"type":"FeatureCollection",{box}"features":[\n'.encode())
        folders.write_bytes(system, f"{at}/operations.geojson/2-foot.json", b"\n]}\n")
        rows, features = sum(p.rows for p in parts), sum(p.features for p in parts)
        content = {"folder": self.folder, "rows": rows, "features": features, "skipped": rows - features, "bbox": bounds}
        if not folders.publish(system, path, base + 1, content):
            self.abort(messages)
            raise versions.ConflictError(f"version {base + 1} of {self.path} is taken")

    def abort(self, messages: list[Part | None]) -> None:
        system, path = folders.open_folder(self.path)
        system.create_dir(f"{path}/{self.folder}")
        system.delete_dir(f"{path}/{self.folder}")


def merged_bounds(one: list[float] | None, other: list[float] | None) -> list[float] | None:
    if one is None or other is None:
        return one or other
    return [min(one[0], other[0]), min(one[1], other[1]), max(one[2], other[2]), max(one[3], other[3])]


class ArchiveExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> ExportWriter:  # noqa: ANN001
        return ExportWriter(self.options["path"])


def export_table(ops: DataFrame, shapes: DataFrame) -> DataFrame:
    """SCHEMA of all operations, in the order of (date, area_name, id): one join and one sort for both documents."""
    box = geo.bbox(F.col("polygons"))
    drawn = F.size("polygons") > 0
    side = export._shape_side(shapes, F.when(drawn, export.geometry_json()).alias("geometry"), F.when(drawn, box).alias("box"))
    # sorted before anything is made of a row: Spark reads a sort's input twice, and less is shuffled
    rows = ops.join(side, "mid", "left").withColumn("_area", F.coalesce("area_name", F.lit(""))).orderBy("date", "_area", "id")
    rows = rows.select(*export._export_columns(), "geometry", "box")
    feature = F.when(F.col("geometry").isNotNull(), export.feature_json())
    made = rows.select(export.csv_line().alias("record"), feature.alias("feature"), *(F.col(f"box.{b}").alias(b) for b in BOUNDS))
    return made.select(*(f.split()[0] for f in SCHEMA.split(", ")))


def publish_export(ops: DataFrame, shapes: DataFrame, path: str) -> dict:
    """Publish both exports as the newest version of ``path``; what was published: folder, rows, features, skipped, bbox.

    The extent and the count of operations without geometry come with the tasks' commit messages. A job that fails leaves the
    version before it current.
    """
    spark = ops.sparkSession
    spark.dataSource.register(ArchiveExport)
    export_table(ops, shapes).write.format(FORMAT).mode("overwrite").save(path)
    return versions.read_version(spark, path)


def exported_features(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(feature): the lines of a published feature collection that are features."""
    folder = versions.current_folder(spark, path, version)
    lines = spark.read.text(f"{folder}/operations.geojson").select(F.regexp_replace("value", ",$", "").alias("feature"))
    return lines.filter(F.col("feature").startswith('{"type":"Feature",'))
