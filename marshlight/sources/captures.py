"""Cached captures as a data source of Spark: files ``<14 digits>.html`` of a folder, listed once, read in Arrow batches."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from marshlight.functions import constants as K
from marshlight.sources import folders

FORMAT = "cached_captures"
SCHEMA = "stamp string, source string, html string"
_ARROW = pa.schema([("stamp", pa.string()), ("source", pa.string()), ("html", pa.string())])
#: Bytes of files that one task reads, unless one file has more, and characters of a batch.
PARTITION_BYTES, BATCH_CHARS = 32 << 20, 4 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


class CaptureReader(DataSourceReader):
    """Reads the files whose stamp passes the pushed filters. Bodies shorter than ``smallest`` characters count as failures and
    are left out. Bytes that aren't UTF-8 are replaced."""

    def __init__(self, options: dict[str, str]):
        self.path, self.smallest = options["path"], int(options.get("smallest", K.SMALLEST_PAGE))
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Comparisons of the stamp choose files; all other filters are Spark's."""
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}
        for f in filters:
            if type(f) in kinds and f.attribute == ("stamp",):
                self.tests.append((kinds[type(f)], tuple(f.value) if isinstance(f, In) else f.value))
            else:
                yield f

    def wanted(self, stamp: str) -> bool:
        checks = {"=": lambda v: stamp == v, ">": lambda v: stamp > v, ">=": lambda v: stamp >= v, "<": lambda v: stamp < v, "<=": lambda v: stamp <= v, "in": lambda v: stamp in v}
        return all(checks[kind](value) for kind, value in self.tests)

    def partitions(self) -> list[Files]:
        system, path = folders.open_folder(self.path)
        out, held = [], 0
        for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name):
            match = re.fullmatch(r"(\d{14})\.html", f.base_name)
            if not f.is_file or not match or not self.wanted(match[1]):
                continue
            if not out or held + f.size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = folders.open_folder(self.path)
        rows, chars = [], 0
        for path in partition.paths:
            html = folders.read_bytes(system, path).decode("utf-8", "replace")
            if len(html) < self.smallest:
                continue
            stamp = posixpath.basename(path)[:14]
            rows.append((stamp, f"wayback:{stamp}", html))
            chars += len(html)
            if chars > BATCH_CHARS:
                yield _batch(rows)
                rows, chars = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], schema=_ARROW)


class CachedCaptures(DataSource):
    """``spark.read.format("cached_captures").load(folder)``: (stamp, source, html)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:  # noqa: ANN001
        return CaptureReader(dict(self.options))


def cached_captures(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The captures cached in a folder. A filter on stamp opens only the files that it wants."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CachedCaptures)
    return spark.read.format(FORMAT).options(**options).load(folder)


def cache_captures(pages: DataFrame, folder: str) -> int:
    """Write pages (stamp: 14 digits, html) as files of a folder, each by its task and whole or not at all; returns how many.
    Of equal stamps one is kept."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = folders.open_folder(folder)
        system.create_dir(path)
        for batch in batches:
            for stamp, html in zip(batch.column("stamp").to_pylist(), batch.column("html").to_pylist(), strict=True):
                folders.write_bytes(system, f"{path}/.{stamp}.part", (html or "").encode())
                system.move(f"{path}/.{stamp}.part", f"{path}/{stamp}.html")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    once = pages.filter(pages["stamp"].rlike(r"^[0-9]{14}$")).dropDuplicates(["stamp"]).select("stamp", "html")
    return once.mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0
