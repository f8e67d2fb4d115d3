"""Session helpers: a local session for tests and benches, and the package on the executors' Python path."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_folders: dict[str, str] = {}
_made: list[str] = []
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session; a cluster's own configuration is used elsewhere."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MARSHLIGHT_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do if PYTHONPATH has it, else it is sent once as a zip."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if any(Path(p).resolve() == ROOT for p in paths) or context.applicationId in _shipped:
        return
    target = Path(tempfile.mkdtemp(prefix="marshlight-zip-")) / "marshlight_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((ROOT / "marshlight").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the checkpoint folder that the context was given: driver and
    executors share it.

    Only where there is neither and the master is local, as in tests, a local temporary folder is made and used for the
    rest of the session. On a cluster that is an error, as executors don't see each other's disks.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(context.applicationId) or context.getCheckpointDir()
    if not base:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="marshlight-")
        spark.sparkContext.setCheckpointDir(base)
    _folders.setdefault(context.applicationId, base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    scope = _scope.get()
    if scope is not None:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at its end the scratch folders that this thread made in it; nothing that is still needed may be read from them."""
    mine: list[str] = []
    token = _scope.set(mine)
    try:
        yield
    finally:
        _scope.reset(token)
        make = spark._jvm.org.apache.hadoop.fs.Path
        for path in mine:
            make(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(make(path), True)


def scratch_mark() -> int:
    """How many scratch folders were made so far; what is made later can be dropped by ``drop_scratch``."""
    return len(_made)


def drop_scratch(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the scratch folders that were made since ``mark``, but those that ``keep`` is read from. Nothing else may read them any more."""
    held = {f.split("//")[-1].lstrip("/") for f in keep.inputFiles()}
    make = spark._jvm.org.apache.hadoop.fs.Path
    for path in _made[mark:]:
        plain = path.split("//")[-1].split(":", 1)[-1].lstrip("/")
        if not any(plain in f for f in held):
            make(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(make(path), True)


#: A table of fewer bytes than this, by Spark's estimate, may be dealt to all cores before costly work on its rows.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table, which often is a single split, in as many parts as there are cores; a larger one stays as it is, without a shuffle."""
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if small else df


#: Bytes, by Spark's estimate, of a table of narrow rows in each of the parts that it is dealt to.
DEALT_BYTES = 1 << 20


def parts_of(df: DataFrame) -> int:
    """How many parts of about ``DEALT_BYTES`` a table has, by Spark's estimate."""
    return max(-(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // DEALT_BYTES), 1)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """A table whose narrow rows are costly, or become wide, in parts of about ``DEALT_BYTES`` by the unique columns ``by``, and in at least as
    many as there are cores: tasks stay short and small however large the table is. Only what is used of the narrow rows is shuffled."""
    return df.repartition(max(parts_of(df), df.sparkSession.sparkContext.defaultParallelism), *by)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back: the lineage ends here and any executor can reread it."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``stored``, and aggregates over the rows that Spark takes as they are written: no job of their own, no second pass."""
    observed = Observation(label)
    rows = stored(df.observe(observed, *(c.alias(n) for n, c in metrics.items())), label)
    return rows, dict(observed.get)
