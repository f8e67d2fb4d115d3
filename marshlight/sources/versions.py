"""Folders that are replaced as a whole: every write is a version of its own, and a name points at the newest one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer has published the version meanwhile."""


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    """(the file system of a path, its constructor of paths)."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def exists(spark: SparkSession, path: str) -> bool:
    fs, make = file_system(spark, path)
    return fs.exists(make(path))


def name_file(spark: SparkSession, draft: str, final: str) -> bool:
    """Give a finished file its name; False if the name is taken. Exclusive on local file systems (a link) and on those
    whose rename doesn't overwrite, as on HDFS."""
    fs, make = file_system(spark, final)
    if fs.getScheme() != "file":
        return not fs.exists(make(final)) and fs.rename(make(draft), make(final))
    java, local = spark._jvm.java, lambda p: spark._jvm.java.io.File(make(p).toUri().getPath()).toPath()
    try:
        java.nio.file.Files.createLink(local(final), local(draft))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    fs.delete(make(draft), False)
    return True


def newest_version(spark: SparkSession, path: str) -> int:
    """0: nothing published."""
    fs, make = file_system(spark, path)
    folder = make(f"{path}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What was published as a version, the newest by default; None without one."""
    version = newest_version(spark, path) if version is None else version
    if not version:
        return None
    fs, make = file_system(spark, path)
    stream = fs.open(make(f"{path}/_versions/v{version}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_version(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Make a small JSON document the given version: at once and once only."""
    fs, make = file_system(spark, path)
    draft = f"{path}/_versions/draft-{uuid.uuid4().hex}"
    stream = fs.create(make(draft), False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if not name_file(spark, draft, f"{path}/_versions/v{version}.json"):
        fs.delete(make(draft), False)
        raise ConflictError(f"version {version} of {path} is taken")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; nothing if it isn't there."""
    fs, make = file_system(spark, path)
    fs.delete(make(path), True)


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None], base: int | None = None) -> str:
    """Let ``write`` fill a new folder below ``path`` and make it the current one. A reader sees the whole old folder or the
    whole new one; a writer that dies leaves the old one current.

    ``base``: the version that the new one was made from. If another was published since, this one isn't, and
    ``ConflictError`` tells so: read again and try again. Without it the newest is replaced, whatever it holds.
    """
    version, folder = (newest_version(spark, path) if base is None else base) + 1, f"data-{uuid.uuid4().hex}"
    if newest_version(spark, path) >= version:  # known to be lost before anything is written
        raise ConflictError(f"version {version} of {path} is taken")
    write(f"{path}/{folder}")
    try:
        publish_version(spark, path, version, {"folder": folder})
    except ConflictError:
        delete(spark, f"{path}/{folder}")
        raise
    return f"{path}/{folder}"


def current_folder(spark: SparkSession, path: str, version: int | None = None) -> str | None:
    """The folder of a version, the newest by default; None without one."""
    found = read_version(spark, path, version)
    return f"{path}/{found['folder']}" if found else None


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table of the current folder."""
    folder = current_folder(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(folder)


def forget_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete the folders that none of the newest ``keep`` versions (one at least) points at. Not while a writer is at work."""
    fs, make = file_system(spark, path)
    newest = newest_version(spark, path)
    live = {read_version(spark, path, v)["folder"] for v in range(max(newest - max(keep, 1), 0) + 1, newest + 1)}
    dead = [s.getPath() for s in fs.listStatus(make(path)) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in live] if newest else []
    for folder in dead:
        fs.delete(folder, True)
    return len(dead)
