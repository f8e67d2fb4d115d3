"""Conversations as rows (conv_id, turn, role, text): their order, places in it, and digests of long ordered lists.

No conversation is ever gathered in one task: rows are dealt by ranges of (conv_id, turn, role, text), so that one that
holds much of the table lies in many neighbouring tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshlight.llm.common import map_arrow, parallelism, stored

#: Characters of role and text that order rows of one turn; a digest of both decides behind them, so range bounds stay small.
ORDER_CHARS = 64
ORDER = ("conv_id", "turn", "role_order", "text_order", "who")


def order_columns() -> dict[str, Column]:
    """What orders the rows of a turn: the heads of role and text, and ``who``, the SHA-256 of both in hex."""
    who = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return {"role_order": F.substring("role", 1, ORDER_CHARS), "text_order": F.substring("text", 1, ORDER_CHARS), "who": who}


def in_order(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows with the columns above in tasks by ranges of their order: conv_id, turn (nulls first), role, text."""
    return rows.repartitionByRange(tasks or parallelism(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER).drop("role_order", "text_order")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task and each row's place in its conversation as far as it lies in this task."""
    task, last, n = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        out = []
        for c in batch.column("conv_id").to_pylist():
            n, last = (n + 1, c) if c == last else (0, c)
            out.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(out), pa.int32()), pa.array(out, pa.int64())], names=[*batch.schema.names, "task", "place"])


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """Rows with ``place`` (long, from 0): the number of rows of the conversation before this one.

    A conversation goes on in another task at most once a task, so the table of what lies before it has as many rows as
    there are tasks; that bound allows to broadcast it.
    """
    ordered = in_order(rows)
    schema = T.StructType([*ordered.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("place", T.LongType())])
    local = stored(map_arrow(ordered, _places, schema), label)
    runs = local.groupBy("conv_id", "task").agg(F.count(F.lit(1)).alias("n"))
    ends = runs.groupBy("task").agg(F.min("conv_id").alias("least"), F.max("conv_id").alias("most"))  # only the outermost can go on
    outer = runs.join(ends, "task").filter((F.col("conv_id") == F.col("least")) | (F.col("conv_id") == F.col("most"))).select("conv_id", "task", "n")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = outer.select("conv_id", "task", before.alias("before")).filter("before is not null")  # at most a row a task
    return local.join(F.broadcast(before), ["conv_id", "task"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0))).drop("task", "before")


def ordered_sha256(pieces: DataFrame, keys: list[str], order: list[str], text: str, between: str) -> DataFrame:
    """(keys, sha256): of each key's pieces, joined by ``between`` in their order. A digest is a chain, so a key's pieces pass
    one task, one after the other and never together: make pieces long where a key has many."""
    kept = pieces.select(*keys, *order, text).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, text)
    joint = between.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done, hashes = [], []
            columns = [batch.column(k).to_pylist() for k in keys]
            for *key, piece in zip(*columns, batch.column(text).to_pylist(), strict=True):
                if digest is None or key != last:
                    if digest is not None:
                        done.append(last)
                        hashes.append(digest.hexdigest())
                    last, digest = key, hashlib.sha256()
                else:
                    digest.update(joint)
                digest.update(piece.encode())
            yield table(done, hashes)
        if digest is not None:
            yield table([last], [digest.hexdigest()])

    schema = T.StructType([*(kept.schema[k] for k in keys), T.StructField("sha256", T.StringType())])
    types = pa.schema([(f.name, {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f.dataType.typeName()]) for f in schema])

    def table(done: list[list], hashes: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in done], types.field(k).type) for k in range(len(keys))), pa.array(hashes, pa.string())], schema=types)

    return map_arrow(kept, run, schema)
