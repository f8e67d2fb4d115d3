"""Observations that arrive as files, merged into a stored archive batch by batch.

A store is a folder of buckets: ids are dealt to them by a hash, a batch rewrites those that its rows touch, in a folder of
its own, and publishes a version that lists every bucket's newest folder. The version also says which batch of which
query it holds, so a batch is merged once however often it is tried, and several queries may feed one store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from marshlight.operators.merge import backfill_fold, merge_append_only
from marshlight.session import scratch_scope, stored, stored_with
from marshlight.sources import versions

COLUMNS_NOT_STORED = ("existed",)
#: Buckets of the stored archive: a batch rewrites those that its ids fall into. Fixed when a store is begun.
BUCKETS = 64
#: How often a batch is merged anew when other queries publish before it does.
TRIES = 20

Hook = Callable[[int, int, int], None]


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave to the query of a checkpoint: it stays the same over restarts."""
    fs, make = versions.file_system(spark, checkpoint)
    stream = fs.open(make(f"{checkpoint}/metadata"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def merge_batch(spark: SparkSession, store: str, query: str, number: int, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], buckets: int, bad: DataFrame | None = None) -> dict | None:
    """Combine rows (with id, stored, as they are read several times) of a query's batch into a store; what was published of it (rows, new, rejected), None if it was before.

    ``combine``: (stored rows, incoming rows) to rows, with ``existed`` if new ones are to be counted. ``bad``: rows for the
    error table, which the same version publishes. Another query that publishes first makes this one read and merge again.
    """
    bucket_of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    for _ in range(TRIES):
        base = versions.newest_version(spark, store)
        found = versions.read_version(spark, store, base) or {"buckets": buckets, "of": {}, "columns": None, "done": {}, "errors": []}
        if found["done"].get(query, -1) >= number:
            return None
        bucket, folder, made = bucket_of(found["buckets"]), f"{store}/batch-{uuid.uuid4().hex}", []
        sizes = {r["_bucket"]: r["count"] for r in incoming.groupBy(bucket.alias("_bucket")).count().collect()}  # at most as many as there are buckets
        touched, counted = sorted(sizes), {"rows": sum(sizes.values())}
        paths = [found["of"][str(b)] for b in touched if str(b) in found["of"]]
        old = spark.read.schema(T.StructType.fromJson(found["columns"])).parquet(*paths) if paths else incoming.limit(0)
        merged = combine(old, incoming)
        if "existed" in merged.columns:
            merged, news = stored_with(merged, "merged", new=F.count_if(~F.col("existed")))
            counted |= news
        merged = merged.drop(*COLUMNS_NOT_STORED)
        if touched:
            merged.withColumn("_bucket", bucket).repartition(found["buckets"], "_bucket").write.partitionBy("_bucket").parquet(folder)
            made.append(folder)
        if bad is not None:
            wrong, n_bad = stored_with(bad, "rejects", rejected=F.count(F.lit(1)))
            counted |= n_bad
            if n_bad["rejected"]:
                wrong.write.parquet(f"{folder}-errors")
                made.append(f"{folder}-errors")
        errors = [*found["errors"], *(m for m in made if m.endswith("-errors"))]
        columns = merged.schema.jsonValue() if touched else found["columns"]
        content = {"buckets": found["buckets"], "of": found["of"] | {str(b): f"{folder}/_bucket={b}" for b in touched}, "columns": columns, "done": found["done"] | {query: number}, "errors": errors, "last": counted}
        try:
            versions.publish_version(spark, store, base + 1, content)
            return counted
        except versions.ConflictError:
            for path in made:
                versions.delete(spark, path)
    raise versions.ConflictError(f"{store} was changed {TRIES} times while batch {number} of {query} was merged")


@dataclass
class Progress(StreamingQueryListener):
    """Collects (batch, rows) of the queries that it hears of, as Spark reports them; ``spark.streams.addListener`` makes it listen."""

    batches: list[tuple[str, int, int]] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        """Nothing to note."""

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.observedMetrics["arrived"]["rows"] if "arrived" in p.observedMetrics else p.numInputRows))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        """Nothing to note."""

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.exception:
            self.errors.append(event.exception)


def stream_merge(
    spark: SparkSession, folder: str, schema: T.StructType, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], files_per_batch: int = 100, buckets: int = BUCKETS,
    reason: Column | None = None, on_batch: Hook | None = None,
) -> None:
    """Merge all files of ``folder`` that this checkpoint didn't merge yet into the table ``store`` and stop.

    No watermark: how late an observation may come is unbounded, and ranks settle what wins. A batch that failed before it
    was published is done again from the start, and one that was published is skipped. ``prepare`` turns raw rows into
    observations with id, source and seq. Prepared rows for which ``reason`` isn't null aren't merged: the batch writes
    them, with reason and batch, to the store's error table (``rejects``). ``on_batch`` is called after a batch was published,
    with its number, its observations and the ids that were new.
    """

    def merge(batch: DataFrame, number: int) -> None:
        with scratch_scope(spark):
            rows, bad = stored(prepare(batch), "prepared"), None
            if reason is not None:
                marked = rows.withColumn("reason", reason)
                rows, bad = marked.filter("reason is null").drop("reason"), marked.filter("reason is not null").withColumn("batch", F.lit(number).cast("long"))
            done = merge_batch(spark, store, query_id(spark, checkpoint), number, rows, merge_append_only, buckets, bad)
        if done is not None and on_batch is not None:
            on_batch(number, done["rows"], done["new"])

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).observe("arrived", F.count(F.lit(1)).alias("rows"))
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new``, and of ``old`` those of other ids; an id is once in each, so nothing has to be grouped."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def stream_fold(spark: SparkSession, folder: str, schema: T.StructType, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], files_per_batch: int = 100, buckets: int = BUCKETS) -> None:
    """Fold all files of ``folder`` that this checkpoint didn't read yet as captures are folded (``merge.backfill_fold``) and stop.

    The fold is a streaming aggregation: Spark's state store holds an id's first and last values with their seq, whatever order
    rows come in and however late, and tasks fold their own rows before they are shuffled. A batch gives the folded rows of the
    ids that it touched, and these replace the ids' rows in ``store``. State lies in RocksDB unless the session says otherwise.
    """
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting, ""):
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def replace(batch: DataFrame, number: int) -> None:
        with scratch_scope(spark):
            merge_batch(spark, store, query_id(spark, checkpoint), number, stored(batch, "folded"), _replaced, buckets)

    rows = prepare(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    backfill_fold(rows).writeStream.outputMode("update").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, store: str) -> DataFrame:
    """The archive as of the last batch that was finished."""
    found = versions.read_version(spark, store)
    if not found or not found["of"]:
        raise FileNotFoundError(f"nothing is stored at {store}")
    return spark.read.schema(T.StructType.fromJson(found["columns"])).parquet(*(found["of"][b] for b in sorted(found["of"], key=int)))


def rejects(spark: SparkSession, store: str) -> DataFrame | None:
    """The store's error table: rows that weren't merged, with reason and batch; None if there are none."""
    found = versions.read_version(spark, store)
    return spark.read.parquet(*found["errors"]) if found and found["errors"] else None
