"""What the two text classifiers share: the labelled sample, held-out folds, and logistic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshlight.llm.common import doc_columns, map_arrow, stored, table, text_chunks
from marshlight.session import spread

#: Most labelled documents that a classifier is fitted on, and most bytes of their texts together: those of the smallest
#: hashes of doc_id. Texts of over a 64th of these bytes aren't fitted on. Fixed bounds; only the fit is bounded.
TRAINING_DOCS, TRAINING_BYTES = 6_000, 24 << 20
_SAMPLE_FILES = 24


def fold(folds: int) -> F.Column:
    """crc32 of doc_id as text, modulo the number of folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def training_sample(spark: SparkSession, sf_dir: str, label: str, folds: int, held_out: int, most: int = TRAINING_DOCS, most_bytes: int = TRAINING_BYTES) -> DataFrame:
    """(doc_id, text, y) of labelled documents outside the held-out fold, within both bounds, written to the shared folder.

    Ids are picked from the labels alone, so the texts are filtered by a small table whose size is bounded. Of labels or
    rows that repeat a doc_id the largest count, and a null text is empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col(label).cast("int").alias("y"))
    labels = labels.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(folds) != held_out)).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = labels.orderBy(*order).limit(most)
    rows = doc_columns(table(spark, sf_dir, "documents")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("bytes", F.octet_length("text"))
    rows = stored(rows.filter(F.col("bytes") <= most_bytes // 64).repartition(_SAMPLE_FILES, "doc_id"), "sample")
    total = F.sum("bytes").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over ``most`` rows
    within = rows.select("doc_id", total.alias("total")).filter(F.col("total") <= most_bytes).select("doc_id")
    return rows.join(F.broadcast(within), "doc_id", "left_semi").select("doc_id", "text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def calibrate(scores: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through training scores, by Newton steps, with a weak pull to slope 1."""
    x = np.stack([scores, np.ones_like(scores)], 1)
    goal = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (p - goal) + 0.1 * (w - prior))
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def append_score(docs: DataFrame, scorer: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], keep: list[str], chunk_bytes: int = 512 << 10, name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``name``, a score of each whole text, without a shuffle.

    ``scorer`` is called once a task and gives a function of (bytes, row offsets) of some texts. Null counts as empty.
    """
    names = list(dict.fromkeys([*keep, "text"]))
    rows = spread(docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(names.index("text")), chunk_bytes):
                columns = [batch.column(names.index(c)).slice(first, last - first) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score(data, offsets).astype(np.float64))], names=[*keep, name])

    fields = [T.StructField(c, rows.schema[c].dataType, True) for c in keep]
    return map_arrow(rows, run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
