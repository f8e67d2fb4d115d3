"""Operator 1: line dedup by repeated windows of three consecutive lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.common import free_name, map_arrow, stored, table

WINDOW = 3
#: Fixed bounds on the documents and places that are broadcast to cut lines.
BROADCAST_DOCS, BROADCAST_PLACES = 300_000, 2_000_000


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, h1, h2): a 128-bit hash of the lines pos, pos + 1 and pos + 2 of each text; windows of empty lines only are left out."""
    lines = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "row", F.split("text", "\n").alias("lines"))
    many = lines.filter(F.size("lines") >= WINDOW)

    def window(i: F.Column) -> F.Column:
        a, b, c = (F.get("lines", i + k) for k in range(WINDOW))
        empty = (F.length(a) + F.length(b) + F.length(c)) == 0
        return F.struct(i.alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(c, F.lit(1), b, a).alias("h2"), empty.alias("empty"))

    found = many.select("doc_id", "row", F.inline(F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), window)))
    return found.filter("not empty").drop("empty")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, removed) of rows (doc_id, row, text): the first lines of each row's windows that occur earlier, in (doc_id, row, position) order."""
    found, place = windows(docs), F.struct("doc_id", "row", "pos")
    first = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).filter(place > F.col("first"))
    return later.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("removed"))


def _remove(marks: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut the lines that the windows in the column ``marks`` cover; rows without any pass by as they are."""

    def cut(text: str, starts: list[int]) -> tuple[str, int]:
        lines = text.split("\n")
        covered = np.zeros(len(lines) + WINDOW, bool)
        for shift in range(WINDOW):
            covered[np.array(starts) + shift] = True
        return "\n".join(line for line, c in zip(lines, covered.tolist(), strict=False) if not c), int(covered[: len(lines)].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            hit = pc.fill_null(pc.greater(pc.list_value_length(batch.column(marks)), 0), False)
            new = [cut(t, s) for t, s in zip(texts.filter(hit).to_pylist(), batch.column(marks).filter(hit).to_pylist(), strict=True)]
            gone = np.zeros(batch.num_rows, np.int64)
            gone[hit.to_numpy(zero_copy_only=False)] = [n for _, n in new]
            counted = pc.fill_null(pc.add(pc.count_substring(texts, "\n"), 1), 0).cast(pa.int64())
            columns = {n: batch.column(n) for n in batch.schema.names if n != marks}
            columns |= {"text": pc.replace_with_mask(texts, hit, pa.array([t for t, _ in new], texts.type)), "n_lines": counted, "n_removed": pa.array(gone)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove later occurrences of repeated three-line windows; adds n_lines and n_removed to the columns of ``docs``.

    A window is three consecutive lines of a text, cut at line feeds, and equals another when all three lines are
    identical. Of each window the occurrence with the smallest (doc_id, row, position) stays; the lines that the others
    cover are removed, overlapping windows together. Texts of fewer than three lines lose nothing. Null texts stay null
    (no lines); windows of empty lines only don't count; rows with a null doc_id stay as they are. Rows that share a
    doc_id are texts of their own, in the order in which Spark reads them, so of equal rows the first keeps its lines.
    Columns called n_lines or n_removed in ``docs`` are replaced, all others stay.

    Only hashes and positions are shuffled to find the windows: each task keeps the smallest place of a window before
    the shuffle, and the join back can be split where one window is in most documents. What is to be removed is broadcast
    while it is within fixed bounds, so that no text moves; beyond them the texts are joined by a shuffle. A table in which
    a doc_id repeats is written once with a number for each row; in others doc_id names the row.
    """
    docs = docs.drop("n_lines", "n_removed")
    row, marks, key, key_row = (free_name(docs, n) for n in ("row", "removed", "removed_doc", "removed_row"))
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    numbered = docs.withColumn(row, F.lit(0).cast("long")) if repeated.isEmpty() else stored(docs.withColumn(row, F.monotonically_increasing_id()), "line-rows")
    found = repeated_lines(numbered.select("doc_id", F.col(row).alias("row"), "text"))
    removed = stored(found.select(F.col("doc_id").alias(key), F.col("row").alias(key_row), F.col("removed").alias(marks)), "removed-lines")
    size = removed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(marks)), F.lit(0)).alias("places")).first()
    small = size["rows"] <= BROADCAST_DOCS and size["places"] <= BROADCAST_PLACES
    same = (numbered["doc_id"] == removed[key]) & (numbered[row] == removed[key_row])
    joined = numbered.join(F.broadcast(removed) if small else removed, same, "left").drop(key, key_row, row)
    schema = joined.drop(marks).withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    for field in schema:
        field.nullable = True
    return map_arrow(joined, _remove(marks), schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the cleaned documents."""
    docs = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, p, [ls[p], ls[p + 1], ls[p + 2]] AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w WHERE w <> ['', '', '']),
gone AS (SELECT DISTINCT doc_id, p + s AS p FROM r, (VALUES (0), (1), (2)) AS t(s) WHERE k > 1),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS p FROM l),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS text_sha256
FROM l LEFT JOIN k USING (doc_id)"""
