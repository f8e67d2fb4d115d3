"""Operator 10: token ids as Parquet list columns, in doc_id order, with pages that can be read selectively."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marshlight.llm.bpe import default_tokenizer, encoder
from marshlight.llm.common import doc_columns, map_arrow, parallelism, scratch_dir, table, text_chunks

END_ID = 2
#: Bytes of text that a file holds at least and at most, about.
SMALL_FILE, LARGE_FILE = 8 << 20, 256 << 20
#: Fixed bound on the files whose running totals are broadcast, a row each.
BROADCAST_FILES = 1_000_000
SCHEMA = "doc_id long, n_tokens long, start_in_file long, ids array<int>"


def with_end(counts: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    stops = np.cumsum(counts)
    return counts + 1, np.insert(ids, stops, end_id).astype(np.int32)


def _encode(tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(tokenizer), 0
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                counts, ids = with_end(*enc.encode(data, offsets), end_id)
                edge = np.append(0, np.cumsum(counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(counts), pa.array(edge[:-1] + seen), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))],
                    names=["doc_id", "n_tokens", "start_in_file", "ids"],
                )
                seen += int(edge[-1])

    return run


def files_for(docs: DataFrame) -> int:
    """Files for these texts: as many as the session shuffles to, unless they would be small or large ones."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(min(parallelism(docs.sparkSession), -(-size // SMALL_FILE)), -(-size // LARGE_FILE), 1)


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, files: int | None = None, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2000) -> None:
    """Encode ``docs`` (doc_id, text) and write them in ascending doc_id order, one file per range of ids.

    The texts are dealt by range of doc_id before they are encoded (a text is smaller than its ids), sorted in each
    partition, and encoded while the file is written. Columns: doc_id, n_tokens, start_in_file (ids of the file's
    documents before it) and ids (list of int). The id list is dictionary-encoded; the three number columns are
    delta-encoded (format version 2, no dictionary). Row groups and pages are held small and Parquet's column and
    offset indexes are written, so a filter on doc_id reads few pages, and a reader of the number columns reads no ids.
    Null text counts as empty (the end id alone); rows with a null doc_id come first; rows with equal doc_id are
    ordered by a hash of their text; an empty table gives an empty folder with the schema. The number of files follows from
    the texts' bytes where ``files`` doesn't say it.
    """
    docs, tie = doc_columns(docs), F.xxhash64("text")
    ordered = docs.repartitionByRange(files or files_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    out = map_arrow(ordered, _encode(tokenizer or default_tokenizer(), end_id), SCHEMA)
    writer = out.write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    for column in ("doc_id", "n_tokens", "start_in_file"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The written documents with ``start``: the ids of all documents before each, over all files.

    File totals come from the number columns alone; the window that runs over the files has one row a file.
    """
    rows = spark.read.schema(SCHEMA).parquet(path).withColumn("part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = F.broadcast(before) if len(rows.inputFiles()) <= BROADCAST_FILES else before
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        at = lists.offsets.to_numpy()
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))
        sums = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents and return what reading them back gives, per document."""
    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return map_arrow(read_token_files(spark, path), _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
