"""A training-data pipeline: quality, toxicity, line dedup, near dedup, packing. Each stage reads what the last one wrote.

A document passes the first two stages unless the classifier rejects it (score under 0.3 for quality, 0.3 and more for
toxicity). Line dedup removes repeated three-line windows; documents of which nothing but empty lines is left by that go.
Of each group of near duplicates (five-word shingles, similarity 0.8) one row stays, of the smallest doc_id that isn't null. Nulls,
empty texts, repeated rows and empty tables are handled as the operators' docstrings say. A table needs doc_id and text;
all its other columns, whatever their names, go through all stages but the last, and n_chars follows the text where it is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm import op1_line_dedup, op2_near_dedup, op3_packing, op5_toxicity, op6_quality
from marshlight.llm.common import free_name, stored, table
from marshlight.session import drop_scratch, scratch_mark, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "score")
    scored = op6_quality.score(docs, op6_quality.fit(spark, sf_dir), tuple(docs.columns), name)
    return scored.filter(F.col(name) >= op6_quality.THRESHOLD).drop(name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = free_name(docs, "score")
    scored = op5_toxicity.score(docs, op5_toxicity.fit(spark, sf_dir), tuple(docs.columns), name)
    return scored.filter(F.col(name) < op5_toxicity.THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: free_name(docs, f"own_{c}") for c in ("n_lines", "n_removed") if c in docs.columns}  # the operator's have these names
    cleaned = op1_line_dedup.line_dedup(docs.withColumnsRenamed(own))
    emptied = (F.col("n_removed") > 0) & (F.length(F.translate("text", "\n", "")) == 0)
    left = cleaned.filter(~F.coalesce(emptied, F.lit(False))).drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = free_name(docs, "row_id")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # doc_id may repeat or be null
    groups = op2_near_dedup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle_words=5)
    members = groups.select(F.col("doc_id").alias("row_id"), "component_id").join(rows.select(F.col(row).alias("row_id"), "doc_id"), "row_id")
    members = stored(members, "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first"))
    gone = stored(members.join(first, "component_id").filter("row_id <> first.row_id").select(F.col("row_id").alias(row)), "dropped")
    small = gone.count() <= op2_near_dedup.BROADCAST_IDS
    return rows.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]
#: The classifiers, the sketches and the tokenizer can't be written in SQL; a test holds a plain version of all stages against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again. What a stage left there
    on its way is deleted when its result is written, and that when the next one's is."""
    ship_package(spark)
    docs, mark = table(spark, sf_dir, "documents"), scratch_mark()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        drop_scratch(spark, mark, docs)
    return docs
