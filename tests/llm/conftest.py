from __future__ import annotations

import pytest
from llm_cases import ROWS, SCHEMA
from pyspark.sql import functions as F

@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, blank and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    extra = {c: F.lit(1) for c in ("score", "removed", "n_lines", "n_removed", "digest", "shard", "arrival", "_arrival", "y", "ids", "band", "part", "length", "component")}
    return spark.createDataFrame(ROWS, SCHEMA).withColumns(extra)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.filter("1 = 0")
