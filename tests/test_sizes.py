"""Work per task stays bounded however large the tables are."""

from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest

from marshlight import session
from marshlight.functions import sql
from marshlight.functions import text as X
from marshlight.operators import merge, sink
from marshlight.plans import catalog
from marshlight.plans import tables as T
from marshlight.sources import archive, html
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sizes"))
    day = datetime(2001, 7, 4)
    orders = [(k, k % 50, "FOP"[k % 3], 1.5 * k, day, "1-URGENT") for k in range(3000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame([(k, f"c{k}") for k in range(3000)], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{at}/customer.parquet")
    return at


def parts(rows):
    return rows.rdd.getNumPartitions()


def test_headers_of_a_large_table_are_dealt_by_its_size(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "SPREAD_BYTES", 1)
    monkeypatch.setattr(session, "DEALT_BYTES", 1 << 10, raising=False)
    assert parts(T.headers(spark, folder)) > 8


def test_shapes_of_a_large_table_are_dealt_by_its_size(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "DEALT_BYTES", 1 << 10, raising=False)
    assert parts(T.shapes(spark, folder)) > 8


def test_cheap_scans_find_what_the_patterns_find(spark):
    odd = ["at 8:40 p.m. and 12:05 AM", "٣:٤٥ pm", "ſeptember 3, 2001 or auguſt 31, 2001", "xJuly 4, 2001", "June 31, 2001, July 4th 2001", "it's over​ now  \x1c COMPLETE. ", "UNCOMPLETE", "USING Dibrom® or the Altosid is", None, ""]
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, h string")
    sql.register(spark)
    got = rows.select("k", X.clean(F.col("h")), X.times(F.col("h")), X.first_date(F.col("h")), X.products_raw(F.col("h")), X.status(F.col("h"))).orderBy("k").collect()
    assert got == rows.selectExpr("k", "ml_clean_text(h)", "ml_header_times(h)", "ml_first_date(h)", "ml_products_raw(h)", "ml_status_of(h)").orderBy("k").collect()
    assert tuple(got[0][2]) == ("20:40", "00:05") and got[1][2]["time_end"] is None and got[5][1] == "it's over now COMPLETE." and got[5][5]["status"] == "complete"
    assert [str(r[3]["date"]) if r[3] else None for r in got] == [None, None, None, None, "2001-07-04"] + [None] * 5
    assert got[6][5]["status"] == "scheduled" and got[7][4] == ["Dibrom", "the Altosid"]


def test_cleaned_headers_are_cleaned_once(spark):
    """A header's white space is looked for once, blanks that are single already aren't replaced, and the result is the plain pattern's."""
    fields = spark.range(1).select(F.lit("x").alias("h")).select(*X.header_fields(F.col("h")).values())
    plan = fields._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace(replace(replace(replace(coalesce(h" not in plan
    odd = ["a  b", "\ta b", "a \tb\n", "a\u2003b", "a\x1cb \x1f c", "a b", " \x85 ", "é \u3000ü~!", "it’s\u00a0 now", "x\u200b y"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    plain = F.col("t")
    for a, b in (("\u00a0", " "), ("’", "'"), ("\u200b", "")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    got = rows.select(X.clean(F.col("t")), F.trim(F.regexp_replace(plain, X.K.WHITE_PATTERN, " "))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_an_element_of_a_document_is_parsed_once(spark):
    items = spark.range(3).select(F.concat(F.lit('{"id":"'), "id", F.lit('","crew":1}')).alias("item"))
    read = archive.operations_of_items(items)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert not any("from_json" in line for line in plan.splitlines() if "Filter " in line)
    assert sorted(r["id"] for r in read.select("id", F.to_json("more").alias("more")).collect()) == ["0", "1", "2"]


def test_pages_are_read_in_small_batches():
    """A worker holds the areas of a few pages, not those of a whole batch."""
    pages = pa.record_batch([pa.array(["live"] * 40), pa.array(range(40)), pa.array(["<ul><li>x<ul><li>y <a href='?mid=1'>map</a></li></ul></li></ul>" + " " * 200_000] * 40)], names=["source", "page_ord", "html"])
    tables = list(html.ExtractAreas.func().eval(pages))
    assert len(tables) > 1 and sum(t.num_rows for t in tables) == 40 and [n for t in tables for n in t.column("page_ord").to_pylist()] == list(range(40))


def test_exports_are_sorted_before_their_texts_are_made(spark, folder):
    table = sink.export_table(T.operations(spark, folder), catalog._shape_table(spark, folder))
    lines = table._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sort = next(k for k, line in enumerate(lines) if "Sort [" in line)
    assert not any("operation_id" in line for line in lines[sort:])


def test_observations_with_keys_are_made_once_for_a_merge(spark, monkeypatch):
    labels, stored = [], merge.stored
    monkeypatch.setattr(merge, "stored", lambda rows, label: labels.append(label) or stored(rows, label))
    seen = spark.createDataFrame([("a", "live", "x", ["status"], 1), ("a", "live", "y", [], 2)], "id string, source string, status string, present array<string>, seq int")
    got = merge.merge_append_only(seen.filter("seq = 1"), seen.filter("seq = 2")).first()
    assert got["status"] == "x" and labels[0] == "observed"
