"""Every SQL function against its Column twin."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marshlight.functions import geo, sql
from marshlight.functions import text as X

TEXTS = [
    None, "", " ", "Ground spraying for adult insect control using Dibrom® and/or Delta Gard is scheduled for the evening of Friday, July 24, 2026, between 8:40 p.m. and 10:00 p.m.",
    "AERIAL SPRAY for larvae using the Evergreen, VectoBac & pyronyl for the morning of June 31, 2001 or July 4 2001 at 12:05 am POSTPONED TO MONDAY, JULY 27, 2026.", "25:99 p.m. 12:00 PM 3:07am",
    "February 30th, 2020 February 29th , 2020", "CANCELED", "Cancelled due to wind", "completed", "It was completed", "RESCHEDULED to May 5, 2021;", "COMPLETE - done", ">N to Road., > South to  Lane.. ; E to x",
    "(Rescheduled from Monday) > W to y", "Area 5: west > x", "M12(b)- Brack", "MH-3 Portion", "D4", "X9z", "LN12: a", "untitled D 4", "https://x/?a=1&mid=1a_B-9&c", "?mid=", "1PG7iZX-Eb0uV_kH6VfCE37SqwMoGj00c",
    "Past Completed Operations", "Current operations", "Spray Alerts", "live", "wayback:20200101000000", "wayback:", "other", "it’s​ a\tb\n c", "using Dibrom or Altosid was applied January 1, 0000", "for the night  of",
]
TWINS = {
    "clean_text": X.clean, "text_or_none": X.none_if_empty, "header_method": X.method, "header_target": X.target, "header_period": X.period, "header_times": X.times, "first_date": X.first_date,
    "products_raw": X.products_raw, "canonical_product": X.canonical_product, "status_of": X.status, "boundary_text": X.boundary, "fallback_name": X.fallback_name, "mid_of_href": X.mid_of_href,
    "corrected_mid": X.corrected_mid, "zone_code": X.zone_code, "region_of": X.region, "section_kind": X.section_kind, "observation_rank": X.observation_rank,
}


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(spark)
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, x string").repartition(2)


@pytest.mark.parametrize("name", TWINS)
def test_function_equals_its_twin(spark, texts, name):
    rows = spark.sql(f"SELECT k, x, ml_{name}(x) AS a FROM {{t}}", t=texts).withColumn("b", TWINS[name](F.col("x"))).collect()
    assert [(r.x, r.a) for r in rows if r.a != r.b] == []
    assert len({str(r.a) for r in rows}) > 1  # it tells texts apart


def test_functions_of_lists_and_several_values(spark, texts):
    t = texts.withColumns({"raw": X.products_raw(F.col("x")), "st": X.status(F.col("x")), "d": F.lit("2020-02-02").cast("date"), "other": F.struct(F.lit("complete").alias("status"), F.when(F.col("k") % 2 == 0, "COMPLETE").alias("status_text"))})
    rows = spark.sql("SELECT *, ml_canonical_products(raw) AS a1, ml_display_product(ml_canonical_products(raw)) AS a2, ml_resolve_date(d, st.status, st.status_text) AS a3, ml_inherit_status(st, other) AS a4 FROM {t}", t=t)
    canonical = X.canonical_products(F.col("raw"))
    rows = rows.withColumns({"b1": canonical, "b2": X.display_product(canonical), "b3": X.resolve_date(F.col("d"), F.col("st.status"), F.col("st.status_text")), "b4": X.inherit_status(F.col("st"), F.col("other"))}).collect()
    assert all(r[f"a{k}"] == r[f"b{k}"] for r in rows for k in (1, 2, 3, 4)) and len({str(r.a3) for r in rows}) == 2


def test_since_and_rings(spark, texts):
    since = spark.createDataFrame([("2020",), ("2020-01-02",), ("",), (None,), ("2020-01-02T03:04:05",)], "x string")
    rows = spark.sql("SELECT ml_since_floor(x) AS a, x FROM {t}", t=since).withColumn("b", X.since_floor(F.col("x"))).collect()
    assert all(r.a == r.b for r in rows) and {r.a for r in rows} == {"20200000000000", "20200102000000", "20200102030405", None}
    with pytest.raises(Exception, match="unparseable since"):
        spark.sql("SELECT ml_since_floor('123')").collect()
    points = spark.createDataFrame([("-121 , 37.5,0 junk 1,x\n -120.9,37.6 5",), ("",), (None,)], "x string")
    assert all(r.a == r.b for r in spark.sql("SELECT x, ml_parse_coordinates(x) AS a FROM {t}", t=points).withColumn("b", geo.parse_coordinates(F.col("x"))).collect())
    ring = "array(named_struct('lon', -121D, 'lat', 37.5D), named_struct('lon', -120.9D, 'lat', 37.5D), named_struct('lon', -120.9D, 'lat', 37.6D){})"
    for end in ("", ", named_struct('lon', -121D, 'lat', 37.5D)"):
        table = spark.range(1).selectExpr(f"{ring.format(end)} AS r")
        row = spark.sql("SELECT ml_closed_ring(r) AS a, ml_ring_area_sq_km(ml_closed_ring(r)) AS area, r FROM {t}", t=table).withColumn("b", geo.close_ring(F.col("r"))).withColumn("polygon", F.round(geo.area_sq_km(F.array(F.array("b"))), 4)).first()
        assert row.a == row.b and round(row.area, 4) == row.polygon > 0


def test_functions_are_expressions(spark, texts):
    """A call is replaced by its expression: the plan has no Python and one projection."""
    plan = spark.sql("SELECT ml_header_method(x) AS m FROM {t}", t=texts)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "regexp_extract" in plan
