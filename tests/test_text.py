"""Text functions on the written examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marshlight.functions import text as X


def run(spark, function, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.out for r in rows.select("k", function(F.col("v")).alias("out")).orderBy("k").collect()]


STATUS = {
    "COMPLETE": ("complete", "COMPLETE"),
    "Complete": ("complete", "Complete"),
    "CANCELED": ("cancelled", "CANCELED"),
    "CANCELLED DUE TO TECHNICAL ISSUE - WILL BE RESCHEDULED": ("cancelled", "CANCELLED DUE TO TECHNICAL ISSUE - WILL BE RESCHEDULED"),
    "POSTPONED TO MONDAY, JULY 27, 2026": ("postponed", "POSTPONED TO MONDAY, JULY 27, 2026"),
    "(rescheduled from Thursday, July 9, 2026)": ("scheduled", None),
    "complete - cancelled later": ("cancelled", "complete - cancelled later"),
    "Area done COMPLETE.": ("complete", "COMPLETE"),
    "Was CANCELLED by crew": ("cancelled", "CANCELLED"),
    "": ("scheduled", None),
    " ": ("scheduled", None),
    None: ("scheduled", None),
}


def test_status(spark):
    assert [tuple(r) for r in run(spark, X.status, STATUS)] == list(STATUS.values())


DATES = {
    "July 23, 2026": "2026-07-23", "July 2 2026": "2026-07-02", "JULY 27, 2026": "2026-07-27", "July 2nd, 2026": "2026-07-02",
    "June 29, 2026 OR Tuesday, June 30, 2026 (depending on weather)": "2026-06-29", "June 31, 2026 or July 1, 2026": "2026-07-01",
    "July 2,2026": None, "Jul 2, 2026": None, "July 4, 0000": None, "": None,
}


def test_dates(spark):
    assert [str(r.date) if r else None for r in run(spark, X.first_date, DATES)] == list(DATES.values())
    assert run(spark, lambda c: X.first_date(c)["date_text"], ["June 31, 2026 or July 1, 2026"]) == ["July 1, 2026"]


CLOCKS = {
    "12:20 a.m.": ("00:20", None), "12:20 p.m.": ("12:20", None), "8:40 pm": ("20:40", None), "25:99 p.m.": ("37:99", None),
    "between 3:15 a.m. and 6:00 a.m. or 7:00 a.m.": ("03:15", "06:00"), "none": (None, None),
}


def test_clocks(spark):
    assert [tuple(r) for r in run(spark, X.times, CLOCKS)] == list(CLOCKS.values())


PRODUCTS = {
    "using Evergreen 5-25 and/or DeltaGard® is scheduled for": (["Evergreen 5-25", "DeltaGard"], ["Evergreen 5-25", "DeltaGard"]),
    "using Dibrom®, is scheduled": (["Dibrom"], ["Dibrom"]),
    "using Dibrom® is rescheduled for the evening of Sunday, July 12, 2020 between 8:30 p.m.": (["Dibrom"], ["Dibrom"]),
    "using Altosid concentrate (SR-20) and VectoBac WDG larvacide is now": (["Altosid concentrate (SR-20)", "VectoBac WDG larvacide"], ["Altosid", "VectoBac WDG"]),
    "using Evergreen 5-25® ULV Air": (["Evergreen 5-25 ULV Air"], ["Evergreen 5-25"]),
    "using Pyronyl 525 & NewStuff 9, between": (["Pyronyl 525", "NewStuff 9"], ["Pyronyl 525"]),
    "using the Evergreen 525 or Evergreen 5-25 for the evening of": (["the Evergreen 525", "Evergreen 5-25"], ["Evergreen 5-25"]),
    "no product here": ([], []),
}


def test_products(spark):
    assert run(spark, X.products_raw, PRODUCTS) == [raw for raw, _ in PRODUCTS.values()]
    assert run(spark, lambda c: X.canonical_products(X.products_raw(c)), PRODUCTS) == [known for _, known in PRODUCTS.values()]


ZONES = {
    "D4(b)- Brack": ("D4(b)", "Delta"), "S55b-  SW": ("S55b", "Stockton"), "S9- Portion": ("S9", "Stockton"), "T16-Cental Tracy": ("T16", "Tracy"),
    "E70 Rural N. Escalon": ("E70", "Escalon"), "SC6 Portion": ("SC6", "South County"), "E50C-North": ("E50C", "Escalon"), "TH-2 Portion": ("TH-2", "Thornton"),
    "LN2 - Linden": ("LN2", "Linden"), "D7-Wright-Shima": ("D7", "Delta"), "D4": ("D4", "Delta"), "Untitled map": (None, "Unknown"), "Portion of North Stockton": (None, "Unknown"),
    "S5500-x": (None, "Unknown"), "d4- x": (None, "Unknown"), "D4(bb)- x": (None, "Unknown"), None: (None, "Unknown"), "Q1 x": ("Q1", "Unknown"),
}


def test_zones(spark):
    assert run(spark, X.zone_code, ZONES) == [z for z, _ in ZONES.values()]
    assert run(spark, lambda c: X.region(X.zone_code(c)), ZONES) == [r for _, r in ZONES.values()]


def test_since(spark):
    cases = {"2025": "20250000000000", "2025-08": "20250800000000", "2025-08-11": "20250811000000", "20250811141635": "20250811141635", None: None, "": None, "x": None}
    assert run(spark, X.since_floor, cases) == list(cases.values())
    for bad in ("202", "123456789012345"):
        with pytest.raises(Exception, match="unparseable"):
            run(spark, X.since_floor, [bad])


def test_sections(spark):
    cases = {"Current Scheduled Spray Operations": "current", "Past Completed Spray Operations:": "past", "Past Scheduled Operations": "past", "Spray Alerts": None, None: None}
    assert run(spark, X.section_kind, cases) == list(cases.values())


def test_boundaries(spark):
    cases = {
        ">North to Watercourse St., >South to French Camp Rd.": "North to Watercourse St., South to French Camp Rd.",
        "> N to Eight Mile Rd.": "North to Eight Mile Rd.", "Cox Rd..": "Cox Rd.", "(rescheduled from Thursday, July 9, 2026)": None, "": None, None: None, ": free prose": "free prose",
    }
    assert run(spark, X.boundary, cases) == list(cases.values())


def test_small_ones(spark):
    assert run(spark, X.clean, ["  a b\n\tc​d’ ", None]) == ["a b cd'", ""]
    assert run(spark, X.target, ["for larvae of", "for ADULT insect", "for the morning"]) == ["larval", "adult", None]
    assert run(spark, X.fallback_name, ["A: b > c", "A > c", "A"]) == ["A", "A ", "A"]
    assert [tuple(r) for r in run(spark, X.observation_rank, ["live", "wayback:2020", "x", None])] == [(2, ""), (1, "2020"), (0, ""), (0, "")]
    assert run(spark, X.corrected_mid, ["1PG7iZX-Eb0uV_kH6VfCE37SqwMoGj00c", "x", None]) == ["1JNoCNnTgawK0dNM7YpxQIOZZHDmI6jVQ", "x", None]
    resolved = lambda c: F.date_format(X.resolve_date(F.lit("2026-07-01").cast("date"), X.status(c)["status"], X.status(c)["status_text"]), "yyyy-MM-dd")
    assert run(spark, resolved, ["POSTPONED TO MONDAY, JULY 27, 2026", "POSTPONED", "CANCELLED JULY 27, 2026"]) == ["2026-07-27", "2026-07-01", "2026-07-01"]
