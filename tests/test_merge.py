"""Merges against a plain fold, captures against the sequential rule, the stream, and the gate's mutations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.operators import merge, quality, timeline
from marshlight.plans import pipeline
from marshlight.sources import versions
from marshlight.streaming.merge import newest, stream_merge

FIELDS = ["id", "status", "status_text", "section", "source", "method", "products", "date", "mid", "first_seen", "seq"]
SCHEMA = "id string, status string, status_text string, section string, source string, method string, products array<string>, date string, mid string, first_seen string, seq long"


def observation(k):
    pick = random.choice
    return {
        "id": f"i{random.randrange(12)}", "status": pick(["scheduled", "complete", None]), "status_text": pick([None, "X", "Y"]), "section": pick(["past", "current"]),
        "source": pick(["live", "wayback:20200101000000", "wayback:20210101000000", "other", None]), "method": pick([None, "", "ground", "aerial"]), "products": pick([None, [], ["a"], ["b", "c"]]),
        "date": str(k), "mid": str(k), "first_seen": str(k), "seq": k,
    }


def rank(source):
    source = source or ""
    return (2, "") if source == "live" else (1, source[8:]) if source.startswith("wayback:") else (0, "")


def fold(existing, incoming):
    out = {}
    for o in existing:
        out[o["id"]] = dict(o)
    known = set(out)
    for o in incoming:
        if o["id"] not in out:
            out[o["id"]] = dict(o)
            continue
        kept = out[o["id"]]
        if rank(o["source"]) >= rank(kept["source"]):
            kept.update({f: o[f] for f in ("status", "status_text", "section", "source")})
        kept.update({f: o[f] for f in ("method", "products") if o[f]})
    return out, len(set(out) - known)


def frame(spark, rows):
    return spark.createDataFrame([[r[f] for f in FIELDS] for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(3))
def test_merge_equals_fold(spark, seed):
    random.seed(seed)
    rows = [observation(k) for k in range(120)]
    old, new = rows[:30], rows[30:]
    merged = merge.merge_append_only(frame(spark, old), frame(spark, new))
    want, n_new = fold(old, new)
    got = {r.id: {f: r[f] for f in FIELDS} for r in merged.collect()}
    assert got == want and {o["id"] for o in old} <= set(got)
    assert merge.new_count(merged).first().n_new == n_new
    again = merge.merge_append_only(merged.drop("existed").withColumn("seq", F.lit(0).cast("long")), frame(spark, new))
    drop = lambda d: {i: {f: v for f, v in o.items() if f != "seq"} for i, o in d.items()}
    assert drop({r.id: {f: r[f] for f in FIELDS} for r in again.collect()}) == drop(fold([o | {"seq": 0} for o in want.values()], new)[0])
    assert merge.new_count(again).first().n_new == 0


def test_merge_with_nothing(spark):
    random.seed(9)
    rows = frame(spark, [observation(k) for k in range(10)])
    assert merge.merge_append_only(rows.filter("1 = 0"), rows.filter("1 = 0")).count() == 0
    assert merge.merge_append_only(rows, rows.filter("1 = 0")).count() == rows.select("id").distinct().count()


def test_backfill(spark):
    rows = [observation(k) | {"id": "i"} for k in range(3)]
    for r, method, status in zip(rows, (None, "ground", "aerial"), ("a", "b", None), strict=True):
        r |= {"method": method, "status": status, "products": []}
    row = merge.backfill_fold(frame(spark, rows)).first()
    assert (row.method, row.status, row.source, row.first_seen, row.products) == ("ground", None, rows[0]["source"], "0", [])


def test_normalize(spark):
    rows = spark.createDataFrame([("", "2020-01-01", "m", None), (None, "2020-01-01", "", "x"), ("k", None, None, "x")], "id string, date string, mid string, first_seen string")
    assert sorted(tuple(r) for r in merge.normalize(rows, F.lit("now")).select("id", "first_seen").collect()) == [("2020-01-01|m", "now"), ("k", "x")]


def greedy(rows, floor):
    days, digests, out = set(), set(), {}
    for ts, status, digest, k in sorted(rows, key=lambda r: (r[0], r[3])):
        day = ts[:8]
        if status != "200":
            out[k] = "status"
        elif ts < floor:
            out[k] = "floor"
        elif day in days:
            out[k] = "same_day"
        elif digest in digests:
            out[k] = "digest"
        else:
            out[k] = "kept"
            days.add(day)
            digests.add(digest)
    return out


CAPTURES = [
    [("20200101000000", "200", "a", 0), ("20200102010000", "200", "a", 1), ("20200102020000", "200", "b", 2)],
    [("20200101000000", "200", "a", 0), ("20200101010000", "200", "b", 1), ("20200102000000", "200", "b", 2)],
]


@pytest.mark.parametrize("case", [0, 1, 2])
def test_captures(spark, case):
    random.seed(case)
    rows = CAPTURES[case] if case < 2 else [(f"202001{random.randint(1, 28):02d}{random.randrange(24):02d}0000", random.choice(["200", "200", "404", None]), random.choice("abcdefghij"), k) for k in range(90)]
    table = spark.createDataFrame(rows, "ts string, statuscode string, digest string, ord long")
    got = merge.capture_reasons(table, F.lit("20200103" if case == 2 else ""))
    assert {r.ord: r.reason for r in got.collect()} == greedy(rows, "20200103" if case == 2 else "")
    kept = got.filter("reason = 'kept'")
    stamps = sorted(r.ts for r in kept.collect())
    for n, want in ((2, stamps[-2:]), (0, []), (-1, stamps), (None, stamps)):
        assert [r.ts for r in merge.latest_n(kept, n).collect()] == want
    assert merge.capture_reasons(table.filter("1 = 0"), F.lit("")).count() == 0


def test_floor(spark):
    row = spark.range(1).select(merge.capture_floor(F.lit("2019")).alias("a"), merge.capture_floor(F.lit("2025")).alias("b"), merge.capture_floor(F.lit("2019"), True).alias("c"), merge.capture_floor(F.lit(None).cast("string"), True).alias("d")).first()
    assert tuple(row) == (K.EARLIEST_CAPTURE, "20250000000000", "20190000000000", "")


def test_stream_equals_batch(spark, tmp_path):
    random.seed(4)
    rows = [observation(k) for k in range(90)]
    for k in range(3):
        frame(spark, rows[30 * k : 30 * k + 30]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: stream_merge(spark, str(tmp_path / "in"), frame(spark, rows).schema, str(tmp_path / "store"), str(tmp_path / "state"), lambda d: d, files_per_batch=1)
    run()
    got = {r.id: {f: r[f] for f in FIELDS} for r in newest(spark, str(tmp_path / "store")).collect()}
    assert got == fold([], rows)[0]
    run()  # nothing new: nothing changes
    assert newest(spark, str(tmp_path / "store")).count() == len(got)


def test_stream_touches_few_buckets(spark, tmp_path):
    """A batch rewrites the buckets of its ids only; an unfinished folder is never read; a published batch isn't done twice."""
    rows = [observation(k) for k in range(60)]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    run = lambda: stream_merge(spark, str(tmp_path / "in"), frame(spark, rows).schema, store, str(tmp_path / "state"), lambda d: d, buckets=8)
    run()
    before = versions.read_version(spark, store)["of"]
    count = newest(spark, store).count()
    frame(spark, rows[:1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    after = versions.read_version(spark, store)["of"]
    assert sum(before[b] != after[b] for b in before) == 1 and newest(spark, store).count() == count
    frame(spark, rows).write.parquet(f"{store}/batch-9/_bucket=1")
    assert newest(spark, store).count() == count
    with pytest.raises(FileNotFoundError):
        newest(spark, str(tmp_path / "none"))


def test_captures_of_many_days(spark):
    """A chain in which each day's first digest is the one that the day before took."""
    rows = [(f"2020{m:02d}{d:02d}0{h}0000", "200", f"g{k + h}", 2 * k + h) for k, (m, d) in enumerate((m, d) for m in range(1, 13) for d in range(1, 11)) for h in (0, 1)]
    got = merge.capture_reasons(spark.createDataFrame(rows, "ts string, statuscode string, digest string, ord long"), F.lit(""))
    assert {r.ord: r.reason for r in got.collect()} == greedy(rows, "")


def clean_archive(spark):
    rows = [(f"2020-05-0{k}|m{k}", f"2020-05-0{k}", "ground", "adult", ["Dibrom"], "A", f"m{k}", "u", "complete", "past", "live", "t") for k in range(1, 6)]
    return spark.createDataFrame(rows, "id string, date string, method string, target string, products array<string>, area_name string, mid string, map_url string, status string, section string, source string, first_seen string")


def shapes(spark, spoil="polygons"):
    ring = "array(named_struct('lon', -121D, 'lat', 37.5D), named_struct('lon', -120.9D, 'lat', 37.5D), named_struct('lon', -120.9D, 'lat', 37.6D), named_struct('lon', -121D, 'lat', 37.5D))"
    return spark.range(1, 6).selectExpr("concat('m', id) as mid", "'Polygon' as geom_type", f"array(array({ring})) as polygons", "id")


MUTATIONS = {
    "prose in products": ("product outside the table", lambda o: o.withColumn("products", F.when(F.col("mid") == "m1", F.array(F.lit("July 12"))).otherwise(F.col("products")))),
    "duplicated id": ("duplicate ids", lambda o: o.union(o.filter("mid = 'm1'"))),
    "blank field": ("missing area_name", lambda o: o.withColumn("area_name", F.when(F.col("mid") != "m1", F.col("area_name")))),
    "id": ("id is not date|mid", lambda o: o.withColumn("id", F.when(F.col("mid") == "m1", "x").otherwise(F.col("id")))),
    "old date": ("date", lambda o: o.withColumn("date", F.when(F.col("mid") == "m1", "2014-01-01").otherwise(F.col("date"))).withColumn("id", F.concat_ws("|", "date", "mid"))),
    "far date": ("date", lambda o: o.withColumn("date", F.when(F.col("mid") == "m1", "2020-12-01").otherwise(F.col("date"))).withColumn("id", F.concat_ws("|", "date", "mid"))),
    "enum": ("status outside its vocabulary", lambda o: o.withColumn("status", F.when(F.col("mid") == "m1", "done").otherwise(F.col("status")))),
    "no shape": ("unresolved maps", lambda o: o.withColumn("mid", F.when(F.col("mid") == "m1", "zz").otherwise(F.col("mid"))).withColumn("id", F.concat_ws("|", "date", "mid"))),
}
SWAP = lambda p: F.struct(p["lat"].alias("lon"), p["lon"].alias("lat"))
SHAPE_MUTATIONS = {
    "swapped": ("rings out of bounds", lambda p: F.transform(p, lambda poly: F.transform(poly, lambda r: F.transform(r, SWAP)))),
    "unclosed": ("unclosed rings", lambda p: F.transform(p, lambda poly: F.transform(poly, lambda r: F.concat(r, F.slice(r, 2, 1))))),
}


def failed(spark, ops, table):
    checks, verdict = pipeline.verify(ops, table.drop("id"), spark.createDataFrame([], "mid string"), F.lit("2020-06-01").cast("date"))
    bad = {r.name for r in checks.collect() if r.n_bad}
    assert verdict.first().ok == (not bad)
    return bad


def test_gate_is_green(spark):
    assert failed(spark, clean_archive(spark), shapes(spark)) == set()


@pytest.mark.parametrize("name", MUTATIONS)
def test_gate_mutations(spark, name):
    check, spoil = MUTATIONS[name]
    assert failed(spark, spoil(clean_archive(spark)), shapes(spark)) == {check}


@pytest.mark.parametrize("name", SHAPE_MUTATIONS)
def test_gate_shape_mutations(spark, name):
    check, spoil = SHAPE_MUTATIONS[name]
    table = shapes(spark).withColumn("polygons", F.when(F.col("id") == 1, spoil(F.col("polygons"))).otherwise(F.col("polygons")))
    assert failed(spark, clean_archive(spark), table) == {check}


def test_area_median(spark):
    rows = spark.createDataFrame([(x,) for x in (3.0, 1.0, None, 0.0, 4.0, 2.0)], "area_sq_km double")
    assert tuple(quality.area_stats(rows).first()) == (1.0, 3.0, 4.0)


def test_area_median_of_many(spark, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 20)
    random.seed(3)
    for values in ([random.expovariate(1) for _ in range(501)], [random.choice([1e-9, 2.0, 2.0, 1e9]) for _ in range(400)], [7.0] * 50):
        got = quality.area_stats(spark.createDataFrame([(x,) for x in values], "area_sq_km double")).first()
        assert tuple(got) == (min(values), sorted(values)[len(values) // 2], max(values))
    assert tuple(quality.area_stats(spark.createDataFrame([], "area_sq_km double")).first()) == (None, None, None)


def test_samples(spark):
    rows = spark.createDataFrame([(f"c{k % 2}", f"v{k % 37:02d}") for k in range(300)] + [("c0", None)], "c string, v string")
    got = {r["check"]: r["sample"] for r in quality.samples(rows.filter("v is not null"), F.col("c"), F.col("v"), 3).collect()}
    assert got == {"c0": ["v00", "v01", "v02"], "c1": ["v00", "v01", "v02"]}


def test_carry_forward_over_blocks(spark):
    """One partition with most rows, which lie in several blocks."""
    random.seed(5)
    rows = [("hot" if k % 8 else f"u{k}", k, random.choice([None, None, None, "a", "b"])) for k in range(400)]
    last, want = {}, []
    for user, k, value in rows:
        last[user] = value or last.get(user)
        want.append((user, k, last[user]))
    got = timeline.carry_forward(spark.createDataFrame(rows, "user string, pos int, value string").repartition(5), ["user"], ["pos"], "value").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_timeline(spark):
    days = timeline.per_day(spark.createDataFrame([("2020-01-01",), ("2020-01-01",), ("2020-01-02",), ("2020-01-05",), (None,)], "d string"), "d")
    text = lambda df: [tuple(str(v) for v in r) for r in df.orderBy("d").collect()]
    assert text(timeline.trail(days, 2)) == [("2020-01-01", "2"), ("2020-01-02", "3"), ("2020-01-05", "1")]
    assert [n for _, n in text(timeline.calendar(days))] == ["2", "1", "0", "0", "1"]
    assert sorted((r.days, r.n) for r in timeline.islands(days).collect()) == [(1, 1), (2, 3)]
    assert timeline.calendar(days.filter("1 = 0")).count() == 0


def test_refresh(spark):
    """Captures, then the live page, into an archive: the live status wins and nothing is lost."""
    from test_documents import HEAD, area, operation, page

    old = merge.last_by_key(clean_archive(spark).withColumns({c: F.lit(None).cast("string") for c in ("period", "time_start", "time_end", "boundary_text", "status_text")}).withColumn("products_raw", F.col("products")).withColumn("seq", F.lit(0)), "id", "seq")
    shown = lambda source, html: spark.createDataFrame([(source, 0, html)], "source string, page_ord int, html string")
    captures = shown("wayback:20260701000000", page(operation(area(mid="a")), operation(area(mid="b"))))
    live = shown("live", page(operation(area(mid="a", extra="<b>COMPLETE</b> ")), operation("<li>x</li>", head=HEAD)))
    merged, rejected = pipeline.refresh(old, live, captures, F.lit("now"))
    rows = {r.mid: r for r in merged.collect()}
    assert len(rows) == 7 and rows["a"].status == "complete" and rows["a"].source == "live" and rows["b"].source.startswith("wayback:")
    assert sum(r.n for r in rejected.collect()) == 1


def test_flags():
    assert pipeline.Flags(backfill_limit=3).backfill and not pipeline.Flags().backfill
    for bad in ({"shapes_only": True, "no_shapes": True}, {"shapes_only": True, "backfill": True}, {"shapes_only": True, "backfill_limit": 1}):
        with pytest.raises(ValueError):
            pipeline.Flags(**bad)


def test_whole_run(spark, tmp_path):
    """Stages fail one by one, an archive that can't be read is left alone, and a second run changes nothing."""
    from test_documents import area, operation, page

    from marshlight.operators import export
    from marshlight.sources import archive

    shown = lambda source, html: spark.createDataFrame([(source, 0, html)], "source string, page_ord int, html string")
    live = lambda: shown("live", page(operation(area(mid="a")), operation(area(mid="b"))))
    old = lambda _: shown("wayback:20260701000000", page(operation(area(mid="c"))))
    ring = "<Polygon><outerBoundaryIs><LinearRing><coordinates>-121,37.5 -120.9,37.5 -120.9,37.6 -121,37.5</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    kml = lambda: spark.createDataFrame([("a", f"<kml><Document><name>D4</name>{ring}</Document></kml>"), ("b", "<kml/>")], "mid string, xml string")

    def broken(*_):
        raise OSError("no answer")

    folder = str(tmp_path / "archive")
    out, good = pipeline.run(spark, folder, broken, old, kml, "t0")
    assert not good and out["total_ops"] == 0 and out["sources"]["wayback"]["status"] == "skipped" and out["errors"] == ["live: OSError: no answer"]
    out, good = pipeline.run(spark, folder, live, old, kml, "t1", pipeline.Flags(backfill=True))
    assert good and (out["page_ops"], out["new_ops"], out["total_ops"], out["total_shapes"], out["new_shapes"], out["shape_failures"]) == (2, 3, 3, 1, 1, 2)
    assert out["sources"]["shapes"]["failed_mids"] == ["b", "c"] and out["sources"]["live"]["unique_mids"] == 2 and not out["errors"]
    assert archive.load_operations(spark, f"{folder}/operations").count() == 3 and archive.load_shapes(spark, f"{folder}/shapes").count() == 1
    assert export.read_json(spark, f"{folder}/manifest")["generated_at"] == "t1"
    out, good = pipeline.run(spark, folder, live, broken, broken, "t2", pipeline.Flags(backfill=True))
    assert good and out["new_ops"] == 0 and len(out["errors"]) == 2 and out["total_shapes"] == 1
    assert archive.load_operations(spark, f"{folder}/operations").filter("first_seen = 't1'").count() == 3
    kept = versions.newest_version(spark, f"{folder}/operations")
    out, good = pipeline.run(spark, folder, live, old, kml, "t3", pipeline.Flags(shapes_only=True, dry_run=True))
    assert good and not out["archive_written"] and versions.newest_version(spark, f"{folder}/operations") == kept
    export.write_json({"operations": 3}, spark, f"{folder}/operations")  # damage it
    out, good = pipeline.run(spark, folder, live, old, kml, "t4")
    assert not good and not out["archive_written"] and export.read_json(spark, f"{folder}/operations") == {"operations": 3}


def test_scratch_is_dropped(spark):
    from marshlight.session import drop_scratch, scratch_mark, stored

    before = stored(spark.range(3), "before")
    mark = scratch_mark()
    between = stored(spark.range(4), "between")
    out = stored(between.filter("id > 0"), "out")
    drop_scratch(spark, mark, out)
    assert out.count() == 3 and before.count() == 3
    assert not versions.exists(spark, between.inputFiles()[0])


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    from marshlight import session

    class Context:
        applicationId, master, getCheckpointDir = "app-x", "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(Session(), "x")
    monkeypatch.setattr(Context, "getCheckpointDir", staticmethod(lambda: "hdfs://shared/c"))
    assert session.scratch_dir(Session(), "x").startswith("hdfs://shared/c/x-")
