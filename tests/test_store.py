"""The stored archive: keys outside the contract, versions, streams that are restarted or share a store, and runs that collide."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from marshlight.operators import export, merge
from marshlight.plans import pipeline
from marshlight.session import stored_with
from marshlight.sources import archive, versions
from marshlight.streaming import merge as streaming

from test_merge import FIELDS, fold, frame, observation, rank

KEYS = ("status", "status_text", "section")


def spotty(k):
    """An observation as the archive's JSON has it: some keys lack, some aren't known."""
    o = {f: v for f, v in observation(k).items() if f != "seq"}
    for f in KEYS:
        if random.random() < 0.35:
            del o[f]
    if random.random() < 0.4:
        o |= {random.choice(["crew", "α β", "z"]): random.choice([1, None, "x\"y", [1, {"a": None}], {"b": 2.5}])}
    return o


def fold_keys(existing, incoming):
    out = {}
    for o in existing:
        out[o["id"]] = dict(o)
    for o in incoming:
        if o["id"] not in out:
            out[o["id"]] = dict(o)
            continue
        kept = out[o["id"]]
        if rank(o["source"]) >= rank(kept["source"]):
            kept.update({f: o[f] for f in (*KEYS, "source") if f in o})
        kept.update({f: o[f] for f in ("method", "products") if o.get(f)})
    return out


def items(spark, rows, first=0):
    return archive.operations_of_items(spark.createDataFrame([(first + k, json.dumps(o, ensure_ascii=False)) for k, o in enumerate(rows)], "seq long, item string"), "seq")


@pytest.mark.parametrize("seed", range(4))
def test_keys_of_observations(spark, tmp_path, seed):
    """Random folds with lacking and unknown keys, through a written document and merged again."""
    random.seed(seed)
    rows = [spotty(k) for k in range(140)]
    old, new, more = rows[:30], rows[30:100], rows[100:]
    merged = merge.merge_append_only(items(spark, old), items(spark, new, 1000))
    export.write_operations(merged, str(tmp_path / "ops"), "t")
    names = set(archive.OPERATION_FIELDS)

    def read():
        lines = spark.read.text(versions.current_folder(spark, str(tmp_path / "ops"))).collect()
        return {o["id"]: o for o in json.loads("".join(r.value for r in lines))["operations"]}

    want = fold_keys(old, new)
    lean = lambda d: {i: {k: v for k, v in o.items() if k in KEYS or k not in names or v is not None} for i, o in d.items()}  # noqa: E731 - other keys of the contract are written as null
    assert lean(read()) == lean(want)
    assert not export.write_operations(merged, str(tmp_path / "ops"), "t2")  # only the clock differs
    again = merge.merge_append_only(archive.load_operations(spark, str(tmp_path / "ops")).withColumn("seq", F.lit(0).cast("long")), items(spark, more, 1000))
    export.write_operations(again, str(tmp_path / "ops"), "t")
    assert lean(read()) == lean(fold_keys(want.values(), more))


def test_elements_keep_their_order(spark, tmp_path):
    """A document in parts of uneven sizes: of equal ids the last element wins, though Spark packs files by their sizes."""
    folder = tmp_path / "doc" / "data-1"
    folder.mkdir(parents=True)
    sizes = [1, 400, 3, 1500, 2, 50]
    element, wanted = 0, {}
    for k, n in enumerate(sizes):
        lines = ['{"operations":['] if k == 0 else []
        for _ in range(n):
            wanted[f"i{element % 7}"] = str(element)
            lines.append(json.dumps({"id": f"i{element % 7}", "date": str(element), "mid": "m" * (900 if k == 2 else 1)}) + ",")
            element += 1
        lines += ["]}"] if k == len(sizes) - 1 else []
        (folder / f"part-{k:05}.txt").write_text("\n".join(lines) + "\n")
    versions.publish_version(spark, str(tmp_path / "doc"), 1, {"folder": "data-1"})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = archive.load_operations(spark, str(tmp_path / "doc"), ordinal="pos")
        assert rows.rdd.getNumPartitions() > 3 and rows.count() == sum(sizes)
        assert {r.id: r.date for r in merge.last_by_key(rows, "id", "pos").collect()} == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps([{"id": "a", "date": str(k)} for k in range(5)]))
    assert merge.last_by_key(archive.load_operations(spark, str(bare), ordinal="pos"), "id", "pos").first().date == "4"


def test_folders_are_replaced_by_version(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda n: lambda folder: spark.range(n).write.parquet(folder)
    versions.replace_folder(spark, path, write(1))
    base = versions.newest_version(spark, path)
    versions.replace_folder(spark, path, write(2), base)
    with pytest.raises(versions.ConflictError):
        versions.replace_folder(spark, path, write(3), base)
    late = base + 1

    def slow(folder):  # another writer publishes while this one writes
        write(4)(folder)
        versions.replace_folder(spark, path, write(5), late)

    with pytest.raises(versions.ConflictError):
        versions.replace_folder(spark, path, slow, late)
    assert versions.current_table(spark, path).count() == 5
    assert len([f for f in (tmp_path / "t").iterdir() if f.name.startswith("data-")]) == 3  # what the losers wrote is gone


def test_two_runs_from_one_base(spark, tmp_path):
    """Of two runs that read the same archive one publishes; the other fails as a whole, and done again it keeps both."""
    from test_documents import area, operation, page

    folder = str(tmp_path / "archive")
    shown = lambda mid: spark.createDataFrame([("live", 0, page(operation(area(mid=mid))))], "source string, page_ord int, html string")
    ring = "<Polygon><outerBoundaryIs><LinearRing><coordinates>-121,37.5 -120.9,37.5 -120.9,37.6 -121,37.5</coordinates></LinearRing></outerBoundaryIs></Polygon>"
    kml = lambda: spark.createDataFrame([(m, f"<kml><Document><name>D4: x</name>{ring}</Document></kml>") for m in "abc"], "mid string, xml string")
    none = lambda _: None
    pipeline.run(spark, folder, lambda: shown("a"), none, kml, "t0")

    def meanwhile():
        pipeline.run(spark, folder, lambda: shown("b"), none, kml, "t1")
        return shown("c")

    with pytest.raises(versions.ConflictError):
        pipeline.run(spark, folder, meanwhile, none, kml, "t2")
    mids = lambda: sorted(r.mid for r in archive.load_operations(spark, f"{folder}/operations").collect())
    assert mids() == ["a", "b"] and export.read_json(spark, f"{folder}/manifest")["generated_at"] == "t1"
    out, good = pipeline.run(spark, folder, lambda: shown("c"), none, kml, "t3")
    assert good and mids() == ["a", "b", "c"] and (out["new_ops"], out["total_ops"], out["new_shapes"], out["total_shapes"]) == (1, 3, 1, 3)


def test_run_reads_zone_codes_anew(spark, tmp_path):
    """A stored shape whose code is older than today's rule gets the code of its name."""
    from test_documents import area, operation, page

    ring = [[[-121.0, 37.5], [-120.9, 37.5], [-120.9, 37.6], [-121.0, 37.5]]]
    feature = lambda mid, code, name: {"type": "Feature", "id": mid, "properties": {"mid": mid, "zone_code": code, "doc_name": name}, "geometry": {"type": "Polygon", "coordinates": ring}}
    (tmp_path / "shapes").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("a", None, "M12: North"), feature("b", "OLD", "no code here")]}))
    live = lambda: spark.createDataFrame([("live", 0, page(operation(area(mid="a"))))], "source string, page_ord int, html string")
    (tmp_path / "shapes").rename(tmp_path / "old")
    shapes = archive.load_shapes(spark, str(tmp_path / "old"))
    export.write_shapes(shapes, str(tmp_path / "x" / "shapes"))
    pipeline.run(spark, str(tmp_path / "x"), live, lambda _: None, lambda: spark.createDataFrame([], "mid string, xml string"), "t")
    assert {r.mid: r.zone_code for r in archive.load_shapes(spark, str(tmp_path / "x" / "shapes")).collect()} == {"a": "M12", "b": "OLD"}


def test_report_has_notes(spark):
    from test_merge import clean_archive, shapes

    ops = clean_archive(spark).filter("mid <> 'm5'").withColumn("mid", F.when(F.col("mid") == "m4", "lost").otherwise(F.col("mid")))
    ops = ops.withColumn("id", F.concat_ws("|", "date", "mid"))
    known = spark.createDataFrame([("lost",), ("lost",), ("other",)], "mid string")
    checks, verdict, notes = pipeline.verify_report(ops, shapes(spark).drop("id"), known, F.lit("2020-06-01").cast("date"))
    assert {r.name: r.n for r in notes.collect()} == {"orphan shapes": 2, "operations without an expected shape": 1, "maps without an expected shape": 1}
    assert verdict.first().ok and all(r.n_bad == 0 for r in checks.collect())


def stream(spark, tmp_path, state, rows, **more):
    seen = []
    streaming.stream_merge(spark, str(tmp_path / f"in-{state}"), frame(spark, rows).schema, str(tmp_path / "store"), str(tmp_path / f"state-{state}"), lambda d: d, on_batch=lambda *b: seen.append(b), files_per_batch=1, **more)
    return seen


def feed(spark, tmp_path, state, rows):
    frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{state}"))


def test_two_checkpoints_feed_one_store(spark, tmp_path):
    """A second query numbers its batches from 0 again: none of them may count as merged already."""
    random.seed(31)
    rows = [observation(k) for k in range(90)]
    for state, part in (("one", rows[:30]), ("two", rows[30:60])):
        feed(spark, tmp_path, state, part)
        assert [n for _, n, _ in stream(spark, tmp_path, state, rows)] == [30]
    feed(spark, tmp_path, "one", rows[60:])
    seen = stream(spark, tmp_path, "one", rows)
    assert [(b, n) for b, n, _ in seen] == [(1, 30)] and stream(spark, tmp_path, "two", rows) == []
    got = {r.id: {f: r[f] for f in FIELDS} for r in streaming.newest(spark, str(tmp_path / "store")).collect()}
    assert got == fold([], rows)[0]


def test_writers_of_one_store_collide(spark, tmp_path):
    """Another query publishes while a batch is merged: the batch is merged anew into what is there then."""
    random.seed(32)
    rows = [observation(k) for k in range(40)]
    store, tries = str(tmp_path / "s"), []

    def combine(old, new):
        tries.append(1)
        if len(tries) == 1:
            streaming.merge_batch(spark, store, "other", 0, frame(spark, rows[:20]), merge.merge_append_only, 4)
        return merge.merge_append_only(old, new)

    done = streaming.merge_batch(spark, store, "mine", 0, frame(spark, rows[20:]), combine, 4)
    assert len(tries) == 2 and done["rows"] == 20
    assert streaming.merge_batch(spark, store, "mine", 0, frame(spark, rows[20:]), combine, 4) is None
    assert {r.id: r.status for r in streaming.newest(spark, store).collect()} == {i: o["status"] for i, o in fold([], rows)[0].items()}
    assert len({f.name for f in (tmp_path / "s").iterdir() if f.name.startswith("batch-")}) == 2


def test_hooks_listener_and_rejects(spark, tmp_path):
    """Rows and new ids of each batch, and bad rows with their reason in a table of their own."""
    random.seed(33)
    rows = [observation(k) for k in range(60)]
    listener = streaming.Progress()
    spark.streams.addListener(listener)
    try:
        seen, ids = [], set()
        for k in range(3):
            part = rows[20 * k : 20 * k + 20]
            feed(spark, tmp_path, "one", part)
            seen += stream(spark, tmp_path, "one", rows, reason=F.when(F.col("status").isNull(), "no status").when(F.col("seq") == 7, "seven"))
            good = [r for r in part if r["status"] is not None and r["seq"] != 7]
            assert seen[-1] == (k, len(good), len({r["id"] for r in good} - ids))
            ids |= {r["id"] for r in good}
        for _ in range(100):
            if len(listener.batches) >= 3:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [(b, n) for _, b, n in sorted(listener.batches, key=lambda x: x[1]) if n] == [(0, 20), (1, 20), (2, 20)] and not listener.errors
    bad = streaming.rejects(spark, str(tmp_path / "store")).collect()
    want = [(r["seq"], "no status" if r["status"] is None else "seven", r["seq"] // 20) for r in rows if r["status"] is None or r["seq"] == 7]
    assert sorted((r.seq, r.reason, r.batch) for r in bad) == want
    assert {r.id for r in streaming.newest(spark, str(tmp_path / "store")).collect()} == ids


def test_fold_is_restarted(spark, tmp_path):
    """State outlives the query: later files hold earlier observations, and the fold is the one of all rows in order."""
    random.seed(34)
    rows = [observation(k) for k in range(120)]
    order = random.sample(rows, 120)
    fold_them = lambda: streaming.stream_fold(spark, str(tmp_path / "in"), frame(spark, rows).schema, str(tmp_path / "store"), str(tmp_path / "state"), lambda d: d, files_per_batch=1)
    for k in range(3):
        frame(spark, order[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k != 1:
            fold_them()
    want = {r.id: tuple(r) for r in merge.backfill_fold(frame(spark, rows)).select(FIELDS).collect()}
    got = {r.id: tuple(r) for r in streaming.newest(spark, str(tmp_path / "store")).select(FIELDS).collect()}
    assert got == want


def test_a_batch_writes_a_file_for_a_bucket(spark, tmp_path):
    """However many tasks a batch has, and a batch counts its rows without a copy of them."""
    rows, store = [observation(k) for k in range(120)], str(tmp_path / "store")
    done = streaming.merge_batch(spark, store, "one", 0, frame(spark, rows).repartition(8), lambda old, new: new, 4)
    assert done == {"rows": 120}
    found = streaming.versions.read_version(spark, store)
    assert [len(list(__import__("pathlib").Path(path).glob("*.parquet"))) for path in found["of"].values()] == [1] * len(found["of"])


def test_counts_take_no_jobs(spark):
    """Writing with metrics runs as many jobs as writing alone."""
    from marshlight.session import stored

    def jobs(work):
        group = f"g{random.random()}"
        spark.sparkContext.setJobGroup(group, group)
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    table = lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
    plain = jobs(lambda: stored(table(), "plain"))
    found = {}
    assert jobs(lambda: found.update(stored_with(table(), "counted", n=F.count(F.lit(1)), most=F.max("s"))[1])) == plain
    assert found == {"n": 7, "most": max(sum(range(k, 1000, 7)) for k in range(7))}
    ops = spark.createDataFrame([("a", "2020-01-01", True), ("b", None, False)], "id string, date string, existed boolean")
    shapes = spark.createDataFrame([("m",)], "mid string")
    tables = (ops, ops, shapes, shapes.limit(0), shapes)
    made = []
    assert jobs(lambda: made.append(pipeline.observed_manifest(*tables))) == jobs(lambda: [stored(t, "t") for t in tables])
    assert made[0].first().asDict() == {"page_ops": 2, "new_ops": 1, "total_ops": 2, "total_shapes": 1, "new_shapes": 1, "shape_failures": 1, "date_min": "2020-01-01", "date_max": "2020-01-01"}
