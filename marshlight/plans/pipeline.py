"""The archive's runs: refresh, export and verify, each a plan over the operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.operators import export, merge, quality, sink
from marshlight.session import scratch_scope, stored, stored_with
from marshlight.sources import archive, html, kml, versions


def isolated[T](stage: Callable[[], T]) -> tuple[T | None, dict]:
    """Run a stage; an error becomes a status instead of ending the run."""
    try:
        return stage(), {"status": "ok", "error": None}
    except Exception as e:  # noqa: BLE001 - a stage must not end the others
        return None, {"status": "error", "error": f"{type(e).__name__}: {e}"}


def refresh(existing: DataFrame, live: DataFrame | None, captures: DataFrame | None, first_seen: Column) -> tuple[DataFrame, DataFrame]:
    """(merged archive, rejects) of the stored operations (with seq) and of pages (source, html, page_ord).

    Captures are folded among themselves, then live rows follow them, then all is merged into the archive.
    """
    read = {k: html.extract_areas(p) for k, p in (("captures", captures), ("live", live)) if p is not None}
    if not read:
        return existing, existing.limit(0)
    rejected = None
    for areas in read.values():
        rejected = html.rejects(areas) if rejected is None else rejected.unionByName(html.rejects(areas))
    return refresh_areas(existing, read, first_seen), rejected


def refresh_areas(existing: DataFrame, read: dict[str, DataFrame], first_seen: Column) -> DataFrame:
    """The merged archive of the stored operations (with seq) and of the areas of pages, by kind: captures, live."""
    parts = []
    for kind, areas in read.items():
        ops = html.operations(areas, first_seen)
        ops = ops.withColumn("seq", F.struct(F.lit(1 if kind == "captures" else 2).alias("kind"), "seq.*"))
        parts.append(merge.backfill_fold(ops) if kind == "captures" else ops)
    incoming = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    zero = F.struct(F.lit(0).alias("kind"), F.col("seq").cast("bigint").alias("page_ord"), *(F.lit(0).alias(c) for c in ("container", "op", "area")))
    incoming = incoming.withColumn("seq", F.struct("seq.kind", F.col("seq.page_ord").cast("bigint").alias("page_ord"), "seq.container", "seq.op", "seq.area"))
    return merge.merge_append_only(existing.withColumn("seq", zero), merge.normalize(incoming, first_seen))


def resolve_shapes(ops: DataFrame, shapes: DataFrame, documents: DataFrame, fetched_at: Column) -> tuple[DataFrame, DataFrame]:
    """(all shapes, failures) after the wanted maps that have none were read from ``documents`` (mid, xml); shapes are immutable."""
    wanted = ops.select("mid").filter("mid <> ''").distinct().join(shapes.select("mid"), "mid", "left_anti")
    read = kml.shapes_of_kml(wanted.join(documents, "mid"), fetched_at)
    failed = read.filter("reason is not null").select("mid", "reason").unionByName(wanted.join(documents.select("mid"), "mid", "left_anti").withColumn("reason", F.lit("no_document")))
    return merge.overlay(shapes, read.filter("reason is null").select(*shapes.columns), "mid"), failed


def manifest(page: DataFrame, merged: DataFrame, shapes: DataFrame, known_shapes: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """One row of a run's totals: page_ops, new_ops, total_ops, total_shapes, new_shapes, shape_failures, date_min, date_max.

    ``known_shapes``: those of before the run. Each part is a single row, so they are joined on a constant."""
    one = lambda df, *aggregates: df.agg(*aggregates).withColumn("_one", F.lit(1))
    count = lambda df, name: one(df, F.count(F.lit(1)).alias(name)) if df is not None else one(shapes.limit(0), F.count(F.lit(1)).alias(name))
    given = F.nullif(F.col("date"), F.lit(""))
    total = one(merged, F.count_if(~F.col("existed")).alias("new_ops"), F.count(F.lit(1)).alias("total_ops"), F.min(given).alias("date_min"), F.max(given).alias("date_max"))
    rows = count(page, "page_ops").join(total, "_one").join(count(shapes, "total_shapes"), "_one").join(count(known_shapes if known_shapes is not None else shapes, "_known"), "_one").join(count(failures, "shape_failures"), "_one")
    return rows.select("page_ops", "new_ops", "total_ops", "total_shapes", (F.col("total_shapes") - F.col("_known")).alias("new_shapes"), "shape_failures", "date_min", "date_max")


def merged_metrics() -> dict[str, Column]:
    """What a manifest says of the merged archive, as aggregates over its rows."""
    given = F.nullif(F.col("date"), F.lit(""))
    return {"new_ops": F.count_if(~F.col("existed")), "total_ops": F.count(F.lit(1)), "date_min": F.min(given), "date_max": F.max(given)}


def observed_manifest(page: DataFrame, merged: DataFrame, shapes: DataFrame, known_shapes: DataFrame, failures: DataFrame) -> DataFrame:
    """``manifest`` of tables that are written anyway: Spark counts the rows as it writes them, so no job runs for the manifest alone."""
    count = F.count(F.lit(1))
    totals = {}
    for label, rows, metrics in (
        ("page", page, {"page_ops": count}), ("merged", merged, merged_metrics()), ("shapes", shapes, {"total_shapes": count}), ("known", known_shapes, {"known": count}), ("failures", failures, {"shape_failures": count}),
    ):
        totals |= stored_with(rows, label, **metrics)[1]
    totals["new_shapes"] = totals["total_shapes"] - totals["known"]
    fields = "page_ops long, new_ops long, total_ops long, total_shapes long, new_shapes long, shape_failures long, date_min string, date_max string"
    return page.sparkSession.createDataFrame([tuple(totals[f.split()[0]] for f in fields.split(", "))], fields)


@dataclass(frozen=True)
class Flags:
    """What a run does. A limit of captures asks for the backfill, and flags that leave nothing to do are an error."""

    backfill: bool = False
    backfill_limit: int | None = None
    shapes_only: bool = False
    no_shapes: bool = False
    dry_run: bool = False

    def __post_init__(self) -> None:
        if self.backfill_limit is not None:
            object.__setattr__(self, "backfill", True)
        if self.shapes_only and self.no_shapes:
            raise ValueError("shapes_only and no_shapes together leave nothing to do")
        if self.shapes_only and self.backfill:
            raise ValueError("shapes_only reads no pages, so backfill has no effect")


def run(spark: SparkSession, folder: str, live: Callable[[], DataFrame], captures: Callable[[int | None], DataFrame], documents: Callable[[], DataFrame], now: str, flags: Flags = Flags()) -> tuple[dict, bool]:  # noqa: B008
    """Bring the archive at ``folder`` up to date; (the manifest, whether the run is good).

    ``live`` and ``captures`` give pages (source, page_ord, html), ``documents`` KML (mid, xml). Each source is a stage of
    its own: an error is noted in the manifest and the others go on. An archive that is there but can't be read is never
    written over, and then no manifest is written either. Bad only if the archive can't be read or is still empty.

    What is written replaces the very versions that were read: if another run has published meanwhile, ``ConflictError`` is
    raised, nothing of it is lost, and the run has to be done again. Counts are taken as tables are written. What the run
    stores on its way is deleted at its end.
    """
    with scratch_scope(spark):
        return _run(spark, f"{folder.rstrip('/')}/", live, captures, documents, now, flags)


def _run(spark: SparkSession, at: str, live: Callable[[], DataFrame], captures: Callable[[int | None], DataFrame], documents: Callable[[], DataFrame], now: str, flags: Flags) -> tuple[dict, bool]:
    errors, sources, stamp, count = [], {}, F.lit(now), F.count(F.lit(1))

    def staged(name: str, work: Callable[[], DataFrame], skip: str | None = None, **metrics: Column) -> tuple[DataFrame | None, dict]:
        if skip:
            sources[name] = {"status": "skipped", "reason": skip}
            return None, {}
        out, sources[name] = isolated(lambda: stored_with(work(), name, **metrics) if metrics else (stored(work(), name), {}))
        if out is None:
            errors.append(f"{name}: {sources[name]['error']}")
            return None, {}
        return out

    base = {name: versions.newest_version(spark, f"{at}{name}") for name in ("operations", "shapes")}

    def load_operations() -> DataFrame:
        listed = archive.load_operations(spark, f"{at}operations", version=base["operations"], ordinal="_pos")
        return stored(merge.last_by_key(merge.normalize(listed, stamp), "id", "_pos").drop("_pos"), "operations")

    old, ops_state = isolated(load_operations)
    known, shapes_state = isolated(lambda: stored_with(archive.load_shapes(spark, f"{at}shapes", version=base["shapes"]), "shapes", n=count))
    errors += [f"archive: {s['error']}" for s in (ops_state, shapes_state) if s["error"]]
    readable = old is not None
    old = old if readable else spark.createDataFrame([], archive.OPERATION_READ)

    skip = "shapes_only" if flags.shapes_only else None
    size = F.coalesce(F.sum(F.length("html")), F.lit(0))
    page, about = staged("live", live, skip, html_bytes=size)
    sources["live"] |= about
    taken, about = staged("wayback", lambda: captures(flags.backfill_limit), skip or (None if flags.backfill else "no backfill"), html_bytes=size)
    sources["wayback"] |= about
    # each page is read once: its areas are what the merge and the page's own figures are made of
    read = {kind: stored(html.extract_areas(p), kind) for kind, p in (("captures", taken), ("live", page)) if p is not None}
    merged = refresh_areas(old.withColumn("seq", F.lit(0)), read, stamp) if read else old.withColumn("existed", F.lit(True))
    merged, totals = stored_with(merged, "merged", **merged_metrics())
    page_ops = 0
    if page is not None:
        figures = html.operations(read["live"], stamp).agg(count.alias("operations"), F.count_distinct(F.nullif("mid", F.lit(""))).alias("unique_mids")).first()
        sources["live"] |= figures.asDict()
        page_ops = figures["operations"]

    shapes, before = known if known is not None else (spark.createDataFrame([], archive.SHAPE), {"n": 0})
    kept: dict[str, tuple[DataFrame, dict]] = {}

    def resolve() -> DataFrame:
        table, failed = resolve_shapes(merged, shapes, documents(), stamp)
        kept["failed"] = stored_with(failed, "failed", n=count)
        return kml.rederive_zones(table)  # stored names are read by the rules of today

    reason = "no_shapes" if flags.no_shapes else ("shapes can't be read" if known is None else None)
    resolved, after = staged("shapes", resolve, reason, n=count)
    failures = 0
    if resolved is not None:
        shapes, (failed, n_failed) = resolved, kept["failed"]
        failures = n_failed["n"]
        sources["shapes"] |= {"fetched": after["n"] - before["n"], "failed": failures, "failed_mids": [r["mid"] for r in failed.select("mid").orderBy("mid").limit(25).collect()] if failures else []}

    n_shapes = after["n"] if resolved is not None else before["n"]
    totals = {"page_ops": page_ops, **totals, "total_shapes": n_shapes, "new_shapes": n_shapes - before["n"], "shape_failures": failures}
    out = {"generated_at": now, **totals, "sources": sources, "errors": errors, "archive_written": readable and not flags.dry_run}
    if readable and not flags.dry_run:
        export.write_operations(merged, f"{at}operations", now, base["operations"])
        if resolved is not None:
            export.write_shapes(shapes, f"{at}shapes", base["shapes"])
        export.write_json(out, spark, f"{at}manifest")
    return out, readable and totals["total_ops"] > 0


def run_export(ops: DataFrame, shapes: DataFrame, folder: str) -> int:
    """Publish both exports as the newest version of ``folder`` (see ``sink.publish_export``); returns how many operations have no geometry."""
    return sink.publish_export(ops, shapes, folder)["skipped"]


def verify(ops: DataFrame, shapes: DataFrame, known_missing: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(all checks, the verdict): every failure is reported, not only the first."""
    checks = quality.operation_checks(ops, today).unionByName(quality.shape_checks(shapes)).unionByName(quality.join_checks(ops, shapes, known_missing))
    return checks, quality.verdict(checks)


def verify_report(ops: DataFrame, shapes: DataFrame, known_missing: DataFrame, today: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``verify`` and its notes (name, n): orphan shapes and operations whose map is known to have none, which fail nothing."""
    return *verify(ops, shapes, known_missing, today), quality.join_notes(ops, shapes, known_missing)


def export_summary(ops: DataFrame, shapes: DataFrame) -> DataFrame:
    """One row: operations, zones, date_min, date_max, and how many operations are features of the export or are skipped as they have no polygon."""
    drawn = shapes.filter(F.size("polygons") > 0).select("mid", F.lit(1).alias("drawn"))
    return ops.join(drawn, "mid", "left").agg(
        F.count(F.lit(1)).alias("operations"), F.count_distinct("mid").alias("zones"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        F.count("drawn").alias("features"), F.count_if(F.col("drawn").isNull()).alias("skipped"),
    )
