"""Data-quality gate: every check is counted, and the verdict is one row over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions import geo

#: Ranges that a median is looked for in at once, and values that are few enough to be sorted.
RANGES, FEW = 4_096, 10_000
CHECKS = "name string, n_bad long"


def rows_of(counts: dict[str, Column]) -> tuple[list[Column], Column]:
    """(aggregates, an expression that turns their row into rows of name and n_bad)."""
    names = list(counts)
    return [counts[n].alias(f"_{k}") for k, n in enumerate(names)], F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"_{k}").cast("long").alias("n_bad")) for k, n in enumerate(names))))


def bad_date(date: Column, today: Column) -> Column:
    """Not an ISO date, not in the calendar, before the first plausible day or over 60 days ahead."""
    day = F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), date.try_cast("date"))
    return ~F.coalesce(day.between(F.lit(K.EARLIEST_DATE).cast("date"), F.date_add(today, K.HORIZON_DAYS)), F.lit(False))


def outside(column: Column, allowed: tuple[str, ...]) -> Column:
    """Not in the vocabulary; null is outside."""
    return ~F.coalesce(column.isin(*allowed), F.lit(False))


def missing(field: str) -> Column:
    return F.coalesce(F.col(field), F.lit("")) == ""


def operation_checks(ops: DataFrame, today: Column) -> DataFrame:
    """(name, n_bad) of the operations table: one aggregation for all row checks, one for duplicate ids."""
    counts = {f"missing {f}": F.count_if(missing(f)) for f in K.REQUIRED}
    counts["no operations"] = (F.count(F.lit(1)) == 0).cast("long")
    counts["id is not date|mid"] = F.count_if(~F.col("id").eqNullSafe(F.concat_ws("|", "date", "mid")))
    counts["date"] = F.count_if(bad_date(F.col("date"), today))
    for field, allowed in (("method", K.METHODS), ("target", K.TARGETS), ("status", K.STATUSES), ("section", K.SECTIONS)):
        counts[f"{field} outside its vocabulary"] = F.count_if(outside(F.col(field), allowed))
    known = [name for _, name in K.PRODUCTS]
    counts["product outside the table"] = F.sum(F.size(F.filter(F.coalesce("products", F.array().cast("array<string>")), lambda p: ~p.isin(*known))))
    aggregates, rows = rows_of({k: F.coalesce(v, F.lit(0)) for k, v in counts.items()})
    dupes = duplicates(ops, "id").agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit("duplicate ids").alias("name"), "n_bad")
    return ops.agg(*aggregates).select(rows).unionByName(dupes)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def bad_products(ops: DataFrame) -> DataFrame:
    known = [name for _, name in K.PRODUCTS]
    return ops.select(F.explode("products").alias("product")).filter(~F.col("product").isin(*known)).groupBy("product").agg(F.count(F.lit(1)).alias("n"))


def shape_checks(shapes: DataFrame) -> DataFrame:
    """(name, n_bad) of shapes (mid, geom_type, polygons): rings are counted, each once."""
    usable = F.coalesce(F.col("geom_type").isin("Polygon", "MultiPolygon"), F.lit(False))
    rings = F.when(usable, geo.rings(F.col("polygons")))
    number = lambda test: F.coalesce(F.sum(F.size(F.filter(rings, test))), F.lit(0))
    counts = {
        "no features": (F.count(F.lit(1)) == 0).cast("long"),
        "geometry type": F.count_if(~usable),
        "unclosed rings": number(lambda r: (F.size(r) > 0) & (F.get(r, 0) != F.get(r, F.size(r) - 1))),
        "rings under 4 points": number(lambda r: F.size(r) < 4),
        "rings out of bounds": number(lambda r: F.exists(r, lambda p: ~geo.in_bounds(p))),
        "duplicate shapes": duplicate_shapes(),
    }
    aggregates, rows = rows_of(counts)
    return shapes.agg(*aggregates).select(rows)


def duplicate_shapes() -> Column:
    """Features less distinct mids; features without a mid count too."""
    return F.count(F.lit(1)) - F.count_distinct(F.nullif(F.col("mid"), F.lit("")))


def area_stats(shapes: DataFrame) -> DataFrame:
    """Smallest, upper median and largest of the areas that aren't null or 0, as one row; nulls without any.

    The median's rank is found from counts of equal ranges of values, in ever smaller ranges, until one range holds few
    values or one; so no task holds the column.
    """
    spark = shapes.sparkSession
    areas = shapes.filter("area_sq_km <> 0 and not isnan(area_sq_km)").select(F.col("area_sq_km").cast("double").alias("x"))
    ends = areas.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    low, high, rank = ends["low"], ends["high"], ends["n"] // 2  # from 0, in ascending order
    within = areas
    while ends["n"] and low < high:
        width = (high - low) / RANGES
        cell = F.least(F.floor((F.col("x") - low) / width), F.lit(RANGES - 1)) if width > 0 else F.lit(0).cast("long")
        held = within.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for row in sorted(held.collect(), key=lambda r: r["cell"]):
            if rank < row["n"]:
                break
            rank -= row["n"]
        low, high = row["low"], row["high"]
        within = areas.filter(F.col("x").between(low, high))
        if row["n"] <= FEW or width == 0:
            low = high = sorted(r["x"] for r in within.limit(FEW + 1).collect())[rank] if row["n"] <= FEW else low
    return spark.createDataFrame([(ends["low"], low, ends["high"])], "area_min double, area_median double, area_max double")


def unresolved(ops: DataFrame, shapes: DataFrame, known_missing: DataFrame) -> DataFrame:
    mids = ops.select("mid").filter("mid <> ''").distinct()
    return mids.join(shapes, "mid", "left_anti").join(known_missing, "mid", "left_anti")


def join_checks(ops: DataFrame, shapes: DataFrame, known_missing: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("name"), "n_bad")
    stale = known_missing.join(shapes.select("mid"), "mid", "left_semi")
    return count(unresolved(ops, shapes.select("mid"), known_missing), "unresolved maps").unionByName(count(stale, "stale exceptions"))


def join_notes(ops: DataFrame, shapes: DataFrame, known_missing: DataFrame) -> DataFrame:
    """(name, n): what a report says beside its checks, as it is no failure: shapes that no operation has, and operations, and
    their maps, whose map is known to have none."""
    orphans = shapes.select("mid").filter("mid <> ''").distinct().join(ops.select("mid").filter("mid is not null"), "mid", "left_anti")
    expected = ops.filter("mid <> ''").join(known_missing.select("mid").distinct(), "mid", "left_semi")
    counts = expected.agg(F.count(F.lit(1)).alias("ops"), F.count_distinct("mid").alias("maps"))
    listed = F.inline(F.array(F.struct(F.lit("operations without an expected shape").alias("name"), F.col("ops").alias("n")), F.struct(F.lit("maps without an expected shape").alias("name"), F.col("maps").alias("n"))))
    return orphans.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan shapes").alias("name"), "n").unionByName(counts.select(listed))


def samples(rows: DataFrame, check: Column, value: Column, most: int) -> DataFrame:
    """(check, sample): the first values of each check in order; a task keeps no more than it needs of them."""
    picked = rows.select(check.alias("check"), value.alias("value")).distinct()
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("value")) <= most
    # values are cut to the smallest few of a hash group before those of a whole check
    parts = picked.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(64))).withColumn("near", first("check", "part")).filter("near")
    few = parts.withColumn("near", first("check")).filter("near")
    return few.groupBy("check").agg(F.array_sort(F.collect_list("value")).alias("sample"))


def verdict(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and(F.col("n_bad") == 0).alias("ok"), F.count_if(F.col("n_bad") > 0).alias("n_failed"))
