"""Timeline analytics over days: trailing windows, running totals, islands, calendars, facets and summaries.

Windows run over one row a day. Days are bounded by the calendar whatever the table's size, so these windows stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshlight.session import stored


def per_day(rows: DataFrame, day: str) -> DataFrame:
    return rows.groupBy(F.col(day).cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d is not null")


def trail(days: DataFrame, length: int) -> DataFrame:
    """Rows seen in the days [d - length + 1, d], for every day that has rows."""
    number = F.datediff("d", F.lit("1970-01-01").cast("date"))
    return days.select("d", F.sum("n").over(Window.orderBy(number).rangeBetween(1 - length, 0)).alias("visible"))


def cumulative(days: DataFrame) -> DataFrame:
    return days.select("d", F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def islands(days: DataFrame) -> DataFrame:
    """Runs of days without a gap: first day, last day, days, rows."""
    keyed = days.withColumn("k", F.date_sub("d", F.row_number().over(Window.orderBy("d"))))
    return keyed.groupBy("k").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("days"), F.sum("n").alias("n")).drop("k")


def calendar(days: DataFrame) -> DataFrame:
    """Every day from the first to the last, with 0 where there are no rows."""
    span = days.agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("d"))
    return every.join(days, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n"))


def carry_forward(rows: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """The last value that isn't null so far, within a partition (its columns aren't null).

    Rows are dealt by ranges of (partition, order), so a partition of any size is spread over blocks; values are carried
    within each block and then from the ends of blocks, of which there are few, into those that follow.
    """
    ranged = rows.repartitionByRange(*partition, *order).withColumn("_block", F.spark_partition_id())
    ranged = stored(ranged, "blocks")
    own = Window.partitionBy(*partition, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(*partition, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    brought = ends.withColumn("_brought", F.last("_end", ignorenulls=True).over(before)).filter("_brought is not null").drop("_end")
    carried = ranged.withColumn(value, F.last(value, ignorenulls=True).over(own)).join(brought, [*partition, "_block"], "left")
    return carried.withColumn(value, F.coalesce(value, "_brought")).select(*rows.columns)


def per_year(rows: DataFrame, day: str) -> DataFrame:
    return rows.groupBy(F.year(day).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def per_year_and_era(rows: DataFrame, day: str, source: str = "source") -> DataFrame:
    """(year, era, n): operations by the year that they fall in and by what shows them: the live page, captures of a year, or anything else."""
    era = F.when(F.col(source) == "live", "live").when(F.col(source).startswith("wayback:"), F.concat(F.lit("captures of "), F.substring(source, 9, 4))).otherwise("other")
    return rows.groupBy(F.year(day).alias("year"), era.alias("era")).agg(F.count(F.lit(1)).alias("n"))


def facets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, n) for every value of every field; array fields count each element. One pass over the table."""

    def pairs_of(field: str) -> Column:
        values = F.col(field) if rows.schema[field].dataType.typeName() == "array" else F.array(field)
        return F.transform(values, lambda v: F.struct(F.lit(field).alias("facet"), v.cast("string").alias("value")))

    pairs = F.concat(*map(pairs_of, fields))
    return rows.select(F.inline(pairs)).filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def treatments_and_zones(ops: DataFrame) -> DataFrame:
    return ops.agg(F.count(F.lit(1)).alias("treatments"), F.count_distinct("mid").alias("zones"))


def area_sums(ops: DataFrame) -> DataFrame:
    """Area once for each zone, and once for each operation; neither is a footprint. ``ops`` has mid and area_sq_km."""
    zones = ops.groupBy("mid").agg(F.max("area_sq_km").alias("area"), F.sum("area_sq_km").alias("treated"))
    return zones.agg(F.sum("area").alias("zone_area"), F.sum("treated").alias("treatment_area"))


def backfill_summary(ops: DataFrame) -> DataFrame:
    """One row: operations, unique_mids, unique_dates, date_min, date_max and by_source, the number of operations of each
    source (null counts as "?") in order. Empty mids and dates don't count; sources are as many as captures."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    counts = ops.groupBy(F.coalesce("source", F.lit("?")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    total = ops.agg(
        F.count(F.lit(1)).alias("operations"), F.count_distinct(given("mid")).alias("unique_mids"), F.count_distinct(given("date")).alias("unique_dates"),
        F.min(given("date")).alias("date_min"), F.max(given("date")).alias("date_max"),
    )
    return total.join(listed, F.lit(True))


def stage_summary(pages: DataFrame, ops: DataFrame, text: str = "html") -> DataFrame:
    """One row about a stage: html_bytes (characters of its pages), operations, unique_mids."""
    size = pages.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("html_bytes"))
    return size.join(ops.agg(F.count(F.lit(1)).alias("operations"), F.count_distinct(F.nullif("mid", F.lit(""))).alias("unique_mids")), F.lit(True))


def summary(rows: DataFrame, key: str, day: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count_distinct(F.col(day).cast("date")).alias("days"), F.min(F.col(day).cast("date")).alias("date_min"), F.max(F.col(day).cast("date")).alias("date_max"))
