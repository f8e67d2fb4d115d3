"""Keyed merges of repeated observations, and the greedy dedup of captures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marshlight.functions import constants as K
from marshlight.functions import text as X
from marshlight.session import stored


def _filled(df: DataFrame, name: str) -> Column:
    """Not null, "" or []."""
    return F.size(name) > 0 if df.schema[name].dataType.typeName() == "array" else F.col(name).isNotNull() & (F.col(name) != "")


def normalize(rows: DataFrame, now: Column) -> DataFrame:
    """Ids derived from date and mid where missing; rows without either go; a missing first_seen is ``now``."""
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    made = F.when(part("date").isNotNull() & part("mid").isNotNull(), F.concat_ws("|", "date", "mid"))
    out = rows.withColumn("id", F.coalesce(part("id"), made)).filter("id is not null")
    return out.withColumn("first_seen", F.coalesce(part("first_seen"), now)) if "first_seen" in rows.columns else out


def last_by_key(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of rows with equal keys the one of the largest ``seq``, whole."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("_row")).select("_row.*")


def _has(name: str) -> Column:
    """Whether an observation has a key; without a list of its keys it has all."""
    return F.col("present").isNull() | F.array_contains("present", name)


def merge_append_only(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Never-shrinking merge of two tables with columns id, source, ``seq`` and any of the contract's.

    Every ``seq`` of ``existing`` is below every one of ``incoming``. Of equal ids in ``existing`` the last replaces the
    others. Then, per id: status, status_text, section and source come from the observation of the highest rank, the
    last of equal ones, nulls included; each derived field is the last value that isn't empty, or else the first;
    all else, keys outside the contract (``more``) too, is the first record's. Adds ``existed``. One aggregation, no join:
    tasks keep one state an id.

    Where either table has ``present`` (see ``archive.load_operations``), an observation changes only what it has of status,
    status_text and section: each is of the last observation that has it and whose rank no earlier one exceeds. The same
    aggregation finds it unless the best observations lack it; ids where they do are looked at again, as ``_by_presence`` says.
    """
    rows = last_by_key(existing, "id", seq).withColumn("existed", F.lit(True)).unionByName(incoming.withColumn("existed", F.lit(False)), allowMissingColumns=True)
    mutable = [c for c in K.MUTABLE if c in rows.columns]
    derived = [c for c in K.DERIVED if c in rows.columns]
    listed = "present" in rows.columns
    rest = [c for c in rows.columns if c not in (*mutable, *derived, "source", "present", "id", "existed")]
    rows = rows.withColumn("_rank", X.observation_rank(F.col("source")))
    rows = stored(rows, "observed") if listed else rows  # read up to three times, and what it is made from may be costly
    place = F.struct("_rank", F.col(seq))
    found = [F.max_by(F.struct(c, F.col("_rank").alias("rank")), F.when(_has(c), place)).alias(f"_{c}") for c in mutable] if listed else [F.max_by(F.struct(*mutable), place).alias("_winner")] if mutable else []
    merged = rows.groupBy("id").agg(
        F.max_by(F.struct("source"), place).alias("_source"),
        *found,
        *(F.coalesce(F.max_by(c, F.when(_filled(rows, c), F.col(seq))), F.min_by(c, seq)).alias(c) for c in derived),
        F.min_by(F.struct(*rest), seq).alias("_first"),
        F.bool_or("existed").alias("existed"),
        *([F.max("_rank").alias("_best")] if listed else []),
    )
    if not listed:
        return merged.select("id", *(["_winner.*"] if mutable else []), "_source.source", *derived, "_first.*", "existed")
    merged = stored(merged, "merged")
    unsure = merged.filter(" or ".join(f"_{c}.rank < _best" for c in mutable)).select("id") if mutable else merged.limit(0).select("id")
    if not unsure.isEmpty():
        again = _by_presence(rows.join(unsure, "id", "left_semi"), mutable, seq)
        merged = merged.join(again, "id", "left").withColumns({f"_{c}": F.when(F.col("_again").isNotNull(), F.col(f"_again.{c}")).otherwise(F.when(F.col(f"_{c}").isNotNull(), F.struct(F.col(f"_{c}.{c}").alias(c)))) for c in mutable})
    present = F.filter(F.array(*(F.when(F.col(f"_{c}").isNotNull(), F.lit(c)) for c in mutable)), lambda c: c.isNotNull()) if mutable else F.lit(None).cast("array<string>")
    return merged.select("id", *(F.col(f"_{c}.{c}").alias(c) for c in mutable), "_source.source", *derived, "_first.*", present.alias("present"), "existed")


def _by_presence(rows: DataFrame, mutable: list[str], seq: str) -> DataFrame:
    """(id, _again: for each of ``mutable`` a struct of its value, null if no observation has it), by the order of observations.

    An observation counts if none of a higher rank comes before it, that is, if it comes before the first one of every higher
    rank. Ranks of an id are as many as captures at most, so the window over them is small however many rows an id has.
    """
    firsts = rows.groupBy("id", "_rank").agg(F.min(seq).alias("_from"))
    higher = Window.partitionBy("id").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, -1)
    until = firsts.select("id", "_rank", F.min("_from").over(higher).alias("_until"))
    counted = rows.join(until, ["id", "_rank"]).filter(F.col("_until").isNull() | (F.col(seq) < F.col("_until")))
    values = counted.groupBy("id").agg(*(F.max_by(F.struct(c), F.when(_has(c), F.col(seq))).alias(c) for c in mutable))
    return values.select("id", F.struct(*mutable).alias("_again"))


def new_count(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(~F.col("existed")).alias("n_new"))


def backfill_fold(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Fold captures in ``seq`` order: the mutable fields of the last, source and first_seen of the first, and of every
    other field the first value that isn't empty."""
    frozen = [c for c in ("source", "first_seen", seq) if c in rows.columns]
    mutable = [c for c in K.MUTABLE if c in rows.columns]
    others = [c for c in rows.columns if c not in (*frozen, *mutable, "id")]
    folded = rows.groupBy("id").agg(
        F.max_by(F.struct(*mutable), seq).alias("_last"),
        F.min_by(F.struct(*frozen), seq).alias("_first"),
        *(F.coalesce(F.min_by(c, F.when(_filled(rows, c), F.col(seq))), F.min_by(c, seq)).alias(c) for c in others),
    )
    return folded.select("id", *others, "_last.*", "_first.*")


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the right one's where both have it."""
    rows = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    return last_by_key(rows, key, "_side").drop("_side")


def _fold_days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their days the first of each day whose digest no row before it took."""
    used: set[str] = set()
    done = None
    for batch in batches:
        take = []
        for day, digest in zip(batch.column("day").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            take.append(day != done and digest not in used)
            if take[-1]:
                done = day
                used.add(digest)
        yield batch.filter(pa.array(take, pa.bool_()))


#: Days of a thousand years: as many are broadcast. Stamps that are no dates may give more, which are joined by a shuffle.
CALENDAR_DAYS = 366_000


def capture_reasons(captures: DataFrame, floor: Column) -> DataFrame:
    """Captures (ts, statuscode, digest, ord) with ``reason``: kept, status, floor, same_day or digest.

    In (ts, ord) order a capture of status 200 that isn't under the floor is kept if no kept one before has its day and
    none has its digest. Days follow each other, so each takes its first digest that no earlier day took, and the j-th day
    never needs more than its first j digests: what one task folds is bounded by the calendar, whatever the table's size.
    """
    rows = captures.withColumn("reason", F.when(~F.col("statuscode").eqNullSafe("200"), "status").when(F.col("ts") < floor, "floor"))
    left = rows.filter("reason is null").select("ts", "ord", F.substring("ts", 1, 8).alias("day"), F.coalesce("digest", F.lit("")).alias("digest"))
    # of captures with one day and one digest only the first can be kept
    left = left.groupBy("day", "digest").agg(F.min(F.struct("ts", "ord")).alias("k")).select("k.ts", "k.ord", "day", "digest")
    days = stored(left.select("day").distinct().withColumn("nth_day", F.row_number().over(Window.orderBy("day"))), "days")
    nth = F.row_number().over(Window.partitionBy("day").orderBy("ts", "ord"))
    few = left.withColumn("nth", nth).join(F.broadcast(days) if days.count() <= CALENDAR_DAYS else days, "day").filter("nth <= nth_day").select(*left.columns)
    kept = stored(few.repartition(1).sortWithinPartitions("day", "ts", "ord").mapInArrow(_fold_days, few.schema), "kept")
    by_day = kept.select(F.col("day").alias("_day"), F.struct("ts", "ord").alias("_first"))
    joined = rows.join(by_day, F.substring("ts", 1, 8) == F.col("_day"), "left")
    own = F.struct("ts", "ord")
    reason = F.coalesce("reason", F.when(own == F.col("_first"), "kept").when(F.col("_first") < own, "same_day"), F.lit("digest"))
    return joined.withColumn("reason", reason).drop("_day", "_first")


def distinct_captures(captures: DataFrame) -> DataFrame:
    """The distinct time stamps, ascending: the order in which captures are walked."""
    return captures.select("ts").filter("ts is not null").distinct().orderBy("ts")


def capture_floor(since: Column, include_empty_era: bool = False) -> Column:
    """The later of the requested floor and the first useful capture; only the former on request; "" without any."""
    floor = X.since_floor(since)
    return F.coalesce(floor if include_empty_era else F.greatest(floor, F.lit(K.EARLIEST_CAPTURE)), F.lit(""))


def latest_n(kept: DataFrame, n: int | None) -> DataFrame:
    """The n most recent, ascending; null or negative n: all."""
    if n is None or n < 0:
        return kept.orderBy("ts", "ord")
    return kept.orderBy(F.desc("ts"), F.desc("ord")).limit(n).orderBy("ts", "ord")
