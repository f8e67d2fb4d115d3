"""Operator 7: exact dedup of arrivals against a sharded minimal-perfect-hash index of the distinct digests seen before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.common import LOWER_ASCII, UPPER_ASCII, doc_columns, mix64, parallelism, scratch_dir, stored, table

#: Distinct digests of one index shard; fixed, so that building or probing a shard takes bounded memory.
SHARD_DIGESTS = 100_000
_LEVELS, _SPREAD = 40, 2
INDEX = "shard int, sizes array<long>, bits binary, rest binary, digests binary, winners array<long>, named array<boolean>, rows array<long>, counts array<long>"
GROUPS = "digest binary, keep_id long, named boolean, keep_row long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased; null counts as empty. JVM only."""
    normal = F.translate(F.coalesce("text", F.lit("")), UPPER_ASCII, LOWER_ASCII)
    return doc_columns(docs).select("doc_id", F.unhex(F.sha2(normal, 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, group_size): the largest doc_id, the first row that has it, and the number of rows; summed in
    each task before the shuffle. Without any id the first row stays."""
    best = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", (-F.col("row")).alias("row"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size")).select("digest", "best.doc_id", (-F.col("best.row")).alias("keep_row"), "group_size").withColumnRenamed("doc_id", "keep_id")


def _keys(digest: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digest).view("<u8").reshape(len(digest), 4)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys[:, level % 4] + keys[:, (level + 1) % 4] * np.uint64(2 * level + 1) + np.uint64(level)) % np.uint64(size)).astype(np.int64)


def build_hash(digest: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct digests (n x 32 bytes): (sizes of the levels, their bits, digests left over).

    On each level the keys that land alone on a bit take it and the others go on to the next; a key's slot is the
    number of set bits before its own. Keys left after the last level are listed; they follow the others.
    """
    keys, left, sizes, bits = _keys(digest), np.arange(len(digest)), [], []
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(64, _SPREAD * len(left))
        place = _place(keys[left], level, size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool), digest[left]


def slots(digest: np.ndarray, sizes: list[int], bits: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The slot of each digest. A digest that isn't in the index gets some slot or -1: the caller compares the bytes."""
    keys, out, todo, base = _keys(digest), np.full(len(digest), -1, np.int64), np.arange(len(digest)), 0
    rank = np.cumsum(bits) - 1
    for level, size in enumerate(sizes):
        place = base + _place(keys[todo], level, size)
        hit = bits[place]
        out[todo[hit]] = rank[place[hit]]
        todo, base = todo[~hit], base + size
    known = {r.tobytes(): int(bits.sum()) + k for k, r in enumerate(rest)}
    for k in todo if known else []:
        out[k] = known.get(digest[k].tobytes(), -1)
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), 32)


def _ids(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, whether each is one, rows): of rows without an id the number means nothing."""
    return rows["keep_id"].to_numpy().astype(np.int64), rows["named"].to_numpy().astype(bool), rows["keep_row"].to_numpy().astype(np.int64)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    digest, (ids, named, place) = _matrix(rows["digest"]), _ids(rows)
    sizes, bits, rest = build_hash(digest)
    order = np.argsort(slots(digest, sizes, bits, rest))
    packed = [int(rows["shard"].iloc[0]), sizes, np.packbits(bits).tobytes(), rest.tobytes(), digest[order].tobytes(), ids[order], named[order], place[order], rows["group_size"].to_numpy()[order]]
    return pd.DataFrame([packed], columns=["shard", "sizes", "bits", "rest", "digests", "winners", "named", "rows", "counts"])


def _probe(arrivals: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """All groups of a shard: the index' slots, with what arrived for them, and the arrivals that aren't in it."""
    new, (ids, named, place), sizes = _matrix(arrivals["digest"]), _ids(arrivals), arrivals["group_size"].to_numpy().astype(np.int64)
    if not len(index):
        held, winners, known, first = np.zeros((0, 32), np.uint8), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        counts, member = np.zeros(0, np.int64), np.zeros(len(new), bool)
    else:
        r = index.iloc[0]
        held = np.frombuffer(r["digests"], np.uint8).reshape(-1, 32)
        winners, known, first, counts = np.array(r["winners"], np.int64), np.array(r["named"], bool), np.array(r["rows"], np.int64), np.array(r["counts"], np.int64)
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=int(np.sum(r["sizes"]))).astype(bool)
        slot = slots(new, list(r["sizes"]), bits, np.frombuffer(r["rest"], np.uint8).reshape(-1, 32))
        member = slot >= 0
        member[member] = (held[slot[member]] == new[member]).all(axis=1)  # the bytes decide
        at = slot[member]  # arrivals are distinct, so no slot comes twice
        better = named[member] & (~known[at] | (ids[member] > winners[at]))
        better |= (named[member] == known[at]) & (~known[at] | (ids[member] == winners[at])) & (place[member] < first[at])
        winners[at], known[at], counts[at] = np.where(better, ids[member], winners[at]), known[at] | named[member], counts[at] + sizes[member]
        first[at] = np.where(better, place[member], first[at])
    digest = np.concatenate([held, new[~member]])
    out = {"digest": [d.tobytes() for d in digest], "keep_id": np.concatenate([winners, ids[~member]]), "named": np.concatenate([known, named[~member]]), "keep_row": np.concatenate([first, place[~member]]), "group_size": np.concatenate([counts, sizes[~member]])}
    return pd.DataFrame(out)


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    """With the shard of each digest; an id that is null is marked and becomes 0, so that ids stay whole numbers in pandas."""
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")
    return groups.select("digest", F.coalesce("keep_id", F.lit(0).cast("long")).alias("keep_id"), F.col("keep_id").isNotNull().alias("named"), "keep_row", "group_size", shard)


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row a shard from (digest, keep_id, keep_row, group_size) with distinct digests; save it with ``write.parquet``."""
    return _sharded(history, shards).groupBy("shard").applyInPandas(_build, INDEX)


def merge_groups(arrivals: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """All groups after ``arrivals`` (distinct digests) have been looked up in ``index``; both sides go by shard."""
    groups = _sharded(arrivals, shards).groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, GROUPS)
    return groups.select("digest", F.when(F.col("named"), F.col("keep_id")).alias("keep_id"), "keep_row", "group_size")


def exact_dedup(history: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Groups of equal texts over both tables (doc_id, text), found by indexing the one and probing it with the other.

    Returns one row per document of either table: doc_id, keep_id (largest doc_id of its group), group_size, kept,
    text_sha256. Texts are equal when identical after lower-casing A-Z; null counts as empty. Ids are any longs; a
    row with a null doc_id counts in group_size and may stay only if no row of its group has an id. Rows that
    repeat a doc_id are counted and returned one by one. Of each group exactly one row is kept: of those with the largest
    doc_id, or of all where none has an id, the first as Spark reads them, those of ``history`` first. Either table may be empty.

    Only digests move: they are summed in each task before a shuffle, and the join that gives every document its
    group can be split where one text is most of the corpus.
    """
    spark = history.sparkSession
    old, new = digests(history).withColumn("arrival", F.lit(False)), digests(arrivals).withColumn("arrival", F.lit(True))
    rows = stored(old.unionByName(new).withColumn("row", F.monotonically_increasing_id()), "digests")  # numbered once, as they are written
    shards = max(4 * parallelism(spark), -(-rows.count() // SHARD_DIGESTS))
    path = scratch_dir(spark, "digest-index")
    build_index(distinct_digests(rows.filter("not arrival")), shards).write.parquet(path)
    index = spark.read.schema(INDEX).parquet(path)
    groups = merge_groups(distinct_digests(rows.filter("arrival")), index, shards)
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return rows.join(groups, "digest").select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as two deliveries of about a half each (by a hash of doc_id): the second meets the first's index."""
    docs = table(spark, sf_dir, "documents")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    return exact_dedup(docs.filter(~late), docs.filter(late))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER_ASCII}', '{LOWER_ASCII}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""
