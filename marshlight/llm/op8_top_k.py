"""Operator 8: exact top-k inner-product search by MaxScore over sharded, dimension-wise postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marshlight.llm.common import map_arrow, parallelism, stored, table

SCALE = 256
#: Fixed sizes: bytes of a shard's components (a task holds a few times as many), and candidates that one step of the traversal takes.
#: All queries pass every shard, so their copies are queries x bytes of all candidates / SHARD_BYTES: raise it where executors are large.
SHARD_BYTES, STEP_ROWS = 32 << 20, 1_024
PROBE_TERMS = 8
#: A dimension is kept as a list of the candidates that aren't 0 in it while they are at most one in so many.
SPARSE = 4
HITS = "query long, query_id long, vec_id long, score long, fits boolean"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors without null or non-finite components, as doubles."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(good).select("vec_id", x.alias("v"))


class Postings:
    """A shard's candidates of one length by dimension (term): their components and the bounds of each term.

    Doubles where every sum of products is exact in them, Python integers where not. A term in which few candidates
    have a component other than 0 is a list of those; any other is a row over all candidates.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.rows = ids, np.ascontiguousarray(scaled(vectors).T)
        self.top, self.low = self.rows.max(axis=1), self.rows.min(axis=1)
        self.peak = float(np.abs(self.rows).max(initial=0))
        held = np.count_nonzero(self.rows, axis=1)
        self.lists = {int(t): np.flatnonzero(self.rows[t]) for t in np.flatnonzero(held * SPARSE <= len(ids))}
        self._exact: Postings | None = None

    def for_query(self, query: np.ndarray) -> Postings:
        """These postings, as integers if doubles could round a score of the query."""
        if self.rows.dtype == object or self.peak * float(np.abs(query).max(initial=0)) * len(query) < 2**52:
            return self
        if self._exact is None:
            self._exact = object.__new__(Postings)
            self._exact.__dict__ |= self.__dict__
            self._exact.rows = integers(self.rows)
            self._exact.top, self._exact.low = integers(self.top), integers(self.low)
        return self._exact

    def add(self, score: np.ndarray, term: int, weight: object, begin: int) -> None:
        """Add a listed term's products to the candidates from ``begin`` on."""
        at = self.lists[term]
        a, b = np.searchsorted(at, [begin, begin + len(score)])
        score[at[a:b] - begin] += weight * self.rows[term, at[a:b]]


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), exact: doubles of this size are whole numbers or keep all their digits."""
    with np.errstate(over="ignore"):
        out = np.floor(x * SCALE)
    if not np.isfinite(out).all():
        raise ArithmeticError("256 * x is beyond the doubles")
    return out


def integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.reshape(-1)], dtype=object).reshape(x.shape)


def maxscore(query: np.ndarray, own: int, postings: Postings, k: int) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of one shard for a query (scaled); ties to smaller ids.

    A term can add ``max(q * top, q * low)`` at most. While the terms of the smallest bounds together stay below the
    k-th best score they aren't essential: candidates get the essential terms first, and the others are probed, the
    largest bounds first, only for candidates that can still get in. The query's zero components are no terms.
    """
    postings = postings.for_query(query)
    exact = postings.rows.dtype == object
    query, ids = integers(query) if exact else query, postings.ids
    terms = np.flatnonzero(query)
    bounds = np.maximum(query[terms] * postings.top[terms], query[terms] * postings.low[terms])
    order = terms[np.argsort(-bounds, kind="stable")]
    bounds = np.sort(bounds)[::-1]
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the terms from a place on can still add
    dense = np.array([t not in postings.lists for t in order], bool)
    best: list[tuple[int, int]] = []
    for begin in range(0, len(ids), STEP_ROWS):
        part = slice(begin, begin + STEP_ROWS)
        least = best[-1][0] if len(best) == k else None
        essential = len(order) if least is None else int(np.searchsorted(-rest, -least, side="left"))
        essential = min(max(essential, 1), len(order))
        full = order[:essential][dense[:essential]]
        score = query[full] @ postings.rows[full, part] if len(full) else np.zeros(len(ids[part]), object if exact else float)
        for term in order[:essential][~dense[:essential]]:
            postings.add(score, int(term), query[term], begin)
        live = np.flatnonzero(ids[part] != own)
        score, at = score[live], essential
        while at < len(order) and len(live):
            stay = score + rest[at] >= least
            live, score = live[stay], score[stay]
            some = order[at : at + PROBE_TERMS]
            score = score + query[some] @ postings.rows[np.ix_(some, live + begin)]
            at += PROBE_TERMS
        if least is not None:
            stay = score >= least
            live, score = live[stay], score[stay]
        if len(live):
            if len(live) > k:  # keep all that tie with the k-th
                cut = np.sort(score)[-k] if exact else np.partition(score, len(score) - k)[len(score) - k]
                live, score = live[score >= cut], score[score >= cut]
            found = sorted([*((-int(s), int(i)) for s, i in zip(score, ids[live + begin], strict=True)), *((-s, i) for s, i in best)])
            best = [(-s, i) for s, i in found[:k]]
    return best


class Shard:
    """The candidates that come before a shard's queries; of rows that are wholly equal no more than k are held."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors = k, {}, {}
        self.postings: dict[int, Postings] | None = None

    def take(self, ids: np.ndarray, lists: pa.ListArray) -> None:
        """Rows in order of vec_id and vector, so that equal ones follow each other."""
        for size, at, vectors in by_length(lists):
            old_ids, old = self.ids.setdefault(size, []), self.vectors.setdefault(size, [])
            own = np.concatenate([old_ids[-1][-self.k :], ids[at]]) if old_ids else ids[at]
            rows = np.concatenate([old[-1][-self.k :], vectors]) if old else vectors
            first = len(own) - len(at)
            more = np.ones(len(own), bool)
            if len(own) > self.k:
                more[self.k :] = (own[self.k :] != own[: -self.k]) | (rows[self.k :] != rows[: -self.k]).any(axis=1)
            more = more[first:]
            if more.any():
                old_ids.append(ids[at][more])
                old.append(vectors[more])

    def search(self, numbers: np.ndarray, ids: np.ndarray, lists: pa.ListArray) -> list[tuple[int, int, int, int]]:
        if self.postings is None:
            self.postings = {n: Postings(np.concatenate(self.ids[n]), np.concatenate(self.vectors[n])) for n in self.ids}
            self.ids, self.vectors = {}, {}
        out = []
        for size, at, vectors in by_length(lists):
            if size in self.postings:
                for number, own, q in zip(numbers[at].tolist(), ids[at].tolist(), scaled(vectors), strict=True):
                    out += [(number, own, i, s) for s, i in maxscore(q, own, self.postings[size], self.k)]
        return out


def by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the lists of each length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        yield size, at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)


def _search(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = -1, Shard(k)
        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1]))) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)], strict=True):
                if shards[a] != number:
                    number, shard = shards[a], Shard(k)
                rows = batch.slice(a, b - a)
                ids, lists = rows.column("vec_id").to_numpy(), rows.column("v")
                if not asks[a]:
                    shard.take(ids, lists)
                    continue
                hits = shard.search(rows.column("query").to_numpy(zero_copy_only=False), ids, lists)
                fits = [-(2**63) <= s < 2**63 for *_, s in hits]
                columns = [pa.array([h[c] for h in hits], pa.int64()) for c in range(3)]
                scores = [s if ok else (2**63 - 1 if s > 0 else -(2**63)) for (*_, s), ok in zip(hits, fits, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.int64()), pa.array(fits, pa.bool_())], names=["query", "query_id", "vec_id", "score", "fits"])

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Per query the k highest integer inner products with other candidates: query_id, rank (from 1), vec_id, score.

    Both tables have vec_id and embedding. Components count as floor(256 * x), exactly; vectors that are null or empty
    or hold null or non-finite components, and rows without a vec_id, take no part. Only vectors of a query's own length
    are its candidates, and rows of its own vec_id aren't. Ties go to the smaller vec_id; a repeated candidate row is
    listed as often as it occurs; a repeated query row is asked once, and rows of one vec_id with different vectors are
    queries of their own. With fewer candidates all are returned. A score among the k best that doesn't fit a long is
    an error, and so is a component beyond the doubles after scaling.

    Candidates are dealt by hash to shards of a fixed number of bytes, whatever their length, each once; every shard's task builds the shard's postings
    from the rows that come first and then walks all queries as they stream past. The shards' best are merged per query.
    """
    spark = candidates.sparkSession
    held = candidates.agg(F.coalesce(F.sum(8 * F.greatest(F.size("embedding"), F.lit(0)).cast("long")), F.lit(0))).first()[0]
    shards = max(parallelism(spark), -(-held // SHARD_BYTES))
    asked = stored(whole_vectors(queries).dropDuplicates(["vec_id", "v"]).withColumn("query", F.monotonically_increasing_id()), "queries")
    mine = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")
    rows = whole_vectors(candidates).select(mine.alias("shard"), F.lit(False).alias("ask"), F.lit(-1).cast("long").alias("query"), "vec_id", "v")
    every = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("ask"), "query", "vec_id", "v")
    dealt = rows.unionByName(every).repartition(shards, "shard").sortWithinPartitions("shard", "ask", "vec_id", "v")
    hits = map_arrow(dealt, _search(k), HITS)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = hits.withColumn("rank", rank).filter(F.col("rank") <= k)
    score = F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error(F.lit("a score doesn't fit a long")).cast("long"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by 50; candidates: all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 5"""
