"""Operator 2: near-duplicate documents by HyperMinHash sketches, banding, and checks on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.common import doc_columns, map_arrow, mix64, span_hashes, stored, table, text_chunks, words
from marshlight.llm.components import components, tasks_for

BUCKET_BITS, BUCKETS = 7, 128
MANTISSA_BITS = 10
#: Rows of a band and bands: a pair of similarity 0.8 shares no band with probability (1 - 0.8^4)^32 = 5e-8.
ROWS, BANDS = 4, 32
SIMILARITY = 80
#: A pair of sets of this size at least is dropped unread if its estimate is under ESTIMATE, over 8 deviations below 0.8.
ESTIMATED_SIZE, ESTIMATE = 256, 0.5
#: Fixed bound on the ids that are broadcast to pick the texts to compare; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 300_000
#: Pairs of a centre that go to one task with a copy of its text.
MEMBERS = 512
SKETCH = "doc_id long, n_shingles long, set1 long, set2 long, registers binary, bands array<long>"

_PROBES = np.random.default_rng(7).integers(0, BUCKETS, size=(1024, BUCKETS))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of the texts, ascending in each; how many each has). A text of fewer words is one shingle."""
    lowered, starts, ends, doc = words(data, offsets)
    hashes = span_hashes(lowered, starts, ends)
    texts = len(offsets) - 1
    count = np.bincount(doc, minlength=texts)
    first = np.cumsum(count) - count
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(texts, np.int64)
    rolled = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled += mix64(hashes[k : k + len(rolled)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    rolled = mix64(rolled)
    out: list[np.ndarray] = []
    for a, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= size:
            own = np.sort(rolled[a : a + n - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif n:
            one = np.zeros(1, np.uint64)
            for k in range(n):
                one += mix64(hashes[a + k : a + k + 1] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
            out.append(mix64(one + np.uint64(n)))
        else:
            out.append(hashes[:0])
    return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def registers(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (texts x buckets, 16 bits each, 0: empty) from each text's ascending hashes.

    The top bits choose the bucket; of the smallest hash in it, the leading zeros (6 bits, from 1) and the bits after
    the first one (10) are kept.
    """
    out = np.zeros((len(sizes), BUCKETS), np.uint16)
    if not len(values):
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key = doc * BUCKETS + bucket
    lead = np.append(True, key[1:] != key[:-1])  # ascending, so a bucket's first hash is its smallest
    rest = values[lead] << np.uint64(BUCKET_BITS)
    zeros = 64 - np.frexp((rest & ~np.uint64(0x7FF)).astype(np.float64))[1]
    zeros = np.minimum(zeros, 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[key[lead]] = (((zeros + np.uint64(1)) << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """Give every empty bucket the register of another, chosen by the bucket's own fixed sequence of probes."""
    out = regs.copy()
    doc, bucket = np.nonzero((regs == 0) & (regs != 0).any(axis=1)[:, None])
    for k in range(len(_PROBES)):
        if not len(doc):
            break
        found = regs[doc, _PROBES[k, bucket]]
        out[doc, bucket] = found
        doc, bucket = doc[found == 0], bucket[found == 0]
    if len(doc):
        out[doc, bucket] = regs[doc, (regs[doc] != 0).argmax(axis=1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(filled(regs)).view("<u8")
    return mix64(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two sets without a common element share by chance, after the published approximation."""
    n, m = np.maximum(n, m).astype(float), np.minimum(n, m).astype(float)
    ratio = n / np.maximum(m, 1)
    return 0.169919487159739093975315012348630288992889 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected estimate from two register matrices and the sets' sizes."""
    used = np.maximum(((a != 0) | (b != 0)).sum(axis=1), 1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    return (same - expected_collisions(n, m)) / used


def _sketch(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                values, sizes = shingles(data, offsets, size)
                regs = registers(values, sizes)
                ends = np.cumsum(sizes)
                sums = []
                for salt in (1, 2):  # sums of mixed hashes name a set
                    total = np.append(np.uint64(0), np.cumsum(mix64(values + np.uint64(salt)), dtype=np.uint64))
                    sums.append((total[ends] - total[ends - sizes]).view(np.int64))
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(regs).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(sizes), pa.array(sums[0]), pa.array(sums[1]), pa.array([r.tobytes() for r in regs], pa.binary()), bands],
                    names=["doc_id", "n_shingles", "set1", "set2", "registers", "bands"],
                )

    return run


def _sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                values, sizes = shingles(data, offsets, size)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), lists], names=["doc_id", "shingles"])

    return run


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in ("registers_a", "registers_b"))
        n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        keep = (np.minimum(n, m) < ESTIMATED_SIZE) | (estimated_jaccard(a, b, n, m) >= ESTIMATE)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _check(size: int, similarity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows in order of (a, salt, b), where a null b stands before the others: b's that are similar to their a.

    A centre's text comes once and its set is held while its members stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                values, sizes = shingles(data, offsets, size)
                rows = batch.slice(first, last - first)
                ends, links = np.cumsum(sizes).tolist(), []
                for k, (a, b) in enumerate(zip(rows.column("a").to_pylist(), rows.column("b").to_pylist(), strict=True)):
                    x = values[ends[k] - sizes[k] : ends[k]]
                    if b is None:
                        centre, own = a, x
                    elif a == centre and len(x) and len(own):
                        few, many = (x, own) if len(x) < len(own) else (own, x)
                        both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                        if both and 100 * both >= similarity * (len(x) + len(own) - both):
                            links.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: by sizes, by estimate, and last on the texts' whole sets.

    For the last step the texts go to their centre (a), each once for a pair as its b and each centre once for
    ``MEMBERS`` of its pairs, so that no task gets all members of a large group.
    """
    tasks = tasks_for(pairs, pairs.count())
    side = lambda k: sketches.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("registers").alias(f"registers_{k}"))
    sized = pairs.join(side("a"), "a").coalesce(tasks).join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
    likely = stored(map_arrow(sized.coalesce(tasks), _likely, "a long, b long"), "likely")
    centres = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts")).coalesce(tasks)
    member = likely.join(centres, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), "b")
    alone = centres.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    roles = stored(member.unionByName(alone).coalesce(tasks), "roles")
    n = roles.count()
    if n == 0:
        return likely
    texts = docs.join(F.broadcast(roles) if n <= BROADCAST_IDS else roles, "doc_id").select("a", "salt", "b", "text")
    dealt = texts.repartition(tasks_for(roles, 8 * n), "a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return stored(map_arrow(dealt, _check(size, similarity), "a long, b long"), "links")


def _ids(rows: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """(distinct doc_id, their number): marked for a broadcast if they are within the bound."""
    ids = stored(rows.coalesce(tasks).distinct().coalesce(tasks), "ids")
    n = ids.count()
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids, n


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, component) after more links; a node that isn't there is its own component."""
    if labels is None:
        return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    tasks = tasks_for(labels, labels.count())
    of = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    up = links.join(of("a"), "a", "left").coalesce(tasks).join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("u"), F.coalesce("c_b", "b").alias("v")).coalesce(tasks)
    more = components(up).select(F.col("node").alias("was"), F.col("component").alias("now"))
    moved = labels.join(more, labels["component"] == more["was"], "left").select("node", F.coalesce("now", "component").alias("component")).coalesce(tasks)
    return stored(moved.unionByName(more.select(F.col("was").alias("node"), F.col("now").alias("component"))).coalesce(tasks).distinct().coalesce(tasks), "labels")


def _with_component(members: DataFrame, labels: DataFrame) -> DataFrame:
    joined = members.join(labels, members["doc_id"] == labels["node"], "left")
    return joined.select(*(members[c] for c in members.columns), F.coalesce("component", "doc_id").alias("component"))


def _in_open(members: DataFrame, tasks: int) -> DataFrame:
    """Of (band, doc_id, component) the rows of bands with more than one component."""
    mixed = members.groupBy("band").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed").select("band")
    return members.join(mixed.coalesce(tasks), "band", "left_semi").coalesce(tasks)


def _prefixes(members: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, similarity: int) -> DataFrame:
    """(doc_id, n, own, common, prefix): of each class the shingles that no other in ``members`` has, the mean number of
    classes that have its shingles, and the rarest of those that others have too: as many as a partner of the
    threshold can't all lack."""
    tasks = tasks_for(members, members.count())
    ids, n = _ids(members.select("doc_id"), tasks)
    texts = docs.join(ids, "doc_id", "left_semi").coalesce(tasks_for(members, 20 * n))
    rows = map_arrow(texts, _sets(size), "doc_id long, shingles array<long>").select("doc_id", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))
    rows = stored(rows, "shingles")
    wide = tasks_for(rows, rows.count())
    often = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("f")).filter("f > 1").coalesce(wide)
    shared = rows.join(often, "shingle").coalesce(wide).groupBy("doc_id", "n").agg(F.sum("f").alias("f"), F.array_sort(F.collect_list(F.struct("f", "shingle"))).alias("shared"))
    overlap = F.ceil(similarity * (F.col("n") + F.ceil(F.col("n") * similarity / 100)) / (100 + similarity))  # with the smallest partner
    own = F.col("n") - F.size("shared")
    taken = F.greatest(F.least(F.col("n") - overlap + 1, F.col("n")) - own, F.lit(0)).cast("int")
    return shared.select("doc_id", "n", own.alias("own"), (F.col("f") / F.col("n")).alias("common"), F.slice(F.col("shared.shingle"), F.lit(1), taken).alias("prefix")).coalesce(wide)


def _with_origin(members: DataFrame, prefixes: DataFrame, tasks: int) -> DataFrame:
    """(a, b): in each band the class with the most common shingles (a), with each class of another component."""
    rows = members.join(prefixes.select("doc_id", "common"), "doc_id").coalesce(tasks)
    origin = rows.groupBy("band").agg(F.max_by(F.struct("doc_id", "component"), F.struct("common", "doc_id")).alias("o")).coalesce(tasks)
    pairs = members.join(origin, "band").filter(F.col("component") != F.col("o.component"))
    return pairs.select(F.col("o.doc_id").alias("a"), F.col("doc_id").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs that aren't in ``tried``, in whatever order their ends are there."""
    known = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return pairs.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def _shared_prefixes(members: DataFrame, similarity: int) -> DataFrame:
    """(a, b): classes of two components that share a shingle of both prefixes, so early that the shingles from there on
    can still reach the threshold.

    Of each shingle's classes those outside its most frequent component meet all, so copies that are linked already
    don't meet each other.
    """
    rows = stored(members.select("doc_id", "n", "component", "own", F.posexplode("prefix").alias("place", "shingle")), "prefix-rows")
    tasks = tasks_for(rows, rows.count())
    sizes = rows.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k")).coalesce(tasks)
    main = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts").coalesce(tasks)
    open_rows = stored(rows.join(main, "shingle").coalesce(tasks), "open-rows")
    few = open_rows.filter("component <> main")
    x = few.select(*(F.col(c).alias(f"{c}_x") for c in few.columns))
    rest = F.least(F.col("n") - F.col("own") - F.col("place"), F.col("n_x") - F.col("own_x") - F.col("place_x"))
    fit = (100 + similarity) * rest >= similarity * (F.col("n") + F.col("n_x"))
    pairs = open_rows.join(x, (F.col("shingle") == F.col("shingle_x")) & (F.col("component") != F.col("component_x")) & fit)
    return pairs.select(F.least("doc_id", "doc_id_x").alias("a"), F.greatest("doc_id", "doc_id_x").alias("b")).coalesce(tasks).distinct().coalesce(tasks)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """Groups of documents linked by 100 * |A and B| >= similarity * |A or B| on sets of ``shingle_words``-word shingles.

    Returns per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that links reach),
    kept (it is that one). Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; a text of
    fewer words is one shingle; null, empty and blank texts have none and are linked with nothing. Where doc_ids
    repeat or are null every row is a document of its own: component_id is the smallest doc_id of its component (null
    if there is none), and of each component one row of it is kept. An empty table gives no rows.

    Method. Equal sets are one class, represented by its smallest id. Classes that share a band of filled registers are
    candidates, and each class of a bucket is first compared with the bucket's smallest. Buckets whose other classes
    are then in one component are done. In each of the rest the class whose shingles are the most common there, the
    likely origin of the copies, is compared with the others. Last, of two classes still in different components that can reach the threshold, one must hold a shingle of the other among its
    rarest few (the prefix principle of set joins): such pairs are compared. So a bucket of copies of any size costs few
    comparisons a member, and no link between candidates is lost. Sets of up to 255 shingles go straight to the check
    on whole sets, larger ones first past the estimate.
    """
    docs = doc_columns(docs)
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return _by_row(docs, shingle_words, similarity)
    sketches = stored(map_arrow(docs, _sketch(shingle_words), SKETCH), "sketches")
    named = ["n_shingles", "set1", "set2"]
    classes = stored(sketches.filter("n_shingles > 0").groupBy(*named).agg(F.min("doc_id").alias("rep")), "classes")
    own = stored(sketches.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "class-sketches")
    members = own.select("doc_id", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = stored(members.join(shared, "band"), "buckets")
    tasks = tasks_for(buckets, buckets.count())
    pairs = buckets.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))
    pairs = stored(pairs.coalesce(tasks).distinct().coalesce(tasks), "pairs")
    compare = lambda some: _links(some, own, docs, shingle_words, similarity)
    labels = _relabel(None, compare(pairs))
    others = buckets.filter("doc_id <> centre").select("band", "doc_id")
    left = stored(_in_open(_with_component(others, labels).coalesce(tasks), tasks), "left")
    if not left.isEmpty():
        tasks = tasks_for(left, left.count())
        prefixes = stored(_prefixes(left, own, docs, shingle_words, similarity), "prefixes")
        more = stored(_untried(_with_origin(left, prefixes, tasks), pairs).coalesce(tasks), "pairs")
        labels, tried = _relabel(labels, compare(more)), pairs.unionByName(more)
        last = _shared_prefixes(_with_component(prefixes, labels).coalesce(tasks), similarity)
        labels = _relabel(labels, compare(stored(_untried(last, tried).coalesce(tasks), "pairs")))
    component = labels.select(F.col("node").alias("rep"), "component")
    of_class = classes.join(component, "rep", "left").select(*named, F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", *named).join(of_class, named, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _by_row(docs: DataFrame, shingle_words: int, similarity: int) -> DataFrame:
    """The groups of rows whose doc_ids don't tell them apart: rows are numbered, and named by their doc_ids again at the end."""
    rows = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), shingle_words, similarity)
    members = stored(groups.withColumnsRenamed({"doc_id": "row", "component_id": "component"}).drop("kept").join(rows.select("row", "doc_id"), "row"), "row-groups")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    joined = members.join(first, "component")
    return joined.select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)
