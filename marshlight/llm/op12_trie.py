"""Operator 12: the prefix trie of conversations, by union-find over the common prefixes of sorted neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshlight.llm.common import map_arrow, parallelism, stored, table
from marshlight.llm.turns import numbered, order_columns, ordered_sha256

#: Turns of a block: a longer conversation is a chain of blocks, whose tries hang under each other.
BLOCK = 4096
#: Sequences and characters of a chunk of sorted sequences, which one forest is built of.
CHUNK_SEQUENCES, CHUNK_CHARS = 20_000, 16 << 20
#: Characters that stand for a turn in a key: 128 bits in hex.
DIGITS = 32
#: Ids of one piece of a list of members.
PIECE_IDS = 8192
#: Open nodes that are broadcast to their children; beyond it they are joined by a shuffle.
BROADCAST_NODES = 200_000
EMPTY_SHA = hashlib.sha256().hexdigest()


def common_turns(a: str, b: str) -> int:
    """Turns that two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGITS
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * DIGITS] == b[: middle * DIGITS]:
            low = middle
        else:
            high = middle - 1
    return low


_SEQUENCE = "prefix string, key string, lengths array<long>, n long, ends long, low long, below_children long, below_leaves long, below_saved long"


def _neighbours(sequences_most: int, chars_most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted sequences with their task, a number of a chunk, and how many turns they share with the one before and after;
    null at the ends of the task, -1 if the other one hangs elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, last, left, count, chars, chunk = TaskContext.get().partitionId(), None, None, None, 0, 0, 0

        def marked(batch: pa.RecordBatch, chunks: list[int], before: list[int | None], after: list[int | None]) -> pa.RecordBatch:
            columns = [*batch.columns, pa.array([task] * len(chunks), pa.int32()), pa.array(chunks, pa.int64()), pa.array(before, pa.int32()), pa.array(after, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "task", "chunk", "before", "after"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, before, shares = [], [], []
            for prefix, key in zip(batch.column("prefix").to_pylist(), batch.column("key").to_pylist(), strict=True):
                share = None if last is None else common_turns(last[1], key) if last[0] == prefix else -1
                if count and (count >= sequences_most or chars + len(key) > chars_most):
                    chunk, count, chars = chunk + 1, 0, 0
                count, chars, last = count + 1, chars + len(key), (prefix, key)
                chunks.append(chunk)
                before.append(share)
                shares.append(share)
            if held is not None:
                yield marked(*held, [*left, shares[0]])
            held, left = (batch, chunks, before), shares[1:]
        if held is not None:
            yield marked(*held, [*left, None])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the first and the last sequence of each task, in order: turns shared with the neighbour in the other task."""
    last = None
    for batch in batches:
        out = []
        for task, first, prefix, key in zip(*(batch.column(c).to_pylist() for c in ("task", "first", "prefix", "key")), strict=True):
            if first:
                share = -1 if last is None or last[1] != prefix else common_turns(last[2], key)
                if last is not None:
                    out.append((last[0], False, share))
                out.append((task, True, share))
            last = (task, prefix, key)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.int32()))], names=["edge_task", "edge_first", "share"])


class _Component:
    """Neighbours that share a prefix, and their node: of ``depth`` turns, still open to more neighbours."""

    __slots__ = ("children", "depth", "first", "last", "leaves", "low", "n", "pending", "saved", "sequence")

    def __init__(self, at: int, depth: int, n: int, low: int, children: int, leaves: int, saved: int, sequence: str | None):
        self.first, self.last, self.depth, self.n, self.low = at, at, depth, n, low
        self.children, self.leaves, self.saved, self.sequence, self.pending = children, leaves, saved, sequence, []


NODE = "prefix string, depth int, id string, low long, n long, children long, leaves long, saved long, parent_id string, parent_low long, sequence string"
_NODE = pa.schema([("prefix", pa.string()), ("depth", pa.int32()), ("id", pa.string()), *((n, pa.int64()) for n in ("low", "n", "children", "leaves", "saved")), ("parent_id", pa.string()), ("parent_low", pa.int64()), ("sequence", pa.string())])


def sequence_id(prefix: str, key: str) -> str:
    return hashlib.sha256((prefix + key).encode()).hexdigest()


def forest(rows: list[dict], left: int, right: int) -> list[list]:
    """The nodes of a chunk of sorted distinct sequences; ``left`` and ``right``: turns shared with those before and after it.

    Edges join neighbours, deepest common prefix first. When a component is joined at a depth less than its own, its
    node is finished, and so are those on the way up to the edge's depth, one a turn; the joined components become one
    node there. A node that reaches over an end of the chunk, and each root, is *open*: it gets an id by its prefix, and its
    numbers are this chunk's part; the parts of an id add up to the node. So that they do, a node's own turn is taken off,
    and a child counted, only where its first sequence is. All other nodes are closed and final but for an open parent.
    """
    out: list[list] = []
    size = len(rows)
    components = [
        _Component(k, len(r["lengths"]), r["n"], r["low"], r["below_children"], r["below_leaves"] if r["below_children"] else int((rows[k + 1]["before"] if k + 1 < size else right) < len(r["lengths"])),
                   r["below_saved"], sequence_id(r["prefix"], r["key"]) if r["ends"] else None)
        for k, r in enumerate(rows)
    ]
    boss = list(range(size))

    def find(k: int) -> int:
        while boss[k] != k:
            boss[k] = boss[boss[k]]
            k = boss[k]
        return k

    def finish(c: _Component) -> None:
        """Write the component's node and pass it to its children; the one above it is next."""
        row, depth = rows[c.first], c.depth
        here = c.first > 0 or depth > left
        is_open = depth == 0 or not here or (c.last == size - 1 and depth <= right)
        name = ("" if not is_open else f"root:{row['prefix']}" if not depth else sequence_id(row["prefix"] + "|", row["key"][: depth * DIGITS])) or None
        length = row["lengths"][depth - 1] if depth else 0
        c.saved += c.n * length - here * length
        record = [row["prefix"], depth, name, c.low, c.n, c.children, c.leaves, c.saved, None, None, c.sequence]
        for child in c.pending:
            if is_open:
                child[8] = name
            else:
                child[9] = c.low
        out.append(record)
        c.depth, c.children, c.pending, c.sequence = depth - 1, int(here), [record], None

    for k in sorted((k for k in range(1, size) if rows[k]["before"] >= 0), key=lambda k: -rows[k]["before"]):
        a, b = find(k - 1), find(k)
        one, other = components[a], components[b]
        for c in (one, other):
            while c.depth > rows[k]["before"]:
                finish(c)
        boss[b] = a
        one.last, one.n, one.low = other.last, one.n + other.n, min(one.low, other.low)
        one.children, one.leaves, one.saved = one.children + other.children, one.leaves + other.leaves, one.saved + other.saved
        one.pending += other.pending
        one.sequence = one.sequence or other.sequence
    for k in range(size):
        if boss[k] == k:
            while components[k].depth >= 0:
                finish(components[k])
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences in order of (task, chunk) to the nodes of each chunk's forest."""

    def closed(rows: list[dict]) -> pa.RecordBatch:
        nodes = forest(rows, rows[0]["before"], rows[-1]["after"])
        return pa.RecordBatch.from_arrays([pa.array([n[k] for n in nodes], f.type) for k, f in enumerate(_NODE)], schema=_NODE)

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["task"], row["chunk"]) != (held[0]["task"], held[0]["chunk"]):
                yield closed(held)
                held = []
            held.append(row)
    if held:
        yield closed(held)


def level_nodes(sequences: DataFrame, chunk_sequences: int = CHUNK_SEQUENCES) -> DataFrame:
    """All parts of nodes (NODE) of the tries of one level, from distinct sequences (_SEQUENCE)."""
    tasks = parallelism(sequences.sparkSession)
    by_range = sequences.repartitionByRange(tasks, "prefix", "key").sortWithinPartitions("prefix", "key")
    schema = T.StructType([*sequences.schema.fields, T.StructField("task", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType())])
    marked = stored(map_arrow(by_range, _neighbours(chunk_sequences, CHUNK_CHARS), schema), "trie-neighbours")
    outer = [marked.filter(f"{c} is null").select("task", F.lit(first).alias("first"), "prefix", "key") for c, first in (("before", True), ("after", False))]
    # two rows a task, put in order by one task
    edges = map_arrow(outer[0].unionByName(outer[1]).repartition(1).sortWithinPartitions("task", F.desc("first")), _edges, "edge_task int, edge_first boolean, share int")
    ends = edges.groupBy("edge_task").agg(F.max(F.when(F.col("edge_first"), F.col("share"))).alias("left"), F.max(F.when(~F.col("edge_first"), F.col("share"))).alias("right"))
    whole = marked.join(F.broadcast(ends), F.col("task") == F.col("edge_task"), "left")  # a row a task
    whole = whole.withColumns({"before": F.coalesce("before", "left", F.lit(-1)), "after": F.coalesce("after", "right", F.lit(-1))}).drop("edge_task", "left", "right")
    chunks = whole.repartition("task", "chunk").sortWithinPartitions("task", "chunk", "prefix", "key")
    return stored(map_arrow(chunks, _forests, NODE), "trie-nodes")


def merged_open(nodes: DataFrame) -> DataFrame:
    """Open nodes put together from the parts of all chunks."""
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    same = [F.max(c).alias(c) for c in ("parent_id", "sequence")]
    return nodes.filter("id is not null").groupBy("id", "prefix", "depth").agg(F.min("low").alias("low"), *sums, *same)


def prefix_trie(members: DataFrame, turns: DataFrame, block: int = BLOCK, chunk_sequences: int = CHUNK_SEQUENCES) -> tuple[DataFrame, DataFrame]:
    """The trie of sequences of turns: (nodes, ends).

    ``members``: conv_id, each once and not null; ``turns``: conv_id, depth (1, 2, ... without gaps), who (hex digest of what
    the turn is, 128 bits at least) and length. A node is a distinct sequence of first turns; the root is the empty one.
    Nodes: conv_id (the smallest member), depth, parent_conv_id (the parent's, null for the root), n_convs (conversations
    that begin with it), n_children, n_leaves (nodes without children in its subtree, itself included), saved_tokens
    ((n_convs - 1) times the length of a node's last turn, summed over its subtree), sequence (a name where conversations
    end, else null). Ends: sequence, conv_id of those that end there. Without members both are empty.

    Equal sequences are counted in tasks before they are shuffled, and sorted sequences are dealt by ranges, so groups of
    copies and long common prefixes lie in many tasks. Of a conversation a task holds ``block`` turns' digests at once:
    the turns after the first ``block`` are a sequence that hangs under the node of those, in a trie of a level of its own,
    and levels are done from the lowest, as its roots' numbers are part of the nodes above.
    """
    spark = members.sparkSession
    piece = F.floor((F.col("depth") - 1) / block).cast("long")
    held = turns.withColumn("block", piece).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("depth", F.substring("who", 1, DIGITS).alias("who"), "length"))).alias("t"))
    blocks = stored(held.select("conv_id", "block", F.array_join("t.who", "").alias("key"), F.col("t.length").alias("lengths")), "trie-blocks")
    top = blocks.agg(F.max("block")).first()[0] or 0
    silent = members.join(blocks.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit("").alias("key"), F.expr("cast(array() as array<bigint>)").alias("lengths"))
    levels, now = [], blocks.filter("block = 0").select("conv_id", "key", "lengths").unionByName(silent).withColumn("prefix", F.lit(""))
    for level in range(top + 1):
        sequence = F.sha2(F.concat("prefix", "key"), 256)
        if level < top:
            more = blocks.filter(F.col("block") == level + 1)
            now = stored(now.join(more.select("conv_id", F.lit(False).alias("end")), "conv_id", "left").withColumn("end", F.coalesce("end", F.lit(True))), "trie-level")
            levels.append(now)
            now = more.select("conv_id", "key", "lengths").join(now.select("conv_id", sequence.alias("prefix")), "conv_id")
        else:
            levels.append(now.withColumn("end", F.lit(True)))
    nodes, ends, below, lows = [], [], None, {}
    for level in range(top, -1, -1):
        rows = levels[level]
        distinct = rows.groupBy("prefix", "key").agg(F.first("lengths").alias("lengths"), F.count(F.lit(1)).alias("n"), F.count_if("end").alias("ends"), F.min("conv_id").alias("low"))
        lows[level] = distinct
        if below is None:
            full = distinct.select("*", *(F.lit(0).cast("long").alias(f"below_{c}") for c in ("children", "leaves", "saved")))
        else:
            hung = below.select(F.col("prefix").alias("hung"), *(F.col(c).alias(f"below_{c}") for c in ("children", "leaves", "saved")))
            full = distinct.join(hung, F.sha2(F.concat("prefix", "key"), 256) == F.col("hung"), "left").drop("hung").na.fill(0, ["below_children", "below_leaves", "below_saved"])
        parts = level_nodes(full.select(*(c.split()[0] for c in _SEQUENCE.split(", "))), chunk_sequences)
        opened = stored(merged_open(parts), "trie-open")
        below = opened.filter("depth = 0")
        nodes.append((level, parts, opened))
        ends.append(rows.filter("end").select(F.sha2(F.concat("prefix", "key"), 256).alias("sequence"), "conv_id"))
    done = None
    for level, parts, opened in nodes:
        if level:  # the root is the node above, which has members that end there too
            above = lows[level - 1].select(F.sha2(F.concat("prefix", "key"), 256).alias("prefix"), F.col("low").alias("above"))
            roots = opened.filter("depth = 0").join(above, "prefix").select(F.col("id").alias("up"), F.col("above").alias("up_low"))
            named = opened.filter("depth > 0").select(F.col("id").alias("up"), F.col("low").alias("up_low")).unionByName(roots)
        else:
            named = opened.select(F.col("id").alias("up"), F.col("low").alias("up_low"))
        columns = ["depth", "low", "n", "children", "leaves", "saved", "sequence", "parent_id"]
        closed = parts.filter("id is null")
        orphans = closed.filter("parent_id is not null").select(*columns).unionByName(opened.filter("depth > 0").select(*columns))
        small = opened.count() <= BROADCAST_NODES
        joined = orphans.join(F.broadcast(named) if small else named, F.col("parent_id") == F.col("up")).withColumnRenamed("up_low", "parent_low")
        some = joined.select(*columns, "parent_low").unionByName(closed.filter("parent_id is null").select(*columns, "parent_low"))
        if not level:
            some = some.unionByName(opened.filter("depth = 0").select(*columns, F.lit(None).cast("long").alias("parent_low")))
        some = some.withColumn("depth", F.col("depth").cast("long") + level * block)
        done = some if done is None else done.unionByName(some)
    names = {"low": "conv_id", "parent_low": "parent_conv_id", "n": "n_convs", "children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    listed = ends[0]
    for e in ends[1:]:
        listed = listed.unionByName(e)
    return done.drop("parent_id").withColumnsRenamed(names), listed


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, turns) of the query: each conversation c begins with the first h turns of c - c % 100 in place of its own.

    Turns are ordered by turn, nulls first, then by role and text. Null roles and texts are empty; rows without a conv_id
    are left out. Texts don't move: only their digests and lengths do.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), plain("role"), plain("text")).filter("conv_id is not null")
    rows = rows.withColumns(order_columns() | {"length": F.char_length("text").cast("long")}).drop("role", "text")
    own = stored(numbered(rows, "trie-turns").select("conv_id", "place", "who", "length"), "trie-numbered")
    h: Column = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    base = F.col("conv_id") - F.col("conv_id") % 100
    members = own.select("conv_id").distinct()
    heads = own.filter((F.col("conv_id") % 100 == 0) & (F.col("place") < 5)).select(F.col("conv_id").alias("base"), "place", "who", "length")
    known = stored(members.select("conv_id", base.alias("base"), h.alias("h")), "trie-members")
    first = known.join(heads, "base").filter("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "who", "length")
    sizes = heads.groupBy("base").agg(F.count(F.lit(1)).alias("size"))
    rest = own.filter(F.col("place") >= h).select("conv_id", base.alias("base"), (F.col("place") - h).alias("after"), h.alias("h"), "who", "length").join(sizes, "base", "left")
    rest = rest.select("conv_id", (F.col("after") + F.least("h", F.coalesce("size", F.lit(0))) + 1).alias("depth"), "who", "length")
    return known.select("conv_id"), first.unionByName(rest)


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt conversations. Lists of ids are made in pieces of up to 8192 ids before they are digested."""
    nodes, ends = prefix_trie(*rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    pieces = ends.groupBy("sequence", F.floor(F.col("conv_id") / PIECE_IDS).alias("nth")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    hashes = ordered_sha256(pieces, ["sequence"], ["nth"], "ids", ",").withColumnRenamed("sha256", "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    with_ends = nodes.filter("sequence is not null").join(hashes, "sequence").select(*columns)
    return with_ends.unionByName(nodes.filter("sequence is null").withColumn("ends_sha256", F.lit(EMPTY_SHA)).select(*columns))


def _oracle() -> str:
    from marshlight.llm.op11_repair import CRC_SQL

    return f"""
WITH RECURSIVE n AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY p) AS own FROM n GROUP BY conv_id),
h AS (SELECT *, {CRC_SQL.format(key="conv_id::VARCHAR")} % 6 AS h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS t FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 100),
x AS (SELECT conv_id, unnest(range(len(t) + 1)) AS depth, t FROM r),
m AS (SELECT conv_id, depth, t[1:depth] AS path, depth = len(t) AS ends FROM x),
v AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends, CASE WHEN depth > 0 THEN (count(*) - 1) * length(path[depth].text) ELSE 0 END AS w
  FROM m GROUP BY path, depth),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (path, depth)),
s AS (SELECT path[1:d] AS path, d AS depth, sum(w)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT path, w, n_children, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN s USING (path, depth) LEFT JOIN v p ON p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]"""


ORACLE = _oracle()
