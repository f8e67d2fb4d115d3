"""Operator 11: repair of conversations by lightest derivations (Knuth's agenda over weighted deductions)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.common import map_arrow, stored, table
from marshlight.llm.turns import in_order, order_columns, ordered_sha256

#: Rows and characters of a segment: a conversation of more is repaired in pieces, which are put together after that.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 2 << 20
#: Repeated turns that are broadcast to mark the later ones.
BROADCAST_SEEN = 200_000
BLANKS = " \t\n\x0b\x0c\r"
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

# What the roles so far may be followed by: nothing yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, GOALS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
#: The state after a turn of a role's initial, where that may come next.
_AFTER = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The state after a turn that was given a role: an assistant's behind a user's, else a user's.
_GIVEN = [USER, USER, ASSISTANT, USER]
_NAMES = {USER: "user", ASSISTANT: "assistant"}
FINE, TRUNCATED, BROKEN = range(3)  # BROKEN: blank or duplicate
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}


def fates(fault: int) -> list[tuple[int, str]]:
    """(cost, edit) of what may become of a row."""
    extra = int(fault == TRUNCATED)
    kept = [] if fault == BROKEN else [(COST[KEEP] + extra, KEEP), (COST[REROLE] + extra, REROLE)]
    return [*kept, (COST[DELETE], DELETE)]


def lightest(rows: Sequence[tuple[str, int]], start: int = START, goals: Sequence[int] | None = GOALS) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) of the items (all rows, state), from ``start``; with ``goals`` only that of the goal.

    Items are *prefixes* (so many rows are done, the roles so far end in a state) and *fates* (row i is kept, given a role
    or deleted). Deductions, each with the value of its conclusion:

        prefix(i, q)  fate(i, e)  =>  prefix(i + 1, q after e)     (cost of both, audit + e)
        prefix(i, q)              =>  prefix(i, q after a new turn) (cost + 2, audit + I)
        prefix(n, q), q a goal    =>  goal                          (the same)

    Values are compared by cost, then by audit; a fate's audit is empty. A conclusion is never less than any of its
    premises, as costs add up and the audit of the one that has one is extended; and it grows with each of them: of two
    derivations of one item with equal costs no audit begins the other, as they could differ by insertions only, which
    cost. So an item's value is final when the agenda gives it up, and the search ends when that is the goal.
    """
    n = len(rows)
    # an item is a number: prefix(i, q) is 4 i + q, the goal -1, the k-th fate of row i is -2 - (3 i + k)
    options = [fates(fault) for _, fault in rows]
    agenda: list[tuple[int, str, int]] = [(cost, "", -2 - (3 * i + k)) for i, o in enumerate(options) for k, (cost, _) in enumerate(o)]
    agenda.append((0, "", start))
    heapq.heapify(agenda)
    final: dict[int, tuple[int, str]] = {}
    open_fates: list[list[tuple[int, str]]] = [[] for _ in rows]
    found: dict[int, tuple[int, str]] = {}

    def conclude(i: int, q: int, cost: int, audit: str, fate: tuple[int, str]) -> None:
        edit = fate[1]
        to = q if edit == DELETE else _GIVEN[q] if edit == REROLE else _AFTER[q].get(rows[i][0])
        if to is not None and 4 * (i + 1) + to not in final:
            heapq.heappush(agenda, (cost + fate[0], audit + edit, 4 * (i + 1) + to))

    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item == -1:
            return {START: (cost, audit)}
        if item < 0:
            i, k = divmod(-2 - item, 3)
            open_fates[i].append(options[i][k])
            for q in STATES:
                if 4 * i + q in final:
                    conclude(i, q, *final[4 * i + q], options[i][k])
            continue
        if item in final:
            continue
        final[item] = cost, audit
        i, q = divmod(item, 4)
        if i == n:
            found[q] = cost, audit
            if goals is None and len(found) == len(STATES):
                break
            if goals is not None and q in goals:
                heapq.heappush(agenda, (cost, audit, -1))
        else:
            for fate in open_fates[i]:
                conclude(i, q, cost, audit, fate)
        if 4 * i + _GIVEN[q] not in final:
            heapq.heappush(agenda, (cost + COST[INSERT], audit + INSERT, 4 * i + _GIVEN[q]))
    return found


def replay(audit: str, turns: Sequence[tuple[str, str]], state: int = START) -> list[dict[str, str]]:
    """The repaired turns: the edits of ``audit`` applied from ``state`` on."""
    out, left = [], iter(turns)
    for edit in audit:
        role, text = ("", "") if edit == INSERT else next(left)
        if edit == DELETE:
            continue
        state = _AFTER[state][role[:1]] if edit == KEEP else _GIVEN[state]
        out.append({"role": role if edit == KEEP else _NAMES[state], "text": text})
    return out


_TURNS = "array<struct<role:string,text:string>>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long"
#: A segment. ``whole``: it is a conversation, and cost, audit and repaired are final; else ``moves`` has the lightest edits
#: between each two states, and ``turns`` is as it was.
SEGMENT = (
    f"conv_id long, task int, nth long, whole boolean, {_COUNTS}, first string, last string, low long, high long, distinct long, first_turn long, last_turn long, "
    f"cost long, audit string, repaired {_TURNS}, moves array<struct<p:int,q:int,cost:long,audit:string>>, turns {_TURNS}"
)
_STRUCT = pa.struct([("role", pa.string()), ("text", pa.string())])
_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("whole", pa.bool_()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.string()), ("last", pa.string()),
     *((n, pa.int64()) for n in ("low", "high", "distinct", "first_turn", "last_turn", "cost")), ("audit", pa.string()), ("repaired", pa.list_(_STRUCT)),
     ("moves", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("turns", pa.list_(_STRUCT))]
)


class _Segment:
    """Rows of one conversation, in order."""

    def __init__(self, conv_id: int | None, task: int, nth: int):
        self.of = {"conv_id": conv_id, "task": task, "nth": nth, "whole": False}
        self.rows: list[tuple[str, int]] = []
        self.turns: list[tuple[str, str]] = []
        self.chars, self.illegal, self.numbers, self.distinct = 0, 0, [], 0
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        self.illegal += bool(self.rows) and self.rows[-1][0] + initial not in ("su", "ua", "au")
        if fault:
            self.count[fault] += 1
        self.rows.append((initial, FINE if not fault else TRUNCATED if fault == "truncated" else BROKEN))
        self.turns.append((role, text))
        self.chars += len(role) + len(text)
        if turn is not None:
            self.distinct += not self.numbers or self.numbers[-1] != turn
            self.numbers = [self.numbers[0], turn] if self.numbers else [turn, turn]

    def close(self, whole: bool) -> dict:
        low, high = self.numbers or (None, None)
        first, last = (self.rows[0][0], self.rows[-1][0]) if self.rows else (None, None)
        out = self.of | self.count | {"illegal": self.illegal, "first": first, "last": last, "low": low, "high": high, "distinct": self.distinct, "first_turn": low, "last_turn": high}
        listed = [{"role": r, "text": t} for r, t in self.turns]
        if not whole:
            moves = [{"p": p, "q": q, "cost": c, "audit": a} for p in STATES for q, (c, a) in lightest(self.rows, p, None).items()]
            return out | {"cost": None, "audit": None, "repaired": None, "moves": moves, "turns": listed}
        cost, audit = lightest(self.rows)[START]
        return out | {"whole": True, "cost": cost, "audit": audit, "repaired": replay(audit, self.turns), "moves": None, "turns": None}


def _cut(rows_most: int, chars_most: int):  # noqa: ANN202
    """Rows in order to segments. A conversation that neither begins nor ends its task lies in it as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, now, begun, before, out = TaskContext.get().partitionId(), None, False, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "alive", "fault", "again"))
            for conv_id, turn, role, text, alive, fault, again in zip(*columns, strict=True):
                if now is None or conv_id != now.of["conv_id"]:
                    if now is not None:
                        out.append(now.close(whole=begun and not now.of["nth"]))
                        begun = True
                    now, before = _Segment(conv_id, task, 0), None
                if not alive:
                    continue
                if now.rows and (len(now.rows) >= rows_most or now.chars + len(text) > chars_most):
                    out.append(now.close(whole=False))
                    now = _Segment(conv_id, task, now.of["nth"] + 1)
                row = (turn, role, text)
                if fault != "blank" and (again or row == before):
                    fault = "duplicate"
                before = row
                now.add(turn, role, text, fault)
            yield pa.RecordBatch.from_pylist(out, _SEGMENT)
            out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.close(whole=False)], _SEGMENT)

    return run


class _Path:
    """The lightest edits of all segments so far into one state: the last segment's, and the path before it."""

    __slots__ = ("before", "cost", "piece", "state")

    def __init__(self, before: _Path | None, cost: int, piece: str, state: int):
        self.before, self.cost, self.piece, self.state = before, cost, piece, state

    def lighter(self, other: _Path) -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        mine, theirs, a, b = [], [], self, other
        while a is not b:  # both have as many segments
            mine.append(a.piece)
            theirs.append(b.piece)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


_FOLDED = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("nth", pa.int64()), ("state", pa.int32()), ("piece", pa.string()), ("end", pa.bool_()),
                     *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
FOLDED = f"conv_id long, task int, nth long, state int, piece string, end boolean, gaps long, {_COUNTS}, cost long, audit string"
_MOST = (1 << 63) - 1


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order: the edits of each that lie on its conversation's lightest path, and the conversation's sums with the last one.

    Held of a conversation: the edits (a letter a turn) of the paths that still may be the lightest, and no texts."""
    names = ("conv_id", "task", "nth", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "distinct", "first_turn", "last_turn", "moves")
    paths, held, sums = {}, [], {}

    def finish() -> list[dict]:
        best = None
        for q in GOALS:
            if q in paths and (best is None or paths[q].lighter(best)):
                best = paths[q]
        pieces, at = [], best
        while at.before is not None:
            pieces.append((at.before.state, at.piece))
            at = at.before
        pieces.reverse()
        gaps = min(sums["high"] - sums["low"] + 1 - sums["distinct"], _MOST) if sums["low"] is not None else 0
        total = {k: sums[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": best.cost, "audit": "".join(p for _, p in pieces)}
        return [dict(zip(("conv_id", "task", "nth"), h, strict=True), state=s, piece=p, end=k == len(held) - 1, **(total if k == len(held) - 1 else {})) for k, (h, (s, p)) in enumerate(zip(held, pieces, strict=True))]

    for batch in batches:
        out = []
        for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            s = dict(zip(names, values, strict=True))
            if not held or held[0][0] != s["conv_id"]:
                if held:
                    out += finish()
                paths, held = {START: _Path(None, 0, "", START)}, []
                sums = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "last": None, "low": None, "high": None, "distinct": 0, "last_turn": None}
            new: dict[int, _Path] = {}
            for m in s["moves"]:
                if m["p"] in paths:
                    path = _Path(paths[m["p"]], paths[m["p"]].cost + m["cost"], m["audit"], m["q"])
                    if m["q"] not in new or path.lighter(new[m["q"]]):
                        new[m["q"]] = path
            paths = new
            held.append((s["conv_id"], s["task"], s["nth"]))
            for k in ("blank", "duplicate", "truncated", "illegal"):
                sums[k] += s[k]
            if s["first"] is not None:
                sums["illegal"] += sums["last"] is not None and sums["last"] + s["first"] not in ("su", "ua", "au")
                sums["last"] = s["last"]
            if s["low"] is not None:
                sums["distinct"] += s["distinct"] - (sums["last_turn"] == s["first_turn"])
                sums["low"] = s["low"] if sums["low"] is None else sums["low"]
                sums["high"] = sums["last_turn"] = s["last_turn"]
        yield pa.RecordBatch.from_pylist(out, _FOLDED)
    if held:
        yield pa.RecordBatch.from_pylist(finish(), _FOLDED)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("piece", "turns", "state"))
        done = [replay(piece, [(t["role"], t["text"]) for t in turns], state) for piece, turns, state in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "task", "nth")), pa.array(done, pa.list_(_STRUCT))], names=["conv_id", "task", "nth", "repaired"])


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> tuple[DataFrame, DataFrame]:
    """Repair conversations (conv_id, turn, role, text, and alive: false for a row that is lost): (summary, repaired turns).

    Summary, a row a conv_id, of lost rows too: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired:
    conv_id, task, nth, whole, repaired (array of role and text), in this order; a conversation of at most ``segment_rows``
    rows and ``segment_chars`` characters that isn't cut by a task is one row (whole), others are several.

    Rows go by turn, nulls first, and of one turn by role and text (the first 64 characters, then a digest). A row's first
    fault counts: blank (nothing but blanks), duplicate (role and text were there before), truncated (the last character
    but blanks is no mark of ``.!?``). Null roles and texts count as one blank. Kept rows cost 0, another role 2, a deletion
    3 (it must be where a row is blank or a duplicate), an inserted empty turn 2, a truncated row that stays 1 more. What is
    left reads, in initials of roles, ``(s?(ua)+)?``. Of equal costs the least audit is chosen. Rows without a conv_id
    are one conversation. Other columns are ignored. An empty table gives empty results.

    A conversation may hold any share of the rows: its segments are repaired in their own tasks, between every two states,
    and only their edits (a letter a turn) are put together.
    """
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.coalesce(F.col("alive"), F.lit(True)).alias("alive"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    keyed = given.withColumns({"fault": fault} | order_columns())
    place = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    seen = keyed.filter("alive and not fault <=> 'blank'").groupBy("conv_id", "who").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = stored(seen.select(F.col("conv_id").alias("c"), F.col("who").alias("w"), "first"), "repair-seen")
    seen = F.broadcast(seen) if seen.count() <= BROADCAST_SEEN else seen  # else the texts are shuffled once more
    marked = keyed.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("who") == F.col("w")), "left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).drop("c", "w", "first")
    segments = stored(map_arrow(in_order(marked), _cut(segment_rows, segment_chars), SEGMENT), "repair-segments")
    whole, pieces = segments.filter("whole"), segments.filter("not whole")
    folded = pieces.drop("turns", "repaired").repartition("conv_id").sortWithinPartitions("conv_id", "task", "nth")
    folded = stored(map_arrow(folded, _fold, FOLDED), "repair-folded")
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.least((F.col("high").cast("decimal(20)") - F.col("low") + 1 - F.col("distinct")), F.lit(_MOST).cast("decimal(20)"))).cast("long")
    summary = whole.withColumn("gaps", gaps).select(*columns).unionByName(folded.filter("end").select(*columns))
    chosen = folded.select(F.col("conv_id").alias("c"), F.col("task").alias("k"), F.col("nth").alias("i"), "state", "piece")
    joined = pieces.join(chosen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("k")) & (F.col("nth") == F.col("i"))).select("conv_id", "task", "nth", "state", "piece", "turns")
    in_pieces = map_arrow(joined, _replay, f"conv_id long, task int, nth long, repaired {_TURNS}").withColumn("whole", F.lit(False))
    return summary, whole.select("conv_id", "task", "nth", "whole", "repaired").unionByName(in_pieces)


def damaged(rows: DataFrame) -> DataFrame:
    """The query's rows with faults planted by the remainder of crc32(`conv_id:turn`) by 20: 0 is lost (alive is false), 1 has no
    text, 2 no marks, 3 comes twice, 4 is the user's. Nulls are one blank."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.pmod(F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")), F.lit(20))
    text = F.when(k == 1, "").when(k == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    role = F.when(k == 4, "user").otherwise(plain("role"))
    copies = F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (k != 0).alias("alive"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, damaged and repaired; of those in several pieces the digest is made piece by piece."""
    summary, repaired = repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    joined = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    lines = repaired.filter(F.size("repaired") > 0).select("conv_id", "task", "nth", "whole", joined.alias("lines"))
    alone = lines.filter("whole").select("conv_id", F.sha2("lines", 256).alias("sha256"))
    hashes = alone.unionByName(ordered_sha256(lines.filter("not whole"), ["conv_id"], ["task", "nth"], "lines", "\n")).withColumnRenamed("conv_id", "c")
    joined = summary.join(hashes, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


#: crc32 of a short ASCII text, bit by bit.
CRC_SQL = """xor(list_reduce(list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""


def _oracle() -> str:
    """The rows of the four states (nothing yet, system, user, assistant) are carried from turn to turn: the edits' cost, their
    initials, and the repaired lines that these give."""

    def move(p: int, cost: str, edit: str, line: str | None) -> str:
        return f"CASE WHEN v[{p}] IS NOT NULL THEN {{'c': v[{p}].c + {cost}, 'a': v[{p}].a || '{edit}', 'r': v[{p}].r" + (f" || chr(10) || {line}" if line else "") + "} END"

    def kept(p: int, initial: str) -> str:
        return f"CASE WHEN ok AND i = '{initial}' THEN {move(p, 't', 'K', 'role || chr(58) || text')} END"

    def given(p: int, name: str) -> str:
        return f"CASE WHEN ok THEN {move(p, '2 + t', 'R', chr(39) + name + ':' + chr(39) + ' || text')} END"

    least = lambda options: f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"
    after = [
        [move(1, "3", "D", None)],
        [move(2, "3", "D", None), kept(1, "s")],
        [move(3, "3", "D", None), *(kept(p, "u") for p in (1, 2, 4)), *(given(p, "user") for p in (1, 2, 4))],
        [move(4, "3", "D", None), kept(3, "a"), given(3, "assistant")],
    ]
    user = f"[v[1], v[2], {least(['v[3]', *(move(p, '2', 'I', chr(39) + 'user:' + chr(39)) for p in (1, 2, 4))])}, v[4]]"
    assistant = f"[v[1], v[2], v[3], {least(['v[4]', move(3, '2', 'I', chr(39) + 'assistant:' + chr(39))])}]"
    state = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)[]"
    return f"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC_SQL.format(key="coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM g WHERE k <> 0),
n AS (SELECT *, substr(role, 1, 1) AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS nth,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM d),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 THEN 'duplicate' WHEN substr(e, -1, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(i) OVER (PARTITION BY conv_id ORDER BY nth) AS p FROM n),
x AS (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS ok, (coalesce(fault, '') = 'truncated')::INT AS t FROM f),
w AS (SELECT conv_id, 0::BIGINT AS nth, {assistant.replace("v[", "u[")} AS v FROM (SELECT conv_id, {user.replace("v[", "s[")} AS u FROM (SELECT DISTINCT conv_id, [{{'c': 0, 'a': '', 'r': ''}}, NULL, NULL, NULL]::{state} AS s FROM conversations))
  UNION ALL SELECT conv_id, nth, {assistant.replace("v[", "u[")}::{state} FROM (SELECT conv_id, nth, {user.replace("v[", "s[")} AS u FROM (
    SELECT w.conv_id, x.nth, [{", ".join(map(least, after))}] AS s FROM w JOIN x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND x.nth = w.nth + 1))),
z AS (SELECT conv_id, arg_max(list_min(list_filter([v[1], v[4]], lambda x: x IS NOT NULL)), nth) AS b FROM w GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || i NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.c AS cost, b.a AS audit,
  sha256(substr(b.r, 2)) AS repaired_sha256 FROM z LEFT JOIN s ON z.conv_id IS NOT DISTINCT FROM s.conv_id"""


ORACLE = _oracle()
