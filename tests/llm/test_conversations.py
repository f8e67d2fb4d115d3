"""Repair of conversations and their prefix trie against brute force, and languages on held-out texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marshlight.llm import op11_repair as repair
from marshlight.llm import op12_trie as trie
from marshlight.llm import op13_language as language
from marshlight.llm.turns import in_order, numbered, order_columns, ordered_sha256

SCHEMA = "conv_id long, turn long, role string, text string"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def least_edits(rows):
    """Cheapest (cost, audit, turns) by dynamic programming over all edits; rows: (role, text, must be deleted, truncated)."""
    state = {"": (0, "", ())}  # roles so far end in: nothing, s, u, a

    def add(best, key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    def follow(last, initial):
        return initial if initial and initial in {"": "su", "s": "u", "u": "a", "a": "u"}[last] else None

    def insertions(best):
        for _ in range(3):
            for last, (c, a, t) in list(best.items()):
                for role in ("user", "assistant"):
                    if follow(last, role[0]):
                        add(best, role[0], (c + 2, a + "I", (*t, (role, ""))))
        return best

    state = insertions(state)
    for role, text, broken, cut in rows:
        after = {}
        for last, (c, a, t) in state.items():
            add(after, last, (c + 3, a + "D", t))
            if not broken:
                if follow(last, role[:1]):
                    add(after, role[:1], (c + cut, a + "K", (*t, (role, text))))
                for other in ("user", "assistant"):
                    if follow(last, other[0]):
                        add(after, other[0], (c + 2 + cut, a + "R", (*t, (other, text))))
        state = insertions(after)
    return min(state[k] for k in ("", "a") if k in state)


def repair_brute(table):
    convs = defaultdict(list)
    for c, turn, role, text in table:
        convs[c].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for c, given in convs.items():
        rows = []
        given.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        for turn, role, text in given:
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k:
                row = (turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
                rows += [row] * (2 if k == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in rows:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, fixed = least_edits([(r, x, f in ("blank", "duplicate"), int(f == "truncated")) for (_, r, x), f in zip(rows, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *counts, illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in fixed))))
    return sorted(out, key=str)


def talk(n, seed, turns):
    random.seed(seed)
    texts = ["Yes.", "No!", "Why?", "well", "", " \n", "so it is", "A. B.", "Long text " * 20, "ok ", "Fine. "]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown", "admin"]
    out = []
    for c in range(n):
        for t in range(random.randint(1, turns)):
            role = ("user", "assistant")[t % 2] if random.random() < 0.7 else random.choice(roles)
            out.append((c, t if random.random() < 0.95 else random.choice([None, t * 3, -2]), role, random.choice(texts) if random.random() < 0.8 else None if random.random() < 0.2 else f"Turn {t}."))
    return out


@pytest.mark.parametrize(("segment", "tasks"), [(1024, 4), (3, 7)])
def test_repair(spark, monkeypatch, segment, tasks):
    """Whole conversations, and ones in pieces of one or three rows that lie in several tasks."""
    monkeypatch.setattr(repair, "in_order", lambda rows: in_order(rows, tasks))
    monkeypatch.setattr(repair, "BROADCAST_SEEN", 200_000 if segment == 3 else 0)
    rows = talk(60, segment, 9) + talk(1, 99, 60) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (70, None, None, None), (71, 5, "user", "x" * 5000)]
    rows = list(dict.fromkeys(rows))
    table = repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(3))
    summary, repaired = repair.repair(table, segment_rows=segment)
    lines = defaultdict(list)
    for r in sorted(repaired.collect(), key=lambda r: (r.task, r.nth)):
        lines[r.conv_id] += [f"{t.role}:{t.text}" for t in r.repaired]
    got = sorted(((*r, sha("\n".join(lines[r.conv_id]))) for r in summary.collect()), key=str)
    assert got == repair_brute(rows)


def test_repair_query(spark, tmp_path):
    rows = talk(40, 5, 8) + [(50, k, "user", f"Row {k}.") for k in range(300)]
    spark.createDataFrame(rows, SCHEMA).withColumn("fault", F.lit("mine")).withColumn("cost", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == repair_brute(rows)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert repair.op11_repair(spark, str(tmp_path)).count() == 0


def test_agenda_equals_dynamic_programming():
    """Random rows: the goal's value, and from other states the values into every state."""
    random.seed(4)
    for _ in range(400):
        rows = [(random.choice(["s", "u", "a", "t", ""]), random.randrange(3)) for _ in range(random.randint(0, 7))]
        want = least_edits([(i, "", f == repair.BROKEN, int(f == repair.TRUNCATED)) for i, f in rows])
        assert repair.lightest(rows)[repair.START] == want[:2]
        split = random.randint(0, len(rows))
        first, last = repair.lightest(rows[:split], repair.START, None), {p: repair.lightest(rows[split:], p, None) for p in repair.STATES}
        joined = [(c + d, a + b) for p, (c, a) in first.items() for q, (d, b) in last[p].items() if q in repair.GOALS]
        assert min(joined) == want[:2]


def test_places_in_hot_conversations(spark):
    """One conversation with most of the rows lies in many tasks and is numbered through."""
    rows = [(7, k // 2, "user", f"t{k}") for k in range(3000)] + [(c, k, "user", "x") for c in range(20, 220) for k in range(3)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns(order_columns()).repartition(5)
    got = numbered(table.drop("role"), "places").select("conv_id", "turn", "text", "place").collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append((r.place, r.turn, r.text))
    assert all([p for p, _, _ in sorted(v)] == list(range(len(v))) for v in by.values()) and len(got) == len(rows)
    assert [t for _, t, _ in sorted(by[7])] == sorted(k // 2 for k in range(3000))


def test_digests_in_order(spark):
    pieces = spark.createDataFrame([(k % 3, k, f"p{k}") for k in range(50)] + [(None, 1, "x"), (None, 2, "")], "k long, n long, t string").repartition(4)
    got = {r.k: r.sha256 for r in ordered_sha256(pieces, ["k"], ["n"], "t", "|").collect()}
    assert got == {k: sha("|".join(f"p{i}" for i in range(50) if i % 3 == k)) for k in range(3)} | {None: sha("x|")}


def trie_brute(sequences):
    """Rows of nodes from {conv_id: list of (text, length)}."""
    nodes = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[p]) - 1) * p[-1][1] if p else 0
        saved[p] = own + sum(saved[c] for c in children[p])
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
    ends = {p: ",".join(map(str, sorted(c for c in cs if len(sequences[c]) == len(p)))) for p, cs in nodes.items()}
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children[p]), leaves[p], saved[p], sha(ends[p])) for p, cs in nodes.items())


@pytest.mark.parametrize(("block", "chunk"), [(4096, 1), (4096, 5), (3, 4)])
def test_trie(spark, block, chunk):
    """Forests of few sequences, whose boundaries cut most nodes, and conversations in blocks of one to three turns."""
    random.seed(block + chunk)
    sequences = {c: [(random.choice("ab" if random.random() < 0.9 else "abcdef"), 0) for _ in range(random.randint(0, 7))] for c in range(150)}
    sequences |= {c: sequences[c % 5] for c in range(150, 220)} | {300: [("a", 0)] * 10, 301: [("a", 0)] * 8 + [("b", 0)], -4: []}
    sequences = {c: [(t, ord(t)) for t, _ in s] for c, s in sequences.items()}
    turns = [(c, d + 1, sha(t), n) for c, s in sequences.items() for d, (t, n) in enumerate(s)]
    members = spark.createDataFrame([(c,) for c in sequences], "conv_id long")
    nodes, ends = trie.prefix_trie(members, spark.createDataFrame(turns, "conv_id long, depth long, who string, length long"), block, chunk)
    listed = defaultdict(list)
    for r in ends.collect():
        listed[r.sequence].append(r.conv_id)
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sha(",".join(map(str, sorted(listed[r.sequence]))) if r.sequence else "")) for r in nodes.collect()]
    assert sorted(got) == trie_brute(sequences)


def rebuilt_brute(table):
    convs = defaultdict(list)
    for c, turn, role, text in table:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(c - int(c / 100) * 100), [])
        out[c] = [((r, x), len(x)) for r, x in base[:h] + turns[h:]]
    return out


def test_trie_query(spark, tmp_path):
    rows = talk(130, 3, 8) + [(c, k, "user", "Same.") for c in range(200, 330) for k in range(c % 7)] + [(500, k, "user", f"t{k % 3}") for k in range(90)] + [(c, 0, "user", "x") for c in (705, 731, 1799)]
    rows += [(None, 1, "user", "lost"), (-7, 1, None, "é😀"), (-107, None, "user", None)]
    rows = list(dict.fromkeys(rows))
    spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "who": F.lit("x"), "length": F.lit("y")}).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = trie.op12_trie(spark, str(tmp_path))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(trie_brute(rebuilt_brute(rows)), key=str)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert trie.op12_trie(spark, str(tmp_path)).count() == 0


SYLLABLES = {"en": "the th ing ed er and on re".split(), "de": "der die sch ung ein ich keit ö".split(), "fr": "le la é eau eux tion ou ç".split()}


def speech(lang, words):
    return " ".join("".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4))) for _ in range(words))


def test_language_query(spark, tmp_path):
    """Held-out texts of all lengths; the held-out labels are wrong on purpose and must not matter, nor do other columns."""
    random.seed(13)
    rows = []
    for i in range(900):
        lang = random.choice(list(SYLLABLES))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        rows.append((i, speech(lang, random.choice([4, 30, 200])), "xx" if held else lang, lang))
    rows += [(2000, None, "en", None), (2001, "", "en", None), (2002, "12 + 34 = 46 !!", "fr", None), (2003, "日本語", None, None), (2004, "the " * 40_000, None, "en"), (None, speech("de", 50), "de", "de"), (3, rows[3][1], rows[3][2], rows[3][3])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("score", F.lit("mine")).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op13_language(spark, str(tmp_path)).collect()
    truth = {i: t for i, _, _, t in rows}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (2000, 2001, 2002)} == {i: ("und", 0.0) for i in (2000, 2001, 2002)}
    assert {r.lang_pred for r in got} == {"und", *SYLLABLES}
    known = [r for r in got if truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in known]) > 0.97
    none = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    none.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in language.op13_language(spark, str(tmp_path)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    none.filter("1 = 0").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert language.op13_language(spark, str(tmp_path)).count() == 0


def test_filters_of_many_languages(spark):
    """More languages than bits of a word; each filter holds all n-grams that it was given, and false ones about as often as said."""
    random.seed(2)
    words = {f"l{k:03}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}q{w}" for w in "abcdefghij"] for k in range(80)}
    docs = spark.createDataFrame([(" ".join(random.choices(v, k=60)), k) for k, v in words.items() for _ in range(2)], "text string, lang string")
    filters = language.fit(docs)
    assert filters.languages == sorted(words) and len(filters.planes) == 2
    texts = pa.array([" ".join(v) for v in words.values()], pa.string())
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts.to_pylist()]))
    number, score = filters.predict(data, offsets)
    assert [filters.languages[k] for k in number] == list(words) and (score > 0.03).all()


def test_language_counts_and_slots(spark):
    """Counted n-grams against plain Python, and every chosen one is found in its language's filter."""
    texts = [("en", "The cat, the CAT sat"), ("en", "cat"), ("fr", "É été"), ("fr", None), (None, "zz")]
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string")
    want = defaultdict(int)
    for lang, t in texts:
        if lang and t:
            plain = "".join(c if c.isalpha() else " " for c in t.lower()).encode()
            for w in set(plain.split()):
                w = b" " + w + b" "
                for n in language.SIZES:
                    for k in range(len(w) - n + 1):
                        want[lang, int.from_bytes(bytes([n]) + w[k : k + n], "big")] += 1
    known = docs.filter("lang is not null and text is not null")
    got = known.mapInArrow(language._count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("gram > 0").collect()
    assert {(r.lang, r.gram): r.n for r in got} == dict(want)
    filters = language.fit(docs)
    for (lang, gram), _ in want.items():
        found = filters.hits(np.array([gram], np.uint64), np.array([0]), 1)[0]
        others = [want.get((other, gram), 0) for other in ("en", "fr")]
        if want[lang, gram] == max(others):
            assert found[filters.languages.index(lang)] == 1
