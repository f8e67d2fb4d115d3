"""Exact dedup, near dedup and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marshlight.llm import op1_line_dedup as lines
from marshlight.llm import op2_near_dedup as near
from marshlight.llm import op7_exact_dedup as exact
from marshlight.llm.components import components

from llm_cases import LINES, ROWS

LOWER = {c: c + 32 for c in range(65, 91)}


def near_brute(texts, size, similarity=80):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_families(spark, size):
    """Families of copies with more and more edits, so that many pairs lie close to the threshold."""
    random.seed(size)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, n = {}, 0
    for family in range(6):
        base = random.choices(vocabulary, k=random.choice([12, 60, 200]))
        for _ in range(30):
            words = list(base)
            for _ in range(random.randint(0, max(1, len(base) // (5 * size)))):
                at = random.randrange(len(words))
                words[at : at + random.choice([0, 1, 1])] = [random.choice(vocabulary)] * random.choice([0, 1, 1])
            texts[n] = " ".join(words)
            n += 1
    rows = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle_words=size).collect()
    want = near_brute(texts, size)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_query(spark, tmp_path):
    """The registered query on long texts near the threshold, where the estimate drops pairs, against brute force."""
    random.seed(21)
    vocabulary, texts, n = [f"w{i}" for i in range(9000)], {}, 0
    for _ in range(5):
        base = random.choices(vocabulary, k=random.choice([300, 800, 2000]))
        for share in (0, 0.02, 0.05, 0.06, 0.08, 0.1, 0.11, 0.12, 0.13, 0.2, 0.4):
            texts[n] = " ".join(random.choice(vocabulary) if random.random() < share else w for w in base)
            n += 1
    texts |= {n + k: t for k, t in enumerate(["", None, "one", "ONE", "Two words", "two  words"])}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = near.op2_near_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_brute(texts, 2)


def test_near_hub(spark, monkeypatch):
    """A centre whose members are dealt to several tasks."""
    monkeypatch.setattr(near, "MEMBERS", 7)
    random.seed(22)
    base = random.choices([f"w{i}" for i in range(500)], k=80)
    texts = {0: " ".join(base)} | {i: " ".join(base[:-1] + [f"v{i}"]) for i in range(1, 90)}
    rows = near.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == near_brute(texts, 5)


def test_near_edges(spark, docs, no_docs):
    rows = defaultdict(list)
    for r in near.near_duplicates(docs, shingle_words=2).collect():
        rows[r.doc_id].append(r)
    assert [(r.n_shingles, r.component_id, r.kept) for i in (1, 2, 3) for r in rows[i]] == [(0, i, True) for i in (1, 2, 3)]
    assert [(r.component_id, r.kept) for i in (4, 5, 6, 7) for r in rows[i]] == [(4, True)] + [(4, False)] * 4
    assert [(r.component_id, r.kept) for r in rows[None]] == [(4, False)]
    assert rows[8][0].n_shingles == 1 and rows[8][0].component_id == 8
    assert near.near_duplicates(no_docs).count() == 0


def test_registers_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**64, 6000, dtype=np.uint64)
    for shared in (0, 2000, 3600):
        a, b = np.sort(pool[:4000]), np.sort(np.append(pool[4000 - shared : 4000], pool[4000 : 8000 - shared]))
        r = near.registers(np.concatenate([a, b]), np.array([len(a), len(b)]))
        estimate = near.estimated_jaccard(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(estimate - shared / (len(a) + len(b) - shared)) < 0.15


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


@pytest.mark.parametrize("split", ["doc_id % 2 = 0", "doc_id < 5", "1 = 0", "1 = 1"])
def test_exact(spark, docs, split):
    mine = F.coalesce(F.expr(split), F.lit(False))
    rows = exact.exact_dedup(docs.filter(mine), docs.filter(~mine)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in rows) == exact_brute([r[:2] for r in ROWS])
    assert_one_kept(rows)


def assert_one_kept(rows):
    """Of each group one row stays, and it has the group's largest id, if there is one."""
    kept = [r for r in rows if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({r.text_sha256 for r in rows})


def test_exact_repeated_ids(spark):
    """Equal rows of one doc_id, on one side of the index or on both, and groups without any id."""
    rows = [(7, "same")] * 5 + [(7, "other"), (6, "same")] + [(None, "none")] * 4
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int").repartition(3)
    for split in ("k % 2 = 0", "1 = 0", "1 = 1", "k < 3"):
        got = exact.exact_dedup(docs.filter(split), docs.filter(f"not ({split})")).collect()
        assert len(got) == len(rows) and sum(r.kept for r in got) == 3
        assert_one_kept(got)


def test_exact_of_any_ids(spark):
    """Negative ids, ids beyond the whole numbers of a double, zero and null, on both sides of the index."""
    big = 2**62 + 1
    rows = [(-1, "a"), (-3, "A"), (None, "a"), (big, "b"), (big - 1, "b"), (None, "c"), (None, "c"), (0, "d"), (None, "d"), (-5, "e"), (-(2**63), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for split in ("doc_id in (-1, 0)", "doc_id is null", "doc_id < 0", "doc_id % 2 = 0"):
        mine = F.coalesce(F.expr(split), F.lit(False))
        got = exact.exact_dedup(docs.filter(mine), docs.filter(~mine)).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == exact_brute(rows), split
        assert_one_kept(got)


def test_exact_query(spark, tmp_path):
    random.seed(8)
    rows = [(i, random.choice(["x", "X", "y z", "", None, f"own {i}"])) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = exact.op7_exact_dedup(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == exact_brute(rows)


def test_exact_empty(spark, no_docs):
    assert exact.exact_dedup(no_docs, no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2, 1000, 30_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    sizes, bits, rest = exact.build_hash(digests)
    assert sorted(exact.slots(digests, sizes, bits, rest).tolist()) == list(range(n))
    other = exact.slots(rng.integers(0, 256, (n, 32), dtype=np.uint8), sizes, bits, rest)
    assert (other < n).all()


def lines_brute(rows, stable=False):
    seen, out = set(), []
    for i, t in sorted(rows, key=(lambda r: r[0]) if stable else None):
        own = t.split("\n")
        gone = set()
        for k in range(len(own) - 2):
            window = tuple(own[k : k + 3])
            if window != ("", "", "") and window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out.append((i, len(own), len(gone), "\n".join(x for k, x in enumerate(own) if k not in gone)))
    return out


def test_lines_random(spark):
    random.seed(6)
    rows = [(i, "\n".join(random.choices("abc", k=random.randint(0, 12)))) for i in range(150)]
    rows += [(200 + i, "\n" * i) for i in range(6)]
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == lines_brute(rows)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_lines_of_rows_that_share_an_id(spark, monkeypatch, most):
    """Different texts of different lengths under one doc_id: each loses what is repeated, and nothing else."""
    monkeypatch.setattr(lines, "BROADCAST_PLACES", most)
    random.seed(16)
    rows = [(random.randrange(12), "\n".join(random.choices("abcd", k=random.randint(0, 9)))) for _ in range(120)]
    rows += [(1, "a\nb\nc"), (5, "a\nb\nc"), (5, "x\ny\nz\nw"), (5, "p\nq"), (5, "x\ny\nz\nw")]
    rows.sort(key=lambda r: r[0])  # Spark reads them in this order
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumn("row", F.lit("mine"))
    got = lines.line_dedup(docs).collect()
    assert all(r["row"] == "mine" for r in got)
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.text) for r in got) == sorted(lines_brute(rows, stable=True))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_lines_by_broadcast_and_by_shuffle(spark, docs, monkeypatch, most):
    monkeypatch.setattr(lines, "BROADCAST_PLACES", most)
    rows = [r for r in lines.line_dedup(docs.filter("doc_id in (4, 5, 7)")).collect()]
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(4, 0), (5, 4), (5, 4), (7, 4)]


def test_lines_edges(spark, docs, no_docs):
    docs = docs.withColumns({"removed_doc": F.lit("mine"), "_removed": F.lit("too")})
    rows = lines.line_dedup(docs).collect()
    assert all((r["removed"], r["_removed"], r["removed_doc"]) == (1, "too", "mine") for r in rows)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert len(rows) == len(ROWS) and "lang" in rows[0].asDict()
    assert by_id[1][0].text is None and by_id[1][0].n_lines == 0
    assert by_id[2][0].text == "" and by_id[4][0].text == LINES and by_id[None][0].text == LINES
    assert [r.text for r in by_id[5]] == ["", ""] and by_id[7][0].text == "thirteen fourteen"
    assert lines.line_dedup(no_docs).count() == 0
