"""The classifiers on planted cases, the search against brute force, the shard store, and the pipeline."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from marshlight.llm import op4_sharding as sharding
from marshlight.llm import op5_toxicity as toxicity
from marshlight.llm import op6_quality as quality
from marshlight.llm import op8_top_k as search
from marshlight.llm.common import scratch_dir, text_chunks

from llm_cases import ROWS

SYLLABLES = ["er", "an", "the", "on", "ti", "re", "st", "ing", "ou", "ed", "ly", "ha"]
INSULTS = ["fathead", "dimwit", "numbskull"]


def prose(n):
    return " ".join("".join(random.choices(SYLLABLES, k=random.randint(1, 3))) for _ in range(n))


def toxic_corpus(n, seed):
    random.seed(seed)
    texts, y = [], []
    for k in range(n):
        words = prose(40).split()
        if k % 4 == 0:
            words[random.randrange(40)] = random.choice(INSULTS)
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    return texts, np.array(y)


def on(texts, y):
    """The training's steps over these texts, as Spark would run them."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(y, pa.int32())], names=["text", "y"])

    def run(step, schema, least=None):
        empty = pa.schema([tuple(f.split()) for f in schema.replace("long", "int64").split(", ")]) if least else None
        rows = pa.Table.from_batches(list(step(iter([batch]))), empty)
        if least is None:
            return rows
        rows = rows.group_by("run").aggregate([("n", "sum")]).rename_columns(["run", "n"])
        return rows.filter(pc.greater_equal(rows.column("n"), least))

    return run


def decisions(model, texts):
    return np.concatenate([model.probability(model.texts(d, o)) for _, _, d, o in text_chunks(pa.array(texts, pa.string()))])


@pytest.fixture(scope="module")
def toxic_model():
    return toxicity.train(on(*toxic_corpus(800, 1)))


def test_toxic_held_out(toxic_model):
    texts, y = toxic_corpus(400, 2)
    p = decisions(toxic_model, texts) >= toxicity.THRESHOLD
    assert (p == y).mean() > 0.97


def test_toxic_spellings(toxic_model):
    """Inserted marks, blanks between letters and an inserted letter are still found; clean text isn't."""
    random.seed(3)
    clean = [prose(30) for _ in range(20)]
    for spelled in ("d-i-m-w-i-t", "d i m w i t", "DIMWIT!", "numbxskull", "fat.head"):
        assert decisions(toxic_model, [f"{prose(10)} {spelled} {prose(10)}"])[0] > max(decisions(toxic_model, clean)), spelled


def test_toxic_in_long_runs(toxic_model):
    """An insult in a run without blanks is found at every place of it, and between marks; runs without one are clean."""
    random.seed(4)
    run = "".join(random.choices(SYLLABLES, k=60))[:90]
    for insult in INSULTS:
        for at in range(61):
            for text in (run[:at] + insult + run[at:], " ".join(run[:at] + insult + run[at:])):
                assert decisions(toxic_model, [text])[0] >= toxicity.THRESHOLD, (insult, at)
    for text in (f"{'word,' * 9}dimwit|word_word", f"{'日本語' * 12}dimwit{'日本語' * 12}"):
        assert decisions(toxic_model, [text])[0] >= toxicity.THRESHOLD, text
    assert max(decisions(toxic_model, [run, "word," * 30, "日本語" * 30, " ".join(run)])) < toxicity.THRESHOLD


def test_toxic_gaps(toxic_model):
    """A blank at any place in an insult, or several, with short parts beside it."""
    random.seed(5)
    spelled = [f"{w[:k]} {w[k:]}" for w in ("dimwit", "fathead") for k in range(1, len(w))] + ["numbsk ull", "numb skull", "nu mbskull", "di mw it", "fat he ad"]
    for gapped in spelled:
        assert decisions(toxic_model, [f"{prose(10)} {gapped} {prose(10)}"])[0] >= toxicity.THRESHOLD, gapped


def span_units(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return toxicity.units(data, np.array([0, len(data)]))


def alone(model, symbols):
    """The decision of a unit by the explicit feature map."""
    n = np.array([len(symbols)])
    matrix, lengths = toxicity.unit_matrix(np.array(symbols, np.uint32), np.array([0]), n)
    total = sum((w * value.sum() for _, key, w in toxicity.subsequences(matrix, lengths) for _, value in [model.table.find(key)]), 0.0)
    return total / toxicity.norms(n)[0] + model.offset


def test_units_are_words_and_phrases():
    u = span_units("A piece, of trash! d i m w i t")
    got = {"".join(map(chr, u.symbols[a:b])).replace(chr(toxicity.MARK), "_") for a, b in zip(u.begin, u.end, strict=True)}
    assert {"_a_", "_piece_", "_piece_of_trash_", "_of_trash_dimwit_", "_dimwit_"} <= got and "_dimwit_a_" not in got
    assert u.is_word.sum() == 5


def test_phrases_are_learnt():
    """An insult of three words that clean texts have one by one."""
    random.seed(6)
    parts, texts, y = ["piece", "made", "junk"], [], []
    for k in range(600):
        words = prose(40).split()
        for p in parts:  # apart from each other
            words.insert(random.randrange(13) + 14 * parts.index(p), p)
        if k % 4 == 0:
            words[20:20] = parts
        texts.append(" ".join(words))
        y.append(int(k % 4 == 0))
    model = toxicity.train(on(texts[:400], np.array(y[:400])))
    p = decisions(model, texts[400:]) >= toxicity.THRESHOLD
    assert (p == np.array(y[400:])).mean() > 0.9


def test_texts_equal_units_alone(toxic_model):
    """The running sums over a chunk of texts give each unit's own decision, and a text gets its worst unit's."""
    random.seed(7)
    for text in ("the numb skull of st up id", f"{prose(30)} dimwit", "日本語 é 12 x"):
        u = span_units(text)
        want = [alone(toxic_model, u.symbols[a:b]) for a, b in zip(u.begin, u.end, strict=True)]
        assert np.allclose(toxic_model.values(u), want)
    texts = [prose(random.randint(0, 60)) for _ in range(40)]
    together = np.concatenate([toxic_model.texts(d, o) for _, _, d, o in text_chunks(pa.array(texts, pa.string()), 700)])
    apart = [toxic_model.texts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, apart)


def test_parts_equal_units(toxic_model):
    """The worst part of a long word has the decision of that part as a word of its own."""
    u = span_units("theredimwitonthealsonumbskulltheston")
    begin, end, _ = u.pieces
    assert (end - begin).tolist() == [30, 30]
    for a, b in zip(begin, end, strict=True):
        row = u.symbols[a:b]
        own = [alone(toxic_model, [toxicity.MARK, *row[k : k + n], toxicity.MARK]) for n in toxicity.PARTS for k in range(31 - n)]
        assert np.isclose(toxic_model.parts(u.symbols, np.array([a]), np.array([b]))[0], max(own))


def kernel_brute(s, t):
    """The subsequence kernel by dynamic programming over the places and spans of common subsequences, normalised."""

    def plain(s, t):
        total = 0.0
        for order, most in toxicity.ORDERS.items():
            ends = {(i, j, 1, 1): 1.0 for i in range(len(s)) for j in range(len(t)) if s[i] == t[j]}
            for _ in range(order - 1):
                longer = {}
                for (i, j, a, b), ways in ends.items():
                    for x in range(1, most - a + 1):
                        for y in range(1, most - b + 1):
                            if i + x < len(s) and j + y < len(t) and s[i + x] == t[j + y]:
                                key = (i + x, j + y, a + x, b + y)
                                longer[key] = longer.get(key, 0) + ways
                ends = longer
            total += sum(ways * toxicity.DECAY ** (a + b) for (_, _, a, b), ways in ends.items())
        return total

    own = lambda s: sum(max(len(s) - p[-1], 0) * toxicity.DECAY ** (2 * (p[-1] + 1)) for p in toxicity._PATTERNS)
    return plain(s, t) / np.sqrt(own(s) * own(t))


def test_kernel_equals_dynamic_programming():
    words = ["dimwit", "dimxwit", "numbskull", "reading", "dim wit"]
    units = [[toxicity.MARK, *(toxicity.MARK if c == " " else ord(c) for c in w), toxicity.MARK] for w in words]
    end = np.cumsum([len(u) for u in units])
    matrix, lengths = toxicity.unit_matrix(np.concatenate(units).astype(np.uint32), end - [len(u) for u in units], end)
    got = toxicity._kernel_columns(matrix, lengths, *toxicity._landmark_table(matrix, lengths))
    assert np.allclose(got, [[kernel_brute(a, b) for b in units] for a in units])
    assert got[0, 1] > 0.3 > got[0, 3]  # an inserted letter is forgiven


def test_weights_are_found():
    rng = np.random.default_rng(3)
    features, weights = rng.integers(0, 2**64, 60_000, dtype=np.uint64), rng.normal(size=60_000)
    table = toxicity.Weights(features, weights)
    at, value = table.find(np.concatenate([rng.integers(0, 2**64, 1000, dtype=np.uint64), features]))
    assert at.tolist() == list(range(1000, 61_000)) and np.array_equal(value, weights)


def test_toxic_edges(spark, docs, no_docs, toxic_model):
    rows = toxicity.score(docs, toxic_model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score(no_docs, toxic_model).count() == 0
    one_class = toxicity.train(on(["a b", "c"], np.array([0, 0])))
    assert 0 < decisions(one_class, ["x", ""])[0] < 0.5
    assert toxicity.train(on([], np.array([], np.int32))).offset == 0


def test_folded_kernel_equals_kernel():
    """Weights folded into subsequences give the same decision as kernel values with the landmarks."""
    u = span_units("dimwit numbskull reading")
    n = int(u.is_word.sum())
    matrix, lengths = toxicity.unit_matrix(u.symbols, u.begin[:n], u.end[:n])
    features, table = toxicity._landmark_table(matrix, lengths)
    kernel = toxicity._kernel_columns(matrix, lengths, features, table)
    w = np.array([0.5, -1.0, 2.0])
    assert np.allclose(kernel, kernel.T) and np.allclose(kernel, table.T @ table)
    assert np.allclose(toxicity.Model(features, table @ w, 0.25, 1.0, 0.0).values(u)[:n], kernel @ w + 0.25)


def test_training_sample_is_bounded(spark, tmp_path):
    """Few documents, few bytes, whole texts; repeated labels and rows don't multiply it."""
    from marshlight.llm.learning import training_sample

    rows = [(i, "x" * 100) for i in range(400)] + [(7, "y" * 100)] * 50 + [(500, "z" * 5000), (501, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2) for i in [*range(400), 500, 501]] + [(7, 1)] * 30
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by_docs = training_sample(spark, str(tmp_path), "toxic", 4, 2, 60).collect()
    assert len(by_docs) == len({r.doc_id for r in by_docs}) and 50 <= len(by_docs) <= 60
    by_bytes = training_sample(spark, str(tmp_path), "toxic", 4, 2, 1000, 12_800).collect()
    assert 12_600 <= sum(len(r.text) for r in by_bytes) <= 12_800 and 500 not in {r.doc_id for r in by_bytes}


def quality_corpus(n, seed):
    random.seed(seed)
    texts, y = [], []
    for k in range(n):
        text = prose(random.randint(5, 150))
        if k % 3 == 0:
            text = [text.upper() + "!!", " | ".join(text.split()), " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * 80)][k % 4]
        texts.append(text)
        y.append(float(k % 3 != 0))
    return texts, np.array(y)


def bags(texts):
    parts = [quality.passages(d, o) for _, _, d, o in text_chunks(pa.array(texts, pa.string()))]
    return np.concatenate([x for x, _ in parts]), np.concatenate([s for _, s in parts])


@pytest.fixture(scope="module")
def quality_model():
    texts, y = quality_corpus(600, 1)
    return quality.train(*bags(texts), y)


def test_quality_held_out(quality_model):
    texts, y = quality_corpus(300, 2)
    score, _ = quality_model.forward(*bags(texts))
    assert ((score >= quality.THRESHOLD) == y).mean() > 0.97


def test_quality_gradient():
    texts, y = quality_corpus(12, 5)
    x, sizes = bags(texts)
    net = quality.Attention(x.shape[1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    score, state = net.forward(x, sizes)
    gradient = net.gradient(y, sizes, score, state, 0.0)
    loss = lambda: -np.mean(y * np.log(net.forward(x, sizes)[0]) + (1 - y) * np.log(1 - net.forward(x, sizes)[0]))
    for k in net.p:
        at = tuple(0 for _ in net.p[k].shape)
        old, base = net.p[k][at], 1e-4
        net.p[k][at] = old + base
        up = loss()
        net.p[k][at] = old - base
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * base) - gradient[k][at]) < 1e-4, k


def test_attention_equals_formula(quality_model):
    """Scores of several texts at once against the formula, one text and one passage at a time."""
    random.seed(9)
    x, sizes = bags([prose(random.randint(0, 200)) for _ in range(12)])
    score, state = quality_model.forward(x, sizes)
    p, edge = quality_model.p, np.append(0, np.cumsum(sizes))
    squash = lambda v: 1 / (1 + np.exp(-v))
    for k in range(12):
        encoded = [np.tanh(np.clip((row - quality_model.mean) / quality_model.scale, -8, 8) @ p["A"] + p["a"]) for row in x[edge[k] : edge[k + 1]]]
        gates = [np.exp(float(((np.tanh(h @ p["V"]) * squash(h @ p["U"])) @ p["w"])[0])) for h in encoded]
        pooled = sum(g / sum(gates) * h for g, h in zip(gates, encoded, strict=True))
        assert np.isclose(score[k], squash(float((pooled @ p["c"])[0]) + p["d"][0]), atol=1e-4)
        assert np.allclose(state["weight"][edge[k] : edge[k + 1]], np.array(gates) / sum(gates), atol=1e-4)


def test_passages_cover_the_text():
    texts = ["a b c " * 100, "", "  ", "x"]
    x, sizes = bags(texts)
    assert sizes.tolist() == [-(-300 // quality.PASSAGE_WORDS), 1, 1, 1] and len(x) == sizes.sum()
    assert not x[sizes[0]].any() and not x[sizes[0] + 1].any()


def test_quality_edges(spark, docs, no_docs, quality_model):
    rows = quality.score(docs, quality_model, ("doc_id", "lang")).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 6) for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(no_docs, quality_model).count() == 0
    assert quality.train(np.zeros((0, quality.FEATURES)), np.zeros(0, np.int64), np.zeros(0)).forward(*bags(["x"]))[0].shape == (1,)


def search_brute(rows, k):
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q in good:
        if i % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def test_search(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 0.2, 16).round(2).tolist()) for i in range(400)]
    rows += [(500 + k, rows[k][1]) for k in range(30)]  # ties
    rows += [(600, None), (650, []), (651, [0.1, None]), (652, [float("nan")] * 16), (653, [float("inf")] * 16), (700, [0.5, -0.5]), (701, [1.0, 2.0]), (None, [1.0] * 16), (750, [0.0] * 16), (800, [1e9] * 16)]
    rows += [(850 + k, [0.0] * 15 + [float(k)]) for k in range(120)]  # many components that are 0
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("shard", F.lit(2))
    got = search.top_k(table.filter("vec_id % 50 = 0"), table).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == search_brute(rows, 5)
    assert search.top_k(table.filter("1 = 0"), table).count() == 0
    assert search.top_k(table.filter("vec_id = 50"), table.filter("vec_id in (50, 51)")).count() == 1


def test_search_in_shards_of_bytes(spark, monkeypatch):
    """Long vectors make more shards, and the answers stay the same."""
    monkeypatch.setattr(search, "SHARD_BYTES", 8 * 64 * 20)
    rng = np.random.default_rng(18)
    rows = [(i, rng.normal(0, 0.2, 64).round(2).tolist()) for i in range(300)] + [(1000, None), (1001, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search.top_k(table.filter("vec_id % 50 = 0"), table)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == search_brute(rows, 5)


def test_search_of_large_components(spark):
    """Components of any size keep their value; a score among the best that isn't a long is an error."""
    rows = [(0, [0.5, 0.25]), *((k, [1e10 * k, -3e9 * k]) for k in range(1, 8)), (8, [2e14, 0.0]), (9, [-2e14, 1.0]), (10, [1.0, 1e14])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search.top_k(table.filter("vec_id = 0"), table, k=11).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == search_brute(rows, 11)
    one = spark.createDataFrame([(0, [1.0]), (1, [1e10]), (2, [2e10])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in search.top_k(one.filter("vec_id = 0"), one).orderBy("rank").collect()] == [(2, 1310720000000000), (1, 655360000000000)]
    zero = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 1e30])], "vec_id long, embedding array<double>")
    assert [r.score for r in search.top_k(zero.filter("vec_id = 0"), zero).collect()] == [256 * 512]
    for far in ([1e30], [-1e30]):
        bad = spark.createDataFrame([(0, [1.0]), (1, far)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="doesn't fit a long"):
            search.top_k(bad.filter("vec_id = 0"), bad).collect()


def test_search_of_repeated_rows(spark):
    """A repeated query is asked once, rows of one vec_id with different vectors apart; repeated candidates are listed each time."""
    rows = [(50, [1.0, 0.0])] * 3 + [(50, [0.0, 1.0])] + [(7, [1.0, 1.0])] * 9 + [(8, [2.0, -1.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in search.top_k(table.filter("vec_id = 50"), table, 4).collect())
    one = 256 * 256
    assert got == sorted([(1, 8, 2 * one), (2, 8, 2 * one), (3, 7, one), (4, 7, one)] + [(r, 7, one) for r in (1, 2, 3, 4)])


def test_maxscore_prunes_exactly():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-90, 90, (5000, 24)).astype(float)
    vectors[:, 12:] *= rng.random((5000, 12)) < 0.1  # sparse terms
    postings = search.Postings(np.arange(5000), vectors / search.SCALE)
    assert len(postings.lists) == 12
    for q in range(0, 5000, 500):
        scores = vectors @ vectors[q]
        order = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        assert search.maxscore(vectors[q], q, postings, 5) == [(int(-s), i) for s, i in order]
        exact = search.Postings(np.arange(5000), vectors / search.SCALE)
        exact.peak = float("inf")  # the same in Python's integers
        assert search.maxscore(vectors[q], q, exact, 5) == [(int(-s), i) for s, i in order]


def test_store(spark, docs, no_docs):
    store = sharding.shard_documents(docs, scratch_dir(spark, "store"), smallest_bytes=100, target_bytes=50_000)
    assert store.read().count() == len(ROWS) and store.read().columns == docs.columns  # _arrival is the table's own
    assert [r[0] for r in store.read().select("_arrival").distinct().collect()] == [1]
    versions = store.version()
    with pytest.raises(sharding.ConflictError):
        store._commit(versions - 1, [], docs.schema)
    store.append(docs)
    assert store.version() == versions + 1 and store.read().count() == 2 * len(ROWS)
    while store.compact():
        pass
    assert store.read().count() == 2 * len(ROWS) and not store.due(store.manifest()[0])
    docs.write.mode("overwrite").parquet(f"{store.path}/data/append-lost")
    assert store.vacuum() > 0 and store.read().count() == 2 * len(ROWS)
    empty = sharding.shard_documents(no_docs, scratch_dir(spark, "store"))
    assert empty.read().count() == 0 and "text" in empty.read().columns


def test_store_keeps_versions(spark, docs):
    """Compaction takes nothing from an earlier version or from a table read before it; vacuum keeps as many versions as asked."""
    store = sharding.ShardStore(spark, scratch_dir(spark, "versions"), smallest_bytes=100, target_bytes=1 << 20, fanout=2)
    store.append(docs.coalesce(1))
    store.append(docs.coalesce(1))
    before = store.read()
    assert store.compact() and store.version() == 3
    assert [store.read(v).count() for v in (1, 2, 3)] == [len(ROWS), 2 * len(ROWS), 2 * len(ROWS)]
    assert before.count() == 2 * len(ROWS)
    assert store.vacuum(keep=2) == 0 and store.read(2).count() == 2 * len(ROWS)
    assert store.vacuum() == 2 and store.read().count() == 2 * len(ROWS)


def test_store_segments(spark, docs):
    """A commit rewrites the segments that it touches and leaves full ones alone; old versions keep theirs until vacuum."""
    store = sharding.ShardStore(spark, scratch_dir(spark, "segments"), smallest_bytes=100, target_bytes=1 << 20, fanout=3, segment_shards=2)
    for _ in range(5):
        store.append(docs.select("doc_id").coalesce(1))
    first, shards = list(store._segments(5)), store.manifest()[0]
    assert len(first) == 3 and len(shards) == 5 and list(store._segments(3))[0] == first[0] == list(store._segments(4))[0]
    store._commit(5, [*shards[:2], shards[4]], docs.select("doc_id").schema)
    assert list(store._segments(6))[0] == first[0] and len(store._segments(6)) == 2 and store.manifest()[0] == [*shards[:2], shards[4]]
    again = sharding.ShardStore(spark, store.path, segment_shards=2)
    assert again.manifest(5)[0] == shards and again.read(5).count() == 5 * len(ROWS) and again.read().count() == 3 * len(ROWS)
    with pytest.raises(sharding.ConflictError):
        again._commit(5, shards, docs.select("doc_id").schema)
    assert again.vacuum() == 2 and sum(n.startswith("segment-") for n in again._names()) == 2 and again.read().count() == 3 * len(ROWS)


def test_store_columns(spark, docs):
    """New columns are null in older rows, lacking ones in the delivery that lacks them; another type is refused."""
    store = sharding.ShardStore(spark, scratch_dir(spark, "columns"), smallest_bytes=100, fanout=2)
    few = docs.select("doc_id", "text")
    store.append(few)
    store.append_arrivals(few.withColumn("more", F.lit(5)), F.lit(0), compact=False)
    store.append(docs.select("doc_id", "lang"))
    assert store.compact() and store.read().columns == ["doc_id", "text", "more", "lang"]
    assert store.read().filter("more = 5").count() == len(ROWS) and store.read().filter("lang is null and more is null").count() >= len(ROWS)
    with pytest.raises(ValueError, match="column text"):
        store.append(docs.select("doc_id", F.lit(1).alias("text")))
    assert store.read().count() == 3 * len(ROWS)


def test_store_writers_race(spark, docs):
    """Of writers that commit one version at once one wins, and nothing of the winner is lost."""
    from concurrent.futures import ThreadPoolExecutor

    path = scratch_dir(spark, "race")
    stores = [sharding.ShardStore(spark, path) for _ in range(6)]
    stores[0].append(docs.select("doc_id"))

    def commit(k):
        try:
            return stores[k]._commit(1, [sharding.Shard(f"shard-{k}", k)], docs.select("doc_id").schema)
        except sharding.ConflictError:
            return None

    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(commit, range(6)))
    assert sorted(d for d in done if d) == [2]
    assert stores[0].manifest()[0] == [sharding.Shard(f"shard-{done.index(2)}", done.index(2))]


def test_pipeline(spark, tmp_path):
    """Planted cases through all stages, against what each stage must do."""
    import corpus_pipeline as pipeline

    random.seed(11)
    good, labels = [], []
    for i in range(260):
        words = prose(60).split()
        toxic = i % 5 == 1
        if toxic:
            words[7] = random.choice(INSULTS)
        text = " ".join(words)
        if i % 5 == 2:
            text = " ".join(w + "###" for w in words)
        good.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 5 != 2), int(toxic)))
    passage = "\n".join(prose(25) for _ in range(4))
    own = prose(30)
    planted = [(1000, passage, "en", "s", 1), (1001, f"{passage}\n{own}", "en", "s", 1), (1002, passage, "en", "s", 1)]
    near_copy = prose(200)
    planted += [(1003, near_copy, "en", "s", 1), (1004, near_copy + " end", "en", "s", 1)]
    spark.createDataFrame(good + planted, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert {1000, 1001, 1003} <= left and not left & {1002, 1004}
    clean = {i for i in range(260) if i % 5 not in (1, 2)}
    assert len(left & clean) >= 0.97 * len(clean)
    assert len(left & {i for i in range(260) if i % 5 in (1, 2)}) <= 4
    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "line_dedup", "near_dedup", "packing"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() row by row against plain Python: the two models' scores, then line dedup, near dedup and packing over what is left."""
    import corpus_pipeline as pipeline
    from test_dedup import lines_brute, near_brute
    from test_tokens import check_packing
    from tokenizers import Tokenizer

    from marshlight.llm.bpe import default_tokenizer

    random.seed(13)
    rows, labels = [], []
    passage = [prose(8) for _ in range(5)]
    base = prose(120).split()
    for i in range(240):
        lines = [prose(12) for _ in range(6)]
        if i % 6 == 1:
            lines[2] += " " + random.choice(INSULTS)
        if i % 6 == 2:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        if i % 6 == 3:
            lines[3:3] = passage[: random.randint(2, 5)]
        if i % 6 == 4:
            words = list(base)
            for _ in range(random.randint(0, 7)):
                words[random.randrange(len(words))] = "xyzzy"
            lines = [" ".join(words)]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(i % 6 != 2), int(i % 6 == 1)))
    rows += [(300, None), (301, ""), (302, "\n".join(passage)), (303, "\n".join(passage))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()

    texts = dict(rows)
    net, model = quality.fit(spark, str(tmp_path)), toxicity.fit(spark, str(tmp_path))
    alone = lambda text: (np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    texts = {i: t for i, t in texts.items() if net.forward(*quality.passages(*alone(t)))[0][0] >= quality.THRESHOLD}
    texts = {i: t for i, t in texts.items() if model.probability(model.texts(*alone(t)))[0] < toxicity.THRESHOLD}
    assert 150 <= len(texts) <= 210
    cut = {i: (t, n) for i, _, n, t in lines_brute([(i, t) for i, t in texts.items() if t is not None])}
    texts = {i: cut[i][0] if i in cut else None for i in texts if i not in cut or not cut[i][1] or cut[i][0].replace("\n", "")}
    texts = {i: texts[i] for i, (_, c) in near_brute(texts, 5).items() if i == c}
    assert 100 <= len(texts) <= 180
    assert {r.doc_id for r in got} == set(texts)
    check_packing(got, texts, Tokenizer.from_file(default_tokenizer()), 1024)


def test_near_dedup_by_row(spark):
    """Rows that share a doc_id, or have none, are kept or dropped one by one, and each group keeps its smallest doc_id."""
    import corpus_pipeline as pipeline

    random.seed(12)
    one, two, three, four = (prose(200) for _ in range(4))
    rows = [(5, one), (5, two + " end"), (3, two), (None, three), (None, three), (9, four), (9, four), (8, four + " end"), (None, four), (1, ""), (1, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(5, one), (3, two), (None, three), (8, four + " end"), (1, ""), (1, "")], key=str)


def test_line_dedup_by_row(spark):
    """The pipeline's stage on rows that share a doc_id."""
    import corpus_pipeline as pipeline
    from test_dedup import lines_brute

    rows = [(1, "a\nb\nc"), (5, "a\nb\nc"), (5, "x\ny\nz\nw"), (5, "u\nv"), (6, "w\nx\ny\nz\nw")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    left = sorted((r.doc_id, r.text, r.n_chars) for r in pipeline.line_dedup(spark, docs, "").collect())
    assert left == sorted((i, t, len(t)) for i, _, n, t in lines_brute(rows, stable=True) if not n or t)


def test_stages_on_edges(spark, docs, no_docs, tmp_path):
    import corpus_pipeline as pipeline

    spark.createDataFrame([(4, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        for some in (docs, no_docs):
            out = stage(spark, some, str(tmp_path))
            assert out.count() <= 200
            if name != "packing":
                assert out.columns == some.columns


def test_classifier_queries(spark, tmp_path):
    """The registered queries: one row a document, folds by crc32, scores in range, predictions by the threshold, held-out texts told
    apart, and labels of the held-out fold without any effect."""
    import zlib

    random.seed(17)
    rows, labels = [], []
    for i in range(300):
        words = prose(60).split()
        if i % 4 == 1:
            words[7] = random.choice(INSULTS)
        if i % 4 == 2:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), i % 4))
        labels.append((i, int(i % 4 != 2), int(i % 4 == 1)))
    rows += [(900, None, 0), (901, "", 0), (None, prose(20), 0), (5, rows[5][1], 1)]
    spark.createDataFrame([(i, t, "en", "s", 0.5) for i, t, _ in rows], "doc_id long, text string, lang string, source string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    for query, folds, out, good in ((toxicity.op5_toxicity, 4, 2, lambda k: k == 1), (quality.op6_quality, 5, 0, lambda k: k != 2)):
        held = {i: zlib.crc32(str(i).encode()) % folds == out for i, _, _ in rows if i is not None}
        results = []
        for flip in (False, True):
            given = [(i, q ^ (flip and held[i]), t ^ (flip and held[i])) for i, q, t in labels]
            spark.createDataFrame([(i, int(q), int(t)) for i, q, t in given], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
            got = query(spark, str(tmp_path))
            assert got.columns == ["doc_id", "held_out", "score", "predicted"]
            results.append(sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in got.collect()))
            if flip:
                continue
            found = got.collect()
            assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
            assert all(r.held_out == held[r.doc_id] for r in found if r.doc_id is not None)
            kinds = {i: k for i, _, k in rows}
            right = [r.predicted == int(good(kinds[r.doc_id])) for r in found if r.doc_id is not None and r.doc_id < 300 and r.held_out]
            assert np.mean(right) >= 0.93
        assert results[0] == results[1]
