"""Operator 6: document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.common import map_arrow, mix64, span_hashes, table, text_chunks, words
from marshlight.llm.learning import append_score, fold, sigmoid, training_sample

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Words of a passage. A text's passages follow each other, the last one may be shorter.
PASSAGE_WORDS = 48
ENCODED, ATTENTION, EPOCHS, RATE = 16, 8, 80, 0.05
#: Most labelled documents that the network is fitted on.
BAGS = 3_000

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~\\"
_KINDS = np.zeros(256, np.int64)
_KINDS[ord("a") : ord("z") + 1] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[ord("0") : ord("9") + 1] = 3
_KINDS[32], _KINDS[10] = 4, 5
_KINDS[128:] = 6
for _k, _b in enumerate(_MARKS):
    _KINDS[_b] = 7 + _k
_KIND_COUNT = 7 + len(_MARKS)
#: Kinds of bytes (shares), then: word length and its spread, share of words equal to the one before, of different words,
#: of words in capitals, with a capital first, without a letter, with a mark inside or behind; words and bytes (logarithms).
FEATURES = _KIND_COUNT + 10


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of passages of each text). A text without words has one passage, all zeros."""
    _, starts, ends, text = words(data, offsets, lower=False)
    count = np.bincount(text, minlength=len(offsets) - 1)
    sizes = np.maximum(-(-count // PASSAGE_WORDS), 1)
    base = np.cumsum(sizes) - sizes
    out = np.zeros((int(sizes.sum()), FEATURES))
    if not len(starts):
        return out, sizes
    nth = np.arange(len(starts)) - (np.cumsum(count) - count)[text]
    passage = base[text] + nth // PASSAGE_WORDS
    heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    own = passage[heads]  # passages that have words
    n = np.diff(np.append(heads, len(starts))).astype(float)
    begin, end = starts[heads], np.append(starts[heads[1:]], ends[-1])
    last = np.append(text[heads[1:]] != text[heads[:-1]], True)
    end = np.where(last, ends[np.append(heads[1:], len(starts)) - 1], end)
    size = end - begin
    kind = _KINDS[data]
    of_byte = np.repeat(np.arange(len(own)), size)
    at = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
    out[own, :_KIND_COUNT] = np.bincount(of_byte * _KIND_COUNT + kind[at], minlength=len(own) * _KIND_COUNT).reshape(len(own), -1) / size[:, None]

    total = lambda x: np.add.reduceat(x.astype(float), heads)
    length = (ends - starts).astype(float)
    hashes = span_hashes(data, starts, ends)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1]))
    key = mix64(hashes + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where = np.unique(key, return_index=True)
    new = np.zeros(len(starts), bool)
    new[where] = True
    before = [np.append(0, np.cumsum(np.isin(kind, k))) for k in ([1], [2], [1, 2, 6], range(7, _KIND_COUNT))]
    lower, upper, letters, marks = (c[ends] - c[starts] for c in before)
    mean = total(length) / n
    columns = (
        mean / 10, np.sqrt(np.maximum(total(length**2) / n - mean**2, 0)) / 10, total(again) / n, total(new) / n, total((upper > 1) & (lower == 0)) / n,
        total(kind[starts] == 2) / n, total(letters == 0) / n, total(marks > 0) / n, np.log1p(n) / 4, np.log1p(size) / 6,
    )
    out[own, _KIND_COUNT:] = np.stack(columns, 1)
    return out, sizes


class Attention:
    """Gated attention over encoded passages: h = tanh(xA + a), weight ~ exp(w . (tanh(hV) * sigmoid(hU))), score = sigmoid(z . c + d)."""

    def __init__(self, features: int, seed: int = 6):
        r = np.random.default_rng(seed)
        shape = {"A": (features, ENCODED), "V": (ENCODED, ATTENTION), "U": (ENCODED, ATTENTION), "w": (ATTENTION, 1), "c": (ENCODED, 1)}
        self.p = {k: r.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) for k, s in shape.items()} | {"a": np.zeros(ENCODED, np.float32), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def forward(self, x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        p, heads = self.p, np.cumsum(sizes) - sizes
        x = np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)
        h = np.tanh(x @ p["A"] + p["a"])
        t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = ((t * g) @ p["w"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), sizes))
        weight = e / np.repeat(np.add.reduceat(e, heads), sizes)
        z = np.add.reduceat(h * weight[:, None], heads)
        score = sigmoid((z @ p["c"])[:, 0] + p["d"])
        return score, {"x": x, "h": h, "t": t, "g": g, "weight": weight, "z": z, "heads": heads}

    def gradient(self, y: np.ndarray, sizes: np.ndarray, score: np.ndarray, s: dict, decay: float) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        up = ((score - y)[:, None] / n).astype(np.float32)
        dz = np.repeat(up @ p["c"].T, sizes, axis=0)
        dot = (dz * s["h"]).sum(1)
        de = s["weight"] * (dot - np.repeat(np.add.reduceat(s["weight"] * dot, s["heads"]), sizes))
        both = de[:, None] @ p["w"].T
        dt, dg = both * s["g"] * (1 - s["t"] ** 2), both * s["t"] * s["g"] * (1 - s["g"])
        dh = (dz * s["weight"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - s["h"] ** 2)
        out = {"A": s["x"].T @ dh, "a": dh.sum(0), "V": s["h"].T @ dt, "U": s["h"].T @ dg, "w": ((s["t"] * s["g"]).T @ de)[:, None], "c": s["z"].T @ up, "d": up.sum(0)}
        return {k: v + decay * p[k] * (v.ndim > 1) for k, v in out.items()}


def train(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, decay: float = 1e-4) -> Attention:
    """Adam over the whole sample. Passages in order of their texts; sizes: how many each text has."""
    net = Attention(x.shape[1])
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        net.p = {k: np.zeros_like(v) for k, v in net.p.items()} | {"d": np.array([np.log(p / (1 - p))])}
        return net
    net.mean, net.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    net.p["d"][0] = np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5))
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, EPOCHS + 1):
        score, state = net.forward(x, sizes)
        rate = RATE * min(1, 2 * (1 - step / (EPOCHS + 1)))
        for k, g in net.gradient(y, sizes, score, state, decay).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch.column("text")):
            x, sizes = passages(data, offsets)
            edge = np.append(0, np.cumsum(sizes) * FEATURES).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(x.reshape(-1).astype(np.float32)))
            yield pa.RecordBatch.from_arrays([batch.column(k).slice(first, last - first) for k in ("doc_id", "y")] + [lists], names=["doc_id", "y", "x"])


def fit(spark: SparkSession, sf_dir: str) -> Attention:
    """Train on the bounded labelled sample; the passages are encoded in Spark's tasks."""
    bags = map_arrow(training_sample(spark, sf_dir, "quality", FOLDS, HELD_OUT, BAGS), _bags, "doc_id long, y int, x array<float>").toArrow().sort_by("doc_id").combine_chunks()
    if not bags.num_rows:
        return train(np.zeros((0, FEATURES)), np.zeros(0, np.int64), np.zeros(0))
    lists = bags.column("x").combine_chunks()
    sizes = lists.value_lengths().to_numpy() // FEATURES
    return train(lists.flatten().to_numpy().astype(np.float64).reshape(-1, FEATURES), sizes, bags.column("y").to_numpy().astype(float))


def score(docs: DataFrame, net: Attention, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as ``name``, a score: 0 to 1, from all passages of the whole text.

    Null, empty and blank texts are one passage of zeros. No shuffle; the network is small and goes with the tasks. ``name``
    must not be in ``keep``.
    """
    return append_score(docs, lambda: lambda data, offsets: net.forward(*passages(data, offsets))[0], list(keep), name=name)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), fit(spark, sf_dir))
    return scored.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
