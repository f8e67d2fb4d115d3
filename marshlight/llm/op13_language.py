"""Operator 13: language of texts by bit-sliced Bloom filters of byte n-grams, one slice a language."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshlight.llm.common import map_arrow, mix64, span_hashes, stored, table, text_chunks, words
from marshlight.llm.learning import fold
from marshlight.session import spread

FOLDS, HELD_OUT = 5, 0
#: Bytes of an n-gram; it lies in a word, with one blank before and behind it.
SIZES = (2, 3, 4)
#: An n-gram belongs to a language if it is in this share of its words at least (so 12 / LEAST_SHARE n-grams at most do, at 12
#: n-grams of a word), and in this share of what its most common language has.
LEAST_SHARE, LEAST_RATIO = 2e-5, 0.2
#: Slots of the filters for each n-gram of the largest language, and slots that an n-gram sets.
SLOTS_A_GRAM, HASHES = 8, 3
PLANE = 64
UNKNOWN = "und"

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[128:] = np.arange(128, 256)


def letters_only(data: np.ndarray) -> np.ndarray:
    """Bytes with letters of ASCII and of Latin-1 in lower case; other ASCII becomes blanks, other bytes stay."""
    out = _PLAIN[data]
    capital = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    capital[1:] &= data[:-1] == 0xC3
    capital[:1] = False
    out[capital] += 0x20
    return out


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, spans of the distinct words of some texts, number of the distinct word and of the text of every word)."""
    data, starts, ends, text = words(letters_only(data), offsets, lower=False)
    _, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return data, np.stack([starts[first], ends[first]]), number, text


def grams(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all n-grams, number of the word) of words: a code holds the bytes and, above them, their number."""
    starts, ends = spans
    lengths = ends - starts + 2
    if not len(lengths):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    base = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    of = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(total) - base[of]
    body = (inside > 0) & (inside < lengths[of] - 1)
    joined = np.full(total + max(SIZES), 0x20, np.uint64)
    joined[:total][body] = data[(starts[of] + inside - 1)[body]]
    codes, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(inside + n <= lengths[of])
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | joined[at + k]
        codes.append(code)
        owners.append(of[at])
    return np.concatenate(codes), np.concatenate(owners)


def slots_of(codes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots that each n-gram sets."""
    mixed = mix64(codes.astype(np.uint64))
    step = mix64(mixed) | np.uint64(1)
    return [((mixed + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bit-sliced filters: ``planes[p][slot]`` has the bit l for language 64 p + l, so one look-up answers for all languages."""

    def __init__(self, languages: list[str], docs: list[int], planes: list[np.ndarray]):
        self.languages, self.docs, self.planes = languages, docs, planes
        size = len(planes[0]) if planes else 1
        filled = [int(((planes[k // PLANE] >> planes[k // PLANE].dtype.type(k % PLANE)) & planes[k // PLANE].dtype.type(1)).sum()) / size for k in range(len(languages))]
        #: How often an n-gram that a language hasn't is found in its filter.
        self.false = np.array(filled) ** HASHES

    def hits(self, codes: np.ndarray, owners: np.ndarray, owners_count: int) -> np.ndarray:
        """Of each owner's n-grams those that each language contains (a popcount a language): (owners, languages)."""
        out = np.zeros((owners_count, len(self.languages)))
        if not len(codes):
            return out
        slots = slots_of(codes, len(self.planes[0]))
        for p, plane in enumerate(self.planes):
            mask = plane[slots[0]] & plane[slots[1]]
            for more in slots[2:]:
                mask &= plane[more]
            for k in range(min(PLANE, len(self.languages) - p * PLANE)):
                bit = (mask >> plane.dtype.type(k)) & plane.dtype.type(1)
                out[:, p * PLANE + k] = np.bincount(owners, bit, minlength=owners_count)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, score) of each text. A language's share of a text's n-grams, less what false positives add,
        counts; the score is the best one's part of all languages' shares. Without any the most common language, score 0."""
        count = len(offsets) - 1
        usual = int(np.argmax(self.docs))
        data, spans, number, text = distinct_words(data, offsets)
        codes, owners = grams(data, spans)
        per_word = self.hits(codes, owners, spans.shape[1])
        many = np.bincount(owners, minlength=spans.shape[1])
        total = np.maximum(np.bincount(text, many[number], minlength=count), 1)
        share = np.stack([np.bincount(text, per_word[number, k], minlength=count) for k in range(len(self.languages))], 1) / total[:, None]
        share = np.maximum((share - self.false) / np.maximum(1 - self.false, 1e-9), 0)
        order = np.argsort([-d for d in self.docs], kind="stable")  # of equal shares the more common language
        best = order[np.argmax(share[:, order], 1)]
        whole = share.sum(1)
        top = share[np.arange(count), best]
        return np.where(whole > 0, best, usual), np.where(whole > 0, top / np.maximum(whole, 1e-12), 0.0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): in how many words of texts, different ones in each text, an n-gram is. A gram of 0 counts the words, of -1 the texts."""
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch.column("text"), 4 << 20):
            langs = batch.column("lang").slice(first, last - first).dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            data, spans, number, text = distinct_words(data, offsets)
            pairs = np.unique(text * max(spans.shape[1], 1) + number)
            text, number = np.divmod(pairs, max(spans.shape[1], 1))
            codes, owners = grams(data, spans)
            for k, name in enumerate(names):
                weight = np.bincount(number[lang[text] == k], minlength=spans.shape[1])
                used = weight[owners] > 0
                found, at = np.unique(codes[used], return_inverse=True)
                n = np.bincount(at, weight[owners[used]], minlength=len(found)).astype(np.int64)
                gram = np.concatenate([found.astype(np.int64), [0, -1]])
                n = np.concatenate([n, [int(weight.sum()), int((lang == k).sum())]])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])


def fit(docs: DataFrame) -> Filters:
    """Learn the filters from all rows of ``docs`` (text, lang) whose lang isn't null; counted in tasks, then by Spark.

    The driver gets the languages and the slots that are set, whose number follows from LEAST_SHARE.
    """
    known = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = stored(map_arrow(spread(known), _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = {(r["lang"], r["gram"]): r["n"] for r in counts.filter("gram <= 0").collect()}  # two rows a language
    languages = sorted({lang for lang, _ in totals})
    if not languages:
        return Filters([], [], [])
    spark = docs.sparkSession
    sizes = spark.createDataFrame([(lang, k, max(totals[lang, 0], 1)) for k, lang in enumerate(languages)], "lang string, nth int, words long")
    shared = counts.filter("gram > 0").join(F.broadcast(sizes), "lang").withColumn("share", F.col("n") / F.col("words")).filter(F.col("share") >= LEAST_SHARE)
    most = shared.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("nth", "share")).alias("of"))
    chosen = most.select("gram", F.inline(F.filter("of", lambda x: x["share"] >= LEAST_RATIO * F.col("most")))).select("gram", "nth")
    chosen = stored(chosen, "language-chosen")
    largest = chosen.groupBy("nth").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    slots = 1 << max(10, math.ceil(math.log2(SLOTS_A_GRAM * largest)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nth = batch.column("nth").to_numpy()
            bit = np.left_shift(np.int64(1), (nth % PLANE).astype(np.int64))
            for s in slots_of(batch.column("gram").to_numpy(), slots):
                yield pa.RecordBatch.from_arrays([pa.array((nth // PLANE).astype(np.int32)), pa.array(s), pa.array(bit)], names=["plane", "slot", "mask"])

    filled = map_arrow(chosen, place, "plane int, slot long, mask long").groupBy("plane", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    planes = []
    for p in range(-(-len(languages) // PLANE)):
        here = filled.column("plane").to_numpy() == p
        held = min(PLANE, len(languages) - p * PLANE)
        plane = np.zeros(slots, np.uint8 if held <= 8 else np.uint16 if held <= 16 else np.uint32 if held <= 32 else np.uint64)
        plane[filled.column("slot").to_numpy()[here]] = filled.column("mask").to_numpy()[here].view(np.uint64).astype(plane.dtype)
        planes.append(plane)
    return Filters(languages, [totals[lang, -1] for lang in languages], planes)


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of ``docs`` and the predicted language and its score (0 to 1) of each whole text, without a shuffle.

    Texts that are null or have no letter are ``und`` with score 0, and so are all where no language was learned. ``names``
    must not be in ``keep``; ``keep`` must not hold text in another type than string.
    """
    lettered = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    columns = list(dict.fromkeys([*keep, "text"]))
    inner = "_lettered"
    rows = spread(docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in columns), lettered.alias(inner)))
    if not filters.languages:
        return rows.select(*keep, F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    listed = pa.array(filters.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(columns.index("text"))):
                language, score = filters.predict(data, offsets)
                fine = batch.column(len(columns)).slice(first, last - first).to_numpy(zero_copy_only=False)
                held = [batch.column(columns.index(c)).slice(first, last - first) for c in keep]
                language = listed.take(pa.array(language, mask=~fine)).fill_null(UNKNOWN)
                yield pa.RecordBatch.from_arrays([*held, language, pa.array(np.where(fine, score, 0.0))], names=[*keep, *names])

    fields = [T.StructField(c, rows.schema[c].dataType, True) for c in keep]
    return map_arrow(rows, run, T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out: Column = fold(FOLDS) == HELD_OUT
    found = identify(docs.select("doc_id", "text"), fit(docs.filter(~held_out).select("text", "lang")))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")

