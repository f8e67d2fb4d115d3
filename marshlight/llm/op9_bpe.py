"""Operator 9: exact BPE encoding and decoding through a minimal acyclic transducer of the corpus' frequent words."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marshlight.llm.bpe import Lexicon, default_tokenizer, distinct_words, encoder, pre_tokens, valid_utf8, vocabulary
from marshlight.llm.common import doc_columns, map_arrow, padded, scratch_dir, span_hashes, stored, table, text_chunks
from marshlight.session import spread

#: Bound on the lexicon; the most frequent words of all documents are in it.
LEXICON_WORDS = 65_536
#: Words over this many bytes are left to the exact merges.
LONGEST_WORD = 48
#: Distinct words that a task counts before it passes them on.
COUNTED_WORDS = 100_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[bytes, int] = {}

    def sums() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column("text")):
            data, offsets = valid_utf8(data, offsets)
            starts, ends = pre_tokens(data, offsets)
            short = ends - starts <= LONGEST_WORD
            starts, ends = starts[short], ends[short]
            where, back = distinct_words(padded(data), starts, ends - starts, span_hashes(data, starts, ends))
            raw = data.tobytes()
            for a, b, n in zip(starts[where].tolist(), ends[where].tolist(), np.bincount(back).tolist(), strict=True):
                total[raw[a:b]] = total.get(raw[a:b], 0) + n
            if len(total) > COUNTED_WORDS:
                yield sums()
                total.clear()
    yield sums()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; each task sums its own words before the shuffle."""
    return map_arrow(spread(doc_columns(docs)).select(F.coalesce("text", F.lit("")).alias("text")), _count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` words: all that occur so often that no more than ``most`` occur as often, or some of the most frequent
    where more than ``most`` are about as frequent. Which words are in it changes no result.

    The limit is found from a histogram over sixteenths of powers of two (at most 1,024 rows), so neither a global sort
    nor a task of all words is needed.
    """
    counts = stored(counts, "word-counts")
    step = F.floor(F.log2("n") * 16).alias("step")
    least, held = None, 0
    for r in sorted(counts.groupBy(step).count().collect(), reverse=True):
        held += r["count"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        top = counts.agg(F.max(step).alias("top")).first()["top"]
        return [] if top is None else [bytes(r["word"]) for r in counts.filter(step == top).select("word").limit(most).collect()]
    return [bytes(r["word"]) for r in counts.filter(F.floor(F.log2("n") * 16) >= least).select("word").collect()]


def build_lexicon(words: list[bytes], tokenizer: str) -> Lexicon:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    counts, ids = vocabulary(tokenizer).merge(data, np.append(0, ends[:-1]).astype(np.int64)[: len(words)], ends)
    edge = np.append(0, np.cumsum(counts))
    return Lexicon.build((w, ids[a:b].tolist()) for w, a, b in zip(words, edge[:-1], edge[1:], strict=True))


def share_lexicon(spark: SparkSession, lexicon: Lexicon) -> str:
    """Put a lexicon's file into the shared folder, from which every executor, early or late, fetches it once; returns its name there."""
    path = f"{scratch_dir(spark, 'lexicon')}.bin"
    make = spark._jvm.org.apache.hadoop.fs.Path
    stream = make(path).getFileSystem(spark._jsc.hadoopConfiguration()).create(make(path), False)
    for block in lexicon.blocks():
        for k in range(0, len(block), 1 << 20):
            stream.write(bytearray(block[k : k + (1 << 20)]))
    stream.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _digest(tokenizer: str, lexicon: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, SparkFiles.get(lexicon))
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                counts, ids = enc.encode(data, offsets)
                flat, edge = ids.astype("<u4"), np.append(0, np.cumsum(counts)).tolist()
                hashes = [hashlib.sha256(flat[a:b].data).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                decoded = [hashlib.sha256(t).hexdigest() for t in enc.vocabulary.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(counts), pa.array(hashes), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(tokenizer: str, lexicon: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, SparkFiles.get(lexicon))
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column("text")):
                counts, ids = enc.encode(data, offsets)
                edge = np.append(0, np.cumsum(counts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.ListArray.from_arrays(pa.array(edge), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _texts(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids").fill_null([])
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            texts = vocabulary(tokenizer).decode(flat, np.array([len(x) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, tokenizer: str | None = None, lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, ids) of each document: the library's ids without special tokens added; null text counts as empty."""
    tokenizer = tokenizer or default_tokenizer()
    lexicon = lexicon or build_lexicon(frequent_words(word_counts(docs)), tokenizer)
    return map_arrow(doc_columns(docs), _ids(tokenizer, share_lexicon(docs.sparkSession, lexicon)), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); special tokens are kept, null ids give an empty text."""
    return map_arrow(tokens.select("doc_id", "ids"), _texts(tokenizer or default_tokenizer()), "doc_id long, text string")


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every document; digests of both.

    The lexicon holds the most frequent words of all documents (their number is bounded), is compiled once and shipped
    as a file that workers map into memory. Other words are merged exactly. Bytes that aren't UTF-8 count as U+FFFD. Null and empty texts have no ids; equal
    rows give equal rows; an empty table gives no rows.
    """
    tokenizer = tokenizer or default_tokenizer()
    docs = table(spark, sf_dir, "documents")
    name = share_lexicon(spark, build_lexicon(frequent_words(word_counts(docs)), tokenizer))
    return map_arrow(spread(doc_columns(docs)), _digest(tokenizer, name), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
