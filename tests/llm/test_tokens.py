"""Tokenizing, token files, packing and the lexicon against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marshlight.llm import op3_packing as packing
from marshlight.llm import op9_bpe as bpe_queries
from marshlight.llm import op10_token_files as files
from marshlight.llm.bpe import Encoder, Lexicon, _classes, default_tokenizer, vocabulary
from marshlight.llm.common import padded, same_spans, scratch_dir, span_hashes, text_chunks

from llm_cases import ROWS


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def encode_all(encoder, texts):
    out = []
    for first, last, data, offsets in text_chunks(pa.array(texts, pa.string()), 4096):
        n, ids = encoder.encode(data, offsets)
        at = np.append(0, np.cumsum(n))
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(last - first)]
    return out


def tricky(n, seed):
    random.seed(seed)
    parts = ["'s", "'", "s", "t", "re", " ", "  ", "\n", "\t", "1", "é", "!", "ll", "Z", "<|endoftext|>", "<|endo", "aa", "日", " ", " ", "ﬁ", "²", "​", "é"]
    return ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(n)]


def test_encoder_equals_library(library):
    texts = [r[1] for r in ROWS] + tricky(2000, 1)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encode_all(Encoder(default_tokenizer()), texts) == want


def test_classes_cut_like_library(library):
    """Every code point between letters, digits and blanks is cut as the library cuts it."""
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{p}b 1{p}2 {p}{p} ." for p in points]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    bad = [hex(ord(p)) for p, a, b in zip(points, encode_all(Encoder(default_tokenizer()), texts), want, strict=True) if a != b]
    assert not bad
    assert len(_classes()) == 0x110000


def test_lexicon_and_merges_agree(library, tmp_path):
    words = sorted({w.encode() for t in tricky(300, 2) for w in t.split() if w and "<|" not in w} | {b" the", b" then", b"", b"he"})
    lexicon = bpe_queries.build_lexicon([w for w in words if w], default_tokenizer())
    lexicon.save(str(tmp_path / "lexicon.bin"))
    lexicon = Lexicon.load(str(tmp_path / "lexicon.bin"))
    texts = tricky(500, 3)
    assert encode_all(Encoder(default_tokenizer(), lexicon), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    rank = lexicon.lookup(data, ends - [len(w) for w in words], ends)
    assert sorted(rank.tolist()) == [-1, *range(len(words) - 1)]  # all but the empty word, each with a rank of its own


def test_long_piece_and_rounds_agree():
    v = vocabulary(default_tokenizer())
    random.seed(4)
    for text in (b"a" * 501, bytes(random.choices(b"abcdeth ", k=900)), bytes(random.choices(range(256), k=700))):
        data = np.frombuffer(text, np.uint8)
        _, ids = v.merge(data, np.array([0]), np.array([len(text)]), long_piece=10_000)
        assert ids.tolist() == v.merge_one(text)


def test_empty_lexicon():
    lexicon = Lexicon.build([])
    assert lexicon.lookup(np.frombuffer(b"abc", np.uint8), np.array([0]), np.array([3])).tolist() == [-1]


def test_token_files(spark, docs, no_docs, library):
    path = scratch_dir(spark, "files")
    files.write_token_files(docs, path, files=3)
    rows = files.read_token_files(spark, path).collect()
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in ROWS}
    at = 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start)):
        assert (r.start, r.n_tokens, r.ids) == (at, len(r.ids), want[r.doc_id])
        at += r.n_tokens
    assert len(rows) == len(ROWS)
    files.write_token_files(no_docs, path + "-none")
    assert files.read_token_files(spark, path + "-none").count() == 0


def test_token_file_encodings(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    files.write_token_files(docs, str(tmp_path / "f"), files=1)
    meta = pq.ParquetFile(next((tmp_path / "f").glob("*.parquet"))).metadata.row_group(0)
    by_name = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert any("DICTIONARY" in e for e in by_name["ids.list.element"].encodings)
    assert all(c.has_offset_index and c.has_column_index for c in by_name.values())


def check_packing(rows, texts, library, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert len(own) == -(-len(ids) // capacity)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_packing(spark, docs, no_docs, library):
    own = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    check_packing(packing.pack_documents(own).collect(), texts, library, 1024)
    check_packing(packing.pack_documents(own, capacity=16, docs_per_shard=3).collect(), texts, library, 16)
    assert packing.pack_documents(docs).filter("doc_id = 5").count() == 2  # repeated rows are packed one by one
    assert packing.pack_documents(docs).filter("doc_id is null").count() == 1
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_of_copies(spark):
    """Ties across shards: equal rows and rows without an id are dealt in parts, and full pieces stand alone."""
    rows = [(None, "same words here")] * 3000 + [(5, "same words here")] * 700 + [(6, "a b c d e f g h i j " * 8)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack_documents(docs, capacity=16, docs_per_shard=64).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for own in by_sequence.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 16
    assert sum(r.doc_id is None for r in got) == 3000 and sum(r.doc_id == 5 for r in got) == 700
    assert all(len(by_sequence[r.sequence_id]) == 1 and r.offset == 0 for r in got if r.length == 16)
    assert len(by_sequence) <= 1.1 * sum(r.length for r in got) / 16 + 64


def test_packing_query(spark, docs, library, tmp_path):
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(packing.op3_packing(spark, str(tmp_path)).collect(), texts, library, 1024)


def test_token_files_query(spark, docs, library, tmp_path):
    docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    texts, at = {r[0]: r[1] for r in ROWS if r[0] is not None}, 0
    for r in sorted(files.op10_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id
        at += len(ids)


def test_words_with_one_hash(library, monkeypatch):
    """Different words that share a hash still get their own ids: the bytes decide."""
    from marshlight.llm import bpe

    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    texts = tricky(300, 9)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode_all(Encoder(default_tokenizer()), texts) == want
    lexicon = bpe_queries.build_lexicon([b" s", b"'s", b"aa", b"ll"], default_tokenizer())
    assert encode_all(Encoder(default_tokenizer(), lexicon), texts) == want


def test_spans():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 3000, 300))
    ends = starts + rng.integers(1, 40, 300)
    ends[::50] += 600
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    hashes = span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(spans)) and len({(h, s) for h, s in zip(hashes.tolist(), spans, strict=True)}) == len(set(spans))
    twin = np.random.default_rng(3).permutation(300)
    same = (ends - starts) == (ends - starts)[twin]
    a, b = np.arange(300)[same], twin[same]
    got = same_spans(padded(data), starts[a], padded(data), starts[b], (ends - starts)[a])
    assert got.tolist() == [spans[i] == spans[j] for i, j in zip(a, b, strict=True)]


def test_packing_is_tight():
    random.seed(5)
    lengths = np.array(sorted((random.randint(1, 1023) for _ in range(4000)), reverse=True))
    bins, offsets = packing.sum_of_squares(lengths, 1024)
    best_fit = []
    for size in lengths.tolist():
        fits = [g for g in best_fit if g >= size]
        best_fit.remove(min(fits)) if fits else None
        best_fit.append((min(fits) if fits else 1024) - size)
    assert bins.max() + 1 <= 1.005 * len(best_fit)
    assert (np.bincount(bins, weights=lengths) <= 1024).all()


def test_bpe_round_trip(spark, docs, no_docs, library):
    lexicon = bpe_queries.build_lexicon(bpe_queries.frequent_words(bpe_queries.word_counts(docs), 50), default_tokenizer())
    encoded = bpe_queries.encode(docs, lexicon=lexicon)
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS}
    rows = encoded.collect()
    assert len(rows) == len(ROWS) and all(r.ids == want[r.doc_id] for r in rows)
    texts = bpe_queries.decode(encoded).collect()
    assert sorted((r.doc_id or 0, r.text) for r in texts) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert bpe_queries.encode(no_docs).count() == 0


def test_word_counts_cover_everything(spark, docs):
    counts = bpe_queries.word_counts(docs).collect()
    assert {bytes(r["word"]): r["n"] for r in counts}[b" b"] == 30_000
    words = bpe_queries.frequent_words(bpe_queries.word_counts(docs), 10)
    assert len(words) <= 10 and b" b" in words


def test_equally_frequent_words(spark):
    docs = spark.createDataFrame([(1, " ".join(a + b for a in "abcdefghij" for b in "klmnopqrst"))], "doc_id long, text string")
    assert len(bpe_queries.frequent_words(bpe_queries.word_counts(docs), 5)) == 5


def test_digests(spark, docs, library, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe_queries.op9_bpe(spark, str(tmp_path)).collect():
        ids = library.encode({x[0]: x[1] for x in ROWS}[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_texts_that_are_not_utf8(spark, library):
    """A byte that isn't UTF-8 becomes U+FFFD, in the words that are counted too; other texts of the table stay as they are."""
    docs = spark.createDataFrame([(1, "plain words"), (2, "end")], "doc_id long, text string")
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.concat("text", F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("text")))
    ids = {r.doc_id: r.ids for r in bpe_queries.encode(broken).collect()}
    assert ids == {1: library.encode("plain words", add_special_tokens=False).ids, 2: library.encode("end\ufffd", add_special_tokens=False).ids}
