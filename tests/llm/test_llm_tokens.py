"""Token ids against the libraries, and the files they are stored in."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from tokenizers import Tokenizer

from tomewright.llm import arrays as A
from tomewright.llm import bpe, pretokens, token_files
from tests.llm.helpers import frame, odd_documents

PIECES = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "  ", "\n", "\t", " ", "　", "é",
          "A", "9", "٣", "!", "...", "\U0001F600", "\x1c", "\x85", "漢", "'s", "'ll", "'D", "l",
          "̀", "<|endoftext|>"]


def odd_texts():
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [
        "", "a" * 20_000, pretokens.every_code_point()[:40_000]] + [t for _, t in odd_documents()]


@pytest.fixture(scope="module")
def vocabulary():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.Vocabulary.build(ranks, bpe.tiktoken_classes())


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=vocabulary.ranks)


def thue_morse(k):
    """Two words of 2^k letters that a polynomial modulo a power of two cannot tell apart."""
    bits = [0]
    for _ in range(k):
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def encoded(encoder, texts):
    return [ids[first[r]:first[r + 1]].tolist() for at, to, ids, first in encoder.column(
        pa.array(texts, pa.string())) for r in range(to - at)]


def test_ids_equal_the_library(vocabulary, reference):
    texts = odd_texts()
    want = [reference.encode_ordinary(t or "") for t in texts]
    assert encoded(bpe.Encoder(vocabulary), texts) == want
    small = bpe.Encoder(vocabulary)
    small.known.limit = 50  # forgets again and again
    assert encoded(small, texts) == want
    for text, ids in zip(texts, want, strict=True):
        row = vocabulary.decode_rows(np.array(ids, np.int64), np.array([0, len(ids)]))
        assert row == [(text or "").encode()]


@pytest.mark.parametrize("k", [5, 6, 10, 11, 16])
def test_words_made_to_share_a_hash(vocabulary, reference, k):
    texts = [*thue_morse(k), " ".join(thue_morse(k))]
    want = [reference.encode_ordinary(t) for t in texts]
    assert encoded(bpe.Encoder(vocabulary), texts) == want
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = token_files.LibraryEncoder(file.read(), token_files.library_classes())
    assert encoded(encoder, texts) == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    one, two = A.words_of(*A.text_buffer(pa.array([" ".join(thue_morse(k))])), A.ALNUM).hash
    assert one != two


def test_bytes_are_compared_where_hashes_agree(vocabulary, reference, monkeypatch):
    """With a hash that knows only the size, ids are still those of the library."""
    texts = [t for t in odd_texts()[:400] if t] + ["one two six ten", "two one ten six", "one"]
    want = [reference.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(bpe.Vocabulary, "whole", lambda self, tokens, places: np.full(
        len(places), -1, np.int64))  # the vocabulary's slots go by the real hash
    monkeypatch.setattr(A.ByteRuns, "__call__", lambda self, first, last: (last - first).astype(
        np.uint64))
    encoder = bpe.Encoder(vocabulary)
    assert encoded(encoder, texts) == want and encoded(encoder, texts[::-1]) == want[::-1]


def test_perfect_hash(vocabulary):
    slots = np.sort(vocabulary.slots(A.ByteRuns(vocabulary.blob)(
        vocabulary.slot_start, vocabulary.slot_start + vocabulary.slot_size)))
    assert (slots == np.arange(len(vocabulary.ranks))).all()


def test_encode_and_decode(spark, vocabulary, reference):
    docs = frame(spark, odd_documents())
    rows = bpe.encode(docs, vocabulary, decoded="decoded").collect()
    assert [(r.doc_id, r.ids, bytes(r.decoded)) for r in rows] == [
        (i, reference.encode_ordinary(t or ""), (t or "").encode()) for i, t in odd_documents()]
    assert rows[0].n_words == "kept"
    again = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert [bytes(r.decoded) for r in again] == [bytes(r.decoded) for r in rows]
    empty = bpe.encode(docs.where("false"), vocabulary, decoded="decoded")
    assert empty.collect() == []


@pytest.mark.parametrize("ranges", [1, 5])
def test_token_files(spark, tmp_path, ranges):
    rng = random.Random(ranges)
    docs = [(i * 7, t) for i, t in enumerate(odd_texts()[:300])] + [(9999, None), (9998, "x" * 50)]
    rng.shuffle(docs)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    path = str(tmp_path / "files")
    token_files.write_tokens(frame(spark, docs), public_tokenizers.path("byte_bpe_50k.json"), path,
                             ranges=ranges)
    rows = {r.doc_id: r for r in token_files.with_crc32(token_files.read_tokens(
        spark, path)).collect()}
    start = 0
    for i, text in sorted(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = rows[i]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    files = sorted((tmp_path / "files/tokens").glob("*.parquet"))
    last = -1
    for file in files:
        ids = pq.read_table(file, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
    meta = pq.ParquetFile(files[0]).metadata.row_group(0)
    kinds = {meta.column(k).path_in_schema.split(".")[0]: meta.column(k).encodings
             for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"] and "RLE_DICTIONARY" in kinds["ids"]
    assert meta.column(0).has_offset_index and meta.column(0).has_column_index


def test_token_files_odd(spark, tmp_path):
    docs = odd_documents()
    where = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(frame(spark, docs), where, str(tmp_path / "a"))
    rows = token_files.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows[:-1]]).tolist()
    assert [r.doc_id or 0 for r in rows] == sorted((i or 0) for i, _ in docs)
    token_files.write_tokens(frame(spark, []), where, str(tmp_path / "b"))
    assert token_files.read_tokens(spark, str(tmp_path / "b")).collect() == []
