"""Alignment of two tokenizers against the libraries and plain loops over tokens."""

import base64
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from tomewright.llm import alignment
from tomewright.llm.csr import Csr
from tomewright.llm.token_files import library_classes
from tests.llm.helpers import frame, odd_documents

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        sizes = {int(r): len(base64.b64decode(t)) for t, r in map(bytes.split, lines)}
    return a, SentencePieceProcessor(model_file=MODEL), sizes


def plain_groups(libraries, text):
    """Lists of (ids of A, ids of B) of each group; none if the text has no tokens."""
    a, b, sizes = libraries
    if not text:
        return []
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    if b"".join(map(piece, b_ids)) != (" " + text).encode():
        return []
    a_ends = np.cumsum([sizes[i] for i in a_ids]).tolist()
    b_ends = np.cumsum([len(piece(i)) for i in b_ids]).tolist()
    assert a_ends[-1] == b_ends[-1]
    both, groups = sorted(set(a_ends) & set(b_ends)), []
    i = j = 0
    for end in both:
        group = ([], [])
        while i < len(a_ends) and a_ends[i] <= end:
            group[0].append(a_ids[i])
            i += 1
        while j < len(b_ends) and b_ends[j] <= end:
            group[1].append(b_ids[j])
            j += 1
        groups.append(group)
    return groups


def plain(libraries, texts):
    found = [plain_groups(libraries, t) for t in texts]
    docs = Counter()
    for groups in found:
        docs.update({(a, b) for g in groups for a in set(g[0]) for b in set(g[1])})
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for groups in found:
        links = [(a, b) for g in groups for a in g[0] for b in g[1]]
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups),
                    len(links), sum(docs[p] == most[p[0]] for p in links),
                    sum(docs[p] for p in links), line))
    return out


def texts():
    rng = random.Random(8)
    parts = ["the", "Haus", "été", "  ", "\n", "漢字", "🙂", "<s>", "<|endoftext|>", "<0x41>",
             "'ll", "don't", "1234567", "\t", " ", "   ", "x" * 40, "=====", "\x00", " ", "ﬁ",
             "Antidisestablishmentarianism", ".", "é", "ab▁c", "　", "\x85", "#!"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 25)))
           for _ in range(250)]
    out += [" ", "  ", " a", "a ", "▁", "a▁b", "", None, "\n", " \n ", "a" * 5000, "ab" * 999 + " "]
    return out + out[:30]


@pytest.mark.parametrize("limit", [10 ** 6, 40, 0])
def test_matches_plain(spark, libraries, limit):
    given = texts()
    rows = [(i, t) for i, t in enumerate(given)]
    aligned, counts = alignment.align_corpus(frame(spark, rows), JSON, MODEL, limit=limit)
    got = {r["doc_id"]: r for r in aligned.collect()}
    for i, want in enumerate(plain(libraries, given)):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                r["groups"]) == want, given[i]
        assert r["ids"] == "kept" and sum(r["pair_links"]) == r["n_links"]
        # Ends of either side cut a text into its overlaps.
        assert max(r["n_a"], r["n_b"]) <= r["n_overlaps"] <= r["n_links"]
    docs = Counter()
    for t in given:
        docs.update({(a, b) for g in plain_groups(libraries, t) for a in set(g[0])
                     for b in set(g[1])})
    assert {(r["a"], r["b"]): r["docs"] for r in counts.collect()} == docs


def test_odd_documents(spark, libraries):
    rows = odd_documents()
    aligned, _ = alignment.align_corpus(frame(spark, rows), JSON, MODEL)
    want = plain(libraries, [t for _, t in rows])
    key = lambda r: tuple(str(v) for v in r)
    got = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"],
            r["count_sum"], r["groups"]) for r in aligned.collect()]
    assert sorted(got, key=key) == sorted(
        [(i, *w) for (i, _), w in zip(rows, want, strict=True)], key=key)


def test_empty_table_and_tables_without_tokens(spark):
    for rows in ([], [(1, None), (2, "")]):
        aligned, counts = alignment.align_corpus(frame(spark, rows), JSON, MODEL)
        assert sorted((r["doc_id"], r["n_links"], r["n_best"], r["count_sum"], r["groups"])
                      for r in aligned.collect()) == [(i, 0, 0, 0, "") for i, _ in rows]
        assert counts.count() == 0


def test_words_are_encoded_as_in_whole_texts(libraries):
    """A small cache that is emptied all the time gives what whole texts give."""
    with open(JSON, encoding="utf-8") as j, open(MODEL, "rb") as m:
        aligner = alignment.Aligner(j.read(), library_classes(), m.read())
    assert aligner.b.by_word
    aligner.a.known.limit = aligner.b.known.limit = 50
    given = [t for t in texts() if t]
    out = aligner.column(pa.array(given))
    whole = [plain_groups(libraries, t) for t in given]
    assert out["n_b"].to_pylist() == [sum(len(g[1]) for g in w) for w in whole]
    aligner.b.by_word = False
    aligner.b.known.clear()
    again = aligner.column(pa.array(given))
    assert all(out[k].equals(again[k]) for k in out)


def test_products_of_sparse_matrices(monkeypatch):
    from tomewright.llm import csr

    rng = np.random.default_rng(0)
    for products in (1 << 20, 7):
        monkeypatch.setattr(csr, "PRODUCTS", products)
        for n, m, k in ((5, 7, 6), (1, 1, 1), (0, 3, 2), (4, 3, 0), (20, 9, 30)):
            places = [rng.integers(0, max(s, 1), (2, 25 if min(p) else 0))
                      for s, p in ((9, (n, m)), (9, (m, k)))]
            x = Csr.of(places[0][0] % max(n, 1), places[0][1] % max(m, 1), n, m)
            y = Csr.of(places[1][0] % max(m, 1), places[1][1] % max(k, 1), m, k)

            def dense(c, height, width):
                out = np.zeros((height, width), int)
                out[c.rows, c.columns] = c.values
                return out

            got = np.zeros((n, k), int)
            for rows, columns, values in x.times(y):
                assert not got[rows, columns].any()
                got[rows, columns] = values
            assert (got == dense(x, n, m) @ dense(y, m, k)).all()
            assert (dense(x.transposed(), m, n) == dense(x, n, m).T).all()
