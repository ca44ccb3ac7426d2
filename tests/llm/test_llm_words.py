"""Words by array operations against regular expressions, and what is built on them."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tomewright.llm import arrays as A
from tomewright.llm import decontaminate, fingerprints, licenses
from tests.llm.helpers import alnum, frame, lower, odd_documents, spaced


@pytest.mark.parametrize("keep,plain", [(A.ALNUM, alnum), (A.NOT_SPACE, spaced)])
def test_words(keep, plain):
    rng = random.Random(3)
    letters = [" ", "\n", "a", "B", "9", "é", "漢", ".", "\x0b", "\x1c", "Z", "　", "{"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += [t for _, t in odd_documents()]
    seen = {}
    for at, to, words in A.block_words(pa.array(texts), keep):
        for r in range(at, to):
            lo, hi = words.first[r - at], words.first[r - at + 1]
            assert [words.text(k).decode() for k in range(lo, hi)] == plain(texts[r])
            for k in range(lo, hi):
                assert seen.setdefault(int(words.hash[k]), words.text(k)) == words.text(k)


def test_runs_of_words_have_one_hash():
    words = A.words_of(*A.text_buffer(pa.array(["a b c a b c", "b c"])), A.ALNUM)
    at, hashes = A.windows(words, 2)
    assert at.tolist() == [0, 1, 2, 3, 4, 6]
    assert hashes[1] == hashes[4] == hashes[5] and len(set(hashes.tolist())) == 3


def plain_hits(texts, items, n=10):
    out = []
    for _, text in texts:
        words, hit, found = alnum(text), set(), set()
        for item, item_text in items:
            w = alnum(item_text)
            size = min(n, len(w))
            windows = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if size else set()
            for k in range(len(words) - size + 1 if size else 0):
                if tuple(words[k:k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found.add(item)
        out.append((len(words), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 25))))
             for i in range(30)] + [(30, None), (31, ""), (32, "Tiny Item"), (32, "tiny ITEM again")]
    texts = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            source = alnum(items[rng.randrange(30)][1])
            a = rng.randint(0, len(source) - 1)
            words[len(words) // 2:len(words) // 2] = source[a:a + rng.randint(5, 20)]
        texts.append((i, ", ".join(words).upper()))
    return texts + [(200, "a tiny-item!"), (201, "tiny"), *odd_documents()], items


@pytest.mark.parametrize("max_windows", [10**6, 60])
def test_benchmark_hits(spark, leaked, max_windows):
    texts, items = leaked
    found = decontaminate.find_benchmark(
        frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"),
        max_windows=max_windows).withColumn("hit", decontaminate.n_hit())
    rows = found.collect()
    assert [r.ids for r in rows] == ["kept"] * len(texts)
    assert [(r.n_words, r.hit, r.item_ids) for r in rows] == plain_hits(texts, items)


def test_removal(spark, leaked):
    texts, items = leaked
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_benchmark(frame(spark, texts), benchmark)
    clean = [i for (i, _), (_, hit, _) in zip(texts, plain_hits(texts, items), strict=True)
             if not hit]
    assert [r.doc_id for r in decontaminate.remove_documents(found).collect()] == clean
    cut = decontaminate.remove_spans(found)
    assert [r.text for r in cut.where("doc_id = 200").collect()] == ["a  !"]
    hits = plain_hits(texts, items)
    for r, (_, text), (words, hit, _) in zip(cut.collect(), texts, hits, strict=True):
        if hit:
            assert len(alnum(r.text)) == words - hit
        else:
            assert r.text == text
    none = decontaminate.find_benchmark(frame(spark, []), benchmark.where("false"))
    assert none.collect() == []


def test_license_base(spark):
    texts = odd_documents() + [
        (20, "MIT License. Apache license; the GNU General Public License mit-license cc by cc-by"),
        (21, "mit. License gnu general public"), (22, "CC BY")]
    rows = licenses.scan_licenses(frame(spark, texts)).collect()
    for (_, text), r in zip(texts, rows, strict=True):
        words, places, labels = alnum(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k:k + len(p)] == p:
                    places.append(k)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), sorted(labels))
        assert (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
    ("Licensed under the Apache License, Version 2.", set()),
    ("licensed under the apache license version 2.0 (the license); you may not use this file "
     "except in compliance with the license", {"apache-2.0"}),
    ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
    ("licensed under the terms of the GNU general public license version 2", {"gpl-2.0"}),
    ("This one two three four licensed under GNU General Public License", set()),
    ("Released under the MIT License.", {"mit-notice"}),
    ("Released beneath the MIT License.", set()),
    ("Licensed under CC BY-NC 4.0.", {"cc-by-nc"}),
    ("licensed under a Creative Commons BY 4.0", {"cc-by-4.0"}),
    ("Copyright (c) 1999 A. B. " + " ".join(licenses.wording(licenses.TEMPLATES["isc"])[7:]),
     {"isc"}),
    (licenses.TEMPLATES["bsd"].replace("provided", "as long"), set())])
def test_templates(text, labels):
    matcher, words = licenses.Matcher(licenses.TEMPLATES), licenses.wording(text)
    got = {label for k in range(len(words)) for label, accepted, _ in matcher.run(
        words.__getitem__, k, len(words)) if accepted}
    assert got == labels


def test_template_regions():
    matcher = licenses.Matcher({"t": "start [[maybe [[inner]] more]] {{x=a b|c}} {{y:1-2}} end"})

    def accepts(text):
        words = text.split()
        return any(a for k in range(len(words)) for _, a, _ in matcher.run(
            words.__getitem__, k, len(words)))

    assert all(map(accepts, ["start c q end", "start maybe more a b q q end",
                             "start maybe inner more c 1 2 end", "z start c end end"]))
    assert not any(map(accepts, ["start c end", "start maybe c q end", "start a q end",
                                 "start inner c q end", "start c 1 2 3 end"]))


def plain_fingerprint(text, level):
    data = (text or "").encode()
    return hashlib.sha256(data).hexdigest() + str(level)


def test_fingerprints(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(20_000))
    other = "".join(rng.choice("abcdefgh \n") for _ in range(20_000))
    edited = base[:9000] + "CHANGED" + base[9100:]
    a, b, c, d = fingerprints.fingerprint_column(pa.array([base, edited, other, base]))
    assert a == d and a != b
    assert fingerprints.likeness(a, b) > 0.8 > 0.3 > fingerprints.likeness(a, c)
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness("3::", "3::") == 1
    doubled = fingerprints.fingerprint_column(pa.array([base + base[:15_000]]))[0]
    assert fingerprints.likeness(a, doubled) > 0.4
    # Signatures do not depend on what else is in a block.
    texts = [t for _, t in odd_documents()]
    alone = [fingerprints.fingerprint_column(pa.array([t], pa.string()))[0] for t in texts]
    assert fingerprints.fingerprint_column(pa.array(texts, pa.string())) == alone


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        x, y = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 15))) for _ in "xy")
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(
                    table[i, j + 1], table[i + 1, j])
        assert fingerprints._common(x, y) == table[-1, -1]


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_next_document(spark, ranges):
    rng = random.Random(1)
    texts = [(i * 3, "".join(rng.choice("aé漢 b") for _ in range(rng.randint(0, 50))))
             for i in range(60)] + [(1000, None), (1001, ""), (1002, "abcdef" * 30_000)]
    rng.shuffle(texts)
    rows = fingerprints.compare_with_next(frame(spark, texts), ranges).collect()
    ordered = sorted(texts, key=lambda x: -x[0])
    want = {}
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, after = t or "", after or ""
        k = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[:len(t) - k] + after[:k]).encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    assert len(rows) == len(texts)


def test_next_document_odd(spark):
    texts = odd_documents()
    rows = fingerprints.compare_with_next(frame(spark, texts), 3).collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in texts)
    assert fingerprints.compare_with_next(frame(spark, [])).collect() == []
    one = fingerprints.compare_with_next(frame(spark, [(5, "abcdef")])).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(6, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_lower():
    assert lower("AÉz") == "aÉz"
