"""Quality: statistics against plain ones, sums against a direct fit, held-out accuracy."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tomewright.llm import arrays as A
from tomewright.llm import quality as Q
from tomewright.llm.frames import remainder
from tests.llm.helpers import frame, odd_documents, spaced

SF = "/root/testdata/sf0.1"


def plain(text):
    raw, words = text.encode(), spaced(text)
    cased = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in re.findall("[^\n]+", text)]
    size, n = len(raw), len(words)
    lengths = [len(w.encode()) for w in words]
    kinds = Counter(Q._KINDS[b] for b in raw)
    runs = [tuple(words[k:k + 5]) for k in range(n - 4)]
    mean = sum(lengths) / max(n, 1)
    spread = max(sum(v * v for v in lengths) / max(n, 1) - mean ** 2, 0) ** 0.5
    low_lines = [re.sub("[A-Z]", lambda m: m[0].lower(), line) for line in lines]
    last = [Q._KINDS[w.encode()[-1]] for w in cased]
    upper = [re.search("[A-Z].*[A-Z]", w) and not re.search(r"[a-z\x80-\U0010ffff]", w)
             for w in cased]
    return [np.log1p(size), np.log1p(n), np.log1p(len(lines)),
            *(kinds[k] / max(size, 1) for k in range(8)), np.log1p(mean), np.log1p(spread),
            np.log1p(max(lengths, default=0)),
            sum(bool(re.match("[A-Z]", w)) for w in cased) / max(n, 1),
            sum(map(bool, upper)) / max(n, 1),
            sum(not re.search(r"[A-Za-z0-9\x80-\U0010ffff]", w) for w in cased) / max(n, 1),
            sum(k == Q._SIGN for k in last) / max(n, 1), len(set(words)) / max(n, 1),
            max(Counter(words).values(), default=0) / max(n, 1),
            sum(a == b for a, b in zip(words, words[1:])) / max(n, 1),
            1 - len(set(runs)) / len(runs) if runs else 0,
            1 - len(set(low_lines)) / len(lines) if lines else 0,
            np.log1p(size / max(len(lines), 1))]


def test_statistics():
    texts = [t or "" for _, t in odd_documents()] + [
        "A b a b a b a b a\nSAME line\n\nsame LINE\n", "x!! Y$$ Zz## ...", "é É\n-- 12 a1", "\n\n"]
    data, offsets = A.text_buffer(pa.array(texts))
    got = np.concatenate([Q.statistics(data, offsets[a:b + 1]) for a, b in A.row_blocks(offsets)])
    assert got.shape == (len(texts), len(Q.NAMES))
    for k, text in enumerate(texts):
        assert np.allclose(got[k], plain(text), atol=1e-9), text[:40]


def test_isotonic():
    rng = np.random.default_rng(3)
    for _ in range(50):
        total = rng.integers(0, 4, 12).astype(float)
        total[rng.integers(12)] += 1
        ones = np.minimum(rng.integers(0, 4, 12), total)
        first, last, share = Q.isotonic(total, ones)
        assert (np.diff(share) > 0).all() and (first[1:] > last[:-1]).all()
        # The best rising fit: the largest over starts of the least mean over ends.
        used = np.flatnonzero(total)
        for k in used:
            best = max(min(ones[i:j + 1].sum() / total[i:j + 1].sum() for j in used if j >= k)
                       for i in used if i <= k)
            at = np.flatnonzero((first <= k) & (k <= last))
            assert share[at[0]] == pytest.approx(best)


def test_sums_are_those_of_a_direct_fit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 1500")
    measured = Q.measure(docs.select("doc_id", "text")).drop("text").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(measured, labels)
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in measured.collect() if r["doc_id"] in y]
    x = np.array([r["stats"] for r in rows])
    target = np.array([float(y[r["doc_id"]]) for r in rows])
    z = model.features(x)
    assert np.allclose(model.features.mean, x.mean(axis=0))
    direct = []
    for penalty in Q._PENALTIES:
        hold = penalty * len(x) * np.diag([1.0] * Q.FEATURES + [0.0])
        direct.append(np.linalg.solve(z.T @ z + hold + 1e-9 * np.eye(len(hold)), z.T @ target))
    assert min(np.abs(z @ w - z @ model.weights).max() for w in direct) < 1e-6
    # The kernel: products of features come near the Gaussian of the distance.
    s = np.clip((x - model.features.mean) / model.features.scale, -6, 6)
    i, j = np.random.default_rng(0).integers(0, len(x), (2, 2000))
    gauss = np.exp(-((s[i] - s[j]) ** 2).sum(axis=1) / (2 * x.shape[1]))
    assert np.abs((z[i, :-1] * z[j, :-1]).sum(axis=1) - gauss).mean() < 0.1
    measured.unpersist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    measured = Q.measure(docs).drop("text")
    model = Q.train(measured, labels.where(remainder("doc_id", 3) != 1))
    held = (Q.score(measured, model).join(labels, "doc_id")
            .where(remainder("doc_id", 3) == 1).collect())
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    right = sum(r["predicted"] == r["quality"] for r in held) / len(held)
    assert right > 0.97, right
    above = np.mean([np.mean(np.array(good) > b) + 0.5 * np.mean(np.array(good) == b) for b in bad])
    assert above > 0.97, above
    # Calibrated: chances add up to the ones that are there.
    assert abs(np.mean([r["score"] for r in held]) - len(good) / len(held)) < 0.03


@pytest.mark.parametrize("labels,constant", [
    ([], 0.5), ([(1, 1), (4, 1)], 1.0), ([(1, 0), (None, 1), (2, None)], 0.0)])
def test_too_few_labels(spark, labels, constant):
    measured = Q.measure(frame(spark, odd_documents()))
    model = Q.train(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    rows = Q.score(measured, model).collect()
    assert len(rows) == len(odd_documents())
    assert {r["score"] for r in rows} == {constant}
    assert {r["ids"] for r in rows} == {"kept"}


def test_odd_documents(spark):
    rows = odd_documents() + [(100 + k, f"!! ##{k} $$ %%" * (k + 1) if k % 2 else
                               "some plain words here " * (k + 1)) for k in range(60)]
    labels = spark.createDataFrame([(100 + k, (k + 1) % 2) for k in range(60)] + [(6, 1), (6, 0)],
                                   "doc_id long, quality int")
    measured = Q.measure(frame(spark, rows))
    model = Q.train(measured, labels)
    done = Q.score(measured, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in done)
    assert all(r["predicted"] == (r["doc_id"] + 1) % 2 for r in done if (r["doc_id"] or 0) >= 100)
    by_text = {}
    for r in done:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    empty = Q.measure(frame(spark, []))
    assert Q.score(empty, model).collect() == []
