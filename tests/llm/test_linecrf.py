"""Line chain: marginals, gradient and features against brute force, held-out
accuracy, edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import linecrf

DOCS = "doc_id long, text string, lang string, quality int, score double, x string, y int, h long"


def brute_marginals(unary, first, bad, good):
    u = list(unary)
    u[0] += first
    total = [0.0, [0.0] * len(u)]
    for labels in itertools.product((0, 1), repeat=len(u)):
        s = sum(u[k] for k, y in enumerate(labels) if y)
        s += sum(bad if a == b == 0 else good if a == b == 1 else 0.0 for a, b in zip(labels, labels[1:]))
        w = math.exp(s)
        total[0] += w
        for k, y in enumerate(labels):
            total[1][k] += w * y
    return [x / total[0] for x in total[1]], math.log(total[0])


@pytest.mark.parametrize("n", [1, 2, 7])
def test_marginals_match_enumeration(n):
    rng = np.random.default_rng(n)
    u = rng.normal(0, 2, n)
    rest = np.array([0.0, 0.7, 1.3, 0.4])
    chain = linecrf.Chain(np.zeros(1), np.ones(1), np.ones(1), rest)
    assert np.allclose(chain.marginals(u.copy()), brute_marginals(u, *rest[1:])[0], atol=1e-9)


def test_loss_matches_enumeration_and_gradient_matches_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9)
    at = np.array([[0, 5, 8], [1, 6, -1], [2, 7, -1], [3, -1, -1], [4, -1, -1]])
    p = rng.normal(size=8)
    loss, grad = linecrf.loss_and_gradient(p, x, at, y, 0.01)
    want = 0.0
    for k in range(3):
        rows = at[:, k][at[:, k] >= 0]
        u = x[rows] @ p[:4] + p[4]
        z = brute_marginals(u, *p[5:])[1]
        labels = y[rows]
        gold = (u * labels).sum() + p[5] * labels[0] + sum(p[6] if a == b == 0 else p[7] if a == b == 1 else 0 for a, b in zip(labels, labels[1:]))
        want += z - gold
    assert loss == pytest.approx(want / 9 + 0.005 * (p ** 2).sum())
    for k in range(8):
        step = np.eye(8)[k] * 1e-6
        slope = (linecrf.loss_and_gradient(p + step, x, at, y, 0.01)[0] - linecrf.loss_and_gradient(p - step, x, at, y, 0.01)[0]) / 2e-6
        assert slope == pytest.approx(grad[k], abs=1e-6)


def features(texts):
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return linecrf.line_features(np.frombuffer(b"".join(data), dtype=np.uint8), offsets)


def test_line_features_match_plain_counts(monkeypatch):
    texts = ["Ab c1\n\n  \nxx xx xx!\nAb c1", "", "one", "\n\n", "é|é\rz\n" * 3, " "]
    x, size, doc = features(texts)
    lines = [(k, line) for k, t in enumerate(texts) for line in t.split("\n") if line.strip(" \t\n\r\v\f")]
    assert doc.tolist() == [k for k, _ in lines] and size.tolist() == [len(s.encode()) for _, s in lines]
    for row, (_, line) in zip(x, lines):
        raw = line.encode()
        for b in range(256):
            if b != 10:
                same = sum(linecrf._class[c] == linecrf._class[b] for c in raw)
                assert row[linecrf._class[b]] == pytest.approx(math.sqrt(same / len(raw)))
        pairs = np.zeros((8, 8))
        for a, b in zip(raw, raw[1:]):
            pairs[linecrf._coarse[a], linecrf._coarse[b]] += 1
        got = row[linecrf.CLASSES:linecrf.CLASSES + 64].reshape(8, 8)
        assert np.allclose(got, np.sqrt(pairs / max(1, len(raw) - 1)), atol=1e-6)
    own = x[:, linecrf.CLASSES + 64:linecrf.COLUMNS]
    assert own[1, 3] == pytest.approx(math.sqrt(1 / 2))         # xx xx xx!: one of two steps repeats
    assert own[1, 4] == pytest.approx(2 / 3)
    assert own[[0, 2], 5] == pytest.approx([math.log(2)] * 2) and own[1, 5] == 0
    assert x[0, linecrf.COLUMNS + linecrf.AROUND] == 0 and x[1, linecrf.COLUMNS + linecrf.AROUND] == 1
    monkeypatch.setattr(linecrf, "CHUNK", 3)                     # the same in small pieces
    assert np.array_equal(features(texts)[0], x)


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 14))).capitalize() + "."     # noqa: E731
    junk = [lambda: " | ".join(word() for _ in range(9)), lambda: " ".join(word() + "###" for _ in range(9)), lambda: " ".join([word()] * 12)]
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.7)
        lines = [good() if y or rng.random() < 0.25 else rng.choice(junk)() for _ in range(rng.randint(2, 9))]
        if not y:
            lines.append(junk[k % 3]())
        rows.append((k, "\n".join(lines), "en", y, 0.5, "a", 1, 2))
    return rows


def test_held_out_documents_of_bad_lines_are_found(spark):
    docs = spark.createDataFrame(corpus(900), DOCS)
    model = linecrf.learn(docs, docs.select("doc_id", "quality"))
    held = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0)
    got = linecrf.score(held, model, keep=["doc_id", "quality"]).collect()
    assert len(got) > 100 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in got)


def test_scores_of_odd_texts(spark):
    train = spark.createDataFrame(corpus(300, 1), DOCS)
    model = linecrf.fit(train)
    texts = [None, "", " \n\t\n", "A plain line of words.", "A plain line of words.", "x" * 300_000, "\n".join(["a | b | c | d"] * 30_000), "\u0000é日本"]
    rows = [(k if k else None, t, None, None, None, None, None, None) for k, t in enumerate(texts)]
    got = {r.doc_id or 0: r for r in linecrf.score(spark.createDataFrame(rows, DOCS).repartition(3), model, keep=["doc_id", "x"]).collect()}
    share = np.mean([r[3] for r in {r[1]: r for r in corpus(300, 1)}.values()])
    assert [got[k].score for k in range(3)] == pytest.approx([share] * 3) and got[0].line_quality is None
    assert got[3].score == got[4].score and len(got) == len(texts)
    assert got[6].score < 0.3 < got[3].score


def test_nothing_to_learn_and_nothing_to_score(spark):
    empty = spark.createDataFrame([], DOCS)
    model = linecrf.fit(empty)
    one = spark.createDataFrame(corpus(5), DOCS)
    assert {r.score for r in linecrf.score(one, model, keep=["doc_id"]).collect()} == {0.5}
    only = linecrf.fit(one.withColumn("quality", F.lit(1)))
    assert all(r.score > 0.9 for r in linecrf.score(one, only, keep=["doc_id"]).collect())
    assert linecrf.score(empty, only).collect() == []
