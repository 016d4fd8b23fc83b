"""Toxicity: exact gradients, all windows, held-out accuracy, odd inputs."""

import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchmart.llm import toxicity as tox

from .helpers import docs_frame

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
INSULTS = ["stupid", "moron", "scum"]


def _corpus(n=240, seed=3):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(list("aeioulmnrst"), r.integers(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [words[k] for k in r.integers(0, len(words), r.integers(5, 150))]
        bad = i % 3 == 0
        if bad:
            text[r.integers(0, len(text))] = str(r.choice([*INSULTS, "vequ" + words[r.integers(0, 400)]]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_gradients_match_differences():
    net = tox.Net(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    distinct, codes, _ = net.windows(pa.array(["one two three", " ".join(f"w{i}" for i in range(70))]))
    f = tox.features(distinct)
    y, w = np.arange(len(codes)) % 2.0, np.ones(len(codes))
    _, g = net.gradients(f, codes, y, w)
    for name, value in net.p.items():
        flat, i = value.reshape(-1), np.abs(g[name]).argmax()
        old, ends = flat[i], []
        for h in (1e-3, -1e-3):
            flat[i] = old + h
            ends.append(net.gradients(f, codes, y, w)[0])
        flat[i] = old
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[name].reshape(-1)[i], rel=0.02, abs=1e-6)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 56, 57, 100, 1000])
def test_windows_cover_every_word(n):
    text, first, size = tox.window_table(np.array([0, n]))
    seen = np.zeros(n, int)
    for a, m in zip(first, size):
        seen[a:a + m] += 1
    assert (seen > 0).all() and len(text) == (0 if n == 0 else max(0, -(-(n - tox.T) // tox.STRIDE)) + 1)
    assert (size[:-1] == tox.T).all()


def test_score_is_the_largest_window_whatever_surrounds_it():
    net = tox.Net(2)
    texts = ["a b c", "", "x " * 500, "..."]
    together = net.logits(pa.array(texts))
    assert np.allclose(together, [net.logits(pa.array([t]))[0] for t in texts], atol=1e-5, equal_nan=True)
    assert np.isneginf(together[[1, 3]]).all() and net.score(pa.array(["", None]).fill_null(""))[0] == 0


def test_held_out_accuracy(spark):
    rows, labels = _corpus(900)
    docs = docs_frame(spark, rows)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = tox.fit(docs, frame)
    got = {r.doc_id: r.score for r in tox.scores(docs, net).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 3 == 0) for i in held)
    assert right >= 0.85 * len(held)
    assert all(0 <= s <= 1 for s in got.values())
    kept = {r.doc_id for r in tox.clean(docs, net).collect()}
    assert kept == {i for i, s in got.items() if s < tox.THRESHOLD}


def test_held_out_labels_change_nothing(spark):
    rows, labels = _corpus(90)
    docs = docs_frame(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (tox.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p) and one.curve == two.curve


def test_odd_tables(spark):
    docs = docs_frame(spark, [(1, None), (1, ""), (None, "word"), (2, "long " * 30000)])
    labels = spark.createDataFrame([(1, 1, None), (9, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    net = tox.fit(docs, labels)
    assert [r.score for r in tox.scores(docs, net).collect()] == [0.0] * 4
    extra = docs.withColumns({"score": docs.doc_id, "id": docs.text})
    assert tox.clean(extra, net).columns == extra.columns and tox.clean(extra, net).count() == 4
    assert tox.scores(docs_frame(spark, []), net).count() == 0


def test_a_short_passage_lies_whole_in_a_window_wherever_it_is():
    """Half a window of words, at every place of a text."""
    text, first, words = tox.window_table(np.array([0, 200]))
    for at in range(200 - tox.T // 2 + 1):
        assert ((first <= at) & (at + tox.T // 2 <= first + words)).any()


def plain_logits(net, text):
    """The forward pass of every window of one text, word by word, without any batching."""
    p, H = net.p, tox.H
    words = re.findall(r"[^\W_]+", text.lower())
    n = len(words)
    starts = sorted({min(k * tox.STRIDE, max(n - tox.T, 0)) for k in range(max(0, -(-(n - tox.T) // tox.STRIDE)) + 1)})
    out = []

    def gru(inputs, u):
        h, states = np.zeros(H), []
        for x in inputs:
            g = h @ u
            z, r = (1 / (1 + np.exp(-(x[a:a + H] + g[a:a + H]))) for a in (0, H))
            new = np.tanh(x[2 * H:] + r * g[2 * H:])
            h = new + z * (h - new)
            states.append(h)
        return states

    for s in starts if n else []:
        gates = []
        for w in words[s:s + tox.T]:
            f = tox.features([w])
            grams = p["Ec"][f.gram].sum(axis=0) / np.sqrt(len(f.gram))
            gates.append(np.concatenate([p["Ew"][f.word[0]], grams]) @ p["W"] + p["b"])
        ahead = gru([g[:3 * H] for g in gates], p["Uf"])
        back = gru([g[3 * H:] for g in gates[::-1]], p["Ub"])[::-1]
        states = [np.concatenate(pair) for pair in zip(ahead, back)]
        weight = np.exp([np.tanh(x @ p["Wa"]) @ p["va"] for x in states])
        out.append(sum(a * x for a, x in zip(weight / weight.sum(), states)) @ p["u"] + p["c"][0])
    return out


def test_scores_are_those_of_a_plain_forward_pass(spark, monkeypatch):
    rows, labels = _corpus()
    net = tox.train([t for _, t in rows], np.array([y for _, _, y in labels]))
    texts = [rows[0][1], rows[1][1], "", "One,two; THREE!", " ".join(t for _, t in rows[:5])]
    want = [1 / (1 + np.exp(-(net.curve[0] * max(plain_logits(net, t)) + net.curve[1]))) if plain_logits(net, t) else 0
            for t in texts]
    assert net.score(pa.array(texts)) == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(tox, "SLICE", 50)
    assert net.score(pa.array(texts)) == pytest.approx(want, abs=1e-5)
    df = docs_frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r.score for r in tox.scores(df, net).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-5)
    kept = tox.clean(df.withColumn("score", F.lit("x")).withColumn("Text2", F.lit(1)), net, 0.3)
    assert kept.columns == [*df.columns, "score", "Text2"]
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, w in enumerate(want) if w < 0.3]


def test_memory_follows_neither_rows_nor_their_length():
    """4,096 texts of 5,000 words (some 120 MB) score within 250 MB more than their own size."""
    script = """
import resource, numpy as np, pyarrow as pa
from matchmart.llm import toxicity as tox
r = np.random.default_rng(1)
words = np.array(["".join(r.choice(list("aeioulmnrst"), 5)) for _ in range(3000)])
texts = pa.array([" ".join(words[r.integers(0, 3000, 5000)]) for _ in range(4096)])
net = tox.Net(1)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
net.forward = lambda gates, codes: np.zeros(len(codes), np.float32)
assert len(net.score(texts)) == 4096
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=ROOT)
    assert int(out.stdout) < 250
