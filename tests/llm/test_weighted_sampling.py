"""Consistent weighted sampling against exact similarities and a plain ordering."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchmart.llm import weighted_sampling as cws

from .helpers import SMALL, docs_frame, table


def _jaccard(x, y):
    a, b = (Counter(t.lower().split()) for t in (x, y))
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_the_generalised_jaccard_similarity():
    r = np.random.default_rng(0)
    pairs = []
    for n in range(150):  # words of its own for each pair: independent draws
        words = [f"w{n}-{i}" for i in range(60)]
        x = [words[k] for k in r.zipf(1.6, 120) % 60]
        y = x[: r.integers(0, 120)] + [words[k] for k in r.integers(0, 60, r.integers(1, 120))]
        pairs.append((" ".join(x), " ".join(y)))
    a, b = (cws.fingerprints(pa.array(list(t))) for t in zip(*pairs))
    error = cws.likeness(a, b) - np.array([_jaccard(*p) for p in pairs])
    assert abs(error.mean()) < 0.012
    assert error.std() < 1.3 * 0.5 / np.sqrt(cws.K)


def test_prints_do_not_depend_on_the_slice():
    texts = [f"a{i} b{i % 3} b{i % 3} c" for i in range(40)] + ["", "  ", "A a"]
    together = cws.fingerprints(pa.array(texts))
    assert all((cws.fingerprints(pa.array([t]))[0] == together[i]).all() for i, t in enumerate(texts))


def _plain(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        out[i] = (t, t[:len(t) - half] + after[:half], after)
    return out


def _check(got, rows):
    want = _plain(rows)
    assert len(got) == len(rows)
    texts = list(dict.fromkeys(t for v in want.values() for t in v))
    prints = dict(zip(texts, cws.fingerprints(pa.array(texts))))
    for r in got.itertuples():
        t, new, after = want[r.doc_id]
        p, q, n = prints[t], prints[new], prints[after]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert bytes(r.fingerprint) == (p[:-1].tobytes() if p[-1] else b"")
        assert bytes(r.edited_fingerprint) == (q[:-1].tobytes() if q[-1] else b"")
        assert r.near_edited == pytest.approx(cws.likeness(p[None], q[None])[0])
        assert r.near_next == pytest.approx(cws.likeness(p[None], n[None])[0])


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    _check(cws.neighbours(table(spark, "documents")).toPandas(), rows)
    shown = cws.query(spark, SMALL)
    assert dict(shown.dtypes)["fingerprint"] == "string" and shown.count() == len(rows)


def test_odd_rows(spark):
    rows = [(5, None), (9, "é" * 3001), (2, ""), (7, "one word"), (3, " \n "), (1, "one word"), (8, "x " * 20000)]
    _check(cws.neighbours(docs_frame(spark, rows)).toPandas(), rows)
    one = cws.neighbours(docs_frame(spark, [(4, "alone here now")])).first()
    assert one.near_edited > 0 and one.near_next == 1
    assert cws.neighbours(docs_frame(spark, [])).count() == 0
    twice = cws.neighbours(docs_frame(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).toPandas()
    assert len(twice) == 4 and twice.doc_id.isna().sum() == 2


def test_columns_with_clashing_names(spark):
    rows = [(5, None), (9, "some words here"), (2, "other words there and here")]
    df = docs_frame(spark, rows)
    for name in ("row", "part", "place", "next", "print", "fingerprint", "edited", "near_next", "id"):
        df = df.withColumn(name, F.lit("x"))
    _check(cws.neighbours(df).toPandas(), rows)
