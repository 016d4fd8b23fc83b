"""Near-duplicate groups against all pairs, hot groups and odd rows included."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchmart.llm import minhash

from .helpers import SMALL, docs_frame, table


def _set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: _set(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {p for ids in by.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def _check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == brute(rows)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()]
    df = minhash.query(spark, SMALL)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    _check(df, rows)


def test_a_hot_group_of_near_copies(spark):
    """Copies of one text with edits of their own: the first is linked to few of the others."""
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in r.integers(0, 500, 150)]
    rows = []
    for i in range(90):
        t = list(base)
        for k in r.integers(0, len(t), i % 5):
            t[k] = f"e{i}-{k}"
        rows.append((i, " ".join(t)))
    _check(minhash.near_groups(docs_frame(spark, rows[::-1])), rows)


def test_odd_rows(spark):
    long = " ".join(f"word{k % 700}x{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "one two three four five"),
            (7, "One two  three\nfour five"), (8, long), (9, long + " more"), (10, "É a b c d"), (11, "é a b c d"),
            (12, "a b c"), (13, "a b c")]
    _check(minhash.near_groups(docs_frame(spark, rows)), rows)
    assert minhash.near_groups(docs_frame(spark, [])).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (3, "other words here"), (None, "a b c d e f"), (None, "z y")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in minhash.near_groups(docs_frame(spark, rows)).collect()
                 if r.component_id is not None)
    assert got == [(0, 2, 3), (3, 1, 3), (3, 2, 3), (3, 2, 3)]


def test_survivors_keep_their_columns(spark):
    docs = docs_frame(spark, [(2, "a b c d e f"), (1, "A b c d e f"), (5, "x")]).selectExpr("*", "doc_id AS stay_id")
    kept = minhash.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_survivors_of_repeated_and_null_ids(spark):
    """Ids that name several texts, or none, cost no group its document."""
    rows = [(3, "a b c d e f"), (3, "A b c d e f"), (3, "other words here"), (None, "a b c d e f"), (None, "z y"),
            (None, "z Y"), (None, "no id either"), (None, None), (None, ""), (4, " "), (4, ""), (7, "Other words here")]
    want = [(3, "other words here"), (None, "no id either"), (None, None), (None, ""), (4, " "), (4, "")]
    runs = []
    for order in (rows, rows[::-1]):
        got = [(r.doc_id, r.text) for r in minhash.survivors(docs_frame(spark, order)).collect()]
        runs.append(sorted(got, key=repr))
    assert runs[0] == runs[1] and len(runs[0]) == len(want) + 2
    assert {x for x in runs[0] if x in want} == set(want)
    rest = [x for x in runs[0] if x not in want]
    assert {(i, t.lower()) for i, t in rest} == {(3, "a b c d e f"), (None, "z y")}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.85, 1.0])
def test_estimate_is_corrected_for_chance(share):
    a, b = minhash._coefficients()
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 4000, dtype=np.uint64)
    n = int(1000 * 2 * share / (1 + share))
    x, y = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:n], pool[1000:2000 - n]]))
    low = [minhash.minima(s, a, b).astype(np.uint8) for s in (x, y)]
    assert minhash.estimate(*low) == pytest.approx(share, abs=0.13)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 3000, 400, dtype=np.uint64) * np.uint64(7919)) for _ in range(2))
        a, b = (np.frombuffer(minhash.bitmap(s), np.uint8) for s in (x, y))
        assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_columns_with_clashing_names(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base + " more"), (3, base), (4, "something else entirely, five words"), (5, None)]
    df = docs_frame(spark, rows)
    for name in ("n", "node", "sig", "bands", "part", "least_id", "component_id", "shingles", "wanted", "key"):
        df = df.withColumn(name, F.lit("x"))
    _check(minhash.near_groups(df).select("doc_id", "n_shingles", "component_id"), rows)
    kept = minhash.survivors(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
