"""SimHash groups against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from matchmart.llm import simhash
from tests.llm.helpers import SMALL, docs_frame, table


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    n = len(words)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, n - 2))] if n else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_parts(prints):
    """Least member of each value's component, by comparing all pairs."""
    prints = sorted(set(prints))
    head = {p: p for p in prints}

    def top(p):
        while head[p] != p:
            p = head[p]
        return p

    a = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            x, y = sorted((top(p), top(prints[j])))
            head[y] = x
    return {p: top(p) for p in prints}


def plain_groups(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    parts = plain_parts([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[parts[p]] = min(i, least.get(parts[p], i))
    return sorted(((i, f"{p:016x}", least.get(parts[p])) for i, p in prints), key=repr)


def got(df):
    return sorted(((r["doc_id"], f"{r['print'] % 2**64:016x}", r["component_id"])
                   for r in simhash.near_groups(df).collect()), key=repr)


def test_code_is_perfect_and_keys_meet():
    golay = simhash.Golay()
    codewords = np.flatnonzero(simhash._syndrome(np.arange(1 << 23)) == 0)
    assert len(codewords) == 1 << 12
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    for w, i in zip(words, golay.index(words)):
        near = codewords[np.bitwise_count(codewords ^ w) <= 3]
        assert len(near) == 1 and near[0] >> 11 == i
    row, _ = golay.keys(words)
    assert set(np.bincount(row)) <= {1, 6}
    for _ in range(300):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(k) for k in rng.choice(63, 2, replace=False))
        pair = np.array([a, b], np.int64)
        row, key = simhash.fingerprint_keys(pair)
        assert set(key[row == 0]) & set(key[row == 1])


def test_defined_cases(spark):
    rows = [(5, None), (4, ""), (3, " \t\n"), (9, "One"), (8, "one"), (7, "a B"), (2, "a b c d é"), (2, "a b c d é"),
            (None, "a b c d é"), (None, "lonely words stand here"), (1, "x " * 4000), (6, "y\x0bz\x1cw q")]
    assert got(docs_frame(spark, rows)) == plain_groups(rows)
    assert simhash.near_groups(docs_frame(spark, rows[:1]).limit(0)).count() == 0


def test_clashing_columns_and_blocks(spark, monkeypatch):
    rows = [(1, "the quick brown fox " * 9), (2, "the quick brown fox " * 9), (3, "other")]
    df = docs_frame(spark, rows)
    for name in ("print", "key", "node", "part", "members", "mid", "component_id"):
        df = df.withColumn(name, F.lit("x"))
    assert got(df) == plain_groups(rows)
    text = "".join(random.Random(3).choice("abc  \n") for _ in range(5000)).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(text)))
    blocks = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda data: blocks(data, 7))
    assert (np.concatenate(list(simhash.shingle_hashes(text))) == whole).all()


def test_given_documents(spark):
    df = table(spark, "documents")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(df) == plain_groups(rows)


@pytest.mark.parametrize("crowd", [1, 64, 10**6])
def test_links_in_crowds(spark, monkeypatch, crowd):
    """Chains and crowds of near fingerprints: the components are those of all pairs."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(7)
    prints = {0, 2**64 - 1, 1 << 63}
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(30))
                   for _ in range(60)}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    frame = spark.createDataFrame([(p - 2**64 if p >> 63 else p,) for p in prints], "print long")
    pairs = [(r.node_a % 2**64, r.node_b % 2**64) for r in simhash.links(frame).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    parts = simhash.components(simhash.links(frame))
    found = {r.node % 2**64: r.part for r in parts.collect()}
    want = plain_parts(prints)
    groups = {}
    for p, head in want.items():
        groups.setdefault(head, set()).add(p)
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
    assert len({found.get(p, p - 2**64 if p >> 63 else p) for p in prints}) == len(groups)


def test_query(spark):
    from matchmart.llm.registry import QUERIES
    out = QUERIES["op11_simhash_golay"](spark, SMALL)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert out.count() == table(spark, "documents").count()
