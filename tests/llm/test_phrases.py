"""Phrase collocations against a plain version and DuckDB."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchmart.llm import phrases
from tests.llm.helpers import SMALL, docs_frame, same_as_sql, table


def plain(rows, least):
    """(lang, phrase, a, l, r, n, score) of every candidate that stays."""
    f = defaultdict(Counter)
    n = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = Counter()
        for g, a in found.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i:i + k]] = max(a, inside[g[i:i + k]])
        for g, a in found.items():
            if g in inside and 100 * inside[g] >= 80 * a:
                continue
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, counts[g[:k]], counts[g[k:]], n[lang], score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in phrases.collocations(df).collect())


def random_rows(rng, count):
    words = ["New", "york", "city", "of", "the", "É", "x\x1cy"]
    seps = [" "] * 20 + ["  ", "\t", ". ", ",", "\n", "\x0b", " ? "]
    rows = []
    for i in range(count):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(0, 60)))
        rows.append((i % 7, rng.choice([text, text + " new York city", None]), rng.choice(["en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("vocabulary", [3, 8, 1 << 20])
def test_random_texts(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(phrases, "VOCABULARY", vocabulary)
    monkeypatch.setattr(phrases, "SHARD", 500)
    rows = random_rows(random.Random(vocabulary), 500)
    df = docs_frame(spark, rows)
    for name in ("phrase", "f", "a", "n", "words", "ids", "score"):
        df = df.withColumn(name, F.lit("x"))
    want = plain([r[1:] for r in rows], phrases.LEAST)
    assert len(want) > 20 and got(df) == want


def test_defined_cases(spark):
    empty = docs_frame(spark, [(1, "a b", "en")]).limit(0)
    assert got(empty) == []
    assert got(docs_frame(spark, [(1, None, None), (1, "", "en"), (2, ".,;", "en")])) == []
    rows = [(None, "p q " * 40, None), (1, "p q " * 200_000, "long"), (1, "same text", "en")] + [(1, "same text", "en")] * 29
    assert got(docs_frame(spark, rows)) == plain([r[1:] for r in rows], phrases.LEAST)


def test_permutation_can_be_undone():
    rng = np.random.default_rng(2)
    for n in (2, 3, 4):
        ids = [rng.integers(0, 1 << phrases.ID, 1000).astype(np.uint32) for _ in range(n)]
        key, rest = phrases.permute(ids)
        assert int(key.max()) < 1 << phrases._key_bits(n)
        for a, b in zip(ids, phrases.restore(n, key, rest)):
            assert (a == b).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 4), st.integers(0, 9), st.lists(st.tuples(st.integers(0, 2**63), st.integers(0, 2**21 - 1),
                                                               st.integers(1, 10**12)), min_size=1, max_size=50))
def test_filters_lose_nothing(n, shard_bits, entries):
    bits = phrases._key_bits(n)
    shard = 5 % (1 << shard_bits)
    key = np.array([shard << (bits - shard_bits) | k % (1 << (bits - shard_bits)) for k, _, _ in entries], np.uint64)
    rest = np.array([r if n == 4 else 0 for _, r, _ in entries], np.uint64)
    key, rest, f = phrases._added(key, rest, np.array([f for _, _, f in entries], np.int64))
    data = phrases.filter_bytes(n, shard_bits, key, rest, f)
    for a, b in zip((key, rest, f), phrases.filter_entries(n, shard_bits, shard, len(key), data)):
        assert (a == b).all()


def test_long_text_parts_only_at_breaks(monkeypatch):
    monkeypatch.setattr(phrases, "ROW", 10)
    monkeypatch.setattr(phrases, "tokens", lambda data: (data[k:k + 40].split() for k in range(0, len(data), 40)))

    class Words:
        value = [("en", b"a"), ("en", b"b")]

    class Batch:
        pass

    monkeypatch.setattr(phrases, "_texts", lambda batch: [("en", b"a b a b a . " * 30), ("en", b"b " * 40)])
    rows = list(phrases._encoder(Words)([Batch()]))
    runs = [np.frombuffer(r.column(0)[0].as_py(), "<u4") for r in rows]
    pieces = [tuple(p) for run in runs for p in "".join(map(str, run)).split("0") if p]
    assert len(runs) > 3 and sorted(pieces) == sorted([tuple("12121")] * 30 + [tuple("2" * 40)])


def test_given_documents(spark):
    from matchmart.llm.registry import ORACLE, QUERIES
    out = QUERIES["op13_phrases"](spark, SMALL)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    same_as_sql(out, ORACLE["op13_phrases"])
    rows = [tuple(r) for r in table(spark, "documents").select("text", "lang").collect()]
    assert got(table(spark, "documents")) == plain(rows, phrases.LEAST)
